"""Running sums and maxima over a whole table in order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut

#: Rows of a range at most, unless rows are equal in the order.
RANGE_ROWS = 500_000


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """rows with columns for each of sums and maxima: the sum (0 before the first row) and the maximum
    (null before the first row) over all rows before the row in the order.

    Rows are cut into ranges of the order and treated within each range, and what the ranges before come
    to (one row a range) is added. The order should have no ties.
    """
    sums, maxima = sums or {}, maxima or {}

    def before(window, sums: dict[str, Column], maxima: dict[str, Column]) -> dict[str, Column]:
        return {k: F.coalesce(F.sum(x).over(window), F.lit(0)) for k, x in sums.items()} | {k: F.max(x).over(window) for k, x in maxima.items()}

    parts = -(-rows.count() // range_rows)
    if parts <= 1:
        return rows.withColumns(before(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1), sums, maxima))
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    totals = ranged.groupBy("__range").agg(*(F.sum(x).alias(f"__all_{k}") for k, x in sums.items()), *(F.max(x).alias(f"__all_{k}") for k, x in maxima.items()))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    named = [{k: F.col(f"__all_{k}") for k in some} for some in (sums, maxima)]
    totals = totals.select("__range", *(x.alias(f"__all_{k}") for k, x in before(earlier, *named).items()))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = before(inside, sums, maxima)
    out = ranged.withColumns({f"__own_{k}": x for k, x in own.items()}).join(F.broadcast(totals), "__range")
    both = {k: F.col(f"__own_{k}") + F.col(f"__all_{k}") for k in sums} | {k: F.greatest(f"__own_{k}", f"__all_{k}") for k in maxima}
    return out.withColumns(both).drop("__range", *(f"__{w}_{k}" for k in both for w in ("own", "all")))
