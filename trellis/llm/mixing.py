"""Mixing sources to target weights by Pareto order sampling.

Within a source longer documents are likelier: a document's expected number of copies goes with
a power of its size (of its size class, CLASSES to a doubling), up to the cap, at a level
at which the expected words are the source's target. The whole part of the expectation is certain
copies. For the rest, the inclusion probability p, each document draws a uniform u from a
hash of its content, and documents are ranked by the odds of u over the odds of p.
The lowest ranks are taken until the words that the source still lacks are reached: a sample of
fixed size (in words) with unequal probabilities. From the document that would cross
the target on, ranks are gone down further and what still fits is taken; at last one
document more, if it brings the sum nearer to the target.

No task gets all documents of a source: ranks fall into bins of about max(BIN_ROWS, sqrt(n))
documents, bins are summed with pre-aggregation, and only the bin in which the target
is crossed and the next are sorted. What is decided goes back to the documents as one
row for each source, so texts are never shuffled.

Defined cases: a null text has no words and size 0; a null source is a source of its
own, the last; repeated rows are documents of their own, and of rows that are equal in id,
source and text it does not matter which are taken; documents of equal rank are taken in the order of
rows; documents of no words may be taken but count nothing; a text of any length is one
document, whose size may exceed what a source lacks, and then it is passed over; an empty
table gives an empty result. Other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut as cut_to_table
from ..operators.ranges import running
from .common import SPACE_WORD, column, cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Expected copies go with this power of the size.
SIZE_POWER = 0.5
#: Size classes to a doubling of the size.
CLASSES = 8
#: Documents of a bin of ranks, at least.
BIN_ROWS = 1_000
#: Rows of a table of some rows for each source that may be broadcast.
BROADCAST_ROWS = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size, weight; one row for each source) with target: the
    sources share `share` of all words by weight, none above cap times its size, the
    excess going to the others by weight.

    Water filling: with sources in order of cap to weight, the capped ones are a prefix,
    and the level of the others follows from running sums.
    """
    rows = sizes.withColumn("__cap", F.lit(cap) * F.col("source_size")).withColumn("__at", F.col("__cap") / F.col("weight"))
    every = rows.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    rows = running(rows, [F.col("__at"), F.col("source").asc_nulls_last()], {"__capped": F.col("__cap"), "__weight": F.col("weight")})
    level = (F.lit(share * (every.words or 0)) - F.col("__capped")) / (F.lit(every.weight or 0.0) - F.col("__weight"))
    rows = rows.withColumn("__level", level).withColumn("__key", F.struct("__at", F.col("source").isNull().alias("none"), "source"))
    first = rows.where("__level * weight <= __cap").agg(F.min(F.struct("__key", "__level")).alias("f"))
    rows = rows.join(F.broadcast(first), how="cross")  # one row
    capped = F.col("f").isNull() | (F.col("__key") < F.col("f.__key"))
    filled = F.when(capped, F.col("__cap")).otherwise(F.least("__cap", F.col("f.__level") * F.col("weight")))
    return rows.withColumn("target", filled.cast("double")).select(*sizes.columns, "target")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """A weight for each source: the given ones in turn, by code point, null last."""
    ranked = running(sources, [F.col("source").asc_nulls_last()], {"__rank": F.lit(1)})
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int"))).drop("__rank")


def size_class(size: str) -> Column:
    return F.floor(CLASSES * F.log2(F.greatest(F.col(size), F.lit(1)).cast("double")) + 1e-9).cast("int")


def expected_copies(by_class: DataFrame, cap: float = CAP, size_power: float = SIZE_POWER) -> DataFrame:
    """by_class (source, cls, words, n, target, ...) with certain copies and the inclusion probability p of each
    size class, and for the source need (words that the sample still has to bring), n_open and mean_p."""
    w = F.pow(F.lit(2.0), F.lit(size_power / CLASSES) * F.col("cls"))
    source = Window.partitionBy("source")
    largest_first = source.orderBy(F.desc("cls"))
    larger = F.coalesce(F.sum("words").over(largest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weighed = F.sum(F.col("words") * F.col("w")).over(largest_first.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = by_class.withColumn("w", w).withColumn("level", F.try_divide(F.col("target") - F.lit(cap) * larger, weighed))
    first = F.max(F.when(F.col("level") * F.col("w") <= F.lit(cap) + 1e-12, F.struct("cls", "level"))).over(source)
    rows = rows.withColumn("first", first)
    expected = F.when(F.col("target") <= 0, 0.0).when(F.col("first").isNull() | (F.col("cls") > F.col("first.cls")), F.lit(cap)).otherwise(F.least(F.lit(cap), F.greatest(F.lit(0.0), F.col("first.level") * F.col("w"))))
    rows = rows.withColumn("e", expected).withColumn("certain", F.floor(F.col("e") + 1e-9).cast("long"))
    p = F.col("e") - F.col("certain")
    rows = rows.withColumn("p", F.when(p > 1e-9, p).otherwise(0.0))
    open_n = F.sum(F.when(F.col("p") > 0, F.col("n")).otherwise(0)).over(source)
    return rows.select("source", "source_size", "target", "cls", "certain", "p", (F.col("target") - F.sum(F.col("certain") * F.col("words")).over(source)).alias("need"), open_n.alias("n_open"), F.try_divide(F.sum(F.col("n") * F.col("p")).over(source), open_n).alias("mean_p"))


def _odds(p: Column) -> Column:
    return p / (1 - p)


def _joined(docs: DataFrame, by: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """Rows of by (n rows) to documents, by source (null matches null) and, where by has it, cls."""
    keys = [k for k in ("source", "cls") if k in by.columns]
    for k in keys:
        by = by.withColumnRenamed(k, f"__{k}")
    on = docs["source"].eqNullSafe(by["__source"])
    if "cls" in keys:
        on = on & (docs["cls"] == by["__cls"])
    return docs.join(F.broadcast(by) if n <= BROADCAST_ROWS else by, on, how).drop(*(f"__{k}" for k in keys))


def _ranked(rows: DataFrame) -> DataFrame:
    """With q, the rank's value, and bin; x is q made about uniform, for bins of about equal numbers near the target."""
    q = F.try_divide(_odds(F.col("u")), _odds(F.col("p")))
    o = F.col("q") * _odds(F.least(F.col("mean_p"), F.lit(1 - 1e-9)))
    bins = F.ceil(F.col("n_open") / F.greatest(F.lit(float(BIN_ROWS)), F.sqrt("n_open")))
    return rows.withColumn("q", q).withColumn("bin", F.least(bins - 1, F.floor(o / (1 + o) * bins)).cast("long"))


def _closed(edge: DataFrame) -> DataFrame:
    """For each source from the rows (source, need, before, q, row, size) of the crossing bin and the next: cut, the
    last of the lowest ranks that fit together, and extra, the rows after it that fit too or close the gap."""
    in_order = Window.partitionBy("source").orderBy("q", "row").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(in_order))
    fits = F.col("upto") <= F.col("need")
    after = F.when(~fits & (F.col("size") > 0), F.struct("q", "row", F.col("size").cast("double").alias("size")))
    by = edge.groupBy("source").agg(
        F.max(F.when(fits, F.struct("q", "row"))).alias("cut"),
        (F.first("need") - F.max(F.when(fits, F.col("upto")).otherwise(F.col("before")))).alias("lack"),
        F.sort_array(F.collect_list(after)).alias("after"),
    )
    start = F.struct(F.col("lack").cast("double").alias("left"), F.array().cast("array<bigint>").alias("rows"))
    fill = F.aggregate(
        F.filter("after", lambda x: x["size"] <= F.col("lack")),
        start,
        lambda acc, x: F.when(x["size"] <= acc["left"], F.struct((acc["left"] - x["size"]).alias("left"), F.concat(acc["rows"], F.array(x["row"])).alias("rows"))).otherwise(acc),
    )
    by = by.withColumn("fill", fill)
    off = F.transform(
        F.filter("after", lambda x: (F.abs(x["size"] - F.col("fill.left")) < F.col("fill.left")) & ~F.array_contains(F.col("fill.rows"), x["row"])),
        lambda x: F.struct(F.abs(x["size"] - F.col("fill.left")).alias("off"), x["q"].alias("q"), x["row"].alias("row")),
    )
    closing = F.array_min(off)["row"]
    return by.select("source", "cut", F.when(closing.isNull(), F.col("fill.rows")).otherwise(F.concat("fill.rows", F.array(closing))).alias("extra"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP,
    seed: int = 7, size_power: float = SIZE_POWER, keep: bool = False,
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken, u) for each row; with keep
    also the row's own columns, as struct `doc`."""
    h = F.xxhash64(F.lit(seed), column(id_col), column(source_col), column(text_col))
    u = (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    own = [F.struct(*(column(c) for c in docs.columns)).alias("doc")] if keep else []
    base = docs.select(column(id_col).alias("id"), column(source_col).cast("string").alias("source"), word_count(column(text_col).cast("string")).alias("size"), u.alias("u"), *own)
    # a table, so that the passes below read only the narrow columns
    base = cut_to_table(base.withColumn("row", F.monotonically_increasing_id())).withColumn("cls", size_class("size"))
    by_class = cut(base.groupBy("source", "cls").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    sizes = by_class.groupBy("source").agg(F.sum("words").alias("source_size"))
    sources = targets(cycled_weights(sizes, weights), share, cap).select("source", "source_size", "target")
    # some rows for each source: no fewer than of the other tables below
    n = by_class.count()
    design = cut(expected_copies(_joined(by_class, sources, n), cap, size_power))
    ranked = _ranked(_joined(base.select("source", "size", "u", "row", "cls"), design.where("p > 0"), n))
    running_words = Window.partitionBy("source").orderBy("bin")
    filled = ranked.groupBy("source", "bin", "need").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(running_words))
    crossing = filled.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("need"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before")))).alias("cross"))
    crossing = cut(crossing.where("cross is not null").select("source", F.col("cross.bin").alias("cross_bin"), F.col("cross.before").alias("before")))
    edge = _joined(ranked, crossing, n).where("bin between cross_bin and cross_bin + 1")
    closed = cut(_joined(_closed(edge), crossing.select("source", "cross_bin"), n))
    out = _ranked(_joined(_joined(base, design.drop("need"), n), closed, n, "left"))
    lowest = F.col("cross_bin").isNull() | (F.col("bin") < F.col("cross_bin")) | ((F.col("bin") == F.col("cross_bin")) & F.coalesce(F.struct("q", "row") <= F.col("cut"), F.lit(False)))
    more = (F.col("p") > 0) & (lowest | F.coalesce(F.array_contains("extra", F.col("row")), F.lit(False)))
    copies = F.least(F.col("certain") + F.coalesce(more, F.lit(False)).cast("long"), F.lit(int(cap)).cast("long"))
    return out.select("id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "u", *(["doc"] if keep else []))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    mixed = mix(docs, keep=True, **options).where("copies > 0")
    return mixed.select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc")).select("doc.*")
