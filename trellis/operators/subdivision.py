"""Splitting oversized groups again and again, and the nodes that tie the parts of a split together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from .graph import components

c = F.col


def _start(members: DataFrame) -> DataFrame:
    """(id, component, open): groups are called by their smallest id, so that names stay unique when they split."""
    names = members.groupBy("component").agg(F.min("id").alias("name"))
    return cut(members.select("id", "component").join(names, "component").select("id", c("name").alias("component"), F.lit(True).alias("open")))


def _inside(member: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, a, b, weight) of the edges with both ends in one group."""
    ends = [member.select(c("id").alias(x), c("component").alias(f"c{x}")) for x in "ab"]
    both = edges.where("a != b and weight is not null").join(ends[0], "a").join(ends[1], "b").where("ca = cb")
    return both.select(c("ca").alias("component"), "a", "b", c("weight").cast("double").alias("weight"))


def _cut(member: DataFrame, inside: DataFrame, at: DataFrame) -> DataFrame:
    """(id, old, component, split) of the groups of `at` (component, t), cut at their thresholds."""
    strong = inside.join(at, "component").where("weight >= t").select(c("a").alias("source_id"), c("b").alias("target_id"))
    of = member.join(at.select("component"), "component", "left_semi")
    parts = of.select("id", c("component").alias("old")).join(components(of.select("id"), strong), "id")
    # the part of the smallest id keeps the old name, so any other name tells of a split
    split = parts.groupBy("old").agg(F.max(c("component") != c("old")).alias("split"))
    return cut(parts.join(split, "old").select("id", "old", "component", "split"))


def _after(member: DataFrame, parts: DataFrame) -> DataFrame:
    new = parts.select("id", c("component").alias("to"), "split")
    kept = F.coalesce("split", F.lit(False))
    return cut(member.join(new, "id", "left").select("id", F.coalesce("to", "component").alias("component"), kept.alias("open")))


def _large(member: DataFrame, max_size: int, min_size: int = 0) -> DataFrame:
    return member.where("open").groupBy("component").agg(F.count("*").alias("n")).where((c("n") > max_size) & (c("n") >= min_size)).select("component")


def subdivide(members: DataFrame, edges: DataFrame, max_size: int) -> DataFrame:
    """(id, component): groups of more than max_size nodes are cut at the median weight of their inner
    edges, or, where that leaves them whole, at the upper quartile if it is more than 0.01 off; parts
    that are still too large are cut again. What no cut divides stays whole.

    A round treats all groups at once. The quantiles come from counts of distinct weights, so a
    window orders one row for each weight, not each edge. Parts are called by their smallest id.
    """
    member = _start(members)
    e = cut(_inside(member, edges).select("a", "b", "weight"))
    while True:
        inside = _inside(member.join(_large(member, max_size), "component", "left_semi"), e)
        weights = inside.groupBy("component", "weight").agg(F.count("*").alias("m"))
        upto = F.sum("m").over(Window.partitionBy("component").orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, 0))
        weights = weights.withColumn("upto", upto).withColumn("n", F.sum("m").over(Window.partitionBy("component")))
        rank = lambda d: F.max(F.when(c("upto") > F.floor(c("n") / d), c("weight")))
        at = cut(weights.groupBy("component").agg(rank(2).alias("t"), rank(4).alias("upper")))
        if at.isEmpty():
            return member.select("id", "component")
        parts = _cut(member, inside, at.select("component", "t"))
        whole = parts.where("not split").select(c("old").alias("component")).distinct()
        again = at.join(whole, "component", "left_semi").where("abs(upper - t) > 0.01").select("component", c("upper").alias("t"))
        if not again.isEmpty():
            second = _cut(member, inside, again)
            parts = parts.join(again.select(c("component").alias("old")), "old", "left_anti").select(*second.columns).unionByName(second)
        member = _after(member, parts)


def subdivide_by_gaps(members: DataFrame, forest: DataFrame, max_size: int, min_size: int, levels: int) -> DataFrame:
    """(id, component): groups of more than max_size nodes are cut at the tightest of the thresholds in the
    levels - 1 widest gaps between the weights at which their nodes merge (with fewer merges than
    levels, at the highest weight); parts of min_size nodes or more are cut again while too large.

    `forest` is a maximum spanning forest of the edges inside the groups (`hierarchy.merges`): cut to
    a part it is the part's own. If the tightest level leaves a group whole, so do all others.
    Equal weights are gaps of nothing, taken after all wider ones.
    """
    member = _start(members)
    e = cut(_inside(member, forest).select("a", "b", "weight"))
    least = 0
    while True:
        inside = _inside(member.join(_large(member, max_size, least), "component", "left_semi"), e)
        w = inside.groupBy("component", "weight").agg(F.count("*").alias("m"))
        above = F.lag("weight").over(Window.partitionBy("component").orderBy(F.desc("weight")))
        w = w.withColumn("above", above).withColumn("gap", c("above") - c("weight"))
        w = w.withColumn("k", F.row_number().over(Window.partitionBy("component").orderBy(F.desc_nulls_last("gap"), F.desc("weight"))))
        merged = F.sum("m")
        in_gaps = F.max(F.when((c("k") < levels) & c("gap").isNotNull(), (c("above") + c("weight")) / 2))
        spare = F.count("gap") < levels - 1
        tight = F.greatest(in_gaps, F.when(spare, F.max(F.when(c("m") > 1, c("weight")))))
        at = w.groupBy("component").agg(F.when(merged < levels, F.max("weight")).otherwise(tight).alias("t"))
        at = cut(at.where("t is not null"))
        if at.isEmpty():
            return member.select("id", "component")
        member = _after(member, _cut(member, inside, at))
        least = min_size


def _both(edges: DataFrame) -> DataFrame:
    e = edges.where("a != b and weight is not null")
    return e.select("a", "b", "weight").unionAll(e.select(c("b").alias("a"), c("a").alias("b"), "weight"))


def bridges(members: DataFrame, edges: DataFrame, delta: float) -> DataFrame:
    """(parent, id) of the members (id, parent, threshold) whose strongest edge, of all edges, lies
    within delta of their group's threshold."""
    strongest = _both(edges).groupBy(c("a").alias("id")).agg(F.max("weight").alias("most"))
    return members.join(strongest, "id").where(F.abs(c("most") - c("threshold")) < delta).select("parent", "id")


def bridge_children(found: DataFrame, children: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent, child, id): each bridge once for each child (id, parent, child) of its group that it has an edge to."""
    other = children.select(c("id").alias("b"), "parent", "child")
    return found.join(_both(edges).withColumnRenamed("a", "id"), "id").join(other, ["parent", "b"]).select("parent", "child", "id").distinct()


def sibling_edges(children: DataFrame, found: DataFrame, edges: DataFrame) -> DataFrame:
    """(parent, a, b, weight, bridges): for children of one parent the mean weight of the edges between them,
    0 without any, and the bridges that touch both. Pairs with neither have no row."""
    x = children.select(c("id").alias("a"), "parent", c("child").alias("ca"))
    y = children.select(c("id").alias("b"), "parent", c("child").alias("cb"))
    links = edges.where("a != b and weight is not null").select("a", "b", "weight").join(x, "a").join(y, ["parent", "b"]).where("ca != cb")
    pair = [F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")]
    means = links.select("parent", *pair, "weight").groupBy("parent", "a", "b").agg(F.avg("weight").alias("weight"))
    touched = bridge_children(found, children, edges)
    two = touched.withColumnRenamed("child", "ca").join(touched.withColumnRenamed("child", "cb"), ["parent", "id"]).where("ca < cb")
    shared = two.groupBy("parent", c("ca").alias("a"), c("cb").alias("b")).agg(F.array_sort(F.collect_set("id")).alias("bridges"))
    out = means.join(shared, ["parent", "a", "b"], "full")
    return out.select("parent", "a", "b", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("bridges", F.array().cast("array<string>")).alias("bridges"))
