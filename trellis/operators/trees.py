"""Queries up and down the tree of nodes (id, parent_id, depth, ...).

Trees are walked level by level with joins on the parent, until a level is empty, however deep;
max_levels is for queries that are limited by definition. Chains that run into a cycle end
too: every CHECK_LEVELS levels what was reached before is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut

c = F.col
CHECK_LEVELS = 64


def _walk(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], max_levels: int | None) -> DataFrame:
    """The rows of start and of all levels after it; step gives (keys) of the next level, to which the level is added."""
    out = level = cut(start)
    k, cycles = 0, False
    while max_levels is None or k < max_levels:
        k += 1
        level = step(level).withColumn("level", F.lit(k))
        level = cut(level if k % CHECK_LEVELS else level.join(out, keys, "left_anti"))
        if level.isEmpty():
            break
        if k % CHECK_LEVELS == 0:
            cycles = True
            out = cut(out)
        out = out.unionByName(level)
    # a cycle gives pairs more than once, within the levels between two looks
    return out.groupBy(*keys).agg(F.min("level").alias("level")) if cycles else out


def descendants(nodes: DataFrame, roots: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(id, root, level) of everything under the roots (column id), which are level 0."""
    tree = nodes.where("parent_id is not null").select("id", "parent_id")

    def step(level: DataFrame) -> DataFrame:
        return tree.join(level.select(c("id").alias("parent_id"), "root"), "parent_id").where("id != root").select("id", "root")

    return _walk(roots.select("id", c("id").alias("root"), F.lit(0).alias("level")), step, ["id", "root"], max_levels)


def ancestors(nodes: DataFrame, start: DataFrame | None = None, max_levels: int | None = None) -> DataFrame:
    """(id, ancestor, level) of the start nodes (all by default), each its own ancestor at level 0."""
    parent = nodes.select(c("id").alias("ancestor"), c("parent_id").alias("__up"))
    known = nodes.select(c("id").alias("ancestor"))

    def step(level: DataFrame) -> DataFrame:
        up = level.join(parent, "ancestor").where("__up is not null").select("id", c("__up").alias("ancestor"))
        return up.join(known, "ancestor", "left_semi").select("id", "ancestor")

    return _walk((start if start is not None else nodes).select("id", c("id").alias("ancestor"), F.lit(0).alias("level")), step, ["id", "ancestor"], max_levels)


def subtree_nodes(nodes: DataFrame, root: str, items_only: bool = False) -> DataFrame:
    under = descendants(nodes, nodes.where(c("id") == root)).where("level > 0").select("id", "level")
    out = nodes.join(under, "id")
    return out.where("is_item") if items_only else out


def item_counts(nodes: DataFrame) -> DataFrame:
    """Items in the subtree of every node; an item counts itself."""
    up = ancestors(nodes, nodes.where("is_item"))
    n = up.groupBy("ancestor").agg(F.count("*").alias("n"))
    return nodes.select("id").join(n, c("id") == c("ancestor"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def true_depths(nodes: DataFrame) -> DataFrame:
    """(id, depth) of what can be reached from the universe."""
    return descendants(nodes, nodes.where("is_universe")).select("id", c("level").alias("depth"))


def wrong_depths(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", c("depth").alias("stored")).join(true_depths(nodes), "id").where("stored != depth")


def shift_depths(nodes: DataFrame, roots: DataFrame, by: int) -> DataFrame:
    """(id, depth) of all nodes after the subtrees of the roots moved by some levels."""
    moved = descendants(nodes, roots).select("id").distinct().withColumn("__m", F.lit(True))
    return nodes.join(moved, "id", "left").select("id", F.when(c("__m"), c("depth") + by).otherwise(c("depth")).alias("depth"))


def protected(nodes: DataFrame, containers: list[str]) -> DataFrame:
    return descendants(nodes, nodes.where(c("id").isin(*containers))).select("id").distinct()


def path_names(nodes: DataFrame, start: DataFrame) -> DataFrame:
    """Names from the root down to each start node."""
    up = ancestors(nodes, start).join(nodes.select(c("id").alias("ancestor"), F.coalesce("cluster_label", "ai_title", "title").alias("name")), "ancestor")
    parts = F.sort_array(F.collect_list(F.struct(c("level"), c("name"))), asc=False)
    return up.groupBy("id").agg(parts.alias("p")).select("id", F.array_join(F.transform("p", lambda x: x["name"]), " > ").alias("path"))


def is_ancestor(nodes: DataFrame, a: str, b: str, max_levels: int = 50) -> DataFrame:
    return ancestors(nodes, nodes.where(c("id") == b), max_levels).agg(F.coalesce(F.bool_or((c("ancestor") == a) & (c("level") > 0)), F.lit(False)).alias("found"))


def regions(nodes: DataFrame) -> DataFrame:
    """(id, region): the nearest ancestor of depth 1 or less, 'unassigned' if the chain breaks."""
    tops = nodes.where("depth <= 1").select(c("id").alias("ancestor"))
    up = ancestors(nodes).join(tops, "ancestor").groupBy("id").agg(F.min_by("ancestor", "level").alias("region"))
    return nodes.select("id").join(up, "id", "left").select("id", F.coalesce("region", F.lit("unassigned")).alias("region"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    i = ids.select(c("id").alias("__id"))
    return edges.join(i, c("source_id") == c("__id"), "left_semi").join(i, c("target_id") == c("__id"), "left_semi")


def latest_dates(nodes: DataFrame) -> DataFrame:
    """Groups get the latest date of the leaves under them, leaves their own."""
    inner = nodes.where("parent_id is not null").select(c("parent_id").alias("__p")).distinct()
    leaves = nodes.join(inner, c("id") == c("__p"), "left_anti")
    up = ancestors(nodes, leaves).join(leaves.select("id", "created_at"), "id")
    return up.groupBy(c("ancestor").alias("id")).agg(F.max("created_at").alias("latest"))


def lowest_privacy(nodes: DataFrame) -> DataFrame:
    """Categories get the lowest score of the items under them."""
    items = nodes.where("is_item and privacy is not null")
    up = ancestors(nodes, items).join(items.select("id", "privacy"), "id").where("level > 0")
    return up.groupBy(c("ancestor").alias("id")).agg(F.min("privacy").alias("privacy"))


def spread_privacy(nodes: DataFrame, root: str, value: float, force: bool = False) -> DataFrame:
    """(id, privacy) after a score was set on a subtree, where there is none or everywhere."""
    under = descendants(nodes, nodes.where(c("id") == root)).select("id").distinct().withColumn("__m", F.lit(True))
    change = F.coalesce(c("__m"), F.lit(False)) & (F.lit(force) | c("privacy").isNull())
    return nodes.join(under, "id", "left").select("id", F.when(change, F.lit(value)).otherwise(c("privacy")).alias("privacy"))


def supersession(edges: DataFrame, start: str, max_links: int = 50) -> DataFrame:
    """(id, step) along superseded_by, earlier versions with negative steps, of several the first by id."""
    link = edges.select("id", "superseded_by").dropDuplicates(["id"])
    here = cut(link.where(c("id") == start).select("id", F.lit(0).alias("step")))
    out = here
    for sign in (-1, 1):
        at = here
        for k in range(1, max_links + 1):
            if sign > 0:
                nxt = at.join(link, "id").where("superseded_by is not null").select(c("superseded_by").alias("id")).join(link.select("id"), "id", "left_semi")
            else:
                nxt = link.join(at.select(c("id").alias("superseded_by")), "superseded_by", "left_semi").select("id")
            at = cut(nxt.agg(F.min("id").alias("id")).where("id is not null").select("id", F.lit(sign * k).alias("step")))
            if at.isEmpty():
                break
            out = out.unionByName(at)
    return out


def tree_lines(nodes: DataFrame, root: str, max_depth: int) -> DataFrame:
    """(id, line): an indented listing to a depth, in order of `sort`."""
    tree = nodes.select("id", "parent_id", "title")
    level = cut(nodes.where(c("id") == root).select("id", "title", c("title").alias("sort"), F.lit(0).alias("level")))
    out = level
    for k in range(1, max_depth + 1):
        up = level.select(c("id").alias("parent_id"), c("sort").alias("__s"))
        level = cut(tree.join(up, "parent_id").select("id", "title", F.concat_ws("\x1f", "__s", "title", "id").alias("sort"), F.lit(k).alias("level")))
        out = out.unionByName(level)
    return out.select("id", "sort", F.concat(F.repeat(F.lit("  "), c("level")), "title").alias("line"))
