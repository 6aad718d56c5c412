"""Tidying the tree: merges of similar siblings, collapse of routing levels, and the fixed pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..functions.text import jaccard
from . import relational as R
from .hierarchy import flatten_single_chains, merge_map
from .trees import true_depths

c = F.col


def _label() -> Column:
    return F.coalesce("cluster_label", "ai_title", "title")


def similar_sibling_names(nodes: DataFrame, least: float = 0.75) -> DataFrame:
    """(a, b): the two children of a binary parent whose names share enough words."""
    cats = nodes.where("not is_item and parent_id is not null").select("id", "parent_id", _label().alias("name"))
    two = cats.groupBy("parent_id").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).where("n = 2")
    pairs = two.join(cats.select(c("id").alias("a"), c("name").alias("na")), "a").join(cats.select(c("id").alias("b"), c("name").alias("nb")), "b")
    return pairs.where(jaccard(c("na"), c("nb")) >= least).select("a", "b")


def merge_similar_siblings(nodes: DataFrame, least: float = 0.75) -> DataFrame:
    return merge_map(nodes, similar_sibling_names(nodes, least))


def collapse_binary(nodes: DataFrame, min_depth: int = 2, max_fanout: int = 15, max_rounds: int = 32) -> DataFrame:
    """(id, parent_id) after routing categories with two child categories gave them to their parent, if that stays
    small, to a fixpoint. A round takes, of each parent, the first that qualifies, so rounds do not depend on order."""
    tree = cut(nodes.select("id", "parent_id", "is_item", "depth"))
    for _ in range(max_rounds):
        kids = tree.where("parent_id is not null").groupBy(c("parent_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(~c("is_item")).alias("cats"))
        routing = tree.where((~c("is_item")) & (c("depth") >= min_depth)).join(kids.where("n = 2 and cats = 2").select("id"), "id", "left_semi")
        routing = routing.join(kids.select(c("id").alias("parent_id"), c("n").alias("fan")), "parent_id").where(c("fan") + 1 <= max_fanout)
        ok = routing.groupBy("parent_id").agg(F.min("id").alias("id"))
        # a category whose parent goes in this round waits for the next
        ok = cut(ok.join(ok.select(c("id").alias("parent_id")), "parent_id", "left_anti"))
        if ok.isEmpty():
            break
        up = ok.select(c("id").alias("__c"), c("parent_id").alias("__g"))
        out = tree.join(up, c("id") == c("__c"), "left_anti").join(up, c("parent_id") == c("__c"), "left")
        tree = cut(out.select("id", F.coalesce("__g", "parent_id").alias("parent_id"), "is_item", F.when(c("__g").isNotNull(), c("depth") - 1).otherwise(c("depth")).alias("depth")))
    return tree.select("id", "parent_id")


def flatten_uncategorised(nodes: DataFrame) -> DataFrame:
    """(id, parent_id) without pass-through categories named so."""
    gone = nodes.where((~c("is_item")) & ~c("is_universe") & F.lower(_label()).isin("uncategorized", "uncategorised")).select("id", c("parent_id").alias("to"))
    out = nodes.select("id", "parent_id").join(gone.select("id"), "id", "left_anti")
    return out.join(gone.select(c("id").alias("parent_id"), "to"), "parent_id", "left").select("id", F.coalesce("to", "parent_id").alias("parent_id"))


def with_parents(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """nodes that parents (id, parent_id) still has, with these parents."""
    return nodes.drop("parent_id").join(parents, "id")


def tidy(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) after the fixed steps: flatten, merge a child named as its parent, drop empty categories,
    give orphans to the root, prune dead and double edges, set depths and counts."""
    n = with_parents(nodes, flatten_uncategorised(nodes))
    n = cut(with_parents(n, flatten_single_chains(n)))
    name = F.lower(_label())
    same = n.where("not is_item").select("id", "parent_id", name.alias("x")).join(n.select(c("id").alias("parent_id"), name.alias("y")), "parent_id").where("x = y").select(c("id").alias("__c"), c("parent_id").alias("__g"))
    n = n.join(same, c("id") == c("__c"), "left_anti").join(same, c("parent_id") == c("__c"), "left").withColumn("parent_id", F.coalesce("__g", "parent_id")).drop("__c", "__g")
    n = cut(n)
    filled = n.where("parent_id is not null").select(c("parent_id").alias("__p")).distinct()
    empty = n.where("not is_item and not is_universe").join(filled, c("id") == c("__p"), "left_anti").select("id")
    n = cut(R.delete(n, empty))
    lost = R.orphan_items(n).select(c("id").alias("__o"))
    n = n.join(lost, c("id") == c("__o"), "left").withColumn("parent_id", F.when(c("__o").isNotNull(), F.lit("root")).otherwise(c("parent_id"))).drop("__o")
    n = cut(n)
    depth = true_depths(n).select("id", c("depth").alias("__d"))
    kids = n.where("parent_id is not null").groupBy(c("parent_id").alias("id")).agg(F.count("*").cast("int").alias("__n"))
    n = n.join(depth, "id", "left").join(kids, "id", "left").withColumn("depth", F.coalesce("__d", "depth")).withColumn("child_count", F.coalesce("__n", F.lit(0))).drop("__d", "__n")
    return n, R.oldest_edges(R.live_edges(edges, n))
