"""Graph analysis over edges (source_id, target_id) and nodes (id)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from ..model import EDGE_PRIORITY, OTHER_PRIORITY, STRUCTURAL_EDGES
from .ranges import running
from .relational import live_edges
from .trees import regions

c = F.col
DAY = 86_400_000


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id that can be reached. Alternating star contraction; the
    smallest neighbour of a node is a pre-aggregated minimum, joined back."""
    e = cut(edges.select(F.greatest("source_id", "target_id").alias("u"), F.least("source_id", "target_id").alias("v")).where("u != v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(c("v").alias("u"), c("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(c("v").alias("u"), c("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(c("v").alias("u"), c("m").alias("v"))
        e = cut(small.union(low.select("u", c("m").alias("v"))).distinct())
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("id").join(e.select(c("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, incoming, outgoing) over edges with both ends; parallel edges count, a loop twice."""
    e = live_edges(edges, nodes)
    ends = e.select(c("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select("target_id", F.lit(0), F.lit(1)))
    n = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    zero = F.lit(0).cast("long")
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce(c("o") + c("i"), zero).alias("degree"), F.coalesce("i", zero).alias("incoming"), F.coalesce("o", zero).alias("outgoing"))


#: Least degrees of the histogram's buckets.
BUCKETS = (0, 1, 2, 4, 8, 16, 32)


def degree_histogram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(nodes, edges)
    return d.agg(*(F.count_if((c("degree") >= low) & (c("degree") < high)).alias(f"from_{low}") for low, high in zip(BUCKETS, [*BUCKETS[1:], 1 << 62], strict=True)))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    sizes = components(nodes, live_edges(edges, nodes)).groupBy("component").agg(F.count("*").alias("n"))
    parts = sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.min("n").alias("smallest"))
    d = degrees(nodes, edges).agg(F.count("*").alias("nodes"), F.count_if(c("degree") == 0).alias("orphans"), (F.sum("degree") / 2).cast("long").alias("edges"))
    return d.join(parts, F.lit(True))


def stale_nodes(nodes: DataFrame, edges: DataFrame, as_of: int, days: int, recent_days: int = 7) -> DataFrame:
    """Nodes not updated for some days that recent edges point to, with the number of these."""
    old = nodes.where(c("updated_at") < as_of - days * DAY).select("id", F.floor((F.lit(as_of) - c("updated_at")) / DAY).alias("age_days"))
    near = edges.where((c("created_at") > as_of - recent_days * DAY) & (c("created_at") <= as_of) & (c("source_id") != c("target_id"))).groupBy(c("target_id").alias("id")).agg(F.count("*").alias("recent"))
    return old.join(near, "id")


def stale_summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Summaries older than what they summarise, with the drift in whole days."""
    n = nodes.select("id", "updated_at")
    e = edges.where("kind = 'summarizes'").select(c("id").alias("edge"), "source_id", "target_id")
    e = e.join(n.select(c("id").alias("source_id"), c("updated_at").alias("s")), "source_id").join(n.select(c("id").alias("target_id"), c("updated_at").alias("t")), "target_id")
    return e.where("t > s").select("edge", F.floor((c("t") - c("s")) / DAY).alias("drift_days"))


def freshness(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Summaries that touch a node, from either side, and whether they are fresh."""
    n = nodes.select("id", "updated_at")
    e = edges.where((c("kind") == "summarizes") & ((c("source_id") == node) | (c("target_id") == node))).select(c("id").alias("edge"), "source_id", "target_id")
    e = e.join(n.select(c("id").alias("source_id"), c("updated_at").alias("s")), "source_id").join(n.select(c("id").alias("target_id"), c("updated_at").alias("t")), "target_id")
    return e.select("edge", F.when(c("source_id") == node, "summary").otherwise("target").alias("side"), (c("s") >= c("t")).alias("fresh"))


def breadth_first(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, parent, level) of a breadth-first forest over edges (a, b) from the roots (id), of several parents the
    smallest. A round extends all trees by a level."""
    steps = edges.select(c("a").alias("at"), c("b").alias("to")).unionByName(edges.select(c("b").alias("at"), c("a").alias("to")))
    seen = level = cut(roots.select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level")))
    k = 0
    while True:
        k += 1
        met = level.select(c("id").alias("at")).join(steps, "at").groupBy(c("to").alias("id")).agg(F.min("at").alias("parent"))
        level = cut(met.join(seen, "id", "left_anti").select("id", "parent", F.lit(k).alias("level")))
        if level.isEmpty():
            return seen
        seen = cut(seen.unionByName(level))


def _up_the_forest(forest: DataFrame, values: DataFrame, fns: dict[str, Callable[[str], Column]]) -> DataFrame:
    """values (id, columns of fns) with each column aggregated over the node's subtree, level by level from the deepest."""
    rows = cut(forest.join(values, "id"))
    deepest = rows.agg(F.max("level")).first()[0]
    if deepest is None:
        return rows
    done = level = cut(rows.where(c("level") == deepest))
    for k in range(deepest - 1, -1, -1):
        below = level.groupBy(c("parent").alias("id")).agg(*(fn(x).alias(f"_{x}") for x, fn in fns.items()))
        both = [c("id"), c("parent"), c("level")] + [F.array_compact(F.array(x, f"_{x}")).alias(x) for x in fns]
        one = {x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y) if fn is F.sum else F.array_min(x) if fn is F.min else F.array_max(x) for x, fn in fns.items()}
        level = cut(rows.where(c("level") == k).join(below, "id", "left").select(*both).withColumns(one))
        done = done.unionByName(level)
    return cut(done)


def cut_points(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articulation points (id), bridges (a, b)) of the simple graph, without a task that holds a component.

    Over a breadth-first forest, numbered in preorder, each subtree is a range of numbers, and a
    tree edge is a bridge if no other edge leaves the range of its lower end. Blocks (sets of edges no single
    node parts) are components of a graph on the tree edges, after Tarjan and Vishkin:
    an edge beside the forest joins the tree edges above its ends, and a tree edge joins the one above
    it if some edge of its subtree reaches outside the upper end's range. A node in several blocks is an
    articulation point. Rounds are as many as the forest has levels."""
    e = cut(live_edges(edges, nodes).select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).where("a != b").distinct())
    linked = e.select(c("a").alias("id")).union(e.select("b")).distinct()
    roots = components(linked, e.select(c("a").alias("source_id"), c("b").alias("target_id"))).select(c("component").alias("id")).distinct()
    forest = breadth_first(e, roots)
    sized = _up_the_forest(forest, forest.select("id", F.lit(1).cast("long").alias("size")), {"size": F.sum})
    # preorder: a node comes after its parent and its earlier siblings' subtrees
    order = [c("level"), c("parent").asc_nulls_first(), c("id")]
    laid = cut(running(sized, order, {"before": c("size")}))
    first = laid.groupBy(c("level").alias("l"), c("parent").alias("p")).agg(F.min("before").alias("first"))
    laid = cut(laid.join(first, (c("level") == c("l")) & c("parent").eqNullSafe(c("p"))).select("id", "parent", "level", "size", (c("before") - c("first")).alias("offset")))
    level = numbered = cut(laid.where("level = 0").select("id", "parent", "level", "size", c("offset").alias("pre")))
    for k in range(1, (laid.agg(F.max("level")).first()[0] or 0) + 1):
        up = level.select(c("id").alias("parent"), c("pre").alias("above"))
        level = cut(laid.where(c("level") == k).join(up, "parent").select("id", "parent", "level", "size", (c("above") + 1 + c("offset")).alias("pre")))
        numbered = numbered.unionByName(level)
    numbered = cut(numbered)
    tree = numbered.where("parent is not null").select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    beside = e.join(tree, ["a", "b"], "left_anti")
    pre = numbered.select("id", "pre")
    ends = beside.select(c("a").alias("id"), c("b").alias("far")).unionByName(beside.select(c("b").alias("id"), c("a").alias("far")))
    reach = ends.join(pre.select(c("id").alias("far"), c("pre").alias("to")), "far").groupBy("id").agg(F.min("to").alias("low"), F.max("to").alias("high"))
    reach = pre.join(reach, "id", "left").select("id", F.least("pre", "low").alias("low"), F.greatest("pre", "high").alias("high"))
    spans = _up_the_forest(forest, reach, {"low": F.min, "high": F.max}).select("id", "low", "high")
    full = cut(numbered.join(spans, "id"))
    inside = (c("low") >= c("pre")) & (c("high") < c("pre") + c("size"))
    bridges = cut(full.where(c("parent").isNotNull() & inside).select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b")))
    upper = full.select(c("id").alias("parent"), c("pre").alias("ppre"), c("size").alias("psize"), c("parent").alias("grand"))
    out = full.join(upper, "parent").where("grand is not null and (low < ppre or high >= ppre + psize)")
    joined = beside.select(c("a").alias("source_id"), c("b").alias("target_id")).unionByName(out.select(c("parent").alias("source_id"), c("id").alias("target_id")))
    lower = full.where("parent is not null").select("id", "parent")
    blocks = cut(components(lower.select("id"), joined).join(lower, "id"))
    touched = blocks.select("id", "component").union(blocks.select("parent", "component"))
    points = cut(touched.groupBy("id").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("id"))
    return points, bridges


def fragile_regions(nodes: DataFrame, edges: DataFrame, at_most: int = 2) -> DataFrame:
    """Pairs of regions that few edges connect."""
    r = cut(regions(nodes).where("region != 'unassigned'"))
    e = edges.select("source_id", "target_id").join(r.select(c("id").alias("source_id"), c("region").alias("ra")), "source_id").join(r.select(c("id").alias("target_id"), c("region").alias("rb")), "target_id")
    return e.where("ra != rb").groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.count("*").alias("n")).where(c("n") <= at_most)


def health(nodes: int, orphans: int, components_: int, stale: int, fragile: int) -> float:
    """0 to 1: connectivity .30, components .25, staleness .25, fragility .20, each falling to 0 at its cap."""
    if nodes == 0:
        return 1.0
    connectivity = max(0.0, 1 - 5 * min(orphans / nodes, 0.2))
    whole = 1 / max(1, components_)
    fresh = max(0.0, 1 - 10 * min(stale / nodes, 0.1))
    firm = max(0.0, 1 - 20 * min(fragile / nodes, 0.05))
    return 0.30 * connectivity + 0.25 * whole + 0.25 * fresh + 0.20 * firm


def priority(kind: str = "kind") -> Column:
    out = F.lit(OTHER_PRIORITY)
    for value in sorted(set(EDGE_PRIORITY.values())):
        out = F.when(c(kind).isin(*(k for k, v in EDGE_PRIORITY.items() if v == value)), value).otherwise(out)
    return out


def relevant_edges(edges: DataFrame, node: str, top: int, not_superseded: bool = False) -> DataFrame:
    """A node's edges by 0.3 recency + 0.3 confidence + 0.4 type priority."""
    e = edges.where((c("source_id") == node) | (c("target_id") == node))
    e = e.where("superseded_by is null") if not_superseded else e
    w = Window.partitionBy()
    span = F.max("created_at").over(w) - F.min("created_at").over(w)
    recent = F.when(span > 0, (c("created_at") - F.min("created_at").over(w)) / span).otherwise(1.0)
    score = F.round(0.3 * recent + 0.3 * F.coalesce("confidence", F.lit(0.5)) + 0.4 * priority(), 6)
    return e.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(top)


def edge_cost() -> Column:
    base = F.greatest((1 - F.coalesce("confidence", F.lit(0.5))) * (1 - 0.5 * priority()), F.lit(0.001))
    return F.when(c("kind").isin(*STRUCTURAL_EDGES), F.greatest(base, F.lit(0.4))).otherwise(base)


def expand_context(nodes: DataFrame, edges: DataFrame, anchors: list[str], budget: int = 20, max_hops: int = 6, max_cost: float = 3.0, allow: list[str] | None = None, deny: list[str] | None = None, not_superseded: bool = False, items_only: bool = False) -> DataFrame:
    """(anchor, rank, id, distance, relevance, hops, path): what is nearest to each anchor over
    undirected edges, by cost. The path is the edge type and node of each hop.

    Frontier relaxation: each round joins the nodes whose distance fell to the edges and keeps
    the best state of each node (distance, then hops, then path), at most max_hops rounds; of
    parallel edges the cheapest counts."""
    e = edges.where("superseded_by is null") if not_superseded else edges
    e = e.where(c("kind").isin(*allow)) if allow else e
    e = e.where(~c("kind").isin(*deny)) if deny else e
    e = e.withColumn("cost", edge_cost()).where(c("cost") <= max_cost)
    steps = e.select(c("source_id").alias("id"), c("target_id").alias("to"), "cost", "kind").unionByName(e.select(c("target_id").alias("id"), c("source_id").alias("to"), "cost", "kind")).where("id != to")
    steps = cut(steps.groupBy("id", "to").agg(F.min(F.struct("cost", "kind")).alias("best")).select("id", "to", "best.cost", "best.kind"))
    state = "struct<distance:double,hops:int,path:string>"
    settled = cut(nodes.where(c("id").isin(*anchors)).select(c("id").alias("anchor"), "id", F.struct(F.lit(0.0).alias("distance"), F.lit(0).alias("hops"), F.lit("").alias("path")).cast(state).alias("s")))
    frontier = settled
    for _ in range(max_hops):
        new = frontier.join(steps, "id").select("anchor", c("to").alias("id"), F.struct((c("s.distance") + c("cost")).alias("distance"), (c("s.hops") + 1).alias("hops"), F.concat("s.path", F.lit("/"), "kind", F.lit(":"), "to").alias("path")).cast(state).alias("n"))
        new = new.where(c("n.distance") <= max_cost).groupBy("anchor", "id").agg(F.min("n").alias("n"))
        both = cut(settled.join(new, ["anchor", "id"], "full").select("anchor", "id", F.least("s", "n").alias("best"), (c("s").isNull() | (c("n.distance") < c("s.distance"))).alias("moved")))
        settled = both.select("anchor", "id", c("best").alias("s"))
        frontier = both.where("moved").select("anchor", "id", c("best").alias("s"))
        if frontier.isEmpty():
            break
    found = settled.where("anchor != id").join(nodes.select("id", "is_item"), "id")
    found = found.where("is_item") if items_only else found
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy("s.distance", "id"))
    return found.withColumn("rank", rank).where(c("rank") <= budget).select("anchor", "rank", "id", F.round("s.distance", 6).alias("distance"), F.round(1 / (1 + c("s.distance")), 6).alias("relevance"), "s.hops", "s.path")


def best_context(expanded: DataFrame) -> DataFrame:
    """Of several anchors' contexts each node with its best relevance."""
    return expanded.groupBy("id").agg(F.max("relevance").alias("relevance"), F.min_by("anchor", F.struct(-c("relevance"), c("anchor"))).alias("anchor"))


def simple_paths(edges: DataFrame, a: str, b: str, max_hops: int, limit: int = 20, kinds: list[str] | None = None) -> DataFrame:
    """Paths without repeated nodes, shortest first, then by name."""
    e = edges.where(c("kind").isin(*kinds)) if kinds else edges
    steps = e.select(c("source_id").alias("at"), c("target_id").alias("to")).union(e.select("target_id", "source_id")).distinct()
    at = edges.sparkSession.range(1).select(F.lit(a).alias("at"), F.array(F.lit(a)).alias("path"))
    out = None
    for _ in range(max_hops):
        at = at.where(c("at") != b).join(steps, "at").where(~F.array_contains("path", c("to"))).select(c("to").alias("at"), F.array_append("path", c("to")).alias("path"))
        done = at.where(c("at") == b).select(F.size("path").alias("n"), F.array_join("path", ">").alias("path"))
        out = done if out is None else out.unionByName(done)
    return out.select((c("n") - 1).alias("hops"), "path").orderBy("hops", "path").limit(limit)


def reach(edges: DataFrame, start: str, hops: int = 3) -> DataFrame:
    """(id, hops) by breadth."""
    steps = edges.select(c("source_id").alias("id"), c("target_id").alias("to")).union(edges.select("target_id", "source_id")).distinct()
    seen = cut(edges.sparkSession.range(1).select(F.lit(start).alias("id"), F.lit(0).alias("hops")))
    last = seen
    for k in range(1, hops + 1):
        last = cut(last.join(steps, "id").select(c("to").alias("id")).distinct().join(seen, "id", "left_anti").select("id", F.lit(k).alias("hops")))
        seen = cut(seen.unionByName(last))
    return seen


def community_split(members: pd.DataFrame, min_size: int = 2, sweeps: int = 20) -> list[list[str]]:
    """Groups of one set's nodes (rows a, b, weight): each node, in order of ids, moves to the
    neighbouring community with the largest share of its weight, until none moves."""
    names = sorted(set(members["a"]) | set(members["b"]))
    place = {x: k for k, x in enumerate(names)}
    near: list[dict[int, float]] = [{} for _ in names]
    for a, b, w in zip(members["a"], members["b"], members["weight"].tolist(), strict=True):
        near[place[a]][place[b]] = w
        near[place[b]][place[a]] = w
    label = list(range(len(names)))
    for _ in range(sweeps):
        moved = False
        for x, others in enumerate(near):
            pull: dict[int, float] = {}
            for y, w in others.items():
                k = label[y]
                pull[k] = pull.get(k, 0.0) + w
            most = max(pull.values())
            if most > pull.get(label[x], 0.0):
                label[x], moved = min(k for k, v in pull.items() if v == most), True
        if not moved:
            break
    groups: dict[int, list[str]] = {}
    for x, k in enumerate(label):
        groups.setdefault(k, []).append(names[x])
    return sorted(g for g in groups.values() if len(g) >= min_size)


def communities(edges: DataFrame, group: str, min_size: int = 2) -> DataFrame:
    """(group, community, id) of edges (group, a, b, weight): one bounded group a call, e.g. a tree level's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf[group].iloc[0], g[0], x) for g in community_split(pdf, min_size) for x in g]
        return pd.DataFrame(rows, columns=["group", "community", "id"])

    return edges.groupBy(group).applyInPandas(run, "group string, community string, id string")


def sibling_weights(cross: DataFrame) -> DataFrame:
    """Cross counts (a, b, n, size_a, size_b) as weights min(1, n / smaller size)."""
    return cross.withColumn("weight", F.round(F.least(F.lit(1.0), c("n") / F.greatest(F.lit(1), F.least("size_a", "size_b"))), 6))


def edge_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    p = nodes.select(c("id").alias("__n"), c("parent_id").alias("__p"))
    out = edges.join(p, c("source_id") == c("__n"), "left").withColumnRenamed("__p", "source_parent_id").drop("__n")
    return out.join(p, c("target_id") == c("__n"), "left").withColumnRenamed("__p", "target_parent_id").drop("__n")
