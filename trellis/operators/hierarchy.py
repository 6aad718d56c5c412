"""Building and tidying the hierarchy of categories from weighted edges (a, b, weight)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut
from .graph import community_split, components
from .ranges import running
from .relational import weight_statistics

c = F.col

# Least share of the second largest child by size, sizes from which it holds.
RATIOS = ((500, 0.01), (200, 0.03), (50, 0.08), (0, 0.15))
# Factors on the least size by depth.
SIZE_FACTORS = (1, 2, 4, 8, 100)


def merges(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(a, b, weight): a maximum spanning forest, whose weights are the heights at which single
    linkage merges. Boruvka: each round every component takes its strongest edge out, ties
    by the ends, and components that follow each other's edges become one by pointer jumping;
    they at least halve, so there are few rounds."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").where("a != b").groupBy("a", "b").agg(F.max("weight").alias("weight"))
    e = cut(e.select("a", "b", "weight", c("a").alias("ca"), c("b").alias("cb")))
    chosen = e.select("a", "b", "weight").limit(0)
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        ends = e.select(c("ca").alias("component"), c("cb").alias("to"), "weight", "a", "b").unionByName(e.select(c("cb").alias("component"), c("ca").alias("to"), "weight", "a", "b"))
        best = cut(ends.groupBy("component").agg(F.min(F.struct((-c("weight")).alias("w"), "a", "b", "to")).alias("m")).select("component", "m.to", "m.a", "m.b", (-c("m.w")).alias("weight")))
        chosen = chosen.unionByName(best.select("a", "b", "weight").distinct())
        # each component follows its edge; two that follow each other end at the smaller
        back = best.select(c("component").alias("to"), c("to").alias("back"))
        up = best.join(back, "to").select("component", F.when((c("back") == c("component")) & (c("component") < c("to")), c("component")).otherwise(c("to")).alias("to"))
        up = cut(up)
        for _ in range(max_rounds):
            jumped = cut(up.join(up.select(c("component").alias("to"), c("to").alias("further")), "to").select("component", c("further").alias("to"), (c("further") != c("to")).alias("moved")))
            up = jumped.select("component", "to")
            if jumped.where("moved").isEmpty():
                break
        else:
            raise RuntimeError("merges did not settle")
        ra, rb = up.select(c("component").alias("ca"), c("to").alias("na")), up.select(c("component").alias("cb"), c("to").alias("nb"))
        e = cut(e.join(ra, "ca").join(rb, "cb").where("na != nb").select("a", "b", "weight", c("na").alias("ca"), c("nb").alias("cb")))
    else:
        if not e.isEmpty():
            raise RuntimeError("merges did not settle")
    return cut(chosen.distinct())


def cut_at(nodes: DataFrame, forest: DataFrame, threshold: float) -> DataFrame:
    """(id, component) at a threshold."""
    return components(nodes, forest.where(c("weight") >= threshold).select(c("a").alias("source_id"), c("b").alias("target_id")))


def dynamic_thresholds(n: int, forest: DataFrame, factor: float = 1.3, plus: int = 5) -> DataFrame:
    """(threshold, components) from .50 to .95: a level where components grow by a factor or a number. The
    number at t is n less the merges at t or above, so one aggregation gives all."""
    grid = [round(0.5 + 0.02 * k, 2) for k in range(23)]
    counts = forest.agg(*(F.count_if(c("weight") >= t).alias(f"t{k}") for k, t in enumerate(grid))).first()
    out, last = [], None
    for k, t in enumerate(grid):
        parts = n - counts[k]
        if last is None or parts >= factor * last or parts >= last + plus:
            out.append((t, parts))
            last = parts
    return forest.sparkSession.createDataFrame(out, "threshold double, components long")


def percentile_thresholds(forest: DataFrame, percents: list[int], apart: float = 0.001) -> list[float]:
    """Weights at sorted[n*p/100], those closer than `apart` to the one before left out."""
    w = cut(forest.where("weight is not null").groupBy("weight").agg(F.count("*").alias("m")))
    n = w.agg(F.sum("m")).first()[0] or 0
    # the distinct weights in order, each with the places that it takes
    placed = running(w, [c("weight")], {"before": c("m")})
    wanted = [min(n - 1, n * p // 100) for p in percents] if n else []
    picked = sorted(r.weight for r in placed.where(reduce(or_, ((c("before") <= k) & (c("before") + c("m") > k) for k in wanted), F.lit(False))).select("weight").collect())
    return apart_from_each_other(picked, apart)


def apart_from_each_other(thresholds: list[float], apart: float = 0.001) -> list[float]:
    """Rising thresholds without those closer than `apart` to the one before."""
    rising = sorted(set(thresholds))
    return [x for k, x in enumerate(rising) if k == 0 or x - rising[k - 1] > apart]


def fixed_thresholds(edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, kept): given thresholds, tightest first, each once, with the edges at or above each."""
    tight = sorted(set(thresholds), reverse=True)
    counts = edges.agg(*(F.count_if(c("weight") >= t).alias(f"t{k}") for k, t in enumerate(tight)))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{k}").alias("kept")) for k, t in enumerate(tight)))
    return counts.select(F.inline(rows))


@dataclass(frozen=True)
class TreeConfig:
    min_size: int
    delta: float
    cohesion: float
    tight: float
    max_depth: int
    iqr: float
    density: float


def auto_config(n: int, n_edges: int, iqr: float) -> TreeConfig:
    size = min(max(math.ceil(math.sqrt(n) / 15), 3), 7)
    density = 2 * n_edges / (n * (n - 1)) if n > 1 else 0.0
    return TreeConfig(size, max(iqr / 20, 0.02), 1.0, 0.001, 7, iqr, density)


def config_of(nodes: DataFrame, edges: DataFrame) -> TreeConfig:
    stats = weight_statistics(edges).first()
    return auto_config(nodes.count(), stats.n, stats.iqr or 0.0)


def min_ratio(n: int) -> float:
    return next(r for least, r in RATIOS if n > least or least == 0)


def ratio_of(n: Column) -> Column:
    """min_ratio as a column."""
    out = F.lit(RATIOS[-1][1])
    for least, ratio in reversed(RATIOS[:-1]):
        out = F.when(n > least, ratio).otherwise(out)
    return out


def dynamic_ratio(n: int, iqr: float) -> float:
    return min_ratio(n) * min(max(iqr / 0.16, 0.25), 2.0)


def dynamic_cohesion(base: float, density: float) -> float:
    return min(max(base * min(max(0.0043 / density, 0.1), 1.0) if density > 0 else base, 0.3), 1.0)


def min_size_at(cfg: TreeConfig, depth: int) -> int:
    return cfg.min_size * SIZE_FACTORS[min(depth, len(SIZE_FACTORS) - 1)]


def cohesion(group: list[str], others: list[str], edges: list[tuple[str, str, float]]) -> float:
    """Mean weight inside over mean weight across; infinite without edges across."""
    g, o = set(group), set(others)
    inside = [w for a, b, w in edges if a in g and b in g]
    across = [w for a, b, w in edges if (a in g and b in o) or (b in g and a in o)]
    return (sum(inside) / len(inside) if inside else 0.0) / (sum(across) / len(across)) if across else math.inf


def _mean_by(key: np.ndarray, w: np.ndarray) -> dict[int, float]:
    """The mean weight of each key, from exact sums."""
    order = np.argsort(key, kind="stable")
    found, starts, sizes = np.unique(key[order], return_index=True, return_counts=True)
    sorted_w = w[order].tolist()
    return {k: math.fsum(sorted_w[at : at + n]) / n for k, at, n in zip(found.tolist(), starts.tolist(), sizes.tolist(), strict=True)}


def _cohesive(children: list[np.ndarray], n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: float) -> bool:
    """Whether cohesion() of each child towards each later one is at least this, in one pass over the edges: pairs of
    children that no edge joins are cohesive."""
    of = np.full(n, -1)
    for k, g in enumerate(children):
        of[g] = k
    one, two = of[a], of[b]
    both = (one >= 0) & (two >= 0)
    one, two, w = one[both], two[both], w[both]
    own = one == two
    inside = _mean_by(one[own], w[own])
    across = _mean_by(np.minimum(one, two)[~own] * len(children) + np.maximum(one, two)[~own], w[~own])
    return all(mean == 0 or inside.get(pair // len(children), 0.0) / mean >= least for pair, mean in across.items())


def valid_splits(ids: list[str], edges: list[tuple[str, str, float]], cfg: TreeConfig, parent: float | None) -> list[tuple[float, list[list[str]]]]:
    """The thresholds and children of the valid splits of a group, tightest first: children large and even
    enough and each more cohesive inside than towards the others. Edges are united once, from the heaviest on."""
    if not edges:
        return []
    names = sorted(set(ids))
    place = {x: k for k, x in enumerate(names)}
    a, b = (np.fromiter((place[e[k]] for e in edges), np.int64, len(edges)) for k in (0, 1))
    w = np.fromiter((e[2] for e in edges), float, len(edges))
    weights = np.sort(w).tolist()
    cuts = sorted({weights[min(len(weights) - 1, len(weights) * p // 100)] for p in range(20, 81, 10)}, reverse=True)
    order = np.argsort(-w, kind="stable")
    heavy, done = np.stack([a, b], axis=1)[order].tolist(), 0
    up = list(range(len(names)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    found = []
    for t in cuts:
        reach = int(np.count_nonzero(w >= t))
        for x, y in heavy[done:reach]:
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        done = reach
        if parent is not None and abs(t - parent) < cfg.delta:
            continue
        root = np.fromiter(map(find, range(len(names))), np.int64, len(names))
        by = np.argsort(root, kind="stable")
        # roots are the first of their nodes, so that of equal sizes the one with the smallest node comes first
        groups = np.split(by, np.flatnonzero(np.diff(root[by])) + 1)
        children = sorted((g for g in groups if len(g) >= cfg.min_size), key=len, reverse=True)
        if len(children) < 2:
            continue
        even = len(children[1]) / len(children[0]) >= dynamic_ratio(len(ids), cfg.iqr)
        covered = sum(map(len, children)) / len(ids) >= 0.5 and len(children) >= 3
        if (even or covered) and _cohesive(children, len(names), a, b, w, dynamic_cohesion(cfg.cohesion, cfg.density)):
            found.append((t, [[names[k] for k in g.tolist()] for g in children]))
    return found


def best_split(ids: list[str], edges: list[tuple[str, str, float]], cfg: TreeConfig, parent: float | None) -> tuple[float, list[list[str]]] | None:
    """The valid split with the highest size-weighted balance, of equals the tightest."""
    quality = lambda found: len(found[1]) * min(map(len, found[1])) / (sum(map(len, found[1])) / len(found[1]))
    return max(valid_splits(ids, edges, cfg, parent), key=quality, default=None)


def splits_of_groups(members: DataFrame, edges: DataFrame, cfg: TreeConfig) -> DataFrame:
    """(component, threshold, children, smallest, largest): the valid splits of each group, from its inner edges in one task."""

    def splits(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["a", "b", "weight"]].sort_values(["a", "b"]).itertuples(index=False, name=None))
        found = valid_splits(sorted(set(pdf["a"]) | set(pdf["b"])), rows, cfg, None)
        return pd.DataFrame([(pdf["component"].iloc[0], t, len(g), len(g[-1]), len(g[0])) for t, g in found], columns=["component", "threshold", "children", "smallest", "largest"])

    ends = [members.select(c("id").alias(x), c("component").alias(f"c{x}")) for x in "ab"]
    inside = edges.where("a != b and weight is not null").join(ends[0], "a").join(ends[1], "b").where("ca = cb").select(c("ca").alias("component"), "a", "b", c("weight").cast("double").alias("weight"))
    return inside.groupBy("component").applyInPandas(splits, "component string, threshold double, children long, smallest long, largest long")


def split_group(ids: list[str], edges: list[tuple[str, str, float]], cfg: TreeConfig, depth: int, parent: float | None) -> tuple[float | None, list[list[str]]]:
    """Children of one group; none if it is a leaf. Nodes in no child join the one with the best mean weight."""
    weights = [w for _, _, w in edges]
    if depth >= cfg.max_depth or len(ids) < min_size_at(cfg, depth) or not weights:
        return None, []
    mean = sum(weights) / len(weights)
    variance = sum((w - mean) ** 2 for w in weights) / max(1, len(weights) - 1)
    if len(ids) >= 10 and len(weights) >= 3 and mean > 0 and math.sqrt(variance) / mean < 0.1:
        return None, []
    if variance < cfg.tight or max(weights) - min(weights) < cfg.delta:
        return None, []
    found = best_split(ids, edges, cfg, parent)
    threshold, children = found if found else (None, [])
    if not children or len(children[0]) >= max(0.5, 0.9 - 0.05 * depth) * len(ids):
        parts = community_split(pd.DataFrame(edges, columns=["a", "b", "weight"]), cfg.min_size)
        if len(parts) >= 2 and (depth > 3 or len(parts) > 2 or min(map(len, parts)) >= 0.2 * len(ids)):
            threshold, children = None, parts
    if len(children) < 2:
        return None, []
    home = {x: k for k, g in enumerate(children) for x in g}
    pulls: dict[str, dict[int, list[float]]] = {}
    for a, b, w in edges:
        for x, other in ((a, b), (b, a)):
            if x not in home and other in home:
                pulls.setdefault(x, {}).setdefault(home[other], []).append(w)
    for x, pull in sorted(pulls.items()):
        children[min(pull, key=lambda k: (-sum(pull[k]) / len(pull[k]), k))].append(x)
    return threshold, [sorted(g) for g in children]


def _splitter(cfg: TreeConfig, depth: int):
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf[["a", "b", "weight"]].sort_values(["a", "b"]).itertuples(index=False, name=None))
        ids = sorted(set(pdf["a"]) | set(pdf["b"]))
        t = pdf["threshold"].iloc[0]
        at, children = split_group(ids, rows, cfg, depth, None if pd.isna(t) else float(t))
        g = pdf["ga"].iloc[0]
        return pd.DataFrame([(x, f"{g}.{k}", g, at) for k, child in enumerate(children) for x in child], columns=["id", "category", "parent", "threshold"])

    return split


def adaptive_tree(nodes: DataFrame, edges: DataFrame, cfg: TreeConfig) -> DataFrame:
    """(category, parent, depth, id): for each level the category that holds each node. A round splits all
    groups of a level, each in one call with its inner edges; edges between groups are dropped, so
    the work shrinks from round to round."""
    member = cut(nodes.select("id", F.lit("0").alias("category"), F.lit(None).cast("double").alias("threshold")))
    levels = [member.select("category", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "id")]
    e = cut(edges.select("a", "b", c("weight").cast("double").alias("weight")).where("a != b and weight is not null"))
    for depth in range(cfg.max_depth):
        inside = e.join(member.select(c("id").alias("a"), c("category").alias("ga"), "threshold"), "a").join(member.select(c("id").alias("b"), c("category").alias("gb")), "b").where("ga = gb")

        found = cut(inside.groupBy("ga").applyInPandas(_splitter(cfg, depth), "id string, category string, parent string, threshold double"))
        if found.isEmpty():
            break
        levels.append(found.select("category", "parent", F.lit(depth + 1).alias("depth"), "id"))
        member = found.select("id", "category", "threshold")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def parents_from_tree(tree: DataFrame) -> DataFrame:
    """(id, parent_id): each node's deepest category, of several the first."""
    return tree.groupBy("id").agg(F.min_by("category", F.struct(-c("depth"), c("category"))).alias("parent_id"))


def rescue_orphans(orphans: DataFrame, member: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, category): each orphan joins the category with the best mean weight to it."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(c("b").alias("a"), c("a").alias("b"), "weight"))
    pull = both.join(orphans.select(c("id").alias("a")), "a", "left_semi").join(member.select(c("id").alias("b"), "category"), "b").groupBy("a", "category").agg(F.avg("weight").alias("w"))
    return pull.groupBy(c("a").alias("id")).agg(F.max_by("category", F.struct("w", "category")).alias("category"))


def classic_hierarchy(nodes: DataFrame, private_below: float = 0.3) -> DataFrame:
    """(topic, parent, n): topics of the visible items by cluster, private ones apart."""
    topic = F.when(c("privacy") < private_below, "personal").when(c("cluster_id").isNull() | (c("cluster_id") < 0), "uncategorized").otherwise(F.concat(F.lit("topic-"), c("cluster_id").cast("string")))
    return nodes.where("is_item").groupBy(topic.alias("topic")).agg(F.count("*").alias("n")).select("topic", F.lit("root").alias("parent"), "n")


# ---- tidying


def flatten_single_chains(nodes: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, parent_id) after categories with one child that is a category gave way to it, to a fixpoint.
    Chains collapse by pointer jumping: a node's parent becomes the next ancestor that stays."""
    kids = nodes.where("parent_id is not null").groupBy(c("parent_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(~c("is_item")).alias("cats"))
    gone = nodes.where("not is_item and not is_universe and parent_id is not null").join(kids.where("n = 1 and cats = 1").select("id"), "id", "left_semi")
    jump = cut(gone.select("id", c("parent_id").alias("to")))
    for _ in range(max_rounds):
        nxt = cut(jump.join(jump.select(c("id").alias("to"), c("to").alias("further")), "to", "left").select("id", F.coalesce("further", "to").alias("to"), c("further").isNotNull().alias("moved")))
        jump = nxt.select("id", "to")
        if nxt.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("the parents form a cycle")
    left = nodes.select("id", "parent_id").join(jump.select("id"), "id", "left_anti")
    return left.join(jump.select(c("id").alias("parent_id"), "to"), "parent_id", "left").select("id", F.coalesce("to", "parent_id").alias("parent_id"))


def dissolve(nodes: DataFrame, category: str) -> DataFrame:
    """(id, parent_id) after a category gave its children to its own parent."""
    up = nodes.where(c("id") == category).select(c("id").alias("__c"), c("parent_id").alias("__g"))
    out = nodes.where(c("id") != category).join(F.broadcast(up), c("parent_id") == c("__c"), "left")
    return out.select("id", F.when(c("__c").isNotNull(), c("__g")).otherwise(c("parent_id")).alias("parent_id"))


def merge_map(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, parent_id) after merging categories: of a component of pairs (a, b) the one with most children stays, then the smallest id."""
    kids = nodes.where("parent_id is not null").groupBy(c("parent_id").alias("id")).agg(F.count("*").alias("n"))
    ends = pairs.select(c("a").alias("id")).union(pairs.select("b")).distinct()
    comp = components(ends, pairs.select(c("a").alias("source_id"), c("b").alias("target_id"))).join(kids, "id", "left")
    keep = comp.groupBy("component").agg(F.min_by("id", F.struct(-F.coalesce("n", F.lit(0)), c("id"))).alias("into"))
    into = comp.join(keep, "component").where("id != into").select(c("id").alias("__c"), "into")
    out = nodes.join(into, c("id") == c("__c"), "left_anti").join(into, c("parent_id") == c("__c"), "left")
    return out.select("id", F.coalesce("into", "parent_id").alias("parent_id"))
