"""Hand-made graphs: topology, staleness, regions, context expansion, trees."""

from __future__ import annotations

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trellis.operators import graph as G
from trellis.operators import hierarchy as H
from trellis.operators import relational as R
from trellis.operators import trees as T

DAY = 86_400_000
NOW = 1_700_000_000_000
EDGE = "id string, source_id string, target_id string, kind string, weight double, confidence double, agent_id string, superseded_by string, created_at long"


def edges(spark, *pairs, kind="related", confidence=0.9):
    rows = [(f"e{k}", p[0], p[1], p[2] if len(p) > 2 else kind, 1.0, p[3] if len(p) > 3 else confidence, None, p[4] if len(p) > 4 else None, NOW) for k, p in enumerate(pairs)]
    return spark.createDataFrame(rows, EDGE)


def nodes(spark, ids, **columns):
    rows = [(x, True) for x in ids]
    df = spark.createDataFrame(rows, "id string, is_item boolean")
    for name, value in columns.items():
        df = df.withColumn(name, F.lit(value))
    return df


def names(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_topology_of_small_graphs(spark):
    chain = G.topology(nodes(spark, "ABCDE"), edges(spark, *zip("ABCD", "BCDE", strict=True))).first()
    assert (chain.components, chain.largest, chain.orphans, chain.edges) == (1, 5, 0, 4)
    two = G.topology(nodes(spark, "ABCDE"), edges(spark, "AB", "BC", "DE")).first()
    assert (two.components, two.largest, two.smallest) == (2, 3, 2)
    empty = G.topology(nodes(spark, ""), edges(spark, "AB").limit(0)).first()
    assert (empty.nodes, empty.components) == (0, 0)
    assert names(G.degrees(nodes(spark, "ABC"), edges(spark, "AB")).where("degree = 0")) == ["C"]


def test_star_hub_parallel_and_loop(spark):
    star = [("center", f"s{k}") for k in range(1, 6)]
    hubs = G.degrees(nodes(spark, ["center", *(f"s{k}" for k in range(1, 6))]), edges(spark, *star)).where("degree > 4").collect()
    assert [(h.id, h.degree) for h in hubs] == [("center", 5)]
    d = {r.id: (r.degree, r.incoming, r.outgoing) for r in G.degrees(nodes(spark, "AB"), edges(spark, "AB", "AB", "AA", "AX")).collect()}
    assert d == {"A": (4, 1, 3), "B": (2, 2, 0)}


def test_bridges_and_articulation_points(spark):
    points, bridges = G.cut_points(nodes(spark, "ABC"), edges(spark, "AB", "BC"))
    assert names(points) == ["B"] and bridges.count() == 2
    points, bridges = G.cut_points(nodes(spark, "ABC"), edges(spark, "AB", "BC", "CA"))
    assert points.count() == 0 and bridges.count() == 0
    points, bridges = G.cut_points(nodes(spark, "ABCDEF"), edges(spark, "AB", "BC", "CA", "DE", "EF", "FD", "CD"))
    assert names(points) == ["C", "D"] and [tuple(r) for r in bridges.collect()] == [("C", "D")]


def test_bridges_against_removal(spark):
    import random

    rng = random.Random(4)
    pairs = sorted({tuple(sorted(rng.sample("ABCDEFGHIJ", 2))) for _ in range(13)})

    def parts(ids, es):
        up = {x: x for x in ids}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in es:
            up[find(a)] = find(b)
        return len({find(x) for x in ids})

    ids = "ABCDEFGHIJ"
    whole = parts(ids, pairs)
    expect = sorted(p for p in pairs if parts(ids, [q for q in pairs if q != p]) > whole)
    cuts = sorted(x for x in ids if any(x in p for p in pairs) and parts([y for y in ids if y != x], [p for p in pairs if x not in p]) > whole)
    points, bridges = G.cut_points(nodes(spark, ids), edges(spark, *pairs))
    assert sorted(tuple(r) for r in bridges.collect()) == expect and names(points) == cuts


def test_staleness(spark):
    n = spark.createDataFrame([("A", NOW - 90 * DAY), ("B", NOW)], "id string, updated_at long")
    recent = edges(spark, "BA", "BA", "AA").withColumn("created_at", F.lit(NOW - DAY))
    hit = G.stale_nodes(n, recent, NOW, 30).collect()
    assert [(r.id, r.recent) for r in hit] == [("A", 2)] and hit[0].age_days >= 89
    assert G.stale_nodes(n, edges(spark, "BA").withColumn("created_at", F.lit(NOW - 60 * DAY)), NOW, 30).count() == 0
    s = spark.createDataFrame([("S", NOW - 10 * DAY), ("T", NOW - 2 * DAY)], "id string, updated_at long")
    assert G.stale_summaries(s, edges(spark, ("S", "T", "summarizes"))).first().drift_days >= 7


def test_regions_and_fragile_pairs(spark):
    n = spark.createDataFrame([("root", None, 0), ("cat1", "root", 1), ("cat2", "root", 1), ("item1", "cat1", 2), ("item2", "cat2", 2), ("lost", "gone", 2)], "id string, parent_id string, depth int")
    assert {r.id: r.region for r in T.regions(n).collect()} == {"root": "root", "cat1": "cat1", "cat2": "cat2", "item1": "cat1", "item2": "cat2", "lost": "unassigned"}
    pair = G.fragile_regions(n, edges(spark, ("item1", "item2"))).collect()
    assert [tuple(r) for r in pair] == [("cat1", "cat2", 1)]


def test_health():
    assert G.health(3, 0, 1, 0, 0) == pytest.approx(1.0, abs=0.01)
    assert 0 <= G.health(3, 3, 3, 0, 0) <= 1 and 0 <= G.health(2, 0, 1, 2, 2) <= 1


def context(spark, es, ids, start="A", **options):
    return G.expand_context(nodes(spark, ids), es, [start], **options).orderBy("rank").collect()


def test_context_cutoffs(spark):
    weak = context(spark, edges(spark, "AB", "BC", confidence=0.1), "ABC", max_cost=1.0)
    assert [(r.id, r.distance) for r in weak] == [("B", pytest.approx(0.765))]
    assert len(context(spark, edges(spark, "AB", "BC", "CD", "DE"), "ABCDE", max_hops=2)) == 2
    star = edges(spark, *((("A", f"n{k}")) for k in range(10)))
    assert len(context(spark, star, ["A", *(f"n{k}" for k in range(10))], budget=3)) == 3
    assert context(spark, edges(spark, "BC"), "ABC") == []


def test_context_order_direction_and_floor(spark):
    assert [r.id for r in context(spark, edges(spark, "AZ", "AY", "AX"), "AXYZ")] == ["X", "Y", "Z"]
    assert [r.id for r in context(spark, edges(spark, "AB"), "AB", start="B")] == ["A"]
    costs = {r.id: r.distance for r in context(spark, edges(spark, ("A", "B", "defined_in"), ("A", "C", "supports")), "ABC")}
    assert costs == {"B": pytest.approx(0.4), "C": pytest.approx(0.075)}
    short = context(spark, edges(spark, ("A", "B", "related", 0.1), ("A", "M", "supports", 0.95), ("M", "B", "supports", 0.95)), "ABM")
    assert {r.id: (r.hops, r.path) for r in short}["B"] == (2, "/supports:M/supports:B")


def test_context_filters(spark):
    assert context(spark, edges(spark, ("A", "B", "related", 0.9, "new")), "AB", not_superseded=True) == []
    both = edges(spark, ("A", "B", "supports"), ("A", "C", "related"))
    assert [r.id for r in context(spark, both, "ABC", allow=["supports"])] == ["B"]
    assert [r.id for r in context(spark, both, "ABC", deny=["supports"])] == ["C"]
    n = spark.createDataFrame([("A", True), ("CAT", False), ("C", True)], "id string, is_item boolean")
    found = G.expand_context(n, edges(spark, ("A", "CAT", "belongs_to"), ("CAT", "C")), ["A"], items_only=True).collect()
    assert [r.id for r in found] == ["C"]
    block = edges(spark, ("S", "M", "clicked"), ("M", "D", "related"), ("S", "D2", "clicked"), ("S", "D2", "related"))
    assert [r.id for r in G.expand_context(nodes(spark, ["S", "M", "D", "D2"]), block, ["S"], deny=["clicked"]).collect()] == ["D2"]


def test_edge_priorities(spark):
    got = {r.kind: r.p for r in edges(spark, *(("A", "B", k) for k in ("contradicts", "summarizes", "supports", "related"))).select("kind", G.priority().alias("p")).collect()}
    assert got == {"contradicts": 1.0, "summarizes": 0.7, "supports": 0.5, "related": 0.3}


def test_dead_edges(spark):
    e, n = edges(spark, "AB", "AX", "XB", "XY"), nodes(spark, "AB")
    assert R.dead_edges(e, n).count() == 3 == e.count() - R.live_edges(e, n).count()


def weighted(spark, *rows):
    return spark.createDataFrame(list(rows), "a string, b string, weight double")


def test_merges_and_cuts(spark):
    e = weighted(spark, ("p1", "p2", 0.9), ("p2", "p3", 0.7), ("p1", "p3", 0.6))
    forest = H.merges(e)
    assert sorted(r.weight for r in forest.collect()) == [0.7, 0.9]
    n = nodes(spark, ["p1", "p2", "p3"])
    assert [H.cut_at(n, forest, t).select("component").distinct().count() for t in (0.8, 0.4)] == [2, 1]


def test_merges_against_kruskal(spark):
    import random

    rng = random.Random(2)
    e = [(f"n{a}", f"n{b}", round(rng.random(), 3)) for a in range(25) for b in range(a) if rng.random() < 0.2]
    up, total = {}, []

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b, w in sorted(e, key=lambda x: -x[2]):
        if find(a) != find(b):
            up[find(a)] = find(b)
            total.append(w)
    assert sorted(r.weight for r in H.merges(weighted(spark, *e)).collect()) == sorted(total)


def test_ratios_and_configuration():
    assert [H.min_ratio(n) for n in (600, 300, 100, 20)] == [0.01, 0.03, 0.08, 0.15]
    base = H.min_ratio(100)
    assert H.dynamic_ratio(100, 0.16) == pytest.approx(base) and H.dynamic_ratio(100, 0.08) == pytest.approx(base / 2) and H.dynamic_ratio(100, 0.32) > base
    assert H.dynamic_cohesion(1.0, 0.043) < 1 and H.dynamic_cohesion(1.0, 0.00043) == 1.0
    cfg = H.auto_config(1000, 5000, 0.1)
    assert cfg.min_size == 3 and cfg.delta == 0.02 and H.min_size_at(cfg, 3) == 24


def test_cohesion_inside_and_across():
    e = [("a1", "a2", 0.9), ("a2", "a3", 0.8), ("b1", "b2", 0.85), ("a1", "b1", 0.35), ("a3", "b2", 0.4)]
    assert H.cohesion(["a1", "a2", "a3"], ["b1", "b2"], e) == pytest.approx(0.85 / 0.375)


def test_small_group_is_a_leaf_and_clusters_split(spark):
    cfg = H.TreeConfig(5, 0.02, 1.0, 0.001, 7, 0.3, 0.1)
    assert H.split_group(["x", "y"], [("x", "y", 0.9)], cfg, 0, None) == (None, [])
    e = [(f"{g}{a}", f"{g}{b}", 0.6 + 0.03 * ((a + b) % 10)) for g in "pq" for a in range(10) for b in range(a)] + [("p1", "q1", 0.1), ("p2", "q2", 0.12), ("p3", "q3", 0.14)]
    tree = H.adaptive_tree(nodes(spark, [f"{g}{k}" for g in "pq" for k in range(10)]), weighted(spark, *e), H.TreeConfig(3, 0.02, 1.0, 0.001, 7, 0.3, 0.2))
    first = {}
    for r in tree.where("depth = 1").collect():
        first.setdefault(r.category, set()).add(r.id[0])
    assert sorted(map(sorted, first.values())) == [["p"], ["q"]]
    home = H.parents_from_tree(tree)
    assert home.count() == 20


def test_splits_of_many_edges_take_one_pass(spark):
    # 500 triangles of heavy edges, light ones between: comparing each two of them by a scan of all edges takes hours
    names = [f"n{k:05d}" for k in range(1500)]
    e = [(names[3 * g + i], names[3 * g + j], 0.9) for g in range(500) for i, j in ((0, 1), (0, 2), (1, 2))]
    e += [(names[k], names[(k + 7) % 1500], 0.4 + k % 5 / 100) for k in range(1500)]
    cfg = H.TreeConfig(3, 0.02, 1.0, 0.001, 7, 0.3, 0.001)
    began = time.monotonic()
    (t, children), *_ = H.valid_splits(names, e, cfg, None)
    assert t == 0.9 and children == [names[k : k + 3] for k in range(0, 1500, 3)]
    assert all(H.cohesion(children[0], g, e) >= 1 for g in children[1:50])
    _, split = H.split_group([*names, "z1", "z2"], [*e, ("n00000", "z1", 0.2), ("n00003", "z2", 0.2), ("n00004", "z2", 0.3)], cfg, 0, None)
    assert split[0][-1] == "z1" and split[1][-1] == "z2" and len(split) == 500
    assert time.monotonic() - began < 10
    config, rows = H.TreeConfig(3, 0.02, 1.0, 0.001, 7, 0.3, 0.2), weighted(spark, *e)
    member = nodes(spark, names).select("id", F.lit("g").alias("component"))
    assert [(r.threshold, r.children, r.smallest, r.largest) for r in H.splits_of_groups(member, rows, config).where("threshold > 0.5").collect()] == [(0.9, 500, 3, 3)]


def test_tree_queries_search_similarity_edges_once(spark, monkeypatch):
    from trellis.operators import vectors as V
    from trellis.plans import QUERIES

    calls, edges = [], V.semantic_edges
    monkeypatch.setattr(V, "semantic_edges", lambda *a: calls.append(1) or edges(*a))
    for name in ("tre_12_valid_splits", "tre_14_adaptive_tree", "tre_15_rebuild"):
        calls.clear()
        assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0 and len(calls) == 1


def test_communities():
    pdf = pd.DataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("a", "c", 0.9), ("d", "e", 0.9), ("e", "f", 0.9), ("d", "f", 0.9), ("c", "d", 0.1)], columns=["a", "b", "weight"])
    assert G.community_split(pdf) == [["a", "b", "c"], ["d", "e", "f"]]


def test_tidying(spark):
    n = spark.createDataFrame([("root", None, False, True), ("a", "root", False, False), ("b", "a", False, False), ("c", "b", False, False), ("i", "c", True, False), ("j", "c", True, False)], "id string, parent_id string, is_item boolean, is_universe boolean")
    assert {r.id: r.parent_id for r in H.flatten_single_chains(n).collect()} == {"root": None, "c": "root", "i": "c", "j": "c"}
    assert {r.id: r.parent_id for r in H.dissolve(n, "b").collect()}["c"] == "a"


def test_paths_and_supersession(spark):
    e = edges(spark, "AB", "BC", "AC", "CD")
    assert [r.path for r in G.simple_paths(e, "A", "D", 3).collect()] == ["A>C>D", "A>B>C>D"]
    chain = spark.createDataFrame([("e1", "e2"), ("e2", "e3"), ("e3", None), ("e9", "e2")], "id string, superseded_by string")
    assert {(r.id, r.step) for r in T.supersession(chain, "e2").collect()} == {("e1", -1), ("e2", 0), ("e3", 1)}
