"""Subdivision and bridges against plain recursions."""

import random

import pytest

from trellis.operators import hierarchy as H
from trellis.operators import subdivision as S


def parts(ids, edges, t):
    left, out = set(ids), []
    while left:
        group, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x in left:
                left.discard(x)
                group.add(x)
                todo += [b if a == x else a for a, b, w in edges if w >= t and x in (a, b)]
        out.append(group)
    return out


def inner(ids, edges):
    return [(a, b, w) for a, b, w in edges if a in ids and b in ids and a != b]


def median_cut(ids, edges, most):
    e = inner(ids, edges)
    if len(ids) <= most or not e:
        return [ids]
    w = sorted((x for _, _, x in e), reverse=True)
    t, upper = w[len(w) // 2], w[len(w) // 4]
    found = parts(ids, e, t)
    if len(found) == 1 and abs(upper - t) > 0.01:
        found = parts(ids, e, upper)
    return [ids] if len(found) == 1 else [y for x in found for y in median_cut(x, edges, most)]


def gap_cut(ids, forest, most, least, levels, top=True):
    e = inner(ids, forest)
    if len(ids) <= most or (not top and len(ids) < least) or not e:
        return [ids]
    w = sorted((x for _, _, x in e), reverse=True)
    if len(w) < levels:
        t = w[0]
    else:
        gaps = sorted(range(1, len(w)), key=lambda i: (-(w[i - 1] - w[i]), i))[: levels - 1]
        if not gaps:
            return [ids]
        t = (w[min(gaps) - 1] + w[min(gaps)]) / 2
    found = parts(ids, e, t)
    return [ids] if len(found) == 1 else [y for x in found for y in gap_cut(x, forest, most, least, levels, False)]


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(7)
    ids = [f"n{k:02d}" for k in range(60)]
    edges = {}
    for _ in range(190):
        a, b = sorted(rng.sample(range(60), 2))
        if a % 3 == b % 3 or rng.random() < 0.2:
            edges[a, b] = rng.choice((0.3, 0.35, 0.4, 0.5, 0.625, 0.75, 0.875))
    rows = [(ids[a], ids[b], w) for (a, b), w in edges.items()]
    home = {x: f"g{int(x[1:]) % 2}" for x in ids}
    members = spark.createDataFrame(list(home.items()), "id string, component string")
    return home, rows, members, spark.createDataFrame(rows, "a string, b string, weight double")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.component, set()).add(r.id)
    assert all(min(g) == name for name, g in out.items())
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("most", [6, 29])
def test_median_cuts(graph, most):
    home, rows, members, edges = graph
    expect = [p for g in ("g0", "g1") for p in median_cut({x for x in home if home[x] == g}, rows, most)]
    assert groups(S.subdivide(members, edges, most)) == sorted(map(sorted, expect))


@pytest.mark.parametrize("least, levels", [(3, 4), (1, 3), (4, 40)])
def test_gap_cuts(graph, spark, least, levels):
    home, rows, members, edges = graph
    own = [r for r in rows if home[r[0]] == home[r[1]]]
    forest = H.merges(spark.createDataFrame(own, "a string, b string, weight double"))
    f = [(r.a, r.b, r.weight) for r in forest.collect()]
    expect = [p for g in ("g0", "g1") for p in gap_cut({x for x in home if home[x] == g}, f, 6, least, levels)]
    assert groups(S.subdivide_by_gaps(members, forest, 6, least, levels)) == sorted(map(sorted, expect))


def test_nothing_to_cut(graph, spark):
    _, _, members, edges = graph
    assert len(groups(S.subdivide(members, edges.limit(0), 6))) == 2
    assert S.subdivide(members.limit(0), edges, 6).isEmpty()


def test_bridges_between_siblings(spark):
    children = spark.createDataFrame([("a1", "p", "A"), ("a2", "p", "A"), ("b1", "p", "B"), ("c1", "p", "C"), ("z", "q", "Z")], "id string, parent string, child string")
    edges = spark.createDataFrame([("a1", "a2", 0.9), ("a2", "b1", 0.5), ("b1", "c1", 0.52), ("z", "c1", 0.2), ("a1", None, None)], "a string, b string, weight double")
    found = S.bridges(children.selectExpr("id", "parent", "0.5D AS threshold"), edges, 0.05)
    assert {tuple(r) for r in found.collect()} == {("p", "b1"), ("p", "c1")}
    assert {tuple(r) for r in S.bridge_children(found, children, edges).collect()} == {("p", "A", "b1"), ("p", "C", "b1"), ("p", "B", "c1")}
    assert {(r.a, r.b, r.weight, tuple(r.bridges)) for r in S.sibling_edges(children, found, edges).collect()} == {("A", "B", 0.5, ()), ("B", "C", 0.52, ()), ("A", "C", 0.0, ("b1",))}
