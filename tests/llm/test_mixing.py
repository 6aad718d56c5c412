"""Pareto order sampling against a ranking in plain Python, and its design over many draws."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from trellis.llm import mixing


def _expected(sizes: list[int], target: float, cap: float, power: float) -> list[float]:
    """Copies of each size by bisection of the level."""
    w = [2.0 ** (power * math.floor(8 * math.log2(max(s, 1)) + 1e-9) / 8) for s in sizes]
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(s * min(cap, mid * x) for s, x in zip(sizes, w, strict=True)) < target else (low, mid)
    return [min(cap, low * x) for x in w]


def _sample(sizes: list[int], us: list[float], target: float, cap: float = 2.0, power: float = 0.5) -> list[int]:
    e = _expected(sizes, target, cap, power)
    certain = [math.floor(x + 1e-6) for x in e]
    p = [x - c if x - c > 1e-6 else 0.0 for x, c in zip(e, certain, strict=True)]
    lack = target - sum(c * s for c, s in zip(certain, sizes, strict=True))
    ranked = sorted((u / (1 - u) / (p[k] / (1 - p[k])), k) for k, u in enumerate(us) if p[k] > 0)
    taken, open_ranks, crossed = [], [], False
    for q, k in ranked:
        if sizes[k] <= lack:
            taken.append(k)
            lack -= sizes[k]
        else:
            crossed = True
            open_ranks.append((q, k))
    if crossed:
        near = [(abs(sizes[k] - lack), q, k) for q, k in open_ranks if sizes[k] > 0 and abs(sizes[k] - lack) < lack]
        if near:
            taken.append(min(near)[2])
    return [c + (k in taken) for k, c in enumerate(certain)]


def _documents(spark, n: int, sources: int):
    size = (F.hash("id") % 90 + 95).cast("int")
    return spark.range(n * sources).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), size).alias("text"), F.concat(F.lit("s"), F.lpad((F.col("id") % sources).cast("string"), 4, "0")).alias("source"))


def test_the_sample_is_the_lowest_ranks(spark):
    got = mixing.mix(_documents(spark, 60, 7)).toPandas()
    for _, mine in got.groupby("source"):
        mine = mine.sort_values("id")
        expect = _sample(mine["size"].tolist(), mine["u"].tolist(), mine["target"].iloc[0])
        assert mine["copies"].tolist() == expect
        # nothing that is left out would have fitted
        lack = mine["target"].iloc[0] - mine["taken"].sum()
        assert lack < mine["size"].min()


def test_inclusion_follows_the_design(spark):
    """Each of many sources holds the same sizes, so each is one draw of the same design."""
    draws, n = 200, 300
    size = (F.floor(F.col("id") / draws) / 2).cast("int") + 20
    docs = spark.range(draws * n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), size).alias("text"), F.concat(F.lit("s"), (F.col("id") % draws).cast("string")).alias("source"))
    got = mixing.mix(docs, weights=(1.0,), share=0.6).groupBy("size").agg(F.avg("copies").alias("copies"), F.count("*").alias("n"), F.first("target").alias("target")).orderBy("size").toPandas()
    assert len(got) == n // 2 and (got.n == 2 * draws).all()
    sizes = got["size"].to_numpy()
    e = np.array(_expected(sizes.tolist(), got.target.iloc[0] / 2, 2.0, 0.5))
    assert e.max() > 2 * e.min()  # the design is unequal
    off = got.copies.to_numpy() - e
    # four standard errors; the documents that close the gap are a few of the small ones
    assert np.abs(off[sizes >= 60]).max() < 4 * 0.5 / math.sqrt(2 * draws) + 0.02
    assert np.abs(off[sizes >= 60].mean()) < 0.01 and (off * 2).sum() < 8


def test_bins_of_a_large_source_give_the_same_ranks(spark):
    docs = _documents(spark, 6000, 2)
    got = mixing.mix(docs).toPandas()
    for _, mine in got.groupby("source"):
        mine = mine.sort_values("id")
        expect = _sample(mine["size"].tolist(), mine["u"].tolist(), mine["target"].iloc[0])
        # up to the closing documents, which are looked for in two bins only
        assert sum(a != b for a, b in zip(mine["copies"], expect, strict=True)) <= 8
        assert abs(mine["target"].iloc[0] - mine["taken"].sum()) < mine["size"].min()


def test_odd_columns_and_rows(spark):
    body = "doc_id long, text string, source string, `a.b` int, doc string, row int, u string, m map<string,int>"
    rows = [(k % 50, "w " * (k % 9), None if k % 4 == 0 else "x", k, "d", 1, "u", {"k": k}) for k in range(120)] + [(7, "same", "x", 0, "d", 1, "u", {"k": 1})] * 200
    docs = spark.createDataFrame(rows, body)
    out = mixing.sample(docs)
    assert out.columns == docs.columns
    got = mixing.mix(docs)
    assert out.count() == got.agg(F.sum("copies")).first()[0]
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).toPandas()
    assert ((by.taken - by.target).abs() <= 1.5).all()


def test_many_sources(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.col("id").cast("string").alias("source"))
    got = mixing.mix(docs).agg(F.sum("taken"), F.sum("size"), F.max("copies"), F.count("*")).first()
    assert got[3] == 4000 and got[2] == 2 and abs(got[0] / got[1] - 1.5) < 0.34
