"""Vectors: similarity, centroids, nearest neighbours, similarity edges and clusters.

Vectors are arrays (id, embedding). Products of many pairs go through Arrow in blocks: rows are
dealt to pairs of blocks, and a task multiplies two blocks as matrices, so memory is bounded by the
block size and no pair is a row unless it passes the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components

c = F.col
BLOCK_ROWS = 2_000
#: Rows that fit the coarse quantiser of the approximate index.
SAMPLE_ROWS = 4_096
#: Rows of a block on either side of a search, and blocks to which smaller tables are dealt, of so many rows at least.
SEARCH_ROWS, SEARCH_PARTS, LEAST_ROWS = 16_384, 8, 500
#: Rows of either side that are multiplied at once.
ASK_ROWS, CHUNK_ROWS = 512, 2_048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty ones and those of no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """(group, centroid): the mean of each group's vectors, of length 1 unless nearly 0."""
    parts = vectors.select(group, F.posexplode("embedding").alias("k", "x")).groupBy(group, "k").agg(F.avg(c("x").cast("double")).alias("x"))
    out = parts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).select(group, F.transform("v", lambda x: x["x"]).alias("v"))
    norm = F.sqrt(dot(c("v"), c("v")))
    return out.select(group, F.when(norm > 1e-10, F.transform("v", lambda x: x / norm)).otherwise(c("v")).alias("centroid"))


def nearest(vectors: DataFrame, query: list[float], k: int, exclude: str | None = None, least: float = -1.0) -> DataFrame:
    """The k most similar rows to one vector, which travels as a literal."""
    q = F.array(*map(F.lit, query))
    out = vectors.where(c("id") != exclude) if exclude is not None else vectors
    out = out.select("id", F.round(cosine(c("embedding"), q), 6).alias("similarity")).where(c("similarity") >= least)
    return out.orderBy(F.desc("similarity"), "id").limit(k)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _half_up(x: np.ndarray) -> np.ndarray:
    """Six places, halves away from 0 as in SQL."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)


def _code(asks: pa.Array, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column of both sides as numbers; strings get a number each, and nulls one that equals nothing."""
    if not pa.types.is_string(asks.type):
        return np.asarray(asks), np.asarray(rows)
    numbers: dict[str | None, int] = {}
    code = lambda x, null: np.array([null if v is None else numbers.setdefault(v, len(numbers)) for v in x.to_pylist()], np.int64)
    return code(asks, -1), code(rows, -2)


def _best(asks: pa.Table, rows: pa.Table, k: int, rate: Callable, need: Callable | None, extra: tuple[str, ...], last_id: bool) -> tuple[np.ndarray, ...]:
    """Positions of asks and rows with their similarity and score: for each ask the k rows of the highest scores."""
    order = sorted(range(rows.num_rows), key=rows["id"].to_pylist().__getitem__, reverse=last_id)
    rows = rows.take(pa.array(order, pa.int64())).combine_chunks()
    asks = asks.combine_chunks()
    q, r = _matrix(asks["embedding"].chunk(0)), _matrix(rows["embedding"].chunk(0))
    coded = {x: _code(asks[x].chunk(0), rows[x].chunk(0)) for x in extra}
    places: dict[str, list[int]] = {}
    for j, x in enumerate(rows["id"].to_pylist()):
        places.setdefault(x, []).append(j)
    own = np.array([(i, j) for i, x in enumerate(asks["id"].to_pylist()) for j in places.get(x, ())], np.int64).reshape(-1, 2)
    out = []
    for at in range(0, len(q), ASK_ROWS):
        block = slice(at, at + ASK_ROWS)
        qs = {x: v[0][block] for x, v in coded.items()}
        mine = own[(own[:, 0] >= at) & (own[:, 0] < at + ASK_ROWS)] - [at, 0]
        n = len(q[block])
        floor = np.full(n, -np.finfo(float).max)
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        for begin in range(0, len(r), CHUNK_ROWS):
            chunk = slice(begin, begin + CHUNK_ROWS)
            sims = q[block] @ r[chunk].T
            here = mine[(mine[:, 1] >= begin) & (mine[:, 1] < begin + CHUNK_ROWS)]
            sims[here[:, 0], here[:, 1] - begin] = -np.inf
            if begin and need:
                i, j = np.nonzero(sims >= need(floor, qs)[:, None] - 2e-6)
            else:
                # no score of a rounded similarity is above this by more than half a millionth
                top = rate(sims + 1e-6, {x: v[:, None] for x, v in qs.items()}, {x: v[1][chunk][None, :] for x, v in coded.items()})
                least = floor
                if not begin and top.shape[1] > k:
                    least = np.maximum(floor, np.partition(top, -k, axis=1)[:, -k] - 4e-6)
                i, j = np.nonzero(top >= least[:, None] - 1e-6)
            similarity = np.round(sims[i, j], 6)
            score = _half_up(rate(similarity, {x: v[i] for x, v in qs.items()}, {x: v[1][chunk][j] for x, v in coded.items()}))
            # rows come in the order in which ties are broken, so that only a higher score can replace one of k
            good = score > floor[i]
            kept = tuple(np.concatenate(x) for x in zip(kept, (i[good], j[good] + begin, similarity[good], score[good]), strict=True))
            by = np.lexsort((kept[1], -kept[3], kept[0]))
            kept = tuple(x[by] for x in kept)
            starts = np.searchsorted(kept[0], np.arange(n))
            place = np.arange(len(by)) - starts[kept[0]]
            kept = tuple(x[place < k] for x in kept)
            ends = np.flatnonzero(np.bincount(kept[0], minlength=n) >= k)
            if len(ends):
                last = np.searchsorted(kept[0], ends, side="right") - 1
                floor[ends] = kept[3][last]
        out.append((kept[0] + at, np.array(order, np.int64)[kept[1]] if len(kept[1]) else kept[1], kept[2], kept[3]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def best_matches(asks: DataFrame, rows: DataFrame, k: int, rate: Callable | None = None, need: Callable | None = None, extra: tuple[str, ...] = (), by: str | None = None, last_id: bool = False) -> DataFrame:
    """(query, id, similarity, score, rank), exact: for each of asks (id, embedding, extra...) the k of rows with other ids that
    have the highest scores, of equal ones those of the smallest ids (with last_id: of the largest); with `by` only rows equal in that column.

    rate(similarities, columns of asks, columns of rows) gives scores, -inf for what doesn't qualify, and may not
    fall where a similarity rises; similarities and scores are of six places; without it the similarity is the score.
    need(scores to reach, columns of asks) may give the least similarities with which that can be. Both sides are dealt to blocks of SEARCH_ROWS
    rows, and a task compares two blocks as matrices and keeps the k best of each row: no more than k rows a block come out."""
    if rate is None:
        rate, need = lambda sims, q, r: sims, lambda floor, q: floor
    both = ["id", "embedding", *extra]
    pick = lambda df: df.select(*both, (c(by).cast("string") if by else F.lit("")).alias("by"))
    asks, rows = pick(asks), pick(rows)

    def parts(df: DataFrame) -> int:
        n = df.groupBy("by").count().agg(F.max("count")).first()[0] or 0
        return max(1, -(-n // SEARCH_ROWS), min(SEARCH_PARTS, n // LEAST_ROWS))

    na, nr = parts(asks), parts(rows)
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = asks.select(*both, "by", part(na).alias("lo"), each(nr).alias("hi"), F.lit(True).alias("asks"))
    dealt = dealt.unionByName(rows.select(*both, "by", part(nr).alias("hi"), each(na).alias("lo"), F.lit(False).alias("asks")))

    def best(table: pa.Table) -> pa.Table:
        one, two = table.filter(table["asks"]), table.filter(pc.invert(table["asks"]))
        if not one.num_rows or not two.num_rows:
            i = j = np.zeros(0, np.int64)
            similarity = score = np.zeros(0)
        else:
            i, j, similarity, score = _best(one, two, k, rate, need, extra, last_id)
        return pa.table({"query": one["id"].take(pa.array(i)), "id": two["id"].take(pa.array(j)), "similarity": pa.array(similarity), "score": pa.array(score)})

    found = dealt.groupBy("by", "lo", "hi").applyInArrow(best, "query string, id string, similarity double, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("id") if last_id else F.asc("id")))
    return found.withColumn("rank", rank).where(c("rank") <= k)



def similar_pairs(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, similarity) of all pairs a < b with a cosine (to six places) of at least threshold."""
    n = vectors.count()
    blocks = max(1, -(-n // block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    dealt = vectors.select("id", "embedding", block.alias("block")).withColumn("other", F.explode(others))
    dealt = dealt.select("id", "embedding", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def multiply(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        own = np.asarray(table["block"])
        ids = np.array(table["id"].to_pylist(), object)
        m = _matrix(table["embedding"].chunk(0))
        one, two = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        sims = np.round(m[one] @ m[two].T, 6)
        i, j = np.nonzero(sims >= threshold)
        a, b, s = ids[one[i]], ids[two[j]], sims[i, j]
        keep = a < b if lo == hi else np.ones(len(a), bool)
        first = np.where(a < b, a, b)
        second = np.where(a < b, b, a)
        return pa.table({"a": pa.array(first[keep].tolist(), pa.string()), "b": pa.array(second[keep].tolist(), pa.string()), "similarity": pa.array(s[keep], pa.float64())})

    return dealt.groupBy("lo", "hi").applyInArrow(multiply, "a string, b string, similarity double")


def semantic_edges(nodes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Similarity edges (id, source_id, target_id, weight) among nodes (id, embedding, is_item, parent_id).

    A pair qualifies from the threshold on, two categories from 0.2 below. Ranking adds 0.2 for the same
    parent; a pair stays if it is among the k best of either end."""
    lower = round(threshold - 0.2, 6)

    def rate(sims: np.ndarray, q: dict, r: dict) -> np.ndarray:
        fits = (sims >= threshold) | ((sims >= lower) & ~q["is_item"] & ~r["is_item"])
        return np.where(fits, sims + np.where(q["parent_id"] == r["parent_id"], 0.2, 0.0), -np.inf)

    n = nodes.select("id", "embedding", "is_item", c("parent_id").cast("string").alias("parent_id"))
    best = best_matches(n, n, k, rate, lambda floor, q: np.maximum(floor - 0.2, np.where(q["is_item"], threshold, lower)), ("is_item", "parent_id")).select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b"), "similarity")
    best = best.select("a", "b", "similarity").distinct()
    return best.select(F.concat_ws("-", F.lit("semantic"), "a", "b").alias("id"), c("a").alias("source_id"), c("b").alias("target_id"), c("similarity").alias("weight"))


def single_linkage(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id, cluster) of the clusters of two and more."""
    pairs = similar_pairs(vectors, threshold)
    comp = components(vectors.select("id"), pairs.select(c("a").alias("source_id"), c("b").alias("target_id")))
    many = comp.groupBy("component").count().where("count > 1").select("component")
    return comp.join(many, "component").select("id", c("component").alias("cluster"))


def mergeable_siblings(nodes: DataFrame, threshold: float) -> DataFrame:
    """(parent_id, a, b, similarity) of similar siblings (id, parent_id, embedding), most similar first by parent."""
    pairs = similar_pairs(nodes.select("id", "embedding"), threshold)
    p = nodes.select("id", "parent_id")
    out = pairs.join(p.select(c("id").alias("a"), c("parent_id").alias("pa")), "a").join(p.select(c("id").alias("b"), c("parent_id").alias("pb")), "b")
    return out.where("pa = pb").select(c("pa").alias("parent_id"), "a", "b", "similarity")


def adopt(orphans: DataFrame, homes: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, parent_id, similarity): each orphan takes the parent of the most similar home, if similar enough (strictly)."""
    tagged = orphans.select(F.concat(F.lit("o"), c("id")).alias("id"), "embedding").unionByName(homes.select(F.concat(F.lit("h"), c("id")).alias("id"), "embedding"))
    pairs = similar_pairs(tagged, least).where((c("similarity") > least) & c("a").startswith("h") & c("b").startswith("o"))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("similarity", "a")).alias("a"), F.max("similarity").alias("similarity"))
    best = best.select(F.expr("substring(b, 2)").alias("id"), F.expr("substring(a, 2)").alias("home"), "similarity")
    return best.join(homes.select(c("id").alias("home"), "parent_id"), "home").select("id", "parent_id", "similarity")


class CellIndex:
    """An inverted-file index: centroids fitted on a bounded sample, every row filed under its nearest."""

    def __init__(self, vectors: DataFrame, cells: int, rounds: int = 8, seed: int = 1):
        rows = vectors.orderBy(F.xxhash64(F.lit(seed), "id")).limit(SAMPLE_ROWS).select("embedding").toPandas()
        m = np.array(rows["embedding"].tolist(), np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        centres = m[: min(cells, len(m))].copy()
        for _ in range(rounds):
            near = (m @ centres.T).argmax(axis=1)
            for k in range(len(centres)):
                if (mine := m[near == k]).size:
                    mean = mine.mean(axis=0)
                    centres[k] = mean / max(np.linalg.norm(mean), 1e-12)
        self.centres = centres
        self.filed = self._file(vectors, 1)

    def _file(self, vectors: DataFrame, probes: int) -> DataFrame:
        centres = self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = np.argsort(-(_matrix(batch.column(1)) @ centres.T), axis=1)[:, :probes]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

        rows = vectors.select("id", "embedding")
        return rows.mapInArrow(run, "id string, embedding array<float>, cells array<int>").select("id", "embedding", F.explode("cells").alias("cell"))

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query, id, similarity, rank): the k most similar rows in each query's nearest cells."""
        return best_matches(self._file(queries, probes), self.filed, k, by="cell").drop("score")


def nearest_of_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, id, similarity, rank), exact: a stated set of queries against all rows. Each block of
    rows keeps the k best of each query before they meet."""
    return best_matches(queries, vectors, k).drop("score")
