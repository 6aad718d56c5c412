"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each text gives base counts (words, symbols, repeated lines and words). Texts that pass the
base rules have a vector of transformed statistics, and each language and source has a
minimum-covariance-determinant estimate of centre and scatter: from several
deterministic starts (two of robust scales alone, one with the correlations of squashed values, one with
those of directions), concentration steps keep the share H of the group's texts nearest to
the estimate and estimate anew from these, and the start with the smallest
determinant wins. A text is rejected if its squared Mahalanobis distance from its group's
centre exceeds the limit.

All texts of a group take part in every step, whatever its size: a step is one
aggregation of sums and products with map-side pre-aggregation, over histograms of distances
for the quantile, of whose border bin the share counts that makes the kept mass exactly H; so the group of a frequent source is never in one task; only a row for
each group and start (and histogram bin) is sent. Small groups borrow: the estimates of
groups under SMALL texts come from the language, and of small languages from all texts.
A floor on each variance keeps statistics that most texts share exactly (no
symbols at all) from making every other value infinitely far.

Defined cases: a null text has no words and fails the base rule; a very long text is read in blocks and
is one vector as any other; null language or source is a group of its own; repeated rows count as often
as they stand; of starts with equal determinants the first wins; a text at the limit is kept; other
columns, whatever their names, are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_map, column, cut

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUES = np.zeros(256, bool)
_CONTINUES[0x80:0xC0] = True


def _repeated_words(found: W.Words, hashes: np.ndarray, n: int) -> np.ndarray:
    """Words of each text in a window of three words that the text has twice or more."""
    first = found.first
    covered = np.zeros(len(found) + 1, np.int64)
    if len(found) > 2:
        with np.errstate(over="ignore"):
            code = W.mix(hashes[:-2] * np.uint64(3) + W.mix(hashes[1:-1] * np.uint64(5) + W.mix(hashes[2:])))
            same = found.row[:-2] == found.row[2:]
            code = W.mix(code + found.row[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(same)
        order = np.argsort(code[at], kind="stable")
        c = code[at][order]
        twin = np.zeros(len(c), bool)
        if len(c) > 1:
            equal = c[1:] == c[:-1]
            twin[1:] |= equal
            twin[:-1] |= equal
        starts = at[order[twin]]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + 3, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return inside[first[1:]] - inside[first[:-1]]


def _repeated_lines(buf: np.ndarray, at: np.ndarray, found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word equal to an earlier line, lines with a word) of each text."""
    n = len(at) - 1
    has_word = np.zeros(len(buf) + 1, np.int64)
    has_word[1:] = np.cumsum(np.bincount(found.starts, minlength=len(buf))[: len(buf)])
    edge = buf == 10
    dup, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = np.flatnonzero(edge)
    raw = buf.tobytes()
    to = np.searchsorted(breaks, at)
    for r in range(n):
        mine = breaks[to[r] : to[r + 1]].tolist()
        if not mine:
            lines[r] = int(has_word[at[r + 1]] > has_word[at[r]])
            continue
        seen: set[bytes] = set()
        s = int(at[r])
        for e in [*mine, int(at[r + 1])]:
            if has_word[e] > has_word[s]:
                line = raw[s:e]
                lines[r] += 1
                if line in seen:
                    dup[r] += 1
                else:
                    seen.add(line)
            s = e + 1
    return dup, lines


def _by_row(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(marks)])
    return total[at[1:]] - total[at[:-1]]


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(id, groups, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: list[list[np.ndarray]] = [[] for _ in names]
            for i, j, buf, at in W.chunks(batch.column(0)):
                found = W.find_words(buf, at, W.BY_SPACE, cased=True)
                dup, _ = _repeated_lines(buf, at, found)
                values = (np.diff(found.first), _by_row(W.BY_SPACE[buf] & ~_CONTINUES[buf], at), _by_row(_SYMBOL[buf], at), dup, _repeated_words(found, found.hashes(), j - i))
                for into, x in zip(got, values, strict=True):
                    into.append(x)
            if got[0]:
                counts = [pa.array(np.concatenate(x), pa.int64()) for x in got]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *counts], [*batch.schema.names[1:], *names])

    rows = docs.select(column(text_col).cast("string").alias("text"), column(id_col).alias("id"), *(column(g).cast("string").alias(f"g{k}") for k, g in enumerate(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, " + ", ".join(f"{n} long" for n in names))


# ---- minimum covariance determinant -------------------------------------------

#: Share of a group's texts that an estimate is made from, concentration steps, texts that a group needs.
H, STEPS, SMALL = 0.75, 6, 100
#: Largest squared distance of a kept text: the 0.999 quantile of chi squared with four degrees of freedom.
LIMIT = 18.47
#: Least standard deviation of each statistic, so small that in a group without repeats 2.5 repeated
#: lines in 100 words or 0.45 repeated words alone pass the limit.
FLOORS = (0.03, 0.3, 0.25, 0.12)
_P = len(FLOORS)
_X = [f"x{k}" for k in range(_P)]
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]
#: Rows of estimates that may be broadcast.
BROADCAST_ROWS = 20_000
HISTOGRAM_STEP = 1 / 64


def _chi2_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees."""
    term = total = 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return 1 - np.exp(-x / 2) * total


def consistency(share: float = H) -> float:
    """Scatter of the nearest `share` of a normal sample to that of all."""
    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, _P) < share else (low, mid)
    return share / _chi2_cdf(low, _P + 2)


def statistics() -> list[Column]:
    """The transformed statistics: word length, symbols, repeated lines and repeated words."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return [
        F.log(chars / words).alias("x0"),
        F.log1p(100 * F.col("n_symbols") / chars).alias("x1"),
        F.log1p(100 * F.col("n_dup_lines") / words).alias("x2"),
        F.sqrt(F.col("n_repeat_words") / words).alias("x3"),
    ]


def _with(rows: DataFrame, by: DataFrame, key: str, n: int) -> DataFrame:
    """Inner join to a table of n rows; beyond the bound a shuffle whose skew Spark can split."""
    return rows.join(F.broadcast(by) if n <= BROADCAST_ROWS else by, key)


def _distance(mean: str = "mean", precision: str = "precision") -> Column:
    d = [F.col(x) - F.col(mean)[k] for k, x in enumerate(_X)]
    terms = [(1 if i == j else 2) * F.col(precision)[i * _P + j] * d[i] * d[j] for i, j in _PAIRS]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


_ESTIMATE = "key string, start int, n long, mean array<double>, precision array<double>, logdet double"


def _estimate(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Centre, inverse scatter and log determinant from sums over the nearest texts."""
    t = {n: np.asarray(batch.column(n)) for n in batch.schema.names if n not in ("key", "start")}
    c, floor = consistency(), np.diag(np.square(FLOORS))
    means, precisions, dets = [], [], []
    for r in range(batch.num_rows):
        m = t["m"][r]
        mean = np.array([t[f"s{k}"][r] for k in range(_P)]) / m
        cov = np.empty((_P, _P))
        for i, j in _PAIRS:
            cov[i, j] = cov[j, i] = t[f"s{i}{j}"][r] / m - mean[i] * mean[j]
        cov = c * cov + floor
        means.append(mean.tolist())
        precisions.append(np.linalg.inv(cov).reshape(-1).tolist())
        dets.append(float(np.linalg.slogdet(cov)[1]))
    doubles = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), batch.column("n"), pa.array(means, doubles), pa.array(precisions, doubles), pa.array(dets, pa.float64())], ["key", "start", "n", "mean", "precision", "logdet"])


def _centres(rows: DataFrame) -> DataFrame:
    """(key, n, mid, scale0, scale1) for each key: medians, and scales from the quartiles and from the outer deciles."""
    bins = rows.select("key", F.posexplode(F.array(*_X)).alias("dim", "x")).groupBy("key", "dim", F.floor(F.col("x") / HISTOGRAM_STEP).alias("bin")).count()
    w = Window.partitionBy("key", "dim")
    bins = bins.withColumn("upto", F.sum("count").over(w.orderBy("bin"))).withColumn("n", F.sum("count").over(w))

    def pick(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= q * F.col("n"), (F.col("bin") + 0.5) * HISTOGRAM_STEP))

    picks = bins.groupBy("key", "dim").agg(F.max("n").alias("n"), *(pick(q).alias(f"q{int(100 * q)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)))
    floors = F.array(*map(F.lit, FLOORS))
    scales = [F.greatest((F.col("q75") - F.col("q25")) / 1.349, floors[F.col("dim")]), F.greatest((F.col("q90") - F.col("q10")) / 2.563, floors[F.col("dim")])]
    picks = picks.groupBy("key").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "q50", *(x.alias(f"scale{k}") for k, x in enumerate(scales))))).alias("d"))
    return picks.select("key", "n", *(F.transform("d", lambda x: x[f]).alias(to) for f, to in (("q50", "mid"), ("scale0", "scale0"), ("scale1", "scale1"))))  # noqa: B023


def _start_estimates(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Four first estimates for each key, from medians, scales and the sums of products of directions and squashed values."""
    t = {n: np.asarray(batch.column(n)) for n in batch.schema.names if n not in ("key", "mid", "scale0", "scale1")}
    mids, scales = batch.column("mid").to_pylist(), [batch.column(f"scale{k}").to_pylist() for k in (0, 1)]
    out: list[tuple] = []
    for r, key in enumerate(batch.column("key").to_pylist()):
        n, narrow, wide = t["n"][r], np.array(scales[0][r]), np.array(scales[1][r])
        squashed, turned = np.empty((_P, _P)), np.empty((_P, _P))
        for i, j in _PAIRS:
            squashed[i, j] = squashed[j, i] = t[f"y{i}{j}"][r] / n - t[f"y{i}"][r] / n * t[f"y{j}"][r] / n
            turned[i, j] = turned[j, i] = t[f"d{i}{j}"][r] / n
        shapes = [np.eye(_P), np.eye(_P)]
        for found in (squashed, turned):
            spread = np.sqrt(np.maximum(np.diag(found), 1e-9))
            shapes.append(found / np.outer(spread, spread) + 1e-3 * np.eye(_P))
        for k, (shape, scale) in enumerate(zip(shapes, (narrow, wide, narrow, narrow), strict=True)):
            out.append((key, k, int(n), mids[r], np.linalg.inv(shape * np.outer(scale, scale)).reshape(-1).tolist(), 0.0))
    types = [pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(types)], ["key", "start", "n", "mean", "precision", "logdet"])


def _starts(rows: DataFrame) -> DataFrame:
    """(key, start, n, mean, precision, logdet): four first estimates of each key."""
    centres = cut(_centres(rows))
    z = [(F.col(x) - F.col("mid")[k]) / F.col("scale0")[k] for k, x in enumerate(_X)]
    d = _with(rows, centres, "key", centres.count()).select("key", "n", "mid", "scale0", "scale1", *(F.tanh(x).alias(f"y{k}") for k, x in enumerate(z)), *(x.alias(f"z{k}") for k, x in enumerate(z)))
    length = F.greatest(F.sqrt(sum((F.col(f"z{k}") * F.col(f"z{k}") for k in range(1, _P)), F.col("z0") * F.col("z0"))), F.lit(1e-9))
    d = d.withColumns({f"z{k}": F.col(f"z{k}") / length for k in range(_P)})
    sums = d.groupBy("key").agg(*(F.sum(f"y{k}").alias(f"y{k}") for k in range(_P)), *(F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"y{i}{j}") for i, j in _PAIRS), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"d{i}{j}") for i, j in _PAIRS))
    return arrow_map(centres.join(sums, "key"), _start_estimates, _ESTIMATE)


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """(key, n, mean, precision, logdet) of rows (key, x0..): the best minimum-covariance-determinant estimate of each key."""
    best = cut(_starts(rows))
    n = best.count()
    w = Window.partitionBy("key", "start")
    names = ["m", *(f"s{k}" for k in range(_P)), *(f"s{i}{j}" for i, j in _PAIRS)]
    for _ in range(steps):
        d = _with(rows, best.select("key", "start", "n", "mean", "precision"), "key", n)
        d = d.withColumn("bin", F.floor(8 * F.log2(_distance() + 1e-6)).cast("int"))
        sums = d.groupBy("key", "start", "n", "bin").agg(F.count("*").alias("m"), *(F.sum(x).alias(f"s{k}") for k, x in enumerate(_X)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS))
        upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.select("key", "start", "n", *(F.col(x).alias(f"own_{x}") for x in names), *(F.sum(x).over(upto).alias(x) for x in names))
        # the bin in which the share H is reached counts with the part that makes it exactly H
        nearest = sums.where((F.col("m") >= H * F.col("n")) & (F.col("m") - F.col("own_m") < H * F.col("n"))).withColumn("over", (F.col("m") - H * F.col("n")) / F.col("own_m"))
        nearest = nearest.select("key", "start", "n", *((F.col(x) - F.col("over") * F.col(f"own_{x}")).alias(x) for x in names))
        best = cut(arrow_map(nearest, _estimate, _ESTIMATE))
    return cut(best.groupBy("key").agg(F.min_by(F.struct("n", "mean", "precision", "logdet"), F.struct("logdet", "start")).alias("e")).select("key", "e.*"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source"), min_words: int = 50, max_repeat: float = 0.5, limit: float = LIMIT) -> DataFrame:
    """(id, base counts, base_failed, distance, kept) of each row; distance is null where the base rule failed."""
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    # each part with its length, so that no two groups share a key
    part = lambda g: F.coalesce(F.concat(F.length(g), F.lit(":"), g), F.lit("-"))
    keys = [F.concat(F.lit(f"{k};"), *(part(F.col(f"g{i}")) for i in range(len(groups) - k))) for k in range(len(groups) + 1)]
    base = cut(base_counts(docs, id_col, text_col, groups).withColumn("base_failed", failed).select("*", *statistics(), *(k.alias(f"key{i}") for i, k in enumerate(keys))))
    good = base.where("not base_failed")
    # the group itself if it has enough texts, else the language, else everything
    counted = good.groupBy("key0", "key1", "key2").agg(F.count("*").alias("n"))
    counted = counted.withColumn("n1", F.sum("n").over(Window.partitionBy("key1")))
    used = cut(counted.select("key0", F.when(F.col("n") >= SMALL, F.col("key0")).when(F.col("n1") >= SMALL, F.col("key1")).otherwise(F.col("key2")).alias("key")))
    needed = cut(used.select("key").distinct())
    n_used = used.count()
    rows = _with(good.select(*_X, F.explode(F.array("key0", "key1", "key2")).alias("key")), needed, "key", n_used)
    found = estimates(rows)
    by_group = _with(used, found.select("key", "mean", "precision"), "key", n_used).select("key0", "mean", "precision")
    by = F.broadcast(by_group) if n_used <= BROADCAST_ROWS else by_group
    out = base.join(by, "key0", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(False))
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
