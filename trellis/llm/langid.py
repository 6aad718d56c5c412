"""Language identification of web pages by Bayesian evidence fusion.

Evidence of a page: its visible text, the language that its markup declares, its address
suffix (top-level domain and a two-letter first path segment), and its host. The text
gives a likelihood by language from byte trigrams, counted over labelled documents
(a bounded sample of MAX_EXAMPLES). The posteriors from the text alone, summed over all pages by
grouped aggregation, say how often each declaration and suffix occurs with each
language, and how each host, its domain and all pages are distributed; a host's prior is
smoothed towards its domain's, that towards the overall one, and leaves the page itself
out. The logarithms add up to the posterior.

Sums by host are pre-aggregated, so a frequent host costs one row a task; its pages get the
prior back by a join whose skew Spark can split.

Defined cases: null or empty html has no text, which leaves the other evidence; a page without
address or declaration counts as one of its own kind of these; documents without text or
language teach nothing; without any labelled document the language is null; repeated
rows count as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import cut

MAX_EXAMPLES = 20_000
BUCKETS = 1 << 15
#: Trigrams that a text may count as at most, since neighbouring ones aren't independent.
TEXT_WEIGHT = 40
SMOOTH, KAPPA = 0.5, 5.0
BROADCAST_ROWS = 20_000


def _trigrams(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each trigram of lower-cased bytes, runs of white space as one space."""
    low = buf.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    space = ~W.BY_SPACE[low]
    low[space] = 32
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = ~(space & np.concatenate([[False], space[:-1]]))
    low, row = low[keep].astype(np.uint64), row[keep]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (low[:-2] << np.uint64(16)) | (low[1:-1] << np.uint64(8)) | low[2:]
    same = row[:-2] == row[2:]
    return (W.mix(code[same]) % np.uint64(BUCKETS)).astype(np.int64), row[2:][same]


def train_text(docs: DataFrame, max_examples: int = MAX_EXAMPLES) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each trigram bucket by language."""
    usable = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text", "doc_id")
    n = usable.count()
    chance = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_examples / max(n, 1)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for i, _, buf, at in W.chunks(batch.column(1)):
                bucket, row = _trigrams(buf, at)
                names, which = np.unique(np.array(langs[i : i + len(at) - 1], object).astype(str), return_inverse=True)
                for k, name in enumerate(names.tolist()):
                    got = np.bincount(bucket[which[row] == k], minlength=BUCKETS)
                    total[name] = total.get(name, 0) + got
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.astype(np.int64).tobytes() for x in total.values()], pa.binary())], ["lang", "counts"])

    parts = usable.where(chance).select("lang", "text").mapInArrow(count, "lang string, counts binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["lang", "counts"])

    rows = sorted(parts.repartition("lang").mapInArrow(add, "lang string, counts binary").collect(), key=lambda r: r.lang)  # a row for each language
    counts = np.array([np.frombuffer(r.counts, np.int64) for r in rows], float).reshape(len(rows), BUCKETS)
    return [r.lang for r in rows], np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32)


def visible_text(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def evidence(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with declared, host, domain, suffix and text."""
    url = F.coalesce("url", F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^(www|m)\.", "")
    segment = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?=[/?#]|$)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})(?![A-Za-z])", 1))
    return pages.select(
        "page_id",
        declared.alias("declared"),
        host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$|^([^.]+)$", 0).alias("domain"),
        F.concat_ws("/", F.regexp_extract(host, r"([^.]*)$", 1), segment).alias("suffix"),
        visible_text(F.coalesce("html", F.lit(""))).alias("text"),
    )


def _text_scores(rows: DataFrame, log_p: np.ndarray) -> DataFrame:
    """rows with column `scores` (log likelihood by language) in place of text."""
    shared = rows.sparkSession.sparkContext.broadcast(log_p)
    at_text = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            parts = []
            for i, j, buf, at in W.chunks(batch.column(at_text), 1 << 20):
                bucket, row = _trigrams(buf, at)
                n = np.bincount(row, minlength=j - i)
                total = np.stack([np.bincount(row, weights=p[k][bucket], minlength=j - i) for k in range(len(p))], axis=1)
                parts.append(total * (np.minimum(n, TEXT_WEIGHT) / np.maximum(n, 1))[:, None])
            flat = np.concatenate(parts) if parts else np.zeros((0, len(p)))
            scores = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, max(1, flat.shape[1]), dtype=np.int32), pa.array(flat.reshape(-1)))
            columns = [c for k, c in enumerate(batch.columns) if k != at_text]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*columns, scores], [*names, "scores"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, f"{kept}, scores array<double>")


def _softmax(scores: str) -> Column:
    top = F.array_max(scores)
    odds = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(odds, lambda x: x / F.aggregate(odds, F.lit(0.0), lambda a, b: a + b))


def _sums(rows: DataFrame, key: str, n: int) -> DataFrame:
    """For each key the sum of posteriors by language, as array `{key}_sum`."""
    found = rows.groupBy(key).agg(*(F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(n)))
    return found.select(key, F.array(*(f"s{k}" for k in range(n))).alias(f"{key}_sum"))


def _joined(rows: DataFrame, by: DataFrame, key: str) -> DataFrame:
    small = by.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(by) if small else by, key)


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page_id, host, declared, text_lang, lang, confidence) of each page."""
    langs, log_p = train_text(docs)
    n = len(langs)
    pages = pages.select(F.col(id_col).alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if not n:
        none = F.lit(None).cast("string")
        return evidence(pages).select("page_id", "host", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"))
    rows = cut(_text_scores(evidence(pages), log_p).withColumn("post", _softmax("scores")))
    overall = [x or 0.0 for x in rows.agg(*(F.sum(F.col("post")[k]) for k in range(n))).first()]
    every = sum(overall)
    base = [(x + 1) / (every + n) for x in overall]
    for key in ("declared", "suffix", "domain", "host"):
        rows = _joined(rows, cut(_sums(rows, key, n)), key)
    kinds = {key: max(1, rows.select(key).distinct().count()) for key in ("declared", "suffix")}

    def given(key: str, k: int) -> Column:
        return F.log((F.col(f"{key}_sum")[k] + SMOOTH) / (overall[k] + SMOOTH * kinds[key]))

    def prior(k: int) -> Column:
        own = F.col("post")[k]
        size = F.aggregate("domain_sum", F.lit(0.0), lambda a, b: a + b)
        domain = (F.greatest(F.col("domain_sum")[k] - own, F.lit(0.0)) + KAPPA * base[k]) / (F.greatest(size - 1, F.lit(0.0)) + KAPPA)
        size = F.aggregate("host_sum", F.lit(0.0), lambda a, b: a + b)
        return F.log((F.greatest(F.col("host_sum")[k] - own, F.lit(0.0)) + KAPPA * domain) / (F.greatest(size - 1, F.lit(0.0)) + KAPPA))

    fused = rows.withColumn("fused", F.array(*(F.col("scores")[k] + given("declared", k) + given("suffix", k) + prior(k) for k in range(n)))).withColumn("final", _softmax("fused"))
    names = F.array(*map(F.lit, langs))

    def best(posterior: str) -> Column:
        return F.element_at(names, F.array_position(posterior, F.array_max(posterior)).cast("int"))

    return fused.select("page_id", "host", "declared", best("post").alias("text_lang"), best("final").alias("lang"), F.array_max("final").alias("confidence"))
