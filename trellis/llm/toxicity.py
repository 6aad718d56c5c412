"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and their first 4 to 7 bytes (so that inflected and compound forms meet).
Vectors are TF-IDF over the terms of at least MIN_DF examples, each term weighed by how much its
presence depends on the label (the phi coefficient), of length 1; where there are more
than MAX_TERMS such terms, or they have more than MAX_POSTINGS postings, those that depend least (by chi squared) go.

The examples' vectors form an inverted index whose postings are cut into blocks of
BLOCK_ROWS examples. Examples stand in the order of their strongest terms, so that those of a
block have terms in common and most blocks lack most terms. For a text, the sum of its
weights times each term's largest weight in a block bounds every cosine in that block (block-max
pruning): the blocks with the highest bounds are read first, then those whose bounds
reach the k-th best cosine so far, so that the result is that of comparing with all examples.

Votes weigh 1/(eps + 1 - cosine), with a prior of the examples' base rate; isotonic regression on
the examples, each scored without itself, turns votes into probabilities. The nearest
examples are the evidence. A text without any kept term has the (smoothed) rate of
the examples without any.

Examples are at most MAX_EXAMPLES labelled rows, those with the smallest hash of the id, one of
each text. Every text is scored, whole, without a shuffle; index size is
bounded by MAX_EXAMPLES, MAX_TERMS and MAX_POSTINGS.

Defined cases: null and blank texts count as texts without a term; a very long text is one vector
as any other, its words read in blocks; of examples of equal cosine the one with the smaller id is nearer; a
text with several labels counts as toxic if any is 1; rows without a label or an id are no examples;
repeated rows are scored alike; without any example every score is 0; an empty table gives an empty result.
Other columns, whatever their names, are not looked at, and drop_toxic hands them on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import column, crc_bucket, cut, map_rows

#: The bound of the sample that the classifier is fitted on.
MAX_EXAMPLES = 12_000
MAX_TERMS, MIN_DF = 8_192, 2
#: Postings of the index at most, about what one search may read.
MAX_POSTINGS = 120_000
PREFIXES = (4, 5, 6, 7)
K, BLOCK_ROWS, FIRST_BLOCKS, EPS, PRIOR = 15, 16, 16, 0.05, 0.5
THRESHOLD = 0.7
#: Bytes of text that are worked on at once (a longer text alone): a word has 1 + len(PREFIXES) terms, so memory is many times this.
TEXT_BYTES = 1 << 20
#: Texts whose result a task remembers, so that copies are searched for once.
REMEMBERED = 20_000


def _term_rows(found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each term of a chunk, one for each occurrence; 0 for none."""
    hashes = found.hashes(PREFIXES)
    return np.concatenate(hashes), np.tile(found.row, len(hashes))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, toxic): (term, clean, toxic) with the numbers of texts, summed for each chunk of TEXT_BYTES."""
    for batch in batches:
        toxic = np.asarray(batch.column(1)).astype(bool)
        for i, _, found in W.word_chunks(batch.column(0), W.ALNUM, size=TEXT_BYTES):
            h, row = _term_rows(found)
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) & (h != 0) if len(h) else np.zeros(0, bool)
            label = toxic[i + row[new]]
            h, at = np.unique(h[new], return_inverse=True)
            bad = np.bincount(at, weights=label, minlength=len(h)).astype(np.int64)
            every = np.bincount(at, minlength=len(h))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(every - bad), pa.array(bad)], ["term", "clean", "toxic"])


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places in spans, one after the other, and the spans' lengths."""
    lengths = ends - starts
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum())), lengths


@dataclass
class Vectors:
    """Sparse rows: the terms (places in the index) and weights of row r are those from first[r] to first[r + 1]."""

    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        mine = slice(self.first[r], self.first[r + 1])
        return self.terms[mine], self.weights[mine]

    def __len__(self) -> int:
        return len(self.first) - 1


def term_weights(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Inverse document frequency times phi of terms that so many clean and toxic examples hold; 0 for too few."""
    df, n = (clean + toxic).astype(float), n_clean + n_toxic
    spread = np.maximum(float(n_clean) * n_toxic * df * (n - df), 1e-300)
    phi = np.abs(toxic * (n_clean - clean) - clean * (n_toxic - toxic).astype(float)) / np.sqrt(spread)
    return np.where((df >= MIN_DF) & (df < n), (np.log((n + 1) / (df + 1)) + 1) * phi, 0.0)


class Index:
    """Postings of the examples' vectors by term and, within a term, by block."""

    def __init__(self, terms: W.HashSet, held: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: Vectors):
        self.terms, self.held = terms, held  # numbers of clean and toxic examples, in the order of terms.keys
        n = len(ids)
        self.n_toxic = int(labels.sum())
        self.n_clean = n - self.n_toxic
        self.weights = weights = term_weights(held[0], held[1], self.n_clean, self.n_toxic)
        of = np.repeat(np.arange(n), np.diff(rows.first))
        order = self._clustered(of, rows, n)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.labels = ids[order], labels[order].astype(float)
        self.blocks = -(-n // BLOCK_ROWS)
        by_term = np.lexsort((place[of], rows.terms))
        term, self.example, self.weight = rows.terms[by_term], place[of][by_term], rows.weights[by_term]
        key = term.astype(np.int64) * max(self.blocks, 1) + self.example // BLOCK_ROWS
        #: Entries: a term in a block, with the largest weight and the span of postings.
        self.entry = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.entry_end = np.append(self.entry[1:], len(key)).astype(np.int64)[: len(self.entry)]
        self.entry_block = self.example[self.entry] // BLOCK_ROWS
        self.entry_best = np.maximum.reduceat(self.weight, self.entry) if len(key) else np.zeros(0)
        self.term_first = np.searchsorted(term[self.entry], np.arange(len(weights) + 1))
        self.own = Vectors(np.concatenate([[0], np.cumsum(np.diff(rows.first)[order])]), *(x[_spans(rows.first[order], rows.first[order + 1])[0]] for x in (rows.terms, rows.weights)))
        self.base_rate = float((self.labels.sum() + 1) / (n + 2)) if n else 0.0
        bare = np.diff(self.own.first) == 0
        self.empty_rate = float((self.labels[bare].sum() + 2 * self.base_rate) / (bare.sum() + 2))
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    @staticmethod
    def _clustered(of: np.ndarray, rows: Vectors, n: int, strongest: int = 3) -> np.ndarray:
        """Examples in the order of their strongest terms."""
        order = np.lexsort((rows.terms, -rows.weights, of))
        first, keys = rows.first[:-1], []
        for k in range(strongest):
            has = first + k < rows.first[1:]
            at = np.where(has, first + k, 0)
            keys.append(np.where(has, rows.terms[order[at]], -1) if len(order) else np.full(n, -1))
        return np.lexsort(keys[::-1])

    def nearest(self, terms: np.ndarray, weights: np.ndarray, leave: int = -1) -> tuple[np.ndarray, np.ndarray, int, int]:
        """The K nearest examples, nearest first, of equal ones that with the smaller id: their cosines and places; and
        how many postings of the text's terms were read, of how many."""
        entry, spread = _spans(self.term_first[terms], self.term_first[terms + 1])
        if not len(entry):
            return np.zeros(0), np.zeros(0, np.int64), 0, 0
        q, block = np.repeat(weights, spread), self.entry_block[entry]
        bound = np.bincount(block, weights=q * self.entry_best[entry], minlength=self.blocks)
        start, end = self.entry[entry], self.entry_end[entry]
        read = 0

        def cosines(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the examples of these blocks: their places and cosines."""
            nonlocal read
            slot = np.full(self.blocks, -1)
            slot[blocks] = np.arange(len(blocks))
            mine = np.flatnonzero(slot[block] >= 0)
            at, lengths = _spans(start[mine], end[mine])
            read += len(at)
            example = self.example[at]
            local = slot[example // BLOCK_ROWS] * BLOCK_ROWS + example % BLOCK_ROWS
            out = np.bincount(local, weights=self.weight[at] * np.repeat(q[mine], lengths), minlength=len(blocks) * BLOCK_ROWS)
            some = np.flatnonzero(out)
            places = blocks[some // BLOCK_ROWS] * BLOCK_ROWS + some % BLOCK_ROWS
            if leave >= 0:
                some, places = some[places != leave], places[places != leave]
            return places, out[some]

        def kth(values: np.ndarray) -> float:
            return float(np.partition(values, len(values) - K)[len(values) - K]) if len(values) >= K else 0.0

        few = min(FIRST_BLOCKS, self.blocks)
        first = np.argpartition(-bound, few - 1)[:few]
        near, found = cosines(first)
        more = (bound > 0) & (bound + 1e-12 >= kth(found))
        more[first] = False
        rest = np.flatnonzero(more)
        if len(rest):
            others = cosines(rest)
            near, found = np.concatenate([near, others[0]]), np.concatenate([found, others[1]])
        good = np.flatnonzero(found >= max(kth(found), 1e-12))
        near, found = near[good], found[good]
        order = np.lexsort((self.ids[near], -found))[:K]
        return found[order], near[order], read, int((end - start).sum())

    def vote(self, cosines: np.ndarray, near: np.ndarray) -> float:
        weights = 1 / (EPS + np.maximum(0.0, 1 - cosines))
        return float((weights @ self.labels[near] + PRIOR * self.base_rate) / (weights.sum() + PRIOR))

    def vote_without(self, example: int) -> float | None:
        """The vote on an example by the others, as if terms had been weighed without it; none if it has no neighbour."""
        terms, weights = self.own.row(example)
        toxic = int(self.labels[example])
        clean, bad = self.held[0][terms] - (1 - toxic), self.held[1][terms] - toxic
        weights = weights / self.weights[terms] * term_weights(clean, bad, self.n_clean - (1 - toxic), self.n_toxic - toxic)
        some = weights > 0
        if not some.any():
            return None
        cosines, near, _, _ = self.nearest(terms[some], weights[some] / np.sqrt((weights[some] ** 2).sum()), leave=example)
        return self.vote(cosines, near) if len(near) else None

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Isotonic regression of labels on votes, by merging neighbours that are out of order; a pool's probability,
        smoothed by its mean vote as one example more, holds from its least to its largest vote."""
        pools: list[list[float]] = []  # sum of labels, number, sum of votes, least and largest vote
        for k in np.lexsort((labels, votes)):
            pools.append([labels[k], 1, votes[k], votes[k], votes[k]])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [*(a + b for a, b in zip(pools[-1][:3], last[:3], strict=True)), pools[-1][3], last[4]]
        if pools:
            y = np.maximum.accumulate([(p[0] + p[2] / p[1]) / (p[1] + 1) for p in pools])
            self.knots = (np.array([0.0, *(x for p in pools for x in p[3:]), 1.0]), np.array([0.0, *np.repeat(y, 2), 1.0]))

    def score(self, terms: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int, int]:
        """The probability, the nearest examples' places and cosines, and postings read and all."""
        cosines, near, read, every = self.nearest(terms, weights)
        probability = float(np.interp(self.vote(cosines, near), *self.knots)) if len(near) else self.empty_rate
        return probability, near, cosines, read, every


def vectors(found: W.Words, n: int, terms: W.HashSet, weights: np.ndarray) -> Vectors:
    """Weighed TF-IDF of length 1 over the kept terms, for each of n texts."""
    held = []
    for h in found.hashes(PREFIXES):
        at = terms.find(h)
        has = np.flatnonzero(at >= 0)
        held.append(found.row[has].astype(np.int64) * max(len(terms.keys), 1) + at[has])
    pairs, counts = np.unique(np.concatenate(held), return_counts=True)
    rows, cols = np.divmod(pairs, max(len(terms.keys), 1))
    w = (1 + np.log(counts)) * weights[cols]
    norm = np.sqrt(np.bincount(rows, weights=w**2, minlength=n))
    return Vectors(np.searchsorted(rows, np.arange(n + 1)), cols, w / norm[rows])


def _calibrated(spark: SparkSession, index: Index) -> Index:
    """With each example's vote by the others, found in tasks."""
    n = len(index.ids)
    shared = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.vote_without(i) for i in batch.column(0).to_pylist()], pa.float64())], ["id", "vote"])

    votes = spark.range(0, n, 1, max(1, min(64, n // 100))).mapInArrow(run, "id long, vote double").where("vote is not null").toArrow()
    at = np.asarray(votes.column("id"))
    index.calibrate(np.asarray(votes.column("vote")), index.labels[at])
    shared.destroy()
    return index


def fit(examples: DataFrame, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Index:
    """An index of labelled texts (id, text, toxic); ids are whole numbers or texts."""
    usable = examples.where("id is not null and toxic is not null")
    n = usable.count()
    if n > max_examples:
        order = F.struct(F.xxhash64("id"), "id")
        last = usable.select(order.alias("o")).orderBy("o").limit(max_examples).agg(F.max("o").alias("o")).first().o
        usable = usable.where(order <= F.struct(F.lit(last[0]).cast("bigint"), F.lit(last[1]).cast(usable.schema["id"].dataType)))
    sample = cut(usable.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("id").alias("id")))
    n, bad = sample.agg(F.count("*"), F.sum("toxic")).first()
    bad = bad or 0
    clean = n - bad
    df = sample.select("text", "toxic").mapInArrow(_document_frequencies, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    chi2 = F.try_divide(n * F.pow(a * (clean - b) - b * (bad - a), 2), bad * clean * (a + b) * (n - a - b))
    strongest = df.where(a + b >= MIN_DF).withColumn("chi2", chi2).where("chi2 > 0").orderBy(F.desc("chi2"), "term").limit(max_terms).toArrow()
    # the strongest whose postings the index has room for
    room = np.cumsum(np.asarray(strongest.column("clean")) + np.asarray(strongest.column("toxic"))) <= MAX_POSTINGS
    strongest = strongest.slice(0, int(room.sum()))
    keys = np.asarray(strongest.column("term")).view(np.uint64)
    terms = W.HashSet(keys)
    held = np.zeros((2, len(keys)), np.int64)
    held[:, np.searchsorted(terms.keys, keys)] = np.asarray(strongest.column("clean")), np.asarray(strongest.column("toxic"))
    weights = term_weights(held[0], held[1], clean, bad)

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found in W.word_chunks(batch.column(1), W.ALNUM, size=TEXT_BYTES):
                made = vectors(found, j - i, terms, weights)
                first = pa.array(made.first, pa.int32())
                lists = [pa.ListArray.from_arrays(first, pa.array(x, t)) for x, t in ((made.terms, pa.int64()), (made.weights, pa.float64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), *lists], ["id", "toxic", "terms", "weights"])

    # at most max_examples short vectors
    made = sample.select("id", "text", "toxic").mapInArrow(vectorise, f"id {sample.schema['id'].dataType.simpleString()}, toxic int, terms array<long>, weights array<double>").toArrow().sort_by("id").combine_chunks()
    sizes = [len(x) for x in made.column("terms")]
    flat = [np.asarray(made.column(c).combine_chunks().flatten()) for c in ("terms", "weights")]
    rows = Vectors(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), flat[0].astype(np.int64), flat[1].astype(float))
    ids = np.array(made.column("id").to_pylist(), dtype=str if pa.types.is_string(made.schema.field("id").type) else np.int64)
    return _calibrated(examples.sparkSession, Index(terms, held, ids, np.asarray(made.column("toxic")), rows))


def examples_of(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """Labelled texts outside the held-out fold, at most so many labels."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(crc_bucket("doc_id", folds) != held_fold).select(F.col("doc_id").alias("__id"), "toxic")
    # the smallest hashes, before any text is moved
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(max_examples)
    return docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), F.col("id") == F.col("__id")).select("id", "text", "toxic")


def _scores(model: Index, col: pa.Array, known: dict[bytes, tuple], keep: int | None = None) -> Iterator[tuple]:
    """What Index.score gives for each text, or the first `keep` of it; known remembers the results of vectors."""
    for i, j, found in W.word_chunks(col, W.ALNUM, size=TEXT_BYTES):
        made = vectors(found, j - i, model.terms, model.weights)
        for r in range(len(made)):
            terms, weights = made.row(r)
            key = hashlib.blake2b(terms.tobytes() + weights.tobytes(), digest_size=16).digest()
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = model.score(terms, weights)[:keep]
            yield known[key]


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence, postings_read, postings_all): evidence holds the nearest examples, nearest first."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    ids, id_type = (pa.string(), "string") if index.ids.dtype.kind == "U" else (pa.int64(), "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            if batch.num_rows:
                model = shared.value
                scores, near, cosines, read, every = zip(*_scores(model, batch.column(1), known), strict=True)
                first, places = np.concatenate([[0], np.cumsum([len(x) for x in near])]), np.concatenate(near).astype(np.int64)
                parts = [pa.array(model.ids[places], ids), pa.array(model.labels[places].astype(np.int32)), pa.array(np.concatenate(cosines))]
                evidence = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(parts, ["doc_id", "toxic", "cosine"]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), evidence, pa.array(read, pa.int64()), pa.array(every, pa.int64())], ["id", "score", "evidence", "postings_read", "postings_all"])

    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double, evidence array<struct<doc_id: {id_type}, toxic: int, cosine: double>>, postings_read long, postings_all long")


def drop_toxic(docs: DataFrame, index: Index, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    known: dict = {}  # each task gets one of its own

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([s < threshold for s, in _scores(shared.value, batch.column(at), known, keep=1)], pa.bool_()))

    return map_rows(docs, run)
