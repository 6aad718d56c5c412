"""Interpolated modified Kneser-Ney bigram model, counted in Spark and kept as sorted
arrays in the shared folder, which workers map into memory to score texts.

Counting moves packed sorted arrays, not rows. Pass 1 counts words: tasks send sorted
word hashes with counts, dealt by the hash's leading bits, and each of 256 shards becomes
a sorted array; a word's id is its place over all shards. Pass 2 counts pairs of ids, dealt
by ranges of (context, word) whose bounds follow from the word counts: a very frequent
context spans many ranges, so no task gets all of it. Map-side counts are merged
before they are sent. Ranges are written as sorted 64-bit keys with counts. What a
context or a word needs from several ranges (how many followers it has once, twice
and more often; how many contexts it follows) comes together in a third, smaller step.

The model's order is 2; see the README for the disk that order 3 would take. A text's end is a token, and also
the context of the next text's first word. Scores: log10 of
p(w|v) = (c(vw) - D(c))/c(v) + gamma(v) p(w), p(w) from continuation counts with discounts
of their own, interpolated with the uniform distribution over V + 1 words; an unseen
context leaves p(w).

Defined cases: a null text is empty and has one token, its end; repeated rows count as often
as they stand; a null id counts as the text '' for the split; with no training
text every token has probability 1 (V = 0).
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import crc_bucket, new_shared_folder

#: Shards of the words by leading hash bits, and training tokens in a range of pairs.
SHARD_BITS, RANGE_TOKENS = 8, 2_000_000
SHARDS = 1 << SHARD_BITS
#: Entries that a counting task holds before it sends them.
HELD = 3_000_000
END = np.uint64(0xE0D5_0F7E_1C3A_9B27)


class Store:
    """Arrays by name in a folder that all workers reach. In a local or mounted folder
    they are mapped in place; from other stores a worker fetches its own copy."""

    def __init__(self, folder: str):
        self.folder = folder
        self._open: dict[str, np.ndarray] = {}

    def __reduce__(self):
        return Store, (self.folder,)

    def _local(self) -> str | None:
        if "://" not in self.folder and not self.folder.startswith("file:"):
            return self.folder
        return self.folder[5:].replace("///", "/", 1).replace("//", "/", 1) if self.folder.startswith("file:") else None

    def put(self, name: str, array: np.ndarray) -> None:
        if local := self._local():
            os.makedirs(local, exist_ok=True)
            part = f"{local}/.{name}-{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                np.save(f, array)
            os.replace(part, f"{local}/{name}.npy")
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(self.folder)
            store.create_dir(path)
            with store.open_output_stream(f"{path}/{name}.npy") as f:
                np.save(f, array)

    def get(self, name: str) -> np.ndarray:
        if name not in self._open:
            if local := self._local():
                self._open[name] = np.load(f"{local}/{name}.npy", mmap_mode="r")
            else:
                from pyarrow import fs

                store, path = fs.FileSystem.from_uri(self.folder)
                with tempfile.NamedTemporaryFile(suffix=".npy") as copy, store.open_input_stream(f"{path}/{name}.npy") as f:
                    while block := f.read(1 << 24):
                        copy.write(block)
                    copy.flush()
                    self._open[name] = np.load(copy.name, mmap_mode="r")  # the map outlives the name
        return self._open[name]


def _pack(*columns: np.ndarray) -> bytes:
    """Integer arrays of one length, by bytes of equal weight, compressed."""
    n = len(columns[0])
    planes = [c.astype("<u8").view(np.uint8).reshape(n, 8).T.tobytes() for c in columns]
    raw = np.int64(n).tobytes() + np.int64(len(columns)).tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    n, k = np.frombuffer(raw, np.int64, 2)
    planes = np.frombuffer(raw, np.uint8, offset=16).reshape(int(k), 8, int(n))
    return [np.ascontiguousarray(planes[i].T).view("<u8").reshape(-1) for i in range(int(k))]


def _pack_sorted(keys: np.ndarray, *more: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)), *more)


def _unpack_sorted(blob: bytes) -> list[np.ndarray]:
    keys, *more = _unpack(blob)
    return [np.cumsum(keys, dtype=np.uint64), *more]


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


class _Counter:
    """Counts of keys, held sorted; full() when they should be sent."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = self.merged = 0

    def add(self, keys: np.ndarray) -> None:
        k, c = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(c.astype(np.uint64))
        self.held += len(k)
        if self.held > max(HELD, 2 * self.merged):
            self._merge()

    def _merge(self) -> None:
        if self.keys:
            k, c = _sum_by(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.held, self.merged = [k], [c], len(k), len(k)

    def full(self) -> bool:
        return self.merged > HELD

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        out = (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.__init__()
        return out


def _tokens(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with ends, index of each row's first token)."""
    for i, j, found in W.word_chunks(col, W.BY_SPACE):
        stream = np.insert(found.hashes(), found.first[1:], END)
        yield i, j, stream, found.first + np.arange(j - i + 1)


def _rows(groups: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Counter()

    def send() -> pa.RecordBatch:
        k, c = held.take()
        at = np.searchsorted(k >> np.uint64(64 - SHARD_BITS), np.arange(SHARDS + 1))
        full = np.flatnonzero(np.diff(at)).tolist()
        return _rows(full, [_pack_sorted(k[at[s] : at[s + 1]], c[at[s] : at[s + 1]]) for s in full])

    for batch in batches:
        for _, _, stream, _ in _tokens(batch.column(0)):
            held.add(stream)
            if held.full():
                yield send()
    yield send()


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each part; rows come sorted by part."""
    part, blobs = None, []
    for batch in batches:
        for p, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if p != part and blobs:
                yield part, blobs
                blobs = []
            part = p
            blobs.append(blob)
    if blobs:
        yield part, blobs


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of packed (keys, counts), a few at a time."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pend: list[list[np.ndarray]] = []
    size = 0
    for k, blob in enumerate(blobs, 1):
        pend.append(_unpack_sorted(blob))
        size += len(pend[-1][0])
        if size > max(HELD, len(keys)) or k == len(blobs):
            keys, counts = _sum_by(np.concatenate([keys, *(p[0] for p in pend)]), np.concatenate([counts, *(p[1] for p in pend)]))
            pend, size = [], 0
    return keys, counts


def _often(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


@dataclass
class Discounts:
    one: float
    two: float
    more: float

    @classmethod
    def of(cls, n1: int, n2: int, n3: int, n4: int) -> Discounts:
        """From the numbers of keys with counts 1 to 4; .5, 1 and 1.5 where those don't define them."""
        if not (n1 and n2 and n3 and n4):
            return cls(0.5, 1.0, 1.5)
        y = n1 / (n1 + 2 * n2)
        one, two, more = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
        return cls(min(max(one, 0.01), 1.0), min(max(two, 0.01), 2.0), min(max(more, 0.01), 3.0))

    def of_counts(self, c: np.ndarray) -> np.ndarray:
        return np.where(c == 1, self.one, np.where(c == 2, self.two, np.where(c > 2, self.more, 0.0)))


@dataclass
class Model:
    store: Store
    tokens: int = 0
    first_id: list[int] = field(default_factory=list)  # of each shard; the number of words last
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # first keys of ranges but the first
    pair: Discounts = field(default_factory=lambda: Discounts(0.5, 1.0, 1.5))
    word: Discounts = field(default_factory=lambda: Discounts(0.5, 1.0, 1.5))
    pairs: int = 0
    word_gamma: float = 1.0

    @property
    def words(self) -> int:
        return self.first_id[-1] if self.first_id else 0

    def lookup(self, hashes: np.ndarray, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
        """Ids of sorted hashes (-1: unknown) and values of each name's array (0: unknown)."""
        ids, out = np.full(len(hashes), -1, np.int64), [np.zeros(len(hashes)) for _ in names]
        at = np.searchsorted(hashes >> np.uint64(64 - SHARD_BITS), np.arange(SHARDS + 1))
        for s in np.flatnonzero(np.diff(at)).tolist():
            if self.first_id[s] == self.first_id[s + 1]:
                continue
            keys, mine = self.store.get(f"word-{s}"), slice(at[s], at[s + 1])
            place = np.minimum(np.searchsorted(keys, hashes[mine]), len(keys) - 1)
            good = keys[place] == hashes[mine]
            ids[mine][good] = place[good] + self.first_id[s]
            for into, name in zip(out, names, strict=True):
                into[mine][good] = self.store.get(f"{name}-{s}")[place[good]]
        return ids, out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys."""
        out = np.zeros(len(keys))
        at = np.concatenate([[0], np.searchsorted(keys, self.bounds), [len(keys)]])
        for r in np.flatnonzero(np.diff(at)).tolist():
            have, mine = self.store.get(f"pair-{r}"), slice(at[r], at[r + 1])
            if len(have):
                place = np.minimum(np.searchsorted(have, keys[mine]), len(have) - 1)
                good = have[place] == keys[mine]
                out[mine][good] = self.store.get(f"paircount-{r}")[place[good]]
        return out


def _word_at(model: Model, totals: list[int], position: float) -> tuple[int, int, int]:
    """(id, tokens before it, its count) of the word at a position of all training tokens in id order."""
    starts = np.concatenate([[0], np.cumsum(totals)])
    s = min(int(np.searchsorted(starts, position, side="right")) - 1, SHARDS - 1)
    while not totals[s]:
        s -= 1
    c = model.store.get(f"count-{s}")
    upto = np.cumsum(c, dtype=np.int64)
    k = min(int(np.searchsorted(upto, position - starts[s], side="right")), len(c) - 1)
    return model.first_id[s] + k, int(starts[s] + upto[k] - c[k]), int(c[k])


def _range_bounds(model: Model, totals: list[int]) -> np.ndarray:
    """First keys of ranges that would be equally large if words were independent."""
    n = max(1, -(-model.tokens // RANGE_TOKENS))
    out = []
    for r in range(1, n):
        position = r * model.tokens / n
        a, before, count = _word_at(model, totals, position)
        b, _, _ = _word_at(model, totals, (position - before) / count * model.tokens)
        out.append((a << 32) + b)
    return np.unique(np.array(out, np.uint64))


def train(texts: DataFrame, text_col: str = "text") -> Model:
    """A model of all rows of texts."""
    spark = texts.sparkSession
    store = Store(new_shared_folder(spark, "trellis-lm"))
    texts = texts.select(F.col(text_col).cast("string").alias("text"))
    tasks = min(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))  # each takes its shards one by one

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, blobs in _by_part(batches):
            k, c = _merged(blobs)
            store.put(f"word-{s}", k)
            store.put(f"count-{s}", c)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(k)], pa.int64()), pa.array([int(c.sum())], pa.int64())], ["part", "n", "total"])

    parts = texts.mapInArrow(_count_words, "part int, blob binary").repartition(tasks, "part").sortWithinPartitions("part")
    n, totals = [0] * SHARDS, [0] * SHARDS
    for r in parts.mapInArrow(write_words, "part int, n long, total long").collect():  # SHARDS rows at most
        n[r.part], totals[r.part] = r.n, r.total
    model = Model(store, sum(totals), [0, *np.cumsum(n).tolist()])
    if not model.tokens:
        return model
    if model.words >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    model.bounds = _range_bounds(model, totals)
    first_id = np.array(model.first_id)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counter()

        def send() -> pa.RecordBatch:
            k, c = held.take()
            at = np.concatenate([[0], np.searchsorted(k, model.bounds), [len(k)]])
            full = np.flatnonzero(np.diff(at)).tolist()
            return _rows(full, [_pack_sorted(k[at[r] : at[r + 1]], c[at[r] : at[r + 1]]) for r in full])

        for batch in batches:
            for _, _, stream, _ in _tokens(batch.column(0)):
                words, inverse = np.unique(stream, return_inverse=True)
                ids = model.lookup(words)[0].astype(np.uint64)
                end = ids[np.searchsorted(words, END)]
                ids = ids[inverse]
                held.add((np.concatenate([[end], ids[:-1]]) << np.uint64(32)) + ids)
                if held.full():
                    yield send()
        yield send()

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, blobs in _by_part(batches):
            k, c = _merged(blobs)
            store.put(f"pair-{r}", k)
            store.put(f"paircount-{r}", c.astype(np.uint32) if int(c.max(initial=0)) < 1 << 32 else c)
            rows, parts = [_pack(np.array([len(k), *_often(c)], np.uint64))], [-1]
            low = k & np.uint64(0xFFFFFFFF)
            after, contexts = np.unique(low, return_counts=True)
            v = k >> np.uint64(32)
            before, at = np.unique(v, return_index=True)
            kinds = [np.add.reduceat((kind).astype(np.int64), at) if len(at) else at for kind in (c == 1, c == 2, c > 2)]
            for ids, kind, values in ((after, 0, [contexts]), (before, 1, kinds)):
                to = np.searchsorted(ids, first_id.astype(np.uint64))
                for s in np.flatnonzero(np.diff(to)).tolist():
                    mine = slice(to[s], to[s + 1])
                    rows.append(bytes([kind]) + _pack_sorted(ids[mine], *(x[mine].astype(np.uint64) for x in values)))
                    parts.append(s)
            yield _rows(parts, rows)

    ranges = len(model.bounds) + 1
    told = texts.mapInArrow(count_pairs, "part int, blob binary").repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(write_pairs, "part int, blob binary")
    from .common import cut

    told = cut(told)  # what contexts and words need of the ranges
    often = np.zeros(5, np.int64)
    for row in told.where("part < 0").select("blob").collect():  # one for each range: totals
        often += _unpack(bytes(row.blob))[0].astype(np.int64)
    for r in set(range(ranges)) - {-1}:
        with contextlib.suppress(FileNotFoundError):
            store.get(f"pair-{r}")
            continue
        store.put(f"pair-{r}", np.zeros(0, np.uint64))
        store.put(f"paircount-{r}", np.zeros(0, np.uint32))
    model.pairs, model.pair = int(often[0]), Discounts.of(*often[1:].tolist())
    d = model.pair

    def write_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, blobs in _by_part(batches):
            size, first = int(first_id[s + 1] - first_id[s]), np.uint64(first_id[s])
            follows, gamma = np.zeros(size, np.int64), np.zeros(size)
            for blob in blobs:
                ids, *values = _unpack_sorted(blob[1:])
                at = (ids - first).astype(np.int64)
                if blob[0] == 0:
                    follows[at] += values[0].astype(np.int64)
                else:
                    gamma[at] += d.one * values[0] + d.two * values[1] + d.more * values[2]
            store.put(f"follows-{s}", follows)
            store.put(f"gamma-{s}", gamma / store.get(f"count-{s}"))
            yield _rows([s], [_pack(np.array([*_often(follows), int((follows > 2).sum())], np.uint64))])

    rest = told.where("part >= 0").repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(write_rest, "part int, blob binary")
    often = sum((_unpack(bytes(row.blob))[0].astype(np.int64) for row in rest.select("blob").collect()), np.zeros(5, np.int64))
    n1, n2, n3, n4, more = often.tolist()
    model.word = Discounts.of(n1, n2, n3, n4)
    model.word_gamma = (model.word.one * n1 + model.word.two * n2 + model.word.more * more) / model.pairs
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, n = model.words, model.tokens
        for batch in batches:
            got: list[list[np.ndarray]] = [[], [], [], []]
            for _, _, stream, first in _tokens(batch.column(1)):
                words, inverse = np.unique(stream, return_inverse=True)
                ids, (count, follows, gamma) = model.lookup(words, "count", "follows", "gamma") if n else (np.full(len(words), -1), [np.zeros(len(words))] * 3)
                p_word = (follows - model.word.of_counts(follows)) / max(1, model.pairs) + model.word_gamma / (v + 1)
                base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
                end = np.searchsorted(words, END)
                after = inverse
                before = np.concatenate([[end], inverse[:-1]])
                p = p_word[after]
                seen = np.flatnonzero(ids[before] >= 0)
                a, b = before[seen], after[seen]
                joint = np.zeros(len(seen))
                known = np.flatnonzero(ids[b] >= 0)
                if len(known):
                    keys, back = np.unique((ids[a[known]].astype(np.uint64) << np.uint64(32)) + ids[b[known]].astype(np.uint64), return_inverse=True)
                    c = model.pair_counts(keys)
                    joint[known] = (c - model.pair.of_counts(c))[back]
                p[seen] = joint / count[a] + gamma[a] * p[seen] if len(seen) else p[seen]
                at = first[:-1]
                for into, x in zip(got, (np.diff(first), np.add.reduceat((count > 0)[inverse].astype(np.int64), at), np.add.reduceat(base[inverse], at), np.add.reduceat(np.log10(p), at)), strict=True):
                    into.append(x)
            if got[0]:
                n_tokens, n_known, base_score, full = (np.concatenate(x) for x in got)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(np.full(len(n_tokens), n), pa.int64()), pa.array(base_score), pa.array(full)], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """Scores of all rows by a model of those outside the held-out fold, with held_out."""
    model = train(docs.where(crc_bucket(id_col, folds) != held_fold), text_col)
    return score(docs, model, id_col, text_col).withColumn("held_out", crc_bucket("id", folds) == held_fold)
