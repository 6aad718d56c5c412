"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. Training words stream through it
and each gets the length of the longest run of item words that ends there; where this
reaches the window, the last `window` words are a window of some item, and the words
are hit. Items shorter than a window are one window themselves; the automaton's states
carry their ends. Words that no item has, and neighbours that no item has side by side,
end every match, so only stretches without them go through the automaton.

The items travel as broadcasts of at most SLICE_WORDS words each (their number comes
from a count of the table first); a larger benchmark is several automata, used one after the
other on each batch, so that memory holds one at a time and no item is left out.

Defined cases: a null text has no words; a null item text has no window; an item
without an id hits words but is not counted or listed; rows with the same item id
count once; equal items with different ids all count; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import arrow_map, column, cut, map_rows

#: Words of one automaton at most, unless a single item has more.
SLICE_WORDS = 200_000
WINDOW = 10


class SuffixAutomaton:
    """Of several sequences of small integers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of exactly the longest run of p followed by c."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._split(last, c)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            self.link[new] = self._split(p, c) if p >= 0 else 0
            last = new


class Slice:
    """An automaton of some items, ready to find their windows."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], window: int):
        self.window = window
        vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        self.words = W.HashSet(vocabulary)
        self.ids = [i for i, _ in items]
        texts = [np.searchsorted(vocabulary, h).tolist() for _, h in items]
        self.least = min([window, *map(len, texts)])
        pairs = [np.array(t[:-1], np.int64) * len(vocabulary) + np.array(t[1:], np.int64) for t in texts if len(t) > 1]
        self.pairs = W.HashSet(W.mix(np.concatenate(pairs).astype(np.uint64)) if pairs else np.zeros(0, np.uint64))
        sam = SuffixAutomaton()
        for t in texts:
            sam.add(t)
        self.sam = sam
        n = len(sam.link)
        by_length = sorted(range(1, n), key=sam.length.__getitem__)
        #: The state of the last `window` words of a match, and the items that hold those.
        self.whole = [-1] * n
        for v in by_length:
            if sam.length[v] >= window:
                up = sam.link[v]
                self.whole[v] = self.whole[up] if sam.length[up] >= window else v
        self.holders: dict[int, set[int]] = {}
        own: dict[int, list[tuple[int, int]]] = {}
        for k, t in enumerate(texts):
            v = 0
            for i, c in enumerate(t):
                v = sam.next[v][c]
                if i + 1 >= window:
                    self.holders.setdefault(self.whole[v], set()).add(k)
            if len(t) < window:
                own.setdefault(v, []).append((len(t), k))
        #: Short items that end where a state's runs end.
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v in by_length:
            if found := own.get(v, []) + self.short.get(sam.link[v], []):
                self.short[v] = found

    def scan(self, found: W.Words, hit: np.ndarray, items: dict[int, set]) -> None:
        """Mark hit words of a chunk, and add (slice-wide) item ids by row."""
        ids = self.words.find(found.hashes())
        known = ids >= 0
        chained = np.zeros(len(ids), bool)
        if len(ids) > 1:
            both = known[1:] & known[:-1] & (found.row[1:] == found.row[:-1])
            at = np.flatnonzero(both)
            codes = W.mix((ids[at] * len(self.words.keys) + ids[at + 1]).astype(np.uint64))
            chained[at + 1] = self.pairs.find(codes) >= 0
        starts = np.flatnonzero(known & ~chained)
        if not len(starts):
            return
        ends = np.flatnonzero(known & ~np.append(chained[1:], False)) + 1
        long = np.flatnonzero(ends - starts >= self.least)
        follow, link, length = self.sam.next, self.sam.link, self.sam.length
        for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            v = matched = 0
            got: set[int] = set()
            for i, c in enumerate(ids[s:e].tolist(), s):
                while v and c not in follow[v]:
                    v = link[v]
                    matched = length[v]
                v = follow[v][c]
                matched += 1
                if matched >= self.window:
                    hit[i + 1 - self.window : i + 1] = True
                    got |= self.holders[self.whole[v]]
                for n, k in self.short.get(v, ()):
                    if n <= matched:
                        hit[i + 1 - n : i + 1] = True
                        got.add(k)
            if got:
                items.setdefault(int(found.row[s]), set()).update(self.ids[k] for k in got)


def _hash_items(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for _, _, found in W.word_chunks(batch.column(1), W.ALNUM):
        h = found.hashes()
        out += [h[a:b].tobytes() for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "words"])


def slices(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW, slice_words: int = SLICE_WORDS) -> list:
    """Broadcasts of the automata of all items; the driver holds one slice at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    hashed = arrow_map(items, _hash_items, f"id {items.schema['id'].dataType.simpleString()}, words binary").where("length(words) > 0")
    hashed = cut(hashed)
    total = hashed.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    n = max(1, -(-int(total) // slice_words))
    part = F.pmod(F.xxhash64("words"), F.lit(n))
    out = []
    for k in range(n if total else 0):
        rows = hashed.where(part == k).orderBy("id", "words").collect()
        made = Slice([(r.id, np.frombuffer(r.words, np.uint64)) for r in rows], window)
        out.append(spark.sparkContext.broadcast(made))
    return out


def _each(shared: list) -> Iterator[Slice]:
    if len(shared) == 1:
        yield shared[0].value
    else:
        for b in shared:
            yield b.load_from_path(b._path) if getattr(b, "_path", None) else b.value


def _scan(col: pa.Array, shared: list) -> Iterator[tuple[int, int, W.Words, np.ndarray, dict[int, set]]]:
    for i, j, found in W.word_chunks(col, W.ALNUM):
        hit, items = np.zeros(len(found), bool), {}
        for one in _each(shared):
            one.scan(found, hit, items)
        yield i, j, found, hit, items


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_hit, items): words, hit words and the ids of the items found, for each row."""
    shared = slices(benchmark, item_id, item_text, window)
    kind, items_type = (pa.string(), "string") if benchmark.schema[item_id].dataType.simpleString() == "string" else (pa.int64(), "bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hits, ids = [], [], []
            for i, j, found, hit, items in _scan(batch.column(1), shared):
                words.append(np.diff(found.first))
                hits.append(np.bincount(found.row[hit], minlength=j - i))
                ids += [sorted(x for x in items.get(r, ()) if x is not None) for r in range(j - i)]
            if words:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words), pa.int64()), pa.array(np.concatenate(hits), pa.int64()), pa.array(ids, pa.list_(kind))], ["id", "n_words", "n_hit", "items"])

    narrow = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, n_words long, n_hit long, items array<{items_type}>")


def digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.8, length_col: str = "n_chars") -> DataFrame:
    """The documents without benchmark passages: every hit span is cut out, until none is
    left, and a document goes whole where hits cover over max_coverage of its words.
    Columns are kept, and length_col, where there is one, follows the text; documents
    without a hit are unchanged, byte for byte."""
    shared = slices(benchmark, item_id, item_text, window)
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def clean(text: bytes) -> bytes | None:
        while True:
            col = pa.array([text.decode()], pa.large_string())
            _, _, found, hit, _ = next(_scan(col, shared))
            if not hit.any():
                return text
            if hit.sum() > max_coverage * len(found):
                return None
            edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
            out, last = [], 0
            for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                out.append(text[last : found.starts[a]])
                last = int(found.ends[b - 1])
            text = b"".join([*out, text[last:]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        col = batch.column(at)
        new: dict[int, bytes | None] = {}
        for i, _, found, hit, _ in _scan(col, shared):
            for r in np.unique(found.row[hit]).tolist():
                new[i + r] = clean(col[i + r].as_py().encode())
        if not new:
            return batch
        texts = col.to_pylist()
        for r, text in new.items():
            texts[r] = None if text is None else text.decode()
        batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, col.type))
        if length_at is not None:
            lengths = batch.column(length_at).to_pylist()
            for r, text in new.items():
                lengths[r] = len(texts[r]) if text is not None else None
            batch = batch.set_column(length_at, batch.schema.field(length_at), pa.array(lengths, batch.column(length_at).type))
        gone = np.ones(batch.num_rows, bool)
        gone[[r for r, text in new.items() if text is None]] = False
        return batch.filter(pa.array(gone))

    return map_rows(docs, run)
