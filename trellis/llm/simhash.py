"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart share a variant at most r/2 bits from either.
So every distinct fingerprint emits all variants within r/2 bits (65 for r = 2), rows
are shuffled on the variant, and whatever meets on a variant is within r bits of each
other by the triangle inequality. Within a variant only neighbours in fingerprint
order are linked, a chain with the same components as all pairs; the links are
deduplicated and verified bit by bit. At most 1 + 64 distinct fingerprints can meet on
a variant for r = 2, whatever the data, because exact copies are one fingerprint
from the start; so no group is large. Components come from alternating star
contraction, with a table in the shared folder each round.

The pipeline's stage adds what the radius can't reach (similar_groups): sets of shingles that
share a band of minima are compared in full, in bands of any size, and those of Jaccard similarity 0.8 or more
are linked too.

Defined cases: null and blank texts have no words and the fingerprint 0, linked like
any other; a text of fewer words than a shingle is one shingle; very long texts are read in blocks; repeated rows are
copies; ids may be of any type that has an order, and repeat; a null id never becomes a component's name unless a whole
component has none; an empty table gives an empty result. Other columns, whatever their names and types, are ignored,
and keep_one hands them on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut as cut_to_table
from .common import arrow_map, column, cut
from .words import mix

SEED = 42
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_blocks(text: bytes, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, of a long one in several lists."""
    at = 0
    while at < len(text):
        end = at + block
        if end < len(text):
            cut_at = _SPACE.search(text, end)
            end = cut_at.start() if cut_at else len(text)
        yield text[at:end].lower().split()
        at = end


def _vote(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set, highest bit first."""
    out = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8")
        out += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return out


def _shingle_hashes(text: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, of a long one in several arrays; nothing for a text without words."""
    n, tail = 0, []
    for words in _word_blocks(text):
        words = tail + words
        if len(words) >= shingle:
            count = len(words) - shingle + 1
            joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)) if shingle > 1 else iter(words)
            yield np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64, count)
            n += count
        tail = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
    if not n and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64)


def _simhash(parts: list[np.ndarray]) -> int:
    votes = sum((_vote(h) for h in parts), np.zeros(64, np.int64))
    return int.from_bytes(np.packbits(2 * votes > sum(map(len, parts))).tobytes(), "big", signed=True)


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer."""
    return _simhash(list(_shingle_hashes(text, shingle, seed)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = SEED) -> DataFrame:
    """(id, fp): one row for each input row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py() or b"", shingle, seed) for x in texts], pa.int64())], ["id", "fp"])

    rows = docs.select(column(id_col).alias("id"), column(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _variants(radius: int) -> list[int]:
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be an even number of bits")
    masks = (sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints of column fp, whose components
    are those of all pairs at most radius bits apart."""
    balls = fps.select("fp").distinct().select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in _variants(radius)))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = balls.select("fp", before.alias("a")).where("a is not null")
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius).select("a", F.col("fp").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) of all linked nodes: root is the smallest node of the component.

    Alternating large-star and small-star contraction. The smallest neighbour of each
    node comes from a pre-aggregated groupBy and is joined back, so that the edges of a
    node with very many can be split over tasks. Rounds end in tables, whose sizes Spark knows.
    """
    e = cut_to_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(small_low, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        e = cut_to_table(small.union(small_low.select("u", F.col("low").alias("v"))).distinct())
        state = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("u", "v") % 1000003).cast("long"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = SEED) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    by_fp = fps.groupBy("fp").agg(F.min("id").alias("low"))
    roots = components(links(fps, radius))
    by_fp = cut(by_fp.join(roots, by_fp.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    named = by_fp.groupBy("root").agg(F.min("low").alias("component"))
    by_fp = by_fp.join(named, "root").select("fp", "component")
    return fps.join(by_fp, "fp").select("id", "fp", "component")


def hex16(col: str):
    return F.lpad(F.lower(F.hex(F.col(col))), 16, "0")


# ---- near copies by Jaccard similarity ------------------------------------------

#: Bands and minima in each: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8^5)^20 = 0.9996.
BANDS, BAND_ROWS = 20, 5
#: Texts before it in a band that a text is compared with; smaller bands are compared pair by pair.
NEIGHBOURS = 64
#: Rows of keys that may be broadcast.
BROADCAST_ROWS = 500_000
#: Longs of a set's outline, a bit for each bin that holds one of its shingles.
OUTLINE = 16
#: Sets of a crowded band that are compared with the others in one task.
PART_SETS = 4096
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.arange(BANDS, dtype=np.uint64)


def _set(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima over a set of shingles."""
    if not len(hashes):
        return []
    with np.errstate(over="ignore"):
        low = np.minimum.reduce([np.multiply.outer(_FACTORS, hashes[i : i + 4096]).min(axis=1) for i in range(0, len(hashes), 4096)]).reshape(BANDS, BAND_ROWS)
        key = mix(_BAND + np.uint64(1))
        for k in range(BAND_ROWS):
            key = mix(key + low[:, k])
    return key.view(np.int64).tolist()


def _outline(hashes: np.ndarray) -> list[int]:
    """The bins that a set of shingles occupies: 64 * OUTLINE bits as longs."""
    bits = np.zeros(64 * OUTLINE, np.uint8)
    bits[(hashes % np.uint64(64 * OUTLINE)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, key, fp, node, n, bands, outline): node stands for the set of a row's n shingles, key for its text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, nodes, sizes, bands, outlines = [], [], [], [], []
        for x in batch.column(2).cast(pa.binary()):
            parts = list(_shingle_hashes(x.as_py() or b"", shingle, SEED))
            own = _set(parts)
            fps.append(_simhash(parts))
            nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
            sizes.append(len(own))
            bands.append(_bands(own))
            outlines.append(_outline(own))
        made = [*(pa.array(x, pa.int64()) for x in (fps, nodes, sizes)), *(pa.array(x, pa.list_(pa.int64())) for x in (bands, outlines))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["id", "key", "fp", "node", "n", "bands", "outline"])

    text = column(text_col).cast("string")
    rows = docs.select(column(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return arrow_map(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, key long, fp long, node long, n long, bands array<long>, outline array<long>")


def _shingle_sets(docs: DataFrame, keys: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles) of the texts of keys (key, node)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [_set(list(_shingle_hashes(x.as_py() or b"", shingle, SEED))).view(np.int64) for x in batch.column(1).cast(pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    text = column(text_col).cast("string")
    some = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    texts = docs.select(F.xxhash64(text).alias("key"), text.alias("text")).join(some, "key").groupBy("node").agg(F.first("text").alias("text"))
    return arrow_map(texts.select("node", "text"), run, "node long, shingles array<long>")


def _close_in_order(width: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b, both) from rows (band, node, n, root, outline) in the order of bands: what _similar_pairs compares in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            rows = [np.asarray(batch.column(k)) for k in range(4)] + [np.asarray(batch.column(4).flatten()).view(np.uint64).reshape(-1, OUTLINE)]
            done = len(kept[0]) if kept else 0
            band, node, n, root, outline = kept = [np.concatenate(x) for x in zip(kept, rows, strict=True)] if kept else rows
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for back in range(1, width + 1):
                j = np.arange(max(done, back), len(band))
                i = j - back
                same = band[i] == band[j]
                if not same.any():
                    break
                # one set can't be so similar to one of another size
                at = same & (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
                i, j = i[at], j[at]
                # each bin of one's alone holds a shingle that the other lacks
                only = [np.bitwise_count(outline[x] & ~outline[y]).sum(axis=1, dtype=np.int64) for x, y in ((i, j), (j, i))]
                at_most = np.minimum(n[i] - only[0], n[j] - only[1])
                at = at_most >= similarity * (n[i] + n[j] - at_most)
                found.append((i[at], j[at]))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), n[i] + n[j])], ["a", "b", "both"])
            kept = [x[-width:] for x in kept]

    return run


def _similar_pairs(docs: DataFrame, sets: DataFrame, width: int, similarity: float, text_col: str, shingle: int) -> DataFrame:
    """(a, b): pairs of sets (node, key, n, bands, outline, root) of different roots that share a band, at most
    width apart in it, and are at least as similar as asked.

    Only bands of more than one root are ordered, and sizes and outlines bound the similarity from above before a pair
    becomes a row, so that groups of sets that are somewhat similar, but less than asked, don't make rows by their square."""
    mixed = sets.select("root", F.explode("bands").alias("band")).groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
    mixed = cut(mixed)
    some = F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed
    filed = sets.select("node", "n", "root", "outline", F.explode(F.transform("bands", lambda x, i: F.struct(x.alias("band"), F.element_at("bands", (i + 1) % BANDS + 1).alias("next")))).alias("b")).select("node", "n", "root", "outline", "b.*")
    ordered = filed.join(some, "band").repartition("band").sortWithinPartitions("band", "next", "node")
    pairs = ordered.select("band", "node", "n", "root", "outline").mapInArrow(_close_in_order(width, similarity), "a long, b long, both long")
    return _verified(docs, sets, pairs, similarity, text_col, shingle)


def _crowded_pairs(docs: DataFrame, sets: DataFrame, similarity: float, text_col: str, shingle: int) -> DataFrame | None:
    """(a, b): what _similar_pairs leaves out: the pairs of sets (node, key, n, bands, outline, root) of different
    roots in bands of more than NEIGHBOURS + 1 sets. None if each such band is of one root by now.

    In such a band the sets of the most frequent root are not compared with each other, and all others are
    compared with all. Sizes and outlines bound the similarity from above, so that few pairs become rows. The sets
    of a band are dealt to classes of size and parts of PART_SETS, so that a large band is work for many tasks.
    """
    tally = sets.select("root", F.explode("bands").alias("band")).groupBy("band", "root").agg(F.count("*").alias("members"))
    crowded = tally.groupBy("band").agg(F.sum("members").alias("members"), F.max_by("root", F.struct("members", "root")).alias("most"), F.count("*").alias("roots"))
    crowded = cut(crowded.where((F.col("members") > NEIGHBOURS + 1) & (F.col("roots") > 1)).select("band", "most", F.ceil(F.col("members") / PART_SETS).cast("int").alias("parts")))
    rows = crowded.count()
    if not rows:
        return None
    some = F.broadcast(crowded) if rows <= BROADCAST_ROWS else crowded
    # sets of a similarity that is asked for are of one class or of two next to each other
    step = 1.001 * max(-math.log(similarity), 1e-6)
    filed = cut(sets.select("node", "n", "root", "outline", F.explode("bands").alias("band")).join(some, "band").withColumn("class", F.floor(F.log("n") / step)))
    one = filed.where("root != most").select(
        "band", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), F.expr("pmod(xxhash64(node), parts)").cast("int").alias("part"), F.struct("node", "n", "root", "outline").alias("x")
    )
    other = filed.select("band", "class", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), (F.col("root") == F.col("most")).alias("frequent"), F.struct("node", "n", "root", "outline").alias("y"))
    x, y = F.col("x"), F.col("y")
    both = x["n"] + y["n"]

    def only(p: Column, q: Column) -> Column:
        # each bin of p's alone holds a shingle that q lacks
        return sum((F.bit_count(p["outline"][k].bitwiseAND(F.bitwise_not(q["outline"][k]))) for k in range(OUTLINE)), F.lit(0))

    at_most = F.least(x["n"] - only(x, y), y["n"] - only(y, x))
    met = one.join(other, ["band", "class", "part"]).where((x["root"] != y["root"]) & (F.col("frequent") | (x["node"] < y["node"])) & (at_most >= F.lit(similarity) * (both - at_most)))
    pairs = met.select(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"), both.alias("both"))
    return _verified(docs, sets, pairs, similarity, text_col, shingle)


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, similarity: float, text_col: str, shingle: int) -> DataFrame:
    """(a, b) of the pairs (a, b, both) whose sets are at least as similar as asked."""
    pairs = cut(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    keys = cut(sets.select("key", "node").join(wanted, "node").select("key", "node"))
    full = cut(_shingle_sets(docs, keys, text_col, shingle))
    compared = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(full.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return compared.where(shared >= F.lit(similarity) * (F.col("both") - shared)).select("a", "b")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 2, similarity: float = 0.8) -> DataFrame:
    """(id, key, component, stays) for each row: near copies have a similarity (Jaccard, of the sets of shingles) of at
    least this, or fingerprints within the radius; component is the smallest id reachable over them, key the
    hash of the text, and the rows of one id and text of a group stay.

    Candidates share a band of minima, and their sets are compared in full. In a band
    of more than NEIGHBOURS texts each is first compared with those next to it in the order of the next
    band, in which similar texts are mostly equal too; then, where a band still holds more than one
    group, with all that are not of its group. So every pair that shares a band is compared, or is of one group already.
    """
    rows = cut(_sketches(docs, id_col, text_col, shingle))
    sets = cut(rows.groupBy("node").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("outline").alias("outline")))
    by_fp = components(links(sets, radius))
    rooted = sets.select("node", "fp").join(by_fp.select(F.col("node").alias("fp"), "root"), "fp", "left").select("node", F.coalesce("root", "fp").alias("root"))
    # of texts within the radius each is linked to the smallest
    lowest = rooted.groupBy("root").agg(F.min("node").alias("low"))
    roots = cut(rooted.join(lowest, "root").select("node", F.col("low").alias("root")))
    # first next neighbours only, so that large groups are one before more are compared
    for width in (1, NEIGHBOURS, None):
        rooted = sets.join(roots, "node")
        found = _similar_pairs(docs, rooted, width, similarity, text_col, shingle) if width else _crowded_pairs(docs, rooted, similarity, text_col, shingle)
        if found is None:
            break
        merged = components(found.union(roots.where("node != root")))
        roots = cut(sets.select("node").join(merged, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    nodes = cut(rows.select("id", "key", "node").join(roots, "node").select("id", "key", "root"))
    named = nodes.groupBy("root").agg(F.min("id").alias("component"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    return nodes.join(named, "root").select("id", "key", "component", ((F.col("first.id").eqNullSafe(F.col("id"))) & (F.col("first.key") == F.col("key"))).alias("stays"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 2, similarity: float = 0.8) -> DataFrame:
    """The documents without near-duplicates, by similar_groups: of each group the row with the smallest id stays (rows
    without an id come last), of different texts under one id the one with the smaller hash, of rows equal in id and text the
    first; rows that share an id but not a group are documents of their own."""
    groups = cut(similar_groups(docs, id_col, text_col, shingle, radius, similarity))
    names = [f"c{k}" for k in range(len(docs.columns))]
    # plain names in between, so that any name will do
    plain = docs.toDF(*names)
    id_at, text_at = (names[docs.columns.index(x)] for x in (id_col, text_col))
    plain = plain.withColumn("key", F.xxhash64(F.col(text_at).cast("string")))

    def among(pairs: DataFrame, how: str) -> DataFrame:
        some = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
        return plain.join(some, F.col(id_at).eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), how)

    pair = [F.col("id").alias("__id"), F.col("key").alias("__key")]
    again = cut(groups.where("stays").groupBy(*pair).agg(F.count("*").alias("n")).where("n > 1").select("__id", "__key"))
    going = cut(groups.where("not stays").select(*pair).distinct().union(again))
    once = among(going, "left_anti")
    if not again.isEmpty():
        rows = cut_to_table(among(again, "left_semi").withColumn("row", F.monotonically_increasing_id()))
        first = rows.groupBy(id_at, "key").agg(F.min("row").alias("row")).select("row")
        once = once.unionByName(rows.join(first, "row", "left_semi").drop("row"))
    return once.select(*names).toDF(*docs.columns)
