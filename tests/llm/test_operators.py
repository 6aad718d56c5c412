"""Each operator against brute force on a small table, and on an empty one."""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from trellis.llm import chat, decontam, kneser_ney, langid, mixing, quality, sharding, simhash, token_counts, toxicity
from trellis.llm import words as W

from .fixtures import documents, empty, rows

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def key(r):
    return tuple("" if x is None else str(x) for x in r)


# ---- words


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = [r[1] for r in rows()]
    seen: dict[int, bytes] = {}
    for i, j, found in W.word_chunks(pa.array(texts), W.BY_SPACE, size=2000):
        h = found.hashes()
        for r in range(j - i):
            mine = slice(found.first[r], found.first[r + 1])
            expect = SPACE.findall((texts[i + r] or "").translate(LOWER))
            got = [found.buf[a:b].tobytes().decode().translate(LOWER) for a, b in zip(found.starts[mine], found.ends[mine], strict=True)]
            assert got == expect
            for word, x in zip(got, h[mine].tolist(), strict=True):
                assert seen.setdefault(x, word) == word
    assert len(seen) == len(set(seen.values()))


# ---- 1 mixing


def _water(sizes, weights, share=1.5, cap=2.0):
    target, fixed = [0.0] * len(sizes), set()
    total = share * sum(sizes)
    while True:
        free = [k for k in range(len(sizes)) if k not in fixed]
        left, w = total - sum(target[k] for k in fixed), sum(weights[k] for k in free)
        for k in free:
            target[k] = left * weights[k] / w
        over = [k for k in free if target[k] > cap * sizes[k] + 1e-9]
        if not over:
            return target
        for k in over:
            target[k] = cap * sizes[k]
            fixed.add(k)


def test_mixing_targets_and_sizes(spark):
    docs = documents(spark)
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows())
    expect = Counter()
    for r in rows():
        expect[r[3]] += len(SPACE.findall(r[1] or ""))
    names = sorted((k for k in expect if k is not None)) + [None]
    targets = dict(zip(names, _water([expect[n] for n in names], [(5, 2, 1)[k % 3] for k in range(len(names))]), strict=True))
    for name in names:
        mine = got[got.source.isna() if name is None else got.source == name]
        assert set(mine.source_size) == {expect[name]}
        assert mine.target.iloc[0] == pytest.approx(targets[name])
        assert abs(mine.taken.sum() - targets[name]) <= mine["size"].max()
    assert (got.taken <= 2 * got["size"]).all() and (got.copies >= 0).all()
    again = mixing.mix(docs.repartition(3)).toPandas()
    order = ["id", "size", "taken"]
    assert got[order].sort_values(order).reset_index(drop=True).equals(again[order].sort_values(order).reset_index(drop=True))


def test_mixing_many_documents_is_near_its_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 11).cast("string"))).alias("source"))
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).toPandas()
    assert ((got.taken - got.target).abs() <= 37).all()
    out = mixing.sample(docs)
    assert out.columns == docs.columns
    assert out.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]


def test_mixing_empty(spark):
    assert mixing.mix(empty(spark)).count() == 0 and mixing.sample(empty(spark)).count() == 0


# ---- 2 language model


def _discounts(counts):
    n = [sum(1 for c in counts if c == k) for k in (1, 2, 3, 4)]
    if not all(n):
        return [0, 0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    clip = lambda x, top: min(max(x, 0.01), top)
    return [0, clip(1 - 2 * y * n[1] / n[0], 1.0), clip(2 - 3 * y * n[2] / n[1], 2.0), clip(3 - 4 * y * n[3] / n[2], 3.0)]


def test_kneser_ney_is_the_formula(spark):
    docs = documents(spark)
    got = kneser_ney.train_and_score(docs).toPandas()
    tokens = [(r[0], SPACE.findall((r[1] or "").translate(LOWER)) + [None]) for r in rows()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    uni, bi = Counter(), Counter()
    for i, t in tokens:
        if not held(i):
            uni.update(t)
            bi.update(zip([None, *t[:-1]], t, strict=True))
    n, v = sum(uni.values()), len(uni)
    d, cont = _discounts(list(bi.values())), Counter(w for _, w in bi)
    dw = _discounts(list(cont.values()))
    gamma, spare = Counter(), sum(dw[min(c, 3)] for c in cont.values()) / len(bi)
    for (a, _), c in bi.items():
        gamma[a] += d[min(c, 3)]
    word = lambda w: (cont[w] - dw[min(cont[w], 3)]) / len(bi) + spare / (v + 1)
    total = sum(word(w) for w in uni) + spare / (v + 1)
    assert total == pytest.approx(1)
    expect = []
    for i, t in tokens:
        base = full = 0.0
        for a, w in zip([None, *t[:-1]], t, strict=True):
            base += math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1)))
            p = word(w)
            if a in uni:
                c = bi[a, w]
                p = (c - d[min(c, 3)]) / uni[a] + gamma[a] / uni[a] * p
            full += math.log10(p)
        expect.append((i, len(t), sum(w in uni for w in t), n, round(base, 6), round(full, 6), held(i)))
    ids = [None if pd.isna(x) else int(x) for x in got.id]
    mine = list(zip(ids, got.n_tokens, got.n_known, got.train_tokens, got.base_score.round(6), got.score.round(6), got.held_out, strict=True))
    mine, expect = sorted(mine, key=key), sorted(expect, key=key)
    assert [m[:4] + m[6:] for m in mine] == [e[:4] + e[6:] for e in expect]
    assert np.allclose([m[4:6] for m in mine], [e[4:6] for e in expect], atol=1e-5)


def test_kneser_ney_empty(spark):
    assert kneser_ney.train_and_score(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b", None, None, 1, "", "", "", "", "")], empty(spark).schema)
    assert kneser_ney.score(one, kneser_ney.train(empty(spark))).first().n_known == 0


def test_bounds_split_a_frequent_context(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "RANGE_TOKENS", 50)
    docs = spark.createDataFrame([(" ".join(f"hot w{k % 17}" for k in range(500)),)], "text string")
    model = kneser_ney.train(docs)
    assert len(model.bounds) > 5
    assert sum(len(model.store.get(f"pair-{r}")) for r in range(len(model.bounds) + 1)) == model.pairs == 17 + 17 + 2


# ---- 3 chat


LAYOUTS = [
    ({"messages": [{"role": "user", "content": "a <|im_end|> \\ b"}, {"role": "assistant", "content": "\\<|x\n"}]}, "messages", [("user", "a <|im_end|> \\ b"), ("assistant", "\\<|x\n")]),
    ({"instruction": "i", "input": "in", "output": "o"}, "instruction", [("user", "i\nin"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o", "system": "s"}, "instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"prompt": "p", "response": None}, "prompt-response", [("user", "p"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}], "id": 3}, "conversations", [("user", "h"), ("assistant", "g")]),
    ({"question": "q", "answer": 4}, "question-answer", [("user", "q"), ("assistant", "4")]),
    ({"unknown": 1}, None, []),
    ({"messages": []}, None, []),
    ({"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "name": "bot", "content": "a"}]}, "messages", [("user", "u"), ("assistant", "a")]),
    ({"lang": "en", "messages": [{"role": "user", "content": "u"}], "metadata": {"a": {"b": [1, {"c": 2}]}, "d": None}, "tags": ["x"]}, "messages", [("user", "u")]),
    ({"category": "c", "prompt": "p", "response": "r"}, "prompt-response", [("user", "p"), ("assistant", "r")]),
    ({"prompt": "p", "response": "r", "surprise": 1}, None, []),
    ({"turns": [{"turn": 0, "role": "human", "text": "as it is"}]}, "turns", [("human", "as it is")]),
    ({"instruction": "x" * 300_000, "output": "o\u0000"}, "instruction", [("user", "x" * 300_000), ("assistant", "o\u0000")]),
]


def test_layouts_are_recognised_and_formatting_is_undone(spark):
    df = spark.createDataFrame([(k, json.dumps(r)) for k, (r, _, _) in enumerate(LAYOUTS)] + [(98, "{not json"), (99, None)], "i long, j string")
    chats = chat.format_turns(chat.from_json(df, "i", "j"))
    got = {r.id: r for r in chats.select("id", "layout", "turns", chat.read_back(F.col("formatted")).alias("back"), chat.masked(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for k, (_, layout, turns) in enumerate(LAYOUTS):
        assert got[k].layout == layout
        assert [(t.role, t.text) for t in got[k].turns] == turns == [(t.role, t.text) for t in got[k].back]
        assert got[k].loss == [t for r, t in turns if r == "assistant"]
    assert got[98].layout is None and got[99].turns == []
    counts = {r.layout: r.n for r in chat.layout_counts(chats).collect()}
    assert counts[None] == 2 + sum(layout is None for _, layout, _ in LAYOUTS)


def test_rows_to_chats_in_order(spark):
    odd = "x\\<|im_start|>\\n漢<"
    data = [(1, 2, "assistant", odd), (1, 1, "user", None), (1, 1, "us\ner\\n<|", "b"), (1, 1, "user", None), (None, None, None, None), (2, 0, "assistant", "")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    got = {r.id: r for r in chat.digests(chat.format_turns(chat.from_rows(df))).collect()}
    order = [("us\ner\\n<|", "b"), ("user", ""), ("user", ""), ("assistant", odd)]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, len(odd), hashlib.sha256(odd.encode()).hexdigest())
    assert got[None].n_turns == 1 and got[2].loss_chars == 0
    assert chat.format_turns(chat.from_rows(df.limit(0))).count() == 0
    typed = chat.from_typed(df.select("conv_id", "role"), "conv_id")
    assert {r.layout for r in typed.collect()} == {None} and chat.layout_counts(typed).first().n == len(data)
    # rows go by their fingerprints like any record
    assert [(r.layout, r.n) for r in chat.layout_counts(chat.from_rows(df)).collect()] == [("turns", 3)]


# ---- 4 sharding


def test_lookup_table_is_fair_and_stable(spark):
    names = sharding.shard_names(8)
    table = sharding.lookup_table(names, 503)
    sizes = Counter(table)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    more = sharding.lookup_table([*names, "shard-9999"], 503)
    assert sum(a != b for a, b in zip(table, more, strict=True)) < 503 * 0.35
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 500)
    odd = sharding.place(documents(spark).withColumn("a.b", F.lit(1)).withColumn("slot", F.lit("own")))
    assert odd.columns[-3:] == ["a.b", "slot", "shard"] and odd.schema["slot"].dataType.simpleString() == "bigint"
    large = sharding.place(spark.range(5).select(F.col("id").alias("doc_id")), slots=104_729)
    assert [r.shard for r in large.collect()] == [sharding.lookup_table(sharding.shard_names(), 104_729)[sharding.hash60(str(k)) % 104_729] for k in range(5)]
    got = sharding.place(documents(spark))
    assert got.columns == [c for c in documents(spark).columns if c not in ("slot", "shard")] + ["slot", "shard"]
    whole = sharding.lookup_table(sharding.shard_names())
    for r in got.select("doc_id", "slot", "shard").collect():
        slot = sharding.hash60("" if r.doc_id is None else str(r.doc_id)) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, whole[slot])
    assert sharding.place(empty(spark)).count() == 0


# ---- 5 language identification


def _pages(spark, n=120):
    en, fr = "the of and with that this is was for", "le la les des une est pour que dans"
    data = []
    for k in range(n):
        text, lang = ((en, "en"), (fr, "fr"))[k % 2]
        declared = {0: "", 1: ' lang="zz"'}.get(k % 7, f' lang="{lang}"')
        body = "" if k % 10 == 9 else " ".join(text.split()[(k + j) % 9] for j in range(12))
        host = "hot.example.com" if k % 2 == 0 else f"h{k % 5}.exemple.fr"
        data.append((k, f"https://{host}/x", f"<html{declared}><script>var the;</script><body>{body}</body></html>"))
    return spark.createDataFrame([*data, (n, None, None), (None, "not a url", ""), data[0]], "page_id long, url string, html string").withColumn("text", F.lit("clash")), en, fr


def test_languages_of_pages(spark):
    pages, en, fr = _pages(spark)
    docs = spark.createDataFrame([(k, (en, fr)[k % 2], ("en", "fr")[k % 2]) for k in range(40)] + [(90, None, "en"), (91, "x", None)], "doc_id long, text string, lang string")
    got = langid.identify(pages, docs).toPandas()
    assert len(got) == 123
    known = got[got.page_id < 120]
    assert (known.lang == np.where(known.page_id % 2 == 0, "en", "fr")).all()  # pages without text too, by host
    assert got.confidence.between(0, 1 + 1e-9).all()
    assert langid.identify(pages.limit(0), docs).count() == 0
    assert langid.identify(pages, docs.limit(0)).where("lang is not null").count() == 0


# ---- 6 token counts


def _unigram_model(tmp_path):
    """The vocabulary as a unigram model for the library, its unusable scores made small, as an independent count."""
    import struct

    import sentencepiece

    raw = bytearray(open(token_counts.default_path(), "rb").read())
    raw = raw.replace(struct.pack("<f", -1e9), struct.pack("<f", -5e4))

    def varint(i):
        value = shift = 0
        while True:
            value |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return value, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        n, i = varint(i)
        j = i
        while tag >> 3 == 2 and j < i + n:
            t, at = varint(j)
            if t >> 3 == 3:
                raw[at] = 1
            j = varint(at)[1] if t & 7 == 0 else at + 4 if t & 7 == 5 else at + 8 if t & 7 == 1 else sum(varint(at))
        i += n
    path = tmp_path / "unigram.model"
    path.write_bytes(bytes(raw))
    return str(path), sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))


def test_token_counts_match_the_library(spark, tmp_path):
    path, library = _unigram_model(tmp_path)
    docs = documents(spark).where("length(text) < 100000 or text is null")
    got = {(r.id, r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs, path).collect()}
    expect = set()
    for r in rows():
        if r[1] is None or len(r[1]) < 100_000:
            w = SPACE.findall(r[1] or "")
            expect.add((r[0], len(w), sum(len(library.encode(x)) for x in w if "\u00a0" not in x) + sum(token_counts.trie_counts([x], token_counts.Vocabulary.load(path))[0] for x in w if "\u00a0" in x)))
    assert got == expect
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def test_trie_counts_against_plain_search():
    v = token_counts.Vocabulary.of_pieces({"▁": -3.0, "▁a": -2.0, "b": -1.5, "ab": -1.0, "bab": -2.2, "a": -4.0})
    words = sorted({"a", "ab", "aba", "abab", "babab", "b", "zé", "abz", "aab"})

    def search(text):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(e):
                if text[s:e] in v.scores and best[s][0] + v.scores[text[s:e]] > best[e][0]:
                    best[e] = (best[s][0] + v.scores[text[s:e]], best[s][1] + 1)
            if text[e - 1] not in v.scores and best[e - 1][0] + v.unknown > best[e][0]:
                best[e] = (best[e - 1][0] + v.unknown, best[e - 1][1] + len(text[e - 1].encode()))
        return best[-1][1]

    assert token_counts.trie_counts(words, v) == [search("▁" + w) for w in words]


# ---- 7 toxicity


def _labelled(spark, n=400):
    rng = np.random.default_rng(3)
    data = []
    for k in range(n):
        toxic = int(k % 5 == 0)
        w = [f"w{x}" for x in rng.integers(0, 50, 30)]
        if toxic:
            w[3:6] = [f"vile{x}" for x in rng.integers(0, 9, 3)]
        data.append((k, " ".join(w), toxic))
    return data


def test_toxicity_separates_and_blocks_are_exact(spark):
    data = _labelled(spark)
    docs = spark.createDataFrame([(k, t, 0) for k, t, _ in data] + [(1000, None, 0), (1001, "", 0), (1002, "VILE3 words", 0), (0, data[0][1], 0)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(k, y) for k, _, y in data] + [(None, 1), (3, None)], "doc_id long, toxic int")
    index = toxicity.fit(toxicity.examples_of(docs, labels))
    got = {r.id: r.score for r in toxicity.score(docs, index).collect()}
    held = [(got[k], y) for k, _, y in data if zlib.crc32(str(k).encode()) % 3 == 1]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)
    assert all((s >= toxicity.THRESHOLD) == bool(y) for s, y in held)
    assert got[1000] == got[1001] < 0.3 and got[1002] > 0.7
    kept = toxicity.drop_toxic(docs, index)
    assert kept.columns == docs.columns and kept.where("doc_id is null or doc_id >= 1000").count() == 2
    assert len(index.labels) <= toxicity.MAX_EXAMPLES
    assert toxicity.score(empty(spark), index).count() == 0


def _dense(index, vectors, r):
    out = np.zeros(len(index.weights))
    terms, weights = vectors.row(r)
    out[terms] = weights
    return out


def test_toxicity_scores_equal_brute_force(spark):
    """Cosines of all pairs, votes, and probabilities by the min-max form of isotonic regression."""
    data = _labelled(spark, 600)
    # equal texts under several ids, one very long text, and ties
    data += [(700 + k, data[k][1], data[k][2]) for k in range(6)] + [(800, "w1 w2 vile3 " * 30_000, 1), (801, "\u00e9\u00e9 \u6f22\u5b57", 0)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in data], "doc_id long, toxic int")
    index = toxicity.fit(toxicity.examples_of(docs, labels))
    n = len(index.ids)
    own = np.array([_dense(index, index.own, r) for r in range(n)])

    def brute(query, leave=-1):
        cosines = own @ query
        if leave >= 0:
            cosines[leave] = 0
        near = sorted((i for i in range(n) if cosines[i] > 1e-12), key=lambda i: (-round(cosines[i], 9), index.ids[i]))[: toxicity.K]
        if not near:
            return None
        w = 1 / (0.05 + np.maximum(0, 1 - cosines[near]))
        return (w @ index.labels[near] + 0.5 * index.base_rate) / (w.sum() + 0.5)

    votes = {}
    for i in range(n):
        terms, weights = index.own.row(i)
        y = int(index.labels[i])
        held = index.held[:, terms] - np.array([[1 - y], [y]])
        q = np.zeros(len(index.weights))
        q[terms] = weights / index.weights[terms] * toxicity.term_weights(held[0], held[1], index.n_clean - (1 - y), index.n_toxic - y)
        if q.any() and (v := brute(q / np.linalg.norm(q), i)) is not None:
            votes[i] = v
    loo = {i: v for i in range(n) if (v := index.vote_without(i)) is not None}
    assert loo.keys() == votes.keys() and max(abs(loo[i] - votes[i]) for i in votes) < 1e-6
    order = sorted(loo, key=lambda i: (loo[i], index.labels[i]))
    x, ys = np.array([loo[i] for i in order]), np.array([index.labels[i] for i in order])
    sums = np.concatenate([[0], np.cumsum(ys)])
    means = [(sums[k + 1 :] - sums[k]) / np.arange(1, len(ys) - k + 1) for k in range(len(ys))]
    least = [np.minimum.accumulate(m[::-1])[::-1] for m in means]  # least[a][b - a]: over all ends from b
    iso = np.round([max(least[a][k - a] for a in range(k + 1)) for k in range(len(ys))], 9)
    levels = np.unique(iso)
    assert len(levels) == (len(index.knots[0]) - 2) // 2  # a pool for each level
    top = 0.0
    for level in levels:
        pool = iso == level
        top = max(top, (ys[pool].sum() + x[pool].mean()) / (pool.sum() + 1))
        assert index.knots[1][1:-1][np.searchsorted(levels, level) * 2] == pytest.approx(top)
    got = {r.id: r for r in toxicity.score(docs, index).collect()}
    found = next(iter(W.word_chunks(pa.array([t for _, t, _ in data]), W.ALNUM, size=1 << 30)))[2]
    made = toxicity.vectors(found, len(data), index.terms, index.weights)
    for r, (k, _, _) in enumerate(data):
        v = brute(_dense(index, made, r))
        expect = index.empty_rate if v is None else float(np.interp(v, *index.knots))
        assert got[k].score == pytest.approx(expect, abs=1e-6)
        assert (got[k].evidence == []) == (v is None)
        assert got[k].postings_read <= got[k].postings_all
    # an example's nearest evidence is its own text
    k = int(index.ids[0])
    assert got[k].evidence[0].cosine == pytest.approx(1.0) and dict((a, b) for a, b, _ in data)[got[k].evidence[0].doc_id] == dict((a, b) for a, b, _ in data)[k]


def test_toxicity_without_examples(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    index = toxicity.fit(toxicity.examples_of(documents(spark), labels))
    assert {r.predicted for r in toxicity.score(documents(spark), index).select((F.col("score") >= 0.7).alias("predicted")).collect()} == {False}


# ---- 8 SimHash


def _fingerprint(text, k=3):
    w = SPACE.findall((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark):
    got = simhash.near_duplicates(documents(spark)).select("id", simhash.hex16("fp").alias("fp"), "component").collect()
    fps = [(r[0], _fingerprint(r[1])) for r in rows()]
    component = {}
    for i, (_, f) in enumerate(fps):
        group = {i}
        while True:
            more = {j for j, (_, g) in enumerate(fps) if any((g ^ fps[m][1]).bit_count() <= 2 for m in group)}
            if more <= group:
                break
            group |= more
        component[i] = min((fps[m][0] for m in group if fps[m][0] is not None), default=None)
    expect = [(d, f"{f:016x}", component[i]) for i, (d, f) in enumerate(fps)]
    assert sorted(((r.id, r.fp, r.component) for r in got), key=key) == sorted(expect, key=key)


def test_links_are_those_of_all_pairs_and_chains_join(spark):
    rng = np.random.default_rng(5)
    values = [0]
    for k in range(60):  # a chain two bits apart each, far from its start at the end
        values.append(values[-1] ^ (1 << (k % 64)) ^ (1 << ((k + 7) % 64)))
    values += [int(x) for x in rng.integers(0, 1 << 63, 50)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    roots = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed * 2], "fp long")))
    root = {r.node: r.root for r in roots.collect()}
    assert len({root[v] for v in set(signed[:61])}) == 1
    assert not set(signed[61:]) & set(root)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), radius=3)


def _shingles(text, k=5):
    w = SPACE.findall((text or "").translate(LOWER))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({" ".join(w)} if w else set())


def test_one_of_each_group_stays(spark):
    docs = documents(spark).withColumns({"a.b": F.lit(1), "m": F.create_map(F.lit("k"), F.col("n_chars")), "__n": F.lit("x"), "row": F.lit(0), "key": F.lit("y"), "c0": F.lit(2)})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    data = [(r[0], r[1]) for r in rows()]
    sets, fps = [_shingles(t) for _, t in data], [_fingerprint(t, 5) for _, t in data]
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2 or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    left, expect = set(range(len(data))), []
    while left:
        group = {left.pop()}
        while more := {j for j in left if any(near(i, j) for i in group)}:
            group |= more
            left -= more
        expect.append(min((data[i][0] for i in group if data[i][0] is not None), default=None))
    assert sorted(map(str, (r.doc_id for r in kept.select("doc_id").collect()))) == sorted(map(str, expect))
    texts = docs.withColumn("doc_id", F.concat(F.lit("d-"), F.col("doc_id").cast("string")))
    assert simhash.keep_one(texts).count() == kept.count() and simhash.near_duplicates(texts).count() == docs.count()
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


def _jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_copies_of_similarity_0_8_go(spark):
    rng = np.random.default_rng(8)
    data, planted = [], []
    for k in range(160):
        n = int(rng.integers(120, 400))
        base = [f"w{x}" for x in rng.integers(0, 5_000, n)]
        goal = (0.80, 0.85, 0.90, 0.95, 0.6)[k % 5]
        # one run of new words: similarity (n - 4 - m - 4) / (n - 4 + m + 4)
        m = int(((1 - goal) * n - 8) / (1 + goal)) if goal > 0.7 else int(n * 0.25) + 8
        at = int(rng.integers(5, n - m - 5))
        copy = base[:at] + [f"x{x}" for x in rng.integers(0, 5_000, m)] + base[at + m :]
        data += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        planted.append((2 * k + 1, _jaccard(" ".join(base), " ".join(copy))))
    assert sum(0.8 <= s < 0.83 for _, s in planted) > 20
    docs = spark.createDataFrame([*data, (1000, None), (1001, ""), (None, data[0][1])], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(docs, similarity=0.8).collect()}
    assert kept == {2 * k for k in range(160)} | {i for i, s in planted if s < 0.8} | {1000}
    assert simhash.keep_one(empty(spark), similarity=0.8).count() == 0


def test_near_copies_in_a_crowded_band_go(spark):
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5_000, 300)]
    data = [(k, " ".join(base[:at] + [f"x{k}"] + base[at + 1 :])) for k, at in enumerate(rng.integers(0, 300, 400))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(docs, similarity=0.8).collect()] == [0]


def test_pairs_far_apart_in_a_crowded_band_are_linked(spark, monkeypatch):
    """With next neighbours alone, links between different groups of a crowded band are missed; with all compared none is."""
    rng = np.random.default_rng(10)
    base = [f"w{x}" for x in rng.integers(0, 5_000, 300)]
    data = []
    for family in range(25):  # families share 0.5 to 0.7 of their shingles, members of a family 0.7 to 0.95
        at, n = int(rng.integers(0, 200)), int(rng.integers(40, 80))
        head = base[:at] + [f"f{family}-{x}" for x in range(n)] + base[at + n :]
        for member in range(8):
            cut_at, m = int(rng.integers(0, 250)), int(rng.integers(1, 30))
            data.append((len(data), " ".join(head[:cut_at] + [f"m{len(data)}-{x}" for x in range(m)] + head[cut_at + m :])))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    sets, fps = [_shingles(t) for _, t in data], [_fingerprint(t, 5) for _, t in data]
    low = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if low[i] != low[j] and (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 2):
                a, b = sorted((low[i], low[j]))
                low = [a if x == b else x for x in low]
    monkeypatch.setattr(simhash, "NEIGHBOURS", 1)
    monkeypatch.setattr(simhash, "PART_SETS", 16)
    calls = []
    crowded = simhash._crowded_pairs
    monkeypatch.setattr(simhash, "_crowded_pairs", lambda *a: calls.append(crowded(*a)) or calls[-1])
    found = {r.id: r.component for r in simhash.similar_groups(docs).collect()}
    assert found == dict(enumerate(low)) and len(set(low)) > 25
    assert calls[0].count() > 0


def test_sets_less_similar_than_asked_make_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 5_000, 200)]
    data = []
    for k in range(120):  # all share 0.55 to 0.75 of the shingles, so most share bands; every third has a copy of 0.9
        cut_at = int(rng.integers(0, 160))
        text = base[:cut_at] + [f"x{k}-{j}" for j in range(int(rng.integers(18, 30)))] + base[cut_at + 30 :]
        data.append((len(data), " ".join(text)))
        if k % 3 == 0:
            data.append((len(data), " ".join([*text[:-2], f"y{k}"])))
    sets = [_shingles(t) for _, t in data]
    alike = {(i, j) for j in range(len(data)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    compared, verified = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda docs, sets, pairs, *a: compared.append(pairs.distinct().count()) or verified(docs, sets, pairs, *a))
    found = {r.id: r.component for r in simhash.similar_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(found[i] == found[j] for i, j in alike) and len(alike) >= 40
    assert sum(compared) <= 10 * len(data)


# ---- 9 quality


def _base(text):
    t = text or ""
    w = SPACE.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACE.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = [False] * len(w)
    for i in range(len(w) - 2):
        if grams[w[i], w[i + 1], w[i + 2]] > 1:
            hit[i : i + 3] = [True] * 3
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(hit)


def test_base_counts(spark):
    extra = ["a b c a b c\na b c a b c\n\n \na b c a b c", "x\nx\nx", "# * $ <b>|&% é\u0301", "\n\n"]
    data = [*[(r[0], r[1]) for r in rows()], *((100 + k, t) for k, t in enumerate(extra))]
    df = spark.createDataFrame([(i, t, "en", None) for i, t in data], "doc_id long, text string, lang string, source string")
    got = [tuple(r) for r in quality.base_counts(df).drop("g0", "g1").collect()]
    assert sorted(got, key=key) == sorted(((i, *_base(t)) for i, t in data), key=key)


def _clean(rng, n):
    return " ".join("abcdefgh"[: int(k)] + str(j) for j, k in enumerate(rng.integers(2, 8, n)))


def test_outliers_go_and_clean_documents_stay(spark):
    rng = np.random.default_rng(1)
    good = [(k, _clean(rng, int(rng.integers(60, 300))), "en", "hot" if k % 2 else f"s{k % 6}") for k in range(600)]
    bad = [(1000 + k, " ".join(f"{j}###$$$" for j in range(100)), "en", "hot") for k in range(20)] + [(1100 + k, " ".join("z" * 60 + str(j) for j in range(80)), "en", "s2") for k in range(10)]
    edge = [(2000, None, None, None), (2001, "few words", "en", None), (2002, "a b c " * 40, "en", "hot"), (2003, _clean(rng, 100), None, None)]
    df = spark.createDataFrame([*good, *bad, *edge], "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit("clash"))
    got = {r.id: r for r in quality.judge(df).collect()}
    assert all(got[k].kept for k, *_ in good) and not any(got[k].kept for k, *_ in bad)
    assert got[2000].base_failed and got[2001].base_failed and got[2002].base_failed and not got[2002].kept and got[2003].kept
    assert quality.judge(df.limit(0)).count() == 0
    assert quality.consistency() == pytest.approx(1.4864, abs=1e-3)


def _best_subset(x, h, tries, seed):
    """The least log determinant over subsets of h rows, by concentration to the end from many random starts."""
    rng, floor, c = np.random.default_rng(seed), np.diag(np.square(quality.FLOORS)), quality.consistency()
    best = (math.inf, None, None)
    for _ in range(tries):
        mine = rng.choice(len(x), 6, replace=False)
        for _ in range(40):
            mean, cov = x[mine].mean(axis=0), c * np.cov(x[mine].T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(mine):
                break
            mine = new
        det = np.linalg.slogdet(cov)[1]
        if det < best[0]:
            best = (det, mean, cov)
    return best


def test_estimates_are_those_of_the_best_subset(spark):
    """Groups with correlated statistics and with a fifth of the rows far off in one direction."""
    rng, groups = np.random.default_rng(7), {}
    for k, (n, bad) in enumerate([(120, 0), (200, 40), (400, 80), (160, 30)]):
        mix = rng.normal(size=(4, 4)) * (0.4 + k)
        x = rng.normal(size=(n, 4)) @ mix + rng.normal(size=4)
        x[:bad] = rng.normal(size=(bad, 4)) * 0.2 + x.mean(axis=0) + 9 * np.abs(mix).sum(axis=0)
        groups[f"g{k}"] = (x, bad)
    groups["still"] = (np.tile([1.0, 0.0, 0.0, 0.5], (100, 1)), 0)  # all rows alike
    df = spark.createDataFrame([(g, *map(float, r)) for g, (x, _) in groups.items() for r in x], "key string, x0 double, x1 double, x2 double, x3 double")
    got = {r.key: r for r in quality.estimates(df).collect()}
    assert got.keys() == groups.keys()
    for g, (x, bad) in groups.items():
        det, mean, cov = _best_subset(x, round(quality.H * len(x)), 150, 3)
        assert got[g].n == len(x) and got[g].logdet == pytest.approx(det, abs=0.12)
        verdicts = [np.einsum("ij,jk,ik->i", x - m, p, x - m) <= quality.LIMIT for m, p in ((mean, np.linalg.inv(cov)), (np.array(got[g].mean), np.array(got[g].precision).reshape(4, 4)))]
        assert (verdicts[0] == verdicts[1]).mean() >= 0.98
        assert not verdicts[1][:bad].any()


def test_groups_with_awkward_names_stay_apart(spark):
    rng = np.random.default_rng(5)
    names = [("a\x1fb", "c"), ("a", "b\x1fc"), (None, "c"), ("-", "c"), ("1:a", "")]
    df = spark.createDataFrame([(100 * k + i, _clean(rng, 80), lang, source) for k, (lang, source) in enumerate(names) for i in range(4)], "doc_id long, text string, lang string, source string")
    assert quality.judge(df).where("kept").count() == df.count()


def test_repeats_alone_go_from_a_clean_group(spark):
    rng = np.random.default_rng(4)
    good = [(k, _clean(rng, 200), "en", "s") for k in range(200)]
    words = _clean(rng, 200).split()
    # 45 % of the words in one repeated run, on one line
    run = " ".join(words[:110] + words[:45] + words[110:155])
    line = " ".join(words[:20])
    lines = "\n".join([line] * 5 + [" ".join(words[20:130])])
    df = spark.createDataFrame([*good, (1000, run, "en", "s"), (1001, lines, "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.id: r for r in quality.judge(df).collect()}
    assert 0.44 < got[1000].n_repeat_words / got[1000].n_words < 0.5 and got[1000].n_dup_lines == 0
    assert got[1001].n_repeat_words <= 0.5 * got[1001].n_words and got[1001].n_dup_lines == 4
    assert not got[1000].base_failed and not got[1000].kept and not got[1001].base_failed and not got[1001].kept
    assert all(got[k].kept for k, *_ in good)


# ---- 10 decontamination


def _contamination(docs, items, window=10):
    runs = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            runs.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, ids = [False] * len(w), set()
        for n in {len(r) for r in runs}:
            for k in range(len(w) - n + 1):
                if found := runs.get(tuple(w[k : k + n])):
                    ids |= {x for x in found if x is not None}
                    hit[k : k + n] = [True] * n
        out.append((i, len(w), sum(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("slice_words", [200_000, 40])
def test_contamination_against_windows(spark, monkeypatch, slice_words):
    monkeypatch.setattr(decontam.slices, "__defaults__", (10, slice_words))
    docs = [(r[0], r[1]) for r in rows()]
    long = docs[12][1].split()
    items = [(1, " ".join(long[5:25])), (2, " ".join(long[20:45])), (2, "w1 w2"), (3, None), (4, "..."), (None, " ".join(long[50:62])), (5, "W3"), (6, " ".join(long[5:25])), (10, "nowhere at all in any of these texts really not one word"), (7, "a A a a a a a a a a a a")]
    docs += [(500, "a " * 15), (501, "x " + ", ".join(long[5:16]) + " y"), (502, " ".join(long[5:14]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = [(r.id, r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(d, b).collect()]
    assert sorted(got, key=key) == sorted(_contamination(docs, items), key=key)


def test_removing_leaves_clean_documents_alone(spark):
    passage = " ".join(f"item{k}" for k in range(14))
    twice = "item0 item1 item2 item3 item4 " + passage + " item5 item6 item7 item8 item9"  # cutting joins a new window
    data = [(1, f"before it, {passage.upper()}! and after it all is well with us", 5), (2, "clean\ttext  kept as it is\n", 6), (3, passage, 7), (4, None, None), (5, "start of it all here " * 3 + twice + " end", 9)]
    d = spark.createDataFrame(data, "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.remove(d, b).collect()}
    assert set(got) == {1, 2, 4, 5} and got[2].text == data[1][1] and got[2].n_chars == 6
    assert got[1].text == "before it, ! and after it all is well with us" and got[1].n_chars == len(got[1].text)
    assert decontam.contamination(decontam.remove(d, b), b).where("n_hit > 0").count() == 0
    assert decontam.remove(d, b.limit(0)).count() == 5 and decontam.remove(d.limit(0), b).count() == 0
