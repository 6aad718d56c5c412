"""The pipeline's stages one after the other, on documents with awkward columns, ids and rows."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trellis.llm import mixing, sharding

from .fixtures import words


def _words(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 900, n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    folder = str(tmp_path_factory.mktemp("corpus"))
    item = " ".join(f"bench{k}" for k in range(40))
    base = [_words(rng, int(rng.integers(40, 120))) for _ in range(90)]
    toxic = [_words(rng, 30) + f" vile{k % 5} awful{k % 3} " + _words(rng, 20) for k in range(40)]
    rows = [(k, t) for k, t in enumerate(base)] + [(200 + k, t) for k, t in enumerate(toxic)]
    rows += [(300, base[0]), (301, base[1] + " more"), (302, base[2] + " " + item + " end"), (303, item), (304, None), (305, ""), (None, "a row without an id " * 4), (5, base[5]), (6, "another text under the id of one that is there already"), (306, "long " + _words(rng, 30_000))]
    docs = [(i, t, ("en", "fr", None)[k % 3], ("a", "b", "c", None)[k % 4], None if t is None else len(t), {"k": k}, k, "s", "h", "r") for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, m map<string,int>, `a.b` int, slot string, __n string, row string").write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(k >= 200)) for k in [*range(90), *range(200, 230)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i1", item)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_in_sequence(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, corpus)
        path = f"{corpus}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs
        if name != "sharding":
            assert docs.columns == columns
        if name != "mixing_to_target_weights":
            assert docs.count() <= before.count()
    ids = {name: Counter(r.doc_id for r in d.select("doc_id").collect()) for name, d in seen.items()}
    # all toxic documents and no other go, with and without labels
    assert not any(k in ids["toxicity"] for k in range(200, 240)) and all(ids["toxicity"][k] for k in (*range(90), 300, 304, 305, 306, None))
    one = ids["simhash_near_dedup"]
    assert max(v for k, v in one.items() if k != 6) == 1 and one[6] == 2
    assert not {300, 301, 305} & set(one) and all(one[k] for k in (*range(90), 302, 303, 304, 306, None))
    clean = {r.doc_id: r for r in seen["benchmark_decontamination"].collect()}
    assert 303 not in clean and "bench" not in clean[302].text and clean[302].text.endswith(" end") and clean[302].n_chars == len(clean[302].text)
    assert set(clean) == set(one) - {303}
    mixed = mixing.mix(seen["benchmark_decontamination"]).where("copies > 0").groupBy("id").agg(F.sum("copies").alias("n")).collect()
    assert {r.id: r.n for r in mixed} == dict(ids["mixing_to_target_weights"])
    table = sharding.lookup_table(sharding.shard_names())
    last = seen["sharding"]
    assert set(last.columns) == {*columns, "shard"} and ids["sharding"] == ids["mixing_to_target_weights"]
    assert all(r.shard == table[r.slot] and r.slot == sharding.hash60("" if r.doc_id is None else str(r.doc_id)) % sharding.SLOTS for r in last.select("doc_id", "slot", "shard").collect())


def test_run_gives_what_the_stages_give(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    expect = spark.read.parquet(f"{corpus}/sharding")
    assert sorted((str(r.doc_id), r.shard) for r in out.collect()) == sorted((str(r.doc_id), r.shard) for r in expect.collect())


@pytest.mark.parametrize("kind", ["empty", "text ids"])
def test_stages_on_odd_tables(spark, corpus, tmp_path, kind):
    import random

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    docs = docs.limit(0) if kind == "empty" else docs.withColumn("doc_id", F.concat(F.lit("d-"), F.col("doc_id").cast("string")))
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    if kind == "text ids":
        labels = labels.withColumn("doc_id", F.concat(F.lit("d-"), F.col("doc_id").cast("string")))
    folder = str(tmp_path / kind.replace(" ", "-"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i", words(random.Random(1), 30))], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    n = corpus_pipeline.run(spark, folder).count()
    assert (n == 0) == (kind == "empty")
