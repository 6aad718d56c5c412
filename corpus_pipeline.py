"""A training-data pipeline over documents: what is toxic, nearly the same or taken from the
benchmark goes, sources are mixed to their weights, and what is left is dealt to shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trellis.llm import decontam, mixing, sharding, simhash, toxicity
from trellis.llm.common import table
from trellis.shipping import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _documents_like(docs: DataFrame, out: DataFrame) -> DataFrame:
    return out.select(*(f"`{c}`" for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. Examples are labelled rows of the whole table."""
    ship(spark)
    index = toxicity.fit(toxicity.examples_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, index)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.8 or more) one document stays."""
    ship(spark)
    return _documents_like(docs, simhash.keep_one(docs, similarity=0.8))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such go."""
    ship(spark)
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship(spark)
    return _documents_like(docs, mixing.sample(docs))


def deal_to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With columns slot and shard."""
    ship(spark)
    return sharding.place(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("mixing_to_target_weights", mix_sources),
    ("sharding", deal_to_shards),
]

#: Votes of nearest examples and suffix automata are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet to the shared folder and read again."""
    from trellis.llm.common import new_shared_folder

    ship(spark)
    docs = table(spark, sf_dir, "documents")
    folder = new_shared_folder(spark, "trellis-pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
