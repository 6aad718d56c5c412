"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of the contracts: maximal runs without space, tab, newline, VT, FF or CR.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def column(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, made ready for checkpoint().

    It is the session's spark.checkpoint.dir; only where that is unset (tests, a
    laptop) a temporary folder is used.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
        if not path:
            path = tempfile.mkdtemp(prefix="trellis-checkpoint-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            sc.setCheckpointDir(path)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that later jobs neither
    recompute df nor depend on the executors that made it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_shared_folder(spark: SparkSession, prefix: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def crc_bucket(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; a null id counts as empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


def map_rows(docs: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """Rows of docs by a function of whole batches, with docs' columns in their places; in between
    they have plain names, so that any name will do."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return arrow_map(plain, fn, plain.schema).toDF(*docs.columns)
