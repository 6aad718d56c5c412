"""Materialising between rounds of iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Written as a table to the folder of spark.checkpoint.dir, which all executors share, and
    read again, so that rounds neither recompute earlier ones nor lose them with an executor. (checkpoint() would
    hand on size estimates, which joins multiply from round to round until planning takes all the time.) Only
    where the setting is unset a temporary folder is used. Tables go when the session ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(sc, "_trellis_tables", None)
        if folder is None:
            folder = sc._trellis_tables = tempfile.mkdtemp(prefix="trellis-tables-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder.rstrip('/')}/trellis-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
