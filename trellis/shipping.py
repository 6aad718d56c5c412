"""Makes a session ready for this package's Python workers: they can import it, wherever the driver found it, and get
batches of bounded size."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
#: Bytes of rows that go to a worker at once, where the session doesn't say: long texts make batches of few rows. (A batch is
#: held several times over, in the JVM's buffers and in the worker.)
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to all present and future workers, once for each context."""
    sc = spark.sparkContext
    if BATCH_BYTES[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH_BYTES)
    if getattr(sc, "_trellis_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="trellis-"), "trellis_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(_ROOT):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
    sc.addPyFile(path)
    sc._trellis_shipped = True
    return spark
