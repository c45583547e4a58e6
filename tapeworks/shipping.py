"""Gives the package to the executors' Python workers, where it isn't installed there already."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of a batch that Python workers get, where the session leaves Spark's own 64 MB: a worker holds a few copies of one.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Adds the package's source to the session's Python files, once for each application, and bounds the batches that they get."""
    context = spark.sparkContext
    if not context.getConf().contains(BATCH) and spark.conf.get(BATCH).rstrip("b") == str(64 << 20):
        spark.conf.set(BATCH, str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tapeworks-")) / "tapeworks.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
