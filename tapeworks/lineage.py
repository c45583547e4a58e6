"""Cutting the lineage of a DataFrame that several plans use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where the session names none a local master, as in tests, gets a temporary one; on a
    cluster that would lose data, and is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tapeworks-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in a reliable checkpoint, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of a part, where their number is known: what a task holds of it then doesn't grow with the input.
ROWS_OF_PART = 500_000


def dealt(df: DataFrame, *by: str, rows: int = 0) -> DataFrame:
    """df dealt out by columns into as many parts as the session's shuffles have, or more, if it has that many rows that parts would pass ROWS_OF_PART. As the number is named, small parts aren't merged until there is one for each core and one
    more, which then runs alone."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_OF_PART)), *by)


#: Joins meet rows where they lie, if both sides are dealt out alike by some of the keys; collected sets are gathered from sorted rows, which are then in order for a join.
WHERE_THEY_LIE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.execution.useObjectHashAggregateExec": "false"}


@contextmanager
def planned_with(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Plans made within follow settings of Spark; those before are back afterwards."""
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def stored(df: DataFrame) -> DataFrame:
    """Computes df once as Parquet in the shared folder, so that later plans read the columns that they need alone; a checkpoint's rows are read whole."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, folder: str | None = None) -> None:
    """Deletes a folder that an operator left in the shared one (or, without a name, all of this session's checkpoints) once its rows aren't needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder or spark.sparkContext.getCheckpointDir() or shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
