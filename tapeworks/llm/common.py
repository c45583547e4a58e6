"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.lineage import clear, cut, shared_dir

__all__ = ["Scratch", "OWN", "ascii_lower", "cut", "fresh_dir", "join_hot", "keep_rows", "row_key", "shared_dir", "text_of"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"

#: Internal columns start with this, so that extra columns of the input can't clash with them.
OWN = "__tw_"

#: How many of the most frequent keys join_hot() broadcasts: no other key has more than one row in so many.
HOT_KEYS = 10_000


def fresh_dir(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


class Scratch:
    """Written tables of an iterative job: each name holds one, and what it held before is deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        folder = fresh_dir(self.spark, name)
        df.write.parquet(folder)
        self.drop(name)
        self.folders[name] = folder
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.folders:
                clear(self.spark, self.folders.pop(name))


#: Whether Spark deletes an execution's shuffle files when it ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as each execution ends: jobs of hundreds of exchanges would keep them all."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else. Text that is all ASCII takes the fast built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(df: DataFrame) -> DataFrame:
    """doc_id, text (null kept) and a hash of the text. Rows are told apart by id and hash, so that rows
    which share a doc_id but hold other texts don't mix their results."""
    return df.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))


def keep_rows(docs: DataFrame, verdicts: DataFrame, keep: Column) -> DataFrame:
    """The rows of docs, in their own columns, for which keep holds. verdicts: doc_id and text_hash
    (unique), and the columns that keep uses, whose names start with OWN."""
    own = docs.withColumn(f"{OWN}hash", F.xxhash64("text"))
    right = verdicts.withColumnsRenamed({"doc_id": f"{OWN}id", "text_hash": f"{OWN}right"})
    joined = own.join(right, own["doc_id"].eqNullSafe(right[f"{OWN}id"]) & own[f"{OWN}hash"].eqNullSafe(right[f"{OWN}right"]), "left")
    return joined.where(keep).select(*[own[f"`{c}`"] for c in docs.columns])


def join_hot(rows: DataFrame, small: DataFrame, keys: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """rows joined with small (inner or left), which has each key (of longs) once and in column n about how many of rows have it. The rows of the HOT_KEYS most frequent keys
    meet a broadcast of those keys and are then dealt out by a hash of the row, so that no task gets a hot key's rows; all others are joined by a shuffle."""
    rest = [c for c in small.columns if c not in keys]
    named = small.select(*[F.col(k).alias(f"{OWN}{k}") for k in keys], F.struct(*rest).alias(f"{OWN}rest"))
    hot = cut(named.orderBy(F.desc(F.col(f"{OWN}rest.{n}")), *[f"{OWN}{k}" for k in keys]).limit(HOT_KEYS)).withColumnRenamed(f"{OWN}rest", f"{OWN}hot")
    met = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"{OWN}{k}") for k in keys], "left").drop(*[f"{OWN}{k}" for k in keys])
    open_ = F.col(f"{OWN}hot").isNull()
    dealt = met.withColumns({f"{OWN}cold": open_, f"{OWN}deal": F.when(open_, F.col(keys[0])).otherwise(F.xxhash64(*rows.columns))})
    same = [F.col(f"{OWN}deal") == F.col(f"{OWN}{keys[0]}"), *[F.col(k) == F.col(f"{OWN}{k}") for k in keys[1:]], F.col(f"{OWN}cold") == F.col(f"{OWN}open")]
    both = dealt.join(named.withColumn(f"{OWN}open", F.lit(True)), same, "left")
    found = F.coalesce(f"{OWN}hot", f"{OWN}rest")
    kept = both if how == "left" else both.where(found.isNotNull())
    return kept.select(*[F.col(c) for c in rows.columns], *[found[c].alias(c) for c in rest])
