"""Writes as queries: upserts by key, replacement by date, merging of ranges, and the deduplication that they rest on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.lineage import cut

Order = Column | str


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Order]) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def last_n(df: DataFrame, keys: Sequence[str], by: str, n: int) -> DataFrame:
    """The last n rows of each key by a column."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc())
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place")


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The row of each key that is last by columns, picked before the exchange and after it."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def valid_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key columns are all there, and the others."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return df.where(whole), df.where(~whole)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], sequence: Sequence[Order], keep_old: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new put over it: unknown columns are dropped, rows with a null in their key too; of rows of new with one key that which is
    last by sequence counts; columns named in keep_old keep the old row's value where there is one."""
    columns = old.columns
    rows, _ = valid_keys(new, keys)
    last = keep_one(rows, keys, [F.desc(c) if isinstance(c, str) else c for c in sequence])
    incoming = last.select(*[F.col(c) if c in last.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in columns])
    both = old.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    merged = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_row"), *[F.min_by(c, "_new").alias(f"_old_{c}") for c in keep_old])
    return merged.select(*[F.col(c) if c in keys else F.col(f"_old_{c}").alias(c) if c in keep_old else F.col("_row")[c].alias(c) for c in columns])


def replace_dates(old: DataFrame, new: DataFrame, date: str) -> DataFrame:
    """old without the dates that new has, and all rows of new, repeated ones too."""
    return old.join(new.select(date).distinct(), date, "left_anti").unionByName(new)


def merge_ranges(old: DataFrame, new: DataFrame, keys: Sequence[str], first: str, last: str, checked: str) -> DataFrame:
    """Rows of (first, last, checked) for each key: the least first, the greatest last (nulls count as unknown), and the newest checked."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last), F.max_by(checked, F.struct("_new", checked)).alias(checked))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old, and those rows of new whose key old lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"))


#: Measures of the light form of daily bars, as doubles. Fixed names.
LIGHT = ("open", "high", "low", "close", "pre_close", "change_amount", "pct_chg", "vol", "amount")


def light(df: DataFrame, columns: Sequence[str] = LIGHT, keys: Sequence[str] = ("ts_code", "trade_date"), code: object = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """The narrow form of a wide table: its keys, measures as doubles, and source where there is one; of one code, or from a day, or to a day only if asked."""
    if code is not None:
        df = df.where(F.col(keys[0]) == code)
    if start is not None:
        df = df.where(F.col(keys[1]) >= start)
    if end is not None:
        df = df.where(F.col(keys[1]) <= end)
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns], *[c for c in ("source",) if c in df.columns])


def prefer(first: DataFrame, second: DataFrame, entity: Sequence[str]) -> DataFrame:
    """first, and second for the entities that first lacks."""
    return first.unionByName(second.join(first.select(*entity).distinct(), list(entity), "left_anti"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their number n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def backfill_hash(df: DataFrame, hashed: str, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows that stay (of each hash the highest id) and the ids that go."""
    w = Window.partitionBy(hashed).orderBy(F.col(id_column).desc())
    ranked = df.withColumn("_place", F.row_number().over(w))
    return ranked.where("_place = 1").drop("_place"), ranked.where("_place > 1").select(id_column)


def backfill_reason_hash(df: DataFrame, keys: Sequence[str], id_column: str, hashed: str, stored: str) -> tuple[DataFrame, DataFrame]:
    """Hashes for the rows that lack one (stored is null): id, hash and state; and a row of counts: scanned, updated, skipped (without a reason) and conflicts. A key and
    hash that several rows share is a conflict, and with any conflict nothing is updated."""
    df = cut(df)  # hashes are costly, and read three times below
    whole = df.where(F.col(hashed).isNotNull()).groupBy(*keys, hashed).agg(F.count("*").alias("_n"))
    conflicts = whole.agg(F.count_if(F.col("_n") > 1).alias("conflicts"))
    shared = whole.where("_n > 1").select(*[F.col(c).alias(f"_{c}") for c in (*keys, hashed)])
    open_ = df.where(F.col(stored).isNull()).join(shared, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, hashed)], "left").join(F.broadcast(conflicts), F.lit(True))
    state = F.when(F.col(hashed).isNull(), "skipped").when(F.col(f"_{hashed}").isNotNull(), "conflict").when(F.col("conflicts") > 0, "refused").otherwise("updated")
    rows = open_.select(id_column, hashed, state.alias("state"))
    counts = rows.agg(F.count("*").alias("scanned"), F.count_if(F.col("state") == "updated").alias("updated"), F.count_if(F.col("state") == "skipped").alias("skipped"))
    return rows, counts.join(F.broadcast(conflicts), F.lit(True))
