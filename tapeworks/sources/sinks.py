"""Writing tables: dynamic partition overwrite, guarded publishing, full copies, and upserts of the parts that arrivals touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.operators.upsert import replace_dates, upsert
from tapeworks.sources.tables import Refused, Table

__all__ = ["Refused", "copy_table", "publish", "replace_dates_in", "upsert_into", "write_partitions"]


def write_partitions(df: DataFrame, path: str, by: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Overwrites the partitions that df has, and no others; rows sorted within files so that row groups can be skipped."""
    rows = df.repartition(*by) if not sort else df.repartition(*by).sortWithinPartitions(*by, *sort)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish(df: DataFrame, table: Table, dry_run: bool = False) -> int:
    """Makes df the table, unless df is empty; a dry run counts only. Returns the rows, which are counted as they are written."""
    return table.replace(df, dry_run=dry_run)


def copy_table(source: DataFrame, table: Table) -> int:
    """Replaces the table by source, empty or not, if their columns and types are the same."""
    if [(f.name, f.dataType) for f in source.schema] != [(f.name, f.dataType) for f in table.schema]:
        raise Refused("the schemas differ")
    return table.replace(source, allow_empty=True)


def upsert_into(table: Table, rows: DataFrame, keys: Sequence[str], sequence: Sequence[Column | str], created: str = "created_at", updated: str = "updated_at", now: Column | None = None, batch: int | None = None) -> list[str]:
    """upsert() of rows, written to the parts that they touch: new keys get both times, known keys keep when they were created, and keys that rows don't have keep both. Rows with a
    null in their key are left out. The table's label must follow from the key."""
    now = F.current_timestamp() if now is None else now
    whole = rows.dropna(subset=list(keys)).withColumns({created: now, updated: now})
    return table.change(whole, lambda old, new: upsert(old, new, keys, sequence, keep_old=[created]), batch)


def replace_dates_in(table: Table, rows: DataFrame, date: str) -> list[str]:
    """Puts rows, repeated ones too, in place of the dates that they have. The table's label must follow from the date."""
    return table.change(rows, lambda old, new: replace_dates(old, new, date))
