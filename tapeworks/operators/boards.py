"""Boards and their members: counts, memberships, rankings and searches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(boards: DataFrame, members: DataFrame) -> DataFrame:
    """boards with constituent_count: different open members, 0 without any."""
    n = members.where(F.col("out_date").isNull()).groupBy("ts_code").agg(F.count_distinct("con_code").alias("constituent_count"))
    return boards.join(n, "ts_code", "left").withColumn("constituent_count", F.coalesce("constituent_count", F.lit(0)).cast("long"))


def page(rows: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in order, each with the total."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total), F.lit(True))


def with_members(boards: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """boards with members: their first k codes in order, as text."""
    w = Window.partitionBy("ts_code").orderBy("con_code")
    first = members.where(F.col("out_date").isNull()).select("ts_code", "con_code").distinct().withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= k)
    lists = first.groupBy("ts_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "con_code"))), lambda x: x["con_code"].cast("string")), ",").alias("members"))
    return boards.join(lists, "ts_code", "left")


def memberships(providers: dict[str, DataFrame]) -> DataFrame:
    """provider, board, con_code of all providers' open members."""
    out = None
    for name, rows in providers.items():
        own = rows.select(F.lit(name).alias("provider"), F.col("ts_code").alias("board"), "con_code")
        out = own if out is None else out.unionByName(own)
    return out


def board_counts(all_members: DataFrame, least: int = 1) -> DataFrame:
    """con_code, board_count: different boards (provider and code) of each stock, least or more."""
    return all_members.groupBy("con_code").agg(F.count_distinct(F.concat_ws(":", "provider", "board")).alias("board_count")).where(F.col("board_count") >= least)


def concepts(all_members: DataFrame, order: Sequence[str], each: int = 20, total: int = 8) -> DataFrame:
    """con_code, place, board: each stock's boards in the providers' order, each name once (where it is first), so many a provider and in all."""
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("provider"))
    own = Window.partitionBy("con_code", "provider").orderBy("board")
    first = all_members.withColumns({"_rank": rank, "_p": F.row_number().over(own)}).where(F.col("_p") <= each)
    once = first.groupBy("con_code", "board").agg(F.min(F.struct("_rank", "_p")).alias("_at"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("con_code").orderBy("_at", "board")))
    return placed.where(F.col("place") <= total).select("con_code", "place", "board")


def search(rows: DataFrame, columns: Sequence[str], text: str, code: str, limit: int) -> DataFrame:
    """Rows whose columns contain text in any case, the best first: equal to the code, code begins with it, a column begins with it, others; ties by code."""
    low = text.lower()
    has = F.lit(False)
    begins = F.lit(False)
    for c in columns:
        has |= F.lower(F.col(c).cast("string")).contains(low)
        begins |= F.lower(F.col(c).cast("string")).startswith(low)
    own = F.lower(F.col(code).cast("string"))
    score = F.when(own == low, 0).when(own.startswith(low), 1).when(begins, 2).otherwise(3)
    return rows.where(has).withColumn("score", score).orderBy("score", code).limit(limit)


def unique_match(rows: DataFrame, masters: DataFrame, name: str, code: str) -> DataFrame:
    """rows with a missing code filled by name where just one master row has that name."""
    single = masters.groupBy(name).agg(F.count("*").alias("_n"), F.first(code).alias("_code")).where("_n = 1").drop("_n")
    return rows.join(single, name, "left").withColumn(code, F.coalesce(F.col(code), F.col("_code"))).drop("_code")


def fall_back(masters: Sequence[DataFrame], code: str) -> DataFrame:
    """Of each code the row of the first master that has it."""
    out = None
    for i, rows in enumerate(masters):
        own = rows.withColumn("_rank", F.lit(i))
        out = own if out is None else out.unionByName(own)
    rest = [c for c in masters[0].columns if c != code]
    return out.groupBy(code).agg(F.min_by(F.struct(*rest), "_rank").alias("_r")).select(code, "_r.*")


def optional_filters(rows: DataFrame, **given: object) -> DataFrame:
    """rows that equal all given values; those that are None don't filter."""
    for name, value in given.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def name_chain(requests: DataFrame, masters: Mapping[str, DataFrame], code: str) -> DataFrame:
    """requests (code, security_type or null) with name: from the master of the asked type alone, or without one from the first master in order that has the code."""
    out = requests
    for kind, rows in masters.items():
        out = out.join(rows.select(F.col(code), F.col("name").alias(f"_{kind}")).dropDuplicates([code]), code, "left")
    asked = F.col("security_type")
    return out.select(*requests.columns, F.coalesce(*[F.when(asked.isNull() | (asked == kind), F.col(f"_{kind}")) for kind in masters]).alias("name"))


def active_masters(rows: DataFrame, fund: bool = False) -> DataFrame:
    """Rows of instruments that are listed, delisted or suspended (list_status L, D or P): equities, or funds without those traded off the exchange (.OF)."""
    known = rows.where(F.col("list_status").isin("L", "P", "D"))
    return known.where(~F.col("ts_code").cast("string").like("%.OF")) if fund else known.where(F.col("security_type") == "EQUITY")


def open_days(rows: DataFrame, calendar: DataFrame, first: DataFrame, start: str, end: str) -> DataFrame:
    """rows on open days from start, but not before the first available day (a row of first), to end."""
    clipped = rows.join(F.broadcast(first.select(F.col(first.columns[0]).alias("_first"))), F.col("trade_date") >= F.greatest("_first", F.to_date(F.lit(start)))).where(F.col("trade_date") <= F.to_date(F.lit(end)))
    return clipped.drop("_first").join(F.broadcast(calendar.where("is_open").select("trade_date")), "trade_date", "left_semi").select(*rows.columns)


def dates_in_all(calendar: DataFrame, tables: Sequence[DataFrame], last: int | None = None) -> DataFrame:
    """Open days of the calendar on which every table has rows; of them the last ones, if a number of days is given (0 or less: all)."""
    out = calendar.where("is_open").select("trade_date")
    for rows in tables:
        out = out.join(rows.select("trade_date").distinct(), "trade_date", "left_semi")
    return out.orderBy(F.desc("trade_date")).limit(last) if last and last > 0 else out


def latest_sets(rows: DataFrame, index: str, date: str, at: str) -> DataFrame:
    """The rows of each index on its own last date up to at: one exchange by index."""
    last = F.max(date).over(Window.partitionBy(index))
    return rows.where(F.col(date) <= at).withColumn("_last", last).where(F.col(date) == F.col("_last")).drop("_last")


def latest_open_day(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """trade_date, latest_open: for each of days the last open day up to it; days before the first open one are left out."""
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)  # one row a calendar day
    known = calendar.select("trade_date", F.last(F.when(F.col("is_open"), F.col("trade_date")), ignorenulls=True).over(w).alias("latest_open"))
    return days.join(F.broadcast(known), "trade_date").where("latest_open is not null")
