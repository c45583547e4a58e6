"""Structured Streaming jobs over a folder in which files arrive, run until all that is there has been read.

Each job keeps a table (sources.tables) whose last version says which batch it holds, so a batch that runs again changes nothing, and a run without new files gives the table as it is.
What a job gives doesn't depend on how the files are dealt to batches, or on their order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeworks.operators.resolution import resolve, touched
from tapeworks.operators.upsert import keep_one
from tapeworks.sources.tables import Table, bucket_of

#: Parts of a job's table: a batch rewrites those that its keys fall in.
BUCKETS = 8


def file_stream(spark: SparkSession, path: str, schema, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def _drain(stream: DataFrame, state: str, each: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def _keyed(stream: DataFrame, folder: str, schema: StructType, keys: Sequence[str], buckets: int) -> Table:
    return Table(stream.sparkSession, folder, schema, bucket_of(keys, buckets))


def _newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that is last by order, then by all other columns, so that it doesn't matter which came first."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return keep_one(rows, keys, [F.desc(c) for c in (*order, *rest)])


def _with_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def upsert_arrivals(stream: DataFrame, folder: str, keys: Sequence[str], order: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Puts arriving rows over the table by key (the last row by order counts, stored or new) and returns the table. Rows with a null in their key are left out."""
    table = _keyed(stream, f"{folder}/table", stream.schema, keys, buckets)

    def each(rows: DataFrame, n: int) -> None:
        table.change(_with_keys(rows, keys), lambda old, new: _newest(old.unionByName(new), keys, order), n)
        table.vacuum()

    _drain(stream, f"{folder}/state", each)
    return table.read()


def publish_arrivals(stream: DataFrame, folder: str, keys: Sequence[str], order: Sequence[str], sources: Sequence[str], freshness: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Keeps the last row by order of each key and source, resolves anew those keys that a batch touches, puts them over the published table and returns it: columns of the stream (the
    resolved row's source) and source_candidates. The stream has a column source."""
    own = StructType([f for f in stream.schema])
    standard = _keyed(stream, f"{folder}/std", own, keys, buckets)
    published_type = resolve(stream.sparkSession.createDataFrame([], own), keys, sources, freshness).schema
    published = _keyed(stream, f"{folder}/published", published_type, keys, buckets)

    def each(rows: DataFrame, n: int) -> None:
        whole = _with_keys(rows, [*keys, "source"])
        parts = standard.change(whole, lambda old, new: _newest(old.unionByName(new), [*keys, "source"], order), n)
        changed = whole.select(*keys).distinct()
        # after a stop between the two writes the first is left out, and this one finds its rows there
        fresh = resolve(touched(standard.read(parts), changed, keys), keys, sources, freshness)
        published.change(changed, lambda old, new: old.join(new, list(keys), "left_anti").unionByName(fresh), n)
        standard.vacuum()
        published.vacuum()

    _drain(stream, f"{folder}/state", each)
    return published.read()


def running_ranges(stream: DataFrame, folder: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """key, first_seen, last_seen, last_checked of all rows so far."""

    def ranges(rows: DataFrame, first: str, last: str, checked: str) -> DataFrame:
        return rows.groupBy(key).agg(F.min(first).alias("first_seen"), F.max(last).alias("last_seen"), F.max(checked).alias("last_checked"))

    table = _keyed(stream, f"{folder}/table", ranges(stream, "ts", "ts", "ts").schema, [key], buckets)

    def each(rows: DataFrame, n: int) -> None:
        counted = ranges(rows.where(F.col(key).isNotNull()), "ts", "ts", "ts")
        table.change(counted, lambda old, new: ranges(old.unionByName(new), "first_seen", "last_seen", "last_checked"), n)
        table.vacuum()

    _drain(stream, f"{folder}/state", each)
    return table.read()


def _daily_counts(stream: DataFrame, folder: str, key: str) -> tuple[Table, Callable[[DataFrame, int], None]]:
    """A table of day, key, n, latest (the last time on that day), a part for each month, and what puts a batch of rows (key, ts) into it."""
    counted = lambda rows: rows.groupBy(F.to_date("ts").alias("day"), key).agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    table = Table(stream.sparkSession, folder, counted(stream).schema, F.date_format("day", "yyyy-MM"))

    def put(rows: DataFrame, n: int) -> None:
        merged = lambda old, new: old.unionByName(new).groupBy("day", key).agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))
        table.change(counted(rows), merged, n)
        table.vacuum()

    return table, put


def _timed(stream: DataFrame) -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts").isNotNull())


def probe(stream: DataFrame, folder: str, key: str, least: int, delay: str = "1 day") -> DataFrame:
    """day, key, n, latest: closed days on which a key had least rows or more. Running counts are merged batch by batch, so that every row counts
    in whatever file or batch it comes; a day is closed when the latest row of all lies the delay or more behind its end."""
    timed = _timed(stream)
    table, put = _daily_counts(timed, f"{folder}/table", key)
    _drain(timed, f"{folder}/state", put)
    days = table.read()
    closed = F.date_add("day", 1).cast("timestamp") <= F.col("newest") - F.expr(f"interval {delay}")
    found = days.join(F.broadcast(days.agg(F.max("latest").alias("newest"))), F.lit(True)).where(closed & (F.col("n") >= least))
    return found.select("day", key, "n", "latest")


def capped(matches: DataFrame, key: str, per_day: int) -> DataFrame:
    """The first per_day matches of each day, most rows first."""
    return matches.withColumn("_p", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("n"), key))).where(F.col("_p") <= per_day).drop("_p")


PROBES = "rule_id long, probed_at timestamp, local_day date, matched boolean, latest_date date, rows_in long"
#: The zone of a rule that names none.
ZONE = "Asia/Shanghai"
IDLE = ("outside_window", "too_soon", "daily_cap")


def due(rules: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """rules with local_day and skip: null if a rule is to be probed at now, else why not (IDLE). rules: rule_id, timezone, window_start and window_end (HH:mm or HH:mm:ss; null: open; a
    window may go over midnight), interval_s, max_per_day; log: PROBES."""
    last = log.groupBy("rule_id").agg(F.max("probed_at").alias("_last"))
    matched = log.where("matched").groupBy("rule_id", F.col("local_day").alias("_day")).agg(F.count("*").alias("_matches"))
    local = F.convert_timezone(F.current_timezone(), F.coalesce("timezone", F.lit(ZONE)), now.cast("timestamp_ntz"))
    # NTZ times of the session's zone: to_date and date_format take them as they stand
    rows = rules.withColumns({"_local": local}).withColumn("local_day", F.to_date("_local"))
    rows = rows.join(last, "rule_id", "left").join(matched.withColumnRenamed("rule_id", "_rule"), (F.col("_rule") == F.col("rule_id")) & (F.col("_day") == F.col("local_day")), "left")
    clock = F.date_format("_local", "HH:mm:ss.SSSSSS")
    # an end without seconds is that minute's first instant, as a time of day
    start, end = F.nullif("window_start", F.lit("")), F.nullif("window_end", F.lit(""))
    padded = lambda c: F.concat(F.rpad(c, 8, ":00"), F.lit(".000000"))
    start, end = F.coalesce(padded(start), F.lit("00:00:00.000000")), F.coalesce(padded(end), F.lit("23:59:59.999999"))
    inside = F.when(start <= end, (clock >= start) & (clock <= end)).otherwise((clock >= start) | (clock <= end))
    elapsed = F.unix_micros(now) - F.unix_micros("_last")
    soon = F.coalesce(elapsed < F.greatest("interval_s", F.lit(1)).cast("long") * 1_000_000, F.lit(False))
    full = F.coalesce("_matches", F.lit(0)) >= F.greatest("max_per_day", F.lit(1))
    skip = F.when(~inside, IDLE[0]).when(soon, IDLE[1]).when(full, IDLE[2])
    return rows.withColumn("skip", skip).drop("_local", "_last", "_rule", "_day", "_matches")


def evaluated(rules: DataFrame, observed: DataFrame, calendar: DataFrame, now: Column) -> DataFrame:
    """PROBES of due rules (see due) at now. rules: besides, dataset, condition and min_rows; ``raw_rows_min`` asks for min_rows rows (null: 1), any other condition for the latest open day
    (trade_date, is_open) up to the local day, and for min_rows rows too where they are given. observed: dataset, latest_date, rows_in."""
    days = rules.select("local_day").distinct()
    opened = days.join(calendar.where("is_open").select("trade_date"), F.col("trade_date") <= F.col("local_day"), "left").groupBy("local_day").agg(F.max("trade_date").alias("_open"))
    rows = rules.join(observed, "dataset", "left").join(F.broadcast(opened), "local_day")  # a row for each day that it is somewhere
    enough = F.coalesce(F.col("rows_in") >= F.coalesce("min_rows", F.lit(1)), F.lit(False))
    current = F.coalesce(F.col("latest_date") == F.col("_open"), F.lit(False))
    matched = F.when(F.col("condition") == "raw_rows_min", enough).otherwise(current & (F.col("min_rows").isNull() | enough))
    return rows.select("rule_id", now.alias("probed_at"), "local_day", matched.alias("matched"), "latest_date", F.col("rows_in").cast("long").alias("rows_in"))


def probe_rules(stream: DataFrame, folder: str, rules: DataFrame, calendar: DataFrame, key: str, clock: Callable[[int], object] | None = None) -> DataFrame:
    """PROBES of all batches: each batch is a tick, at which the rules that are due are held against what has arrived (see due and evaluated). A dataset's rows_in are those of its latest
    day. clock gives a batch's time; without it a batch is as late as the latest row so far. Which rules are due follows from the probes before, so state outlives a restart."""
    spark, timed = stream.sparkSession, _timed(stream)
    counts, put = _daily_counts(timed, f"{folder}/counts", key)
    log = Table(spark, f"{folder}/log", StructType.fromDDL(PROBES), F.date_format("local_day", "yyyy-MM"))

    def each(rows: DataFrame, n: int) -> None:
        put(rows, n)
        days = counts.read()
        observed = days.groupBy(F.col(key).alias("dataset")).agg(F.max("day").alias("latest_date"), F.max_by("n", "day").alias("rows_in"))
        at = clock(n) if clock else days.agg(F.max("latest")).first()[0]
        if at is None:
            return
        now = F.lit(at).cast("timestamp")
        found = evaluated(due(rules, log.read(), now).where("skip IS NULL"), observed, calendar, now)
        log.change(found, lambda old, new: old.unionByName(new), n)
        log.vacuum()

    _drain(timed, f"{folder}/state", each)
    return log.read()
