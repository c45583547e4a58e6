"""Queries that run a stream to its end, and those that write and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from tapeworks.lineage import shared_dir
from tapeworks.operators import upsert
from tapeworks.plans.registry import query
from tapeworks.sources import sinks
from tapeworks.sources.tables import Table, bucket_of
from tapeworks.streaming import jobs


def _folder(m, kind: str) -> str:
    return f"{shared_dir(m.spark)}/{kind}-{uuid.uuid4().hex}"


def _events(m):
    """The events as a stream; a file stream reads folders, or what a pattern matches."""
    return jobs.file_stream(m.spark, f"{m.sf_dir}/events.parque[t]", m.table("events").schema)


@query("ss1_incremental_upsert", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1, 2")
def ss1(m):
    return jobs.upsert_arrivals(_events(m), _folder(m, "ss1"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value", "ts")


_DAYS = "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY 1, 2 HAVING CAST(date_trunc('day', ts) AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND count(*) >= 60"


@query("ss2_probe", f"SELECT day, event_type, n, latest FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY n DESC, event_type) AS p FROM ({_DAYS})) WHERE p <= 2")
def ss2(m):
    return jobs.capped(jobs.probe(_events(m), _folder(m, "ss2"), "event_type", 60), "event_type", 2).withColumn("latest", F.col("latest").cast("timestamp_ntz"))


@query("ss3_running_ranges", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, max(ts) AS last_checked FROM events GROUP BY 1")
def ss3(m):
    return jobs.running_ranges(_events(m), _folder(m, "ss3"), "user_id")


@query("snk6_light_partitions", "SELECT ts_code, trade_date, CAST(CASE WHEN year(trade_date) = 1997 THEN close * 2 ELSE close END AS DOUBLE) AS close, year(trade_date) AS year FROM panel_bar")
def snk6(m):
    """Writes all years, then one of them anew; the others stay."""
    path = _folder(m, "light")
    rows = upsert.light(m.panel_bar, ["close"], ["ts_code", "trade_date"]).withColumn("year", F.year("trade_date"))
    sinks.write_partitions(rows, path, ["year"], ["ts_code", "trade_date"])
    sinks.write_partitions(rows.where("year = 1997").withColumn("close", F.col("close") * 2), path, ["year"], ["ts_code", "trade_date"])
    return m.spark.read.parquet(path).withColumn("year", F.col("year").cast("long"))


@query("snk8_full_copy", "SELECT ts_code, name, exchange FROM security")
def snk8(m):
    rows = m.security.select("ts_code", "name", "exchange")
    table = Table(m.spark, _folder(m, "copy"), rows.schema)
    sinks.copy_table(rows.where("ts_code % 2 = 0"), table)
    sinks.copy_table(rows, table)
    return table.read()


@query("snk9_snapshot_build", "SELECT ts_code, trade_date, close, name FROM panel_bar JOIN security USING (ts_code)")
def snk9(m):
    rows = m.panel_bar.select("ts_code", "trade_date", "close").join(m.security.select("ts_code", "name"), "ts_code")
    table = Table(m.spark, _folder(m, "snapshot"), rows.schema, F.year("trade_date"))
    sinks.publish(rows, table)
    return table.read()


@query("snk10_guarded_publish", "SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS published FROM supplier")
def snk10(m):
    rows = m.table("supplier").select("s_suppkey", "s_name")
    table = Table(m.spark, _folder(m, "publish"), rows.schema)
    n = sinks.publish(rows, table)
    return table.read().withColumn("published", F.lit(n).cast("long"))


_YEAR = lambda c: f"CAST(make_date(CAST({c} AS INTEGER), 1, 1) AS DATE)"


@query(
    "snk1_touched_parts",
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, year(trade_date) ORDER BY l_shipdate DESC, l_partkey DESC, ts_code DESC, vol DESC, amount DESC, px DESC) AS p FROM tick WHERE year(trade_date) IN (1996, 1997)),
    x AS (SELECT l_orderkey, l_linenumber, year(trade_date) AS y, px FROM t WHERE p = 1)
    SELECT l_orderkey, l_linenumber, arg_max(px, y) AS px, {_YEAR("min(y)")} AS created_at, {_YEAR("max(y)")} AS updated_at FROM x GROUP BY 1, 2""",
)
def snk1_touched(m):
    """Trades of one year, and those of the next put over them, by order and line."""
    keys = ["l_orderkey", "l_linenumber"]
    ticks = m.tick.select(*keys, "px", "trade_date", F.col("seq.l_shipdate").alias("l_shipdate"), "l_partkey", "ts_code", "vol", "amount")
    order = [F.desc(c) for c in ("l_shipdate", "l_partkey", "ts_code", "vol", "amount", "px")]
    schema = StructType([*ticks.select(*keys, "px").schema, StructField("created_at", DateType()), StructField("updated_at", DateType())])
    table = Table(m.spark, _folder(m, "upsert"), schema, bucket_of(keys, 8))
    for year in (1996, 1997):
        sinks.upsert_into(table, ticks.where(F.year("trade_date") == year), keys, order, now=F.make_date(F.lit(year), F.lit(1), F.lit(1)))
    return table.read()


@query(
    "snk3_replaced_parts",
    """WITH n AS (SELECT ts_code, trade_date, px, 1 AS batch FROM tick WHERE ts_code % 10 = 0 AND year(trade_date) = 1996) SELECT * FROM n
    UNION ALL SELECT ts_code, trade_date, px, 0 FROM tick WHERE ts_code % 10 <> 0 AND trade_date NOT IN (SELECT trade_date FROM n)""",
)
def snk3_replaced(m):
    """A table by year, in which the dates of one year are put in anew."""
    rows = m.tick.select("ts_code", "trade_date", "px", F.when(F.col("ts_code") % 10 == 0, 1).otherwise(0).alias("batch"))
    table = Table(m.spark, _folder(m, "dates"), rows.schema, F.year("trade_date"))
    table.replace(rows.where("batch = 0"))
    sinks.replace_dates_in(table, rows.where("batch = 1 AND year(trade_date) = 1996"), "trade_date")
    return table.read()


@query(
    "ss1_publish",
    """WITH s AS (SELECT user_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'a' ELSE 'b' END AS source, value, ts, event_id FROM events),
    l AS (SELECT user_id, source, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM s GROUP BY 1, 2)
    SELECT user_id, arg_min(source, source) AS source, arg_min(value, source) AS value, arg_min(ts, source) AS ts, string_agg(source, ',' ORDER BY source) AS source_candidates FROM l GROUP BY 1""",
)
def ss1_publish(m):
    source = F.when(F.col("event_type").isin("click", "purchase"), "a").otherwise("b")
    stream = _events(m).select("user_id", source.alias("source"), "value", "ts", "event_id")
    return jobs.publish_arrivals(stream, _folder(m, "ss1p"), ["user_id"], ["ts", "event_id"], ["a", "b"]).drop("event_id")


_RULES = """SELECT n_nationkey AS rule_id, CASE n_nationkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'purchase' WHEN 3 THEN 'error' ELSE 'none' END AS dataset,
  n_nationkey % 3 = 0 AS by_rows, CASE WHEN n_nationkey % 4 = 0 THEN 1000000 WHEN n_nationkey % 4 = 1 THEN 2 END AS min_rows, n_nationkey % 7 = 6 AS closed FROM nation"""


@query(
    "ss2_probe_rules",
    f"""WITH r AS ({_RULES}), d AS (SELECT event_type AS dataset, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), o AS (SELECT dataset, max(day) AS latest_date, arg_max(n, day) AS rows_in FROM d GROUP BY 1),
    c AS (SELECT max(day) AS open FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type <> 'view'))
    SELECT rule_id, CASE WHEN by_rows THEN coalesce(rows_in >= coalesce(min_rows, 1), FALSE) ELSE coalesce(latest_date = open, FALSE) AND (min_rows IS NULL OR coalesce(rows_in >= min_rows, FALSE)) END AS matched,
    latest_date, rows_in FROM r LEFT JOIN o USING (dataset), c WHERE NOT closed""",
)
def ss2_rules(m):
    """Rules from the nations; a day is open if anything but views happened on it. Closed rules have a window that the last event's time isn't in."""
    k = F.col("n_nationkey")
    last = m.table("events").agg(F.max("ts").cast("timestamp").alias("last"))
    minute = lambda c, h: F.date_format(c + F.expr(f"interval {h} hours"), "HH:mm")
    nation = m.table("nation").join(F.broadcast(last), F.lit(True))
    rules = nation.select(
        k.cast("long").alias("rule_id"), F.element_at(F.array(*[F.lit(x) for x in ("click", "view", "purchase", "error", "none")]), (k % 5 + 1).cast("int")).alias("dataset"),
        F.when(k % 3 == 0, "raw_rows_min").otherwise("freshness_latest_open").alias("condition"), F.when(k % 4 == 0, 1000000).when(k % 4 == 1, 2).alias("min_rows"), F.lit("UTC").alias("timezone"),
        F.when(k % 7 == 6, minute(F.col("last"), 2)).alias("window_start"), F.when(k % 7 == 6, minute(F.col("last"), 3)).alias("window_end"), F.lit(60).alias("interval_s"), F.lit(1).alias("max_per_day"),
    )
    calendar = m.table("events").where("event_type != 'view'").select(F.to_date("ts").alias("trade_date"), F.lit(True).alias("is_open")).distinct()
    found = jobs.probe_rules(_events(m).select("event_type", "ts"), _folder(m, "ss2r"), rules, calendar, "event_type")
    return found.select("rule_id", "matched", "latest_date", "rows_in")
