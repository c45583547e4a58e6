"""Queries over ingestion and column functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tapeworks.functions import scalars as fn
from tapeworks.lineage import shared_dir
from tapeworks.operators import upsert
from tapeworks.plans.registry import query
from tapeworks.sources import ingest
from tapeworks.sources.tables import Table

_CODE = "CASE WHEN ts_code % 7 = 0 THEN lpad(CAST(ts_code AS VARCHAR), 6, '6') WHEN ts_code % 7 = 1 THEN lpad(CAST(ts_code AS VARCHAR), 6, '9') WHEN ts_code % 7 = 2 THEN lpad(CAST(ts_code AS VARCHAR), 6, '8') WHEN ts_code % 7 = 3 THEN 'x' || CAST(ts_code AS VARCHAR) || '.hk' ELSE lpad(CAST(ts_code AS VARCHAR), 6, '0') END"


def coded(m):
    code = F.col("ts_code").cast("string")
    pad = lambda c: F.lpad(code, 6, c)
    text = F.when(F.col("ts_code") % 7 == 0, pad("6")).when(F.col("ts_code") % 7 == 1, pad("9")).when(F.col("ts_code") % 7 == 2, pad("8")).when(F.col("ts_code") % 7 == 3, F.concat(F.lit("x"), code, F.lit(".hk"))).otherwise(pad("0"))
    return m.tick.select("ts_code", "trade_date", text.alias("raw")).distinct()


_CODED = f"(SELECT DISTINCT ts_code, trade_date, {_CODE} AS raw FROM tick)"
_MARKET = "CASE WHEN contains(upper(raw), '.') THEN upper(raw) WHEN length(raw) = 6 THEN upper(raw) || CASE WHEN raw[1] IN ({sh}) THEN '.SH' WHEN raw[1] IN ('4', '8') THEN '.BJ' ELSE '.SZ' END ELSE upper(raw) END"


@query("sc1_market_code", f"SELECT ts_code, trade_date, {_MARKET.format(sh=chr(39) + '6' + chr(39) + ', ' + chr(39) + '9' + chr(39))} AS code FROM {_CODED}")
def sc1(m):
    return coded(m).select("ts_code", "trade_date", fn.market_code(F.col("raw"), required=True).alias("code"))


@query("sc2_market_code_digits", f"SELECT ts_code, trade_date, {_MARKET.format(sh=chr(39) + '6' + chr(39))} AS code FROM {_CODED}")
def sc2(m):
    return coded(m).select("ts_code", "trade_date", fn.market_code(F.col("raw"), shanghai="6", digits_only=True).alias("code"))


@query("sc3_split_code", "SELECT c_custkey, split_part(x, '.', 1) AS symbol, split_part(x, '.', 2) AS market FROM (SELECT c_custkey, c_custkey || '.' || c_mktsegment AS x FROM customer)")
def sc3(m):
    symbol, market = fn.split_code(F.concat_ws(".", F.col("c_custkey").cast("string"), "c_mktsegment"))
    return m.table("customer").select("c_custkey", symbol.alias("symbol"), market.alias("market"))


_SPACED = "CASE WHEN ts_code % 19 <> 0 THEN name || CASE ts_code % 3 WHEN 0 THEN chr(12288) WHEN 1 THEN chr(160) ELSE chr(9) || ' ' END || area END"


@query("sc4_plain_names", f"SELECT ts_code, coalesce(regexp_replace({_SPACED}, '[\\s\\x{{A0}}\\x{{3000}}]+', '', 'g'), '') AS name, CASE WHEN ts_code % 23 = 0 THEN '' ELSE CASE exchange WHEN 'SSE' THEN 'SH' WHEN 'SZSE' THEN 'SZ' WHEN 'BSE' THEN 'BJ' ELSE exchange END END AS exchange FROM security")
def sc4(m):
    c = F.col("ts_code")
    gap = F.when(c % 3 == 0, "\u3000").when(c % 3 == 1, "\u00a0").otherwise("\t ")
    return m.security.select("ts_code", fn.plain_name(F.when(c % 19 != 0, F.concat("name", gap, "area"))).alias("name"), fn.exchange_code(F.when(c % 23 != 0, F.concat(F.lower("exchange"), F.lit(" ")))).alias("exchange"))


@query("sc5_plain_reason")
def sc5(m):
    """Whole texts of documents, as full-width text every third time."""
    wide = F.translate("text", "abcdefghij,", "ａｂｃｄｅｆｇｈｉｊ，")
    reason = F.when(F.col("doc_id") % 3 == 0, wide).otherwise(F.col("text"))
    return m.table("documents").select("doc_id", fn.plain_reason(reason).alias("reason"))


@query("sc7_reason_hash")
def sc7(m):
    return m.table("documents").select("doc_id", fn.reason_hash(F.col("text")).alias("reason_hash"))


@query("rc6_reason_hash_backfill")
def rc6(m):
    """Hashes for documents that lack one (two of three), keyed by language and source: those whose hash another document of the key has are conflicts, and the others
    are then refused."""
    rows = m.table("documents").select("doc_id", "lang", "source", fn.reason_hash(F.col("text")).alias("hash"))
    stored = rows.withColumn("stored", F.when(F.col("doc_id") % 3 == 0, F.col("hash")))
    return upsert.backfill_reason_hash(stored, ["lang", "source"], "doc_id", "hash", "stored")[0]


@query("rc6_backfill_counts")
def rc6_counts(m):
    """The counts of a backfill keyed by document, in which nothing conflicts."""
    rows = m.table("documents").select("doc_id", fn.reason_hash(F.col("text")).alias("hash"))
    stored = rows.withColumn("stored", F.when(F.col("doc_id") % 3 == 0, F.col("hash")))
    return upsert.backfill_reason_hash(stored, ["doc_id"], "doc_id", "hash", "stored")[1]


_HASH = "sha256(concat_ws('|', CAST(ts_code AS VARCHAR), CAST(trade_date AS VARCHAR), CAST(px AS VARCHAR), coalesce(CAST(nullif(vol, 7.0000) AS VARCHAR), '')))"


def hashed(m):
    return m.tick.select("l_orderkey", "l_linenumber", "l_partkey", "ts_code", "trade_date", fn.content_hash([F.col("ts_code"), F.col("trade_date"), F.col("px"), F.nullif("vol", F.lit(7).cast("decimal(20,4)"))]).alias("row_hash"))


@query("sc6_content_hash", f"SELECT l_orderkey, l_linenumber, l_partkey, {_HASH} AS row_hash FROM tick")
def sc6(m):
    return hashed(m).select("l_orderkey", "l_linenumber", "l_partkey", "row_hash")


@query("snk4_upsert_by_hash", f"SELECT {_HASH} AS row_hash, max(l_orderkey) AS l_orderkey FROM tick GROUP BY 1")
def snk4(m):
    return upsert.keep_one(hashed(m), ["row_hash"], [F.desc("l_orderkey"), F.desc("l_linenumber")]).select("row_hash", "l_orderkey")


@query("rc5_hash_backfill", f"SELECT l_orderkey * 10 + l_linenumber AS id FROM (SELECT *, row_number() OVER (PARTITION BY {_HASH} ORDER BY l_orderkey * 10 + l_linenumber DESC) AS p FROM tick) WHERE p > 1")
def rc5(m):
    rows = hashed(m).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "row_hash")
    return upsert.backfill_hash(rows, "row_hash", "id")[1]


@query("sc8_round_half_up", "SELECT l_orderkey, l_linenumber, l_partkey, px, CAST(round(px / 8, 4) AS DECIMAL(18,4)) AS up FROM tick")
def sc8(m):
    return m.tick.select("l_orderkey", "l_linenumber", "l_partkey", "px", fn.half_up(F.col("px").cast("double") / 8).cast("decimal(18,4)").alias("up"))


_HALF_EVEN = """SELECT *, CAST(sign(n) * (q + CASE WHEN 2 * (abs(n) - q * d) > d OR (2 * (abs(n) - q * d) = d AND q % 2 = 1) THEN 1 ELSE 0 END) AS DECIMAL(30,4)) / 10000 AS price FROM (SELECT *, abs(n) // d AS q FROM (
  SELECT ts_code, trade_date, CAST(CAST(close * 10000 AS DECIMAL(22,0)) AS HUGEINT) * CAST(adj_factor * 100000000 AS HUGEINT) AS n, CAST(arg_max(adj_factor, trade_date) OVER (PARTITION BY ts_code) * 100000000 AS HUGEINT) AS d FROM panel_bar JOIN adj_factor USING (ts_code, trade_date)))"""


@query("sc9_round_half_even", f"SELECT ts_code, trade_date, CAST(price AS DECIMAL(18,4)) AS qfq FROM ({_HALF_EVEN})")
def sc9(m):
    """Forward-adjusted closes in decimals."""
    from tapeworks.operators import bars

    joined = m.panel_bar.join(m.adj_factor, ["ts_code", "trade_date"]).join(bars.anchors(m.adj_factor, True), "ts_code")
    return joined.select("ts_code", "trade_date", bars.scaled_price(F.col("close"), F.col("adj_factor"), F.col("anchor")).alias("qfq"))


@query("sc10_period_start", "SELECT CAST(date_trunc('week', trade_date) AS DATE) AS period, min(trade_date) AS period_start FROM trade_calendar WHERE is_open GROUP BY 1")
def sc10(m):
    from tapeworks.operators import bars

    return bars.period_starts(m.trade_calendar, "week")


@query("sc11_period_ends", "SELECT CAST(date_trunc('month', trade_date) AS DATE) AS period, max(trade_date) AS last_open, CAST(last_day(min(trade_date)) AS DATE) AS natural_end FROM trade_calendar WHERE is_open GROUP BY 1")
def sc11(m):
    days = m.trade_calendar.where("is_open").withColumn("period", F.trunc("trade_date", "month"))
    return days.groupBy("period").agg(F.max("trade_date").alias("last_open"), F.last_day(F.min("trade_date")).alias("natural_end"))


@query("sc12_months", "SELECT ts_code, strftime(unnest(generate_series(date_trunc('month', min(trade_date)), date_trunc('month', max(trade_date)), INTERVAL 1 MONTH)), '%Y%m') AS month FROM tick GROUP BY ts_code")
def sc12(m):
    ends = m.tick.groupBy("ts_code").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    return ends.select("ts_code", F.explode(fn.months_of(F.col("a"), F.col("b"))).alias("month"))


@query(
    "sc13_date_windows",
    "SELECT ts_code, CAST(s AS DATE) AS window_start, least(CAST(s AS DATE) + 99, b) AS window_end FROM (SELECT ts_code, b, unnest(generate_series(a, b, INTERVAL 100 DAY)) AS s FROM (SELECT ts_code, min(trade_date) AS a, max(trade_date) AS b FROM tick GROUP BY ts_code))",
)
def sc13(m):
    ends = m.tick.groupBy("ts_code").agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b"))
    return ends.select("ts_code", F.explode(fn.windows_of(F.col("a"), F.col("b"), 100)).alias("w")).select("ts_code", "w.*")


@query("sc14_normalise", "SELECT c_custkey, round(least(greatest((c_acctbal - 0) / 5000, 0.0), 1.0), 8) AS n_pos, round(1 - least(greatest((c_acctbal - 0) / 5000, 0.0), 1.0), 8) + 0.0 AS n_neg FROM customer")
def sc14(m):
    from tapeworks.operators import walkforward

    n = walkforward.n_pos(F.col("c_acctbal"), 0, 5000)
    return m.table("customer").select("c_custkey", F.round(n, 8).alias("n_pos"), F.round(1 - n, 8).alias("n_neg"))


@query("sc15_buckets", "SELECT c_custkey, CASE WHEN c_acctbal < 2000 THEN 'low' WHEN c_acctbal < 6000 THEN 'mid' ELSE 'high' END AS bucket, CASE WHEN c_acctbal > 1e-6 THEN 1 WHEN c_acctbal < -1e-6 THEN -1 ELSE 0 END AS sign FROM customer")
def sc15(m):
    from tapeworks.operators import walkforward

    return m.table("customer").select("c_custkey", walkforward.bucket("c_acctbal", 2000, 6000).alias("bucket"), walkforward.sign("c_acctbal").alias("sign"))


@query("sc16_local_day", "SELECT DISTINCT trade_date, CAST(trade_date AS TIMESTAMP) - INTERVAL 8 HOUR AS starts, CAST(trade_date AS TIMESTAMP) + INTERVAL 16 HOUR AS ends FROM tick")
def sc16(m):
    start, end = fn.local_day_range(F.col("trade_date"))
    return m.tick.select("trade_date", start.cast("timestamp_ntz").alias("starts"), end.cast("timestamp_ntz").alias("ends")).distinct()


@query("sc17_typed_json", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events")
def sc17(m):
    return m.table("events").select("event_id", F.from_json("props", "struct<k:int>")["k"].alias("k"))


_MESSAGE = "'run ' || event_id || CASE WHEN event_id % 3 = 0 THEN '; data_quality_warning: ' || event_type || '   ' || user_id WHEN event_id % 3 = 1 THEN '; connection   lost after ' || repeat('x ', CAST(event_id % 90 AS INTEGER)) ELSE '; request timed out' END"


def messages(m):
    rest = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("; data_quality_warning: "), "event_type", F.lit("   "), F.col("user_id").cast("string")))
    rest = rest.when(F.col("event_id") % 3 == 1, F.concat(F.lit("; connection   lost after "), F.repeat(F.lit("x "), (F.col("event_id") % 90).cast("int")))).otherwise("; request timed out")
    return m.table("events").select("event_id", F.concat(F.lit("run "), F.col("event_id").cast("string"), rest).alias("message"))


@query("sc18_tagged_message", f"SELECT event_id, list_filter(list_transform(string_split({_MESSAGE}, ';'), lambda x: trim(x)), lambda x: starts_with(x, 'data_quality_warning:'))[1] AS warning FROM events")
def sc18(m):
    return messages(m).select("event_id", fn.tagged_part(F.col("message")).alias("warning"))


_FAILURE = """CASE event_id % 6 WHEN 0 THEN 'ERROR:  column "' || event_type || '" of relation "t' || user_id || '" does not exist' WHEN 1 THEN 'Null value in column "c' || user_id || '" of relation "' || event_type || '" violates not-null constraint'
  WHEN 2 THEN 'there is no unique or   exclusion constraint matching the ON CONFLICT specification' WHEN 3 THEN 'Tushare API error: code ' || user_id WHEN 4 THEN 'lost  after ' || repeat('x ', CAST(event_id % 90 AS INTEGER)) ELSE '' END"""


def failures(m):
    text = F.expr("""CASE event_id % 6 WHEN 0 THEN 'ERROR:  column "' || event_type || '" of relation "t' || user_id || '" does not exist' WHEN 1 THEN 'Null value in column "c' || user_id || '" of relation "' || event_type || '" violates not-null constraint'
  WHEN 2 THEN 'there is no unique or   exclusion constraint matching the ON CONFLICT specification' WHEN 3 THEN 'Tushare API error: code ' || user_id WHEN 4 THEN 'lost  after ' || repeat('x ', CAST(event_id % 90 AS INTEGER)) ELSE '' END""")
    return m.table("events").select("event_id", text.alias("message"))


@query(
    "sc19_error_kind",
    f"""SELECT event_id, CASE WHEN m = '' THEN NULL WHEN event_id % 6 = 0 THEN '数据库字段缺失：表 t' || user_id || ' 缺少列 ' || event_type WHEN event_id % 6 = 1 THEN '数据库约束错误：表 ' || event_type || ' 的列 c' || user_id || ' 不能为空'
    WHEN event_id % 6 = 2 THEN '数据库约束错误：缺少可用于 ON CONFLICT 的唯一约束' WHEN event_id % 6 = 3 THEN 'Tushare 接口错误：code ' || user_id WHEN length(p) > 120 THEN left(p, 120) || '...' ELSE p END AS summary
    FROM (SELECT *, trim(regexp_replace(m, '\\s+', ' ', 'g')) AS p FROM (SELECT *, {_FAILURE} AS m FROM events))""",
)
def sc19(m):
    return failures(m).select("event_id", fn.failure_summary(F.col("message")).alias("summary"))


@query("sc20_clipped", f"SELECT event_id, CASE WHEN length(m) > 60 THEN left(m, 60 - length('{fn.CUT_SUFFIX}')) || '{fn.CUT_SUFFIX}' ELSE m END AS message, '' AS none FROM (SELECT event_id, {_MESSAGE} AS m FROM events)")
def sc20(m):
    return messages(m).select("event_id", fn.clipped(F.col("message"), 60).alias("message"), fn.clipped(F.col("message"), 0).alias("none"))


@query("sc21_freshness", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('day', ts) WHEN event_id % 3 = 1 THEN date_trunc('second', ts) END AS fresh FROM events")
def sc21(m):
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("soon")
    return m.table("events").select("event_id", fn.freshness(text).cast("timestamp_ntz").alias("fresh"))


@query("flt7_time_window", "SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') >= '22:00:00' OR strftime(ts, '%H:%M:%S') <= '02:30:00'")
def flt7(m):
    return m.table("events").where(fn.in_time_window(F.col("ts"), "22:00:00", "02:30:00")).select("event_id")


@query("ag7_null_aware_sum", "SELECT ts_code, trade_date, CASE WHEN coalesce(buy_sm_amount, buy_md_amount, buy_lg_amount) IS NOT NULL THEN coalesce(buy_sm_amount, 0) + coalesce(buy_md_amount, 0) + coalesce(buy_lg_amount, 0) END AS total FROM moneyflow_a")
def ag7(m):
    return m.moneyflow_a.select("ts_code", "trade_date", fn.null_aware_sum([F.col(f"buy_{t}_amount") for t in ("sm", "md", "lg")]).alias("total"))


@query("src2_envelope", "SELECT CAST(ts_code AS VARCHAR) AS code, strftime(trade_date, '%Y%m%d') AS day, CAST(close AS VARCHAR) AS close, NULL AS missing FROM panel_bar")
def src2(m):
    item = F.array(F.col("close").cast("string"), F.col("ts_code").cast("string"), F.date_format("trade_date", "yyyyMMdd"))
    landed = m.panel_bar.groupBy("trade_date").agg(F.to_json(F.struct(F.array(F.lit("close"), F.lit("code"), F.lit("day")).alias("fields"), F.collect_list(item).alias("items"))).alias("payload"))
    return ingest.decode_envelope(landed, "payload", ["code", "day", "close", "missing"])


@query("src3_json_list", "SELECT ts_code AS code, CAST(close AS DOUBLE) AS close FROM panel_bar WHERE ts_code % 10 <> 3")
def src3(m):
    rows = F.to_json(F.collect_list(F.struct(F.col("ts_code").alias("code"), F.col("close").cast("double").alias("close"))))
    landed = m.panel_bar.groupBy("ts_code").agg(rows.alias("rows"))
    payload = F.when(F.col("ts_code") % 10 == 3, F.lit('{"error": "no data"}')).otherwise(F.concat(F.lit('["x",'), F.substring("rows", 2, 1 << 30)))
    return ingest.decode_list(landed.select(payload.alias("payload")), "payload", "code long, close double")


@query("src4_coercion", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 <> 0 THEN trade_date END AS day, CASE WHEN l_linenumber % 5 <> 0 THEN px END AS px FROM tick")
def src4(m):
    day = F.when(F.col("l_linenumber") % 4 == 0, "").when(F.col("l_linenumber") % 2 == 0, F.date_format("trade_date", "yyyyMMdd")).otherwise(F.date_format("trade_date", "yyyy-MM-dd"))
    px = F.when(F.col("l_linenumber") % 5 == 0, " ").otherwise(F.col("px").cast("string"))
    return ingest.coerce(m.tick.select("l_orderkey", "l_linenumber", "l_partkey", day.alias("day"), px.alias("px")), {"day": "date", "px": "decimal(18,4)"})


@query("src5_raw_rows", "SELECT s_suppkey, s_name, CAST(s_suppkey AS VARCHAR) AS raw_key, s_name AS raw_name FROM supplier")
def src5(m):
    rows = ingest.with_raw(m.table("supplier").select("s_suppkey", "s_name"))
    return rows.select("s_suppkey", "s_name", F.get_json_object("raw_payload", "$.s_suppkey").alias("raw_key"), F.get_json_object("raw_payload", "$.s_name").alias("raw_name"))


@query("map1_rule_projection", "SELECT CAST(s_suppkey AS VARCHAR) AS code, CAST(s_acctbal AS DECIMAL(18,4)) AS balance, s_name AS name, CAST(NULL AS DATE) AS listed FROM supplier")
def map1(m):
    rules = m.spark.createDataFrame([("s_suppkey", "code", "string"), ("s_acctbal", "balance", "decimal(18,4)"), ("s_name", "name", "string"), ("s_listed", "listed", "date")], "src_field string, std_field string, std_type string")
    return ingest.map_columns(m.table("supplier"), rules)


@query(
    "map1_active_rules",
    """SELECT 'basic' AS dataset, 'a' AS source, CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, CAST(s_acctbal AS DECIMAL(18,4)) AS balance, CAST(NULL AS DATE) AS listed FROM supplier
    UNION ALL SELECT 'basic', 'b', CAST(c_custkey AS VARCHAR), c_name, NULL, NULL FROM customer UNION ALL SELECT 'parts', 'a', CAST(p_partkey AS VARCHAR), NULL, NULL, NULL FROM part""",
)
def map1_active(m):
    rules = [
        ("basic", "a", "s_suppkey", "code", "string", "active"), ("basic", "a", "s_name", "name", "string", "active"), ("basic", "a", "s_acctbal", "balance", "decimal(18,4)", "active"),
        ("basic", "a", "s_listed", "listed", "date", "active"), ("basic", "a", "s_phone", "phone", "string", "inactive"), ("basic", "b", "c_custkey", "code", "string", "active"),
        ("basic", "b", "c_name", "name", "string", "active"), ("basic", "b", "c_acctbal", "balance", "decimal(18,4)", "disabled"), ("parts", "a", "p_partkey", "code", "string", "active"), ("parts", "b", "p_name", "label", "string", "active"),
    ]
    frames = {("basic", "a"): m.table("supplier"), ("basic", "b"): m.table("customer"), ("parts", "a"): m.table("part"), ("orders", "a"): m.table("orders")}
    return ingest.map_by_rules(frames, m.spark.createDataFrame(rules, ingest.RULES))


@query("src2_landed_files", "SELECT CAST(ts_code AS VARCHAR) AS code, strftime(trade_date, '%Y%m%d') AS day, CAST(close AS VARCHAR) AS close, (SELECT count(*) FROM calendar WHERE n % 25 = 0) AS n_broken FROM panel_bar JOIN calendar USING (trade_date) WHERE n % 25 <> 0")
def src2_landed(m):
    """A file for each day in a landing folder; every 25th is cut off in the middle."""
    item = F.array(F.col("close").cast("string"), F.col("ts_code").cast("string"), F.date_format("trade_date", "yyyyMMdd"))
    days = m.panel_bar.groupBy("trade_date").agg(F.to_json(F.struct(F.array(F.lit("close"), F.lit("code"), F.lit("day")).alias("fields"), F.collect_list(item).alias("items"))).alias("payload")).join(F.broadcast(m.calendar), "trade_date")
    value = F.when(F.col("n") % 25 == 0, F.expr("left(payload, length(payload) - 9)")).otherwise(F.col("payload"))
    folder = f"{shared_dir(m.spark)}/landed-{uuid.uuid4().hex}"
    days.select(value.alias("value")).write.text(folder)
    whole, broken = ingest.quarantined(ingest.read_landed(m.spark, folder, lines=True))
    rows = ingest.decode_envelope(whole, "payload", ["code", "day", "close"])
    return rows.join(F.broadcast(broken.agg(F.count("*").alias("n_broken"))), F.lit(True))  # one row


@query("src3_landed_lists", "SELECT ts_code AS code, CAST(close AS DOUBLE) AS close, (SELECT count(DISTINCT ts_code) FROM panel_bar WHERE ts_code % 10 = 4) AS n_broken FROM panel_bar WHERE ts_code % 10 NOT IN (3, 4)")
def src3_landed(m):
    rows = F.to_json(F.collect_list(F.struct(F.col("ts_code").alias("code"), F.col("close").cast("double").alias("close"))))
    landed = m.panel_bar.groupBy("ts_code").agg(rows.alias("rows"))
    value = F.when(F.col("ts_code") % 10 == 3, '{"error": "no data"}').when(F.col("ts_code") % 10 == 4, F.concat(F.lit("["), F.substring("rows", 3, 1 << 30))).otherwise(F.concat(F.lit('["x",'), F.substring("rows", 2, 1 << 30)))
    folder = f"{shared_dir(m.spark)}/landed-{uuid.uuid4().hex}"
    landed.select(value.alias("value")).write.text(folder)
    whole, broken = ingest.quarantined(ingest.read_landed(m.spark, folder, lines=True))
    found = ingest.decode_list(whole, "payload", "code long, close double")
    return found.join(F.broadcast(broken.agg(F.count("*").alias("n_broken"))), F.lit(True))  # one row


@query("prj1_renames", "SELECT ts_code, trade_date, close - pre_close AS change_amount, close AS closing FROM panel_bar")
def prj1(m):
    return m.panel_bar.select("ts_code", "trade_date", (F.col("close") - F.col("pre_close")).alias("change"), F.col("close")).withColumnsRenamed({"change": "change_amount", "close": "closing"})


@query("prj2_calendar_shape", "SELECT trade_date, is_open FROM trade_calendar")
def prj2(m):
    raw = m.trade_calendar.select(F.col("trade_date").alias("cal_date"), F.col("is_open").cast("int").cast("string").alias("is_open"))
    return raw.select(F.col("cal_date").alias("trade_date"), F.col("is_open").cast("int").cast("boolean").alias("is_open"))


@query("prj3_conditional_fill", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'own' || s_suppkey END AS con_name FROM supplier")
def prj3(m):
    raw = m.table("supplier").withColumn("con_name", F.when(F.col("s_suppkey") % 6 == 0, "").when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("own"), F.col("s_suppkey").cast("string"))))
    return raw.select("s_suppkey", F.coalesce(F.nullif("con_name", F.lit("")), "s_name").alias("con_name"))


@query(
    "prj4_dividend_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 5 > 0 THEN CAST(o_orderdate AS DATE) + 1 WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) + 2 END AS ex_date,
    CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 5 > 0 THEN 'record_date' WHEN o_orderkey % 7 > 0 THEN 'pay_date' END AS filled, count(*) FILTER (WHERE o_orderkey % 2 <> 0 AND o_orderkey % 5 > 0) OVER () AS by_record_date,
    count(*) FILTER (WHERE o_orderkey % 2 <> 0 AND o_orderkey % 5 = 0 AND o_orderkey % 7 > 0) OVER () AS by_pay_date FROM orders""",
)
def prj4(m):
    day = F.to_date("o_orderdate")
    raw = m.table("orders").select(
        "o_orderkey", F.lit("实施").alias("div_proc"), F.when(F.col("o_orderkey") % 2 == 0, day).alias("ex_date"), F.date_add(day, 1).alias("record_date"), F.date_add(day, 2).alias("pay_date"),
        (F.col("o_orderkey") % 5).alias("stk_div"), (F.col("o_orderkey") % 7).alias("cash_div"),
    )
    seen = Observation()
    rows = ingest.fill_dividend_dates(raw, seen).select("o_orderkey", "ex_date", "filled")
    table = Table(m.spark, f"{shared_dir(m.spark)}/dividend-{uuid.uuid4().hex}", rows.schema)
    table.replace(rows)
    return table.read().withColumns({c: F.lit(n).cast("long") for c, n in seen.get.items()})


@query("prj5_required_keys", "SELECT l_orderkey, l_linenumber, px, (SELECT count(*) FROM tick WHERE l_linenumber = 3) AS skipped FROM tick WHERE l_linenumber <> 3")
def prj5(m):
    rows = m.tick.select("l_orderkey", F.nullif("l_linenumber", F.lit(3)).alias("l_linenumber"), "px")
    seen = Observation()
    table = Table(m.spark, f"{shared_dir(m.spark)}/core-{uuid.uuid4().hex}", rows.schema)
    table.replace(ingest.split_required(rows, ["l_orderkey", "l_linenumber"], seen))
    return table.read().withColumn("skipped", F.lit(seen.get["skipped"]).cast("long"))


@query("prj6_request_tags", "SELECT ts_code, name, '__ALL__' AS query_market, coalesce(nullif(exchange, 'BSE'), '__ALL__') AS content_type FROM security")
def prj6(m):
    asked = F.lit(None).cast("string")
    return m.security.select("ts_code", "name", F.coalesce(asked, F.lit("__ALL__")).alias("query_market"), F.coalesce(F.nullif("exchange", F.lit("BSE")), F.lit("__ALL__")).alias("content_type"))


@query("prj7_default_partition", "SELECT ts_code, CASE WHEN ts_code % 4 = 0 THEN area ELSE 'requested' END AS content_type FROM security")
def prj7(m):
    rows = m.security.withColumn("own", F.when(F.col("ts_code") % 4 == 0, F.col("area")))
    return rows.select("ts_code", F.coalesce("own", F.lit("requested")).alias("content_type"))


@query("prj8_first_existing", "SELECT ts_code, trade_date, CAST(vol AS DOUBLE) AS volume, CAST(NULL AS DOUBLE) AS turnover FROM panel_bar")
def prj8(m):
    rows = m.panel_bar
    return rows.select("ts_code", "trade_date", ingest.first_existing(rows, ["volume", "vol"], "double").alias("volume"), ingest.first_existing(rows, ["turnover", "turn"], "double").alias("turnover"))
