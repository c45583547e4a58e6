"""Queries over bars: sources and sinks, adjustment, period bars, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import bars, upsert
from tapeworks.plans.registry import query

_PERIOD = """
SELECT ts_code, CAST(date_trunc('{u}', trade_date) AS DATE) AS period, max(trade_date) AS trade_date, arg_min(open, trade_date) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, trade_date) AS close, first(pre_close ORDER BY trade_date) AS pre_close, CAST(sum(vol) AS DECIMAL(30,4)) AS vol, CAST(sum(amount) AS DECIMAL(30,4)) AS amount
FROM daily_bar GROUP BY 1, 2"""
_PCT = "round((CAST(close AS DOUBLE) / nullif(CAST(pre_close AS DOUBLE), 0) - 1) * 100, 4)"


def _period_sql(unit: str) -> str:
    return f"SELECT *, close - pre_close AS change_amount, {_PCT} AS pct_chg FROM ({_PERIOD.format(u=unit)})"


@query("bar4_weekly_bars", _period_sql("week"))
def weekly(m):
    return bars.period_bars(m.daily_bar, "week")


@query("bar4_monthly_bars", _period_sql("month"))
def monthly(m):
    return bars.period_bars(m.daily_bar, "month")


def _vendor(m):
    rows = bars.period_bars(m.daily_bar, "week").where("ts_code % 2 = 0")
    return rows.withColumn("pct_chg", F.round(F.col("pct_chg") + 0.0001, 4)).withColumn("source", F.lit("api"))


@query(
    "bar5_vendor_over_derived",
    f"""WITH w AS ({_period_sql("week")}), api AS (SELECT * REPLACE (round(pct_chg + 0.0001, 4) AS pct_chg), 'api' AS source FROM w WHERE ts_code % 2 = 0),
    der AS (SELECT *, 'derived_daily' AS source FROM w)
    SELECT * FROM api UNION ALL SELECT * FROM der d WHERE NOT EXISTS (SELECT 1 FROM api a WHERE a.ts_code = d.ts_code AND a.period = d.period)
    AND NOT EXISTS (SELECT 1 FROM api a WHERE a.ts_code = d.ts_code AND a.trade_date = d.trade_date)""",
)
def precedence(m):
    derived = bars.period_bars(m.daily_bar, "week").withColumn("source", F.lit("derived_daily"))
    return bars.with_precedence(_vendor(m), derived)


_SCALE = "CAST(adj_factor AS DOUBLE) / nullif(CAST(anchor AS DOUBLE), 0)"


def _adjusted_sql(pick: str) -> str:
    """Prices in whole numbers: the quotient, and one more if the remainder is over half, or half and the quotient odd."""
    p, f, e = "CAST({c} * 10000 AS HUGEINT)", "CAST(adj_factor * 100000000 AS HUGEINT)", "CAST(anchor * 100000000 AS HUGEINT)"
    q, r = f"((abs({p}) * {f}) // {e})", f"((abs({p}) * {f}) % {e})"
    price = f"CAST(sign({p}) * ({q} + CASE WHEN 2 * {r} > {e} OR (2 * {r} = {e} AND {q} % 2 = 1) THEN 1 ELSE 0 END) AS DECIMAL(22,4)) / 10000 AS {{c}}"
    return f"""WITH f AS (SELECT *, {pick}(adj_factor, trade_date) OVER (PARTITION BY ts_code) AS anchor FROM adj_factor),
    j AS (SELECT b.*, close - pre_close AS change_amount, adj_factor, anchor, count(*) FILTER (WHERE adj_factor IS NULL) OVER (PARTITION BY b.ts_code) AS gaps FROM panel_bar b LEFT JOIN f USING (ts_code, trade_date))
    SELECT ts_code, trade_date, {", ".join(price.format(c=c) for c in bars.PRICES)}, vol, amount FROM j WHERE gaps = 0"""


def changed(m):
    return m.panel_bar.withColumn("change_amount", F.col("close") - F.col("pre_close"))


@query("bar1_forward_adjusted", _adjusted_sql("arg_max"))
def forward(m):
    return bars.adjusted(changed(m), m.adj_factor)


@query("bar1_backward_adjusted", _adjusted_sql("arg_min"))
def backward(m):
    return bars.adjusted(changed(m), m.adj_factor, forward=False)


@query(
    "bar2_adjustment_gaps",
    """WITH f AS (SELECT ts_code, trade_date, CASE WHEN ts_code % 43 = 0 THEN 0 ELSE adj_factor END AS adj_factor FROM adj_factor), h AS (SELECT ts_code, 'missing_factor' AS reason, count(*) AS n_missing, CAST(list_slice(list_sort(list(DISTINCT trade_date)), 1, 3) AS VARCHAR) AS first_dates
    FROM panel_bar b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.ts_code = b.ts_code AND f.trade_date = b.trade_date) GROUP BY ts_code)
    SELECT * FROM h UNION ALL SELECT ts_code, 'missing_anchor', 0, '[]' FROM f WHERE ts_code NOT IN (SELECT ts_code FROM h) GROUP BY ts_code HAVING arg_max(adj_factor, trade_date) = 0""",
)
def gaps(m):
    factors = m.adj_factor.withColumn("adj_factor", F.when(F.col("ts_code") % 43 == 0, F.lit(0)).otherwise(F.col("adj_factor")))
    return bars.adjustment_gaps(m.panel_bar, factors).withColumn("first_dates", F.concat(F.lit("["), F.array_join(F.col("first_dates").cast("array<string>"), ", "), F.lit("]")))


@query(
    "bar3_qfq_view",
    "WITH f AS (SELECT *, arg_max(adj_factor, trade_date) OVER (PARTITION BY ts_code) AS e FROM adj_factor) SELECT ts_code, trade_date, "
    + ", ".join(f"CAST((2 * (CAST({c} * 10000 AS HUGEINT) * CAST(adj_factor * 100000000 AS HUGEINT)) + CAST(e * 100000000 AS HUGEINT)) // (2 * CAST(e * 100000000 AS HUGEINT)) AS DECIMAL(22,4)) / 10000 AS {c}_qfq" for c in ("open", "high", "low", "close"))
    + " FROM panel_bar JOIN f USING (ts_code, trade_date)",
)
def qfq(m):
    return bars.forward_view(m.panel_bar, m.adj_factor)


@query(
    "jn14_factor_join",
    "SELECT ts_code, trade_date, adj_factor, arg_max(adj_factor, trade_date) OVER (PARTITION BY ts_code) AS end_factor, close FROM panel_bar JOIN adj_factor USING (ts_code, trade_date)",
)
def factor_join(m):
    joined = m.panel_bar.select("ts_code", "trade_date", "close").join(m.adj_factor, ["ts_code", "trade_date"])
    return joined.join(bars.anchors(m.adj_factor, forward=True).withColumnRenamed("anchor", "end_factor"), "ts_code").select("ts_code", "trade_date", "adj_factor", "end_factor", "close")


@query("wn19_anchors", "SELECT ts_code, arg_max(adj_factor, trade_date) AS last_factor, arg_min(adj_factor, trade_date) AS first_factor FROM adj_factor GROUP BY ts_code")
def anchor_pair(m):
    last, first = bars.anchors(m.adj_factor, True), bars.anchors(m.adj_factor, False)
    return last.withColumnRenamed("anchor", "last_factor").join(first.withColumnRenamed("anchor", "first_factor"), "ts_code")


@query(
    "bar6_adjusted_period_bars",
    f"""WITH w AS ({_period_sql("week")}), q AS (SELECT ts_code, trade_date, CAST(round(CAST(close AS DOUBLE) * 0.5, 4) AS DECIMAL(18,4)) AS close_qfq, pre_close FROM w)
    SELECT ts_code, trade_date, close_qfq, coalesce(lag(close_qfq) OVER (PARTITION BY ts_code ORDER BY trade_date), pre_close) AS pre_close,
      close_qfq - coalesce(lag(close_qfq) OVER (PARTITION BY ts_code ORDER BY trade_date), pre_close) AS change_amount FROM q""",
)
def adjusted_period(m):
    week = bars.period_bars(m.daily_bar, "week")
    scaled = week.withColumn("scaled", F.round(F.col("close").cast("double") * 0.5, 4).cast("decimal(18,4)"))
    return bars.carried(scaled, "scaled", "qfq")


@query(
    "jn6_as_of_basic",
    """SELECT b.ts_code, b.trade_date, b.close, d.trade_date AS asof_trade_date, d.pe, d.turnover_rate
    FROM panel_bar b ASOF LEFT JOIN daily_basic d ON b.ts_code = d.ts_code AND b.trade_date >= d.trade_date""",
)
def as_of_basic(m):
    return bars.as_of(m.panel_bar.select("ts_code", "trade_date", "close"), m.daily_basic, ["ts_code"], "trade_date", ["pe", "turnover_rate"])


@query(
    "bar8_price_summary",
    """WITH l AS (SELECT ts_code, max(trade_date) AS trade_date FROM panel_bar GROUP BY ts_code)
    SELECT b.ts_code, b.trade_date, b.close, b.pre_close, b.vol, d.trade_date AS asof_trade_date, d.pe, d.total_mv
    FROM panel_bar b JOIN l USING (ts_code, trade_date) ASOF LEFT JOIN daily_basic d ON b.ts_code = d.ts_code AND b.trade_date >= d.trade_date""",
)
def price_summary(m):
    last = upsert.latest(m.panel_bar.select("ts_code", "trade_date", "close", "pre_close", "vol"), ["ts_code"], ["trade_date"])
    return bars.as_of(last, m.daily_basic, ["ts_code"], "trade_date", ["pe", "total_mv"])


_SNAPSHOT = f"""SELECT b.*, name, exchange, turnover_rate, pe, total_mv, buy_sm_amount, {_PCT} AS pct_chg FROM panel_bar b JOIN security USING (ts_code)
 LEFT JOIN daily_basic USING (ts_code, trade_date) LEFT JOIN (SELECT ts_code, trade_date, buy_sm_amount FROM moneyflow_a) USING (ts_code, trade_date)"""


def _snapshot(m):
    flow = m.moneyflow_a.select("ts_code", "trade_date", "buy_sm_amount")
    rows = bars.snapshot(m.panel_bar, m.security.select("ts_code", "name", "exchange"), m.daily_basic, flow)
    return rows.withColumn("pct_chg", F.round((F.col("close").cast("double") / F.nullif(F.col("pre_close").cast("double"), F.lit(0.0)) - 1) * 100, 4))


@query("dm1_daily_snapshot", _SNAPSHOT)
def daily_snapshot(m):
    return _snapshot(m)


@query(
    "ag1_market_summary",
    f"""SELECT trade_date, count(*) AS total, count(*) FILTER (WHERE pct_chg > 0) AS up_count, count(*) FILTER (WHERE pct_chg < 0) AS down_count, count(*) FILTER (WHERE pct_chg = 0) AS flat_count,
    round(avg(pct_chg), 8) AS avg_pct_chg, CAST(sum(amount) AS DECIMAL(30,4)) AS total_amount FROM ({_SNAPSHOT}) GROUP BY trade_date""",
)
def summary(m):
    return bars.market_summary(_snapshot(m))


@query(
    "dm2_market_overview",
    f"""WITH s AS ({_SNAPSHOT}), d AS (SELECT * FROM s WHERE trade_date = (SELECT max(trade_date) FROM s))
    SELECT * FROM (SELECT 'amount' AS board, ts_code, amount, pct_chg FROM d WHERE amount IS NOT NULL ORDER BY amount DESC, ts_code LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'gainers', ts_code, amount, pct_chg FROM d WHERE pct_chg IS NOT NULL ORDER BY pct_chg DESC, ts_code LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'losers', ts_code, amount, pct_chg FROM d WHERE pct_chg IS NOT NULL ORDER BY pct_chg, ts_code LIMIT 10)""",
)
def overview(m):
    rows = _snapshot(m)
    day = rows.join(F.broadcast(rows.agg(F.max("trade_date").alias("trade_date"))), "trade_date").select("ts_code", "amount", "pct_chg")
    board = lambda name, by, down: bars.top(day, by, 10, ["ts_code"], down).select(F.lit(name).alias("board"), "ts_code", "amount", "pct_chg")
    return board("amount", "amount", True).unionByName(board("gainers", "pct_chg", True)).unionByName(board("losers", "pct_chg", False))


@query("tk1_top_amounts", "SELECT ts_code, trade_date, amount FROM daily_bar WHERE amount IS NOT NULL ORDER BY amount DESC, ts_code, trade_date LIMIT 20")
def top_amounts(m):
    return bars.top(m.daily_bar.select("ts_code", "trade_date", "amount"), "amount", 20, ["ts_code", "trade_date"])


@query("src1_date_range_scan", "SELECT ts_code, trade_date, close FROM daily_bar WHERE trade_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def scan(m):
    return m.daily_bar.where(F.col("trade_date").between("1996-01-01", "1996-12-31")).select("ts_code", "trade_date", "close")


#: Trades are upserts to (order, line), which repeat; the last in this total order counts.
_LAST = "l_shipdate DESC, l_partkey DESC, ts_code DESC, vol DESC, amount DESC, px DESC"


@query(
    "snk1_upsert",
    f"""WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LAST}) AS p FROM tick WHERE year(trade_date) >= 1997) WHERE p = 1),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LAST}) AS p FROM tick WHERE year(trade_date) < 1997) WHERE p = 1)
    SELECT l_orderkey, l_linenumber, px, amount FROM n UNION ALL SELECT l_orderkey, l_linenumber, px, amount FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.l_orderkey = o.l_orderkey AND n.l_linenumber = o.l_linenumber)""",
)
def upsert_ticks(m):
    order = [F.desc("seq.l_shipdate"), F.desc("l_partkey"), F.desc("ts_code"), F.desc("vol"), F.desc("amount"), F.desc("px")]
    keys = ["l_orderkey", "l_linenumber"]
    old = upsert.keep_one(m.tick.where("year(trade_date) < 1997"), keys, order).select(*keys, "px", "amount")
    return upsert.upsert(old, m.tick.where("year(trade_date) >= 1997"), keys, order)


@query(
    "wn2_keep_one",
    f"SELECT l_orderkey, l_linenumber, ts_code, trade_date, px FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LAST}) AS p FROM tick) WHERE p = 1",
)
def keep_one(m):
    order = [F.desc("seq.l_shipdate"), F.desc("l_partkey"), F.desc("ts_code"), F.desc("vol"), F.desc("amount"), F.desc("px")]
    return upsert.keep_one(m.tick, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "ts_code", "trade_date", "px")


@query("snk2_append", "SELECT ts_code, trade_date, px FROM tick WHERE year(trade_date) < 1997 UNION ALL SELECT ts_code, trade_date, px FROM tick WHERE year(trade_date) >= 1996")
def append(m):
    rows = m.tick.select("ts_code", "trade_date", "px")
    return rows.where("year(trade_date) < 1997").unionByName(rows.where("year(trade_date) >= 1996"))


@query(
    "snk3_replace_dates",
    """WITH n AS (SELECT ts_code, trade_date, px, 1 AS batch FROM tick WHERE ts_code % 10 = 0) SELECT * FROM n
    UNION ALL SELECT ts_code, trade_date, px, 0 FROM tick WHERE ts_code % 10 <> 0 AND trade_date NOT IN (SELECT trade_date FROM n)""",
)
def replace(m):
    rows = m.tick.select("ts_code", "trade_date", "px")
    return upsert.replace_dates(rows.where("ts_code % 10 != 0").withColumn("batch", F.lit(0)), rows.where("ts_code % 10 = 0").withColumn("batch", F.lit(1)), "trade_date")


@query(
    "snk5_merge_ranges",
    """WITH o AS (SELECT ts_code, min(trade_date) AS f, max(trade_date) AS l FROM tick WHERE year(trade_date) < 1998 GROUP BY 1), n AS (SELECT ts_code, min(trade_date) AS f, max(trade_date) AS l FROM tick WHERE year(trade_date) >= 1997 GROUP BY 1)
    SELECT ts_code, least(o.f, n.f) AS first_seen, greatest(o.l, n.l) AS last_seen, coalesce(n.l, o.l) AS last_checked FROM o FULL JOIN n USING (ts_code)""",
)
def merge_ranges(m):
    seen = lambda rows: rows.groupBy("ts_code").agg(F.min("trade_date").alias("first_seen"), F.max("trade_date").alias("last_seen"), F.max("trade_date").alias("last_checked"))
    return upsert.merge_ranges(seen(m.tick.where("year(trade_date) < 1998")), seen(m.tick.where("year(trade_date) >= 1997")), ["ts_code"], "first_seen", "last_seen", "last_checked")


@query("snk6_light", "SELECT ts_code, trade_date, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("open", "high", "low", "close", "pre_close", "change_amount", "vol", "amount")) + f", {_PCT} AS pct_chg, 'api' AS source, year(trade_date) AS year FROM (SELECT *, close - pre_close AS change_amount FROM daily_bar) WHERE trade_date >= DATE '1994-01-01'")
def light(m):
    pct = F.round((F.col("close").cast("double") / F.nullif(F.col("pre_close").cast("double"), F.lit(0.0)) - 1) * 100, 4)
    rows = m.daily_bar.withColumns({"change_amount": F.col("close") - F.col("pre_close"), "pct_chg": pct, "source": F.lit("api")})
    return upsert.light(rows, start="1994-01-01").withColumn("year", F.year("trade_date").cast("long"))


@query("snk7_insert_absent", "SELECT ts_code, name FROM security WHERE ts_code % 3 = 0 UNION ALL SELECT ts_code, upper(name) FROM security WHERE ts_code % 2 = 0 AND ts_code % 3 <> 0")
def insert_absent(m):
    rows = m.security.select("ts_code", "name")
    return upsert.insert_absent(rows.where("ts_code % 3 = 0"), rows.where("ts_code % 2 = 0").withColumn("name", F.upper("name")), ["ts_code"])


@query("jn16_table_preference", "SELECT ts_code, trade_date, close, 'light' AS origin FROM daily_bar WHERE ts_code % 3 = 0 AND year(trade_date) = 1996 UNION ALL SELECT ts_code, trade_date, close, 'serving' FROM daily_bar WHERE year(trade_date) = 1996 AND ts_code NOT IN (SELECT ts_code FROM daily_bar WHERE ts_code % 3 = 0 AND year(trade_date) = 1996)")
def preference(m):
    rows = m.daily_bar.where("year(trade_date) = 1996").select("ts_code", "trade_date", "close")
    return upsert.prefer(rows.where("ts_code % 3 = 0").withColumn("origin", F.lit("light")), rows.withColumn("origin", F.lit("serving")), ["ts_code"])


@query("wn3_latest_bar", "SELECT ts_code, max(trade_date) AS trade_date, arg_max(close, trade_date) AS close FROM daily_bar GROUP BY ts_code")
def latest_bar(m):
    return upsert.latest(m.daily_bar.select("ts_code", "trade_date", "close"), ["ts_code"], ["trade_date"])


@query("wn4_last_n", "SELECT ts_code, trade_date, close FROM (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS p FROM daily_bar) WHERE p <= 30")
def last_n(m):
    return upsert.last_n(m.daily_bar.select("ts_code", "trade_date", "close"), ["ts_code"], "trade_date", 30)


@query("wn5_next_older", "SELECT ts_code, trade_date, lag(trade_date) OVER (PARTITION BY ts_code ORDER BY trade_date) AS older, lag(trade_date) OVER (PARTITION BY ts_code ORDER BY trade_date) IS NOT NULL AS has_more FROM daily_bar")
def next_older(m):
    from pyspark.sql import Window

    older = F.lag("trade_date").over(Window.partitionBy("ts_code").orderBy("trade_date"))
    return m.daily_bar.select("ts_code", "trade_date", older.alias("older"), older.isNotNull().alias("has_more"))


@query("ag15_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM tick GROUP BY 1, 2 HAVING count(*) > 1")
def repeated(m):
    return upsert.repeated_keys(m.tick, ["l_orderkey", "l_linenumber"])


@query(
    "wn1_first_last_markers",
    "SELECT ts_code, trade_date, row_number() OVER (PARTITION BY ts_code, date_trunc('month', trade_date) ORDER BY trade_date) AS from_first, row_number() OVER (PARTITION BY ts_code, date_trunc('month', trade_date) ORDER BY trade_date DESC) AS from_last FROM daily_bar",
)
def markers(m):
    from pyspark.sql import Window

    w = Window.partitionBy("ts_code", F.trunc("trade_date", "month"))
    place = lambda o: F.row_number().over(w.orderBy(o)).cast("long")
    return m.daily_bar.select("ts_code", "trade_date", place("trade_date").alias("from_first"), place(F.desc("trade_date")).alias("from_last"))
