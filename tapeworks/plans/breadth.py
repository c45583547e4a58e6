"""Queries over market breadth: every trading day at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import breadth
from tapeworks.plans.registry import query
from tapeworks.plans.views import SQL_VIEWS, Market

_NEAR = " AND ".join(f"coalesce(abs({c} - up_limit) <= 0.01, FALSE)" for c in ("open", "high", "low", "close"))
SQL_VIEWS |= {
    "mood_base": """SELECT b.*, c.n, t.trade_date AS threshold, s.exchange, s.list_date, l.up_limit, l.down_limit, coalesce(nullif(l.limit_pre_close, 0), b.pre_close) AS base
      FROM panel_bar b JOIN calendar c USING (trade_date) JOIN calendar t ON t.n = c.n - 19 JOIN security s ON s.ts_code = b.ts_code LEFT JOIN stk_limit l ON l.ts_code = b.ts_code AND l.trade_date = b.trade_date
      WHERE s.exchange IN ('SSE', 'SZSE') AND NOT EXISTS (SELECT 1 FROM stock_st x WHERE x.ts_code = b.ts_code AND x.trade_date = b.trade_date)
      AND NOT EXISTS (SELECT 1 FROM suspend x WHERE x.ts_code = b.ts_code AND x.trade_date = b.trade_date)""",
    "mood_rows": f"""SELECT *, tradable_touch_up AND NOT close_up AS blast, tradable_touch_up AND (close - pre_close) * base <= -0.3 * (up_limit - base) * pre_close AS big_loss,
      (close - pre_close) * base <= -0.7 * (up_limit - base) * pre_close AS collapsed FROM (SELECT *, close_up AND NOT oneword_up AS tradable_up, touch_up AND coalesce(low < up_limit - 0.01, FALSE) AS tradable_touch_up FROM (
      SELECT *, CAST(close AS DOUBLE) / CAST(pre_close AS DOUBLE) - 1 AS r, CAST(up_limit AS DOUBLE) / CAST(base AS DOUBLE) - 1 AS limit_pct, close > pre_close AS red, close >= pre_close * 1.03 AS strong, close <= pre_close * 0.97 AS weak,
      coalesce(close >= up_limit - 0.01, FALSE) AS close_up, coalesce(close <= down_limit + 0.01, FALSE) AS close_down, coalesce(high >= up_limit - 0.01, FALSE) AS touch_up, ({_NEAR}) AS oneword_up,
      CASE WHEN up_limit >= base * 1.095 AND up_limit <= base * 1.105 THEN '10' WHEN up_limit >= base * 1.195 AND up_limit <= base * 1.205 THEN '20' END AS bucket
      FROM mood_base WHERE list_date <= threshold AND close IS NOT NULL AND pre_close <> 0 AND base <> 0 AND up_limit > base))""",
    "mood_runs": """SELECT *, CASE WHEN close_up THEN least(row_number() OVER (PARTITION BY ts_code, close_up, island ORDER BY n), 121) ELSE 0 END AS streak
      FROM (SELECT *, n - row_number() OVER (PARTITION BY ts_code, close_up ORDER BY n) AS island FROM mood_rows)""",
    "mood_pairs": "SELECT a.*, y.close AS y_close, y.close_up AS y_close_up, y.tradable_up AS y_tradable_up, y.streak AS y_streak FROM mood_runs a LEFT JOIN mood_runs y ON y.ts_code = a.ts_code AND y.n = a.n - 1",
    "mood_themes": """SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY theme_score DESC, theme) AS place FROM (SELECT *, round(0.4 * pr1 + 0.3 * pr2 + 0.3 * pr3, 8) AS theme_score FROM (
      SELECT *, {} FROM (SELECT d.*, (SELECT CASE WHEN count(*) >= 5 THEN CAST(d.theme_amount AS DOUBLE) / nullif(quantile_cont(CAST(h.theme_amount AS DOUBLE), 0.5), 0) END FROM mood_theme_days h WHERE h.theme = d.theme AND h.n BETWEEN d.n - 20 AND d.n - 1) AS theme_amount_ratio
      FROM mood_theme_days d) WHERE member_count >= 10 AND theme_red_rate IS NOT NULL AND theme_amount_ratio IS NOT NULL))""".format(
        ", ".join(
            f"CASE WHEN count(*) OVER (PARTITION BY trade_date) = 1 THEN 100.0 ELSE (rank() OVER (PARTITION BY trade_date ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2.0) / (count(*) OVER (PARTITION BY trade_date) - 1) * 100 END AS pr{i}"
            for i, c in enumerate(("theme_return", "theme_red_rate", "theme_amount_ratio"), 1)
        )
    ),
    "mood_theme_days": """SELECT m.ts_code AS theme, r.trade_date, r.n, count(*) AS member_count, quantile_cont(r.r, 0.5) AS theme_return, CASE WHEN count(*) >= 5 THEN CAST(count(*) FILTER (WHERE red) AS DOUBLE) / count(*) END AS theme_red_rate,
      CAST(sum(amount) AS DECIMAL(30,4)) AS theme_amount FROM dc_member m JOIN mood_rows r ON r.trade_date = m.trade_date AND r.ts_code = m.con_code GROUP BY 1, 2, 3""",
    "index_bar": """SELECT *, lag(close) OVER (PARTITION BY index_code ORDER BY trade_date) AS pre_close FROM (SELECT region AS index_code, trade_date, CAST(round(sum(close) / count(*), 4) AS DECIMAL(18,4)) AS close FROM panel_bar JOIN security USING (ts_code) GROUP BY 1, 2)""",
}


def ratio_sql(part: str, whole: str = "count(*)") -> str:
    return f"CASE WHEN {whole} >= 5 THEN CAST({part} AS DOUBLE) / {whole} END"


def where(c: str) -> str:
    return f"count(*) FILTER (WHERE {c})"


def median_sql(value: str) -> str:
    return f"CASE WHEN count({value}) >= 5 THEN quantile_cont({value}, 0.5) END"


def eligible(m: Market):
    return breadth.eligible(m.panel_bar, m.security, m.stk_limit, m.stock_st, m.suspend, m.calendar)


def pairs(m: Market):
    return breadth.with_yesterday(breadth.streaks(eligible(m)))


def rounded(rows, places: int = 8):
    return rows.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


FLAGS = ("red", "strong", "weak", "close_up", "close_down", "touch_up", "oneword_up", "tradable_up", "tradable_touch_up", "blast", "big_loss", "collapsed")


@query("mood1_eligible_rows", "SELECT ts_code, trade_date, exchange, list_date, close, pre_close, up_limit, down_limit, CAST(n AS BIGINT) AS n FROM mood_rows")
def mood1(m):
    return eligible(m).select("ts_code", "trade_date", "exchange", "list_date", "close", "pre_close", "up_limit", "down_limit", F.col("n").cast("long"))


@query("mood2_flags", f"SELECT ts_code, trade_date, round(r, 8) AS r, round(limit_pct, 8) AS limit_pct, bucket, {', '.join(FLAGS)} FROM mood_rows")
def mood2(m):
    return rounded(eligible(m).select("ts_code", "trade_date", "r", "limit_pct", "bucket", *FLAGS))


_TEMPERATURE = f"""SELECT trade_date, universe_size, red_rate, median_return, strong3_rate, weak3_rate, limit_down_rate, market_amount,
  CASE WHEN seen >= 5 THEN CAST(market_amount AS DOUBLE) / nullif(med, 0) END AS market_amount_ratio_20 FROM (
  SELECT d.*, (SELECT count(h.market_amount) FROM mood_days h WHERE h.n BETWEEN d.n - 20 AND d.n - 1) AS seen, (SELECT quantile_cont(CAST(h.market_amount AS DOUBLE), 0.5) FROM mood_days h WHERE h.n BETWEEN d.n - 20 AND d.n - 1) AS med FROM mood_days d)"""
SQL_VIEWS["mood_days"] = f"""SELECT trade_date, n, count(*) AS universe_size, {ratio_sql(where('red'))} AS red_rate, {median_sql('r')} AS median_return, {ratio_sql(where('strong'))} AS strong3_rate, {ratio_sql(where('weak'))} AS weak3_rate,
  {ratio_sql(where('close_down'))} AS limit_down_rate, CAST(sum(amount) AS DECIMAL(30,4)) AS market_amount FROM mood_rows GROUP BY trade_date, n"""
SQL_VIEWS["mood_temperature"] = _TEMPERATURE
_T = ("red_rate", "median_return", "strong3_rate", "weak3_rate", "limit_down_rate", "market_amount_ratio_20")


@query("mood3_temperature", f"SELECT trade_date, universe_size, market_amount, {', '.join(f'round({c}, 8) AS {c}' for c in _T)} FROM mood_temperature")
def mood3(m):
    return rounded(breadth.temperature(eligible(m), m.calendar).drop("n"))


def _index_bar(m):
    return _index_bar_of(m.panel_bar.join(F.broadcast(m.security.select("ts_code", "region")), "ts_code"), F.sum("close").cast("double"))


def _index_bar_of(joined, total):
    bars = joined.groupBy(F.col("region").alias("index_code"), "trade_date").agg(F.round(total / F.count("*"), 4).cast("decimal(18,4)").alias("close"))
    from pyspark.sql import Window

    return bars.withColumn("pre_close", F.lag("close").over(Window.partitionBy("index_code").orderBy("trade_date")))


_RETURNS = "SELECT trade_date, index_code, CAST(close AS DOUBLE) / CAST(pre_close AS DOUBLE) - 1 AS index_return FROM index_bar WHERE pre_close <> 0"
SQL_VIEWS["mood_spread"] = f"SELECT trade_date, max(index_return) FILTER (WHERE index_code = 0) - max(index_return) FILTER (WHERE index_code = 1) AS small_vs_large FROM ({_RETURNS}) GROUP BY trade_date"


@query("mood4_index_returns", f"SELECT trade_date, index_code, round(index_return, 8) AS index_return FROM ({_RETURNS})")
def mood4(m):
    return rounded(breadth.index_returns(_index_bar(m)))


@query("mood4_small_vs_large", "SELECT trade_date, round(small_vs_large, 8) + 0.0 AS small_vs_large FROM mood_spread")
def mood4_spread(m):
    return rounded(breadth.spread(breadth.index_returns(_index_bar(m)), 0, 1))


@query(
    "mood5_mainline_themes",
    "SELECT trade_date, theme, place, member_count, round(theme_return, 8) + 0.0 AS theme_return, round(theme_red_rate, 8) AS theme_red_rate, round(theme_amount_ratio, 8) AS theme_amount_ratio, theme_score FROM mood_themes WHERE place <= 3",
)
def mood5(m):
    scored = breadth.themes(eligible(m), m.dc_member, unique=True)
    return rounded(scored.where("place <= 3").select("trade_date", "theme", F.col("place").cast("long"), "member_count", "theme_return", "theme_red_rate", "theme_amount_ratio", "theme_score"))


SQL_VIEWS["mood_concentration"] = """SELECT trade_date, CAST(inside AS DOUBLE) / nullif(CAST(market AS DOUBLE), 0) AS mainline_concentration FROM (
  SELECT trade_date, sum(amount) AS inside FROM mood_rows r WHERE EXISTS (SELECT 1 FROM dc_member d JOIN mood_themes t ON t.trade_date = d.trade_date AND t.theme = d.ts_code WHERE t.place <= 3 AND d.trade_date = r.trade_date AND d.con_code = r.ts_code) GROUP BY trade_date)
  JOIN (SELECT trade_date, sum(amount) AS market FROM mood_rows GROUP BY trade_date) USING (trade_date)"""


@query("ag13_mainline_concentration", "SELECT trade_date, round(mainline_concentration, 8) AS mainline_concentration FROM mood_concentration")
def ag13(m):
    rows = eligible(m)
    return rounded(breadth.concentration(breadth.themes(rows, m.dc_member, unique=True), rows, m.dc_member))


SQL_VIEWS["mood_collapse"] = f"""SELECT trade_date, {ratio_sql(where('collapsed'), 'count(here)')} AS high_collapse_rate, max(size) AS high_pool_size, count(here) AS high_pool_effective_size FROM (
  SELECT c.trade_date, k.size, t.collapsed, t.ts_code AS here FROM (SELECT *, count(*) OVER (PARTITION BY n) AS size, row_number() OVER (PARTITION BY n ORDER BY ret20 DESC, ts_code) AS place FROM (
    SELECT e.ts_code, e.n + 1 AS n, round(p.adj / b.adj - 1, 10) AS ret20 FROM mood_rows e JOIN mood_adj p ON p.ts_code = e.ts_code AND p.n = e.n JOIN mood_adj b ON b.ts_code = e.ts_code AND b.n = e.n - 20 WHERE b.adj <> 0)) k
  JOIN calendar c ON c.n = k.n LEFT JOIN mood_rows t ON t.ts_code = k.ts_code AND t.n = k.n WHERE size >= 5 AND place <= greatest(1, ceil(size * 0.1))) GROUP BY trade_date"""
SQL_VIEWS["mood_adj"] = "SELECT ts_code, n, CAST(close AS DOUBLE) * CAST(adj_factor AS DOUBLE) AS adj FROM panel_bar JOIN calendar USING (trade_date) JOIN adj_factor USING (ts_code, trade_date)"


@query("mood6_high_collapse", "SELECT trade_date, round(high_collapse_rate, 8) AS high_collapse_rate, high_pool_size, high_pool_effective_size FROM mood_collapse")
def mood6(m):
    return rounded(breadth.collapse(eligible(m), m.panel_bar, m.adj_factor, m.calendar))


_PREMIUM = "CASE WHEN y_tradable_up THEN CAST({c} AS DOUBLE) / nullif(CAST(y_close AS DOUBLE), 0) - 1 END"
EMOTION = {
    "tradable_up_rate": ratio_sql(where("tradable_up")), "seal_success_rate": ratio_sql(where("tradable_up"), where("tradable_touch_up")), "blast_rate": ratio_sql(where("blast"), where("tradable_touch_up")),
    "board2plus_rate": ratio_sql(where("streak >= 2")), "advance_rate": ratio_sql(where("y_close_up AND close_up"), where("y_close_up")), "open_premium": median_sql(_PREMIUM.format(c="open")),
    "close_premium": median_sql(_PREMIUM.format(c="close")), "big_loss_rate": ratio_sql(where("big_loss"), where("tradable_touch_up")),
    "high_board_break_kill_rate": ratio_sql(where("y_streak >= 2 AND NOT close_up AND close < pre_close"), where("y_streak >= 2")),
}
_EMOTION = ", ".join(f"{e} AS {n}" for n, e in EMOTION.items())
_COUNTS = f"count(*) AS sample_size, {where('tradable_up')} AS tradable_up_count, {where('streak >= 2')} AS board2plus_count, CAST(max(streak) AS BIGINT) AS max_board"
SQL_VIEWS["mood_emotion"] = f"SELECT trade_date, {_COUNTS}, {_EMOTION} FROM mood_pairs GROUP BY trade_date"
SQL_VIEWS["mood_buckets"] = f"SELECT *, 30 * tradable_up_rate + 25 * seal_success_rate + 20 * advance_rate + 25 * close_premium AS msi FROM (SELECT trade_date, bucket, {_COUNTS}, {_EMOTION} FROM mood_pairs WHERE bucket IS NOT NULL GROUP BY trade_date, bucket)"
_ROUNDED = ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in EMOTION)


@query("mood7_emotion", f"SELECT trade_date, sample_size, tradable_up_count, board2plus_count, max_board, {_ROUNDED} FROM mood_emotion")
def mood7(m):
    rows = breadth.emotion(pairs(m))
    return rounded(rows.withColumn("max_board", F.col("max_board").cast("long")))


@query("mood8_bucket_stats", f"SELECT trade_date, bucket, sample_size, tradable_up_count, board2plus_count, max_board, {_ROUNDED}, round(msi, 6) + 0.0 AS msi FROM mood_buckets")
def mood8(m):
    rows = breadth.bucket_stats(pairs(m))
    return rounded(rows.withColumns({"max_board": F.col("max_board").cast("long"), "msi": F.round("msi", 6)}))


_TAG = " ".join(
    f"WHEN {c} THEN '{breadth.TAGS[t]}'"
    for c, t in (("msi10 IS NULL OR msi20 IS NULL", "few"), ("msi10 - msi20 >= 10", "ten"), ("msi10 - msi20 <= -10", "twenty"), ("msi10 >= 30 AND msi20 >= 30", "both"), ("msi20 > msi10", "elastic"), ("msi10 > msi20", "relay"))
)


@query(
    "mood9_structure",
    f"""SELECT trade_date, round(msi10, 6) AS msi10, round(msi20, 6) AS msi20, CASE WHEN msi10 IS NULL AND msi20 IS NULL THEN NULL {_TAG} ELSE '{breadth.TAGS['even']}' END AS structure_tag
    FROM (SELECT trade_date, max(msi) FILTER (WHERE bucket = '10') AS msi10, max(msi) FILTER (WHERE bucket = '20') AS msi20 FROM mood_buckets GROUP BY trade_date)""",
)
def mood9(m):
    return rounded(breadth.structure(breadth.bucket_stats(pairs(m))), 6)


@query(
    "mood10_diagnostics",
    """SELECT c.trade_date, y.trade_date AS prev_trade_date, b.trade_date AS ret20_base_date, (SELECT count(DISTINCT d.trade_date) FROM dc_member d JOIN calendar x ON x.trade_date = d.trade_date WHERE x.n BETWEEN c.n - 20 AND c.n) AS theme_day_coverage,
    high_pool_size, high_pool_effective_size FROM calendar c JOIN calendar y ON y.n = c.n - 1 JOIN calendar b ON b.n = c.n - 21 LEFT JOIN mood_collapse k ON k.trade_date = c.trade_date""",
)
def mood10(m):
    from pyspark.sql import Window

    w = Window.orderBy("n")
    days = m.calendar.select("trade_date", "n", F.lag("trade_date").over(w).alias("prev_trade_date"), F.lag("trade_date", 21).over(w).alias("ret20_base_date")).where("ret20_base_date is not null")
    pool = breadth.collapse(eligible(m), m.panel_bar, m.adj_factor, m.calendar).drop("high_collapse_rate")
    return days.drop("n").join(breadth.theme_coverage(m.dc_member, m.calendar), "trade_date").join(pool, "trade_date", "left")


@query("wn12_streaks", "SELECT ts_code, trade_date, CAST(streak AS BIGINT) AS streak FROM mood_runs WHERE close_up")
def wn12(m):
    return breadth.streaks(eligible(m)).where("close_up").select("ts_code", "trade_date", F.col("streak").cast("long"))


@query("jn11_yesterday", "SELECT ts_code, trade_date, y_close, y_close_up, CAST(y_streak AS BIGINT) AS y_streak FROM mood_pairs")
def jn11(m):
    return pairs(m).select("ts_code", "trade_date", "y_close", "y_close_up", F.col("y_streak").cast("long"))


@query("jn3_existence_flags", "SELECT ts_code, trade_date, EXISTS (SELECT 1 FROM stock_st x WHERE x.ts_code = b.ts_code AND x.trade_date = b.trade_date) AS is_st, EXISTS (SELECT 1 FROM suspend x WHERE x.ts_code = b.ts_code AND x.trade_date = b.trade_date) AS is_suspend FROM panel_bar b")
def jn3(m):
    keys = ["ts_code", "trade_date"]
    flag = lambda rows, name: rows.select(*keys).distinct().withColumn(f"_{name}", F.lit(True))
    rows = m.panel_bar.select(*keys).join(flag(m.stock_st, "st"), keys, "left").join(flag(m.suspend, "sus"), keys, "left")
    return rows.select(*keys, F.col("_st").isNotNull().alias("is_st"), F.col("_sus").isNotNull().alias("is_suspend"))


@query("st3_intersection", "SELECT r.ts_code, r.trade_date FROM mood_rows r JOIN mood_rows y ON y.ts_code = r.ts_code AND y.n = r.n - 1 WHERE y.close_up")
def st3(m):
    rows = eligible(m)
    before = rows.where("close_up").select("ts_code", (F.col("n") + 1).alias("n"))
    return rows.join(before, ["ts_code", "n"], "left_semi").select("ts_code", "trade_date")


@query(
    "wn17_percentile_rank",
    "SELECT ts_code, trade_date, round(CASE WHEN count(*) OVER d = 1 THEN 100.0 ELSE (rank() OVER (PARTITION BY trade_date ORDER BY close) - 1 + (count(*) OVER (PARTITION BY trade_date, close) - 1) / 2.0) / (count(*) OVER d - 1) * 100 END, 8) AS pr FROM panel_bar WINDOW d AS (PARTITION BY trade_date)",
)
def wn17(m):
    from pyspark.sql import Window

    return rounded(m.panel_bar.select("ts_code", "trade_date", breadth.percent_rank("close", Window.partitionBy("trade_date")).alias("pr")))


@query("wn20_nth_open_date", "SELECT trade_date, lag(trade_date, 1) OVER (ORDER BY n) AS prev, lag(trade_date, 19) OVER (ORDER BY n) AS listed, lag(trade_date, 21) OVER (ORDER BY n) AS base FROM calendar")
def wn20(m):
    from pyspark.sql import Window

    w = Window.orderBy("n")
    return m.calendar.select("trade_date", *[F.lag("trade_date", k).over(w).alias(name) for k, name in ((1, "prev"), (19, "listed"), (21, "base"))])


@query(
    "jn10_board_bridge",
    "SELECT d.trade_date, d.ts_code AS board, r.ts_code, r.amount FROM dc_member d JOIN dc_index i ON i.trade_date = d.trade_date AND i.ts_code = d.ts_code AND i.idx_type = 'concept' JOIN mood_rows r ON r.trade_date = d.trade_date AND r.ts_code = d.con_code",
)
def jn10(m):
    """Members of the boards of one kind with their metrics."""
    kind = m.dc_index.where("idx_type = 'concept'").select("trade_date", "ts_code")
    members = m.dc_member.join(kind, ["trade_date", "ts_code"], "left_semi").select("trade_date", F.col("ts_code").alias("board"), F.col("con_code").alias("ts_code"))
    return members.join(eligible(m).select("trade_date", "ts_code", "amount"), ["trade_date", "ts_code"])
