"""Queries over indicators. The recursive ones are checked against recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import bars, indicators
from tapeworks.plans.registry import query


def _sma_sql(table: str) -> str:
    part = lambda c, n, name: f"CASE WHEN count({c}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN round(avg(CAST({c} AS DOUBLE)) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) END AS {name}"
    columns = [part("close", n, f"ma{n}") for n in indicators.CLOSE_SPANS] + [part("vol", n, f"vol_ma{n}") for n in indicators.VOLUME_SPANS]
    return f"SELECT ts_code, trade_date, {', '.join(columns)} FROM {table} WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)"


@query("wn6_moving_averages", _sma_sql("panel_bar"))
def averages(m):
    rows = indicators.moving_averages(m.panel_bar.select("ts_code", "trade_date", "close", "vol")).drop("close", "vol")
    return rows.select("ts_code", "trade_date", *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


#: The bars numbered from 1, and all states of a code step by step.
_STATES = """
b AS (SELECT ts_code, trade_date, CAST(close AS DOUBLE) AS c, CAST(max(high) OVER w AS DOUBLE) AS h9, CAST(min(low) OVER w AS DOUBLE) AS l9, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS i
  FROM {rows} WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
s AS (SELECT ts_code, trade_date, i, c AS ema12, c AS ema26, CAST(0 AS DOUBLE) AS dea, 100.0 / 3 + (CASE WHEN h9 = l9 THEN 50 ELSE (c - l9) / (h9 - l9) * 100 END) / 3 AS k,
    100.0 / 3 + (100.0 / 3 + (CASE WHEN h9 = l9 THEN 50 ELSE (c - l9) / (h9 - l9) * 100 END) / 3) / 3 AS d FROM b WHERE i = 1
  UNION ALL
  SELECT ts_code, trade_date, i, e12, e26, 0.2 * (e12 - e26) + 0.8 * dea, nk, d * 2 / 3 + nk / 3 FROM (
    SELECT b.ts_code, b.trade_date, b.i, c * 2 / 13 + ema12 * 11 / 13 AS e12, c * 2 / 27 + ema26 * 25 / 27 AS e26, dea, d, k * 2 / 3 + (CASE WHEN h9 = l9 THEN 50 ELSE (c - l9) / (h9 - l9) * 100 END) / 3 AS nk
    FROM s JOIN b ON b.ts_code = s.ts_code AND b.i = s.i + 1))"""
_OUT = ", ".join(
    f"round({e}, {{p}}) + 0.0 AS {n}" for n, e in zip(indicators.STATEFUL, ("ema12", "ema26", "ema12 - ema26", "dea", "2 * (ema12 - ema26 - dea)", "k", "d", "3 * k - 2 * d"))
)
_FULL = f"WITH RECURSIVE {_STATES.format(rows='panel_bar')} SELECT ts_code, trade_date, {_OUT.format(p=5)} FROM s"


def _five(rows):
    return rows.withColumns({n: F.round(n, 5) for n in indicators.STATEFUL})


@query("wn7_wn9_ema_macd_kdj", _FULL)
def stateful(m):
    return _five(indicators.stateful(m.panel_bar))


@query("wn8_macd", f"WITH RECURSIVE {_STATES.format(rows='panel_bar')} SELECT ts_code, trade_date, round(ema12 - ema26, 5) + 0.0 AS dif, round(dea, 5) + 0.0 AS dea, round(2 * (ema12 - ema26 - dea), 5) + 0.0 AS macd FROM s")
def macd(m):
    return _five(indicators.stateful(m.panel_bar)).select("ts_code", "trade_date", "dif", "dea", "macd")


@query(
    "wn10_preheated",
    f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS p FROM panel_bar WHERE trade_date <= DATE '2000-12-31'),
    warm AS (SELECT * FROM (SELECT *, min(CASE WHEN trade_date >= DATE '2000-01-01' THEN p END) OVER (PARTITION BY ts_code) AS f FROM n) WHERE p >= f - 250), {_STATES.format(rows='warm')}
    SELECT ts_code, trade_date, {_OUT.format(p=5)} FROM s WHERE trade_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'""",
)
def preheated(m):
    return _five(indicators.preheated(m.panel_bar, "2000-01-01", "2000-12-31", warm=250))


@query(
    "wn11_overlay",
    f"WITH RECURSIVE {_STATES.format(rows='panel_bar')} SELECT ts_code, trade_date, close, " + ", ".join(f"CASE WHEN ts_code % 3 = 0 THEN CAST(close AS DOUBLE) + {i} END AS {n}" for i, n in enumerate(("dif", "dea", "macd", "k", "d", "j"))) + " FROM s JOIN (SELECT ts_code, trade_date, close FROM panel_bar) USING (ts_code, trade_date)",
)
def overlaid(m):
    """Computed values, over which stored ones are laid: without a stored row all are null."""
    names = ("dif", "dea", "macd", "k", "d", "j")
    computed = m.panel_bar.select("ts_code", "trade_date", "close").join(indicators.stateful(m.panel_bar).select("ts_code", "trade_date", *names), ["ts_code", "trade_date"])
    stored = m.panel_bar.where("ts_code % 3 = 0").select("ts_code", "trade_date", *[(F.col("close").cast("double") + i).alias(f"{n}_qfq") for i, n in enumerate(names)])
    return indicators.overlay(computed, stored, "qfq")


_KLINE = f"""a AS ({_sma_sql('panel_bar')}), k AS (SELECT ts_code, trade_date, {_OUT.format(p=4)} FROM s),
 r AS (SELECT ts_code, trade_date, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS back, count(*) OVER (PARTITION BY ts_code) AS total FROM panel_bar),
 x AS (SELECT ts_code, max(CASE WHEN back = 61 THEN trade_date END) AS next_start FROM r GROUP BY ts_code)"""
_MA = ", ".join(f"round(ma{n}, 4) AS ma{n}" for n in indicators.CLOSE_SPANS)


@query(
    "bar7_kline",
    f"""WITH RECURSIVE {_STATES.format(rows='panel_bar')}, {_KLINE}
    SELECT ts_code, trade_date, b.close, turnover_rate, ma5, ma20, {', '.join(indicators.STATEFUL)}, least(total, 60) AS bar_count, next_start IS NOT NULL AS has_more, next_start
    FROM (SELECT ts_code, trade_date, close FROM panel_bar) b JOIN r USING (ts_code, trade_date) JOIN x USING (ts_code) JOIN (SELECT ts_code, trade_date, {_MA} FROM a) USING (ts_code, trade_date) JOIN k USING (ts_code, trade_date)
    LEFT JOIN daily_basic USING (ts_code, trade_date) WHERE back <= 60""",
)
def kline(m):
    columns = ("ts_code", "trade_date", "close", "turnover_rate", "ma5", "ma20", *indicators.STATEFUL, "bar_count", "has_more", "next_start")
    return indicators.kline(m.panel_bar, m.daily_basic, 60).select(*columns)


@query("bar9_header_defaults")
def header(m):
    doubles = lambda rows: rows.withColumns({c: F.col(c).cast("double") for c in bars.PRICES if c in rows.columns})
    return indicators.header(doubles(bars.adjusted(m.panel_bar, m.adj_factor)), doubles(m.panel_bar), m.daily_basic)
