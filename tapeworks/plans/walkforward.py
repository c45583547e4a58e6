"""Queries over walk-forward validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.lineage import WHERE_THEY_LIE, cut, planned_with, stored
from tapeworks.operators import boards, breadth
from tapeworks.operators import walkforward as wf
from tapeworks.plans.breadth import _index_bar, _index_bar_of, rounded
from tapeworks.plans.registry import query
from tapeworks.plans.views import SQL_VIEWS


def _score_sql(terms: dict) -> str:
    part = lambda n, low, high: f"coalesce(least(greatest((CAST({n} AS DOUBLE) - ({low})) / ({high} - ({low})), 0.0), 1.0), 0.5)"
    total = " + ".join(f"CAST({abs(w)} AS DOUBLE) * ({part(n, lo, hi) if w > 0 else '1 - ' + part(n, lo, hi)})" for n, (w, lo, hi) in terms.items())
    return f"round(least(greatest(({total}) * 100, 0.0), 100.0), 8)"


_TERMS = list(dict.fromkeys([*wf.MTI, *wf.MSI, *wf.RSK]))
SQL_VIEWS |= {
    "wf_days": f"""SELECT t.trade_date, {', '.join(_TERMS)} FROM mood_temperature t JOIN calendar c ON c.trade_date = t.trade_date AND c.n >= 21 JOIN mood_emotion e ON e.trade_date = t.trade_date
      LEFT JOIN mood_spread s ON s.trade_date = t.trade_date LEFT JOIN mood_concentration k ON k.trade_date = t.trade_date LEFT JOIN mood_collapse h ON h.trade_date = t.trade_date""",
    "wf_scores": f"""SELECT *, {', '.join(f'coalesce(round({c} - lag({c}) OVER (ORDER BY trade_date), 8), 0.0) + 0.0 AS d_{c}' for c in ('mti', 'msi', 'rsk'))}, row_number() OVER (ORDER BY trade_date) - 1 AS i
      FROM (SELECT *, {_score_sql(wf.MTI)} AS mti, {_score_sql(wf.MSI)} AS msi, {_score_sql(wf.RSK)} AS rsk FROM wf_days)""",
    "wf_limits": "SELECT s.*, {} FROM wf_scores s".format(
        ", ".join(f"(SELECT CASE WHEN count({c}) >= 20 THEN quantile_cont({c}, 0.8) END FROM wf_scores h WHERE h.i BETWEEN s.i - 252 AND s.i - 1) AS q_{c}" for c in wf.RSK)
    ),
    "wf_samples": """SELECT a.*, CAST(round(b.mti - a.mti, 6) >= -5 AND round(b.msi - a.msi, 6) >= -8 AS INTEGER) AS y_env_continue, CAST(round(b.mainline_concentration - a.mainline_concentration, 10) >= -0.005 AS INTEGER) AS y_mainline_expand,
      {} AS y_risk_event, b.red_rate AS y_red_next, b.tradable_up_rate AS y_tradable_up_next FROM wf_limits a JOIN wf_limits b ON b.i = a.i + 1""".format(
        "CASE WHEN " + " AND ".join(f"b.q_{c} IS NOT NULL AND b.{c} IS NOT NULL" for c in wf.RSK) + " THEN CAST(" + " OR ".join(f"round(b.{c}, 10) > round(b.q_{c}, 10)" for c in wf.RSK) + " AS INTEGER) END"
    ),
    "wf_states": "SELECT *, {}, {} FROM wf_samples".format(
        ", ".join(f"CASE WHEN {c} < {lo} THEN 'low' WHEN {c} < {hi} THEN 'mid' ELSE 'high' END AS b_{c}" for c, (lo, hi) in wf.BUCKETS.items()),
        ", ".join(f"CASE WHEN d_{c} > 1e-6 THEN 1 WHEN d_{c} < -1e-6 THEN -1 ELSE 0 END AS s_{c}" for c in ("mti", "msi")),
    ),
    "wf_folds": "SELECT f + 1 AS fold, 140 + 20 * f AS train_end, 180 + 20 * f AS valid_end, 200 + 20 * f AS test_end FROM (SELECT unnest(range(0, greatest(0, (n - 200) // 20 + 1))) AS f FROM (SELECT count(*) AS n FROM wf_samples))",
    "wf_counts": " UNION ALL ".join(
        f"SELECT fold, label, {level} AS level, {', '.join(c if k < size else f'NULL AS {c}' for k, c in enumerate(wf.STATE))}, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM wf_train GROUP BY fold, label{''.join(', ' + c for c in wf.STATE[:size])}"
        for level, size in enumerate((*wf.LEVELS, 0))
    ),
    "wf_train": " UNION ALL ".join(f"SELECT fold, {', '.join(wf.STATE)}, '{name}' AS label, y_{name} AS y FROM wf_states JOIN wf_folds ON i < train_end WHERE y_{name} IS NOT NULL" for name in wf.LABELS),
}


def _p(name: str) -> str:
    rate = f"coalesce((SELECT CAST(positives AS DOUBLE) / n FROM wf_counts c WHERE c.fold = f.fold AND c.label = '{name}' AND c.level = 4), 0.5)"
    options = []
    for level, (size, least) in enumerate(zip(wf.LEVELS, (30, 15, 10, 5))):
        same = " AND ".join(f"c.{k} = s.{k}" for k in wf.STATE[:size])
        options.append(f"(SELECT (c.positives + {rate.replace(' c ', ' g ').replace('c.', 'g.')} * 5.0) / (c.n + 5.0) FROM wf_counts c WHERE c.fold = f.fold AND c.label = '{name}' AND c.level = {level} AND c.n >= {least} AND {same})")
    return f"round(coalesce({', '.join(options)}, {rate}), 8) AS p_{name}"


SQL_VIEWS["wf_points"] = f"SELECT s.*, f.fold, {', '.join(_p(n) for n in wf.LABELS)} FROM wf_states s JOIN wf_folds f ON s.i >= f.valid_end AND s.i < f.test_end"
SQL_VIEWS["wf_decided"] = """SELECT *, round(least(least(greatest(0.15 + 0.45 * p_env_continue + 0.20 * p_mainline_expand - 0.50 * p_risk_event, 0.0), 0.8), CASE playbook WHEN 'A0' THEN 0.20 WHEN 'A1' THEN 0.50 WHEN 'A2' THEN 0.70 WHEN 'A3' THEN 0.35 ELSE 0.30 END), 8) AS exposure,
  msi BETWEEN 55 AND 75 AND rsk < 60 AND p_risk_event < 0.35 AS allow_chase FROM (SELECT *, CASE WHEN p_risk_event >= 0.6 OR rsk >= 70 THEN CASE WHEN mti >= 55 THEN 'A4' ELSE 'A0' END WHEN mti >= 65 AND msi >= 35 AND msi < 75 AND p_env_continue >= 0.55 AND p_risk_event < 0.35 THEN 'A2'
  WHEN mti >= 60 AND msi < 45 THEN 'A1' WHEN mti < 50 AND msi >= 60 AND p_risk_event < 0.4 THEN 'A3' WHEN mti >= 75 AND msi >= 75 AND rsk >= 60 THEN 'A4' WHEN mti >= 50 THEN 'A1' ELSE 'A0' END AS playbook FROM wf_points)"""


#: What the days' terms are made of.
_READ = (
    "ts_code", "trade_date", "n", "ok", "region", "bar_cents", "open", "close", "pre_close", "amount", "r", "red", "strong", "weak", "close_up", "close_down", "tradable_up", "tradable_touch_up", "blast", "big_loss",
    "streak", "y_close", "y_close_up", "y_tradable_up", "y_streak", "ret20", "t_here", "t_collapsed",
)


def _marked(m):
    """All bars with what the days' terms are made of, and the boards of their stock: trades are dealt out by stock once for the bars and once for the boards, and flags, streaks, days
    before and after and boards take no exchange then, and one order by stock and day."""
    bars = breadth.eligible_of_marked(m.marked_bars(), m.security.select("ts_code", "exchange", "list_date", "region"), m.calendar)
    return breadth.with_neighbours(bars).select(*_READ).join(m.boards_of_stocks(), ["ts_code", "n"], "left")


def days(m):
    with planned_with(m.spark, WHERE_THEY_LIE):
        bars = stored(_marked(m))
    rows = bars.where("ok")
    index = _index_bar_of(bars, F.sum("bar_cents") / 100)
    spread = breadth.spread(breadth.index_returns(index), 0, 1)
    share = breadth.concentration_of(breadth.themes_of(rows), rows)
    fallen = breadth.collapse_of(rows, m.calendar)
    base = breadth.temperature(rows, m.calendar).where(F.col("n") >= wf.WARM_UP).join(breadth.emotion(rows), "trade_date")
    joined = base.join(spread, "trade_date", "left").join(share, "trade_date", "left").join(fallen, "trade_date", "left")
    return cut(joined.select("trade_date", *_TERMS))


def samples(m):
    return cut(wf.labels(wf.scores(days(m))))


@query("wf1_scores", "SELECT trade_date, mti, msi, rsk, d_mti, d_msi, d_rsk FROM wf_scores")
def wf1(m):
    return wf.scores(days(m)).select("trade_date", "mti", "msi", "rsk", "d_mti", "d_msi", "d_rsk")


@query("wn13_score_deltas", "SELECT trade_date, d_mti, d_msi, d_rsk FROM wf_scores")
def wn13(m):
    return wf.scores(days(m)).select("trade_date", "d_mti", "d_msi", "d_rsk")


@query("wn15_trailing_quantile", "SELECT trade_date, " + ", ".join(f"round(q_{c}, 8) AS q_{c}" for c in wf.RSK) + " FROM wf_samples")
def wn15(m):
    return rounded(samples(m).select("trade_date", *[f"q_{c}" for c in wf.RSK]))


@query("wf3_labels", "SELECT trade_date, y_env_continue, y_mainline_expand, y_risk_event, y_red_next, y_tradable_up_next FROM wf_samples")
def wf3(m):
    return samples(m).select("trade_date", "y_env_continue", "y_mainline_expand", "y_risk_event", "y_red_next", "y_tradable_up_next")


@query("wf4_folds", "SELECT CAST(fold AS INTEGER) AS fold, CAST(train_end AS INTEGER) AS train_end, CAST(valid_end AS INTEGER) AS valid_end, CAST(test_end AS INTEGER) AS test_end FROM wf_folds")
def wf4(m):
    return wf.folds(samples(m))


@query("ag16_state_counts", f"SELECT CAST(fold AS INTEGER) AS fold, label, level, {', '.join(wf.STATE)}, n, positives FROM wf_counts")
def ag16(m):
    rows = samples(m)
    return wf.state_counts(rows, wf.folds(rows)).select("fold", "label", "level", *wf.STATE, "n", "positives")


_POINT = ("trade_date", "mti", "msi", "rsk", *[f"p_{n}" for n in wf.LABELS])


@query("wf5_probabilities", f"SELECT CAST(fold AS INTEGER) AS fold, {', '.join(_POINT)} FROM wf_points")
def wf5(m):
    rows = samples(m)
    return wf.predictions(rows, wf.folds(rows)).select("fold", *_POINT)


def decided(m):
    rows = samples(m)
    return cut(wf.decisions(wf.predictions(rows, wf.folds(rows))))


@query("wf6_playbook", "SELECT CAST(fold AS INTEGER) AS fold, trade_date, playbook, exposure, allow_chase FROM wf_decided")
def wf6(m):
    return decided(m).select("fold", "trade_date", "playbook", "exposure", "allow_chase")


def _rank_sql(c: str) -> str:
    return f"rank() OVER (PARTITION BY fold ORDER BY {c}) + (count(*) OVER (PARTITION BY fold, {c}) - 1) / 2.0"


def _ic(x: str, y: str) -> str:
    return f"(SELECT fold, CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 6) END AS ic FROM (SELECT fold, {_rank_sql(x)} AS a, {_rank_sql(y)} AS b FROM wf_decided WHERE {y} IS NOT NULL) GROUP BY fold)"


_METRICS = f"""SELECT CAST(d.fold AS INTEGER) AS fold, count(*) AS test_size, {', '.join(f'round(avg(pow(p_{n} - y_{n}, 2)), 6) AS brier_{n}' for n in wf.LABELS)}, round(avg(exposure), 6) AS avg_exposure,
 {', '.join(f"count(*) FILTER (WHERE playbook = '{p}') AS n_{p.lower()}" for p in wf.CAPS)}, any_value(r.ic) AS mti_red_ic, any_value(u.ic) AS msi_up_ic
 FROM wf_decided d LEFT JOIN {_ic('mti', 'y_red_next')} r USING (fold) LEFT JOIN {_ic('msi', 'y_tradable_up_next')} u USING (fold) GROUP BY d.fold"""


@query("wf7_fold_metrics", _METRICS)
def wf7(m):
    return rounded(wf.metrics(decided(m)), 6)


@query("ag11_brier", f"SELECT {', '.join(f'round(avg(pow(p_{n} - y_{n}, 2)), 6) AS brier_{n}' for n in wf.LABELS)} FROM wf_decided")
def ag11(m):
    return rounded(decided(m).agg(*[wf.brier(n).alias(f"brier_{n}") for n in wf.LABELS]), 6)


@query(
    "ag12_rank_correlation",
    """SELECT ts_code, CASE WHEN count(*) >= 3 AND min(a) < max(a) AND min(b) < max(b) THEN round(corr(a, b), 6) + 0.0 END AS ic FROM (SELECT ts_code, rank() OVER (PARTITION BY ts_code ORDER BY vol) + (count(*) OVER (PARTITION BY ts_code, vol) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY ts_code ORDER BY close) + (count(*) OVER (PARTITION BY ts_code, close) - 1) / 2.0 AS b FROM panel_bar) GROUP BY ts_code""",
)
def ag12(m):
    return rounded(wf.rank_correlation(m.panel_bar, "vol", "close", ("ts_code",)), 6)


_COMMON = (
    "SELECT trade_date FROM trade_calendar WHERE is_open"
    + "".join(f" AND trade_date IN (SELECT trade_date FROM {t})" for t in ("panel_bar", "stk_limit", "adj_factor", "daily_basic", "index_bar", "dc_member"))
    + " AND trade_date IN (SELECT trade_date FROM dc_index WHERE idx_type = 'concept')"
)


def common(m, last=None):
    """Open days of bars, limits, factors, ratios, indexes, boards of concepts, and members."""
    return boards.dates_in_all(m.trade_calendar, [m.panel_bar, m.stk_limit, m.adj_factor, m.daily_basic, _index_bar(m), m.dc_index.where("idx_type = 'concept'"), m.dc_member], last)


@query("wf2_common_dates", _COMMON)
def wf2(m):
    return common(m)


@query("wf2_last_dates", f"{_COMMON} ORDER BY trade_date DESC LIMIT 40")
def wf2_last(m):
    return common(m, 40)
