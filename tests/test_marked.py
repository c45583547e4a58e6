"""The days' terms from bars that are marked in their own row, against the general operators on separate tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tapeworks import lineage
from tapeworks.operators import breadth
from tapeworks.plans import walkforward
from tapeworks.plans.breadth import eligible
from tapeworks.plans.views import Market

DATA = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def found(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    m = Market(spark, str(DATA))
    with lineage.planned_with(spark, lineage.WHERE_THEY_LIE):
        bars = lineage.stored(walkforward._marked(m))
    return m, bars.where("ok"), lineage.stored(eligible(m))


def rows_of(df):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(*sorted(df.columns)).collect())


def test_marked_rows_are_the_joined_ones(found):
    m, rows, joined = found
    paired = breadth.with_yesterday(breadth.streaks(joined))
    number = lambda df, c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if "streak" in c else F.coalesce(F.col(c), F.lit(False)).alias(c) if dict(df.dtypes)[c] == "boolean" else F.col(c).cast("double").alias(c)
    names = ("open", "close", "pre_close", "r", "red", "strong", "weak", "close_up", "close_down", "tradable_up", "tradable_touch_up", "blast", "big_loss", "streak", "y_close", "y_close_up", "y_tradable_up", "y_streak")
    shown = lambda df: df.select("ts_code", "trade_date", "n", *[number(df, c) for c in names])
    assert rows_of(shown(rows)) == rows_of(shown(paired)) and rows.count() > 10_000
    assert rows.agg(F.sum("amount")).first()[0] == joined.agg((F.sum("amount") * 10_000).cast("long")).first()[0]


def test_marked_terms_are_the_general_ones(found):
    m, rows, joined = found
    share = breadth.concentration(breadth.themes(joined, m.dc_member, unique=True), joined, m.dc_member)
    assert rows_of(breadth.concentration_of(breadth.themes_of(rows), rows)) == rows_of(share) and share.count() > 0
    assert rows_of(breadth.collapse_of(rows, m.calendar)) == rows_of(breadth.collapse(joined, m.panel_bar, m.adj_factor, m.calendar))
    assert rows_of(breadth.temperature(rows, m.calendar)) == rows_of(breadth.temperature(joined, m.calendar))


def test_themes_go_by_name_where_scores_tie(found):
    """A board is its place among the names, so ties by it are ties by name."""
    m, rows, joined = found
    part = m.table("part").select(F.col("p_type").alias("name")).distinct()
    names = {r.name: i for i, r in enumerate(part.orderBy("name").collect(), 1)}
    first = {(r.trade_date, r.place): r.theme for r in breadth.themes_of(rows).where("place <= 3").collect()}
    assert first == {(r.trade_date, r.place): names[r.theme] for r in breadth.themes(joined, m.dc_member, unique=True).where("place <= 3").collect()}


def test_neighbours_pass_over_what_is_not_eligible(spark):
    days = [(0, True, True), (1, True, True), (2, False, False), (3, True, True), (5, True, True), (6, True, True), (7, True, False)]
    rows = spark.createDataFrame([(1, n, ok, 10.0 + n if ok else None, up, False, n == 6) for n, ok, up in days], "ts_code long, n int, ok boolean, close double, close_up boolean, tradable_up boolean, collapsed boolean")
    near = breadth.with_neighbours(rows).where("ok").orderBy("n").collect()
    assert [(r.n, r.streak, r.y_streak, r.y_close, r.t_here, r.t_collapsed) for r in near] == [
        (0, 1, None, None, 1, False), (1, 2, 1, 10.0, None, None), (3, 1, None, None, None, None), (5, 1, None, None, 1, True), (6, 2, 1, 15.0, 1, False), (7, 0, 2, 16.0, None, None),
    ]


def test_marked_bars_take_two_large_exchanges(spark):
    """Trades are dealt out by stock, for the bars and for the boards; flags, streaks, neighbours and boards are then found where they lie (before, each was an exchange of the whole panel)."""
    m = Market(spark, str(DATA))
    with lineage.planned_with(spark, lineage.WHERE_THEY_LIE):
        plan = walkforward._marked(m)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2
    assert "decimal" not in plan.split("REPARTITION_BY_NUM", 1)[0]
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true" and spark.conf.get("spark.sql.execution.useObjectHashAggregateExec") == "true"
    top = plan.split("REPARTITION_BY_NUM", 1)[0]  # above the bars' exchange
    assert top.count("Exchange ") == 1 + top.count("BroadcastExchange ")
