"""Every registered query of the library against its SQL on the small tables, by groups."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tapeworks import lineage, plans
from tapeworks.operators import breadth, resolution
from tapeworks.plans import views
from tapeworks.plans.views import Market

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query for each family is run here; the others are compared in the same way by the driver.
NAMES = (
    "bar4_weekly_bars", "bar1_forward_adjusted", "bar2_adjustment_gaps", "bar5_vendor_over_derived", "jn6_as_of_basic", "dm2_market_overview", "snk1_upsert", "snk3_replace_dates", "snk5_merge_ranges",
    "wn6_moving_averages", "wn7_wn9_ema_macd_kdj", "wn11_overlay", "mood2_flags", "mood3_temperature", "mood7_emotion", "mood9_structure", "wn17_percentile_rank", "sc1_market_code", "sc6_content_hash", "src2_envelope", "src3_json_list",
    "prj4_dividend_dates", "rs6_field_merge", "rs11_conflicts", "rc1_moneyflow_reconcile", "rc4_gate", "fr1_freshness", "fr8_alerts", "st5_concepts", "tk3_members_of_boards", "snk6_light_partitions", "ss1_incremental_upsert", "ss2_probe",
)


@pytest.fixture(scope="module")
def duck():
    if not DATA.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool | str):
        return x
    if hasattr(x, "isoformat"):
        return str(x)[:19].removesuffix(" 00:00:00")
    return round(float(x), 6)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, str(DATA))
    cursor = duck.execute(plans.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


def test_names_and_counts():
    assert set(plans.SQL) <= set(plans.QUERIES)
    assert len(plans.QUERIES) >= 150


def test_money_flows_are_summed_after_the_exchange(spark):
    """Before it, a task would hold a split's keys, about as many as its trades, with eight decimals each."""
    plan = Market(spark, str(DATA))._flows()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "HashAggregate" not in plan[plan.index("Exchange ") :]


def test_bars_take_one_exchange(spark):
    """Trades are dealt out by code once, for the bars and for the closes before them, and aren't summed within a split."""
    plan = Market(spark, str(DATA)).daily_bar._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Aggregate" not in plan[plan.index("Exchange ") :]


def test_trades_are_whole_numbers_as_exact_as_decimals(spark):
    """Cents and ten-thousandths without decimals for each trade, also where a half decides or a double has more places."""
    numbers = [0.0, -0.0, 1.005, 2.675, 0.125, -0.125, 20.015, 19.995, 17954.55, 104949.5, 0.00005, 0.00015, 1.23455, 1.23445, -7.00005, 123456789.12345, 1e11 + 0.3, None]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", F.round("x", 2).alias("px"), views._cents(F.col("x")).alias("cents"), views._units(F.col("x")).alias("units"), views.dec(F.col("x"), 20).alias("d"))
    for r in rows.collect():
        assert (r.x is None and r.cents is None and r.units is None) or (r.cents == round(r.px * 100) and r.units == int(r.d * 10_000)), r


def test_trades_stay_whole_numbers_until_a_bar(spark):
    plan = Market(spark, str(DATA)).daily_bar._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange ") :]
    assert "decimal" not in below.split("Project [", 1)[0] and "placed" in below and " px#" not in below


def test_parts_of_large_steps_are_not_merged(spark):
    """Merged down to about one part a core, the last part runs alone."""
    rows = spark.createDataFrame([(1, "2020-01-06", 1, 0.1, True, 5.0)], "ts_code long, trade_date string, n int, r double, red boolean, amount double")
    members = spark.createDataFrame([("2020-01-06", "a", 1)], "trade_date string, ts_code string, con_code long")
    plan = breadth.themes(rows, members, unique=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 3


def test_conflicts_do_not_multiply_rows(spark):
    """Distinct counts of two columns would give each row twice for each field, in hash maps that grow with the task's rows; merged parts would, too."""
    rows = spark.createDataFrame([("k", "a", 1, None), ("k", "b", 2, None), ("k", "c", 2, 5), ("l", "a", 1, 1), ("l", "a", 2, 1), ("m", "a", 3, 3), ("m", "b", 3, 3), ("n", None, 1, 1), ("n", "a", 2, 2)], "key string, source string, x int, y int")
    found = resolution.conflicts(rows, ["key"], ["x", "y"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange ") == 1
    assert sorted(tuple(r) for r in found.collect()) == [("k", "x", 2), ("k", "y", 2)] and found.columns == ["key", "field", "n_values"] and dict(found.dtypes)["n_values"] == "bigint"


def test_sources_meet_in_named_parts(spark):
    rows = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 2.0)], "key string, source string, v double")
    for found in (resolution.last_of_source(rows, ["key"], [F.col("v")]), resolution.compare(rows, rows, ["key"], ["v"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == plan.count("REPARTITION_BY_NUM") > 0


def test_stored_rows_are_read_by_columns(spark):
    kept = lineage.stored(spark.range(3).select("id", F.lit("x").alias("other")))
    plan = kept.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "other" not in plan and sorted(r.id for r in kept.collect()) == [0, 1, 2]


def test_streaks_and_yesterday_take_one_order(spark):
    rows = spark.createDataFrame([(1, n, up, float(n), False) for n, up in enumerate([True, True, False, True, True, True])] + [(1, 7, True, 7.0, True)], "ts_code long, n int, close_up boolean, close double, tradable_up boolean")
    found = breadth.with_yesterday(breadth.streaks(rows))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1
    assert [(r.streak, r.y_streak) for r in found.orderBy("n").collect()] == [(1, None), (2, 1), (0, 2), (1, 0), (2, 1), (3, 2), (1, None)]
