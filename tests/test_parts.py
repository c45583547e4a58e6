"""How many rows a part of a large exchange holds."""

from pathlib import Path

from tapeworks import lineage
from tapeworks.operators import resolution
from tapeworks.plans.views import Market

DATA = Path("/root/testdata/sf0.001")


def test_parts_grow_with_known_rows(spark):
    """By the session's number alone, a task would hold more and more rows as the input grows."""
    named = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [lineage.dealt(spark.range(9), "id", rows=n).rdd.getNumPartitions() for n in (0, lineage.ROWS_OF_PART * named, lineage.ROWS_OF_PART * named + 1)] == [named, named, named + 1]


def test_money_flows_and_conflicts_bound_a_part(spark, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS_OF_PART", 500)
    flows = Market(spark, str(DATA))._flows()
    plan = flows._jdf.queryExecution().executedPlan().toString()
    trades = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert f", {-(-trades // 500)}), REPARTITION_BY_NUM" in plan
    assert "decimal" not in plan[plan.index("Exchange ") :].split("Project [", 1)[0]  # sums are whole numbers until then
    rows = spark.createDataFrame([(k, s, k * (s == "a")) for k in range(10) for s in "ab"], "key int, source string, x int")
    found = resolution.conflicts(rows, ["key"], ["x"], 20_000)
    assert ", 40), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(k, "x", 2) for k in range(1, 10)]
