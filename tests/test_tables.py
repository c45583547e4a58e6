"""Versioned tables, and the streams that keep them: batches, order, restarts, failures."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapeworks.sources import sinks
from tapeworks.sources.tables import Conflict, Refused, Table, bucket_of
from tapeworks.streaming import jobs

D = dt.date
UTC = dt.timezone.utc


def files_of(table):
    entries, _ = table._entries(table.version())
    return {name: sorted(p.name for p in Path(table.folder, at).glob("*.parquet")) for name, at in entries.items()}


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), spark.range(1).schema)
    assert sinks.publish(spark.range(5), table, dry_run=True) == 5 and table.version() == 0 and table.read().count() == 0
    assert sinks.publish(spark.range(5), table) == 5
    late = spark.range(8).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stopped")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stopped"):
        sinks.publish(late, table)
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Refused):
        sinks.publish(spark.range(0), table)
    with pytest.raises(Refused):
        sinks.copy_table(spark.range(3).withColumn("x", F.lit(1)), table)
    assert table.version() == 1 and sinks.copy_table(spark.range(0), table) == 0 and table.read().count() == 0
    assert table.read(version=1).count() == 5


def test_two_writers_of_one_version(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), spark.range(1).schema)
    table.replace(spark.range(2))
    with pytest.raises(Conflict):
        table._commit({}, 0, -1)
    assert table.read().count() == 2


def test_upserts_rewrite_touched_parts_alone(spark, tmp_path):
    schema = StructType.fromDDL("day date, k long, v string, created_at timestamp, updated_at timestamp")
    table = Table(spark, str(tmp_path / "t"), schema, F.date_format("day", "yyyy-MM"))
    at = lambda h: F.lit(dt.datetime(2024, 5, 1, h)).cast("timestamp")
    rows = lambda *r: spark.createDataFrame(list(r), "day date, k long, v string, seq int, extra string")
    sinks.upsert_into(table, rows((D(2024, 1, 1), 1, "a", 1, "x"), (D(2024, 2, 1), 2, "b", 1, "x"), (None, 3, "lost", 1, "x")), ["day", "k"], ["seq"], now=at(1))
    before = files_of(table)
    touched = sinks.upsert_into(table, rows((D(2024, 2, 1), 2, "first", 1, "x"), (D(2024, 2, 1), 2, "last", 2, "x"), (D(2024, 2, 9), 4, "new", 1, "x")), ["day", "k"], ["seq"], now=at(7))
    after = files_of(table)
    assert touched == ["2024-02"] and after["2024-01"] == before["2024-01"] and after["2024-02"] != before["2024-02"]
    assert {r.k: (r.v, r.created_at.hour, r.updated_at.hour) for r in table.read().collect()} == {1: ("a", 1, 1), 2: ("last", 1, 7), 4: ("new", 7, 7)}
    table.vacuum(keep=1)
    assert files_of(table) == after and table.read().count() == 3 and len(list(Path(table.folder, "versions").glob("v*"))) == 1
    with pytest.raises(Exception, match="not a label"):
        Table(spark, str(tmp_path / "u"), schema, F.col("v")).replace(table.read().withColumn("v", F.lit("a/b")))


def test_dates_are_replaced_with_their_repeats(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), StructType.fromDDL("day date, v int"), F.year("day"))
    rows = lambda *r: spark.createDataFrame(list(r), "day date, v int")
    table.replace(rows((D(2023, 1, 1), 1), (D(2024, 1, 1), 2), (D(2024, 1, 2), 3)))
    before = files_of(table)
    assert sinks.replace_dates_in(table, rows((D(2024, 1, 2), 8), (D(2024, 1, 2), 8)), "day") == ["2024"]
    assert sorted((r.day, r.v) for r in table.read().collect()) == [(D(2023, 1, 1), 1), (D(2024, 1, 1), 2), (D(2024, 1, 2), 8), (D(2024, 1, 2), 8)]
    assert files_of(table)["2023"] == before["2023"] and sinks.replace_dates_in(table, rows().limit(0), "day") == []


ARRIVAL = "k long, source string, v int, ts timestamp, n long"


def arrivals(rng, n):
    rows = [(rng.randint(0, 12) if rng.random() < 0.95 else None, rng.choice(["a", "b", "c"]), rng.randint(0, 99), dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(hours=rng.randint(0, 200)), i) for i in range(n)]
    return rows


def landed(spark, folder, parts):
    for rows in parts:
        spark.createDataFrame(rows, ARRIVAL).coalesce(1).write.mode("append").parquet(folder)


def brute_published(rows, order):
    last = {}
    for r in rows:
        if r[0] is not None and (r[0], r[1]) not in last or r[0] is not None and (r[3], r[4]) > (last[r[0], r[1]][3], last[r[0], r[1]][4]):
            last[r[0], r[1]] = r
    out = {}
    for k in {k for k, _ in last}:
        own = {s: r for (kk, s), r in last.items() if kk == k}
        best = next((s for s in order if s in own), min(own))
        out[k] = (best, own[best][2], ",".join(sorted(own)))
    return out


@pytest.mark.parametrize("files_at_once", [1, 3, 100])
def test_published_rows_do_not_depend_on_batches(spark, tmp_path, files_at_once):
    rng = random.Random(1)  # the same rows for each way to deal them
    rows = arrivals(rng, 120)
    rng2 = random.Random(files_at_once)
    rng2.shuffle(rows)
    first, then = [rows[:20], rows[20:25], rows[25:80]], [rows[80:]]
    landed(spark, str(tmp_path / "in"), first)
    stream = lambda: jobs.file_stream(spark, str(tmp_path / "in"), ARRIVAL, files_at_once)
    published = lambda: {r.k: (r.source, r.v, r.source_candidates) for r in jobs.publish_arrivals(stream(), str(tmp_path / "p"), ["k"], ["ts", "n"], ["b", "a"], buckets=3).collect()}
    upserted = lambda: {r.k: (r.n, r.v) for r in jobs.upsert_arrivals(stream(), str(tmp_path / "u"), ["k"], ["ts", "n"], buckets=3).collect()}
    ranged = lambda: {r.k: (r.first_seen, r.last_seen, r.last_checked) for r in jobs.running_ranges(stream(), str(tmp_path / "r"), "k", buckets=3).collect()}
    for so_far in (sum(first, []), rows):
        newest = {k: max((r for r in so_far if r[0] == k), key=lambda r: (r[3], r[4])) for k in {r[0] for r in so_far} - {None}}
        times = {k: [r[3].replace(tzinfo=None) for r in so_far if r[0] == k] for k in newest}
        for _ in range(2):  # the second run finds no new files
            assert published() == brute_published(so_far, ["b", "a"])
            assert upserted() == {k: (r[4], r[2]) for k, r in newest.items()}
            assert ranged() == {k: (min(t), max(t), max(t)) for k, t in times.items()}
        if so_far is not rows:
            landed(spark, str(tmp_path / "in"), then)
    assert len(list((tmp_path / "u" / "table" / "versions").glob("v*"))) <= 2


def test_a_batch_that_stopped_halfway_runs_again(spark, tmp_path):
    """A batch that is in the table already comes again."""
    rows = arrivals(random.Random(4), 40)
    schema = StructType.fromDDL(ARRIVAL)
    frame = spark.createDataFrame(rows, schema)
    table = Table(spark, str(tmp_path / "t"), schema, bucket_of(["k"], 2))
    parts = table.change(frame, lambda old, new: old.unionByName(new), 0)
    assert sorted(table.change(frame, lambda old, new: old.unionByName(new), 0)) == sorted(parts)
    assert table.read().count() == 40 and table.batch() == 0


RULE = "rule_id long, dataset string, condition string, min_rows int, timezone string, window_start string, window_end string, interval_s int, max_per_day int"


def rule(spark, *rules):
    return spark.createDataFrame(list(rules), RULE)


def at(day, hour, minute=0, second=0):
    return dt.datetime(2024, 1, day, hour, minute, second, tzinfo=UTC)


def test_which_rules_are_due(spark):
    rules = rule(
        spark,
        (1, "d", "x", None, "UTC", "09:00", "10:00", 60, 5), (2, "d", "x", None, "UTC", "23:00", "01:00", 60, 5), (3, "d", "x", None, "Asia/Shanghai", "09:00:30", None, 60, 5),
        (4, "d", "x", None, "UTC", None, None, 600, 5), (5, "d", "x", None, "UTC", "", "", 60, 2), (6, "d", "x", None, None, None, None, 0, 0),
    )
    log = spark.createDataFrame([(4, at(1, 9, 25), D(2024, 1, 1), False, None, None), (5, at(1, 1), D(2024, 1, 1), True, None, None), (5, at(1, 2), D(2024, 1, 1), True, None, None), (5, at(1, 3), D(2024, 1, 1), False, None, None)], jobs.PROBES)
    skips = lambda t: {r.rule_id: r.skip for r in jobs.due(rules, log, F.lit(t).cast("timestamp")).collect()}
    assert skips(at(1, 9, 30)) == {1: None, 2: "outside_window", 3: None, 4: "too_soon", 5: "daily_cap", 6: None}
    assert skips(at(1, 10, 0)) | {6: None} == {1: None, 2: "outside_window", 3: None, 4: None, 5: "daily_cap", 6: None}
    assert skips(at(1, 10, 0, 1))[1] == "outside_window"
    assert skips(at(1, 23, 30))[2] is None and skips(at(2, 0, 59))[2] is None and skips(at(2, 1, 0, 1))[2] == "outside_window"
    assert skips(at(2, 4))[5] is None  # another day


def test_which_rules_are_due_at_the_second(spark):
    rules = rule(spark, (1, "d", "x", None, "Asia/Shanghai", "09:00:30", None, 60, 5))
    none = spark.createDataFrame([], jobs.PROBES)
    skip = lambda t: jobs.due(rules, none, F.lit(t).cast("timestamp")).first().skip
    assert skip(at(1, 1, 0, 30)) is None and skip(at(1, 1, 0, 29)) == "outside_window"


def test_conditions_of_probes(spark):
    rules = rule(
        spark,
        (1, "new", "freshness_latest_open", None, "UTC", None, None, 60, 5), (2, "old", "freshness_latest_open", None, "UTC", None, None, 60, 5), (3, "new", "freshness_latest_open", 10, "UTC", None, None, 60, 5),
        (4, "new", "freshness_latest_open", 11, "UTC", None, None, 60, 5), (5, "old", "raw_rows_min", 3, "UTC", None, None, 60, 5), (6, "old", "raw_rows_min", 4, "UTC", None, None, 60, 5),
        (7, "none", "raw_rows_min", None, "UTC", None, None, 60, 5), (8, "none", "freshness_latest_open", None, "UTC", None, None, 60, 5), (9, "old", "raw_rows_min", None, "UTC", None, None, 60, 5),
    )
    observed = spark.createDataFrame([("new", D(2024, 1, 5), 10), ("old", D(2024, 1, 4), 3)], "dataset string, latest_date date, rows_in long")
    calendar = spark.createDataFrame([(D(2024, 1, 4), True), (D(2024, 1, 5), True), (D(2024, 1, 6), False), (D(2024, 1, 8), True)], "trade_date date, is_open boolean")
    now = F.lit(at(7, 12)).cast("timestamp")
    ready = jobs.due(rules, spark.createDataFrame([], jobs.PROBES), now).where("skip IS NULL")
    got = {r.rule_id: r.matched for r in jobs.evaluated(ready, observed, calendar, now).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False, 8: False, 9: True}
    late = F.lit(at(8, 12)).cast("timestamp")
    ready = jobs.due(rules, spark.createDataFrame([], jobs.PROBES), late).where("skip IS NULL")
    assert {r.rule_id for r in jobs.evaluated(ready, observed, calendar, late).where("matched").collect()} == {5, 9}


def test_probes_keep_their_state_over_batches_and_restarts(spark, tmp_path):
    rules = rule(spark, (1, "a", "raw_rows_min", 2, "UTC", None, None, 3600, 2), (2, "b", "raw_rows_min", 1, "UTC", "06:00", "22:00", 60, 9))
    calendar = spark.createDataFrame([], "trade_date date, is_open boolean")
    write = lambda *rows: spark.createDataFrame(list(rows), "kind string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: [(r.rule_id, r.probed_at.hour, r.matched, r.rows_in) for r in jobs.probe_rules(jobs.file_stream(spark, str(tmp_path / "in"), "kind string, ts timestamp", 1), str(tmp_path / "s"), rules, calendar, "kind").orderBy("probed_at", "rule_id").collect()]
    write(("a", at(1, 5)))
    want = [(1, 5, False, 1)]
    assert run() == want
    write(("a", at(1, 5, 30)))  # too soon for rule 1, and rule 2 is outside its window
    assert run() == want
    write(("a", at(1, 7)), ("b", at(1, 7)))
    want += [(1, 7, True, 3), (2, 7, True, 1)]
    assert run() == want and run() == want
    write(("a", at(1, 9)))
    want += [(1, 9, True, 4), (2, 9, True, 1)]
    assert run() == want
    write(("a", at(1, 11)))  # rule 1 has matched twice today
    want += [(2, 11, True, 1)]
    assert run() == want
    write(("a", at(2, 11)))
    want += [(1, 11, False, 1), (2, 11, True, 1)]
    assert run() == want
