"""Literal cases of the operators: ties, gaps, nulls, holes and empty inputs."""

import datetime as dt
import re
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks import plans
from tapeworks.functions import scalars
from tapeworks.operators import bars, breadth, indicators, resolution, upsert, walkforward
from tapeworks.sources import ingest

D = dt.date


def test_half_even_adjustment(spark):
    from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

    rows = [("10", "2", "4"), ("0.0001", "1", "2"), ("0.0003", "1", "2"), ("1.2345", "1.00000001", "3"), ("-0.0001", "1", "2"), ("99999999.9999", "123.45678901", "0.07"), ("5", "1", "0"), ("5", None, "1"), ("-7.7777", "1.5", "-2.5")]
    rows = [[None if x is None else Decimal(x) for x in r] for r in rows]
    df = spark.createDataFrame(rows, "p decimal(18,4), f decimal(20,8), e decimal(20,8)")
    got = df.select("*", bars.scaled_price(F.col("p"), F.col("f"), F.col("e")).alias("even"), bars.scaled_price(F.col("p"), F.col("f"), F.col("e"), even=False).alias("up")).collect()
    for r in got:
        exact = None if r.f is None or not r.e else r.p * r.f / r.e
        assert r.even == (exact and exact.quantize(Decimal("0.0001"), ROUND_HALF_EVEN)) and r.up == (exact and exact.quantize(Decimal("0.0001"), ROUND_HALF_UP)), r


def test_forward_adjustment_and_factor_hole(spark):
    price = Decimal("10.5")
    rows = [("a", D(2024, 1, 2), price, price), ("a", D(2024, 1, 3), Decimal(11), Decimal(11)), ("b", D(2024, 1, 2), price, price), ("b", D(2024, 1, 3), price, price)]
    daily = spark.createDataFrame(rows, "ts_code string, trade_date date, open decimal(18,4), close decimal(18,4)")
    factors = spark.createDataFrame([("a", D(2024, 1, 2), Decimal(1)), ("a", D(2024, 1, 3), Decimal(2)), ("b", D(2024, 1, 2), Decimal(1))], "ts_code string, trade_date date, adj_factor decimal(20,8)")
    got = {(r.ts_code, r.trade_date): r.close for r in bars.adjusted(daily, factors).collect()}
    assert got == {("a", D(2024, 1, 2)): 5.25, ("a", D(2024, 1, 3)): 11.0}
    assert [(r.ts_code, r.n_missing, r.first_dates) for r in bars.adjustment_gaps(daily, factors).collect()] == [("b", 1, [D(2024, 1, 3)])]


def test_upsert_keeps_the_last_and_skips_null_keys(spark):
    old = spark.createDataFrame([(1, "old", "c1"), (2, "old", "c2")], "k int, v string, created_at string")
    new = spark.createDataFrame([(1, "first", 1, "x"), (1, "second", 2, "y"), (3, "new", 1, None), (None, "lost", 9, None)], "k int, v string, seq int, extra string")
    got = {r.k: (r.v, r.created_at) for r in upsert.upsert(old, new, ["k"], ["seq"], keep_old=["created_at"]).collect()}
    assert got == {1: ("second", "c1"), 2: ("old", "c2"), 3: ("new", None)}


def test_as_of_takes_the_last_known_row(spark):
    left = spark.createDataFrame([("a", D(2024, 1, d)) for d in (1, 3, 5)], "ts_code string, trade_date date")
    right = spark.createDataFrame([("a", D(2024, 1, 2), 7), ("a", D(2024, 1, 5), None), ("b", D(2024, 1, 1), 9)], "ts_code string, trade_date date, v int")
    got = [(r.trade_date.day, r.v, r.asof_trade_date and r.asof_trade_date.day) for r in bars.as_of(left, right, ["ts_code"], "trade_date", ["v"]).orderBy("trade_date").collect()]
    assert got == [(1, None, None), (3, 7, 2), (5, None, 5)]


def test_ema_and_kdj_carry_state_over_nulls():
    nan = float("nan")
    assert np.allclose(indicators.ema(np.array([nan, 2.0, nan, 4.0]), 3), [nan, 2.0, nan, 3.0], equal_nan=True)
    k, d, j = indicators.kdj(np.array([5.0, 5.0, 5.0]), np.array([5.0, 5.0, 5.0]), np.array([5.0, nan, 5.0]))
    assert np.allclose(k, [50.0, nan, 50.0], equal_nan=True) and np.allclose(j, [50.0, nan, 50.0], equal_nan=True)


def test_preheated_average(spark):
    rows = [("a", D(2024, 1, d), Decimal(c)) for d, c in enumerate(("10.0", "10.1", "10.2", "10.3", "10.4"), 1)]
    got = spark.createDataFrame(rows, "ts_code string, trade_date date, close decimal(18,4)").withColumn("ma5", indicators.sma("close", 5)).where("trade_date = '2024-01-05'").first()
    assert abs(got.ma5 - 10.2) < 1e-9


def test_streak_is_broken_by_an_absent_day(spark):
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 4, True), ("a", 5, False), ("a", 6, True)], "ts_code string, n int, close_up boolean")
    assert [r.streak for r in breadth.streaks(rows).orderBy("n").collect()] == [1, 2, 1, 0, 1]


def test_median_needs_a_sample(spark):
    few, even = spark.range(4).select(F.col("id").cast("double").alias("x")), spark.range(6).select(F.col("id").cast("double").alias("x"))
    assert few.agg(breadth.median_of(F.col("x")).alias("m")).first().m is None and even.agg(breadth.median_of(F.col("x")).alias("m")).first().m == 2.5


def test_rank_correlation_with_ties_and_constants(spark):
    rows = [("t", 1.0, 10.0), ("t", 2.0, 20.0), ("t", 2.0, 20.0), ("t", 3.0, 30.0), ("c", 1.0, 5.0), ("c", 2.0, 5.0), ("c", 3.0, 5.0), ("f", 1.0, 1.0), ("f", 2.0, None)]
    got = {r.g: r.ic for r in walkforward.rank_correlation(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ("g",)).collect()}
    assert abs(got["t"] - 1) < 1e-9 and got["c"] is None and got["f"] is None


def test_resolution_modes(spark):
    rows = [("k", "a", None, 5, D(2024, 1, 1)), ("k", "b", 2, None, D(2024, 1, 3)), ("only", "c", 9, 9, None), (" ", "a", 1, 1, None)]
    frame = spark.createDataFrame(rows, "key string, source string, x int, y int, seen date")
    by = {s: frame.where(F.col("source") == s).drop("source") for s in "abc"}
    cand = resolution.candidates(by, ["key"])
    first = {r.key: (r.source, r.x, r.source_candidates) for r in resolution.resolve(cand, ["key"], ["a", "b"]).collect()}
    assert first == {"k": ("a", None, "a,b"), "only": ("c", 9, "c")}
    merged = {r.key: (r.x, r.y) for r in resolution.merge_fields(cand, ["key"], ["a", "b"], {"x": ["a", "b"], "y": ["b", "a"]}, skip_nulls=["y"]).collect()}
    assert merged["k"] == (None, 5)
    fresh = {r.key: r.source for r in resolution.resolve(cand, ["key"], ["a", "b"], freshness="seen").collect()}
    assert fresh == {"k": "b", "only": "c"}
    assert {(r.key, r.field) for r in resolution.conflicts(cand, ["key"], ["x", "y"]).collect()} == {("k", "x"), ("k", "y")}


def test_reconcile_counts(spark):
    a = spark.createDataFrame([(1, 100.0), (2, 100.0), (3, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 100.5), (2, 150.0), (4, 1.0)], "k int, v double")
    got = {r.k: (r.presence, r.n_violations, r.worst) for r in resolution.compare(a, b, ["k"], ["v"]).collect()}
    assert got == {1: ("both", 0, None), 2: ("both", 1, "v"), 3: ("only_a", 0, None), 4: ("only_b", 0, None)}


def test_bad_dates_are_errors(spark):
    good = spark.createDataFrame([("20240131",), ("2024-01-31",), ("",), (None,)], "d string")
    assert [r.d for r in ingest.coerce(good, {"d": "date"}).collect()] == [D(2024, 1, 31), D(2024, 1, 31), None, None]
    with pytest.raises(Exception, match="soon"):
        ingest.coerce(spark.createDataFrame([("soon",)], "d string"), {"d": "date"}).collect()


def test_reasons_and_hashes(spark):
    rows = spark.createDataFrame([("Ａ　 b",), ("A b",), ("  ",), (None,)], "r string").select(scalars.plain_reason(F.col("r")).alias("r"), scalars.reason_hash(F.col("r")).alias("h")).collect()
    assert [r.r for r in rows] == ["A b", "A b", None, None] and rows[0].h == rows[1].h and rows[3].h is None


def test_settled_characters_are_their_own_normal_form(spark):
    import re
    import unicodedata

    settled = [c for c in map(chr, range(0x110000)) if re.match(scalars._SETTLED, c)]
    pairs = [unicodedata.decomposition(chr(c)).split() for c in range(0x110000)]
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    assert len(settled) > 20_000 and all(unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c) and c not in seconds for c in settled)
    texts = ["Größe “ein”  – да", "e\u0301\u00a0x", "ﬁn", "が"]
    assert [r.r for r in spark.createDataFrame([(t,) for t in texts], "r string").coalesce(1).select(scalars.plain_reason(F.col("r")).alias("r")).collect()] == ["Größe “ein” – да", "é x", "fin", "が"]


def test_backfill_reads_hashes_once(spark):
    rows = spark.createDataFrame([(1, "é\u00a0", None), (2, "b", None)], "id long, text string, stored string").withColumn("hash", scalars.reason_hash(F.col("text")))
    found, _ = upsert.backfill_reason_hash(rows, ["id"], "id", "hash", "stored")
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 2


def test_reason_queries_read_whole_texts(spark, tmp_path):
    import hashlib
    import re
    import unicodedata

    from tapeworks import plans

    texts = ["License X\nfirst", "License X\nsecond", "\nafter an empty line", "Ｌicense  X\n\tsecond ", "\n \n", "", None, "abc, def\nghi"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    reasons = {i: re.sub(r"[ \t\n\x0b\f\r]+", " ", unicodedata.normalize("NFKC", t or "")).strip(" ") or None for i, t in enumerate(texts)}
    hashes = {i: r and hashlib.sha256(r.encode()).hexdigest() for i, r in reasons.items()}
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.reason for r in run("sc5_plain_reason")} == reasons
    assert {r.doc_id: r.reason_hash for r in run("sc7_reason_hash")} == hashes
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    held = [h for h in hashes.values() if h]
    state = lambda h: "skipped" if h is None else "conflict" if held.count(h) > 1 else "refused" if len(set(held)) < len(held) else "updated"
    assert {r.doc_id: (r.hash, r.state) for r in run("rc6_reason_hash_backfill")} == {i: (h, state(h)) for i, h in hashes.items() if i % 3 or h is None}


def test_probe_counts_rows_of_all_batches(spark, tmp_path):
    from tapeworks.streaming import jobs

    day = lambda n, k: dt.datetime(2024, 1, n, k % 24, k % 60)
    late, early = [("a", day(20, k)) for k in range(600)], [("a", day(n, k)) for n in (1, 2, 9) for k in range(70)]
    early += [("b", day(2, k)) for k in range(59)] + [("a", day(19, k)) for k in range(70)] + [(None, None)]
    late += [("a", day(n, 30)) for n in (1, 2)]
    for rows, files in ((late, 150), (early, 30)):  # the later days' files are read first, in a batch of their own
        spark.createDataFrame(rows, "kind string, ts timestamp").repartition(files).write.mode("append").parquet(str(tmp_path / "in"))
    assert len(list((tmp_path / "in").glob("*.parquet"))) > 100
    read = lambda: sorted((r.day.day, r.kind, r.n, r.latest) for r in jobs.probe(jobs.file_stream(spark, str(tmp_path / "in"), "kind string, ts timestamp"), str(tmp_path / "out"), "kind", 60).collect())
    last = lambda n, extra: max(day(n, k) for k in [*range(70), *extra])
    want = [(1, "a", 71, last(1, [30])), (2, "a", 71, last(2, [30])), (9, "a", 70, last(9, []))]
    assert read() == want
    assert read() == want  # no new files


@pytest.mark.parametrize("hidden", ["xxhash", "tapeworks.llm", "corpus_pipeline"])
def test_entry_without_the_training_operators(hidden):
    """The market queries are there where the subpackage, the pipeline or a library that they need can't be imported."""
    code = f"import sys; sys.modules['{hidden}'] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'bar4_weekly_bars' in q and 'bar4_weekly_bars' in s and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and int(done.stdout) >= 180, done.stderr[-1000:]


def test_a_required_code_is_an_error(spark):
    codes = spark.createDataFrame([("600000",), (" 430001 ",), ("000001",), ("a.b",), ("12",)], "c string")
    assert [r[0] for r in codes.select(scalars.market_code(F.col("c"), required=True)).collect()] == ["600000.SH", "430001.BJ", "000001.SZ", "A.B", "12"]
    for empty in ("", "  ", None):
        with pytest.raises(Exception, match="no code"):
            spark.createDataFrame([(empty,)], "c string").select(scalars.market_code(F.col("c"), required=True)).collect()


def test_every_case_of_changed_queries_occurs(spark):
    folder = "/root/testdata/sf0.01"
    if not Path(folder).exists():
        pytest.skip("no test tables here")
    values = lambda name, column: {r[0] for r in plans.QUERIES[name](spark, folder).select(column).distinct().collect()}
    assert values("fr6_layer_matrix", "layer_status") >= {"skipped", "unobserved", "stale", "unknown"} and values("fr6_layer_matrix", "source_key") == {"__all__", "b"}
    assert values("fr9_stale_runs", "new_status") == {"canceled", "failed"} and values("fr9_stale_runs", "previous_status") == {"queued", "running", "canceling"}
    assert values("bar2_adjustment_gaps", "reason") == {"missing_factor", "missing_anchor"}
    assert len({(s or "")[:9] for s in values("sc19_error_kind", "summary")}) >= 6
    attention = plans.QUERIES["fr10_attention"](spark, folder)
    assert attention.where("failed_at is not null").count() and attention.where("failed_at is null").count()
    assert {r.security_type for r in plans.QUERIES["jn15_name_chain"](spark, folder).where("name is null").select("security_type").distinct().collect()} >= {"INDEX"}
    filled = plans.QUERIES["jn12_unique_match"](spark, folder).where("c_custkey % 3 != 0")
    assert 0 < filled.where("code is not null").count() < filled.count()
    assert {r.p for r in plans.QUERIES["dm3_board_review"](spark, folder).select(F.col("provider").alias("p")).distinct().collect()} == {"ths", "dc"}


def brute_hash(text):
    import hashlib
    import unicodedata

    plain = " ".join(w for w in re.split(r"[ \t\n\x0b\f\r]+", unicodedata.normalize("NFKC", text or "")) if w)
    return plain or None, hashlib.sha256(plain.encode()).hexdigest() if plain else None


def test_reasons_and_backfill_match_brute_force(spark):
    rows = [(1, "k", "same first line\nand more", None), (2, "k", "same first line\nbut other", None), (3, "k", "ｗｉｄｅ，\tA\n b ", None), (4, "m", "wide, A b", None), (5, "k", None, None), (6, "k", " \n", None), (7, "n", "stored", "x"), (8, None, "ﬁne", None)]
    df = spark.createDataFrame(rows, "id long, key string, text string, stored string").withColumn("hash", scalars.reason_hash(F.col("text"))).withColumn("plain", scalars.plain_reason(F.col("text")))
    assert {r.id: (r.plain, r.hash) for r in df.collect()} == {i: brute_hash(t) for i, _, t, _ in rows}
    found, counts = upsert.backfill_reason_hash(df, ["key"], "id", "hash", "stored")
    assert {r.id: r.state for r in found.collect()} == {1: "updated", 2: "updated", 3: "updated", 4: "updated", 5: "skipped", 6: "skipped", 8: "updated"}
    assert counts.first().asDict() == {"scanned": 7, "updated": 5, "skipped": 2, "conflicts": 0}
    twice = df.withColumn("key", F.lit("one"))
    found, counts = upsert.backfill_reason_hash(twice, ["key"], "id", "hash", "stored")
    assert {r.id: r.state for r in found.collect()} == {1: "refused", 2: "refused", 3: "conflict", 4: "conflict", 5: "skipped", 6: "skipped", 8: "refused"} and counts.first().conflicts == 1


def test_vendor_shapes_of_securities(spark):
    b = spark.createDataFrame([(" 600000.SH ", " name ", "SH"), ("000001", None, " ")], "dm string, mc string, jys string")
    got = [tuple(r) for r in resolution.standard_security(b, "b").collect()]
    assert got == [("600000.SH", "600000", "name", "SH", "L", "EQUITY", "b"), ("000001", "000001", "000001", None, "L", "EQUITY", "b")]
    with pytest.raises(Exception, match="no dm"):
        resolution.standard_security(spark.createDataFrame([("", "x", "y")], b.schema), "b").collect()


def test_shared_market_views_are_computed_once(spark):
    from tapeworks.plans.views import Market

    m = Market(spark, "/root/testdata/sf0.001")
    for view in (m.dc_member, m.moneyflow_a, m.moneyflow_b):
        assert "lineitem.parquet" not in view._jdf.queryExecution().executedPlan().toString()


def test_header_adjusts_prices_once(spark, monkeypatch):
    from tapeworks.operators import indicators

    rows = [(1, D(2024, 1, i), float(i), float(i), float(i), 1.0) for i in range(1, 5)]
    bars = spark.createDataFrame(rows, "ts_code int, trade_date date, high double, low double, close double, vol double")
    basic = spark.createDataFrame([], "ts_code int, trade_date date, turnover_rate double")
    seen = []
    kline = indicators.kline
    monkeypatch.setattr(indicators, "kline", lambda recent, *rest: seen.append(recent._jdf.queryExecution().executedPlan().toString()) or kline(recent, *rest))
    assert [(r.close, r.adjustment) for r in indicators.header(bars.where("false"), bars, basic).collect()] == [(4.0, "none")]
    assert "Window" not in seen[0] and "Join" not in seen[0]
