"""Literal cases of rules: dates and their sources, adjustment, masters, snapshots, policies, mappings, landed files, counts and reports."""

import datetime as dt
import math
import random
from decimal import ROUND_HALF_EVEN, Decimal
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tapeworks import plans
from tapeworks.functions import scalars
from tapeworks.operators import bars, boards, health, indicators, resolution
from tapeworks.sources import ingest

D = dt.date
SMALL = Path("/root/testdata/sf0.01")


def test_a_source_is_named_where_its_date_is_the_latest(spark):
    spec = spark.createDataFrame([(k, "daily", k in "gh", k not in "ij") for k in "abcdefghij"], "dataset string, cadence string, observed_only boolean, has_date boolean")
    rows = lambda **by: spark.createDataFrame([(k, D(2024, 1, n)) for k, n in by.items()], "dataset string, date date")
    state, seen, synced = rows(a=5, b=5, c=3, d=5, g=9, h=9, j=2), rows(a=5, b=3, c=5, e=4, g=4), rows(a=9, f=9, i=8, j=8)
    got = {r.dataset: (r.latest and r.latest.day, r.date_source) for r in health.freshness(spec, seen, state, spark.createDataFrame([(D(2024, 1, 9),)], "last_open date"), "2024-01-09", synced).collect()}
    assert got == {
        "a": (5, "state+observed"), "b": (5, "state"), "c": (5, "observed"), "d": (5, "state"), "e": (4, "observed"), "f": (None, "none"),
        "g": (4, "observed"), "h": (9, "state"), "i": (8, "sync_date"), "j": (2, "state"),
    }


def test_changes_are_scaled_with_their_prices(spark):
    bar = lambda *xs: [None if x is None else Decimal(x) for x in xs]
    daily = spark.createDataFrame([("a", D(2024, 1, 2), *bar("10", "1.0", None)), ("a", D(2024, 1, 3), *bar("11.0001", "-0.0001", "9"))], "ts_code string, trade_date date, close decimal(18,4), change_amount decimal(18,4), pre_close decimal(18,4)")
    factors = spark.createDataFrame([("a", D(2024, 1, 2), Decimal(1)), ("a", D(2024, 1, 3), Decimal(2))], "ts_code string, trade_date date, adj_factor decimal(20,8)")
    got = {r.trade_date.day: (r.close, r.change_amount, r.pre_close) for r in bars.adjusted(daily, factors).collect()}
    assert got == {2: tuple(bar("5", "0.5", None)), 3: tuple(bar("11.0001", "-0.0001", "9"))}
    back = {r.trade_date.day: (r.close, r.change_amount) for r in bars.adjusted(daily, factors, forward=False).collect()}
    assert back[3] == (Decimal("22.0002"), Decimal("-0.0002"))


def test_adjusted_prices_round_half_to_even(spark):
    rng = random.Random(2)
    rows = [("a", D(2024, 1, 1) + dt.timedelta(i), Decimal(rng.randint(1, 10**7)) / 10**4, Decimal(rng.randint(1, 16)) / 8) for i in range(60)]
    daily = spark.createDataFrame([r[:3] for r in rows], "ts_code string, trade_date date, close decimal(18,4)")
    factors = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "ts_code string, trade_date date, adj_factor decimal(20,8)")
    got = {r.trade_date: r.close for r in bars.adjusted(daily, factors).collect()}
    assert got == {d: (c * f / rows[-1][3]).quantize(Decimal("0.0001"), ROUND_HALF_EVEN) for _, d, c, f in rows}


def test_masters_with_null_names_are_on_both_sides(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "ts_code string, name string, exchange string")
    a = side(("1", None, "SSE"), ("2", None, None), ("3", "x　y", " sse "), ("4", "x", "SZ"), ("5", "only", None), ("7", "p q", "BSE"))
    b = side(("1", "name", "SSE"), ("2", "  ", ""), ("3", "xy", "SH"), ("4", "x", None), ("6", None, None), ("7", "pq", "BJ"))
    assert {r.ts_code: r.result for r in resolution.compare_masters(a, b, "ts_code").collect()} == {"1": "diff", "2": "same", "3": "same", "4": "diff", "5": "only_a", "6": "only_b", "7": "same"}


def test_white_space_of_any_script(spark):
    texts = ["a　b c d\x1ce\x85f", " \t", None, "plain"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.n, r.s) for r in rows.select("i", scalars.plain_name(F.col("t")).alias("n"), scalars.failure_summary(F.col("t")).alias("s")).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: "".join((t or "").split()) for i, t in enumerate(texts)}
    assert {i: g[1] for i, g in got.items()} == {i: t and " ".join(t.split()) for i, t in enumerate(texts)}  # blank is empty, not null


def test_each_index_keeps_its_own_last_snapshot(spark):
    rows = spark.createDataFrame([("i", D(2024, 1, 1), "old"), ("i", D(2024, 1, 5), "x"), ("i", D(2024, 1, 5), "y"), ("i", D(2024, 1, 9), "later"), ("j", D(2024, 1, 2), "z"), ("k", D(2024, 1, 8), "none")], "index_code string, trade_date date, con_code string")
    got = {(r.index_code, r.con_code) for r in boards.latest_sets(rows, "index_code", "trade_date", "2024-01-06").collect()}
    assert got == {("i", "x"), ("i", "y"), ("j", "z")}


def test_dates_in_all_tables_and_the_last_of_them(spark):
    day = lambda *ns: spark.createDataFrame([(D(2024, 1, n),) for n in ns], "trade_date date")
    calendar = spark.createDataFrame([(D(2024, 1, n), n != 3) for n in range(1, 9)], "trade_date date, is_open boolean")
    tables = [day(1, 2, 3, 4, 5, 6), day(2, 3, 4, 6, 7)]
    days = lambda last: sorted(r.trade_date.day for r in boards.dates_in_all(calendar, tables, last).collect())
    assert days(None) == days(0) == days(9) == [2, 4, 6] and days(2) == [4, 6]


def brute_policy(candidates, policy, active):
    """The row that a policy makes of {source: row}."""
    if not policy["enabled"]:
        return None
    found = {s: r for s, r in candidates.items() if not active or s in active}
    if not found:
        return None
    chain = [s for s in dict.fromkeys([policy["primary"], *policy["fallbacks"]]) if s]
    first = next((s for s in chain if s in found), min(found))
    if policy["mode"] == "freshness_first":
        key = lambda s: (found[s][policy["fresh"]] is not None, found[s][policy["fresh"]] or D(1, 1, 1), -(chain.index(s) if s in chain else 10_000))
        best = max(key(s) for s in found)
        first = min(s for s in found if key(s) == best)
    row = dict(found[first])
    if policy["mode"] == "field_merge":
        for field, (sources, skip) in policy["rules"].items():
            pick = next((s for s in sources if s in found and not (skip and found[s][field] is None)), None)
            row[field] = found[pick][field] if pick else row[field]
    return (first, row["x"], row["y"], ",".join(sorted(found)), policy["mode"], policy["version"])


def test_policies_match_brute_force(spark):
    rng = random.Random(9)
    policies, active, rows = {}, {}, []
    for i in range(40):
        mode = ["primary", "fallback", "primary_fallback", "field_merge", "freshness_first"][i % 5]
        pick = lambda k: rng.choices(["a", "b", "c", "d", ""], k=k)
        policies[f"s{i}"] = {"mode": mode, "primary": rng.choice("abz"), "fallbacks": pick(rng.randint(0, 3)), "rules": {f: (pick(2), rng.random() < 0.5) for f in rng.sample(["x", "y"], rng.randint(0, 2))}, "fresh": "seen", "version": i, "enabled": i % 7 != 3}
        active[f"s{i}"] = set(rng.sample("abcd", rng.randint(0, 3)))
        for key in range(6):
            for source in rng.sample("abcde", rng.randint(1, 4)):
                rows.append((f"s{i}", f"k{key}", source, rng.choice([None, 1, 2, 3]), rng.choice([None, "p", "q"]), rng.choice([None, D(2024, 1, 1), D(2024, 1, 2)])))
    rows += [("nopolicy", "k", "a", 1, "p", None), ("s0", " ", "a", 1, "p", None), ("s0", None, "a", 1, "p", None)]
    frame = spark.createDataFrame(rows, "dataset string, key string, source string, x int, y string, seen date")
    table = spark.createDataFrame([(d, p["mode"], p["primary"], p["fallbacks"], p["rules"], p["fresh"], p["version"], p["enabled"]) for d, p in policies.items()], resolution.POLICY)
    status = spark.createDataFrame([(d, s, s in on) for d, on in active.items() for s in "abcd"], "dataset string, source string, is_active boolean")
    got = {(r.dataset, r.key): (r.source, r.x, r.y, r.candidate_sources, r.resolution_mode, r.resolution_policy_version) for r in resolution.resolve_by_policy(frame, ["key"], table, status).collect()}
    want = {}
    for d, p in policies.items():
        for k in {r[1] for r in rows if r[0] == d and (r[1] or "").strip()}:
            own = {r[2]: {"x": r[3], "y": r[4], "seen": r[5]} for r in rows if r[:2] == (d, k)}
            found = brute_policy(own, p, active[d])
            if found:
                want[d, k] = found
    assert got == want and {w[4] for w in want.values()} == {p["mode"] for p in policies.values()} and not any(d in got for d in policies if not policies[d]["enabled"])
    everything = resolution.resolve_by_policy(frame, ["key"], table)
    assert everything.count() == sum(len({r[1] for r in rows if r[0] == d and (r[1] or "").strip()}) for d, p in policies.items() if p["enabled"])
    with pytest.raises(Exception, match="no such mode: odd"):
        resolution.resolve_by_policy(frame, ["key"], table.withColumn("mode", F.lit("odd"))).collect()


def test_rules_of_other_sources_and_inactive_ones_have_no_effect(spark):
    rules = [("d", "a", "old", "code", "string", "active"), ("d", "a", "n", "size", "int", "inactive"), ("d", "b", "n", "size", "int", "active"), ("e", "a", "n", "code", "string", "active"), ("d", "c", "x", "code", "string", "inactive")]
    frames = {("d", "a"): spark.createDataFrame([("k", 1)], "old string, n int"), ("d", "b"): spark.createDataFrame([(2, 0)], "n int, code int"), ("d", "c"): spark.createDataFrame([("never",)], "x string")}
    table = spark.createDataFrame(rules, ingest.RULES)
    assert {tuple(r) for r in ingest.map_by_rules(frames, table).select("dataset", "source", "code", "size").collect()} == {("d", "a", "k", None), ("d", "b", None, 2)}
    with pytest.raises(ValueError, match="code is string and int"):
        ingest.map_by_rules(frames, spark.createDataFrame([*rules, ("d", "b", "n", "code", "int", "active")], ingest.RULES))
    with pytest.raises(ValueError, match="no active rule"):
        ingest.map_by_rules({("d", "c"): frames["d", "c"]}, table)


def test_broken_files_are_kept_aside(spark, tmp_path):
    files = {"a.json": '{"fields": ["x", "y"], "items": [["1", "2"],\n ["3", null]]}', "b.json": '{"fields": ["x"], "items": [["4"', "c.json": '{"error": "no data"}', "d.json": "", "e.json": "oops", "f.json": '{"fields": ["y"], "items": []}'}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    whole, broken = ingest.quarantined(ingest.read_landed(spark, str(tmp_path)))
    assert sorted((r.x, r.y) for r in ingest.decode_envelope(whole, "payload", ["x", "y"]).collect()) == [("1", "2"), ("3", None)]
    assert {(Path(r.file).name, r.payload, r.bytes) for r in broken.collect()} == {(n, files[n], len(files[n])) for n in ("b.json", "e.json")}  # a file of no bytes has nothing to read
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.json").write_text('[{"code": 1}, "x", {"code": 2}]\n\n[{"code": 3}\n{"error": 1}\n')
    whole, broken = ingest.quarantined(ingest.read_landed(spark, str(tmp_path / "lines"), lines=True))
    assert sorted(r.code for r in ingest.decode_list(whole, "payload", "code int").collect()) == [1, 2] and [r.payload for r in broken.collect()] == ['[{"code": 3}']


def test_counts_are_seen_in_the_same_pass(spark):
    seen = Observation()
    rows = ingest.split_required(spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (3, "c")], "k int, v string"), ["k", "v"], seen)
    assert sorted(r.k for r in rows.collect()) == [1, 3] and seen.get == {"skipped": 2, "kept": 2}
    seen = Observation()
    day = D(2024, 1, 1)
    dividends = [("实施", None, 1, 0), ("实施", None, None, 2), ("实施", day, 1, 1), ("预案", None, 1, 1), ("实施", None, 0, None)]
    frame = spark.createDataFrame([(p, e, D(2024, 2, 1), D(2024, 3, 1), s, c) for p, e, s, c in dividends], "div_proc string, ex_date date, record_date date, pay_date date, stk_div int, cash_div int")
    assert [r.filled for r in ingest.fill_dividend_dates(frame, seen).collect()] == ["record_date", "pay_date", None, None, None] and seen.get == {"by_record_date": 1, "by_pay_date": 1}


def test_a_day_report_is_of_that_day_alone(spark):
    t = lambda day, hour, minute=0: dt.datetime(2024, 1, day, hour, minute, tzinfo=dt.timezone.utc)
    executions = spark.createDataFrame([(i, "job", s, t(d, h), t(d, h), f" why {i}") for i, (s, d, h) in enumerate([("failed", 4, 15), ("FAILED", 4, 16), ("running", 5, 1), ("running", 5, 15), ("queued", 5, 2), ("success", 5, 15), ("failed", 5, 16)])], "id long, name string, status string, requested_at timestamp, started_at timestamp, message string")
    runs = spark.createDataFrame([("x", i, s, t(d, h), f, w) for i, (s, d, h, f, w) in enumerate([("SUCCESS", 4, 15, 9, 0), ("SUCCESS", 4, 20, 5, 0), ("FAILED", 5, 3, 2, 0)])] + [("y", 9, "SUCCESS", t(5, 1), 1, 1)], "dataset string, event_id long, status string, started_at timestamp, rows_fetched long, rows_written long")
    fresh = spark.createDataFrame([(f"d{i}", "stale" if i < 10 else "fresh", i) for i in range(12)], "dataset string, status string, lag_days int")
    rows = health.day_report(executions, runs, fresh, "2024-01-05", "Asia/Shanghai", "2024-01-05 15:20:00").collect()
    by = lambda s: [(r.name, r.n) for r in sorted((r for r in rows if r.section == s), key=lambda r: r.place)]
    assert by("freshness") == [("total", 12), ("fresh", 2), ("lagging", 0), ("stale", 10), ("unknown", 0), ("disabled", 0)]
    assert by("execution") == [("total", 5), ("success", 1), ("failed", 1), ("running", 2), ("queued", 1)] and by("run") == [("x", 2), ("y", 1)]
    alerts = by("alert")
    assert [a for a, _ in alerts] == [*[f"stale:d{i}" for i in range(9, 1, -1)], "failed:job#1", "running_long:job#2", "nothing_written:x"] and alerts[-2][1] == 860 and alerts[-1][1] == 7


def test_lists_and_totals_of_freshness(spark):
    fresh = spark.createDataFrame([("m", "a", "fresh", 0), ("m", "b", "stale", 3), ("m", "c", "stale", 9), ("n", "d", "lagging", 50), ("n", "e", "unknown", None), ("n", "f", "disabled", None), ("n", "g", "lagging", 50)], "domain string, dataset string, status string, lag_days int")
    assert [r.dataset for r in health.lagging(fresh).collect()] == ["c", "b", "d", "g"]
    assert {(r.dataset, r.place) for r in health.grouped(fresh).collect()} == {("c", 1), ("b", 2), ("a", 3), ("d", 1), ("g", 2), ("e", 3), ("f", 4)}
    assert {(r.domain, r.is_total, r.total, r.stale, r.lagging, r.disabled) for r in health.summary(fresh).collect()} == {("m", False, 3, 2, 0, 0), ("n", False, 4, 0, 2, 1), (None, True, 7, 2, 2, 1)}


def brute_last_indicators(rows):
    """Recursive indicators of the last of (high, low, close) rows, one row after the other."""
    fast = slow = dea = None
    k = d = 50.0
    for i, (_, _, c) in enumerate(rows):
        fast = c if fast is None else fast + 2 / 13 * (c - fast)
        slow = c if slow is None else slow + 2 / 27 * (c - slow)
        dif = fast - slow
        dea = dif if dea is None else dea + 2 / 10 * (dif - dea)
        top, low = max(h for h, _, _ in rows[max(0, i - 8) : i + 1]), min(x for _, x, _ in rows[max(0, i - 8) : i + 1])
        rsv = 50.0 if top == low else (c - low) / (top - low) * 100
        k = 2 / 3 * k + rsv / 3
        d = 2 / 3 * d + k / 3
    return {"dif": dif, "dea": dea, "macd": 2 * (dif - dea), "k": k, "d": d, "j": 3 * k - 2 * d, "ema12": fast, "ema26": slow}


def test_headers_match_brute_force_and_fall_back(spark):
    rng = random.Random(3)
    made = {code: [(round(c + rng.random(), 2), round(c - rng.random(), 2), round(c, 2)) for c in (10 + 3 * math.sin(i / 9) + rng.random() for i in range(n))] for code, n in (("whole", 300), ("hole", 40), ("one", 1))}
    day = lambda i: D(2023, 1, 1) + dt.timedelta(i)
    rows = [(code, day(i), float(h), float(x), float(c), float(c), 5.0) for code, own in made.items() for i, (h, x, c) in enumerate(own)]
    plain = spark.createDataFrame(rows, "ts_code string, trade_date date, high double, low double, close double, pre_close double, vol double")
    factors = spark.createDataFrame([(code, day(i), Decimal(1 if i < 290 else 2)) for code, own in made.items() for i in range(len(own)) if (code, i) != ("hole", 7)], "ts_code string, trade_date date, adj_factor decimal(20,8)")
    decimals = plain.withColumns({c: F.col(c).cast("decimal(18,4)") for c in ("high", "low", "close", "pre_close")})
    adjusted = bars.adjusted(decimals, factors).withColumns({c: F.col(c).cast("double") for c in ("high", "low", "close", "pre_close")})
    basic = spark.createDataFrame([("whole", day(299), 1.5)], "ts_code string, trade_date date, turnover_rate double")
    got = {r.ts_code: r for r in indicators.header(adjusted, plain, basic).collect()}
    assert {c: r.adjustment for c, r in got.items()} == {"whole": "forward", "hole": "none", "one": "forward"} and got["whole"].turnover_rate == 1.5 and got["hole"].turnover_rate is None
    half = lambda x: float((Decimal(str(x)) / 2).quantize(Decimal("0.0001"), ROUND_HALF_EVEN))
    scaled = [tuple(half(x) for x in r) if i < 290 else r for i, r in enumerate(made["whole"])]
    for code, own in (("whole", scaled), ("hole", made["hole"]), ("one", made["one"])):
        recent = own[-250:]
        for name, value in brute_last_indicators(recent).items():
            assert abs(got[code][name] - value) < 1e-3, (code, name)
        want = sum(c for _, _, c in recent[-5:]) / 5 if len(recent) >= 5 else None
        assert got[code].ma5 == want or abs(got[code].ma5 - want) < 1e-3
        assert got[code].trade_date == day(len(own) - 1) and got[code].bar_count == len(recent)


def test_every_case_of_the_mended_queries_occurs(spark):
    if not SMALL.exists():
        pytest.skip("no test tables here")
    values = lambda name, column: {r[0] for r in plans.QUERIES[name](spark, str(SMALL)).select(column).distinct().collect()}
    assert values("fr2_date_source", "date_source") >= {"state", "observed", "state+observed", "sync_date"}
    assert values("rc3_security_reconcile", "result") == {"only_a", "only_b", "diff", "same"}
    assert values("rs5_policy_table", "resolution_mode") == {"primary_fallback", "field_merge", "freshness_first", "fallback", "primary"}
    report = plans.QUERIES["fr8_day_report"](spark, str(SMALL)).collect()
    assert {r.section for r in report} == {"freshness", "execution", "run", "alert"} and {r.name.split(":")[0] for r in report if r.section == "alert"} >= {"stale", "failed"}
    assert values("ss2_probe_rules", "matched") == {True, False}
