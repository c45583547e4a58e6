"""Queries over resolution, reconciliation, health and boards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeworks.lineage import cut
from tapeworks.operators import boards, health, resolution
from tapeworks.plans.registry import query
from tapeworks.plans.views import AMOUNTS, SQL_VIEWS

KEYS = ["ts_code", "trade_date"]
_SUM = lambda side: " + ".join(f"coalesce({side}_{t}_amount, 0)" for t in ("sm", "md", "lg", "elg"))
_SOME = lambda side: f"coalesce({', '.join(f'{side}_{t}_amount' for t in ('sm', 'md', 'lg', 'elg'))}) IS NOT NULL"
_NET = f"CASE WHEN {_SOME('buy')} OR {_SOME('sell')} THEN CAST({_SUM('buy')} - ({_SUM('sell')}) AS DECIMAL(24,4)) END"
SQL_VIEWS |= {
    "std_a": f"SELECT *, {_NET} AS net_amount FROM moneyflow_a",
    "std_b": f"SELECT *, {_NET} AS net_amount FROM moneyflow_b",
    "cand": "SELECT *, 'a' AS source FROM std_a UNION ALL BY NAME SELECT *, 'b' AS source FROM std_b",
}
_BUYS, _SELLS = [c for c in AMOUNTS if c.startswith("buy")], [c for c in AMOUNTS if c.startswith("sell")]


def std(rows):
    return resolution.standardise_flow(rows, _BUYS, _SELLS)


def cand(m):
    return resolution.candidates({"a": std(m.moneyflow_a), "b": std(m.moneyflow_b)}, KEYS)


@query("rs1_standard_a", "SELECT ts_code, trade_date, buy_sm_amount, net_amount FROM std_a")
def rs1(m):
    return std(m.moneyflow_a).select(*KEYS, "buy_sm_amount", "net_amount")


@query("rs2_standard_b", "SELECT ts_code, trade_date, buy_sm_amount, net_amount FROM std_b")
def rs2(m):
    return std(m.moneyflow_b).select(*KEYS, "buy_sm_amount", "net_amount")


@query(
    "rs3_standard_security",
    """SELECT CAST(ts_code AS VARCHAR) AS ts_code, CAST(ts_code AS VARCHAR) AS symbol, name, exchange, list_status, 'EQUITY' AS security_type, 'a' AS source FROM security
    UNION ALL SELECT p_partkey || '.SZ', CAST(p_partkey AS VARCHAR), CASE WHEN p_size % 6 = 0 THEN p_partkey || '.SZ' ELSE trim(p_name) END, CASE WHEN p_size % 4 <> 0 THEN p_brand END, 'L', 'EQUITY', 'b' FROM part""",
)
def rs3(m):
    a = m.security.select(F.col("ts_code").cast("string").alias("ts_code"), F.col("ts_code").cast("string").alias("symbol"), "name", "exchange", "list_status")
    code = F.concat(F.lit(" "), F.col("p_partkey").cast("string"), F.lit(".SZ"))
    b = m.table("part").select(code.alias("dm"), F.when(F.col("p_size") % 6 != 0, F.concat("p_name", F.lit(" "))).alias("mc"), F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_brand")).alias("jys"))
    return resolution.standard_security(a, "a").unionByName(resolution.standard_security(b, "b"))


@query("rs4_candidates", "SELECT ts_code, trade_date, source, net_amount FROM cand")
def rs4(m):
    return resolution.last_of_source(cand(m), KEYS, [F.col("net_amount")]).select(*KEYS, "source", "net_amount")


_PRIORITY = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts_code, trade_date ORDER BY CASE source WHEN '{first}' THEN 0 ELSE 1 END) AS p, string_agg(source, ',') OVER (PARTITION BY ts_code, trade_date ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS source_candidates FROM cand) WHERE p = 1"


@query("rs5_priority", f"SELECT ts_code, trade_date, net_amount, source FROM ({_PRIORITY.format(first='b')})")
def rs5(m):
    return resolution.resolve(cand(m), KEYS, ["b", "a"]).select(*KEYS, "net_amount", "source")


@query(
    "rs9_provenance",
    f"""SELECT ts_code, trade_date, source, source_candidates AS candidate_sources, 'primary_fallback' AS resolution_mode, 3 AS resolution_policy_version,
    '{{"mode":"primary_fallback","version":3,"source":"' || source || '","candidates":["' || replace(source_candidates, ',', '","') || '"]}}' AS resolution_audit FROM ({_PRIORITY.format(first='a')})""",
)
def rs9(m):
    resolved = resolution.audited(resolution.resolve(cand(m), KEYS, ["a", "b"]), "primary_fallback", 3)
    return resolved.select(*KEYS, "source", "candidate_sources", "resolution_mode", "resolution_policy_version", "resolution_audit")


@query(
    "rs6_field_merge",
    """SELECT ts_code, trade_date, coalesce(a.source, b.source) AS source, CASE WHEN b.source IS NOT NULL THEN b.buy_sm_amount ELSE a.buy_sm_amount END AS buy_sm_amount, coalesce(b.buy_md_amount, a.buy_md_amount) AS buy_md_amount,
    CASE WHEN a.source IS NOT NULL THEN a.net_amount ELSE b.net_amount END AS net_amount FROM (SELECT * FROM cand WHERE source = 'a') a FULL JOIN (SELECT * FROM cand WHERE source = 'b') b USING (ts_code, trade_date)""",
)
def rs6(m):
    merged = resolution.merge_fields(cand(m), KEYS, ["a", "b"], {"buy_sm_amount": ["b", "a"], "buy_md_amount": ["b", "a"]}, skip_nulls=["buy_md_amount"])
    return merged.select(*KEYS, "source", "buy_sm_amount", "buy_md_amount", "net_amount")


@query(
    "rs7_freshness_first",
    "SELECT ts_code, arg_max(source, (trade_date, source = 'a')) AS source, max(trade_date) AS trade_date FROM (SELECT ts_code, source, max(trade_date) AS trade_date FROM cand GROUP BY ALL) GROUP BY ts_code",
)
def rs7(m):
    last = cand(m).groupBy("ts_code", "source").agg(F.max("trade_date").alias("trade_date"))
    return resolution.resolve(last, ["ts_code"], ["a", "b"], freshness="trade_date").select("ts_code", "source", "trade_date")


@query("rs8_active_sources", "SELECT ts_code, trade_date, net_amount, source FROM cand WHERE source = 'b'")
def rs8(m):
    status = m.spark.createDataFrame([("a", False), ("b", True)], "source string, is_active boolean")
    return resolution.resolve(resolution.active(cand(m), status), KEYS, ["a", "b"]).select(*KEYS, "net_amount", "source")


#: Datasets of the policy queries, by code, and how each is resolved.
_POLICIES = [
    ("d0", "primary_fallback", "b", ["a", "b"], {}, None, 4, True), ("d1", "field_merge", "a", ["b"], {"buy_sm_amount": (["b", "a"], False), "buy_md_amount": (["c", "b"], True)}, None, 2, True),
    ("d2", "freshness_first", "a", ["b"], {}, "seen", 7, True), ("d3", "primary", "a", [], {}, None, 1, False), ("d4", "fallback", "a", ["b"], {}, None, 1, True), ("d5", "primary", "z", [""], {}, None, 9, True),
]


@query(
    "rs5_policy_table",
    """WITH x AS (SELECT 'd' || ts_code % 7 AS dataset, *, trade_date + CASE WHEN source = 'b' THEN CAST(ts_code % 3 AS INTEGER) - 1 ELSE 0 END AS seen FROM cand),
    y AS (SELECT * FROM x WHERE dataset NOT IN ('d3', 'd6') AND NOT (dataset = 'd4' AND source = 'a')),
    f AS (SELECT dataset, ts_code, trade_date, coalesce(a.source, b.source) AS any_source, a.source IS NOT NULL AS has_a, b.source IS NOT NULL AS has_b, a.buy_sm_amount AS sm_a, b.buy_sm_amount AS sm_b, a.buy_md_amount AS md_a, b.buy_md_amount AS md_b, a.seen AS seen_a, b.seen AS seen_b
      FROM (SELECT * FROM y WHERE source = 'a') a FULL JOIN (SELECT * FROM y WHERE source = 'b') b USING (dataset, ts_code, trade_date)),
    g AS (SELECT *, CASE WHEN NOT has_a THEN 'b' WHEN NOT has_b THEN 'a' WHEN dataset = 'd0' THEN 'b' WHEN dataset = 'd2' THEN CASE WHEN seen_b > seen_a THEN 'b' ELSE 'a' END ELSE 'a' END AS source FROM f)
    SELECT dataset, ts_code, trade_date, CASE WHEN dataset = 'd1' THEN CASE WHEN has_b THEN sm_b ELSE sm_a END WHEN source = 'a' THEN sm_a ELSE sm_b END AS buy_sm_amount,
    CASE WHEN dataset = 'd1' AND md_b IS NOT NULL THEN md_b WHEN source = 'a' THEN md_a ELSE md_b END AS buy_md_amount, source, CASE WHEN has_a AND has_b THEN 'a,b' WHEN has_a THEN 'a' ELSE 'b' END AS candidate_sources,
    CASE dataset WHEN 'd0' THEN 'primary_fallback' WHEN 'd1' THEN 'field_merge' WHEN 'd2' THEN 'freshness_first' WHEN 'd4' THEN 'fallback' ELSE 'primary' END AS resolution_mode, CASE dataset WHEN 'd0' THEN 4 WHEN 'd1' THEN 2 WHEN 'd2' THEN 7 WHEN 'd4' THEN 1 ELSE 9 END AS resolution_policy_version FROM g""",
)
def rs5_policy(m):
    rows = cand(m).withColumns({"dataset": F.concat(F.lit("d"), (F.col("ts_code") % 7).cast("string")), "seen": F.when(F.col("source") == "b", F.expr("date_add(trade_date, int(ts_code % 3) - 1)")).otherwise(F.col("trade_date"))})
    policies = m.spark.createDataFrame(_POLICIES, resolution.POLICY)
    status = m.spark.createDataFrame([("d4", "a", False), ("d4", "b", True), ("d0", "a", False)], "dataset string, source string, is_active boolean")
    found = resolution.resolve_by_policy(rows.select("dataset", *KEYS, "source", "buy_sm_amount", "buy_md_amount", "seen"), KEYS, policies, status)
    return found.drop("seen", "resolution_audit")


@query("rs10_touched_keys", f"SELECT ts_code, trade_date, net_amount, source FROM ({_PRIORITY.format(first='a')}) WHERE (ts_code, trade_date) IN (SELECT (ts_code, trade_date) FROM moneyflow_b WHERE year(trade_date) = 1997)")
def rs10(m):
    changed = m.moneyflow_b.where("year(trade_date) = 1997")
    return resolution.resolve(resolution.touched(cand(m), changed, KEYS), KEYS, ["a", "b"]).select(*KEYS, "net_amount", "source")


@query(
    "rs11_conflicts",
    " UNION ALL ".join(f"SELECT ts_code, trade_date, '{f}' AS field, 2 AS n_values FROM std_a a JOIN std_b b USING (ts_code, trade_date) WHERE a.{f} IS DISTINCT FROM b.{f}" for f in ("buy_sm_amount", "buy_md_amount", "net_amount")),
)
def rs11(m):
    return resolution.conflicts(cand(m), KEYS, ["buy_sm_amount", "buy_md_amount", "net_amount"], 2 * m.moneyflow_a.count())


_GAP = {f: (f"abs(CAST(a.{f} AS DOUBLE) - CAST(b.{f} AS DOUBLE))", f"abs(CAST(a.{f} AS DOUBLE) - CAST(b.{f} AS DOUBLE)) / greatest(abs(CAST(a.{f} AS DOUBLE)), abs(CAST(b.{f} AS DOUBLE)), 1.0)") for f in AMOUNTS}
_BAD = {f: f"((a.{f} IS NULL) <> (b.{f} IS NULL) OR coalesce({g} > 1 AND {r} > 0.03, FALSE))" for f, (g, r) in _GAP.items()}
SQL_VIEWS["rc_rows"] = f"""SELECT ts_code, trade_date, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS presence,
  CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN {' + '.join(f'CAST({e} AS INTEGER)' for e in _BAD.values())} ELSE 0 END AS n_violations,
  CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN concat_ws(',', {', '.join(f"CASE WHEN {_BAD[f]} THEN '{f}' END" for f in sorted(AMOUNTS))}) ELSE '' END AS violations
  FROM (SELECT *, 1 AS k FROM moneyflow_a) a FULL JOIN (SELECT *, 1 AS k FROM moneyflow_b) b USING (ts_code, trade_date)"""


def compared(m):
    return resolution.compare(m.moneyflow_a, m.moneyflow_b, KEYS, AMOUNTS)


@query("rc1_moneyflow_reconcile", "SELECT ts_code, trade_date, presence, n_violations, violations FROM rc_rows")
def rc1(m):
    return compared(m).drop("worst")


@query("jn9_presence", "SELECT presence, count(*) AS n FROM rc_rows GROUP BY presence")
def jn9(m):
    return compared(m).groupBy("presence").agg(F.count("*").alias("n"))


@query("tk7_difference_sample", "SELECT presence, ts_code, trade_date FROM (SELECT *, row_number() OVER (PARTITION BY presence ORDER BY ts_code, trade_date) AS p FROM rc_rows WHERE presence <> 'both' OR n_violations > 0) WHERE p <= 10")
def tk7(m):
    return resolution.sample(compared(m).where("presence != 'both' or n_violations > 0"), "presence", KEYS, 10).select("presence", *KEYS)


@query(
    "tk8_worst_field",
    f"SELECT ts_code, trade_date, list_sort(list_filter([{', '.join(f'CASE WHEN {_BAD[f]} THEN (coalesce({_GAP[f][0]}, 0.0), coalesce({_GAP[f][1]}, 0.0), {chr(39)}{f}{chr(39)}) END' for f in AMOUNTS)}], lambda x: x IS NOT NULL), 'DESC')[1][3] AS worst FROM moneyflow_a a JOIN moneyflow_b b USING (ts_code, trade_date)",
)
def tk8(m):
    return compared(m).where("presence = 'both'").select(*KEYS, "worst")


@query("rc1_direction_mismatch", "SELECT ts_code, trade_date FROM std_a a JOIN std_b b USING (ts_code, trade_date) WHERE sign(coalesce(a.net_amount, 0)) <> sign(coalesce(b.net_amount, 0))")
def rc1_direction(m):
    b = std(m.moneyflow_b).select(*KEYS, F.col("net_amount").alias("other"))
    return std(m.moneyflow_a).join(b, KEYS).where(resolution.direction_mismatch(F.col("net_amount"), F.col("other"))).select(*KEYS)


@query("rc2_default_range", "SELECT greatest(a, b) AS end_date, greatest(a, b) - 29 AS start_date FROM (SELECT max(trade_date) AS a FROM moneyflow_a), (SELECT max(trade_date) AS b FROM moneyflow_b)")
def rc2(m):
    ends = m.moneyflow_a.select("trade_date").unionByName(m.moneyflow_b.select("trade_date")).agg(F.max("trade_date").alias("end_date"))
    return ends.withColumn("start_date", F.date_sub("end_date", 29))


_PLAIN_X = "CASE coalesce({x}, '') WHEN 'SSE' THEN 'SH' WHEN 'SZSE' THEN 'SZ' WHEN 'BSE' THEN 'BJ' ELSE coalesce({x}, '') END"


@query(
    "rc3_security_reconcile",
    f"""WITH a AS (SELECT ts_code, TRUE AS here, coalesce(regexp_replace(CASE WHEN ts_code % 5 <> 0 THEN name END, '\\s+', '', 'g'), '') AS n, {_PLAIN_X.format(x="exchange")} AS x FROM security WHERE ts_code % 13 <> 0),
    b AS (SELECT ts_code, TRUE AS here, coalesce(regexp_replace(CASE WHEN ts_code % 10 = 0 THEN NULL WHEN ts_code % 7 = 0 THEN name || ' ltd' ELSE name END, '\\s+', '', 'g'), '') AS n, {_PLAIN_X.format(x="CASE WHEN ts_code % 11 = 0 THEN 'BSE' WHEN ts_code % 6 <> 0 THEN exchange END")} AS x FROM security WHERE ts_code % 17 <> 0)
    SELECT ts_code, CASE WHEN b.here IS NULL THEN 'only_a' WHEN a.here IS NULL THEN 'only_b' WHEN a.n <> b.n OR a.x <> b.x THEN 'diff' ELSE 'same' END AS result FROM a FULL JOIN b USING (ts_code)""",
)
def rc3(m):
    c = F.col("ts_code")
    a = m.security.where(c % 13 != 0).withColumn("name", F.when(c % 5 != 0, F.col("name")))
    name = F.when(c % 10 == 0, None).when(c % 7 == 0, F.concat("name", F.lit(" ltd"))).otherwise(F.col("name"))
    b = m.security.where(c % 17 != 0).withColumns({"name": name, "exchange": F.when(c % 11 == 0, "BSE").when(c % 6 != 0, F.col("exchange"))})
    return resolution.compare_masters(a, b, "ts_code")


@query("rc4_gate", "SELECT only_a, only_b, n_bad, concat_ws(',', CASE WHEN n_bad > 5 THEN 'n_bad' END, CASE WHEN only_b > 0 THEN 'only_b' END) AS failed FROM (SELECT count(*) FILTER (WHERE presence = 'only_a') AS only_a, count(*) FILTER (WHERE presence = 'only_b') AS only_b, count(*) FILTER (WHERE n_violations > 0) AS n_bad FROM rc_rows)")
def rc4(m):
    counts = compared(m).agg(F.count_if(F.col("presence") == "only_a").alias("only_a"), F.count_if(F.col("presence") == "only_b").alias("only_b"), F.count_if(F.col("n_violations") > 0).alias("n_bad"))
    return resolution.gate(counts, {"only_a": -1, "only_b": 0, "n_bad": 5})


@query(
    "ag14_run_summary",
    "SELECT dataset, count(*) AS runs, count(*) FILTER (WHERE status = 'SUCCESS') AS n_success, count(*) FILTER (WHERE status = 'FAILED') AS n_failed, count(*) FILTER (WHERE status = 'RUNNING') AS n_running, CAST(sum(rows_fetched) AS BIGINT) AS rows_fetched, CAST(sum(rows_written) AS BIGINT) AS rows_written, last(status ORDER BY started_at, event_id) AS last_status FROM run_log GROUP BY dataset",
)
def ag14(m):
    return health.run_summary(m.run_log, "dataset")


@query("ag5_status_histogram", "SELECT status, count(*) AS n FROM run_log GROUP BY status")
def ag5(m):
    return m.run_log.groupBy("status").agg(F.count("*").alias("n"))


@query("ag6_filtered_counts", "SELECT job_name, count(*) AS n FROM run_log WHERE rows_written > 10 GROUP BY job_name")
def ag6(m):
    return m.run_log.where("rows_written > 10").groupBy("job_name").agg(F.count("*").alias("n"))


@query("fr3_visible_failures", "SELECT job_name, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_name ORDER BY started_at DESC, event_id DESC) AS p, NULL AS x FROM run_log WHERE status = 'FAILED') f WHERE p = 1 AND NOT EXISTS (SELECT 1 FROM run_log s WHERE s.job_name = f.job_name AND s.status = 'SUCCESS' AND s.started_at >= f.started_at)")
def fr3(m):
    return health.visible_failures(m.run_log, "job_name").select("job_name", "event_id")


_CADENCE = "CASE ts_code % 5 WHEN 0 THEN 'reference' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'monthly' ELSE 'event' END"
SQL_VIEWS |= {
    "fr_observed": "SELECT ts_code AS dataset, max(trade_date) AS date FROM daily_bar WHERE ts_code % 9 <> 0 GROUP BY 1",
    "fr_state": "SELECT ts_code AS dataset, max(trade_date) AS date FROM daily_bar WHERE ts_code % 4 <> 0 AND (year(trade_date) < 2001 OR ts_code % 7 = 0) GROUP BY 1",
    "fr_synced": "SELECT ts_code AS dataset, max(trade_date) AS date FROM daily_bar WHERE ts_code % 8 = 0 GROUP BY 1",
    "fr_known": f"""SELECT ts_code AS dataset, {_CADENCE} AS cadence, CASE ts_code % 3 WHEN 0 THEN 'equity' WHEN 1 THEN 'index' ELSE 'board' END AS domain, ts_code % 4 <> 0 AS has_date, t.date AS known, o.date AS seen, y.date AS synced,
      CASE WHEN ts_code % 6 = 0 AND o.date IS NOT NULL THEN o.date ELSE greatest(t.date, o.date) END AS top FROM security s LEFT JOIN fr_observed o ON o.dataset = s.ts_code LEFT JOIN fr_state t ON t.dataset = s.ts_code LEFT JOIN fr_synced y ON y.dataset = s.ts_code""",
    "fr_rows": f"""SELECT *, CASE WHEN lag_days IS NULL THEN 'unknown' {' '.join(f"WHEN cadence = '{c}' THEN CASE WHEN lag_days <= {a} THEN 'fresh' WHEN lag_days <= {b} THEN 'lagging' ELSE 'stale' END" for c, (a, b) in health.CADENCES.items())} END AS status FROM (
      SELECT *, CASE WHEN latest IS NOT NULL THEN greatest(date_diff('day', latest, expected), 0) END AS lag_days FROM (SELECT dataset, cadence, domain, CASE WHEN top IS NULL AND NOT has_date THEN synced ELSE top END AS latest,
      CASE WHEN top IS NULL THEN CASE WHEN NOT has_date AND synced IS NOT NULL THEN 'sync_date' ELSE 'none' END WHEN known = top AND seen = top THEN 'state+observed' WHEN known = top THEN 'state' ELSE 'observed' END AS date_source,
      CASE WHEN cadence IN ('daily', 'weekly', 'monthly') THEN (SELECT max(trade_date) FROM trade_calendar WHERE is_open) ELSE DATE '2002-01-01' END AS expected FROM fr_known))""",
}


SQL_VIEWS["fr_modes"] = """SELECT ts_code AS dataset, CASE ts_code % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN '' ELSE 'b' END AS scope, ts_code % 11 <> 0 AS raw, ts_code % 2 = 0 AS std, ts_code % 4 = 0 AS resolution,
  ts_code % 13 <> 0 AS serving FROM security WHERE ts_code % 8 <> 3"""


def modes(m):
    c = F.col("ts_code")
    scope = F.when(c % 4 == 0, "a,b").when(c % 4 == 1, "").otherwise("b")
    flags = {"raw": c % 11 != 0, "std": c % 2 == 0, "resolution": c % 4 == 0, "serving": c % 13 != 0}
    return m.security.where("ts_code % 8 != 3").select(c.alias("dataset"), scope.alias("source_scope"), *[x.alias(f"{n}_enabled") for n, x in flags.items()])


def observed(m):
    return m.daily_bar.where("ts_code % 9 != 0").groupBy(F.col("ts_code").alias("dataset")).agg(F.max("trade_date").alias("date"))


def state(m):
    return m.daily_bar.where("ts_code % 4 != 0 and (year(trade_date) < 2001 or ts_code % 7 = 0)").groupBy(F.col("ts_code").alias("dataset")).agg(F.max("trade_date").alias("date"))


def fresh(m):
    cadence = F.element_at(F.array(*[F.lit(c) for c in health.CADENCES]), (F.col("ts_code") % 5 + 1).cast("int"))
    c = F.col("ts_code")
    domain = F.when(c % 3 == 0, "equity").when(c % 3 == 1, "index").otherwise("board")
    spec = m.security.select(c.alias("dataset"), cadence.alias("cadence"), (c % 6 == 0).alias("observed_only"), (c % 4 != 0).alias("has_date"), domain.alias("domain"))
    last_open = m.trade_calendar.where("is_open").agg(F.max("trade_date").alias("last_open"))
    synced = m.daily_bar.where("ts_code % 8 = 0").groupBy(c.alias("dataset")).agg(F.max("trade_date").alias("date"))
    return health.freshness(spec, observed(m), state(m), last_open, "2002-01-01", synced)


@query("fr1_freshness", "SELECT dataset, cadence, latest, expected, CAST(lag_days AS INTEGER) AS lag_days, status FROM fr_rows")
def fr1(m):
    return fresh(m).drop("date_source", "domain")


@query("fr2_date_source", "SELECT dataset, date_source FROM fr_rows")
def fr2(m):
    return fresh(m).select("dataset", "date_source")


_WORST = "CASE status WHEN 'stale' THEN 0 WHEN 'lagging' THEN 1 WHEN 'unknown' THEN 2 WHEN 'disabled' THEN 3 ELSE 4 END, coalesce(lag_days, 0) DESC, dataset"


@query("fr4_top_lagging", f"SELECT dataset, status, CAST(lag_days AS INTEGER) AS lag_days FROM fr_rows WHERE status IN ('lagging', 'stale') ORDER BY {_WORST} LIMIT 5")
def fr4(m):
    return health.lagging(fresh(m)).select("dataset", "status", "lag_days")


@query("fr4_grouped", f"SELECT domain, dataset, status, CAST(lag_days AS INTEGER) AS lag_days, row_number() OVER (PARTITION BY domain ORDER BY {_WORST}) AS place FROM fr_rows")
def fr4_grouped(m):
    return health.grouped(fresh(m)).select("domain", "dataset", "status", "lag_days", "place")


@query(
    "fr4_summary",
    "SELECT grouping(domain) = 1 AS is_total, domain, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("fresh", "lagging", "stale", "unknown", "disabled")) + " FROM fr_rows GROUP BY ROLLUP (domain)",
)
def fr4_summary(m):
    return health.summary(fresh(m))


@query("fr5_behind_state", "SELECT o.dataset, o.date AS observed, t.date AS recorded FROM fr_observed o LEFT JOIN fr_state t USING (dataset) WHERE t.date IS NULL OR o.date > t.date")
def fr5(m):
    return health.behind_state(state(m), observed(m))


@query(
    "fr6_layer_matrix",
    """SELECT f.dataset, CASE WHEN m.scope IS NULL OR m.scope = '' OR contains(m.scope, ',') THEN '__all__' ELSE m.scope END AS source_key, stage, CASE stage WHEN 'raw' THEN CASE WHEN coalesce(m.raw, TRUE) THEN f.status ELSE 'skipped' END
    WHEN 'std' THEN CASE WHEN coalesce(m.std, FALSE) THEN 'unobserved' ELSE 'skipped' END WHEN 'resolution' THEN CASE WHEN coalesce(m.resolution, FALSE) THEN 'unobserved' ELSE 'skipped' END
    WHEN 'serving' THEN CASE WHEN coalesce(m.serving, TRUE) THEN f.status ELSE 'skipped' END ELSE CASE WHEN t.date IS NULL THEN 'unknown' WHEN f.latest IS NULL OR date_diff('day', t.date, f.latest) <= 0 THEN 'healthy'
    WHEN date_diff('day', t.date, f.latest) = 1 THEN 'lagging' ELSE 'stale' END END AS layer_status FROM fr_rows f LEFT JOIN fr_modes m USING (dataset) LEFT JOIN fr_state t USING (dataset), (SELECT unnest(['raw', 'std', 'resolution', 'serving', 'light']) AS stage)
    WHERE stage <> 'light' OR (f.dataset = 1 AND coalesce(m.serving, TRUE))""",
)
def fr6(m):
    return health.layers(fresh(m), modes(m), state(m), 1)


@query("fr7_latest_layers", "SELECT dataset, date FROM fr_state UNION ALL SELECT dataset, date FROM fr_observed WHERE dataset NOT IN (SELECT dataset FROM fr_state)")
def fr7(m):
    return health.latest_layers(state(m), observed(m), ("dataset",), ("date",))


@query(
    "fr8_alerts",
    """WITH x AS (SELECT * FROM (SELECT 1 AS rank, 'stale' AS kind, 'dataset:' || dataset AS subject FROM fr_rows WHERE status = 'stale' ORDER BY lag_days DESC, dataset LIMIT 8) UNION ALL SELECT * FROM (SELECT 2, 'failed', 'run:' || event_id FROM run_log WHERE status = 'FAILED' ORDER BY started_at DESC, event_id LIMIT 8)
    UNION ALL SELECT * FROM (SELECT 3, 'stuck', 'run:' || event_id FROM run_log WHERE status = 'RUNNING' AND started_at <= TIMESTAMP '2024-01-30 23:00:00' ORDER BY started_at DESC, event_id LIMIT 8) UNION ALL SELECT * FROM (SELECT 4, 'nothing_written', 'run:' || event_id FROM run_log WHERE rows_fetched > 0 AND rows_written = 0 ORDER BY started_at DESC, event_id LIMIT 8))
    SELECT min(rank) AS rank, arg_min(kind, rank) AS kind, subject FROM x GROUP BY subject ORDER BY 1, 3 LIMIT 12""",
)
def fr8(m):
    return health.alerts(m.run_log, fresh(m), "2024-01-30 23:30:00")


SQL_VIEWS["executions"] = """SELECT event_id AS id, CASE user_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'canceling' WHEN 3 THEN 'failed' ELSE 'success' END AS status, ts AS requested_at,
  CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 5 MINUTE END AS queued_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 20 MINUTE END AS started_at, CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 50 MINUTE END AS last_progress_at,
  CASE WHEN event_id % 6 = 1 THEN ts + INTERVAL 70 MINUTE END AS cancel_requested_at FROM events WHERE event_type = 'click'"""


def executions(m):
    e, later = m.table("events").where("event_type = 'click'"), lambda k, r, minutes: F.when(F.col("event_id") % k == r, F.col("ts") + F.expr(f"interval {minutes} minutes"))
    status = F.element_at(F.array(*[F.lit(s) for s in ("queued", "running", "canceling", "failed", "success")]), (F.col("user_id") % 5 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), status.alias("status"), F.col("ts").alias("requested_at"), later(2, 0, 5).alias("queued_at"), later(3, 0, 20).alias("started_at"), later(7, 0, 50).alias("last_progress_at"), later(6, 1, 70).alias("cancel_requested_at"),
    )


_DAY = "requested_at >= TIMESTAMP '2024-01-14 16:00:00' AND requested_at < TIMESTAMP '2024-01-15 16:00:00'"
SQL_VIEWS |= {
    "day_executions": f"SELECT id, 'sync_' || id % 7 AS name, status, requested_at, started_at, CASE WHEN id % 2 = 0 THEN ' ' || repeat('lost ', 20) END AS message FROM executions WHERE {_DAY}",
    "day_runs": """SELECT dataset, count(*) AS runs, count(*) FILTER (WHERE status = 'SUCCESS') AS n_success, count(*) FILTER (WHERE status = 'FAILED') AS n_failed, count(*) FILTER (WHERE status = 'RUNNING') AS n_running, CAST(sum(rows_fetched) AS BIGINT) AS rows_fetched,
      CAST(sum(CASE WHEN dataset % 3 = 0 THEN 0 ELSE rows_written END) AS BIGINT) AS rows_written, arg_max(status, (started_at, event_id)) AS last_status FROM run_log WHERE started_at >= TIMESTAMP '2024-01-14 16:00:00' AND started_at < TIMESTAMP '2024-01-15 16:00:00' GROUP BY 1""",
    "day_alerts": """SELECT 1 AS kind, 'stale:' || dataset AS name, row_number() OVER (ORDER BY coalesce(lag_days, 0) DESC, dataset) AS p, CAST(lag_days AS BIGINT) AS n, '' AS detail FROM fr_rows WHERE status = 'stale' QUALIFY p <= 8
      UNION ALL SELECT 2, 'failed:' || name || '#' || id, row_number() OVER (ORDER BY requested_at, id) AS p, NULL, left(trim(coalesce(message, '')), 60) FROM day_executions WHERE status = 'failed' QUALIFY p <= 8
      UNION ALL SELECT 3, 'running_long:' || name || '#' || id, row_number() OVER (ORDER BY requested_at, id), date_diff('second', started_at, TIMESTAMP '2024-01-15 16:00:00') // 60, '' FROM day_executions WHERE status = 'running' AND started_at <= TIMESTAMP '2024-01-15 15:30:00'
      UNION ALL SELECT 4, 'nothing_written:' || dataset, row_number() OVER (ORDER BY dataset), rows_fetched, '' FROM day_runs WHERE rows_fetched > 0 AND rows_written = 0""",
}


@query(
    "fr8_day_report",
    "WITH "
    + ", ".join(
        f"{section} AS (SELECT '{section}' AS section, unnest([{', '.join(str(i) for i in range(len(names) + 1))}]) AS place, unnest([{', '.join(repr(x) for x in ('total', *names))}]) AS name, unnest([count(*), {', '.join(f'count(*) FILTER (WHERE status = {x!r})' for x in names)}]) AS n, NULL AS detail FROM {rows})"
        for section, rows, names in (("freshness", "fr_rows", ("fresh", "lagging", "stale", "unknown", "disabled")), ("execution", "day_executions", ("success", "failed", "running", "queued")))
    )
    + """ SELECT * FROM freshness UNION ALL SELECT * FROM execution UNION ALL SELECT 'run', row_number() OVER (ORDER BY dataset), CAST(dataset AS VARCHAR), runs,
    'n_success=' || n_success || ' n_failed=' || n_failed || ' n_running=' || n_running || ' rows_fetched=' || rows_fetched || ' rows_written=' || rows_written || ' last_status=' || last_status FROM day_runs
    UNION ALL SELECT 'alert', row_number() OVER (ORDER BY kind, p) AS place, name, n, detail FROM day_alerts QUALIFY place <= 12""",
)
def fr8_report(m):
    """A local day that begins at 16:00 UTC, seen at its end."""
    c = F.col("id")
    runs = m.run_log.withColumn("rows_written", F.when(F.col("dataset") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("rows_written")))
    own = executions(m).withColumns({"name": F.concat(F.lit("sync_"), (c % 7).cast("string")), "message": F.when(c % 2 == 0, F.concat(F.lit(" "), F.repeat(F.lit("lost "), 20)))})
    few = fresh(m)
    return health.day_report(own, runs, few, "2024-01-15", "Asia/Shanghai", "2024-01-15 16:00:00")


@query(
    "fr9_stale_runs",
    """SELECT id, last_activity, status AS previous_status, CASE WHEN cancel_requested_at IS NOT NULL THEN 'canceled' ELSE 'failed' END AS new_status, CASE WHEN cancel_requested_at IS NOT NULL THEN 'stop_not_finished' ELSE 'no_progress' END AS reason FROM (
    SELECT x.*, greatest(last_progress_at, started_at, queued_at, requested_at, cancel_requested_at, e.at, l.at) AS last_activity FROM executions x LEFT JOIN (SELECT event_id - 1 AS id, max(ts) AS at FROM events WHERE event_type = 'view' GROUP BY 1) e USING (id)
    LEFT JOIN (SELECT event_id - 2 AS id, max(CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 90 MINUTE ELSE ts END) AS at FROM events WHERE event_type = 'purchase' GROUP BY 1) l USING (id) WHERE status IN ('queued', 'running', 'canceling'))
    WHERE last_activity < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 45 MINUTE""",
)
def fr9(m):
    e = m.table("events")
    events = e.where("event_type = 'view'").select((F.col("event_id") - 1).alias("execution_id"), F.col("ts").alias("occurred_at"))
    ended = F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("interval 90 minutes"))
    logs = e.where("event_type = 'purchase'").select((F.col("event_id") - 2).alias("execution_id"), F.col("ts").alias("started_at"), ended.alias("ended_at"))
    return health.stale_runs(executions(m), events, logs, "2024-01-30 12:00:00", 45).withColumn("last_activity", F.col("last_activity").cast("timestamp_ntz"))


SQL_VIEWS["fr_failed"] = """SELECT f.dataset, f.at AS failed_at FROM (SELECT dataset, max(started_at) AS at FROM run_log WHERE status = 'FAILED' AND event_id % 3 = 0 GROUP BY 1) f LEFT JOIN (SELECT dataset, max(started_at) AS at FROM run_log WHERE status = 'SUCCESS' AND dataset % 2 = 0 GROUP BY 1) s USING (dataset)
  WHERE s.at IS NULL OR f.at > s.at"""


@query(
    "fr10_attention",
    """SELECT dataset, status, CAST(lag_days AS INTEGER) AS lag_days, failed_at, row_number() OVER (ORDER BY failed_at IS NULL, CASE status WHEN 'stale' THEN 0 WHEN 'lagging' THEN 1 ELSE 2 END, coalesce(lag_days, 0) DESC, failed_at DESC NULLS LAST, dataset) AS place
    FROM fr_rows LEFT JOIN fr_failed USING (dataset) WHERE failed_at IS NOT NULL OR status IN ('lagging', 'stale')""",
)
def fr10(m):
    runs = m.run_log.where("(status = 'FAILED' AND event_id % 3 = 0) OR (status = 'SUCCESS' AND dataset % 2 = 0)")
    failures = health.visible_failures(runs, "dataset").select("dataset", F.col("started_at").alias("failed_at"))
    return health.attention(fresh(m), failures).withColumn("failed_at", F.col("failed_at").cast("timestamp_ntz"))


@query(
    "fr10_today",
    """SELECT count(*) AS total_requests, count(*) FILTER (WHERE status IN ('success', 'failed')) AS completed_requests, count(*) FILTER (WHERE status IN ('running', 'canceling')) AS running_requests,
    count(*) FILTER (WHERE status = 'failed') AS failed_requests, count(*) FILTER (WHERE status = 'queued') AS queued_requests FROM executions WHERE requested_at >= TIMESTAMP '2024-01-28 16:00:00'""",
)
def fr10_today(m):
    """The local day begins at 16:00 UTC."""
    return health.today(executions(m), "2024-01-28 16:00:00")


@query("tk5_priority_order", "SELECT dataset, row_number() OVER (ORDER BY CASE status WHEN 'stale' THEN 0 WHEN 'lagging' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END, lag_days DESC NULLS LAST, dataset) AS place FROM fr_rows")
def tk5(m):
    rank = F.when(F.col("status") == "stale", 0).when(F.col("status") == "lagging", 1).when(F.col("status") == "unknown", 2).otherwise(3)
    return fresh(m).select("dataset", F.row_number().over(Window.orderBy(rank, F.desc_nulls_last("lag_days"), "dataset")).cast("long").alias("place"))


@query("ag4_observed_range", "SELECT 'daily' AS dataset, min(trade_date) AS first_date, max(trade_date) AS last_date FROM daily_bar UNION ALL SELECT 'flow_b', min(trade_date), max(trade_date) FROM moneyflow_b WHERE ts_code % 2 = 0")
def ag4(m):
    span = lambda name, rows: rows.agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date")).select(F.lit(name).alias("dataset"), "first_date", "last_date")
    return span("daily", m.daily_bar).unionByName(span("flow_b", m.moneyflow_b.where("ts_code % 2 = 0")))


@query("ag8_median", "SELECT trade_date, CASE WHEN count(close) >= 50 THEN round(quantile_cont(CAST(close AS DOUBLE), 0.5), 8) END AS median_close FROM panel_bar GROUP BY trade_date")
def ag8(m):
    from tapeworks.operators.breadth import median_of

    return m.panel_bar.groupBy("trade_date").agg(F.round(median_of(F.col("close").cast("double"), 50), 8).alias("median_close"))


@query("ag9_ratio", "SELECT trade_date, CASE WHEN count(*) >= 80 THEN round(CAST(count(*) FILTER (WHERE close > pre_close) AS DOUBLE) / count(*), 8) END AS up_share FROM panel_bar GROUP BY trade_date")
def ag9(m):
    from tapeworks.operators.breadth import ratio

    return m.panel_bar.groupBy("trade_date").agg(F.round(ratio(F.count_if(F.col("close") > F.col("pre_close")), F.count("*"), 80), 8).alias("up_share"))


@query("ag10_quantile", "SELECT ts_code, round(quantile_cont(CAST(amount AS DOUBLE), 0.8), 4) AS q80 FROM daily_bar GROUP BY ts_code")
def ag10(m):
    return m.daily_bar.groupBy("ts_code").agg(F.round(F.percentile(F.col("amount").cast("double"), F.lit(0.8)), 4).alias("q80"))


SQL_VIEWS |= {"board": "SELECT DISTINCT ts_code FROM ths_member", "open_member": "SELECT * FROM ths_member WHERE out_date IS NULL", "last_dc": "SELECT ts_code, con_code FROM dc_member WHERE trade_date = (SELECT max(trade_date) FROM dc_member)"}
_COUNTED = "SELECT b.ts_code, count(DISTINCT o.con_code) AS constituent_count FROM board b LEFT JOIN open_member o USING (ts_code) GROUP BY 1"
SQL_VIEWS["memberships"] = "SELECT 'ths' AS provider, ts_code AS board, con_code FROM open_member UNION ALL SELECT 'dc', ts_code, con_code FROM last_dc"


def board_rows(m):
    members = cut(m.ths_member)
    return boards.counted(members.select("ts_code").distinct(), members), members


def all_members(m):
    last = m.dc_member.agg(F.max("trade_date").alias("trade_date"))
    return boards.memberships({"ths": m.ths_member.where("out_date is null"), "dc": m.dc_member.join(F.broadcast(last), "trade_date")})


@query("ag2_constituents", "SELECT ts_code, count(DISTINCT con_code) AS n FROM ths_member GROUP BY ts_code")
def ag2(m):
    return m.ths_member.groupBy("ts_code").agg(F.count_distinct("con_code").alias("n"))


@query("jn13_counted_boards", _COUNTED)
def jn13(m):
    return board_rows(m)[0]


@query("flt6_min_count", f"SELECT * FROM ({_COUNTED}) WHERE constituent_count >= 10")
def flt6(m):
    return board_rows(m)[0].where("constituent_count >= 10")


@query("tk2_ranked_page", f"SELECT *, (SELECT count(*) FROM board) AS total FROM ({_COUNTED}) ORDER BY constituent_count DESC, ts_code LIMIT 10 OFFSET 5")
def tk2(m):
    return boards.page(board_rows(m)[0], [F.desc("constituent_count"), F.col("ts_code")], 10, 5)


@query("tk3_members_of_boards", f"SELECT c.ts_code, constituent_count, string_agg(con_code, ',' ORDER BY con_code) AS members FROM ({_COUNTED}) c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY con_code) AS p FROM (SELECT DISTINCT ts_code, con_code FROM open_member)) o ON o.ts_code = c.ts_code AND p <= 5 GROUP BY 1, 2")
def tk3(m):
    rows, members = board_rows(m)
    return boards.with_members(rows, members, 5)


_REVIEW = """SELECT '{p}' AS provider, c.ts_code, constituent_count, string_agg(con_code, ',' ORDER BY con_code) AS members FROM (SELECT * FROM ({c}) WHERE constituent_count >= 5 ORDER BY constituent_count DESC, ts_code LIMIT 12) c
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY con_code) AS p FROM (SELECT DISTINCT ts_code, con_code FROM {m})) o ON o.ts_code = c.ts_code AND p <= 3 GROUP BY 1, 2, 3"""


@query("dm3_board_review", _REVIEW.format(p="ths", c=_COUNTED, m="open_member") + " UNION ALL " + _REVIEW.format(p="dc", c="SELECT ts_code, count(DISTINCT con_code) AS constituent_count FROM last_dc GROUP BY 1", m="last_dc"))
def dm3(m):
    """Both providers' boards; one has intervals, the other a membership of the last day."""
    last = m.dc_member.join(F.broadcast(m.dc_member.agg(F.max("trade_date").alias("trade_date"))), "trade_date").withColumn("out_date", F.lit(None).cast("date"))
    out = None
    for provider, members in (("ths", cut(m.ths_member)), ("dc", cut(last.select("ts_code", "con_code", "out_date")))):
        counts = boards.counted(members.select("ts_code").distinct(), members)
        own = boards.with_members(counts.where("constituent_count >= 5").orderBy(F.desc("constituent_count"), "ts_code").limit(12), members, 3).select(F.lit(provider).alias("provider"), "ts_code", "constituent_count", "members")
        out = own if out is None else out.unionByName(own)
    return out


@query("dm3_equity_memberships", "SELECT con_code, name, count(DISTINCT provider || ':' || board) AS board_count, string_agg(DISTINCT provider || ':' || board, ',' ORDER BY provider || ':' || board) AS boards FROM memberships JOIN security ON security.ts_code = con_code GROUP BY 1, 2")
def dm3_memberships(m):
    """Each stock's name and boards of all providers."""
    named = all_members(m).select("con_code", F.concat_ws(":", "provider", "board").alias("board"))
    listed = named.groupBy("con_code").agg(F.array_sort(F.collect_set("board")).alias("b"))  # a stock's boards
    rows = listed.join(m.security.select(F.col("ts_code").alias("con_code"), "name"), "con_code")
    return rows.select("con_code", "name", F.size("b").cast("long").alias("board_count"), F.array_join("b", ",").alias("boards"))


@query("dm3_equity_suggest", "SELECT ts_code, name, CASE WHEN CAST(ts_code AS VARCHAR) = '2' THEN 0 WHEN starts_with(CAST(ts_code AS VARCHAR), '2') THEN 1 WHEN starts_with(lower(name), '2') THEN 2 ELSE 3 END AS score FROM security WHERE list_status = 'L' AND (contains(lower(name), '2') OR contains(CAST(ts_code AS VARCHAR), '2')) ORDER BY score, ts_code LIMIT 20")
def dm3_suggest(m):
    return boards.search(m.security.where("list_status = 'L'").select("ts_code", "name"), ["ts_code", "name"], "2", "ts_code", 20)


@query("dm3_active_indexes", "SELECT index_code, max(trade_date) AS latest, count(*) AS n_bars FROM index_bar GROUP BY 1 HAVING max(trade_date) >= (SELECT max(trade_date) FROM index_bar) - 30")
def dm3_indexes(m):
    """Indexes with a bar in the last 30 days of all."""
    from tapeworks.plans.breadth import _index_bar

    own = cut(_index_bar(m).groupBy("index_code").agg(F.max("trade_date").alias("latest"), F.count("*").alias("n_bars")))
    return own.join(F.broadcast(own.agg(F.max("latest").alias("last"))), F.lit(True)).where(F.col("latest") >= F.date_sub("last", 30)).drop("last")


@query("st1_memberships", "SELECT * FROM memberships")
def st1(m):
    return all_members(m)


@query("ag3_boards_of_stocks", "SELECT con_code, count(DISTINCT provider || ':' || board) AS board_count FROM memberships GROUP BY 1 HAVING count(DISTINCT provider || ':' || board) >= 3")
def ag3(m):
    return boards.board_counts(all_members(m), 3)


@query(
    "st5_concepts",
    "SELECT con_code, place, board FROM (SELECT *, row_number() OVER (PARTITION BY con_code ORDER BY r, p, board) AS place FROM (SELECT con_code, board, first(r ORDER BY r, p) AS r, first(p ORDER BY r, p) AS p FROM (SELECT *, CASE provider WHEN 'ths' THEN 1 ELSE 2 END AS r, row_number() OVER (PARTITION BY con_code, provider ORDER BY board) AS p FROM memberships) WHERE p <= 20 GROUP BY 1, 2)) WHERE place <= 8",
)
def st5(m):
    return boards.concepts(all_members(m), ["ths", "dc"]).withColumn("place", F.col("place").cast("long"))


@query("st2_distinct_keys", "SELECT DISTINCT ts_code, l_partkey FROM tick")
def st2(m):
    return m.tick.select("ts_code", "l_partkey").distinct()


@query("st4_difference", "SELECT ts_code FROM security EXCEPT SELECT ts_code FROM daily_bar WHERE trade_date = (SELECT max(trade_date) FROM daily_bar)")
def st4(m):
    last = m.daily_bar.agg(F.max("trade_date").alias("trade_date"))
    return m.security.select("ts_code").join(m.daily_bar.join(F.broadcast(last), "trade_date"), "ts_code", "left_anti")


@query("flt2_search", "SELECT ts_code, name, CASE WHEN CAST(ts_code AS VARCHAR) = '1' THEN 0 WHEN starts_with(CAST(ts_code AS VARCHAR), '1') THEN 1 WHEN starts_with(lower(name), '1') OR starts_with(CAST(ts_code AS VARCHAR), '1') THEN 2 ELSE 3 END AS score FROM security WHERE contains(lower(name), '1') OR contains(CAST(ts_code AS VARCHAR), '1') ORDER BY score, ts_code LIMIT 25")
def flt2(m):
    return boards.search(m.security.select("ts_code", "name"), ["ts_code", "name"], "1", "ts_code", 25)


@query("tk4_relevance", "SELECT ts_code, CASE WHEN starts_with(lower(area), 'nation_1') THEN 2 ELSE 3 END AS score FROM security WHERE contains(lower(area), 'nation_1') ORDER BY score, ts_code LIMIT 40")
def tk4(m):
    return boards.search(m.security.select("ts_code", "area"), ["area"], "nation_1", "ts_code", 40).drop("area")


@query(
    "flt3_active_masters",
    """SELECT 'equity' AS kind, CAST(ts_code AS VARCHAR) AS ts_code FROM security WHERE security_type = 'EQUITY' AND CASE WHEN ts_code % 7 = 0 THEN 'U' ELSE list_status END IN ('L', 'P', 'D')
    UNION ALL SELECT 'fund', p_partkey || CASE WHEN p_size % 5 = 0 THEN '.OF' ELSE '.SH' END FROM part WHERE p_size % 3 <> 0 AND p_size % 5 <> 0""",
)
def flt3(m):
    equities = m.security.withColumn("list_status", F.when(F.col("ts_code") % 7 == 0, "U").otherwise(F.col("list_status")))
    code = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 5 == 0, ".OF").otherwise(".SH"))
    funds = m.table("part").select(code.alias("ts_code"), F.when(F.col("p_size") % 3 == 0, "U").otherwise("L").alias("list_status"))
    own = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), F.col("ts_code").cast("string").alias("ts_code"))
    return own(boards.active_masters(equities), "equity").unionByName(own(boards.active_masters(funds, fund=True), "fund"))


@query("flt4_open_memberships", "SELECT ts_code, con_code FROM open_member")
def flt4(m):
    return m.ths_member.where(F.col("out_date").isNull()).select("ts_code", "con_code")


@query("flt5_optional_filters", "SELECT event_id FROM run_log WHERE status = 'FAILED' AND dataset = 3")
def flt5(m):
    return boards.optional_filters(m.run_log, status="FAILED", job_name=None, dataset=3).select("event_id")


@query(
    "flt8_open_days_in_range",
    "SELECT ts_code, trade_date FROM daily_bar WHERE trade_date >= greatest(DATE '1990-01-01', (SELECT min(trade_date) FROM moneyflow_b WHERE year(trade_date) >= 1997)) AND trade_date <= DATE '1998-06-30' AND trade_date IN (SELECT trade_date FROM trade_calendar WHERE is_open)",
)
def flt8(m):
    first = m.moneyflow_b.where("year(trade_date) >= 1997").agg(F.min("trade_date").alias("first"))
    return boards.open_days(m.daily_bar.select("ts_code", "trade_date"), m.trade_calendar, first, "1990-01-01", "1998-06-30")


@query("flt1_eligible_universe", "SELECT trade_date, count(*) AS n FROM mood_rows GROUP BY trade_date")
def flt1(m):
    from tapeworks.plans.breadth import eligible

    return eligible(m).groupBy("trade_date").agg(F.count("*").alias("n"))


@query("jn1_bar_security", "SELECT ts_code, trade_date, close, name FROM panel_bar JOIN security USING (ts_code)")
def jn1(m):
    return m.panel_bar.select("ts_code", "trade_date", "close").join(F.broadcast(m.security.select("ts_code", "name")), "ts_code")


@query("jn2_bar_limit_basic", "SELECT ts_code, trade_date, close, up_limit, pe FROM panel_bar LEFT JOIN stk_limit USING (ts_code, trade_date) LEFT JOIN daily_basic USING (ts_code, trade_date)")
def jn2(m):
    return m.panel_bar.select(*KEYS, "close").join(m.stk_limit.select(*KEYS, "up_limit"), KEYS, "left").join(m.daily_basic.select(*KEYS, "pe"), KEYS, "left")


@query(
    "jn4_dates_in_all_tables",
    "SELECT trade_date FROM trade_calendar WHERE is_open" + "".join(f" AND trade_date IN (SELECT trade_date FROM {t})" for t in ("panel_bar", "stk_limit", "adj_factor", "daily_basic", "index_bar", "dc_member")) + " AND trade_date IN (SELECT trade_date FROM dc_member WHERE ts_code LIKE 'ECONOMY%')",
)
def jn4(m):
    """Bars, limits, factors, ratios, indexes, boards of one kind, and members."""
    from tapeworks.plans.breadth import _index_bar

    kind = m.dc_member.where(F.col("ts_code").startswith("ECONOMY"))
    return boards.dates_in_all(m.trade_calendar, [m.panel_bar, m.stk_limit, m.adj_factor, m.daily_basic, _index_bar(m), kind, m.dc_member])


@query("jn5_undelivered", "SELECT s.ts_code, c.trade_date FROM security s, calendar c WHERE NOT EXISTS (SELECT 1 FROM panel_bar b WHERE b.ts_code = s.ts_code AND b.trade_date = c.trade_date)")
def jn5(m):
    days = m.calendar.agg(F.collect_list("trade_date").alias("days"))  # a calendar's days
    expected = m.security.select("ts_code").join(F.broadcast(days), F.lit(True)).select("ts_code", F.explode("days").alias("trade_date"))
    return expected.join(m.panel_bar, KEYS, "left_anti")


@query("jn7_as_of_snapshot", "SELECT ts_code, con_code, trade_date FROM (SELECT *, max(trade_date) OVER (PARTITION BY ts_code) AS last FROM dc_member WHERE trade_date <= DATE '1998-03-04') WHERE trade_date = last")
def jn7(m):
    return boards.latest_sets(m.dc_member, "ts_code", "trade_date", "1998-03-04").select("ts_code", "con_code", "trade_date")


@query("jn8_latest_members", "SELECT d.ts_code, d.con_code, d.trade_date FROM dc_member d JOIN (SELECT con_code, max(trade_date) AS trade_date FROM dc_member GROUP BY 1) l USING (con_code, trade_date)")
def jn8(m):
    last = m.dc_member.groupBy("con_code").agg(F.max("trade_date").alias("trade_date"))
    return m.dc_member.join(last, ["con_code", "trade_date"]).select("ts_code", "con_code", "trade_date")


@query("jn12_unique_match", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE s.k END AS code FROM customer LEFT JOIN (SELECT s_nationkey || '-' || s_suppkey % 4 AS n, min(s_suppkey) AS k FROM supplier GROUP BY 1 HAVING count(*) = 1) s ON s.n = c_nationkey || '-' || c_custkey % 4")
def jn12(m):
    """Of the suppliers' names by nation some are held by one supplier and some by several."""
    name = lambda nation, key: F.concat_ws("-", F.col(nation).cast("string"), (F.col(key) % 4).cast("string")).alias("name")
    rows = m.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("code"), name("c_nationkey", "c_custkey"))
    masters = m.table("supplier").select(name("s_nationkey", "s_suppkey"), F.col("s_suppkey").alias("code"))
    return boards.unique_match(rows, masters, "name", "code").select("c_custkey", "code")


@query(
    "jn15_name_chain",
    """SELECT r.code, r.security_type, CASE r.security_type WHEN 'INDEX' THEN i.c_name WHEN 'ETF' THEN e.p_name ELSE coalesce(s.s_name, i.c_name, e.p_name) END AS name
    FROM (SELECT DISTINCT o_custkey AS code, CASE WHEN o_custkey % 4 = 0 THEN 'INDEX' WHEN o_custkey % 7 = 0 THEN 'ETF' END AS security_type FROM orders) r LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) s ON s.s_suppkey = r.code
    LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) i ON i.c_custkey = r.code LEFT JOIN part e ON e.p_partkey = r.code""",
)
def jn15(m):
    kind = F.when(F.col("o_custkey") % 4 == 0, "INDEX").when(F.col("o_custkey") % 7 == 0, "ETF").alias("security_type")
    master = lambda name, key, label: m.table(name).select(F.col(key).alias("code"), F.col(label).alias("name"))
    masters = {"EQUITY": master("supplier", "s_suppkey", "s_name").where("code % 2 = 0"), "INDEX": master("customer", "c_custkey", "c_name").where("code % 3 = 0"), "ETF": master("part", "p_partkey", "p_name")}
    return boards.name_chain(m.table("orders").select(F.col("o_custkey").alias("code"), kind).distinct(), masters, "code")


@query(
    "tk6_top_decile",
    """SELECT trade_date, ts_code FROM (SELECT *, count(*) OVER (PARTITION BY trade_date) AS n, row_number() OVER (PARTITION BY trade_date ORDER BY ret20 DESC, ts_code) AS p FROM (
    SELECT ts_code, trade_date, round(CAST(close AS DOUBLE) / CAST(lag(close, 20) OVER (PARTITION BY ts_code ORDER BY trade_date) AS DOUBLE) - 1, 10) AS ret20 FROM panel_bar) WHERE ret20 IS NOT NULL) WHERE p <= greatest(1, ceil(0.1 * n))""",
)
def tk6(m):
    from tapeworks.operators.breadth import top_share

    before = F.lag("close", 20).over(Window.partitionBy("ts_code").orderBy("trade_date"))
    rows = m.panel_bar.select(*KEYS, F.round(F.col("close").cast("double") / before.cast("double") - 1, 10).alias("ret20"))
    return top_share(rows, "ret20").select("trade_date", "ts_code")


@query("wn14_lead_labels", "SELECT trade_date, n, lead(n) OVER (ORDER BY trade_date) AS next_n FROM calendar")
def wn14(m):
    return m.calendar.withColumn("next_n", F.lead("n").over(Window.orderBy("trade_date")))


@query("wn16_trailing_median", "SELECT ts_code, trade_date, CASE WHEN count(amount) OVER w >= 5 THEN round(quantile_cont(CAST(amount AS DOUBLE), 0.5) OVER w, 4) END AS med FROM panel_bar WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def wn16(m):
    w = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(-20, -1)
    x = F.col("amount").cast("double")
    return m.panel_bar.select(*KEYS, F.when(F.count(x).over(w) >= 5, F.round(F.percentile(x, F.lit(0.5)).over(w), 4)).alias("med"))


@query("wn18_carried_close", "SELECT ts_code, trade_date, close AS close_raw, coalesce(lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date), pre_close) AS pre_close, close - coalesce(lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date), pre_close) AS change_amount FROM daily_bar")
def wn18(m):
    from tapeworks.operators import bars

    return bars.carried(m.daily_bar, "close", "raw")


@query("dm4_latest_open_day", "SELECT b.trade_date, max(c.trade_date) AS latest_open FROM (SELECT DISTINCT trade_date FROM daily_bar) b JOIN trade_calendar c ON c.is_open AND c.trade_date <= b.trade_date GROUP BY 1")
def dm4(m):
    return boards.latest_open_day(m.daily_bar.select("trade_date").distinct(), m.trade_calendar)
