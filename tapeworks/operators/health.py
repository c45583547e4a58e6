"""Freshness and health of datasets, from their run logs and what their tables hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.operators.upsert import keep_one

#: Days of lag up to which a dataset of a cadence is fresh, and lagging; beyond it is stale. Fixed values.
CADENCES = {"reference": (1, 7), "daily": (0, 2), "weekly": (7, 14), "monthly": (31, 62), "event": (30, 90)}
#: Datasets of these cadences should reach the last open day; others the reference day.
TRADING = ("daily", "weekly", "monthly")


def run_summary(runs: DataFrame, by: str) -> DataFrame:
    """For each dataset its runs by status, rows fetched and written, and its last status by start (ties by id)."""
    s = F.col("status")
    return runs.groupBy(by).agg(
        F.count("*").alias("runs"), F.count_if(s == "SUCCESS").alias("n_success"), F.count_if(s == "FAILED").alias("n_failed"), F.count_if(s == "RUNNING").alias("n_running"),
        F.sum("rows_fetched").alias("rows_fetched"), F.sum("rows_written").alias("rows_written"), F.max_by("status", F.struct("started_at", "event_id")).alias("last_status"),
    )


def freshness(spec: DataFrame, observed: DataFrame, state: DataFrame, last_open: DataFrame, reference_day: str, synced: DataFrame | None = None) -> DataFrame:
    """dataset, cadence, latest, date_source, expected, lag_days, status, and what else spec has. spec: dataset, cadence, observed_only (the table's date counts where there is one), and with synced
    has_date (whether the table has a date at all); observed, state and synced: dataset, and the date that the table, the recorded state and the last sync reach; last_open: one row, last_open.
    date_source names those of table and state whose date is the latest, or else the sync of a table without a date."""
    rows = spec.join(observed.withColumnRenamed("date", "_seen"), "dataset", "left").join(state.withColumnRenamed("date", "_state"), "dataset", "left").join(F.broadcast(last_open), F.lit(True), "left")
    latest = F.when(F.col("observed_only") & F.col("_seen").isNotNull(), F.col("_seen")).otherwise(F.greatest("_state", "_seen"))
    named = F.array_compact(F.array(F.when(F.col("_state") == latest, "state"), F.when(F.col("_seen") == latest, "observed")))
    source = F.when(F.size(named) > 0, F.array_join(named, "+")).otherwise("none")
    if synced is not None:
        rows = rows.join(synced.withColumnRenamed("date", "_synced"), "dataset", "left")
        by_sync = latest.isNull() & ~F.col("has_date") & F.col("_synced").isNotNull()
        source, latest = F.when(by_sync, "sync_date").otherwise(source), F.when(by_sync, F.col("_synced")).otherwise(latest)
    kept = [c for c in spec.columns if c not in ("dataset", "cadence", "observed_only", "has_date")]
    expected = F.when(F.col("cadence").isin(*TRADING), F.col("last_open")).otherwise(F.to_date(F.lit(reference_day)))
    timed = rows.withColumns({"latest": latest, "date_source": source, "expected": expected})
    lag = timed.withColumn("lag_days", F.when(F.col("latest").isNotNull(), F.greatest(F.datediff("expected", "latest"), F.lit(0))))
    return lag.withColumn("status", status(F.col("cadence"), F.col("lag_days"))).select("dataset", "cadence", "latest", "date_source", "expected", "lag_days", "status", *kept)


#: The order of states in lists. Fixed values.
STATES = ("stale", "lagging", "unknown", "disabled", "fresh")


def worst_first(rows: DataFrame) -> list[Column]:
    """The order in lists: by state, most lag, and name."""
    place = F.lit(len(STATES))
    for i, name in enumerate(STATES):
        place = F.when(F.col("status") == name, i).otherwise(place)
    return [place, F.desc(F.coalesce("lag_days", F.lit(0))), F.col("dataset")]


def lagging(fresh: DataFrame, n: int = 5) -> DataFrame:
    """The first n datasets that lag or are stale."""
    return fresh.where(F.col("status").isin("lagging", "stale")).orderBy(*worst_first(fresh)).limit(n)


def grouped(fresh: DataFrame, by: str = "domain") -> DataFrame:
    """fresh with each dataset's place in its domain's list."""
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*worst_first(fresh))))


def summary(fresh: DataFrame, by: str = "domain") -> DataFrame:
    """Datasets by status, for each domain and for all (a null domain), in one pass: is_total, domain, total, fresh, lagging, stale, unknown, disabled."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("fresh", "lagging", "stale", "unknown", "disabled")]
    return fresh.rollup(by).agg((F.grouping(by) == 1).alias("is_total"), F.count("*").alias("total"), *counts)


def status(cadence: Column, lag: Column) -> Column:
    out = F.lit("unknown")
    for name, (fresh, lagging) in CADENCES.items():
        out = F.when(cadence == name, F.when(lag <= fresh, "fresh").when(lag <= lagging, "lagging").otherwise("stale")).otherwise(out)
    return F.when(lag.isNull(), "unknown").otherwise(out)


def visible_failures(runs: DataFrame, job: str) -> DataFrame:
    """Each job's newest failed run, if it is newer than its last success."""
    failed = keep_one(runs.where("status = 'FAILED'"), [job], [F.desc("started_at"), F.desc("event_id")])
    success = runs.where("status = 'SUCCESS'").groupBy(job).agg(F.max("started_at").alias("_ok"))
    return failed.join(success, job, "left").where(F.col("_ok").isNull() | (F.col("started_at") > F.col("_ok"))).drop("_ok")


def behind_state(state: DataFrame, observed: DataFrame) -> DataFrame:
    """Datasets whose table reaches further than their recorded state."""
    return observed.withColumnRenamed("date", "observed").join(state.withColumnRenamed("date", "recorded"), "dataset", "left").where(F.col("recorded").isNull() | (F.col("observed") > F.col("recorded")))


STAGES = ("raw", "std", "resolution", "serving", "light")


def layers(fresh: DataFrame, modes: DataFrame, light: DataFrame, light_dataset: object) -> DataFrame:
    """dataset, source_key, stage, layer_status. modes: dataset, source_scope and raw_enabled, std_enabled, resolution_enabled, serving_enabled; a dataset without a mode
    has raw and serving. raw and serving have the freshness status, std and resolution aren't observed, and a stage that a mode leaves out is skipped. light_dataset alone
    has a light stage, where it is served: unknown without a date in light (dataset, date), else by its days behind the serving date: none, one, more."""
    joined = fresh.join(modes, "dataset", "left").join(light.where(F.col("dataset") == light_dataset).select("dataset", F.col("date").alias("_light")), "dataset", "left")
    on = {stage: F.coalesce(f"{stage}_enabled", F.lit(default)) for stage, default in (("raw", True), ("std", False), ("resolution", False), ("serving", True))}
    scope = F.trim(F.coalesce("source_scope", F.lit("")))
    lag = F.datediff("latest", "_light")
    own = F.when(F.col("_light").isNull(), "unknown").when(lag.isNull() | (lag <= 0), "healthy").when(lag == 1, "lagging").otherwise("stale")
    by_stage = {stage: F.when(on[stage], "unobserved" if stage in ("std", "resolution") else F.col("status")).otherwise("skipped") for stage in on} | {"light": own}
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), c.alias("layer_status")) for s, c in by_stage.items()]))
    rows = joined.select("dataset", F.when((scope == "") | scope.contains(","), "__all__").otherwise(scope).alias("source_key"), (on["serving"] & (F.col("dataset") == light_dataset)).alias("_lit"), each.alias("x"))
    return rows.where((F.col("x.stage") != "light") | F.col("_lit")).select("dataset", "source_key", "x.stage", "x.layer_status")


def latest_layers(current: DataFrame, history: DataFrame, keys: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """The current rows, and for keys without one the newest of the history."""
    old = keep_one(history.join(current.select(*keys), list(keys), "left_anti"), list(keys), [F.desc(c) for c in by])
    return current.unionByName(old)


def alerts(runs: DataFrame, fresh: DataFrame, now: str, each: int = 8, cap: int = 12, stuck_minutes: int = 30) -> DataFrame:
    """place, kind, subject: stale datasets (most lag first), failed runs (newest first), runs that go on too long, and runs that fetched rows and wrote none; each subject once,
    cap in all."""
    stale = fresh.where("status = 'stale'").orderBy(F.desc("lag_days"), "dataset").limit(each).select(F.lit(1).alias("rank"), F.lit("stale").alias("kind"), F.concat(F.lit("dataset:"), F.col("dataset").cast("string")).alias("subject"))
    run = F.concat(F.lit("run:"), F.col("event_id").cast("string")).alias("subject")
    failed = runs.where("status = 'FAILED'").orderBy(F.desc("started_at"), "event_id").limit(each).select(F.lit(2).alias("rank"), F.lit("failed").alias("kind"), run)
    end = F.lit(now).cast("timestamp_ntz")
    stuck = runs.where((F.col("status") == "RUNNING") & (F.col("started_at").cast("timestamp_ntz") <= end - F.expr(f"interval {stuck_minutes} minutes"))).orderBy(F.desc("started_at"), "event_id").limit(each).select(F.lit(3).alias("rank"), F.lit("stuck").alias("kind"), run)
    empty = runs.where("rows_fetched > 0 and rows_written = 0").orderBy(F.desc("started_at"), "event_id").limit(each).select(F.lit(4).alias("rank"), F.lit("nothing_written").alias("kind"), run)
    found = stale.unionByName(failed).unionByName(stuck).unionByName(empty)
    once = found.groupBy("subject").agg(F.min_by(F.struct("rank", "kind"), "rank").alias("x")).select("x.rank", "x.kind", "subject")
    return once.orderBy("rank", "subject").limit(cap)


REPORT = ("section", "place", "name", "n", "detail")


def in_local_day(time: Column, day: str, zone: str) -> Column:
    """Whether a time falls on a day of a zone."""
    here = lambda c: F.convert_timezone(F.lit(zone), F.current_timezone(), c.cast("timestamp_ntz"))
    start = F.lit(day).cast("date")
    own = time.cast("timestamp_ntz")
    return (own >= here(start)) & (own < here(F.date_add(start, 1)))


def day_report(executions: DataFrame, runs: DataFrame, fresh: DataFrame, day: str, zone: str, now: str, each: int = 8, cap: int = 12, stuck_minutes: int = 30) -> DataFrame:
    """section, place, name, n, detail: the report of a local day. ``freshness``: datasets by status; ``execution``: executions requested on the day (id, name, status, requested_at, started_at,
    message) by status; ``run``: run_summary() of the runs (dataset, ...) started on it; ``alert``: stale datasets (most lag first), failed executions (by request), those that have run too
    long at now, and datasets that fetched rows and wrote none; each once, cap in all."""
    own = executions.where(in_local_day(F.col("requested_at"), day, zone))
    by_dataset = run_summary(runs.where(in_local_day(F.col("started_at"), day, zone)), "dataset")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def counted(rows: DataFrame, section: str, states: tuple[str, ...]) -> DataFrame:
        s = F.lower("status")
        pairs = F.array(F.struct(F.lit(0).alias("place"), F.lit("total").alias("name"), F.col("_total").alias("n")), *[F.struct(F.lit(i).alias("place"), F.lit(x).alias("name"), F.col(f"_{x}").alias("n")) for i, x in enumerate(states, 1)])
        one = rows.agg(F.count("*").alias("_total"), *[F.count_if(s == x).alias(f"_{x}") for x in states])
        return one.select(F.lit(section).alias("section"), F.explode(pairs).alias("x")).select("section", "x.*", F.lit(None).cast("string").alias("detail"))

    listed = by_dataset.select(
        F.lit("run").alias("section"), F.row_number().over(Window.orderBy("dataset")).alias("place"), text("dataset").alias("name"), F.col("runs").alias("n"),  # a row a dataset
        F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), text(c)) for c in ("n_success", "n_failed", "n_running", "rows_fetched", "rows_written", "last_status")]).alias("detail"),
    )

    def alert(rows: DataFrame, kind: int, name: str, order: list[Column], subject: Column, n: Column, detail: Column, most: int | None) -> DataFrame:
        some = rows.orderBy(*order).limit(most or cap)  # the report has no place for more than cap
        placed = some.withColumn("_p", F.row_number().over(Window.orderBy(*order)))
        return placed.select(F.lit(kind).alias("_kind"), "_p", F.lit(name).alias("kind"), subject.alias("subject"), n.cast("long").alias("n"), detail.alias("detail"))

    none, minutes = F.lit(""), (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))) / 60
    who, by_request, by_name = F.concat_ws("#", text("name"), text("id")), [F.col("requested_at"), F.col("id")], [F.col("dataset")]
    found = (
        alert(fresh.where("status = 'stale'"), 1, "stale", [F.desc(F.coalesce("lag_days", F.lit(0))), F.col("dataset")], text("dataset"), F.col("lag_days"), none, each)
        .unionByName(alert(own.where("lower(status) = 'failed'"), 2, "failed", by_request, who, F.lit(None), F.substring(F.trim(text("message")), 1, 60), each))
        .unionByName(alert(own.where((F.lower("status") == "running") & (minutes >= stuck_minutes)), 3, "running_long", by_request, who, F.floor(minutes), none, None))
        .unionByName(alert(by_dataset.where("rows_fetched > 0 AND rows_written = 0"), 4, "nothing_written", by_name, text("dataset"), F.col("rows_fetched"), none, None))
    )
    once = found.groupBy("kind", "subject", "n", "detail").agg(F.min("_kind").alias("_kind"), F.min("_p").alias("_p"))
    order = F.row_number().over(Window.orderBy("_kind", "_p"))  # four lists of bounded length
    alerts = once.withColumn("place", order).where(F.col("place") <= cap).select(F.lit("alert").alias("section"), "place", F.concat_ws(":", "kind", "subject").alias("name"), "n", "detail")
    parts = [counted(fresh, "freshness", ("fresh", "lagging", "stale", "unknown", "disabled")), counted(own, "execution", ("success", "failed", "running", "queued")), listed, alerts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).select(*REPORT)


#: States in which a run still counts as going on, and those that end it.
ACTIVE = ("queued", "running", "canceling")
ENDED = ("success", "failed", "canceled", "partial_success")


def stale_runs(executions: DataFrame, events: DataFrame, logs: DataFrame, now: str, minutes: int) -> DataFrame:
    """id, last_activity, previous_status, new_status, reason of active executions without a sign of life for so many minutes. Signs are the five times of the execution itself
    (last_progress_at, started_at, queued_at, requested_at, cancel_requested_at), its last event (execution_id, occurred_at) and its last log (execution_id, ended_at or
    started_at); without any it is stale. One that was asked to stop becomes canceled, others failed."""
    event = events.groupBy(F.col("execution_id").alias("id")).agg(F.max("occurred_at").alias("_event"))
    log = logs.groupBy(F.col("execution_id").alias("id")).agg(F.max(F.coalesce("ended_at", "started_at")).alias("_log"))
    rows = executions.where(F.col("status").isin(*ACTIVE)).join(event, "id", "left").join(log, "id", "left")
    last = F.greatest("last_progress_at", "started_at", "queued_at", "requested_at", "cancel_requested_at", "_event", "_log")
    asked = F.col("cancel_requested_at").isNotNull()
    found = rows.withColumn("last_activity", last).where(F.col("last_activity").isNull() | (F.col("last_activity").cast("timestamp_ntz") < F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes")))
    return found.select("id", "last_activity", F.col("status").alias("previous_status"), F.when(asked, "canceled").otherwise("failed").alias("new_status"), F.when(asked, "stop_not_finished").otherwise("no_progress").alias("reason"))


def attention(fresh: DataFrame, failures: DataFrame) -> DataFrame:
    """dataset, status, lag_days, failed_at, place: datasets with a recent failure (dataset, failed_at), or that lag or are stale; failed ones first, then by status, most lag, newest failure
    and name."""
    rows = fresh.join(failures.select("dataset", "failed_at"), "dataset", "left").where(F.col("failed_at").isNotNull() | F.col("status").isin("lagging", "stale"))
    order = [F.col("failed_at").isNull(), F.when(F.col("status") == "stale", 0).when(F.col("status") == "lagging", 1).otherwise(2), F.desc(F.coalesce("lag_days", F.lit(0))), F.desc_nulls_last("failed_at"), F.col("dataset")]
    return rows.select("dataset", "status", "lag_days", "failed_at", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # a row a dataset


def today(executions: DataFrame, start: str) -> DataFrame:
    """One row of counts of the executions requested since the local day began (start, in UTC): total, completed, running, failed, queued."""
    s = F.col("status")
    rows = executions.where(F.col("requested_at").cast("timestamp_ntz") >= F.lit(start).cast("timestamp_ntz"))
    return rows.agg(
        F.count("*").alias("total_requests"), F.count_if(s.isin(*ENDED)).alias("completed_requests"), F.count_if(s.isin("running", "canceling")).alias("running_requests"),
        F.count_if(s == "failed").alias("failed_requests"), F.count_if(s == "queued").alias("queued_requests"),
    )
