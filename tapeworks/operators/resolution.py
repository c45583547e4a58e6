"""Several sources fused into one row for each key, reconciled and checked.

Candidates are rows of all sources in one frame with a column ``source``; a policy names an order of sources. Resolution is one exchange by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.scalars import exchange_code, plain_name
from tapeworks.lineage import dealt
from tapeworks.operators.upsert import keep_one

UNKNOWN_PRIORITY = 10_000


def candidates(sources: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """All rows with their source; rows with a null or blank key part are left out."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.withColumn("source", F.lit(name)) for name, df in sources.items()])
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(k).cast("string")) != "", F.lit(False)) for k in keys])
    return rows.where(whole)


def last_of_source(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of rows of one key and source the first in order."""
    return keep_one(dealt(rows, *keys), [*keys, "source"], order)


def priority(sources: Sequence[str]) -> Column:
    """A source's place in the order; others after all, by name."""
    known = F.lit(UNKNOWN_PRIORITY)
    for i, name in reversed(list(enumerate(dict.fromkeys(sources)))):
        known = F.when(F.col("source") == name, i).otherwise(known)
    return known


def active(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of sources that status (source, is_active) calls active; if it calls none so, all rows."""
    on = status.where("is_active").select("source")
    return rows if on.isEmpty() else rows.join(F.broadcast(on), "source", "left_semi")


def resolve(rows: DataFrame, keys: Sequence[str], sources: Sequence[str], freshness: str | None = None) -> DataFrame:
    """For each key the row of the first source in order that has one, or with freshness of the freshest (nulls last, ties by order)."""
    rest = [c for c in rows.columns if c not in keys]
    order = [priority(sources), F.col("source")]
    if freshness:
        order = [F.col(freshness).isNull(), -F.coalesce(F.unix_date(F.to_date(freshness)), F.lit(0)), *order]
    own = Window.partitionBy(*keys)
    placed = rows.withColumns({"_place": F.row_number().over(own.orderBy(*order)), "_sources": F.collect_set("source").over(own)})
    return placed.where("_place = 1").select(*keys, *rest, provenance("_sources"))


def provenance(sources: str) -> Column:
    return F.array_join(F.array_sort(sources), ",").alias("source_candidates")


def merge_fields(rows: DataFrame, keys: Sequence[str], sources: Sequence[str], rules: Mapping[str, Sequence[str]], skip_nulls: Sequence[str] = ()) -> DataFrame:
    """resolve(), with each field of rules taken from the first of its own sources that has a row for the key (its null counts, but for fields in skip_nulls)."""
    rest = [c for c in rows.columns if c not in keys]
    picks = [F.min_by(F.struct(*rest), F.struct(priority(sources), F.col("source"))).alias("_row"), F.collect_set("source").alias("_sources")]
    for field, order in rules.items():
        usable = F.col("source").isin(*order) & (F.col(field).isNotNull() if field in skip_nulls else F.lit(True))
        picks.append(F.min_by(F.when(usable, F.struct(F.col(field).alias("v"))), F.when(usable, F.struct(priority(order), F.col("source")))).alias(f"_{field}"))
    chosen = rows.groupBy(*keys).agg(*picks)
    field = lambda c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}")["v"]).otherwise(F.col("_row")[c]) if c in rules else F.col("_row")[c]
    return chosen.select(*keys, *[field(c).alias(c) for c in rest], provenance("_sources"))


#: How a dataset is resolved: a row for each.
POLICY = "dataset string, mode string, primary_source string, fallback_sources array<string>, field_rules map<string,struct<sources:array<string>,skip_empty:boolean>>, freshness_field string, version int, enabled boolean"
BY_PRIORITY, BY_FIELD, BY_FRESHNESS = ("primary", "fallback", "primary_fallback"), "field_merge", "freshness_first"


def resolve_by_policy(rows: DataFrame, keys: Sequence[str], policies: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """rows (dataset, keys, fields, source) of many datasets resolved in one plan and one exchange, each by its policy (POLICY): a row for each dataset and key, with fields, source,
    candidate_sources, resolution_mode, resolution_policy_version and resolution_audit. A dataset without a policy, or whose policy isn't enabled, gives no row; an unknown mode is an error.
    Sources count if status (dataset, source, is_active) calls them active; where it calls none of a dataset so, all do. An unknown source comes after the policy's, by name.
    freshness_field (null: updated_at) is compared as a time, null last. A key's candidates are gathered: as many as it has sources."""
    fields = [c for c in rows.columns if c not in ("dataset", "source", *keys)]
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(k).cast("string")) != "", F.lit(False)) for k in keys])
    chain = F.array_distinct(F.filter(F.concat(F.array("primary_source"), F.coalesce("fallback_sources", F.array().cast("array<string>"))), lambda s: s.isNotNull() & (s != "")))
    named = policies.where("enabled").select("dataset", F.struct("mode", "version", chain.alias("chain"), "field_rules", F.coalesce("freshness_field", F.lit("updated_at")).alias("freshness_field")).alias("_policy"))
    own = rows.where(whole).join(named, "dataset")
    if status is not None:
        active = status.where("is_active").groupBy("dataset").agg(F.collect_set("source").alias("_on"))
        own = own.join(active, "dataset", "left").where(F.col("_on").isNull() | F.array_contains("_on", F.col("source")))
    place = F.coalesce(F.nullif(F.array_position("_policy.chain", F.col("source")), F.lit(0)), F.lit(UNKNOWN_PRIORITY))
    fresh = F.coalesce(*[F.when(F.col("_policy.freshness_field") == c, F.unix_micros(F.try_to_timestamp(F.col(c).cast("string")))) for c in fields], F.lit(None).cast("long"))
    candidate = F.struct(place.cast("int").alias("place"), "source", fresh.alias("fresh"), F.struct(*fields).alias("row"))
    met = own.groupBy("dataset", *keys).agg(F.collect_list(candidate).alias("_all"), F.first("_policy").alias("_policy"))
    mode = F.col("_policy.mode")
    first = F.array_min(F.transform("_all", lambda x: F.struct(x["place"].alias("place"), x["source"].alias("source"))))["source"]
    newest = F.array_min(F.transform("_all", lambda x: F.struct(x["fresh"].isNull().alias("none"), (-F.coalesce(x["fresh"], F.lit(0))).alias("age"), x["place"].alias("place"), x["source"].alias("source"))))["source"]
    unknown = F.raise_error(F.concat(F.lit("no such mode: "), F.coalesce(mode, F.lit("null")))).cast("string")
    chosen = met.withColumn("source", F.when(mode.isin(*BY_PRIORITY, BY_FIELD), first).when(mode == BY_FRESHNESS, newest).otherwise(unknown))
    row_of = lambda source: F.filter("_all", lambda x: x["source"] == source)[0]["row"]

    def field(c: str) -> Column:
        rule = F.try_element_at("_policy.field_rules", F.lit(c))
        usable = F.filter(rule["sources"], lambda s: F.exists("_all", lambda x: (x["source"] == s) & (x["row"][c].isNotNull() | ~F.coalesce(rule["skip_empty"], F.lit(False)))))
        ruled = (mode == BY_FIELD) & (F.coalesce(F.size(usable), F.lit(0)) > 0)
        return F.when(ruled, row_of(F.get(usable, F.lit(0)))[c]).otherwise(row_of(F.col("source"))[c])

    listed = F.array_sort(F.array_distinct(F.transform("_all", lambda x: x["source"])))
    audit = F.to_json(F.struct(mode.alias("mode"), F.col("_policy.version").alias("version"), F.col("source"), listed.alias("candidates")))
    return chosen.select(
        "dataset", *keys, *[field(c).alias(c) for c in fields], "source", F.array_join(listed, ",").alias("candidate_sources"), mode.alias("resolution_mode"),
        F.col("_policy.version").alias("resolution_policy_version"), audit.alias("resolution_audit"),
    )


def touched(rows: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The candidates of those keys alone that have changed."""
    return rows.join(changed.select(*keys).distinct(), list(keys), "left_semi")


def conflicts(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], n: int = 0) -> DataFrame:
    """keys, field, n_values: fields on which two or more sources of a key differ; null is a value. n is how many rows there are at most, where that is known."""
    value = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("\x00"))
    kinds = lambda c: F.size(F.collect_set(c)).cast("long")  # noqa: E731  a key has few rows: without a distinct count, they aren't multiplied
    met = dealt(rows.select(*keys, "source", *[value(f).alias(f"_v{i}") for i, f in enumerate(fields)]), *keys, rows=n).groupBy(*keys).agg(kinds("source").alias("_sources"), *[kinds(f"_v{i}").alias(f"_n{i}") for i in range(len(fields))])
    found = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_n{i}").alias("n_values")) for i, f in enumerate(fields)]))
    return met.where("_sources > 1").select(*keys, found.alias("x")).select(*keys, "x.*").where("n_values > 1")


def standardise_flow(rows: DataFrame, buys: Sequence[str], sells: Sequence[str]) -> DataFrame:
    """rows with net_amount: bought less sold, of the sums that are there; null if neither side has any."""
    total = lambda names: F.when(F.coalesce(*names).isNotNull(), reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0)) for n in names]))
    buy, sell = total(list(buys)), total(list(sells))
    net = F.when(buy.isNull() & sell.isNull(), None).otherwise(F.coalesce(buy, F.lit(0)) - F.coalesce(sell, F.lit(0)))
    return rows.withColumn("net_amount", net.cast("decimal(24,4)"))


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str], absolute: float = 1.0, relative: float = 0.03) -> DataFrame:
    """A row for each key of either: presence (only_a, only_b, both), violations (fields where one side alone is null, or that differ by more than absolute and by more than
    relative of the larger size, 1 at least), and worst (the field with the greatest difference)."""
    left = a.select(*keys, F.struct(*fields).alias("_a"))
    right = b.select(*keys, F.struct(*fields).alias("_b"))
    both = dealt(left, *keys).join(dealt(right, *keys), list(keys), "full")
    checks = []
    for f in fields:
        x, y = F.col(f"_a.{f}").cast("double"), F.col(f"_b.{f}").cast("double")
        gap = F.abs(x - y)
        rel = gap / F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
        bad = (x.isNull() != y.isNull()) | F.coalesce((gap > absolute) & (rel > relative), F.lit(False))
        checks.append(F.struct(F.coalesce(gap, F.lit(0.0)).alias("gap"), F.coalesce(rel, F.lit(0.0)).alias("rel"), F.lit(f).alias("field"), bad.alias("bad")))
    presence = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both")
    bad = F.when(F.col("presence") == "both", F.filter(F.array(*checks), lambda c: c["bad"])).otherwise(F.array().cast("array<struct<gap:double,rel:double,field:string,bad:boolean>>"))
    rows = both.withColumn("presence", presence).withColumn("_bad", bad)
    return rows.select(*keys, "presence", F.size("_bad").alias("n_violations"), F.array_join(F.array_sort(F.transform("_bad", lambda c: c["field"])), ",").alias("violations"), F.array_max("_bad")["field"].alias("worst"))


def compare_masters(a: DataFrame, b: DataFrame, code: str) -> DataFrame:
    """code, result (only_a, only_b, diff, same) of two security masters by plain name and exchange (null: empty). Which side has a code is marked, not told from its values."""
    plain = lambda rows, tag: rows.select(code, F.lit(True).alias(f"_{tag}"), plain_name(F.col("name")).alias(f"_n_{tag}"), exchange_code(F.col("exchange")).alias(f"_x_{tag}"))
    differ = (F.col("_n_a") != F.col("_n_b")) | (F.col("_x_a") != F.col("_x_b"))
    return plain(a, "a").join(plain(b, "b"), code, "full").select(code, F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(differ, "diff").otherwise("same").alias("result"))


def direction_mismatch(a: Column, b: Column) -> Column:
    """Whether two net amounts, null as 0, have different signs."""
    return F.signum(F.coalesce(a, F.lit(0)).cast("double")) != F.signum(F.coalesce(b, F.lit(0)).cast("double"))


def sample(rows: DataFrame, by: str, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each class, in order of the keys."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def gate(counts: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """counts with failed: the sorted names of counts above their limit; -1 lets any pass."""
    checks = F.array(*[F.when(F.col(c) > limit, c) for c, limit in limits.items() if limit >= 0]) if any(v >= 0 for v in limits.values()) else F.array().cast("array<string>")
    return counts.withColumn("failed", F.array_join(F.array_sort(F.filter(checks, lambda c: c.isNotNull())), ","))


def audited(resolved: DataFrame, mode: str, version: int) -> DataFrame:
    """resolve()'s rows with how they came about: resolution_mode, resolution_policy_version, candidate_sources (sorted) and resolution_audit (a JSON of them and the source)."""
    named = resolved.withColumnRenamed("source_candidates", "candidate_sources").withColumns({"resolution_mode": F.lit(mode), "resolution_policy_version": F.lit(version)})
    audit = F.to_json(F.struct(F.lit(mode).alias("mode"), F.lit(version).alias("version"), F.col("source"), F.split("candidate_sources", ",").alias("candidates")))
    return named.withColumn("resolution_audit", audit)


def standard_security(rows: DataFrame, vendor: str) -> DataFrame:
    """ts_code, symbol, name, exchange, list_status, security_type, source from either vendor's shape: ``a`` has the columns under their own names; ``b`` has dm (code with market), mc (name, else
    the code) and jys (exchange), and lists live instruments alone. Rows of b without a code are an error."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    if vendor == "a":
        own = [F.col(c) for c in ("ts_code", "symbol", "name", "exchange", "list_status")]
    else:
        code = F.when(text("dm") == "", F.raise_error(F.lit("a row has no dm")).cast("string")).otherwise(text("dm"))
        own = [code.alias("ts_code"), F.substring_index(code, ".", 1).alias("symbol"), F.coalesce(F.nullif(text("mc"), F.lit("")), code).alias("name"), F.nullif(text("jys"), F.lit("")).alias("exchange"), F.lit("L").alias("list_status")]
    return rows.select(*own, F.lit("EQUITY").alias("security_type"), F.lit(vendor).alias("source"))
