"""Vendor files to typed rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def decode_envelope(df: DataFrame, payload: str, columns: Sequence[str]) -> DataFrame:
    """Rows of an envelope {fields: [...], items: [[...], ...]}: items by position of the field's name; fields that it lacks are null."""
    parsed = F.from_json(payload, "struct<fields:array<string>,items:array<array<string>>>")
    items = df.select(parsed.alias("e")).select("e.fields", F.explode("e.items").alias("item"))
    place = lambda name: F.array_position("fields", name)
    return items.select(*[F.when(place(c) > 0, F.get("item", (place(c) - 1).cast("int"))).alias(c) for c in columns])


def decode_list(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """Rows of a JSON list of objects; an error object instead of a list is no rows, and elements that aren't objects are left out."""
    listed = F.when(F.trim(payload).startswith("["), F.from_json(payload, "array<string>"))
    return df.select(F.explode(listed).alias("_x")).where(F.trim("_x").startswith("{")).select(F.from_json("_x", schema).alias("r")).select("r.*")


def read_landed(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, payload of the JSON that has landed in a folder: a row for each file that isn't empty, or for each of its lines that isn't blank."""
    rows = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))
    return rows.where(F.trim("payload") != "") if lines else rows


def _broken(payload: Column) -> Column:
    """Whether a payload is no JSON object or list."""
    kind = F.when(F.trim(payload).startswith("["), F.from_json(payload, "array<string>", {"mode": "PERMISSIVE"}).isNull())
    return F.coalesce(kind, F.from_json(payload, "map<string,string>", {"mode": "PERMISSIVE"}).isNull(), F.lit(True))


def quarantined(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Landed payloads (file, payload) that are JSON, and the others with their size, which are kept aside."""
    marked = landed.withColumn("_broken", _broken(F.col("payload")))
    return marked.where("NOT _broken").drop("_broken"), marked.where("_broken").select("file", "payload", F.octet_length("payload").cast("long").alias("bytes"))


def as_date(c: Column) -> Column:
    """YYYYMMDD or ISO; empty is null, anything else an error."""
    text = F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.when(text.rlike("^[0-9]{8}$"), F.to_date(text, "yyyyMMdd")).otherwise(F.to_date(text, "yyyy-MM-dd"))


def coerce(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """df with its text columns as dates ("date") or decimals ("decimal(18,4)"); empty text is null, text that isn't such a value an error."""
    return df.withColumns({c: as_date(F.col(c)) if kind == "date" else F.nullif(F.trim(F.col(c)), F.lit("")).cast(kind) for c, kind in kinds.items()})


def with_raw(df: DataFrame, name: str = "raw_payload") -> DataFrame:
    """df with each row as JSON text beside its columns."""
    return df.withColumn(name, F.to_json(F.struct(*df.columns)))


def map_columns(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Applies rules (src_field, std_field, std_type; a small table) as a projection; a source that df lacks gives nulls."""
    listed = rules.orderBy("std_field").collect()  # a row for each target column
    pick = lambda r: F.col(r["src_field"]) if r["src_field"] in df.columns else F.lit(None)
    return df.select(*[pick(r).cast(r["std_type"]).alias(r["std_field"]) for r in listed])


RULES = "dataset string, source string, src_field string, std_field string, std_type string, status string"


def map_by_rules(frames: Mapping[tuple[str, str], DataFrame], rules: DataFrame) -> DataFrame:
    """Applies the active rules (RULES) of many datasets and sources in one plan: dataset, source and all target columns, null where a dataset has no rule for one. Rules of other datasets and
    sources, and inactive ones, have no effect; a source without an active rule gives no rows. A target whose rules differ in type is an error."""
    listed = rules.where("status = 'active'").orderBy("dataset", "source", "std_field", "src_field").collect()  # a row for each target column of a source
    types: dict[str, str] = {}
    for r in listed:
        if types.setdefault(r["std_field"], r["std_type"]) != r["std_type"]:
            raise ValueError(f"{r['std_field']} is {types[r['std_field']]} and {r['std_type']}")
    parts = []
    for (dataset, source), df in frames.items():
        own = {r["std_field"]: r["src_field"] for r in listed if (r["dataset"], r["source"]) == (dataset, source)}
        if own:
            value = {std: (F.col(src) if src in df.columns else F.lit(None)).cast(types[std]).alias(std) for std, src in own.items()}
            parts.append(df.select(F.lit(dataset).alias("dataset"), F.lit(source).alias("source"), *value.values()))
    if not parts:
        raise ValueError("no active rule for any of these sources")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def first_existing(df: DataFrame, names: Sequence[str], kind: str) -> Column:
    """The first of the named columns that df has, else null."""
    return next((F.col(n) for n in names if n in df.columns), F.lit(None)).cast(kind)


def split_required(df: DataFrame, keys: Sequence[str], seen: Observation | None = None) -> DataFrame:
    """Rows with all keys. seen counts the others (skipped) and these (kept) in the pass that computes them."""
    whole = F.coalesce(*[F.when(F.col(k).isNull(), 1) for k in keys]).isNull()
    rows = df.observe(seen, F.count_if(~whole).alias("skipped"), F.count_if(whole).alias("kept")) if seen else df
    return rows.where(whole)


def fill_dividend_dates(df: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Carried-out dividends without ex_date: record_date for stock, pay_date for cash alone; filled says which. seen counts both fills (by_record_date, by_pay_date) in the pass that computes them."""
    due = (F.col("div_proc") == "实施") & F.col("ex_date").isNull()
    stock, cash = F.coalesce(F.col("stk_div"), F.lit(0)) > 0, (F.coalesce(F.col("stk_div"), F.lit(0)) == 0) & (F.col("cash_div") > 0)
    filled = F.when(due & stock, "record_date").when(due & cash, "pay_date")
    value = F.when(filled == "record_date", F.col("record_date")).when(filled == "pay_date", F.col("pay_date")).otherwise(F.col("ex_date"))
    out = df.withColumn("filled", filled).withColumn("ex_date", value)
    return out.observe(seen, F.count_if(F.col("filled") == "record_date").alias("by_record_date"), F.count_if(F.col("filled") == "pay_date").alias("by_pay_date")) if seen else out
