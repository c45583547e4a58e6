"""Bars: price adjustment, weekly and monthly bars, precedence of sources, and daily snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close", "pre_close", "change_amount")


def anchors(factors: DataFrame, forward: bool) -> DataFrame:
    """ts_code, anchor: the factor at the last date (forward) or the first one (backward) of each code."""
    pick = F.max_by if forward else F.min_by
    return factors.groupBy("ts_code").agg(pick("adj_factor", "trade_date").alias("anchor"))


def adjustment_gaps(bars: DataFrame, factors: DataFrame, forward: bool = True, sample: int = 3) -> DataFrame:
    """ts_code, reason, n_missing, first_dates: codes that can't be adjusted, as bars lack their factors (missing_factor), or as the anchor is null or 0 (missing_anchor)."""
    missing = bars.join(factors.where(F.col("adj_factor").isNotNull()), ["ts_code", "trade_date"], "left_anti")
    dates = F.slice(F.array_sort(F.collect_set("trade_date")), 1, sample).alias("first_dates")
    holes = missing.groupBy("ts_code").agg(F.lit("missing_factor").alias("reason"), F.count("*").alias("n_missing"), dates)
    useless = anchors(factors, forward).where(F.col("anchor").isNull() | (F.col("anchor") == 0)).join(bars.select("ts_code").distinct(), "ts_code", "left_semi").join(holes, "ts_code", "left_anti")
    none = useless.select("ts_code", F.lit("missing_anchor").alias("reason"), F.lit(0).cast("long").alias("n_missing"), F.array().cast(holes.schema["first_dates"].dataType).alias("first_dates"))
    return holes.unionByName(none)


def adjusted(bars: DataFrame, factors: DataFrame, forward: bool = True) -> DataFrame:
    """Bars with prices, and their change, scaled by factor over anchor in whole numbers (see scaled_price). Codes with an incomplete or useless set of factors are left out (see adjustment_gaps)."""
    pick = F.max_by if forward else F.min_by
    own = Window.partitionBy("ts_code")
    anchored = factors.withColumn("anchor", pick("adj_factor", "trade_date").over(own))
    joined = bars.join(anchored, ["ts_code", "trade_date"], "left")
    whole = joined.withColumn("_gaps", F.count_if(F.col("adj_factor").isNull()).over(own)).where("_gaps = 0 AND anchor != 0")
    scaled = [scaled_price(F.col(c), F.col("adj_factor"), F.col("anchor")).alias(c) if c in PRICES else F.col(c) for c in bars.columns]
    return whole.select(*scaled)


def forward_view(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Forward-adjusted open, high, low and close in decimals; bars without a factor vanish."""
    anchored = factors.withColumn("factor_end", F.max_by("adj_factor", "trade_date").over(Window.partitionBy("ts_code")))
    joined = bars.join(anchored, ["ts_code", "trade_date"])
    price = lambda c: scaled_price(F.col(c), F.col("adj_factor"), F.col("factor_end"), even=False).alias(f"{c}_qfq")
    return joined.select("ts_code", "trade_date", *[price(c) for c in ("open", "high", "low", "close")])


def scaled_price(price: Column, factor: Column, end_factor: Column, even: bool = True) -> Column:
    """Price (four places) times factor over end factor (eight places each), rounded to four places: half to even, or half away from zero. The quotient is taken
    in whole numbers with its remainder, so that nothing is rounded twice; null without an end factor, or with one of 0."""
    whole = lambda c, places: F.round(c.cast("decimal(30,8)") * F.lit(10**places), 0)
    product = F.abs(whole(price, 4).cast("decimal(19,0)") * whole(factor, 8).cast("decimal(18,0)"))
    over = F.abs(F.nullif(whole(end_factor, 8).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")))
    quotient, twice = F.call_function("div", product, over), 2 * (product % over)
    up = (twice > over) | ((twice == over) & (quotient % 2 == 1)) if even else twice >= over
    size = (quotient + F.when(up, 1).otherwise(0)).cast("decimal(18,0)") * F.lit(Decimal("0.0001"))
    negative = (price < 0) != ((factor < 0) != (end_factor < 0))
    return F.when(negative, -size).otherwise(size).cast("decimal(18,4)")


def period_starts(calendar: DataFrame, unit: str) -> DataFrame:
    """period, period_start: the first open day of each natural week or month (by its first day)."""
    days = calendar.where("is_open").select(F.date_trunc(unit, "trade_date").cast("date").alias("period"), "trade_date")
    return days.groupBy("period").agg(F.min("trade_date").alias("period_start"))


def period_bars(daily: DataFrame, unit: str) -> DataFrame:
    """Weekly or monthly bars from daily ones, keyed by code and natural period; trade_date is the last day traded. One aggregate, with
    partial sums before the exchange."""
    rows = daily.withColumn("period", F.date_trunc(unit, "trade_date").cast("date"))
    bars = rows.groupBy("ts_code", "period").agg(
        F.max("trade_date").alias("trade_date"), F.min_by("open", "trade_date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "trade_date").alias("close"), F.min_by("pre_close", "trade_date").alias("pre_close"), F.sum("vol").alias("vol"), F.sum("amount").alias("amount"),
    )
    change = F.col("close") - F.col("pre_close")
    pct = F.round((F.col("close").cast("double") / F.nullif(F.col("pre_close").cast("double"), F.lit(0.0)) - 1) * 100, 4)
    return bars.withColumns({"change_amount": change, "pct_chg": pct})


def with_precedence(vendor: DataFrame, derived: DataFrame, period: str = "period") -> DataFrame:
    """Vendor rows, and derived ones for periods and last days that no vendor row of the code has."""
    free = derived.join(vendor.select("ts_code", period), ["ts_code", period], "left_anti").join(vendor.select("ts_code", "trade_date"), ["ts_code", "trade_date"], "left_anti")
    return vendor.unionByName(free)


def carried(period: DataFrame, close: str, suffix: str) -> DataFrame:
    """Bars of one adjustment: pre_close is the bar's own predecessor's close, else what the row says; change to four places."""
    before = F.lag(close).over(Window.partitionBy("ts_code").orderBy("trade_date"))
    pre = F.coalesce(before, F.col("pre_close"))
    return period.select("ts_code", "trade_date", F.col(close).alias(f"close_{suffix}"), pre.alias("pre_close"), F.bround(F.col(close) - pre, 4).alias("change_amount"))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], by: str, columns: Sequence[str]) -> DataFrame:
    """left with, for each row, the columns of right's last row of its key at or before it. One exchange: both sides are put in order together, and the
    last known row is carried along; of rows of right with one key and time the greatest counts."""
    known = F.struct(by, *columns)
    a = left.select(*[F.col(c) for c in left.columns], F.lit(None).cast(right.select(known.alias("k")).schema["k"].dataType).alias("_known"), F.lit(1).alias("_left"))
    b = right.select(*[F.col(c) if c in (*keys, by) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], known.alias("_known"), F.lit(0).alias("_left"))
    w = Window.partitionBy(*keys).orderBy(by, "_left", "_known").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn("_last", F.last("_known", ignorenulls=True).over(w)).where("_left = 1")
    return filled.select(*left.columns, F.col(f"_last.{by}").alias(f"asof_{by}"), *[F.col(f"_last.{c}").alias(c) for c in columns])


def snapshot(bars: DataFrame, security: DataFrame, basic: DataFrame, flow: DataFrame) -> DataFrame:
    """A row for each bar with its security, ratios and money flow."""
    keys = ["ts_code", "trade_date"]
    return bars.join(security, "ts_code").join(basic, keys, "left").join(flow, keys, "left")


def market_summary(rows: DataFrame) -> DataFrame:
    """For each day: how many rows went up, down and nowhere, the mean change and the amount."""
    c = F.col("pct_chg")
    return rows.groupBy("trade_date").agg(
        F.count("*").alias("total"), F.count_if(c > 0).alias("up_count"), F.count_if(c < 0).alias("down_count"), F.count_if(c == 0).alias("flat_count"),
        F.round(F.avg(c), 8).alias("avg_pct_chg"), F.sum("amount").alias("total_amount"),
    )


def top(rows: DataFrame, by: str, k: int, ties: Sequence[str], descending: bool = True) -> DataFrame:
    """The k (1 to 30) rows that are greatest or least by a column, nulls left out."""
    k = max(1, min(30, k))
    order = F.col(by).desc() if descending else F.col(by).asc()
    return rows.where(F.col(by).isNotNull()).orderBy(order, *ties).limit(k)
