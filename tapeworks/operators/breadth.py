"""Market breadth for every trading day at once: eligible stocks, limit flags, temperature, emotion, themes and the collapse of leaders.

Days are told apart by their place in the calendar: a stock that is absent on a day breaks its streak and has no yesterday.
Counts and thresholds compare decimals by cross-multiplication; rates come out as doubles. ``k`` is the least sample for a rate or a median."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.lineage import dealt

K = 5
TICK = "0.01"
#: Open days that a listing must be old, and from the calendar's start on.
LISTED_DAYS = 19
HISTORY = 20
LOOKBACK = 120
THEME_MEMBERS = 10


def _d(text: str, kind: str = "decimal(6,4)") -> Column:
    return F.lit(text).cast(kind)


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def ratio(part: Column, whole: Column, k: int = K) -> Column:
    """part / whole of two counts, null under k."""
    return F.when((whole >= k) & (whole > 0), part.cast("double") / whole)


def median_of(value: Column, k: int = K) -> Column:
    """Exact median of the values that aren't null, null for fewer than k."""
    return F.when(F.count(value) >= k, F.percentile(value, F.lit(0.5)))


def median_of_counted(value: str, n: str, k: int = K) -> Column:
    """median_of() where each value stands n times."""
    return F.when(F.sum(F.when(F.col(value).isNotNull(), F.col(n))) >= k, F.percentile(value, F.lit(0.5), F.col(n)))


def eligible(bars: DataFrame, security: DataFrame, limits: DataFrame, st: DataFrame, suspended: DataFrame, calendar: DataFrame) -> DataFrame:
    """The day's rows of stocks of the two main exchanges that were listed 19 open days before, aren't flagged or suspended, and have a close, a pre-close and an
    up limit above it; with n, the day's place in the calendar, and the flags of flagged()."""
    keys = ["ts_code", "trade_date"]
    threshold = calendar.select((F.col("n") + LISTED_DAYS).alias("n"), F.col("trade_date").alias("threshold"))
    days = F.broadcast(calendar.join(threshold, "n"))
    rows = bars.join(days, "trade_date").join(F.broadcast(security.select("ts_code", "exchange", "list_date")), "ts_code").where(F.col("exchange").isin("SSE", "SZSE"))
    joined = dealt(rows, *keys).join(dealt(limits, *keys), keys, "left").join(st.select(*keys).distinct(), keys, "left_anti").join(suspended.select(*keys).distinct(), keys, "left_anti")
    base = F.coalesce(F.nullif("limit_pre_close", F.lit(0).cast("decimal(18,4)")), "pre_close")
    return flagged(joined.withColumn("base", base).where(_usable()))


def _usable() -> Column:
    return (F.col("list_date") <= F.col("threshold")) & F.col("close").isNotNull() & (F.col("pre_close") != 0) & (F.col("base") != 0) & (F.col("up_limit") > F.col("base"))


def eligible_of_marked(bars: DataFrame, security: DataFrame, calendar: DataFrame) -> DataFrame:
    """eligible() for bars that have their limits and flags (st, suspended) in the same row, with n and whole cents as prices: all bars of known stocks, where ok says which are eligible. The
    others keep bar_cents alone; their prices are null and their limit flags false. open, close and pre_close come out as doubles, and ret20 is the adjusted return since adj_20."""
    threshold = calendar.select((F.col("n") + LISTED_DAYS).alias("n"), F.col("trade_date").alias("threshold"))
    base = F.coalesce(F.nullif("limit_pre_close", F.lit(0).cast("long")), "pre_close")
    named = bars.join(F.broadcast(threshold), "n", "left").join(F.broadcast(security), "ts_code").withColumn("base", base)
    ok = F.coalesce(F.col("exchange").isin("SSE", "SZSE") & ~F.col("st") & ~F.col("suspended") & _usable(), F.lit(False))
    rows = named.withColumns({"ok": ok, "bar_cents": F.col("close")})
    shown = rows.withColumns({c: F.when(F.col("ok"), F.col(c)) for c in ("open", "high", "low", "close", "pre_close", "up_limit", "down_limit", "base")})
    up, down, base, close, before = (F.col(c) for c in ("up_limit", "down_limit", "base", "close", "pre_close"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    near = lambda c: yes(F.abs(F.col(c) - up) <= 1)
    loss = lambda tenths: (close - before) * base * 10 <= (up - base) * before * -tenths  # noqa: E731  cents: whole numbers, so exact
    close_up, touch = yes(close >= up - 1), yes((F.col("high") >= up - 1) & (F.col("low") < up - 1))
    return shown.withColumns({
        "open": F.col("open") / 100, "close": close / 100, "pre_close": before / 100, "r": (close / 100) / (before / 100) - 1, "red": close > before, "strong": close * 100 >= before * 103, "weak": close * 100 <= before * 97,
        "close_up": close_up, "close_down": yes(close <= down + 1), "tradable_up": close_up & ~(near("open") & near("high") & near("low") & near("close")), "tradable_touch_up": touch, "blast": touch & ~close_up,
        "big_loss": touch & loss(3), "collapsed": loss(7), "ret20": F.when(F.col("ok") & (F.col("adj_20") != 0), _ret20("adj", "adj_20")),
    })


def flagged(rows: DataFrame) -> DataFrame:
    """Return, limit rate and limit flags of each row."""
    up, down, tick = F.col("up_limit"), F.col("down_limit"), _d(TICK, "decimal(3,2)")
    near = lambda c: F.coalesce(F.abs(F.col(c) - up) <= tick, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    between = lambda low, high: (up >= F.col("base") * _d(low)) & (up <= F.col("base") * _d(high))
    first = rows.withColumns({
        "r": _num("close") / _num("pre_close") - 1, "limit_pct": _num("up_limit") / _num("base") - 1, "red": F.col("close") > F.col("pre_close"),
        "strong": F.col("close") >= F.col("pre_close") * _d("1.03"), "weak": F.col("close") <= F.col("pre_close") * _d("0.97"),
        "close_up": yes(F.col("close") >= up - tick), "close_down": yes(F.col("close") <= down + tick), "touch_up": yes(F.col("high") >= up - tick),
        "oneword_up": reduce(lambda a, b: a & b, [near(c) for c in ("open", "high", "low", "close")]),
        "bucket": F.when(between("1.095", "1.105"), "10").when(between("1.195", "1.205"), "20"),
    })
    second = first.withColumns({"tradable_up": F.col("close_up") & ~F.col("oneword_up"), "tradable_touch_up": F.col("touch_up") & yes(F.col("low") < up - tick)})
    loss = lambda share: (F.col("close") - F.col("pre_close")) * F.col("base") <= -_d(share, "decimal(2,1)") * (up - F.col("base")) * F.col("pre_close")
    return second.withColumns({"blast": F.col("tradable_touch_up") & ~F.col("close_up"), "big_loss": F.col("tradable_touch_up") & loss("0.3"), "collapsed": loss("0.7")})


def streaks(rows: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """rows with streak: how many open days in a row the stock has closed at its limit, within the look-back: its place after
    the last day that began a run. One order by code and day serves this and with_yesterday()."""
    w = Window.partitionBy("ts_code").orderBy("n")
    goes_on = F.coalesce(F.lag("close_up").over(w) & (F.lag("n").over(w) == F.col("n") - 1), F.lit(False))
    start = F.max(F.when(F.col("close_up") & ~F.col("_goes_on"), F.col("n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("_goes_on", goes_on).withColumn("_run", F.col("n") - start + 1)
    return placed.withColumn("streak", F.when(F.col("close_up"), F.least("_run", F.lit(lookback + 1))).otherwise(0)).drop("_goes_on", "_run")


def with_yesterday(rows: DataFrame) -> DataFrame:
    """rows with the stock's close, flags and streak of the previous open day, null where it wasn't eligible then: its row before counts only if that is
    one place earlier in the calendar."""
    w = Window.partitionBy("ts_code").orderBy("n")
    yesterday = F.lag("n").over(w) == F.col("n") - 1
    return rows.withColumns({f"y_{c}": F.when(yesterday, F.lag(c).over(w)) for c in ("close", "close_up", "tradable_up", "streak")})


def with_neighbours(rows: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """streaks() and with_yesterday() of eligible_of_marked(), passing over what isn't eligible as if it weren't there, and t_here and t_collapsed: whether the stock is eligible on the next
    open day, and then collapsed. A run's start is looked for in the rows before, so that it serves the streaks of both days."""
    w = Window.partitionBy("ts_code").orderBy("n")
    near = rows.withColumns({"_y": F.lag(F.struct("n", "ok", "close", "close_up", "tradable_up")).over(w), "_t": F.lead(F.struct("n", "ok", "collapsed")).over(w)})
    yesterday = F.coalesce((F.col("_y.n") == F.col("n") - 1) & F.col("_y.ok"), F.lit(False))
    tomorrow = (F.col("_t.n") == F.col("n") + 1) & F.col("_t.ok")
    named = near.withColumns({f"y_{c}": F.when(yesterday, F.col(f"_y.{c}")) for c in ("close", "close_up", "tradable_up")} | {"t_here": F.when(tomorrow, 1), "t_collapsed": F.when(tomorrow, F.col("_t.collapsed"))}).drop("_y", "_t")
    begins = F.when(F.col("close_up") & ~_yes("y_close_up"), F.col("n"))
    start = F.max("_begins").over(w.rowsBetween(Window.unboundedPreceding, -1))
    placed = named.withColumn("_begins", begins).withColumn("_start", start)
    own = F.when(F.col("_begins").isNotNull(), 1).otherwise(F.col("n") - F.col("_start") + 1)
    streak = F.when(F.col("close_up"), F.least(own, F.lit(lookback + 1))).otherwise(0)
    before = F.when(F.col("y_close_up"), F.least(F.col("n") - F.col("_start"), F.lit(lookback + 1))).when(F.col("y_close_up").isNotNull(), 0)
    return placed.withColumns({"streak": streak, "y_streak": before}).drop("_begins", "_start")


def _ret20(last: str, base: str) -> Column:
    return F.round(F.col(last) / F.col(base) - 1, 10)


def _money(total: Column, rows: DataFrame) -> Column:
    """A sum of amounts: rows have them as decimals, or as whole ten-thousandths, whose sums need no decimals for each row and are as exact up to 9e14 (beyond it is an error)."""
    whole = dict(rows.dtypes)["amount"] == "bigint"
    return ((total.cast("decimal(20,0)") * _d("0.0001", "decimal(4,4)")) if whole else total).cast("decimal(30,4)")


def _yes(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def temperature(rows: DataFrame, calendar: DataFrame, k: int = K) -> DataFrame:
    """Each day's universe, share of rising, strong and weak stocks and of those at the down limit, median return, amount, and the amount over the median of
    the 20 days before (at least k of them with an amount)."""
    shares = {"red_rate": "red", "strong3_rate": "strong", "weak3_rate": "weak", "limit_down_rate": "close_down"}
    # equal returns first, by a hash aggregate: percentiles keep a map of values for each group and sort the rows of many groups
    values = rows.groupBy("trade_date", "r").agg(F.count("*").alias("_n"), *[F.count_if(c).alias(c) for c in shares.values()], F.sum("amount").alias("_amount"))
    n = F.sum("_n")
    days = values.groupBy("trade_date").agg(
        n.alias("universe_size"), *[ratio(F.sum(c), n, k).alias(rate) for rate, c in shares.items()], median_of_counted("r", "_n", k).alias("median_return"), _money(F.sum("_amount"), rows).alias("market_amount")
    )
    w = Window.orderBy("n").rowsBetween(-HISTORY, -1)  # a row for each open day of the market
    amount = F.col("market_amount").cast("double")
    placed = calendar.join(days, "trade_date", "left").withColumns({"_seen": F.count(amount).over(w), "_median": F.percentile(amount, F.lit(0.5)).over(w)})
    over = F.when(F.col("_seen") >= k, amount / F.nullif(F.col("_median"), F.lit(0.0)))
    return placed.withColumn("market_amount_ratio_20", over).where(F.col("universe_size").isNotNull()).drop("_seen", "_median")


def _msi(rate: str, seal: str, advance: str, premium: str) -> Column:
    return 30 * F.col(rate) + 25 * F.col(seal) + 20 * F.col(advance) + 25 * F.col(premium)


def emotion(rows: DataFrame, k: int = K, by: tuple[str, ...] = ("trade_date",)) -> DataFrame:
    """Limit-up counts and rates for each day (or day and bucket): rows come from with_yesterday(streaks(...))."""
    pool = _yes("y_tradable_up")
    premium = lambda c: F.when(pool, _num(c) / F.nullif(_num("y_close"), F.lit(0.0)) - 1)
    high = F.coalesce(F.col("y_streak") >= 2, F.lit(False))
    flags = {
        "_n": F.lit(True), "_up": F.col("tradable_up"), "_touched": F.col("tradable_touch_up"), "_blast": F.col("blast"), "_board2": F.col("streak") >= 2, "_advanced": _yes("y_close_up") & F.col("close_up"),
        "_before": _yes("y_close_up"), "_loss": F.col("big_loss"), "_killed": high & ~F.col("close_up") & (F.col("close") < F.col("pre_close")), "_high": high,
    }
    # rows of equal premiums first (most have none), as in temperature()
    values = rows.withColumns({"_open": premium("open"), "_close": premium("close")}).groupBy(*by, "_open", "_close").agg(*[F.count_if(c).alias(name) for name, c in flags.items()], F.max("streak").alias("_streak"))
    n, up, touched = F.sum("_n"), F.sum("_up"), F.sum("_touched")
    return values.groupBy(*by).agg(
        n.alias("sample_size"), up.alias("tradable_up_count"), ratio(up, n, k).alias("tradable_up_rate"), ratio(up, touched, k).alias("seal_success_rate"), ratio(F.sum("_blast"), touched, k).alias("blast_rate"),
        F.sum("_board2").alias("board2plus_count"), ratio(F.sum("_board2"), n, k).alias("board2plus_rate"), F.max("_streak").alias("max_board"), ratio(F.sum("_advanced"), F.sum("_before"), k).alias("advance_rate"),
        median_of_counted("_open", "_n", k).alias("open_premium"), median_of_counted("_close", "_n", k).alias("close_premium"), ratio(F.sum("_loss"), touched, k).alias("big_loss_rate"),
        ratio(F.sum("_killed"), F.sum("_high"), k).alias("high_board_break_kill_rate"),
    )


def bucket_stats(rows: DataFrame, k: int = K) -> DataFrame:
    """trade_date, bucket, its rates and msi, which is null if one of its four terms is."""
    return emotion(rows.where(F.col("bucket").isNotNull()), k, ("trade_date", "bucket")).withColumn("msi", _msi("tradable_up_rate", "seal_success_rate", "advance_rate", "close_premium"))


#: Tags of the market's structure: fixed values.
TAGS = {"few": "样本不足", "ten": "10cm主导", "twenty": "20cm主导", "both": "双线共振", "elastic": "接力弱，弹性强", "relay": "接力强，弹性一般", "even": "双线均衡"}


def structure_tag(msi10: Column, msi20: Column) -> Column:
    """Which of the two limit buckets leads."""
    gap = msi10 - msi20
    return (
        F.when(msi10.isNull() & msi20.isNull(), None).when(msi10.isNull() | msi20.isNull(), TAGS["few"]).when(gap >= 10, TAGS["ten"]).when(gap <= -10, TAGS["twenty"])
        .when((msi10 >= 30) & (msi20 >= 30), TAGS["both"]).when(gap < 0, TAGS["elastic"]).when(gap > 0, TAGS["relay"]).otherwise(TAGS["even"])
    )


def structure(buckets: DataFrame) -> DataFrame:
    """trade_date, msi10, msi20, structure_tag."""
    sides = buckets.groupBy("trade_date").agg(F.max(F.when(F.col("bucket") == "10", F.col("msi"))).alias("msi10"), F.max(F.when(F.col("bucket") == "20", F.col("msi"))).alias("msi20"))
    return sides.withColumn("structure_tag", structure_tag(F.col("msi10"), F.col("msi20")))


def percent_rank(value: str, within: Window) -> Column:
    """Rank from 0 to 100 among the partition's values, ties by their mean; alone: 100."""
    n = F.count("*").over(within)
    rank = F.rank().over(within.orderBy(value)) - 1
    same = F.count("*").over(within.orderBy(value).rangeBetween(0, 0))
    return F.when(n == 1, 100.0).otherwise((rank + (same - 1) / 2) / (n - 1) * 100)


def themes(rows: DataFrame, members: DataFrame, k: int = K, min_members: int = THEME_MEMBERS, unique: bool = False) -> DataFrame:
    """trade_date, theme, place: all scored themes of each day by score (ties by theme). A theme's amount is set against the median of its amounts on those of
    the 20 open days before on which it had any, at least k. unique: no member stands twice."""
    named = members.select("trade_date", F.col("ts_code").alias("theme"), F.col("con_code").alias("ts_code"))
    keys = ["ts_code", "trade_date"]
    joined = dealt(named if unique else named.distinct(), *keys).join(dealt(rows.select(*keys, "n", "r", "red", "amount"), *keys), keys)
    return scored_themes(dealt(joined, "theme", "trade_date"), k, min_members)


def themes_of(rows: DataFrame, k: int = K, min_members: int = THEME_MEMBERS) -> DataFrame:
    """themes() of rows that have an array of their boards: a day's rows are dealt out to one place, and only there stand once for each board."""
    named = dealt(rows.select("trade_date", "n", "r", "red", "amount", "boards").where(F.size("boards") > 0), "trade_date")
    return scored_themes(named.select("trade_date", "n", "r", "red", "amount", F.explode("boards").alias("theme")), k, min_members)


def scored_themes(joined: DataFrame, k: int, min_members: int) -> DataFrame:
    """themes() of rows that stand once for each of their themes."""
    # dealt out once, and then as in temperature()
    values = joined.groupBy("theme", "trade_date", "n", "r").agg(F.count("*").alias("_n"), F.count_if("red").alias("_red"), F.sum("amount").alias("_amount"))
    n = F.sum("_n")
    days = values.groupBy("theme", "trade_date", "n").agg(n.alias("member_count"), F.percentile("r", F.lit(0.5), F.col("_n")).alias("theme_return"), ratio(F.sum("_red"), n, k).alias("theme_red_rate"), _money(F.sum("_amount"), joined).alias("theme_amount"))
    w = Window.partitionBy("theme").orderBy("n").rangeBetween(-HISTORY, -1)
    amount = F.col("theme_amount").cast("double")
    over = F.when(F.count(amount).over(w) >= k, amount / F.nullif(F.percentile(amount, F.lit(0.5)).over(w), F.lit(0.0)))
    scored = days.withColumn("theme_amount_ratio", over).where((F.col("member_count") >= min_members) & F.col("theme_return").isNotNull() & F.col("theme_red_rate").isNotNull() & F.col("theme_amount_ratio").isNotNull())
    day = Window.partitionBy("trade_date")
    total = 0.4 * percent_rank("theme_return", day) + 0.3 * percent_rank("theme_red_rate", day) + 0.3 * percent_rank("theme_amount_ratio", day)
    ranked = scored.withColumn("theme_score", F.round(total, 8))
    return ranked.withColumn("place", F.row_number().over(day.orderBy(F.desc("theme_score"), "theme")))


def concentration(scored: DataFrame, rows: DataFrame, members: DataFrame) -> DataFrame:
    """trade_date, mainline_concentration: the amount of the stocks in the day's first three themes, each counted once, over the market's."""
    top = scored.where("place <= 3").select("trade_date", F.col("theme").alias("ts_code"))
    keys = ["ts_code", "trade_date"]
    codes = dealt(members.join(F.broadcast(top), ["trade_date", "ts_code"]).select("trade_date", F.col("con_code").alias("ts_code")), *keys).distinct()
    inside = dealt(rows.select(*keys, "amount"), *keys).join(codes, keys).groupBy("trade_date").agg(F.sum("amount").alias("inside"))
    market = rows.groupBy("trade_date").agg(F.sum("amount").alias("market"))
    return inside.join(market, "trade_date").select("trade_date", (_num("inside") / F.nullif(_num("market"), F.lit(0.0))).alias("mainline_concentration"))


def concentration_of(scored: DataFrame, rows: DataFrame) -> DataFrame:
    """concentration() of rows that have an array of their boards, in one pass."""
    top = scored.where("place <= 3").groupBy("trade_date").agg(F.collect_list("theme").alias("_top"))
    inside = F.coalesce(F.arrays_overlap("boards", "_top"), F.lit(False))
    sums = rows.join(F.broadcast(top), "trade_date").groupBy("trade_date").agg(F.sum(F.when(inside, F.col("amount"))).alias("inside"), F.sum("amount").alias("market"))
    share = _money(F.col("inside"), rows).cast("double") / F.nullif(_money(F.col("market"), rows).cast("double"), F.lit(0.0))
    return sums.select("trade_date", share.alias("mainline_concentration"))


def theme_coverage(members: DataFrame, calendar: DataFrame) -> DataFrame:
    """trade_date, theme_day_coverage: how many of the day and the 20 before it have members."""
    days = calendar.join(members.select("trade_date", F.lit(1).alias("_has")).distinct(), "trade_date", "left")
    return days.select("trade_date", F.count("_has").over(Window.orderBy("n").rowsBetween(-HISTORY, 0)).alias("theme_day_coverage"))


def collapse(rows: DataFrame, bars: DataFrame, factors: DataFrame, calendar: DataFrame, k: int = K) -> DataFrame:
    """trade_date, high_collapse_rate, high_pool_size, high_pool_effective_size: of the tenth of stocks with the greatest adjusted return from the 21st open day
    before to the last one (among those eligible then, ties by code), the share of those eligible today that lost 0.7 of their limit or more."""
    keys = ["ts_code", "trade_date"]
    prices = dealt(bars.join(F.broadcast(calendar), "trade_date"), *keys).join(dealt(factors, *keys), keys).select("ts_code", "n", (_num("close") * _num("adj_factor")).alias("adj"))
    before = Window.partitionBy("ts_code").orderBy("n").rangeBetween(-HISTORY, -HISTORY)  # the one row so many places earlier, if there is one
    paired = dealt(prices, "ts_code").withColumn("base", F.max("adj").over(before)).where("base != 0")
    last = dealt(paired, "ts_code", "n").join(dealt(rows.select("ts_code", "n"), "ts_code", "n"), ["ts_code", "n"]).select("ts_code", (F.col("n") + 1).alias("n"), F.col("adj").alias("last"), "base")
    leaders = _leaders(last.withColumn("ret20", _ret20("last", "base")), k)
    today = rows.select("ts_code", "n", "collapsed", F.lit(1).alias("_here"))
    return _rated(leaders.join(today, ["ts_code", "n"], "left"), calendar, k)


def collapse_of(rows: DataFrame, calendar: DataFrame, k: int = K) -> DataFrame:
    """collapse() of eligible rows that have ret20 and what comes tomorrow."""
    pool = rows.where(F.col("ret20").isNotNull()).select("ts_code", (F.col("n") + 1).alias("n"), "ret20", F.col("t_here").alias("_here"), F.col("t_collapsed").alias("collapsed"))
    return _rated(_leaders(dealt(pool, "n"), k), calendar, k)


def _leaders(pool: DataFrame, k: int) -> DataFrame:
    day = Window.partitionBy("n")
    ranked = pool.withColumns({"size": F.count("*").over(day), "place": F.row_number().over(day.orderBy(F.desc("ret20"), "ts_code"))})
    return ranked.where((F.col("size") >= k) & (F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("size") * 0.1))))


def _rated(leaders: DataFrame, calendar: DataFrame, k: int) -> DataFrame:
    rated = leaders.groupBy("n").agg(
        F.max("size").alias("high_pool_size"), F.count("_here").alias("high_pool_effective_size"), ratio(F.count_if(_yes("collapsed")), F.count("_here"), k).alias("high_collapse_rate")
    )
    return rated.join(F.broadcast(calendar), "n").select("trade_date", "high_collapse_rate", "high_pool_size", "high_pool_effective_size")


def index_returns(index_bars: DataFrame) -> DataFrame:
    """trade_date, index_code, index_return: close over pre-close."""
    return index_bars.where((F.col("pre_close") != 0) & F.col("close").isNotNull()).select("trade_date", "index_code", (_num("close") / _num("pre_close") - 1).alias("index_return"))


def spread(returns: DataFrame, small: object, large: object) -> DataFrame:
    """trade_date, small_vs_large: one benchmark's return less the other's."""
    pick = lambda code: F.max(F.when(F.col("index_code") == code, F.col("index_return")))
    return returns.groupBy("trade_date").agg((pick(small) - pick(large)).alias("small_vs_large"))


def top_share(rows: DataFrame, by: str, share: float = 0.1) -> DataFrame:
    """Of each day the max(1, ceil(share * n)) rows that are greatest by a column (ties by code); rows without a value don't count."""
    w = Window.partitionBy("trade_date")
    known = rows.where(F.col(by).isNotNull()).withColumns({"_n": F.count("*").over(w), "_p": F.row_number().over(w.orderBy(F.desc(by), "ts_code"))})
    return known.where(F.col("_p") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).drop("_n", "_p")
