"""Indicators over each instrument's bars: moving averages as window frames, and those with recursive state in one grouped Arrow pass."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.lineage import cut

CLOSE_SPANS = (5, 10, 15, 20, 30, 60, 120, 250)
VOLUME_SPANS = (5, 10)
#: Earlier bars that recursive indicators are run over before the asked range.
PREHEAT = 250
STATEFUL = ("ema12", "ema26", "dif", "dea", "macd", "k", "d", "j")


def sma(column: str, n: int, keys: Sequence[str] = ("ts_code",), by: str = "trade_date") -> Column:
    """Mean of the last n rows, where all of them have a value."""
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(w) == n, F.avg(F.col(column).cast("double")).over(w))


def moving_averages(bars: DataFrame, close: Sequence[int] = CLOSE_SPANS, volume: Sequence[int] = VOLUME_SPANS) -> DataFrame:
    """bars with ma<n> and vol_ma<n>: one sort for all frames."""
    return bars.withColumns({f"ma{n}": sma("close", n) for n in close} | {f"vol_ma{n}": sma("vol", n) for n in volume})


def ema(values: np.ndarray, n: int) -> np.ndarray:
    """Exponential average with weight 2 / (n + 1), begun with the first value; rows without a value have none, and carry the state."""
    smoothed = pd.Series(values).ewm(alpha=2.0 / (n + 1), adjust=False, ignore_na=True).mean().to_numpy()
    return np.where(np.isnan(values), np.nan, smoothed)


def kdj(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic K, D and J over the last n rows, smoothed by thirds from 50; rows without a close have none, and carry the state."""
    top = pd.Series(high).rolling(n, min_periods=1).max().to_numpy()
    bottom = pd.Series(low).rolling(n, min_periods=1).min().to_numpy()
    ks, ds = np.full(len(close), np.nan), np.full(len(close), np.nan)
    known = ~(np.isnan(close) | np.isnan(top) | np.isnan(bottom))
    span = np.where(top == bottom, 1.0, top - bottom)[known]
    rsv = np.where((top == bottom)[known], 50.0, (close - bottom)[known] / span * 100.0)
    smoothed = lambda x: pd.Series(np.concatenate([[50.0], x])).ewm(alpha=1.0 / 3.0, adjust=False).mean().to_numpy()[1:]
    ks[known] = smoothed(rsv)
    ds[known] = smoothed(ks[known])
    return ks, ds, 3.0 * ks - 2.0 * ds


def stateful(bars: DataFrame) -> DataFrame:
    """ts_code, trade_date, EMA(12), EMA(26), MACD and KDJ of each code's bars (high, low, close). A code's bars are a group of their own,
    bounded by its trading days."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("trade_date")
        close = rows["close"].to_numpy(float)
        fast, slow = ema(close, 12), ema(close, 26)
        dif = fast - slow
        dea = ema(dif, 9)
        k, d, j = kdj(rows["high"].to_numpy(float), rows["low"].to_numpy(float), close)
        values = dict(zip(STATEFUL, (fast, slow, dif, dea, 2 * (dif - dea), k, d, j)))
        return pd.DataFrame({"ts_code": rows["ts_code"], "trade_date": rows["trade_date"]} | {n: pd.Series(v, index=rows.index) for n, v in values.items()})

    narrow = bars.select("ts_code", "trade_date", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close")])
    code = bars.schema["ts_code"].dataType.simpleString()
    found = narrow.groupBy("ts_code").applyInPandas(run, f"ts_code {code}, trade_date date, " + ", ".join(f"{n} double" for n in STATEFUL))
    return found.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in STATEFUL})


def preheated(bars: DataFrame, start: str, end: str, warm: int = PREHEAT) -> DataFrame:
    """stateful() for bars from start to end, run from warm bars before each code's first one in the range."""
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    placed = bars.where(F.col("trade_date") <= end).withColumn("_n", F.row_number().over(w))
    first = F.min(F.when(F.col("trade_date") >= start, F.col("_n"))).over(Window.partitionBy("ts_code"))
    warmed = placed.withColumn("_first", first).where(F.col("_n") >= F.col("_first") - warm)
    return stateful(warmed).where(F.col("trade_date").between(start, end))


def overlay(computed: DataFrame, stored: DataFrame, suffix: str, names: Sequence[str] = ("dif", "dea", "macd", "k", "d", "j")) -> DataFrame:
    """computed with its indicators replaced by the stored ones of an adjustment (columns <name>_<suffix>); null where no row is stored."""
    chosen = stored.select("ts_code", "trade_date", *[F.col(f"{n}_{suffix}").alias(n) for n in names])
    return computed.drop(*names).join(chosen, ["ts_code", "trade_date"], "left")


def kline(bars: DataFrame, basic: DataFrame, n: int = 300) -> DataFrame:
    """The last n bars of each code with turnover, averages and indicators, rounded to four places, and how far the code's history goes on: bar_count,
    has_more, next_start."""
    w = Window.partitionBy("ts_code")
    placed = moving_averages(bars).join(basic.select("ts_code", "trade_date", "turnover_rate"), ["ts_code", "trade_date"], "left").join(stateful(bars), ["ts_code", "trade_date"])
    ranked = placed.withColumn("_back", F.row_number().over(w.orderBy(F.desc("trade_date"))))
    older = F.max(F.when(F.col("_back") == n + 1, F.col("trade_date"))).over(w)
    counted = ranked.withColumns({"next_start": older, "has_more": older.isNotNull(), "bar_count": F.least(F.count("*").over(w), F.lit(n))})
    rounded = {c: F.round(c, 4) for c in (*[f"ma{k}" for k in CLOSE_SPANS], *[f"vol_ma{k}" for k in VOLUME_SPANS], *STATEFUL)}
    return counted.where(F.col("_back") <= n).drop("_back").withColumns(rounded)


def header(adjusted: DataFrame, plain: DataFrame, basic: DataFrame, n: int = PREHEAT) -> DataFrame:
    """The last bar's row of kline() over the last n bars of each code: adjusted prices where the code has them, else plain ones."""
    chosen = adjusted.withColumn("adjustment", F.lit("forward")).unionByName(plain.join(adjusted.select("ts_code").distinct(), "ts_code", "left_anti").withColumn("adjustment", F.lit("none")))
    back = F.row_number().over(Window.partitionBy("ts_code").orderBy(F.desc("trade_date")))
    recent = cut(chosen.withColumn("_back", back).where(F.col("_back") <= n).drop("_back"))  # read twice by kline()
    rows = kline(recent, basic, n)
    last = F.row_number().over(Window.partitionBy("ts_code").orderBy(F.desc("trade_date")))
    return rows.withColumn("_back", last).where("_back = 1").drop("_back")
