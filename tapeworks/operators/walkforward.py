"""Walk-forward validation of the breadth scores: scores, labels, expanding folds, a back-off probability model and its metrics.

Days are few (one row each), so windows over all of them are one task by nature; folds are a join by range on the day's place. The training rows of a fold are
all rows before it; the rows between training and test are reported and unused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.lineage import cut

#: Weight, low and high of each term; negative weights count the term's complement. Fixed values.
MTI = {
    "red_rate": (0.18, 0.35, 0.85), "median_return": (0.16, -0.03, 0.03), "strong3_rate": (0.10, 0.0, 0.25), "weak3_rate": (-0.10, 0.0, 0.15), "market_amount_ratio_20": (0.12, 0.8, 1.4),
    "small_vs_large": (0.08, -0.03, 0.03), "mainline_concentration": (0.10, 0.0, 0.2), "limit_down_rate": (-0.08, 0.0, 0.03), "high_collapse_rate": (-0.08, 0.0, 0.12),
}
MSI = {
    "tradable_up_rate": (0.18, 0.0, 0.06), "seal_success_rate": (0.16, 0.4, 1.0), "blast_rate": (-0.12, 0.0, 0.6), "board2plus_rate": (0.10, 0.0, 0.03), "max_board": (0.10, 0.0, 8.0),
    "advance_rate": (0.12, 0.0, 0.5), "close_premium": (0.10, -0.03, 0.05), "big_loss_rate": (-0.07, 0.0, 0.4), "high_board_break_kill_rate": (-0.05, 0.0, 0.6),
}
RSK = {"high_collapse_rate": (0.40, 0.0, 0.2), "blast_rate": (0.35, 0.0, 0.6), "limit_down_rate": (0.25, 0.0, 0.04)}
#: Low and high bound of a score's middle bucket.
BUCKETS = {"mti": (40.0, 65.0), "msi": (35.0, 70.0), "rsk": (45.0, 65.0)}
#: Days before the first scored one.
WARM_UP = 21
LABELS = ("env_continue", "mainline_expand", "risk_event")
STATE = ("b_mti", "b_msi", "b_rsk", "s_mti", "s_msi")
#: How many of STATE's columns each level of the model uses.
LEVELS = (5, 3, 2, 1)


def n_pos(x: Column, low: float, high: float) -> Column:
    """Where x lies between low and high, 0 to 1; a half where it is null."""
    return F.coalesce(F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0)), F.lit(0.5))


def score(terms: dict[str, tuple[float, float, float]]) -> Column:
    total = F.lit(0.0)
    for name, (weight, low, high) in terms.items():
        part = n_pos(F.col(name).cast("double"), low, high)
        total = total + abs(weight) * (part if weight > 0 else 1 - part)
    return F.round(F.least(F.greatest(total * 100, F.lit(0.0)), F.lit(100.0)), 8)


def scores(days: DataFrame) -> DataFrame:
    """days (trade_date and all terms) with mti, msi, rsk and their changes from the row before (0 in the first)."""
    scored = days.withColumns({"mti": score(MTI), "msi": score(MSI), "rsk": score(RSK)})
    w = Window.orderBy("trade_date")
    deltas = {f"d_{c}": F.coalesce(F.round(F.col(c) - F.lag(c).over(w), 8), F.lit(0.0)) for c in ("mti", "msi", "rsk")}
    return scored.withColumns(deltas).withColumn("i", F.row_number().over(w) - 1)


def labels(scored: DataFrame, temp_slack: float = 5.0, emotion_slack: float = 8.0, expand_slack: float = 0.005, history: int = 252, least: int = 20, q: float = 0.8) -> DataFrame:
    """All rows but the last with their labels, by what the next row shows: the environment goes on, the themes' share grows, and a risk event: one of three rates
    above its own trailing quantile (of the rows before that next row; null with fewer than least values)."""
    w = Window.orderBy("i")
    trailing = w.rowsBetween(-history, -1)
    risks = ("high_collapse_rate", "blast_rate", "limit_down_rate")
    limits = scored.withColumns({f"q_{c}": F.when(F.count(c).over(trailing) >= least, F.percentile(c, F.lit(q)).over(trailing)) for c in risks})
    over = limits.withColumn("_event", F.when(F.coalesce(*[F.when(F.col(f"q_{c}").isNull() | F.col(c).isNull(), 1) for c in risks]).isNull(), (F.greatest(*[(F.round(c, 10) > F.round(f"q_{c}", 10)).cast("int") for c in risks]))))
    following = lambda c: F.lead(c).over(w)
    env = (F.round(following("mti") - F.col("mti"), 6) >= -temp_slack) & (F.round(following("msi") - F.col("msi"), 6) >= -emotion_slack)
    expand = F.round(following("mainline_concentration") - F.col("mainline_concentration"), 10) >= -expand_slack
    named = over.withColumns({
        "y_env_continue": env.cast("int"), "y_mainline_expand": expand.cast("int"), "y_risk_event": following("_event"), "y_red_next": following("red_rate"),
        "y_tradable_up_next": following("tradable_up_rate"), "_last": following("i").isNull(),
    })
    return named.where(~F.col("_last")).drop("_last", "_event")


def bucket(c: str, low: float, high: float) -> Column:
    return F.when(F.col(c) < low, "low").when(F.col(c) < high, "mid").otherwise("high")


def sign(c: str, tolerance: float = 1e-6) -> Column:
    return F.when(F.col(c) > tolerance, 1).when(F.col(c) < -tolerance, -1).otherwise(0)


def states(samples: DataFrame) -> DataFrame:
    return samples.withColumns({f"b_{c}": bucket(c, *BUCKETS[c]) for c in ("mti", "msi", "rsk")} | {f"s_{c}": sign(f"d_{c}") for c in ("mti", "msi")})


def folds(samples: DataFrame, train: int = 140, valid: int = 40, test: int = 20, roll: int = 20) -> DataFrame:
    """fold (from 1), train_end, valid_end, test_end: places, ends exclusive, of all folds that fit."""
    n = samples.agg(F.count("*").alias("n"))
    last = F.floor((F.col("n") - train - valid - test) / roll)
    ids = n.where(F.col("n") >= train + valid + test).select(F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("_f"))
    end = F.lit(train) + F.col("_f") * roll
    return ids.select((F.col("_f") + 1).alias("fold"), end.alias("train_end"), (end + valid).alias("valid_end"), (end + valid + test).alias("test_end"))


def state_counts(samples: DataFrame, plan: DataFrame) -> DataFrame:
    """fold, label, level, the state's columns, n, positives: one pass of grouping sets over each fold's training rows; level 4 is the whole fold."""
    rows = states(samples).join(F.broadcast(plan.select("fold", "train_end")), F.col("i") < F.col("train_end"))
    long = rows.select("fold", *STATE, F.explode(F.array(*[F.struct(F.lit(name).alias("label"), F.col(f"y_{name}").alias("y")) for name in LABELS])).alias("x")).select("fold", *STATE, "x.label", "x.y").where(F.col("y").isNotNull())
    sets = [[F.col("fold"), F.col("label"), *[F.col(c) for c in STATE[:k]]] for k in (*LEVELS, 0)]
    counted = long.groupingSets(sets, "fold", "label", *STATE).agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.grouping_id().alias("_g"))
    level = F.when(F.col("_g") == 0, 0).when(F.col("_g") == 3, 1).when(F.col("_g") == 7, 2).when(F.col("_g") == 15, 3).otherwise(4)
    return counted.withColumn("level", level).drop("_g")


def predictions(samples: DataFrame, plan: DataFrame, min_samples: int = 30, prior: float = 5.0) -> DataFrame:
    """The test rows of each fold with p_<label>: the rate, shrunk to the fold's, of the finest of the row's states that has enough training rows, else the fold's
    rate, else a half."""
    samples, plan = cut(samples), cut(plan)
    counts = cut(state_counts(samples, plan))
    rows = states(samples).join(F.broadcast(plan), (F.col("i") >= F.col("valid_end")) & (F.col("i") < F.col("test_end")))
    least = (min_samples, max(15, min_samples // 2), max(10, min_samples // 3), 5)
    for name in LABELS:
        own = counts.where(F.col("label") == name)
        base = own.where("level = 4").select("fold", (F.col("positives") / F.col("n")).alias("_g"))
        rows = rows.join(F.broadcast(base), "fold", "left")
        rate = F.coalesce(F.col("_g"), F.lit(0.5))
        options = []
        for level, size in enumerate(LEVELS):
            keys = ["fold", *STATE[:size]]
            known = own.where((F.col("level") == level) & (F.col("n") >= least[level])).select(*keys, F.col("n").alias(f"_n{level}"), F.col("positives").alias(f"_y{level}"))
            rows = rows.join(F.broadcast(known), keys, "left")
            options.append((F.col(f"_y{level}") + rate * prior) / (F.col(f"_n{level}") + prior))
        rows = rows.withColumn(f"p_{name}", F.round(F.coalesce(*options, rate), 8)).drop("_g", *[f"_{c}{i}" for c in "ny" for i in range(4)])
    return rows


CAPS = {"A0": 0.20, "A1": 0.50, "A2": 0.70, "A3": 0.35, "A4": 0.30}


def playbook(p_env: Column, p_risk: Column) -> Column:
    """The rule that fits the scores and probabilities first."""
    mti, msi, rsk = F.col("mti"), F.col("msi"), F.col("rsk")
    return (
        F.when((p_risk >= 0.6) | (rsk >= 70), F.when(mti >= 55, "A4").otherwise("A0")).when((mti >= 65) & (msi >= 35) & (msi < 75) & (p_env >= 0.55) & (p_risk < 0.35), "A2").when((mti >= 60) & (msi < 45), "A1")
        .when((mti < 50) & (msi >= 60) & (p_risk < 0.4), "A3").when((mti >= 75) & (msi >= 75) & (rsk >= 60), "A4").when(mti >= 50, "A1").otherwise("A0")
    )


def decisions(predicted: DataFrame) -> DataFrame:
    """predicted with playbook, exposure (0 to the playbook's cap) and allow_chase."""
    env, main, risk = (F.col(f"p_{name}") for name in LABELS)
    base = F.least(F.greatest(0.15 + 0.45 * env + 0.20 * main - 0.50 * risk, F.lit(0.0)), F.lit(0.8))
    cap = F.create_map(*[F.lit(x) for pair in CAPS.items() for x in pair])
    named = predicted.withColumn("playbook", playbook(env, risk))
    chase = F.col("msi").between(55, 75) & (F.col("rsk") < 60) & (risk < 0.35)
    return named.withColumns({"exposure": F.round(F.least(base, cap[F.col("playbook")]), 8), "allow_chase": chase})


def rank_correlation(rows: DataFrame, x: str, y: str, by: tuple[str, ...]) -> DataFrame:
    """by, ic: Spearman's correlation of the rows where y is there, ties by mean ranks; null for fewer than three rows or a constant side."""
    used = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    group = Window.partitionBy(*by)
    rank = lambda c: F.rank().over(group.orderBy(c)) + (F.count("*").over(group.orderBy(c).rangeBetween(0, 0)) - 1) / 2
    ranked = used.withColumns({"_x": rank(x), "_y": rank(y)})
    n, varies = F.count("*"), (F.min("_x") < F.max("_x")) & (F.min("_y") < F.max("_y"))
    return ranked.groupBy(*by).agg(F.when((n >= 3) & varies, F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))).alias("ic"))


def brier(name: str) -> Column:
    return F.avg(F.when(F.col(f"y_{name}").isNotNull(), F.pow(F.col(f"p_{name}") - F.col(f"y_{name}"), F.lit(2.0))))


def metrics(decided: DataFrame, by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Brier scores, rank correlations, mean exposure and how often each playbook was chosen, for each fold (or group)."""
    sums = decided.groupBy(*by).agg(F.count("*").alias("test_size"), *[brier(n).alias(f"brier_{n}") for n in LABELS], F.avg("exposure").alias("avg_exposure"), *[F.count_if(F.col("playbook") == p).alias(f"n_{p.lower()}") for p in CAPS])
    red = rank_correlation(decided, "mti", "y_red_next", by).withColumnRenamed("ic", "mti_red_ic")
    up = rank_correlation(decided, "msi", "y_tradable_up_next", by).withColumnRenamed("ic", "msi_up_ic")
    return sums.join(red, list(by), "left").join(up, list(by), "left")
