"""Schedules, resampling and multiple-testing over observed returns.

Draws come from the md5 of seed, replicate and position, so every engine and every
rerun makes the same ones. Resamples are joins of replicate indices with rows and
grouped aggregates; nothing is looped on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X


def positions(calendar: DataFrame, ts: str = "date") -> DataFrame:
    """``ts, pos``: the distinct days numbered from 0 (a calendar, one row a day)."""
    return calendar.select(ts).distinct().withColumn("pos", F.row_number().over(W.orderBy(ts)) - 1)


def walk_forward(calendar: DataFrame, train: int, purge: int, validation: int, embargo: int, test: int, step: int | None = None, ts: str = "date") -> DataFrame:
    """Windows by row position: train, purge, validation, embargo, test; a row for each window with the days each part begins and ends."""
    pos = positions(calendar, ts)
    span = train + purge + validation + embargo + test
    starts = pos.agg((F.max("pos") + 1).alias("n")).where(F.col("n") >= span).select(F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n") - span).cast("long"), F.lit(step or test).cast("long"))).alias("at"))
    edges = {"train_start": 0, "train_end": train - 1, "validation_start": train + purge, "validation_end": train + purge + validation - 1, "test_start": span - test, "test_end": span - 1}
    numbered = starts.withColumn("window", F.row_number().over(W.orderBy("at")))
    long = numbered.select("window", "at", F.explode(F.create_map(*[F.lit(x) for kv in edges.items() for x in kv])).alias("edge", "offset"))
    dated = long.withColumn("pos", (F.col("at") + F.col("offset")).cast("int")).join(pos, "pos")
    return dated.groupBy("window").pivot("edge", list(edges)).agg(F.first(ts))


def holding_schedule(calendar: DataFrame, rebalances: DataFrame, embargo: int, ts: str = "date") -> DataFrame:
    """Rebalance days snapped back to the calendar; the signal is of ``embargo`` positions before."""
    pos = positions(calendar, ts)
    snapped = rebalances.join(F.broadcast(pos), F.col(ts) <= F.col("rebalance")).groupBy("rebalance").agg(F.max("pos").alias("at"))  # a calendar
    by = lambda p, name: pos.select(F.col("pos").alias(p), F.col(ts).alias(name))
    return snapped.join(by("at", "trade_date"), "at").withColumn("signal_at", F.col("at") - embargo).join(by("signal_at", "signal_date"), "signal_at", "left").select("rebalance", "trade_date", "signal_date")


def turnover(weights: DataFrame, *, period: str, key: str, weight: str = "weight", vol: str = "vol", fixed_bps: float = 10.0, impact: float = 0.1) -> DataFrame:
    """Half the sum of absolute changes at each period, fixed costs and impact with the 1.5th power of the change."""
    order = weights.select(period).distinct().withColumn("_k", F.row_number().over(W.orderBy(period)))
    w = weights.select(period, key, weight, vol).join(F.broadcast(order), period)  # one row a period
    both = w.select("_k", key, F.col(weight).alias("_new"), F.col(vol).alias("_v")).join(w.select((F.col("_k") + 1).alias("_k"), key, F.col(weight).alias("_old"), F.col(vol).alias("_ov")), ["_k", key], "full")
    change = F.abs(F.coalesce("_new", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0)))
    out = both.groupBy("_k").agg((F.sum(change) / 2).alias("turnover"), F.sum(impact * F.pow(change, 1.5) * F.coalesce("_v", "_ov")).alias("impact_cost"))
    return out.join(order, "_k").withColumn("fixed_cost", F.col("turnover") * fixed_bps / 1e4).select(period, "turnover", "fixed_cost", "impact_cost")


def _draws(n: int, reps: int, seed: int, spark) -> DataFrame:
    return spark.range(reps).select(F.col("id").cast("int").alias("rep")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def block_indices(spark, n: int, reps: int, block: int, seed: int) -> DataFrame:
    """``rep, i, pos``: circular blocks; each starts at a draw."""
    at = _draws(n, reps, seed, spark).withColumn("b", F.floor(F.col("i") / block))
    start = F.floor(X.draw(seed, F.col("rep"), F.col("b")) * n)
    return at.select("rep", "i", ((start + F.col("i") % block) % n).cast("int").alias("pos"))


def stationary_indices(spark, n: int, reps: int, p: float, seed: int) -> DataFrame:
    """``rep, i, pos``: at each step a new start with chance ``p``, else the next position."""
    at = _draws(n, reps, seed, spark)
    fresh = (F.col("i") == 0) | (X.draw(seed, F.lit("restart"), F.col("rep"), F.col("i")) < p)
    start = F.floor(X.draw(seed, F.lit("start"), F.col("rep"), F.col("i")) * n)
    marked = at.withColumn("s", F.when(fresh, F.struct(start.alias("start"), F.col("i").alias("from"))))
    last = F.last("s", ignorenulls=True).over(W.partitionBy("rep").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("s", last).select("rep", "i", ((F.col("s.start") + F.col("i") - F.col("s.from")) % n).cast("int").alias("pos"))


def bootstrap_summary(returns: DataFrame, indices: DataFrame) -> DataFrame:
    """``metric, p05, p50, p95`` of total return, mean, Sortino and drawdown over resamples of one ``pos, r`` series."""
    x = indices.join(F.broadcast(returns), "pos")  # one series
    run = W.partitionBy("rep").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("index", F.exp(F.sum(F.log1p("r")).over(run))).withColumn("peak", F.greatest(F.max("index").over(run), F.lit(1.0)))
    reps = x.groupBy("rep").agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("total"), F.avg("r").alias("mean"), X.ratio(F.avg("r"), F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2)))).alias("sortino"), F.min(F.col("index") / F.col("peak") - 1).alias("drawdown"))
    long = reps.unpivot("rep", ["total", "mean", "sortino", "drawdown"], "metric", "value")
    return long.groupBy("metric").agg(*[F.percentile("value", q).alias(name) for q, name in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))])


def reality_check(trials: DataFrame, indices: DataFrame, *, trial: str = "trial", value: str = "r") -> DataFrame:
    """By trial: mean, t, the stepdown-adjusted p; and the p of the best for White's check and for the studentised one.

    ``trials``: ``pos, trial, r`` with every trial at every position.
    """
    stats = trials.groupBy(trial).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*").cast("double"))).alias("se"), F.count("*").alias("n"))
    stats = stats.withColumn("t", X.ratio("mean", "se", 1e-12))
    order = W.orderBy(F.round("t", 9).desc_nulls_last(), trial)  # one row a trial
    stats = stats.withColumn("rank", F.row_number().over(order))
    counts = indices.groupBy("rep", "pos").agg(F.count("*").alias("k"))
    boot = counts.join(trials, "pos").groupBy("rep", trial).agg((F.sum(F.col(value) * F.col("k")) / F.sum("k")).alias("m")).join(stats, trial)
    boot = boot.withColumn("centred", F.col("m") - F.col("mean")).withColumn("ct", X.ratio("centred", "se", 1e-12))
    # the largest over this rank and all after it
    rest = W.partitionBy("rep").orderBy(F.col("rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    boot = boot.withColumn("rest_max", F.max("ct").over(rest))
    step = boot.groupBy(trial).agg(F.avg((F.col("rest_max") >= F.col("t")).cast("double")).alias("raw"))
    best = stats.agg(F.max("mean").alias("best_mean"), F.max("t").alias("best_t"))
    reps = boot.groupBy("rep").agg(F.max("centred").alias("max_centred"), F.max("ct").alias("max_t")).crossJoin(F.broadcast(best))  # one row
    whole = reps.agg(F.avg((F.col("max_centred") >= F.col("best_mean")).cast("double")).alias("white_p"), F.avg((F.col("max_t") >= F.col("best_t")).cast("double")).alias("spa_p"))
    out = stats.join(step, trial).withColumn("stepdown_p", F.max("raw").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    return out.crossJoin(F.broadcast(whole)).select(trial, "mean", "t", "rank", "stepdown_p", "white_p", "spa_p")  # one row


def overfit_by_folds(trials: DataFrame, folds: int, *, trial: str = "trial", value: str = "r", pos: str = "pos") -> DataFrame:
    """Leave-one-fold-out: the best trial of the rest, its average-tie rank in the fold, the logit of it; the share of negative logits is the probability of overfitting."""
    n = trials.select(pos).distinct().withColumn("fold", F.ntile(folds).over(W.orderBy(pos)))  # a calendar
    x = trials.join(F.broadcast(n), pos).groupBy(trial, "fold").agg(F.sum(value).alias("s"), F.count("*").alias("k"))
    whole = W.partitionBy(trial)
    x = x.withColumn("train", X.ratio(F.sum("s").over(whole) - F.col("s"), (F.sum("k").over(whole) - F.col("k")).cast("double"))).withColumn("test", F.col("s") / F.col("k"))
    x = x.withColumn("train", F.round("train", 12)).withColumn("test", F.round("test", 12)).withColumn("rank", X.average_rank("test", "fold")).withColumn("n", F.count("*").over(W.partitionBy("fold")))
    best = x.groupBy("fold").agg(F.max_by(F.struct(F.col(trial).alias("best"), "rank", "n"), F.struct("train", -F.col(trial))).alias("b")).select("fold", "b.*")
    u = F.col("rank") / (F.col("n") + 1)
    return best.withColumn("logit", F.log(u / (1 - u))).select("fold", "best", "rank", "logit", F.avg((F.log(u / (1 - u)) < 0).cast("double")).over(W.partitionBy()).alias("pbo"))


def overfit_by_masks(windows: DataFrame, n_windows: int, *, trial: str = "trial", value: str = "r", window: str = "window", fix_first: bool = True) -> DataFrame:
    """All balanced splits of ``n_windows`` (at most 12) windows into train and test, as bit masks; ``fix_first`` keeps one of each complementary two."""
    if n_windows > 12:
        raise ValueError("at most 12 windows (4096 masks)")
    spark = windows.sparkSession
    masks = spark.range(1 << n_windows).where((F.bit_count("id") == n_windows // 2) & ((F.col("id") % 2 == 1) if fix_first else F.lit(True)))
    x = windows.crossJoin(F.broadcast(masks.withColumnRenamed("id", "mask")))  # at most 4096 masks
    bit = F.expr(f"(mask >> cast({window} as int)) & 1")
    g = x.groupBy("mask", trial).agg(F.round(F.avg(F.when(bit == 1, F.col(value))), 12).alias("train"), F.round(F.avg(F.when(bit == 0, F.col(value))), 12).alias("test"))
    g = g.withColumn("rank", X.average_rank("test", "mask")).withColumn("n", F.count("*").over(W.partitionBy("mask")))
    best = g.groupBy("mask").agg(F.max_by(F.struct(F.col(trial).alias("best"), "rank", "n"), F.struct("train", -F.col(trial))).alias("b")).select("mask", "b.*")
    u = F.col("rank") / (F.col("n") + 1)
    return best.withColumn("logit", F.log(u / (1 - u))).select("mask", "best", "rank", "logit")


def normal_quantile(p):
    """Quantile of the normal distribution by a rational approximation (error below 5e-4)."""
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p >= 0.5, z).otherwise(-z)


def combination_stability(combos: DataFrame, df: DataFrame, key: str, ts: str, ret: str, reps: int, seed: int) -> DataFrame:
    """``key, selected``: the share of bootstrap draws in which it is in the combination of ``members`` with the best Sortino ratio.

    A draw weighs each period 0, 1 or 2; a member without a row of a period returns nothing there.
    """
    periods = df.select(ts).distinct()
    parts = combos.select("members", F.explode("members").alias(key)).join(df.select(key, ts, ret), key)
    held = parts.groupBy("members", ts).agg((F.sum(ret) / F.max(F.size("members"))).alias("_r"))
    draws = periods.crossJoin(F.broadcast(df.sparkSession.range(reps).select(F.col("id").alias("rep"))))  # a calendar by the draws
    draws = draws.withColumn("_k", F.floor(X.draw(seed, F.col("rep"), F.col(ts)) * 3))
    weighs = draws.groupBy("rep").agg(F.sum("_k").alias("_all"))
    x = draws.where("_k > 0").join(held, ts).groupBy("rep", "members").agg(F.sum(F.col("_k") * F.col("_r")).alias("_up"), F.sum(F.col("_k") * F.pow(F.least("_r", F.lit(0.0)), 2)).alias("_down"))
    x = x.join(F.broadcast(weighs), "rep")  # one row a draw
    x = x.withColumn("_s", F.round(X.ratio(X.ratio("_up", "_all"), F.sqrt(X.ratio("_down", "_all"))), 9))
    best = x.withColumn("_o", F.row_number().over(W.partitionBy("rep").orderBy(F.desc_nulls_last("_s"), "members"))).where("_o = 1")
    return best.select(F.explode("members").alias(key)).groupBy(key).agg((F.count("*") / F.lit(float(reps))).alias("selected"))
