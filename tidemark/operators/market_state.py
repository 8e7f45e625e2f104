"""State of the market at each signal date: volatility rank, drawdown, trends, crowding, dispersion, stress and exposure caps.

Crowding is the mean correlation of all pairs, without forming any: with N standardised
series the variance of their sum is N + N (N - 1) times it, so the work is linear in
the series. Everything at a date is of days up to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW, MEDIUM, SHORT = 126, 63, 21
#: Weights of stress (volatility rank, drawdown over its scale, crowding over its scale, falling trend), and bounds of the caps.
STRESS = {"vol": 0.35, "drawdown": 0.30, "crowding": 0.20, "trend": 0.15}
SCALES = {"drawdown": 0.12, "crowding": 0.65}
CAPS = {"growth": (0.58, -0.42, 0.18, 0.10, 0.10, 0.78), "alpha": (0.24, -0.16, 0.08, 0.05, 0.0, 0.34)}
TOTAL_CAP = (0.20, 0.82)
STRESSED, CALM_RANK, RECOVERY_DRAWDOWN = 0.70, 0.70, 0.03


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def crowding(rows: DataFrame, entity: str, ts: str, value: str) -> DataFrame:
    """``signal, crowding, dispersion`` from rows dealt to their signals (``signal, entity, ts, value``); days without a row of an entity count as zero.

    Entities that do not move take no part in crowding. ``rows`` must hold each day of a window at least once.
    """
    days = rows.groupBy("signal").agg(F.countDistinct(ts).alias("days"))
    sums = rows.groupBy("signal", entity).agg(F.sum(value).alias("s1"), F.sum(F.col(value) * F.col(value)).alias("s2")).join(F.broadcast(days), "signal")  # one row a signal
    sd = F.sqrt((F.col("s2") - F.col("s1") * F.col("s1") / F.col("days")) / (F.col("days") - 1))
    moves = sums.select("signal", entity, F.when(sd > 1e-12, sd).alias("sd"))
    many = moves.groupBy("signal").agg(F.count("*").alias("all_n"), F.count("sd").cast("double").alias("n"))
    daily = rows.join(moves, ["signal", entity]).groupBy("signal", ts).agg(F.coalesce(F.sum(F.col(value) / F.col("sd")), F.lit(0.0)).alias("z"), F.sum(value).alias("x"), F.sum(F.col(value) * F.col(value)).alias("xx")).join(F.broadcast(many), "signal")  # one row a signal
    across = F.sqrt(F.greatest((F.col("xx") - F.col("x") * F.col("x") / F.col("all_n")) / F.when(F.col("all_n") > 1, F.col("all_n") - 1), F.lit(0.0)))
    g = daily.groupBy("signal").agg(F.var_samp("z").alias("v"), F.max("n").alias("n"), F.percentile(across, 0.5).alias("mid"))
    mean = (F.col("v") - F.col("n")) / F.when(F.col("n") > 1, F.col("n") * (F.col("n") - 1))
    return g.select("signal", F.coalesce(mean, F.lit(0.0)).alias("crowding"), F.coalesce(F.col("mid") * math.sqrt(252.0), F.lit(0.0)).alias("dispersion"))


def market_states(df: DataFrame, bench: DataFrame, signals: DataFrame, entity: str = "entity", ts: str = "date", value: str = "r", rb: str = "rb") -> DataFrame:
    """``signal, vol_rank, drawdown, trend_63, trend_126, crowding, dispersion, stress, risk_on, recovery, state, growth_cap, alpha_cap, total_cap``.

    ``bench``: one row a day; ``signals``: ``signal``, days of it. Signals before ``WINDOW`` days have no row.
    """
    order = W.orderBy(ts)  # one row a day
    vol = F.when(F.count(rb).over(order.rowsBetween(-SHORT + 1, 0)) >= SHORT, F.stddev_samp(rb).over(order.rowsBetween(-SHORT + 1, 0)))
    days = bench.select(ts, rb, (F.row_number().over(order) - 1).alias("pos"), (vol * math.sqrt(252.0)).alias("vol"))
    at = signals.join(days, F.col("signal") == F.col(ts)).where(F.col("pos") >= WINDOW - 1).select("signal", F.col("pos").alias("at"), F.col("vol").alias("now"))
    # a calendar by its signals
    seen = days.join(F.broadcast(at), F.col("pos") <= F.col("at"))
    rank = seen.groupBy("signal").agg((F.count_if(F.round("vol", 12) <= F.round("now", 12)) / F.count("vol")).alias("vol_rank"))
    inside = seen.where(F.col("pos") > F.col("at") - WINDOW)
    run = W.partitionBy("signal").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    nav = inside.withColumn("up", F.sum(F.log1p(rb)).over(run)).withColumn("peak", F.greatest(F.max("up").over(run), F.lit(0.0)))

    def trend(n: int) -> Column:
        own = F.when(F.col("pos") > F.col("at") - n, F.log1p(rb))
        return F.exp(F.sum(own) * 252.0 / F.count(own)) - 1

    paths = nav.groupBy("signal").agg((1 - F.exp(F.min(F.col("up") - F.col("peak")))).alias("drawdown"), trend(MEDIUM).alias("trend_63"), trend(WINDOW).alias("trend_126"))
    dealt = df.select(entity, ts, value).join(F.broadcast(inside.select("signal", ts)), ts)  # a window's days for each signal
    x = rank.join(paths, "signal").join(crowding(dealt, entity, ts, value), "signal")
    falls = F.when(F.col("trend_63") < 0, 1.0).otherwise(0.0)
    parts = {"vol": F.col("vol_rank"), "drawdown": F.col("drawdown") / SCALES["drawdown"], "crowding": F.col("crowding") / SCALES["crowding"], "trend": falls}
    x = x.withColumn("stress", sum((STRESS[k] * _clip(v, 0.0, 1.0) for k, v in parts.items()), F.lit(0.0)))
    on = (F.col("trend_63") > 0) & (F.col("trend_126") > 0) & (F.col("vol_rank") < CALM_RANK)
    back = (F.col("trend_63") > 0) & (F.col("trend_126") <= 0) & (F.col("drawdown") > RECOVERY_DRAWDOWN)
    x = x.withColumn("risk_on", on.cast("double")).withColumn("recovery", back.cast("double"))
    x = x.withColumn("state", F.when(on, "expansion").when(back, "recovery").when(F.round("stress", 9) > STRESSED, "stress").otherwise("fragile"))
    for name, (base, by_stress, by_on, by_back, low, high) in CAPS.items():
        x = x.withColumn(f"{name}_cap", _clip(base + by_stress * F.col("stress") + by_on * F.col("risk_on") + by_back * F.col("recovery"), low, high))
    return x.withColumn("total_cap", _clip(F.col("growth_cap") + F.col("alpha_cap"), *TOTAL_CAP))
