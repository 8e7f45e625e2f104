"""Eight strategy families scored at signal dates only, each on its own days of history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X

#: Days of history of each family.
LOOKBACKS = {
    "momentum_12_1": 252,
    "vol_adjusted_trend": 252,
    "dual_momentum": 252,
    "residual_momentum": 126,
    "asymmetric_capture": 126,
    "defensive_convexity": 126,
    "residual_reversion": 63,
    "downside_controlled_momentum": 252,
}
#: Least rows of a year's momentum, of any history, and of a tail; the quantile of the tail; rows skipped by momentum.
LEAST_YEAR, LEAST_ROWS, LEAST_TAIL, TAIL, SKIP = 230, 42, 40, 0.05, 21


def family_scores(df: DataFrame, bench: DataFrame, signals: DataFrame, entity: str = "entity", ts: str = "date", close: str = "close", ret: str = "r", rb: str = "rb") -> DataFrame:
    """``signal, entity`` and a score for each of ``LOOKBACKS``; null where the history is too short or the family has nothing to say.

    ``bench``: one row a day; ``signals``: ``signal``, days of it. Rows are dealt to the
    signals whose history they are in, so a signal never reads a later row.
    """
    day = W.orderBy(ts)  # one row a day
    index = F.exp(F.sum(F.log1p(rb)).over(day.rowsBetween(W.unboundedPreceding, 0)))
    days = bench.withColumn("pos", F.row_number().over(day)).withColumn("_index", index).withColumn("_index_lag", F.lag("_index", SKIP).over(day))
    longest = max(LOOKBACKS.values())
    at = signals.join(days.select(F.col(ts).alias("signal"), F.col("pos").alias("at")), "signal").where(F.col("at") >= longest)
    # a calendar by its signals
    windows = days.join(F.broadcast(at), (F.col("pos") <= F.col("at")) & (F.col("pos") > F.col("at") - longest))
    market = windows.groupBy("signal").agg(F.count("*").alias("_days"), (F.max_by("_index_lag", "pos") / F.min_by("_index", "pos") - 1).alias("market_momentum"))
    own = W.partitionBy(entity).orderBy(ts)
    rows = df.withColumn("_lag", F.lag(close, SKIP).over(own)).withColumn("_i", F.row_number().over(own))
    x = rows.join(F.broadcast(windows.select("signal", "at", "pos", ts, rb)), ts)
    newest = x.groupBy("signal", entity).agg(F.max("_i").alias("_last"))
    x = x.join(newest, ["signal", entity]).withColumn("_k", F.col("_last") - F.col("_i") + 1)

    def within(n: int, value: Column | None = None) -> Column:
        return F.when(F.col("pos") > F.col("at") - n, F.lit(1) if value is None else value)

    r, b = F.col(ret), F.col(rb)
    aggs = {}
    for n in sorted(set(LOOKBACKS.values())):
        aggs |= {
            f"n{n}": F.count(within(n)), f"beta{n}": F.covar_samp(within(n, r), within(n, b)) / F.when(F.var_samp(within(n, b)) > 1e-18, F.var_samp(within(n, b))), f"sum{n}": F.sum(within(n, r)), f"bsum{n}": F.sum(within(n, b)),
            f"first{n}": F.min_by(within(n, F.col(close)), within(n, F.col("pos"))), f"low{n}": F.percentile(within(n, b), TAIL),
        }
    half = LOOKBACKS["asymmetric_capture"]
    side = {"up": b > 0, "down": b < 0}
    aggs |= {f"{k}_{s}": F.avg(F.when((F.col("pos") > F.col("at") - half) & c, v)) for k, c in side.items() for s, v in (("r", r), ("b", b))}
    aggs |= {
        "downside": F.sqrt(F.avg(within(half, F.pow(F.least(r, F.lit(0.0)), 2)))), "vol": F.stddev_samp(F.when(F.col("_k") <= 63, r)), "recent": F.max_by("_lag", "pos"), "last": F.max_by(close, "pos"),
        "sum5": F.sum(F.when(F.col("_k") <= 5, r)), "bsum5": F.sum(F.when(F.col("_k") <= 5, b)), "var21": F.var_samp(F.when(F.col("_k") <= 21, r)), "bvar21": F.var_samp(F.when(F.col("_k") <= 21, b)), "cov21": F.covar_samp(F.when(F.col("_k") <= 21, r), F.when(F.col("_k") <= 21, b)),
    }
    f = x.groupBy("signal", entity).agg(*[v.alias(k) for k, v in aggs.items()]).join(F.broadcast(market), "signal")  # one row a signal
    tail = x.join(f.select("signal", entity, f"low{half}"), ["signal", entity]).where((F.col("pos") > F.col("at") - half) & (F.round(rb, 12) <= F.round(f"low{half}", 12)))
    f = f.join(tail.groupBy("signal", entity).agg(X.ratio(F.avg(ret), F.avg(rb), 1e-12).alias("tail_beta")), ["signal", entity], "left")
    f = f.withColumn("capture_up", X.ratio("up_r", "up_b", 1e-12)).withColumn("capture_down", X.ratio("down_r", "down_b", 1e-12)).withColumn("momentum", F.when(F.col("n252") >= LEAST_YEAR, F.try_divide("recent", "first252") - 1))
    vol = F.col("vol") * F.sqrt(F.lit(252.0))
    relative = F.col("momentum") - F.col("market_momentum")
    spread = F.col("capture_up") - F.col("capture_down")
    reversal = LOOKBACKS["residual_reversion"]
    noise = F.sqrt(F.greatest(F.col("var21") + F.pow(f"beta{reversal}", 2) * F.col("bvar21") - 2 * F.col(f"beta{reversal}") * F.col("cov21"), F.lit(0.0)))
    score = {
        "momentum_12_1": F.col("momentum"),
        "vol_adjusted_trend": F.when((F.col("momentum") > 0) & (vol > 1e-12), F.col("momentum") / vol),
        "dual_momentum": F.when((F.col("momentum") > 0) & (F.round(relative, 12) > 0) & (F.col("_days") >= LEAST_YEAR), relative),
        "residual_momentum": F.col("sum126") - F.col("beta126") * F.col("bsum126"),
        "asymmetric_capture": F.when(F.col("n126") >= LEAST_TAIL, spread - 0.5 * F.greatest(F.col("tail_beta") - 1, F.when(F.col("tail_beta").isNotNull(), F.lit(0.0)))),
        "defensive_convexity": F.try_divide("last", "first126") - 1 + 0.35 * spread - 4 * F.col("downside"),
        "residual_reversion": F.when(noise > 1e-12, -(F.col("sum5") - F.col(f"beta{reversal}") * F.col("bsum5")) / noise),
        "downside_controlled_momentum": F.col("momentum"),
    }
    enough = {k: F.col(f"n{n}") >= max(LEAST_ROWS, n // 2) for k, n in LOOKBACKS.items()}
    return f.select("signal", entity, *[F.when(enough[k], v).alias(k) for k, v in score.items()])
