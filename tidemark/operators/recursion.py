"""Recursive estimates along each series, as folds over its sorted rows.

A fold holds one series at a time; for series without bound use the streaming twins,
which keep the state only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X


def _series(df: DataFrame, entity: str, ts: str, value: str, *more: str) -> DataFrame:
    part = F.sort_array(F.collect_list(F.struct(ts, value)))
    return df.where(F.col(value).isNotNull()).groupBy(entity, *more).agg(F.transform(part, lambda s: s[value]).alias("xs"), F.count("*").alias("n"), F.var_samp(value).alias("var0"))


def ewma_variance(df: DataFrame, entity: str = "entity", ts: str = "date", value: str = "r", decay: float = 0.94, least: int = 20) -> DataFrame:
    """Exponentially weighted variance seeded with the sample variance; null for fewer than ``least`` rows."""
    s = _series(df, entity, ts, value)
    v = F.aggregate("xs", F.col("var0"), lambda a, x: decay * a + (1 - decay) * x * x)
    return s.select(entity, "n", F.when(F.col("n") >= least, v).alias("ewma_variance"))


def power_law_variance(df: DataFrame, lags: int = 60, exponent: float = 0.6, entity: str = "entity", ts: str = "date", value: str = "r", least: int = 20) -> DataFrame:
    """Weighted mean of the last squared returns with weights lag^-exponent."""
    back = df.withColumn("_k", F.row_number().over(W.partitionBy(entity).orderBy(F.col(ts).desc()))).where(F.col("_k") <= lags)
    w = F.pow(F.col("_k").cast("double"), -exponent)
    return back.groupBy(entity).agg(F.count("*").alias("n"), (F.sum(w * F.col(value) * F.col(value)) / F.sum(w)).alias("v")).select(entity, "n", F.when(F.col("n") >= least, F.col("v")).alias("power_law_variance"))


def roughness(df: DataFrame, entity: str = "entity", ts: str = "date", value: str = "vol", lags: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """Half the slope of log mean squared increments of log volatility on log lag, and its R squared."""
    w = X.by(entity, ts)
    logs = df.where(F.col(value) > 0).withColumn("_l", F.log(value))
    steps = logs.select(entity, *[F.pow(F.col("_l") - F.lag("_l", k).over(w), 2).alias(str(k)) for k in lags])
    means = steps.groupBy(entity).agg(*[F.avg(F.col(f"`{k}`")).alias(str(k)) for k in lags])
    long = means.unpivot(entity, [F.col(f"`{k}`") for k in lags], "lag", "m").where("m > 0")
    x, y = F.log(F.col("lag").cast("double")), F.log("m")
    return long.groupBy(entity).agg((F.regr_slope(y, x) / 2).alias("roughness"), F.regr_r2(y, x).alias("r2"))


def local_level(df: DataFrame, entity: str = "entity", ts: str = "date", value: str = "r", signal: float = 0.01) -> DataFrame:
    """Filtered mean of a local-level model with noise 1 and signal variance ``signal``: last level and gain."""
    s = _series(df, entity, ts, value)
    zero = F.struct(F.lit(0.0).alias("m"), F.lit(1.0).alias("p"), F.lit(0.0).alias("k"))

    def step(a: Column, x: Column) -> Column:
        p = a["p"] + signal
        k = p / (p + 1)
        return F.struct((a["m"] + k * (x - a["m"])).alias("m"), ((1 - k) * p).alias("p"), k.alias("k"))

    return s.withColumn("a", F.aggregate("xs", zero, step)).select(entity, "n", F.col("a.m").alias("level"), F.col("a.k").alias("gain"))


def variance_models(df: DataFrame, grid: DataFrame, entity: str = "entity", ts: str = "date", value: str = "r") -> DataFrame:
    """Likelihood, AIC and BIC of each series under each (model, alpha, beta, k) of a fixed grid; the best by BIC is flagged.

    The variance moves as (1 - alpha - beta) v0 + alpha x^2 + beta v, from the sample variance v0.
    """
    s = _series(df, entity, ts, value).where("n >= 20 and var0 > 0").crossJoin(F.broadcast(grid))  # a fixed grid
    v0, alpha, beta = F.col("var0"), F.col("alpha"), F.col("beta")
    zero = F.struct(F.col("var0").alias("v"), F.lit(0.0).alias("ll"))

    def step(a: Column, x: Column) -> Column:
        ll = a["ll"] - 0.5 * (F.log(2 * 3.141592653589793 * a["v"]) + x * x / a["v"])
        return F.struct(((1 - alpha - beta) * v0 + alpha * x * x + beta * a["v"]).alias("v"), ll.alias("ll"))

    out = s.withColumn("a", F.aggregate("xs", zero, step)).withColumn("ll", F.col("a.ll"))
    out = out.withColumn("aic", 2 * F.col("k") - 2 * F.col("ll")).withColumn("bic", F.col("k") * F.log(F.col("n").cast("double")) - 2 * F.col("ll"))
    best = F.row_number().over(W.partitionBy(entity).orderBy(F.round("bic", 6), "model", "alpha", "beta")) == 1
    return out.select(entity, "model", "alpha", "beta", "ll", "aic", "bic", F.col("a.v").alias("next_variance"), best.alias("best"))


def forecast_cone(params: DataFrame, horizon: int, entity: str = "entity") -> DataFrame:
    """Variance ahead from the last one: it returns to ``var0`` at the rate alpha + beta."""
    days = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    out = params.select(entity, "var0", "next_variance", "alpha", "beta", days)
    v = F.col("var0") + F.pow(F.col("alpha") + F.col("beta"), F.col("h") - 1) * (F.col("next_variance") - F.col("var0"))
    return out.withColumn("variance", v).withColumn("band", 1.96 * F.sqrt(F.col("variance"))).select(entity, "h", "variance", "band")


def change_points(df: DataFrame, rounds: int = 2, least: int = 21, entity: str = "entity", ts: str = "date", value: str = "r") -> DataFrame:
    """Segments by ``rounds`` of binary splitting under the Gaussian variance cost, each at least ``least`` rows long, penalty 3 ln n."""
    seg = df.select(entity, ts, F.col(value).alias("x")).withColumn("segment", F.lit("1"))
    for _ in range(rounds):
        part, run = W.partitionBy(entity, "segment"), W.partitionBy(entity, "segment").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
        s = seg.withColumn("i", F.count("*").over(run)).withColumn("n", F.count("*").over(part)).withColumn("s1", F.sum("x").over(run)).withColumn("s2", F.sum(F.col("x") * F.col("x")).over(run)).withColumn("t1", F.sum("x").over(part)).withColumn("t2", F.sum(F.col("x") * F.col("x")).over(part))

        def cost(n: Column, a: Column, b: Column) -> Column:
            return n * F.log(F.greatest(b / n - F.pow(a / n, 2), F.lit(1e-12)))

        rest = F.col("n") - F.col("i")
        gain = cost(F.col("n"), F.col("t1"), F.col("t2")) - cost(F.col("i"), F.col("s1"), F.col("s2")) - cost(F.when(rest > 0, rest), F.col("t1") - F.col("s1"), F.col("t2") - F.col("s2"))
        s = s.withColumn("gain", F.when((F.col("i") >= least) & (rest >= least), F.round(gain, 6)))
        best = s.where(F.col("gain") > 3 * F.log(F.col("n").cast("double"))).groupBy(entity, "segment").agg(F.min_by(ts, F.struct(-F.col("gain"), ts)).alias("cut"))
        seg = seg.join(best, [entity, "segment"], "left").select(entity, ts, "x", F.concat("segment", F.when(F.col("cut").isNull(), "").when(F.col(ts) <= F.col("cut"), "a").otherwise("b")).alias("segment"))
    return seg.groupBy(entity, "segment").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))


def throttle_step(a: Column, r: Column, cut: Column, restore: Column) -> Column:
    """State (exposure, index, peak, earned): exposure halves when the drawdown passes ``cut`` and is whole again once it is less than ``restore``."""
    earned = a["exposure"] * r
    index = a["index"] * (1 + earned)
    peak = F.greatest(a["peak"], index)
    dd = index / peak - 1
    exposure = F.when(dd < -cut, F.lit(0.5)).when(dd > -restore, F.lit(1.0)).otherwise(a["exposure"])
    return F.struct(exposure.alias("exposure"), index.alias("index"), peak.alias("peak"), (a["throttled"] + (exposure < 1).cast("int")).alias("throttled"), F.least(a["worst"], dd).alias("worst"))


def throttle(df: DataFrame, grid: DataFrame, entity: str = "entity", ts: str = "date", value: str = "r") -> DataFrame:
    """Each path under each (cut, restore) of a grid: end index, days throttled and worst drawdown of the throttled path."""
    s = _series(df, entity, ts, value).crossJoin(F.broadcast(grid))  # a fixed grid
    zero = F.struct(F.lit(1.0).alias("exposure"), F.lit(1.0).alias("index"), F.lit(1.0).alias("peak"), F.lit(0).alias("throttled"), F.lit(0.0).alias("worst"))
    out = s.withColumn("a", F.aggregate("xs", zero, lambda a, r: throttle_step(a, r, F.col("cut"), F.col("restore"))))
    return out.select(entity, "cut", "restore", "n", F.col("a.exposure").alias("exposure"), F.col("a.index").alias("index"), F.col("a.throttled").alias("throttled"), F.col("a.worst").alias("worst"))


def choose_throttle(results: DataFrame, entity: str = "entity") -> DataFrame:
    """The parameters with the least drawdown, then the largest index, then the smallest cut."""
    key = F.struct(F.round(-F.col("worst"), 9), F.round(-F.col("index"), 9), "cut", "restore")
    return results.groupBy(entity).agg(F.min_by(F.struct("cut", "restore", "index", "worst"), key).alias("b")).select(entity, "b.*")
