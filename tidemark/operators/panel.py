"""Window features over long panels: one row for each entity and date, nothing later than the row's date is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X


def momentum(df: DataFrame, entity: str = "entity", ts: str = "date", value: str = "close") -> DataFrame:
    """Returns over 21, 63, 126 and 252 rows, and over 252 without the last 21."""
    w = X.by(entity, ts)
    out = df.withColumns({f"mom_{n}": F.try_divide(F.col(value), F.lag(value, n).over(w)) - 1 for n in (21, 63, 126, 252)})
    return out.withColumn("mom_12_1", F.try_divide(F.lag(value, 21).over(w), F.lag(value, 252).over(w)) - 1)


def trend(df: DataFrame, entity: str = "entity", ts: str = "date", value: str = "close") -> DataFrame:
    """Moving averages and the state of the price against them."""
    w = X.by(entity, ts)
    out = df.withColumns({f"ma_{n}": X.rolling(F.avg, value, w, n) for n in (50, 63, 126, 200)})
    up = (F.col(value) > F.col("ma_50")) & (F.col("ma_50") > F.col("ma_200"))
    down = (F.col(value) < F.col("ma_50")) & (F.col("ma_50") < F.col("ma_200"))
    return out.withColumn("trend", F.when(F.col("ma_200").isNull(), "unknown").when(up, "up").when(down, "down").otherwise("mixed"))


def rolling_risk(df: DataFrame, n: int = 63, least: int = 20, entity: str = "entity", ts: str = "date", ret: str = "r") -> DataFrame:
    """Annualised rolling volatility and downside deviation."""
    w = X.by(entity, ts)
    year = F.sqrt(F.lit(252.0))
    down = F.pow(F.least(F.col(ret), F.lit(0.0)), 2)
    return df.withColumn("vol", X.rolling(F.stddev_samp, ret, w, n, least) * year).withColumn("downside", F.sqrt(X.rolling(F.avg, down, w, n, least)) * year)


def rolling_z(df: DataFrame, value: str, n: int = 252, least: int = 60, entity: str = "entity", ts: str = "date", out: str = "z") -> DataFrame:
    """Causal z-score over the last ``n`` rows."""
    w = X.by(entity, ts)
    return df.withColumn(out, X.ratio(F.col(value) - X.rolling(F.avg, value, w, n, least), X.rolling(F.stddev_samp, value, w, n, least)))


def carried(df: DataFrame, value: str, entity: str = "entity", ts: str = "date", out: str = "carried") -> DataFrame:
    """The last non-null value up to each row."""
    return df.withColumn(out, F.last(value, ignorenulls=True).over(X.by(entity, ts).rowsBetween(W.unboundedPreceding, 0)))


def breadth(df: DataFrame, n: int = 50, entity: str = "entity", ts: str = "date", value: str = "close", ret: str = "r") -> DataFrame:
    """By date: share of entities above their moving average, and with a positive return."""
    above = (F.col(value) > X.rolling(F.avg, value, X.by(entity, ts), n)).cast("double")
    return df.withColumn("above", above).groupBy(ts).agg(F.avg("above").alias("above_ma"), F.avg((F.col(ret) > 0).cast("double")).alias("positive"), F.count("*").alias("entities"))


def drawdown_path(df: DataFrame, entity: str = "entity", ts: str = "date", ret: str = "r") -> DataFrame:
    """Index of cumulative return from 1, its running maximum and the drawdown from it."""
    w = X.by(entity, ts).rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("index", F.exp(F.sum(F.log1p(F.greatest(F.col(ret), F.lit(-0.999999)))).over(w)))
    return out.withColumn("peak", F.greatest(F.max("index").over(w), F.lit(1.0))).withColumn("drawdown", F.col("index") / F.col("peak") - 1)


def percentile_rank(df: DataFrame, value: str, *groups: str, out: str = "pct") -> DataFrame:
    """Average-tie rank over the number of values, by group."""
    return df.withColumn(out, X.percent_of_rank(value, *groups))


def top_weights(df: DataFrame, score: str, n: int, *groups: str, key: str = "entity") -> DataFrame:
    """The ``n`` best of each group by score, weighted by their rank from the bottom of the chosen."""
    order = W.partitionBy(*groups).orderBy(F.col(score).desc_nulls_last(), key)
    chosen = df.where(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    many = F.count("*").over(W.partitionBy(*groups))
    return chosen.withColumn("points", many - F.col("rank") + 1).withColumn("weight", F.col("points") / F.sum("points").over(W.partitionBy(*groups))).drop("points")


def capped_in_proportion(df: DataFrame, cap: float, *groups: str, weight: str = "weight", key: str = "entity") -> DataFrame:
    """Weights of sum 1 with none above max(cap, 1/n): the largest are cut to the cap and the rest share what is left in proportion."""
    part = W.partitionBy(*groups)
    order = part.orderBy(F.col(weight).desc(), key)
    out = df.withColumn("_w", F.greatest(F.col(weight), F.lit(0.0))).withColumn("_n", F.count("*").over(part)).withColumn("_cap", F.greatest(F.lit(cap), 1 / F.col("_n")))
    out = out.withColumn("_k", F.row_number().over(order) - 1).withColumn("_rest", F.sum("_w").over(part) - F.coalesce(F.sum("_w").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    # with the k largest at the cap, the next fits
    fits = F.col("_w") * (1 - F.col("_k") * F.col("_cap")) <= F.col("_cap") * F.col("_rest") + 1e-12
    first = F.min(F.when(fits, F.struct("_k", "_rest"))).over(part)
    out = out.withColumn("_f", first)
    shared = F.try_divide(F.col("_w") * (1 - F.col("_f._k") * F.col("_cap")), F.col("_f._rest"))
    return out.withColumn("capped", F.when(F.col("_f").isNull() | (F.col("_k") < F.col("_f._k")), F.col("_cap")).otherwise(F.coalesce(shared, F.lit(0.0)))).drop("_w", "_n", "_cap", "_k", "_rest", "_f")


def capped_by_room(df: DataFrame, cap: float, *groups: str, weight: str = "weight") -> DataFrame:
    """Weights of sum 1 cut at the cap, what is over handed out in proportion to the room below it."""
    part = W.partitionBy(*groups)
    out = df.withColumn("_w", X.ratio(F.greatest(F.col(weight), F.lit(0.0)), F.sum(F.greatest(F.col(weight), F.lit(0.0))).over(part)))
    out = out.withColumn("_c", F.least("_w", F.lit(cap))).withColumn("_room", F.lit(cap) - F.col("_c"))
    over = 1 - F.sum("_c").over(part)
    room = F.sum("_room").over(part)
    return out.withColumn("capped", F.col("_c") + F.when((over > 1e-12) & (room > 0), F.least(over, room) * F.col("_room") / room).otherwise(F.lit(0.0))).drop("_w", "_c", "_room")


def group_robust_z(df: DataFrame, values: str | list[str], group: str, *across: str, least: int = 4, bound: float = 8.0) -> DataFrame:
    """(x - median) / IQR within the group if it has ``least`` values, else among all; clipped. Columns ``z_<value>``."""
    values = [values] if isinstance(values, str) else values
    wide = lambda v: F.percentile(v, 0.75) - F.percentile(v, 0.25)
    own = {f"_{k}_{v}": f(v) for v in values for k, f in (("gn", F.count), ("gm", F.median), ("gs", wide))}
    every = {f"_{k}_{v}": f(v) for v in values for k, f in (("am", F.median), ("as", wide))}
    both = X.with_group(X.with_group(df, [*across, group], **own), list(across), source=df, **every)
    made = {}
    for v in values:
        enough = F.col(f"_gn_{v}") >= least
        middle, spread = (F.when(enough, F.col(f"_g{k}_{v}")).otherwise(F.col(f"_a{k}_{v}")) for k in "ms")
        made[f"z_{v}"] = X.clip(X.ratio(F.col(v) - middle, spread, 1e-12), -bound, bound)
    return both.withColumns(made).drop(*own, *every)


def mad_z(df: DataFrame, values: str | list[str], *groups: str, least: int = 3, bound: float = 3.0) -> DataFrame:
    """(x - median) / (1.4826 MAD) in two passes; null with fewer than ``least`` values; clipped. Columns ``z_<value>``."""
    values = [values] if isinstance(values, str) else values
    one = {f"_{k}_{v}": f(v) for v in values for k, f in (("m", F.median), ("n", F.count))}
    two = {f"_d_{v}": F.median(F.abs(F.col(v) - F.col(f"_m_{v}"))) for v in values}
    both = X.with_group(X.with_group(df, list(groups), **one), list(groups), **two)
    made = {f"z_{v}": F.when(F.col(f"_n_{v}") >= least, X.clip(X.ratio(F.col(v) - F.col(f"_m_{v}"), F.col(f"_d_{v}") * 1.4826, 1e-12), -bound, bound)) for v in values}
    return both.withColumns(made).drop(*one, *two)


def market_residuals(df: DataFrame, market: DataFrame, n: int = 126, least: int = 63, entity: str = "entity", ts: str = "date", ret: str = "r", bench: str = "rb") -> DataFrame:
    """Rolling beta, alpha and the residual of each row by the market model of its last ``n`` rows, then idiosyncratic volatility, residual momentum and information ratio."""
    w = X.by(entity, ts)
    out = df.join(market, ts)
    over = X.last_rows(w, n)
    cov = F.covar_samp(ret, bench).over(over)
    out = out.withColumn("beta", F.when(F.count(ret).over(over) >= least, X.ratio(cov, F.var_samp(bench).over(over))))
    out = out.withColumn("alpha", F.avg(ret).over(over) - F.col("beta") * F.avg(bench).over(over)).withColumn("residual", F.col(ret) - F.col("alpha") - F.col("beta") * F.col(bench))
    mean, sd = X.rolling(F.avg, "residual", w, n, least), X.rolling(F.stddev_samp, "residual", w, n, least)
    out = out.withColumn("idio_vol", sd * F.sqrt(F.lit(252.0))).withColumn("residual_ir", X.ratio(mean, sd) * F.sqrt(F.lit(252.0)))
    up = F.log1p(F.greatest(F.col("residual"), F.lit(-0.999999)))
    return out.withColumn("residual_mom", F.when(F.count("residual").over(over) >= least, F.exp(F.sum(up).over(over)) - 1))


def exposure_state(df: DataFrame, entity: str = "entity", ts: str = "date", value: str = "close", ret: str = "r") -> DataFrame:
    """Exposure in [0.25, 1]: cut for a price below its trend, for drawdown, for rising volatility and for downside."""
    w = X.by(entity, ts)
    year = w.rowsBetween(-251, 0)
    down = F.pow(F.least(F.col(ret), F.lit(0.0)), 2)
    out = df.withColumn("below", (F.col(value) < X.rolling(F.avg, value, w, 126)).cast("double")).withColumn("dd", F.col(value) / F.max(value).over(year) - 1)
    out = out.withColumn("vol_ratio", X.ratio(X.rolling(F.stddev_samp, ret, w, 21), X.rolling(F.stddev_samp, ret, w, 126)))
    out = out.withColumn("down_ratio", X.ratio(F.sqrt(X.rolling(F.avg, down, w, 63)), X.rolling(F.stddev_samp, ret, w, 63)))
    cut = 0.25 * F.coalesce("below", F.lit(0.0)) + X.clip(F.abs("dd"), 0.0, 0.4) + 0.2 * X.clip(F.coalesce(F.col("vol_ratio"), F.lit(1.0)) - 1, 0.0, 1.0) + 0.2 * X.clip(F.coalesce(F.col("down_ratio"), F.lit(0.7)) - 0.7, 0.0, 1.0)
    return out.withColumn("exposure", X.clip(1 - cut, 0.25, 1.0))


def regime(df: DataFrame, entity: str = "entity", ts: str = "date", value: str = "close", ret: str = "r") -> DataFrame:
    """Label of trend (63 rows) and of volatility (21 against 126 rows)."""
    w = X.by(entity, ts)
    out = df.withColumn("trend_63", F.try_divide(F.col(value), F.lag(value, 63).over(w)) - 1)
    out = out.withColumn("vol_ratio", X.ratio(X.rolling(F.stddev_samp, ret, w, 21), X.rolling(F.stddev_samp, ret, w, 126)))
    known = F.col("trend_63").isNotNull() & F.col("vol_ratio").isNotNull()
    label = F.concat(F.when(F.col("trend_63") >= 0, "bull").otherwise("bear"), F.when(F.col("vol_ratio") > 1.25, "_stress").when(F.col("vol_ratio") < 0.8, "_calm").otherwise("_normal"))
    return out.withColumn("regime", F.when(known, label).otherwise("unknown"))


def runs(df: DataFrame, flag, entity: str = "entity", ts: str = "date") -> DataFrame:
    """Longest run of consecutive rows where ``flag`` holds, by entity (gaps and islands)."""
    w = X.by(entity, ts)
    out = df.withColumn("_on", F.coalesce(flag, F.lit(False))).withColumn("_island", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.groupBy(entity, "_island").agg(F.sum(F.col("_on").cast("long")).alias("_n")).groupBy(entity).agg(F.max("_n").alias("longest_run"))


def transitions(df: DataFrame, state: str, entity: str = "entity", ts: str = "date", prior: float = 1.0) -> DataFrame:
    """Counts and Laplace probabilities of the next state given the state, by entity."""
    w = X.by(entity, ts)
    pairs = df.where(F.col(state).isNotNull()).withColumn("to", F.lead(state).over(w)).where("to is not null").groupBy(entity, F.col(state).alias("from"), "to").agg(F.count("*").alias("n"))
    states = df.select(F.countDistinct(state).alias("k"))
    out = pairs.crossJoin(F.broadcast(states))  # one row
    return out.withColumn("p", (F.col("n") + prior) / (F.sum("n").over(W.partitionBy(entity, "from")) + prior * F.col("k"))).drop("k")


def expanding_transition(df: DataFrame, state: str, target: str, entity: str = "entity", ts: str = "date", states: int = 2, prior: float = 1.0) -> DataFrame:
    """For each row, the probability that the next state is ``target`` given the row's state, from the pairs seen so far."""
    w = X.by(entity, ts)
    own = X.by([entity, "_from"], ts).rowsBetween(W.unboundedPreceding, 0)
    pairs = df.withColumn("_from", F.lag(state).over(w)).where("_from is not null").withColumn("_hit", (F.col(state) == target).cast("long"))
    seen = pairs.withColumn("_n", F.count("*").over(own)).withColumn("_h", F.sum("_hit").over(own)).select(entity, ts, "_from", "_n", "_h")
    rows = df.select(entity, ts, F.col(state).alias("_from")).withColumn("_side", F.lit(1)).unionByName(seen.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = W.partitionBy(entity, "_from").orderBy(ts, "_side").rowsBetween(W.unboundedPreceding, 0)
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(order), F.lit(0))
    return rows.withColumn("n", last("_n")).withColumn("h", last("_h")).where("_side = 1").select(entity, ts, F.col("_from").alias(state), "n", ((F.col("h") + prior) / (F.col("n") + prior * states)).alias("p"))
