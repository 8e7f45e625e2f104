"""Grouped risk statistics: one row for each group, or long (metric, value) rows.

Guards on the number of observations are part of each result: too few give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X

YEAR = 252.0


def _down(r: str) -> Column:
    return F.pow(F.least(F.col(r), F.lit(0.0)), 2)


def performance(df: DataFrame, *by: str, ret: str = "r", bench: str = "rb", least: int = 20) -> DataFrame:
    """Sharpe, Sortino, information and Treynor ratios, beta, correlation and R squared."""
    active = F.col(ret) - F.col(bench)
    year = F.sqrt(F.lit(YEAR))
    beta = F.regr_slope(ret, bench)
    out = df.groupBy(*by).agg(
        F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"), F.sqrt(F.avg(_down(ret))).alias("dd"),
        F.avg(active).alias("am"), F.stddev_samp(active).alias("asd"), beta.alias("beta"), F.corr(ret, bench).alias("correlation"), F.regr_r2(ret, bench).alias("r2"),
    )
    enough = F.col("n") >= least
    ratios = {"sharpe": X.ratio("mean", "sd") * year, "sortino": X.ratio("mean", "dd") * year, "information": X.ratio("am", "asd") * year, "treynor": X.ratio(F.col("mean") * YEAR, "beta"), "beta": F.col("beta"), "correlation": F.col("correlation"), "r2": F.col("r2")}
    return out.select(*by, "n", *[F.when(enough, v).alias(k) for k, v in ratios.items()])


def conditional_betas(df: DataFrame, by: str, ret: str = "r", bench: str = "rb", tail: float = 0.1, least: int = 20) -> DataFrame:
    """Slopes on days when the benchmark is up, down, or in its tail; null with fewer than ``least`` days."""
    cut = F.percentile(bench, tail).over(W.partitionBy(by))
    tagged = df.withColumn("_cut", cut)
    parts = {"up": F.col(bench) > 0, "down": F.col(bench) < 0, "tail": F.col(bench) <= F.col("_cut")}
    made = [F.when(F.count(F.when(c, 1)) >= least, F.regr_slope(F.when(c, F.col(ret)), F.when(c, F.col(bench)))).alias(f"beta_{k}") for k, c in parts.items()]
    return tagged.groupBy(by).agg(*made)


def capture(df: DataFrame, *by: str, ret: str = "r", bench: str = "rb") -> DataFrame:
    """Mean return over the benchmark's mean, on its up and down days, and the ratio of the tails."""
    means = {k: X.ratio(F.avg(F.when(c, F.col(ret))), F.avg(F.when(c, F.col(bench)))) for k, c in (("up", F.col(bench) > 0), ("down", F.col(bench) < 0))}
    tail = X.ratio(F.percentile(ret, 0.95), F.abs(F.percentile(ret, 0.05)))
    return df.groupBy(*by).agg(means["up"].alias("up_capture"), means["down"].alias("down_capture"), tail.alias("tail_ratio"))


def drawdowns(path: DataFrame, by: str, ts: str = "date") -> DataFrame:
    """Maximum and current drawdown, its trough, the days to recovery and whether it recovered, from a drawdown path."""
    worst = path.groupBy(by).agg(F.min("drawdown").alias("max_drawdown"), F.min_by(ts, F.struct("drawdown", ts)).alias("trough"), F.max_by("drawdown", ts).alias("current_drawdown"))
    trough_peak = path.select(by, F.col(ts).alias("trough"), F.col("peak").alias("goal"))
    back = path.join(worst.join(trough_peak, [by, "trough"]), by).where((F.col(ts) >= F.col("trough")) & (F.col("index") >= F.col("goal") * (1 - 1e-12)))
    first = back.groupBy(by).agg(F.min(ts).alias("recovered_on"))
    out = worst.join(first, by, "left")
    return out.select(by, "max_drawdown", "current_drawdown", "trough", F.date_diff("recovered_on", "trough").alias("recovery_days"), F.col("recovered_on").isNotNull().alias("recovered"))


def value_at_risk(df: DataFrame, by: str, ret: str = "r", level: float = 0.95) -> DataFrame:
    """Historical VaR and CVaR as losses: the loss quantile and the mean of losses at or beyond it."""
    tagged = df.withColumn("_loss", -F.col(ret)).withColumn("_var", F.percentile("_loss", level).over(W.partitionBy(by)))
    return tagged.groupBy(by).agg(F.max("_var").alias("var"), F.avg(F.when(F.col("_loss") >= F.col("_var"), F.col("_loss"))).alias("cvar"), F.count("*").alias("n"))


def liquidity(df: DataFrame, by: str, n: int = 63, ts: str = "date", close: str = "close", volume: str = "volume", ret: str = "r") -> DataFrame:
    """Over each entity's last ``n`` rows: average volume and dollar volume, illiquidity, days without volume."""
    last = df.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(F.col(ts).desc()))).where(F.col("_k") <= n)
    money = F.col(close) * F.col(volume)
    return last.groupBy(by).agg(F.avg(volume).alias("adv"), F.avg(money).alias("dollar_adv"), F.avg(X.ratio(F.abs(ret), money)).alias("illiquidity"), F.count_if(F.col(volume) <= 0).alias("zero_days"))


def tail_fit(df: DataFrame, by: str, ret: str = "r", threshold: float = 0.9, level: float = 0.99, least: int = 10) -> DataFrame:
    """Generalised Pareto tail of losses by probability-weighted moments: shape, scale, VaR and CVaR at ``level``."""
    losses = df.withColumn("_l", -F.col(ret)).withColumn("_u", F.percentile("_l", threshold).over(W.partitionBy(by)))
    every = losses.groupBy(by).agg(F.count("*").alias("n"), F.max("_u").alias("u"))
    over = losses.where("_l > _u").withColumn("_y", F.col("_l") - F.col("_u"))
    order = W.partitionBy(by).orderBy("_y")
    over = over.withColumn("_i", F.row_number().over(order)).withColumn("_m", F.count("*").over(W.partitionBy(by)))
    b = over.groupBy(by).agg(F.count("*").alias("n_tail"), F.avg("_y").alias("b0"), F.avg(F.try_divide(F.col("_i") - 1, F.col("_m") - 1) * F.col("_y")).alias("b1"))
    out = every.join(b, by, "left").withColumn("n_tail", F.coalesce("n_tail", F.lit(0)))
    # l1 = b0, l2 = 2 b1 - b0; shape = 2 - l1 / l2, scale = (1 - shape) l1
    l2 = 2 * F.col("b1") - F.col("b0")
    out = out.withColumn("status", F.when(F.col("n_tail") < least, "too_few").when(F.coalesce(l2, F.lit(0.0)) <= 1e-12, "degenerate").otherwise("ok"))
    shape = F.when(F.col("status") == "ok", X.clip(2 - X.ratio("b0", l2), -0.5, 0.95))
    out = out.withColumn("shape", shape).withColumn("scale", (1 - F.col("shape")) * F.col("b0"))
    times = F.col("n") / F.col("n_tail") * (1 - level)
    flat = F.abs("shape") < 1e-6
    extra = F.when(flat, -F.col("scale") * F.log(times)).otherwise(X.ratio("scale", "shape") * (F.pow(times, -F.col("shape")) - 1))
    out = out.withColumn("var", F.when(F.col("status") == "ok", F.col("u") + extra))
    return out.withColumn("cvar", (F.col("var") + F.col("scale") - F.col("shape") * F.col("u")) / (1 - F.col("shape"))).select(by, "n", "n_tail", "status", "u", "shape", "scale", "var", "cvar")


def pooled_shape(fits: DataFrame, groups: DataFrame, by: str, group: str, prior: float = 20.0) -> DataFrame:
    """Shapes drawn to their group's median with weight n / (n + prior), and the scale that keeps the mean excess."""
    out = fits.join(groups, by).withColumn("_m", F.median("shape").over(W.partitionBy(group)))
    w = F.col("n_tail") / (F.col("n_tail") + prior)
    out = out.withColumn("pooled", F.coalesce(w * F.col("shape") + (1 - w) * F.col("_m"), F.col("_m")))
    return out.select(by, group, "n_tail", "shape", "pooled", (F.col("scale") * X.ratio(1 - F.col("pooled"), 1 - F.col("shape"))).alias("pooled_scale"))


def moments(df: DataFrame, by: str, value: str = "r") -> DataFrame:
    return df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), X.sample_skewness(value).alias("skewness"), X.sample_kurtosis(value).alias("kurtosis"))


def summary(df: DataFrame, by: str, ret: str = "r", bench: str = "rb", ts: str = "date") -> DataFrame:
    """Long (metric, value) rows of a return path's performance against its benchmark."""
    from tidemark.operators.panel import drawdown_path

    worst = drawdown_path(df, by, ts, ret).groupBy(by).agg(F.min("drawdown").alias("max_drawdown"))
    active = F.col(ret) - F.col(bench)
    year = F.sqrt(F.lit(YEAR))
    up = F.sum(F.log1p(F.greatest(F.col(ret), F.lit(-0.999999))))
    out = df.groupBy(by).agg(
        (F.exp(up) - 1).alias("total_return"), (F.exp(up * YEAR / F.count(ret)) - 1).alias("annual_return"), (F.stddev_samp(ret) * year).alias("volatility"), (X.ratio(F.avg(ret), F.stddev_samp(ret)) * year).alias("sharpe"),
        (X.ratio(F.avg(ret), F.sqrt(F.avg(_down(ret)))) * year).alias("sortino"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"), (F.stddev_samp(active) * year).alias("tracking_error"), (X.ratio(F.avg(active), F.stddev_samp(active)) * year).alias("information_ratio"), F.regr_slope(ret, bench).alias("beta"),
    )
    out = out.join(worst, by).join(value_at_risk(df, by, ret).select(by, "var", "cvar"), by)
    values = [c for c in out.columns if c != by]
    return out.unpivot(by, values, "metric", "value")


def by_state(df: DataFrame, *states: str, ret: str = "r") -> DataFrame:
    """Performance by each state column on its own, by grouping sets."""
    # a rollup of all pairs holds the single ones too; each row keeps one state column
    out = df.cube(*states).agg(F.grouping_id().alias("_g"), F.count(ret).alias("n"), F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"), F.avg((F.col(ret) > 0).cast("double")).alias("hit_rate"))
    k = len(states)
    single = {(1 << k) - 1 - (1 << (k - 1 - i)): s for i, s in enumerate(states)}
    name = F.coalesce(*[F.when(F.col("_g") == g, s) for g, s in single.items()])
    value = F.coalesce(*[F.when(F.col("_g") == g, F.col(s)) for g, s in single.items()])
    return out.where(F.col("_g").isin(list(single))).select(name.alias("dimension"), value.alias("state"), "n", "mean", "sd", "hit_rate")


def relative_score(df: DataFrame, by: str, ret: str = "r", bench: str = "rb", least: int = 40, lambdas: dict[str, float] | None = None) -> DataFrame:
    """Active return, capture and convexity over downside, CVaR, drawdown and tracking error, less a penalty for falling behind."""
    from tidemark.operators.panel import drawdown_path

    k = {"downside": 1.0, "cvar": 0.5, "drawdown": 0.5, "tracking": 0.5, "breach": 0.25} | (lambdas or {})
    c = capture(df, by, ret=ret, bench=bench).select(by, "up_capture", "down_capture")
    worst = drawdown_path(df, by, "date", ret).groupBy(by).agg((-F.min("drawdown")).alias("mdd"))
    active = F.col(ret) - F.col(bench)
    base = df.groupBy(by).agg(F.count(ret).alias("n"), (F.avg(active) * YEAR).alias("active"), (F.sqrt(F.avg(_down(ret))) * F.sqrt(F.lit(YEAR))).alias("downside"), (F.stddev_samp(active) * F.sqrt(F.lit(YEAR))).alias("tracking"), F.avg((active < 0).cast("double")).alias("behind"))
    out = base.join(c, by).join(worst, by).join(value_at_risk(df, by, ret).select(by, "cvar"), by)
    top = F.col("active") + (F.col("up_capture") - F.col("down_capture")) * 0.1
    risk = k["downside"] * F.col("downside") + k["cvar"] * F.col("cvar") + k["drawdown"] * F.col("mdd") + k["tracking"] * F.col("tracking")
    return out.select(by, "n", F.when(F.col("n") >= least, X.ratio(top, risk) - k["breach"] * F.greatest(F.col("behind") - 0.5, F.lit(0.0))).alias("score"))


def concentration(df: DataFrame, *by: str, weight: str = "weight") -> DataFrame:
    """Entropy, Herfindahl index and effective number of names of weights taken as shares."""
    p = X.ratio(F.col(weight), F.sum(weight).over(W.partitionBy(*by)))
    out = df.withColumn("_p", p).groupBy(*by).agg(F.sum(F.when(F.col("_p") > 0, -F.col("_p") * F.log("_p")).otherwise(F.lit(0.0))).alias("entropy"), F.sum(F.col("_p") * F.col("_p")).alias("hhi"))
    return out.withColumn("effective_names", X.ratio(F.lit(1.0), "hhi"))


def stability_index(df: DataFrame, value: str, early: Column, bins: int = 10) -> DataFrame:
    """Population stability index of ``value``: late rows against quantile bins of the early ones."""
    cuts = df.where(early).agg(F.percentile(value, [k / bins for k in range(1, bins)]).alias("cuts"))
    tagged = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(cuts))  # one row
    tagged = tagged.withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col(value))))
    counts = tagged.groupBy("bin").agg(F.count_if(early).alias("a"), F.count_if(~early).alias("b"))
    whole = W.partitionBy()
    share = {c: F.greatest(F.col(c) / F.sum(c).over(whole), F.lit(1e-6)) for c in ("a", "b")}
    return counts.select("bin", share["a"].alias("early"), share["b"].alias("late")).withColumn("psi", (F.col("late") - F.col("early")) * F.log(F.col("late") / F.col("early")))


def benchmark_fit(df: DataFrame, candidates: DataFrame, by: str, ret: str = "r", ts: str = "date") -> DataFrame:
    """Correlation, beta and tracking error of each entity to each candidate benchmark; the best by a weighted score."""
    both = df.join(candidates, ts)
    out = both.groupBy(by, "benchmark").agg(F.corr(ret, "rb").alias("correlation"), F.regr_slope(ret, "rb").alias("beta"), (F.stddev_samp(F.col(ret) - F.col("rb")) * F.sqrt(F.lit(YEAR))).alias("tracking"))
    out = out.withColumn("fit", F.col("correlation") - 0.25 * F.abs(F.col("beta") - 1) - F.col("tracking"))
    return out.withColumn("best", F.row_number().over(W.partitionBy(by).orderBy(F.round("fit", 9).desc_nulls_last(), "benchmark")) == 1)


def pairwise(df: DataFrame, entity: str = "entity", ts: str = "date", ret: str = "r", least: int = 20) -> DataFrame:
    """Covariance and correlation of each pair of entities (a <= b) over their common dates."""
    a = df.select(F.col(entity).alias("a"), ts, F.col(ret).alias("ra"))
    b = df.select(F.col(entity).alias("b"), ts, F.col(ret).alias("rb"))
    return a.join(b, ts).where("a <= b").groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_samp("ra", "rb").alias("cov"), F.corr("ra", "rb").alias("corr")).where(F.col("n") >= least)


def information_coefficient(df: DataFrame, by: str, score: str, outcome: str) -> DataFrame:
    """Rank correlation of score and outcome at each date, its mean of three dates, and its running hit rate."""
    ranked = df.where(F.col(score).isNotNull() & F.col(outcome).isNotNull()).withColumn("_a", X.average_rank(score, by)).withColumn("_b", X.average_rank(outcome, by))
    out = ranked.groupBy(by).agg(F.corr("_a", "_b").alias("ic"), F.count("*").alias("n"))
    order = W.orderBy(by)  # one row for each date
    return out.withColumn("ic_3", F.avg("ic").over(order.rowsBetween(-2, 0))).withColumn("hit_rate", F.avg((F.round("ic", 9) > 0).cast("double")).over(order.rowsBetween(W.unboundedPreceding, 0)))


def ledger(df: DataFrame, entity: str, ts: str, ret: str, capital: float) -> DataFrame:
    """Capital at begin and end of each period, profit, peak and drawdown."""
    w = X.by(entity, ts)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumn("end_capital", capital * F.exp(F.sum(F.log1p(F.greatest(F.col(ret), F.lit(-0.999999)))).over(run)))
    out = out.withColumn("begin_capital", F.coalesce(F.lag("end_capital").over(w), F.lit(capital))).withColumn("pnl", F.col("end_capital") - F.col("begin_capital"))
    return out.withColumn("peak", F.greatest(F.max("end_capital").over(run), F.lit(capital))).withColumn("drawdown", F.col("end_capital") / F.col("peak") - 1)


def carry_validation(levels: DataFrame, rates: DataFrame, least: int = 60, trend_days: int = 252) -> DataFrame:
    """Each ordered pair of countries: its spread of ``rate`` against the risk of the cross rate of ``lv``, in per cent.

    A pair of fewer than ``least`` days has no figures of risk and is charged 20 for each.
    Countries are few; their pairs meet by date.
    """
    a, b = (levels.select(F.col("country").alias(n), "date", F.col("lv").alias(f"lv_{n}")) for n in ("long", "short"))
    q = a.join(b, "date").where("long <> short").withColumn("q", X.ratio("lv_long", "lv_short")).where("q > 0")
    w, back = X.by(["long", "short"], "date"), W.partitionBy("long", "short").orderBy(F.desc("date"))
    q = q.withColumn("log", F.log("q") - F.log(F.lag("q").over(w))).withColumn("down", F.col("q") / F.max("q").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    q = q.withColumn("back", F.row_number().over(back)).withColumn("n", F.count("*").over(W.partitionBy("long", "short")))
    at = lambda k: F.max(F.when(F.col("back") == k, F.col("q")))
    trend = (at(F.lit(1)) / at(F.least("n", F.lit(trend_days))) - 1) * 100
    m = q.groupBy("long", "short").agg(F.max("n").alias("n"), (F.stddev_samp("log") * F.sqrt(F.lit(252.0)) * 100).alias("vol"), (F.min("down") * 100).alias("max_drawdown"), trend.alias("trend"))
    m = m.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("vol", "max_drawdown", "trend")})
    for n in ("long", "short"):
        m = m.join(rates.select(F.col("country").alias(n), F.col("rate").alias(f"rate_{n}")), n)
    m = m.withColumn("spread", F.col("rate_long") - F.col("rate_short"))
    q1, mid, q3 = (F.percentile("spread", F.lit(p)).over(W.partitionBy()) for p in (0.25, 0.5, 0.75))  # one row a pair of countries
    m = m.withColumn("z", (F.col("spread") - mid) / F.greatest(q3 - q1, F.lit(1e-9))).withColumn("coverage", X.ratio("spread", "vol"))
    m = m.withColumn("adjusted", F.col("spread") - 0.25 * F.coalesce("vol", F.lit(20.0)) - 0.1 * F.coalesce(F.abs("max_drawdown"), F.lit(20.0)))
    good = (F.round("spread", 9) > 0) & (F.round("adjusted", 9) > 0)
    return m.select("long", "short", "n", "spread", "vol", "max_drawdown", "trend", "z", "coverage", "adjusted", good.alias("admissible"))
