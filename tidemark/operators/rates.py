"""Curves, carry, options and event risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X


def curve_metrics(curve: DataFrame, by: str = "country") -> DataFrame:
    """Level, slope, curvature and state of each curve, from one row with ``policy``, ``y2``, ``y5``, ``y10``."""
    out = curve.withColumn("level", (F.col("y2") + F.col("y5") + F.col("y10")) / 3).withColumn("slope", F.col("y10") - F.col("y2")).withColumn("policy_gap", F.col("y2") - F.col("policy")).withColumn("curvature", 2 * F.col("y5") - F.col("y2") - F.col("y10"))
    state = F.when(F.col("slope").isNull(), "unknown").when(F.col("slope") < -0.25, "inverted").when(F.col("slope") < 0.25, "flat").when(F.col("slope") < 1.5, "normal").otherwise("steep")
    return out.withColumn("state", state)


def modified_duration(y: Column, maturity: Column) -> Column:
    """Of a zero-coupon bond at yield ``y`` in per cent."""
    return maturity / (1 + y / 100)


def convexity(y: Column, maturity: Column) -> Column:
    return maturity * (maturity + 1) / F.pow(1 + y / 100, 2)


def price_impact(y: Column, maturity: Column, shock_bp: Column) -> Column:
    """Relative price change for a shift in basis points, to the second order."""
    dy = shock_bp / 10000
    return -modified_duration(y, maturity) * dy + 0.5 * convexity(y, maturity) * dy * dy


def curve_stress(latest: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Price impact of each scenario (a shift for the short and the long end) on each curve point."""
    shock = F.when(F.col("tenor") <= 2, F.col("short_bp")).otherwise(F.col("long_bp"))
    return latest.crossJoin(F.broadcast(scenarios)).withColumn("impact", price_impact(F.col("rate"), F.col("tenor").cast("double"), shock))  # a handful of scenarios


def change_since(df: DataFrame, months: int, by: list[str], ts: str, value: str) -> DataFrame:
    """Change against the last value at or before the same day ``months`` earlier."""
    from tidemark.operators.asof import asof_join

    left = df.withColumn("_then", F.add_months(ts, -months))
    out = asof_join(left, df.select(*by, F.col(ts).alias("_at"), F.col(value).alias("_was")), by=by, left_ts="_then", right_ts="_at", prefix="")
    return out.withColumn(f"change_{months}m", F.col(value) - F.col("_was")).drop("_then", "_at", "_was")


def option_summary(chain: DataFrame, by: str = "entity", min_dte: int = 7) -> DataFrame:
    """At the nearest expiry of at least ``min_dte`` days: at-the-money volatility, skew, put/call interest, relative spread."""
    live = chain.where(F.col("dte") >= min_dte)
    near = live.groupBy(by).agg(F.min("dte").alias("dte"))
    own = live.join(near, [by, "dte"])

    def closest(m: float) -> Column:
        return F.min_by("iv", F.struct(F.abs(F.col("moneyness") - m), "contract", "leg"))

    puts, calls = (F.sum(F.when(F.col("kind") == k, F.col("open_interest")).otherwise(F.lit(0.0))) for k in ("put", "call"))
    spread = X.ratio(F.col("ask") - F.col("bid"), (F.col("ask") + F.col("bid")) / 2)
    return own.groupBy(by, "dte").agg(closest(1.0).alias("atm_iv"), (closest(0.95) - closest(1.05)).alias("skew"), X.ratio(puts, calls).alias("put_call"), F.median(spread).alias("spread"), F.count("*").alias("contracts"))


def dte_bucket(dte: Column) -> Column:
    return F.when(dte <= 30, "000-030").when(dte <= 90, "031-090").when(dte <= 180, "091-180").otherwise("181+")


def moneyness_bucket(m: Column) -> Column:
    """Bins closed at the upper end; the first is closed at the lower end too."""
    return F.when(m <= 0.9, "low").when(m <= 1.0, "below").when(m <= 1.1, "above").otherwise("high")


def iv_surface(chain: DataFrame, by: str = "entity") -> DataFrame:
    """Volatility by cell, weighted by open interest, with the number of contracts."""
    cells = chain.withColumn("dte_bin", dte_bucket(F.col("dte"))).withColumn("moneyness_bin", moneyness_bucket(F.round("moneyness", 6)))
    return cells.groupBy(by, "dte_bin", "moneyness_bin").agg(X.ratio(F.sum(F.col("iv") * F.col("open_interest")), F.sum("open_interest")).alias("iv"), F.count("*").alias("contracts"))


def event_risk(events: DataFrame, now: Column, by: str, impact: str = "impact", ts: str = "ts", hours: float = 48.0) -> DataFrame:
    """Sum of impact decayed by distance, over events from 6 hours ago to 7 days ahead; counts by level and the next time."""
    away = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 3.6e9
    near = events.withColumn("_h", away).where("_h between -6 and 168")
    return near.groupBy(by).agg(F.sum(F.col(impact) * F.exp(-F.abs("_h") / hours)).alias("risk"), F.count_if(F.col(impact) >= 3).alias("high"), F.count_if(F.col(impact) == 2).alias("medium"), F.min(F.when(F.col("_h") >= 0, F.col(ts))).alias("next_time"))


def attention_shock(series: DataFrame, by: str, ts: str, value: str, least: int = 20) -> DataFrame:
    """Latest value against the history: robust z (fallback: by standard deviation), percentile, and whether it may be used."""
    part = W.partitionBy(by)
    first = series.withColumn("_m", F.median(value).over(part))
    second = first.withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    stats = second.groupBy(by).agg(F.count(value).alias("n"), F.countDistinct(value).alias("distinct"), F.max("_m").alias("mid"), F.median("_d").alias("mad"), F.stddev_samp(value).alias("sd"), F.avg(value).alias("mean"), F.max_by(value, ts).alias("latest"))
    share = series.join(stats.select(by, "latest"), by).groupBy(by).agg(F.avg((F.col(value) <= F.col("latest")).cast("double")).alias("percentile"))
    z = F.when(F.col("mad") > 1e-12, (F.col("latest") - F.col("mid")) / (1.4826 * F.col("mad"))).otherwise(X.ratio(F.col("latest") - F.col("mean"), "sd", 1e-12))
    return stats.join(share, by).select(by, "n", "latest", X.clip(z, -5.0, 5.0).alias("shock"), "percentile", ((F.col("n") >= least) & (F.col("distinct") >= 4)).alias("admissible"))


def heat(articles: DataFrame, by: str, topic: str = "topic", source: str = "source", intensity: str = "intensity") -> DataFrame:
    """log1p(n) times diversity of sources times mean intensity, the dominant topic (the smallest of equals) and the level by percentile."""
    out = articles.groupBy(by).agg(F.count("*").alias("n"), (F.countDistinct(source) / F.count("*")).alias("diversity"), F.avg(intensity).alias("intensity"), F.mode(topic, True).alias("dominant"))
    out = out.withColumn("heat", F.log1p(F.col("n").cast("double")) * F.col("diversity") * F.col("intensity")).withColumn("_h", F.round("heat", 9))
    out = out.withColumn("percentile", X.percent_of_rank("_h"))
    return out.withColumn("level", F.when(F.col("percentile") >= 0.9, "extreme").when(F.col("percentile") >= 0.7, "high").when(F.col("percentile") >= 0.4, "medium").otherwise("low")).drop("_h")


#: Weights of curve quality (long tenors, policy rate, history, recency), rows of a full history, and days until stale.
QUALITY = {"tenors": 0.60, "policy": 0.15, "history": 0.15, "recency": 0.10}
FULL_HISTORY, FEWEST_HISTORY, FRESH_DAYS, STALE_DAYS, OLDEST_DAYS, VOL_ROWS, LEAST_VOL_ROWS = 252, 60, 7, 31, 31, 252, 20


def country_curves(rates: DataFrame, decided: Column, tenors: tuple[int, int, int], by: str = "country", ts: str = "date", years: tuple[float, float] = (2.0, 10.0)) -> DataFrame:
    """A row for each country as known at ``decided``: latest rates of ``tenors`` (policy, short, long), level, slope, policy gap and state, changes of slope and level in bp, volatility of the level's changes, durations, convexities, and quality.

    History is the dates on which both the short and the long tenor stand. A change is the
    last value less the last one that is so many days older.
    """
    known = rates.where(F.col(ts) <= decided)
    names = dict(zip(("policy", "short", "long"), tenors))
    at = lambda k: F.when(F.col("tenor") == k, F.col("rate"))
    latest = known.groupBy(by).agg(*[F.max_by("rate", F.when(F.col("tenor") == k, F.col(ts))).alias(n) for n, k in names.items()], F.max(F.when(F.col("tenor").isin(*tenors), F.col(ts))).alias("as_of"))
    daily = known.where(F.col("tenor").isin(tenors[1], tenors[2])).groupBy(by, ts).agg(F.avg(at(tenors[1])).alias("a"), F.avg(at(tenors[2])).alias("b")).where("a is not null and b is not null")
    order = W.partitionBy(by).orderBy(ts)
    newest = W.partitionBy(by).orderBy(F.desc(ts))
    h = daily.select(by, ts, (F.col("b") - F.col("a")).alias("slope"), ((F.col("a") + F.col("b")) / 2).alias("level")).withColumn("k", F.row_number().over(newest))
    h = h.withColumn("step", (F.col("level") - F.lag("level").over(order)) * 100).withColumn("last", F.max(ts).over(W.partitionBy(by)))

    def change(value: str, days: int) -> Column:
        before = F.max_by(value, F.when(F.col(ts) <= F.date_sub("last", days), F.col(ts)))
        return (F.max(F.when(F.col("k") == 1, F.col(value))) - before) * 100

    recent = F.when((F.col("k") <= VOL_ROWS) & F.col("step").isNotNull(), F.col("step"))
    past = h.groupBy(by).agg(
        F.count("*").alias("history"), change("slope", 31).alias("slope_1m_bp"), change("slope", 92).alias("slope_3m_bp"), change("level", 92).alias("level_3m_bp"), F.when(F.count(recent) >= LEAST_VOL_ROWS, F.stddev_samp(recent)).alias("change_vol_bp")
    )
    x = latest.join(past, by, "left").fillna(0, ["history"]).withColumn("level", (F.col("short") + F.col("long")) / 2).withColumn("slope", F.col("long") - F.col("short")).withColumn("policy_gap", F.col("short") - F.col("policy"))
    s = F.col("slope")
    x = x.withColumn("state", F.when(s.isNull(), "unknown").when(s < -0.25, "inverted").when(s < 0.25, "flat").when(s < 1.5, "normal").otherwise("steep"))
    for n, y in zip(("short", "long"), years):
        x = x.withColumn(f"duration_{n}", modified_duration(F.col(n), F.lit(y))).withColumn(f"convexity_{n}", convexity(F.col(n), F.lit(y)))
    known_ = lambda n: F.col(n).isNotNull().cast("double")
    x = x.withColumn("tenors", (known_("short") + known_("long")).cast("long")).withColumn("stale_days", F.greatest(F.date_diff(decided, F.col("as_of")), F.lit(0)))
    fresh = F.when(F.col("stale_days") <= FRESH_DAYS, 1.0).when(F.col("stale_days") <= STALE_DAYS, 0.5).otherwise(0.0)
    score = QUALITY["tenors"] * F.col("tenors") / 2 + QUALITY["policy"] * known_("policy") + QUALITY["history"] * F.least(F.col("history") / float(FULL_HISTORY), F.lit(1.0)) + QUALITY["recency"] * fresh
    good = (F.col("tenors") >= 2) & (F.col("history") >= FEWEST_HISTORY) & (F.col("stale_days") <= OLDEST_DAYS)
    return x.withColumn("quality_score", score).withColumn("quality", F.when(good, "High").when(F.col("tenors") >= 2, "Medium").otherwise("Insufficient"))
