"""Cross-section of filings and prices as known at a signal date, scored by groups, styles and regime."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import panel as P
from tidemark.operators import scoring as S
from tidemark.sources.files import cut

#: Signed features of each group.
GROUPS = {
    "value": {"ev_ebitda": -1.0, "price_book": -1.0, "price_earnings": -1.0, "net_debt_ebitda": -1.0, "fcf_yield": 1.0, "earnings_yield": 1.0},
    "quality": {"roic": 1.0, "roe": 1.0, "coverage": 1.0, "turnover": 1.0, "altman_z": 1.0, "solvency": 1.0},
    "growth": {"revenue_growth": 1.0, "net_income_growth": 1.0, "gross_margin": 1.0, "net_margin": 1.0, "gross_margin_change": 1.0},
    "technical": {"mom_21": 1.0, "mom_63": 1.0, "mom_126": 1.0, "trend_50_200": 1.0, "drawdown_126": 1.0, "vol_63": -1.0},
    "liquidity": {"dollar_volume_63": 1.0, "illiquidity_63": -1.0},
}
STYLES = {"momentum": {"mom_63": 1.0, "mom_126": 1.0}, "low_vol": {"vol_63": -1.0}, "size": {"log_cap": -1.0}}
#: Weights of groups by (hawkish, bear), and of groups and the mean of all styles by mandate.
REGIME_WEIGHTS = {
    (True, True): {"value": 0.13, "quality": 0.42, "technical": 0.23, "liquidity": 0.07},
    (True, False): {"value": 0.18, "quality": 0.33, "technical": 0.28, "liquidity": 0.06},
    (False, True): {"value": 0.18, "quality": 0.33, "technical": 0.28, "liquidity": 0.06},
    (False, False): {"value": 0.23, "quality": 0.24, "technical": 0.33, "liquidity": 0.05},
}
MANDATES = {
    "growth_mandate": {"growth": 0.40, "quality": 0.25, "technical": 0.20, "liquidity": 0.10},
    "value_mandate": {"value": 0.40, "quality": 0.30, "technical": 0.15, "liquidity": 0.10},
    "quality_mandate": {"quality": 0.45, "value": 0.20, "technical": 0.20, "liquidity": 0.10},
    "factor_mandate": {"style": 0.55, "technical": 0.25, "liquidity": 0.10},
}
FEATURES = [*dict.fromkeys(f for parts in [*GROUPS.values(), *STYLES.values()] for f in parts)]


def price_features(df: DataFrame, entity: str = "entity", ts: str = "date") -> DataFrame:
    """``entity`` and its technical and liquidity features at its last row, from ``close``, ``r`` and ``volume``."""
    w = W.partitionBy(entity).orderBy(ts)
    x = df.withColumn("_k", F.row_number().over(W.partitionBy(entity).orderBy(F.desc(ts)))).where("_k <= 252")
    rows = lambda n: F.col("_k") <= n
    x = x.withColumn("_peak", F.max(F.when(rows(126), F.col("close"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    last = F.max(F.when(F.col("_k") == 1, F.col("close")))
    back = lambda k: F.max(F.when(F.col("_k") == k + 1, F.col("close")))
    mean = lambda n: F.when(F.count("*") >= n, F.avg(F.when(rows(n), F.col("close"))))
    money = F.col("close") * F.col("volume")
    return x.groupBy(entity).agg(
        *[F.try_divide(last, back(k)).alias(f"_m{k}") for k in (21, 63, 126)], F.try_divide(mean(50), mean(200)).alias("_t"), F.min(F.when(rows(126), F.col("close") / F.col("_peak") - 1)).alias("drawdown_126"),
        F.stddev_samp(F.when(rows(63), F.col("r"))).alias("vol_63"), F.avg(F.when(rows(63), money)).alias("dollar_volume_63"), (F.avg(F.when(rows(63), F.try_divide(F.abs("r"), F.when(money > 0, money)))) * 1e6).alias("illiquidity_63"),
    ).select(entity, *[(F.col(f"_m{k}") - 1).alias(f"mom_{k}") for k in (21, 63, 126)], (F.col("_t") - 1).alias("trend_50_200"), "drawdown_126", "vol_63", "dollar_volume_63", "illiquidity_63")


def latest_statements(ratios: DataFrame, as_of: Column, entity: str = "entity") -> DataFrame:
    """The latest statement of each entity known at ``as_of``, with growth against the one known before it."""
    known = ratios.where(F.col("available") <= as_of)
    grown = S.growth(known, ["revenue", "net_income"], entity)
    newest = W.partitionBy(entity).orderBy(F.desc("period_end"), F.desc("available"), F.desc("filing"))
    return grown.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")


def _mean(parts: list[Column]) -> Column:
    known = F.array_compact(F.array(*parts))
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def style_scores(cross: DataFrame, regime: DataFrame, entity: str = "entity") -> DataFrame:
    """``entity, value, quality, growth, technical, liquidity, style, regime_score`` and a score for each of ``MANDATES``.

    ``cross``: one row an entity with ``FEATURES``, nulls where unknown; ``regime``: one row ``hawkish, bear``. A group is the
    mean of what is known of it; a missing group counts as zero in a weighted score.
    """
    z = P.mad_z(cut(cross.select(entity, *FEATURES)), FEATURES)
    signed = lambda parts: [F.col(f"z_{c}") * s for c, s in parts.items()]
    x = cut(z.select(entity, *[_mean(signed(p)).alias(g) for g, p in GROUPS.items()], *[_mean(signed(p)).alias(f"_{s}") for s, p in STYLES.items()]))
    x = x.withColumn("style", _mean([F.col(c) for c in ("value", "quality", "growth", "liquidity", *[f"_{s}" for s in STYLES])]))
    x = x.crossJoin(F.broadcast(regime.select("hawkish", "bear")))  # one row
    total = lambda weights: sum((F.lit(w) * F.coalesce(F.col(g), F.lit(0.0)) for g, w in weights.items()), F.lit(0.0))
    by_regime = F.coalesce(*[F.when((F.col("hawkish") == h) & (F.col("bear") == b), total(w)) for (h, b), w in REGIME_WEIGHTS.items()])
    return x.select(entity, *GROUPS, "style", by_regime.alias("regime_score"), *[total(w).alias(k) for k, w in MANDATES.items()], "hawkish", "bear")
