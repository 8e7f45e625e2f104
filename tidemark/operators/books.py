"""Score books: features of a training window, robust z-scores, and signed sums of them as capped weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import panel as P
from tidemark.sources.files import cut

#: Rows that a conditional mean needs more than, and bounds of ratios.
FEW = 5
TAIL, TOP, CRASH = 0.10, 0.65, 0.03
FEATURES = (
    "resid_mom", "resid_ir", "upside_beta", "downside_beta", "tail_beta", "tail_loss", "large_up_beta", "upside_hit", "upside_excess", "upside_power", "trend_quality", "recovery", "crash",
    "mom", "mom_63", "mom_252", "total", "downside", "cvar", "drawdown", "fundamental",
)

#: Ratios derived of features before they are scored.
DERIVED = {
    "tail_beta": "greatest(least(tail_beta, 4.0::double), -2.0::double)",
    "convexity": "upside_beta - downside_beta",
    "upside_edge": "greatest(least(upside_beta - 1.0::double, 4.0::double), -2.0::double)",
    "downside_drag": "greatest(least(downside_beta - 0.75::double, 4.0::double), -2.0::double)",
    "tail_convexity": "greatest(least(upside_beta - downside_beta - 0.35::double * greatest(least(tail_beta, 4.0::double), -2.0::double), 4.0::double), -4.0::double)",
    "pure_convexity": "greatest(least(upside_beta - downside_beta, 4.0::double), -4.0::double)",
}
REAL_CONVEXITY = "greatest(least(0.45::double * large_up_beta + 0.25::double * upside_beta + 0.2::double * z_upside_hit + 0.12::double * z_upside_excess - 0.32::double * downside_beta - 0.28::double * tail_beta, 5.0::double), -5.0::double)"
GATES = {
    "upside": "upside_beta > 1.0 and downside_beta < 1.0 and tail_beta < 1.10 and pure_convexity > 0.0",
    "real": "large_up_beta > 1.02 and upside_beta > 0.95 and downside_beta < 1.03 and tail_beta < 1.18 and upside_hit > 0.44 and real_convexity > 0.0",
}
#: Sums of z-scores that books share.
SHARED = {
    "tail_penalty": {"tail_beta": 0.45, "tail_loss": 0.35, "cvar": 0.25, "crash": 0.20, "drawdown": 0.15},
    "quality_growth": {"trend_quality": 0.35, "recovery": 0.25, "total": 0.20, "downside": -0.20, "drawdown": -0.15},
}
#: Each book's terms, with the book it builds on and that book's factor, and the gate beyond which it is at its floor.
BOOKS: dict[str, tuple[str | None, float, str | None, dict[str, float]]] = {
    "capital": (None, 0.0, None, {"downside": -0.45, "cvar": -0.35, "drawdown": -0.25, "total": 0.05}),
    "capital_xi_tail": (None, 0.0, None, {"downside": -0.34, "cvar": -0.30, "drawdown": -0.24, "tail_beta": -0.26, "tail_loss": -0.24, "downside_drag": -0.18, "recovery": 0.08, "total": 0.05, "crowd": -0.12}),
    "growth": (None, 0.0, None, {"mom": 0.30, "resid_mom": 0.25, "upside_beta": 0.15, "total": 0.15, "cvar": -0.20, "crowd": -0.18}),
    "alpha": ("growth", 1.0, None, {"resid_mom": 0.20, "crowd": -0.10}),
    "growth_plus": (None, 0.0, None, {"mom_63": 0.20, "mom": 0.18, "mom_252": 0.12, "resid_ir": 0.18, "convexity": 0.16, "trend_quality": 0.12, "recovery": 0.10, "total": 0.08, "cvar": -0.18, "drawdown": -0.15, "crash": -0.12, "crowd": -0.18}),
    "alpha_plus": ("growth_plus", 1.0, None, {"resid_mom": 0.16, "resid_ir": 0.10, "convexity": 0.08, "crowd": -0.08}),
    "growth_tail_aware": (None, 0.0, None, {"mom_63": 0.18, "mom": 0.16, "resid_ir": 0.14, "convexity": 0.20, "trend_quality": 0.10, "recovery": 0.08, "total": 0.06, "tail_beta": -0.22, "tail_loss": -0.20, "cvar": -0.16, "drawdown": -0.12, "crash": -0.10, "crowd": -0.16}),
    "alpha_tail_aware": ("growth_tail_aware", 1.0, None, {"resid_mom": 0.14, "resid_ir": 0.10, "convexity": 0.08, "tail_beta": -0.10, "crowd": -0.06}),
    "growth_tail_convex": (None, 0.0, None, {"mom_63": 0.18, "mom": 0.15, "resid_ir": 0.13, "resid_mom": 0.13, "tail_convexity": 0.24, "upside_edge": 0.16, "quality_growth": 0.16, "downside_drag": -0.18, "tail_penalty": -0.42, "crowd": -0.22}),
    "alpha_tail_convex": ("growth_tail_convex", 1.0, None, {"resid_ir": 0.16, "resid_mom": 0.12, "tail_convexity": 0.10, "tail_beta": -0.10, "crowd": -0.08}),
    "growth_upside_convex": (None, 0.0, "upside", {"mom_63": 0.25, "mom": 0.18, "resid_ir": 0.20, "resid_mom": 0.18, "pure_convexity": 0.24, "upside_edge": 0.18, "quality_growth": 0.15, "recovery": 0.10, "tail_beta": -0.22, "cvar": -0.18, "downside_drag": -0.14, "crowd": -0.10}),
    "alpha_upside_convex": ("growth_upside_convex", 1.0, "upside", {"resid_ir": 0.20, "resid_mom": 0.16, "pure_convexity": 0.12, "tail_beta": -0.12, "crowd": -0.08}),
    "growth_fundamental_upside_convex": ("growth_upside_convex", 0.34, None, {"fundamental": 0.30, "pure_convexity": 0.14, "resid_ir": 0.12, "mom": 0.08, "tail_beta": -0.12, "crowd": -0.10}),
    "alpha_fundamental_upside_convex": ("growth_fundamental_upside_convex", 0.40, None, {"fundamental": 0.22, "resid_mom": 0.18, "resid_ir": 0.14, "pure_convexity": 0.12, "tail_beta": -0.10, "crowd": -0.08}),
    "growth_real_upside_convex": (None, 0.0, "real", {"mom_63": 0.22, "mom": 0.16, "resid_ir": 0.18, "resid_mom": 0.14, "real_convexity": 0.30, "large_up_beta": 0.18, "upside_hit": 0.14, "upside_power": 0.10, "quality_growth": 0.12, "tail_beta": -0.20, "cvar": -0.16, "downside_drag": -0.14, "crowd": -0.12}),
    "alpha_real_upside_convex": ("growth_real_upside_convex", 1.0, "real", {"resid_ir": 0.18, "resid_mom": 0.14, "real_convexity": 0.12, "upside_excess": 0.08, "tail_beta": -0.12, "crowd": -0.08}),
    "growth_fundamental_real_upside_convex": ("growth_real_upside_convex", 0.38, "real", {"fundamental": 0.26, "real_convexity": 0.18, "upside_excess": 0.12, "resid_ir": 0.10, "tail_beta": -0.12, "crowd": -0.08}),
    "alpha_fundamental_real_upside_convex": ("growth_fundamental_real_upside_convex", 0.44, "real", {"fundamental": 0.20, "resid_ir": 0.16, "real_convexity": 0.14, "upside_excess": 0.10, "tail_beta": -0.10, "crowd": -0.08}),
}
FLOOR_BOOK, FLOOR = "growth_upside_convex", 3.0


def terms(book: str) -> str:
    """SQL of a book's own terms and of the book it builds on."""
    base, factor, _, own = BOOKS[book]
    flat: dict[str, float] = {}
    for name, coef in own.items():
        for part, share in SHARED.get(name, {name: 1.0}).items():
            flat[part] = flat.get(part, 0.0) + coef * share
    said = [f"{c!r}::double * {'crowd' if n == 'crowd' else f'z_{n}'}" for n, c in flat.items()]
    return " + ".join([*([f"{factor!r}::double * {base}"] if base else []), *said])


def window_features(df: DataFrame, bench: DataFrame, window: int = 504, entity: str = "entity", ts: str = "date", ret: str = "r", rb: str = "rb") -> DataFrame:
    """The return features of each entity over the last ``window`` days of ``bench`` (one row a day)."""
    days = bench.orderBy(F.desc(ts)).limit(window)  # a calendar
    cuts = days.agg(F.percentile(rb, TAIL).alias("_low"), F.percentile(rb, TOP).alias("_high"))
    x = df.select(entity, ts, ret).join(F.broadcast(days.crossJoin(cuts)), ts)  # one row a day
    order = W.partitionBy(entity).orderBy(ts)
    run = order.rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("_k", F.row_number().over(W.partitionBy(entity).orderBy(F.desc(ts))))
    x = x.withColumn("_up", F.sum(F.log1p(ret)).over(run)).withColumn("_peak", F.max("_up").over(run))
    last21 = order.rowsBetween(-20, 0)
    x = x.withColumn("_trend", F.when(F.count(ret).over(last21) == 21, (F.sum(ret).over(last21) > 1e-12).cast("double")))
    x = x.withColumn("_dd", F.exp(F.col("_up") - F.col("_peak")) - 1)
    market = x.groupBy(entity).agg(F.regr_slope(ret, rb).alias("_b"), F.regr_intercept(ret, rb).alias("_a"), F.percentile(F.negate(F.col(ret)), 0.95).alias("_q"))
    x = x.join(market, entity).withColumn("_e", F.when(F.col("_k") <= 126, F.col(ret) - F.coalesce(F.col("_a") + F.col("_b") * F.col(rb), F.lit(0.0))))
    up, down, tail, top = F.col(rb) > 0, F.col(rb) < 0, F.round(rb, 12) <= F.round("_low", 12), F.round(rb, 12) >= F.round("_high", 12)

    def ratio(days: Column, otherwise) -> Column:
        enough = (F.count_if(days) > FEW) & (F.abs(F.avg(F.when(days, F.col(rb)))) > 1e-12)
        return F.when(enough, F.avg(F.when(days, F.col(ret))) / F.avg(F.when(days, F.col(rb)))).otherwise(otherwise)

    many = F.count_if(top) > FEW
    losses = F.avg(F.when(F.round(-F.col(ret), 12) >= F.round("_q", 12), -F.col(ret)))
    mean = lambda k: F.avg(F.when(F.col("_k") <= k, F.col(ret))) * 252
    root = F.sqrt(F.lit(252.0))
    upside = ratio(up, F.lit(0.0))
    return x.groupBy(entity).agg(
        (F.avg("_e") * 252).alias("resid_mom"), (F.avg("_e") / (F.stddev_samp("_e") + 1e-12) * root).alias("resid_ir"), upside.alias("upside_beta"), ratio(down, F.lit(1.0)).alias("downside_beta"),
        ratio(tail, F.lit(1.0)).alias("tail_beta"), F.when(F.count_if(tail) > FEW, F.greatest(-F.avg(F.when(tail, F.col(ret))), F.lit(0.0))).otherwise(losses).alias("tail_loss"), ratio(top, upside).alias("large_up_beta"),
        F.when(many, F.avg(F.when(top, (F.col(ret) > F.col(rb)).cast("double")))).otherwise(0.0).alias("upside_hit"), F.when(many, F.avg(F.when(top, F.col(ret) - F.col(rb))) * 252).otherwise(0.0).alias("upside_excess"),
        F.when(many, F.sqrt(F.avg(F.when(top, F.pow(F.greatest(F.col(ret), F.lit(0.0)), 2)))) * root).otherwise(0.0).alias("upside_power"), F.coalesce(F.avg("_trend"), F.lit(0.0)).alias("trend_quality"),
        (F.max(F.when(F.col("_k") == 1, F.col("_dd"))) - F.min("_dd")).alias("recovery"), F.when(F.count(ret) > 30, -F.percentile(ret, CRASH)).otherwise(0.0).alias("crash"), mean(126).alias("mom"), mean(63).alias("mom_63"), mean(252).alias("mom_252"),
        (F.avg(ret) * 252).alias("total"), (F.sqrt(F.avg(F.pow(F.least(F.col(ret), F.lit(0.0)), 2))) * root).alias("downside"), losses.alias("cvar"), (-F.min("_dd")).alias("drawdown"),
    )


def mean_correlation(df: DataFrame, bench: DataFrame, window: int = 504, entity: str = "entity", ts: str = "date", ret: str = "r") -> DataFrame:
    """``entity, crowding``: the mean correlation of each entity with all others over the window's days, missing rows as zero, from its covariance with the sum of all standardised series."""
    days = bench.orderBy(F.desc(ts)).limit(window).select(ts)  # a calendar
    n = days.agg(F.count("*").cast("double").alias("_d"))
    x = df.select(entity, ts, ret).join(F.broadcast(days), ts)
    sums = x.groupBy(entity).agg(F.sum(ret).alias("_s"), F.sum(F.col(ret) * F.col(ret)).alias("_q")).crossJoin(F.broadcast(n))  # one row
    sd = F.sqrt((F.col("_q") - F.col("_s") * F.col("_s") / F.col("_d")) / (F.col("_d") - 1))
    moves = sums.withColumn("_sd", sd).where("_sd > 1e-12")
    each = x.join(moves.select(entity, "_sd"), entity)
    daily = each.groupBy(ts).agg(F.sum(F.col(ret) / F.col("_sd")).alias("_z"))
    whole = daily.agg(F.sum("_z").alias("_all"))
    met = each.join(daily, ts).groupBy(entity).agg(F.sum(F.col(ret) * F.col("_z")).alias("_with"))
    many = moves.agg(F.count("*").alias("_n"))
    y = moves.join(met, entity).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(many))  # one row each
    cov = (F.col("_with") - F.col("_s") / F.col("_d") * F.col("_all")) / (F.col("_sd") * (F.col("_d") - 1))
    return y.select(entity, X.ratio(cov - 1, F.when(F.col("_n") > 1, F.col("_n") - 1).cast("double")).alias("crowding"))


def robust_z(df: DataFrame, values: list[str]) -> DataFrame:
    """``z_<value>``: distance from the median over 1.4826 MAD, or over the standard deviation where that is nothing, or 1; nulls count as zero; at most 3."""
    filled = df.withColumns({v: F.coalesce(F.when(~F.isnan(v), F.col(v)), F.lit(0.0)) for v in values})
    one = X.with_group(filled, [], **{f"_m_{v}": F.median(v) for v in values}, **{f"_s_{v}": F.stddev_pop(v) for v in values})
    two = X.with_group(one, [], **{f"_d_{v}": F.median(F.abs(F.col(v) - F.col(f"_m_{v}"))) for v in values})
    scale = {v: F.when(F.col(f"_d_{v}") * 1.4826 > 1e-12, F.col(f"_d_{v}") * 1.4826).when(F.col(f"_s_{v}") > 1e-12, F.col(f"_s_{v}")).otherwise(1.0) for v in values}
    made = {f"z_{v}": X.clip((F.col(v) - F.col(f"_m_{v}")) / scale[v], -3.0, 3.0) for v in values}
    return two.withColumns(made).drop(*[f"_{k}_{v}" for v in values for k in "msd"])


def book_scores(features: DataFrame) -> DataFrame:
    """``features`` with a score for each book of ``BOOKS``; ``features`` has ``FEATURES`` and ``crowding``, one row an entity.

    The z-scores are checkpointed, as every step over the whole cross-section reads them again.
    """
    x = cut(features.selectExpr("* except (tail_beta)", f"{DERIVED['tail_beta']} as tail_beta", *[f"{v} as {k}" for k, v in DERIVED.items() if k != "tail_beta"]))
    x = cut(robust_z(x, [*FEATURES, *[k for k in DERIVED if k != "tail_beta"], "crowding"]).withColumn("crowd", F.greatest("z_crowding", F.lit(0.0))))
    x = cut(robust_z(x.selectExpr("*", f"{REAL_CONVEXITY} as real_convexity"), ["real_convexity"]))
    # the book that sets the floors comes first; the others lie below its least score
    x = X.with_group(x.selectExpr("*", f"{terms(FLOOR_BOOK)} as _raw"), [], source=x.selectExpr(f"{terms(FLOOR_BOOK)} as _raw"), _least=F.min("_raw"))
    x = cut(x.withColumn(FLOOR_BOOK, F.when(F.expr(GATES[BOOKS[FLOOR_BOOK][2]]), F.col("_raw")).otherwise(F.col("_least") - FLOOR)).drop("_raw", "_least"))
    x = X.with_group(x, [], _floor=F.min(FLOOR_BOOK) - FLOOR)
    for book, (_, _, gate, _) in BOOKS.items():
        if book != FLOOR_BOOK:
            x = x.selectExpr("*", f"if({GATES[gate]}, {terms(book)}, _floor) as {book}" if gate else f"{terms(book)} as {book}")
    return x.drop("_floor")


def book_weights(scores: DataFrame, cap: float, entity: str = "entity") -> DataFrame:
    """``book, entity, score, weight``: each book's scores from its least on, capped at ``cap`` by room; weights of a book add up to 1."""
    long = cut(scores.select(entity, *BOOKS).unpivot(entity, list(BOOKS), "book", "score"))
    long = X.with_group(long, ["book"], _least=F.min("score"))
    capped = P.capped_by_room(long.withColumn("weight", F.greatest(F.col("score") - F.col("_least") + 1e-6, F.lit(1e-6))), cap, "book")
    whole = X.with_group(capped.select("book", entity, "score", "capped"), ["book"], _all=F.sum("capped"))
    return whole.select("book", entity, "score", (F.col("capped") / F.col("_all")).alias("weight"))
