"""Fundamental ratios, quality tests, confidence and composite scores over a cross-section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X

RATIOS = ("ev", "fcf", "roic", "ev_ebitda", "fcf_yield", "net_debt_ebitda", "turnover", "altman_z", "coverage", "retention", "price_book", "price_earnings", "eps", "solvency", "roe", "current_ratio", "gross_margin", "net_margin")


def tax_rate() -> Column:
    """Tax over pre-tax income, 0.21 where unknown, within 0 and 0.45."""
    return X.clip(F.coalesce(X.ratio("tax", "pretax"), F.lit(0.21)), 0.0, 0.45)


def fundamental_ratios(df: DataFrame, price: str = "price") -> DataFrame:
    """The ratios and how many of them are known."""
    c = F.col
    cap = c(price) * c("shares")
    ebitda = c("ebit") + c("depreciation")
    fcf = c("cfo") - c("capex")
    ev = cap + c("debt") - c("cash")
    # all seven inputs are needed
    altman = 1.2 * X.ratio("working_capital", "assets") + 1.4 * X.ratio("retained", "assets") + 3.3 * X.ratio("ebit", "assets") + 0.6 * X.ratio(cap, "liabilities") + X.ratio("revenue", "assets")
    made = {
        "ev": ev, "fcf": fcf, "roic": X.ratio(c("ebit") * (1 - tax_rate()), c("debt") + c("equity") - c("cash")), "ev_ebitda": X.ratio(ev, ebitda), "fcf_yield": X.ratio(fcf, cap), "net_debt_ebitda": X.ratio(c("debt") - c("cash"), ebitda),
        "turnover": X.ratio("revenue", "assets"), "altman_z": altman, "coverage": X.ratio("ebit", F.abs("interest")), "retention": X.clip(X.ratio("retained", "net_income"), -2.0, 2.0), "price_book": X.ratio(cap, "equity"), "price_earnings": X.ratio(cap, "net_income"), "eps": X.ratio("net_income", "shares"),
        "solvency": X.ratio("assets", "liabilities"), "roe": X.ratio("net_income", "equity"), "current_ratio": X.ratio("current_assets", "current_liabilities"), "gross_margin": X.ratio("gross_profit", "revenue"), "net_margin": X.ratio("net_income", "revenue"),
    }
    out = df.withColumns(made)
    return out.withColumn("known_ratios", sum(F.col(r).isNotNull().cast("int") for r in RATIOS))


def quality_tests(df: DataFrame, entity: str = "entity", order: tuple[str, ...] = ("period_end", "available", "filing"), least: int = 7) -> DataFrame:
    """Nine tests of this statement against the one before; null unless ``least`` of them can be made."""
    w = W.partitionBy(entity).orderBy(*order)
    was = lambda e: F.lag(e).over(w)
    roa, leverage = X.ratio("net_income", "assets"), X.ratio("debt", "assets")
    liquid, margin, turn = X.ratio("current_assets", "current_liabilities"), X.ratio("gross_profit", "revenue"), X.ratio("revenue", "assets")
    tests = [F.col("net_income") > 0, F.col("cfo") > 0, roa > was(roa), F.col("cfo") > F.col("net_income"), leverage < was(leverage), liquid > was(liquid), F.col("shares") <= was(F.col("shares")), margin > was(margin), turn > was(turn)]
    out = df.withColumn("_tests", F.array(*tests))
    made = F.size(F.filter("_tests", lambda t: t.isNotNull()))
    return out.withColumn("evaluable", made).withColumn("quality", F.when(made >= least, F.size(F.filter("_tests", lambda t: t)))).drop("_tests")


def growth(df: DataFrame, columns: list[str], entity: str = "entity", order: tuple[str, ...] = ("period_end", "available", "filing")) -> DataFrame:
    """Change of each column over its absolute value one statement before, and change of the margins."""
    w = W.partitionBy(entity).orderBy(*order)
    out = df.withColumns({f"{c}_growth": X.ratio(F.col(c) - F.lag(c).over(w), F.abs(F.lag(c).over(w))) for c in columns})
    margins = {"gross_margin": X.ratio("gross_profit", "revenue"), "net_margin": X.ratio("net_income", "revenue")}
    return out.withColumns({f"{k}_change": m - F.lag(m).over(w) for k, m in margins.items()})


def period_class(start: str | Column, end: str | Column) -> Column:
    days = F.date_diff(X.col(end), X.col(start))
    return F.when(days.between(70, 115), "quarter").when(days.between(330, 390), "year").otherwise("other")


def pit_confidence(filed: Column, accepted: Column, coverage: Column, age_days: Column) -> Column:
    """0.05 to 0.95: filing known, acceptance known, coverage, less staleness over 540 days."""
    stale = X.clip(age_days / 540.0, 0.0, 1.0)
    return X.clip(0.20 + 0.35 * filed.cast("double") + 0.20 * accepted.cast("double") + 0.20 * coverage - 0.20 * stale, 0.05, 0.95)


def decayed_confidence(source: Column, age_days: Column, coverage: Column) -> Column:
    return source * F.exp(-F.greatest(age_days, F.lit(0)) / 540.0) * coverage


def confidence_class(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.5, "medium").when(c >= 0.25, "low").otherwise("weak")


def missing_reasons(df: DataFrame, inputs: dict[str, list[str]], key: str) -> DataFrame:
    """A row for each ratio that is null, with the inputs that are missing (or zero) as the reason."""
    made = [F.array_join(F.array_compact(F.array(*[F.when(F.col(i).isNull(), F.lit(f"missing {i}")).when(F.col(i) == 0, F.lit(f"zero {i}")) for i in needs])), ";").alias(r) for r, needs in inputs.items()]
    return df.select(key, *made).unpivot(key, list(inputs), "ratio", "reason").where("reason <> ''")


def composite(df: DataFrame, styles: dict[str, list[tuple[str, float]]], weights: dict[str, float]) -> DataFrame:
    """Style scores as null-skipping means of signed features, and their weighted sum."""

    def mean(parts: list[tuple[str, float]]) -> Column:
        known = F.array_compact(F.array(*[F.col(c) * s for c, s in parts]))
        return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))

    out = df.withColumns({f"{k}_style": mean(v) for k, v in styles.items()})
    return out.withColumn("composite", sum(F.coalesce(F.col(f"{k}_style"), F.lit(0.0)) * w for k, w in weights.items()))


def fundamental_gate(df: DataFrame, *across: str) -> DataFrame:
    """Reject reasons; null values pass; the quality percentile holds only among ten rows or more."""
    low = F.when(F.count("quality") >= 10, F.percentile("quality", 0.3))
    rules = {"few_ratios": F.col("known_ratios") < 6, "low_quality": F.col("quality") < F.col("_low"), "leverage": F.col("net_debt_ebitda") > 4, "coverage": F.col("coverage") < 1.5, "distress": F.col("altman_z") < 1.1, "liquidity": F.col("current_ratio") < 0.8}
    out = X.with_group(df, list(across), _low=low)
    reasons = F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))
    return out.withColumn("reasons", F.array_join(reasons, ";")).withColumn("accepted", F.col("reasons") == "").drop("_low")


def posterior(df: DataFrame, value: str, variance: str, group: str, prior: float = 5.0) -> DataFrame:
    """Empirical-Bayes means: the group's mean, drawn to the whole's by n / (n + prior), then the entity's by precision."""
    out = X.with_group(df, [group], _n=F.count(value), _g=F.avg(value))
    out = X.with_group(out, [], source=df, _all=F.avg(value), _tau=F.var_samp(value))
    w = F.col("_n") / (F.col("_n") + prior)
    out = out.withColumn("prior_mean", w * F.col("_g") + (1 - w) * F.col("_all"))
    k = X.ratio("_tau", F.col("_tau") + F.col(variance))
    out = out.withColumn("posterior_mean", k * F.col(value) + (1 - k) * F.col("prior_mean")).withColumn("posterior_sd", F.sqrt(k * F.col(variance)))
    z = X.ratio("posterior_mean", "posterior_sd")
    return out.withColumn("low", F.col("posterior_mean") - 1.96 * F.col("posterior_sd")).withColumn("high", F.col("posterior_mean") + 1.96 * F.col("posterior_sd")).withColumn("p_positive", normal_cdf(z)).drop("_n", "_g", "_all", "_tau")


def normal_cdf(z: Column) -> Column:
    """Normal distribution function by a rational approximation (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def suitability(df: DataFrame) -> DataFrame:
    """Investor score of 0 to 100 from balance, segment and horizon, its profile and that profile's caps."""
    parts = {"capacity": X.clip(F.col("balance") / 10000.0, 0.0, 1.0), "horizon": X.clip(F.col("horizon_years") / 20.0, 0.0, 1.0), "tolerance": X.clip(F.col("max_drawdown") / 0.5, 0.0, 1.0), "need": 1 - X.clip(F.col("liquidity_need"), 0.0, 1.0)}
    score = 100 * (0.25 * parts["capacity"] + 0.30 * parts["horizon"] + 0.30 * parts["tolerance"] + 0.15 * parts["need"])
    out = df.withColumn("score", score).withColumn("profile", F.when(F.col("score") >= 70, "aggressive").when(F.col("score") >= 50, "growth").when(F.col("score") >= 30, "balanced").otherwise("conservative"))
    cap = F.create_map(*[F.lit(x) for pair in (("aggressive", 0.15), ("growth", 0.12), ("balanced", 0.10), ("conservative", 0.07)) for x in pair])
    return out.withColumn("weight_cap", F.element_at(cap, F.col("profile"))).withColumn("incoherent", (F.col("max_drawdown") > 0.35) & (F.col("horizon_years") < 3))


def orders(target: DataFrame, current: DataFrame, prices: DataFrame, capital: float, key: str = "entity") -> DataFrame:
    """Order legs from current to target weights; changes up to 1e-8 are no orders."""
    both = target.select(key, F.col("weight").alias("to")).join(current.select(key, F.col("weight").alias("from")), key, "full").na.fill(0.0, ["to", "from"])
    out = both.withColumn("change", F.col("to") - F.col("from")).where(F.abs("change") > 1e-8).join(prices.select(key, "close"), key, "left")
    return out.select(key, "from", "to", F.when(F.col("change") > 0, "buy").otherwise("sell").alias("side"), (F.abs("change") * capital).alias("notional"), X.ratio(F.abs("change") * capital, "close").alias("quantity"))


def pre_trade_checks(legs: DataFrame, key: str = "entity", weight_cap: float = 0.05, participation: float = 0.1, cost_cap: float = 0.01) -> DataFrame:
    """Long (order, check, passed) rows of the rules before trading, from legs with ``adv`` and ``cost``."""
    checks = {"weight_cap": F.col("to") <= weight_cap, "adv_participation": F.coalesce(X.ratio("notional", "adv") <= participation, F.lit(False)), "cost_cap": F.col("cost") <= cost_cap, "has_price": F.col("quantity").isNotNull()}
    return legs.select(key, *[v.alias(k) for k, v in checks.items()]).unpivot(key, list(checks), "check", "passed")


def contract_rows(df: DataFrame, *by: str, weight: str = "weight") -> DataFrame:
    """Weights normalised to 1, confidence within 0 and 1, prices that are not positive nulled."""
    total = F.sum(F.greatest(F.col(weight), F.lit(0.0))).over(W.partitionBy(*by))
    return df.withColumn(weight, X.ratio(F.greatest(F.col(weight), F.lit(0.0)), total)).withColumn("confidence", X.clip("confidence", 0.0, 1.0)).withColumn("price", F.when(F.col("price") > 0, F.col("price")))


def row_hash(*columns: str) -> Column:
    """Digest of a row, whatever the order its columns are given in."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
