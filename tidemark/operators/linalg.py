"""Factor models and matrices on moments that Spark has aggregated first.

Only moments of a fixed width (at most 16 by 16), or windows of a fixed number of rows, reach numpy, one group at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _moments(df: DataFrame, by: str, y: str, xs: list[str]) -> DataFrame:
    full = df.dropna(subset=[y, *xs]).withColumn("_one", F.lit(1.0))
    cols = ["_one", *xs]
    xx = [F.sum(F.col(a) * F.col(b)) for a in cols for b in cols]
    xy = [F.sum(F.col(a) * F.col(y)) for a in cols]
    return full.groupBy(by).agg(F.count("*").alias("n"), F.array(*xx).alias("xx"), F.array(*xy).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("sy"))


def factor_betas(df: DataFrame, by: str, y: str, xs: list[str], least: int = 40, ridge: float = 0.0) -> DataFrame:
    """Least squares of y on an intercept and at most 15 factors: long (factor, beta) rows, with R squared and residual variance."""
    if len(xs) > 15:
        raise ValueError("at most 15 factors")
    m = _moments(df, by, y, xs).where(F.col("n") >= least)
    key = dict(m.dtypes)[by]
    names = ["alpha", *xs]

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = len(names)
                a = np.array(row.xx, float).reshape(k, k) + ridge * np.diag([0.0] + [1.0] * (k - 1))
                b = np.linalg.lstsq(a, np.array(row.xy, float), rcond=None)[0]
                rss = max(row.yy - 2 * b @ np.array(row.xy, float) + b @ a @ b, 0.0)
                tss = row.yy - row.sy**2 / row.n
                out += [(getattr(row, by), name, float(v), int(row.n), float(1 - rss / tss) if tss > 0 else None, float(rss / max(row.n - k, 1))) for name, v in zip(names, b)]
            yield pd.DataFrame(out, columns=[by, "factor", "beta", "n", "r2", "residual_variance"])

    return m.mapInPandas(solve, f"{by} {key}, factor string, beta double, n long, r2 double, residual_variance double")


def attribution(betas: DataFrame, weights: DataFrame, factor_means: DataFrame, by: str) -> DataFrame:
    """Portfolio beta and contribution of each factor: sum of weight times beta, times the factor's mean."""
    p = betas.join(weights, by).groupBy("factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("beta"))
    return p.join(factor_means, "factor", "left").withColumn("contribution", F.col("beta") * F.coalesce("mean", F.lit(1.0)))


def risk_decomposition(betas: DataFrame, weights: DataFrame, factor_cov: DataFrame, by: str) -> DataFrame:
    """Factor and specific variance of a portfolio, by quadratic forms in long form."""
    own = betas.join(weights, by)
    b = own.where("factor <> 'alpha'").groupBy("factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("b"))
    f = factor_cov.join(b.select(F.col("factor").alias("i"), F.col("b").alias("bi")), "i").join(b.select(F.col("factor").alias("j"), F.col("b").alias("bj")), "j").agg(F.sum(F.col("bi") * F.col("bj") * F.col("cov")).alias("factor_variance"))
    s = own.where("factor = 'alpha'").agg(F.sum(F.pow("weight", 2) * F.col("residual_variance")).alias("specific_variance"))
    return f.crossJoin(s).withColumn("factor_share", F.try_divide(F.col("factor_variance"), F.col("factor_variance") + F.col("specific_variance")))  # one row each


def asset_risk(betas: DataFrame, weights: DataFrame, factor_cov: DataFrame, by: str) -> DataFrame:
    """``by, weight, marginal, component, share, standalone`` under the covariance B F B' + D of a factor model.

    ``betas`` are rows of ``factor_betas``; ``weights`` are scaled to add up to one, entities without betas taking no
    part. Components add up to the portfolio's volatility and shares to one. The covariance of
    entities is never formed: F B'w has a row for each factor.
    """
    own = betas.join(weights, by)
    total = own.where("factor = 'alpha'").agg(F.sum("weight").alias("_all"))
    own = own.crossJoin(F.broadcast(total)).withColumn("weight", F.try_divide("weight", "_all")).drop("_all")  # one row
    b = own.where("factor <> 'alpha'").groupBy("factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("b"))
    fb = factor_cov.join(b.withColumnRenamed("factor", "j"), "j").groupBy(F.col("i").alias("factor")).agg(F.sum(F.col("cov") * F.col("b")).alias("fb"))
    held = own.where("factor <> 'alpha'").join(F.broadcast(fb), "factor")  # a row for each factor
    systematic = held.groupBy(by).agg(F.sum(F.col("beta") * F.col("fb")).alias("_with"), F.map_from_entries(F.collect_list(F.struct("factor", "beta"))).alias("_beta"))
    pairs = factor_cov.agg(F.collect_list(F.struct("i", "j", "cov")).alias("_cov"))  # at most 15 x 15
    out = own.where("factor = 'alpha'").select(by, "weight", "residual_variance").join(systematic, by).crossJoin(F.broadcast(pairs))
    square = F.aggregate("_cov", F.lit(0.0), lambda a, c: a + c["cov"] * F.coalesce(F.element_at("_beta", c["i"]), F.lit(0.0)) * F.coalesce(F.element_at("_beta", c["j"]), F.lit(0.0)))
    out = out.withColumn("_sigma", F.col("_with") + F.col("weight") * F.col("residual_variance")).withColumn("standalone", F.sqrt(F.greatest(square + F.col("residual_variance"), F.lit(0.0))))
    variance = out.agg(F.sum(F.col("weight") * F.col("_sigma")).alias("_variance"))
    out = out.crossJoin(F.broadcast(variance))  # one row
    vol = F.greatest(F.sqrt(F.greatest("_variance", F.lit(0.0))), F.lit(1e-12))
    part = F.col("weight") * F.col("_sigma")
    return out.select(by, "weight", (F.col("_sigma") / vol).alias("marginal"), (part / vol).alias("component"), (part / F.greatest("_variance", F.lit(1e-12))).alias("share"), "standalone", "residual_variance")


def factor_risk(betas: DataFrame, weights: DataFrame, factor_cov: DataFrame, by: str) -> DataFrame:
    """``block, name, beta, variance, share, factor_share``: factors, specific risk, and the totals of the portfolio."""
    own = betas.join(weights, by)
    total = own.where("factor = 'alpha'").agg(F.sum("weight").alias("_all"))
    own = own.crossJoin(F.broadcast(total)).withColumn("weight", F.try_divide("weight", "_all"))  # one row
    b = own.where("factor <> 'alpha'").groupBy("factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("b"))
    fb = factor_cov.join(b.select(F.col("factor").alias("j"), F.col("b").alias("bj")), "j").groupBy(F.col("i").alias("factor")).agg(F.sum(F.col("cov") * F.col("bj")).alias("fb"))
    factors = b.join(fb, "factor").select(F.lit("factor").alias("block"), F.col("factor").alias("name"), F.col("b").alias("beta"), (F.col("b") * F.col("fb")).alias("variance"))
    none = F.lit(None).cast("double")
    specific = own.where("factor = 'alpha'").agg(F.sum(F.pow("weight", 2) * F.col("residual_variance")).alias("variance")).select(F.lit("specific").alias("block"), F.lit("specific").alias("name"), none.alias("beta"), "variance")
    rows = factors.union(specific)
    parts = rows.groupBy("block").agg(F.sum("variance").alias("variance"))
    sums = parts.select(F.lit("total").alias("block"), F.concat("block", F.lit("_share")).alias("name"), none.alias("beta"), "variance")
    whole = parts.agg(F.sum("variance").alias("variance")).select(F.lit("total").alias("block"), F.lit("variance").alias("name"), none.alias("beta"), "variance")
    said = parts.agg(F.sum("variance").alias("_variance"), F.sum(F.when(F.col("block") == "factor", F.col("variance"))).alias("_factors"))
    out = rows.union(sums).union(whole).crossJoin(F.broadcast(said))  # one row
    return out.select("block", "name", "beta", "variance", F.try_divide("variance", "_variance").alias("share"), F.when(F.col("block") == "factor", F.try_divide("variance", "_factors")).alias("factor_share"))


def scenario_stress(betas: DataFrame, scenarios: DataFrame, by: str) -> DataFrame:
    """Sum of beta times shock for each entity and scenario (long ``scenario, factor, shock``)."""
    return betas.join(F.broadcast(scenarios), "factor").groupBy(by, "scenario").agg(F.sum(F.col("beta") * F.col("shock")).alias("impact"))  # a table of scenarios


def hedges(exposures: DataFrame, limits: DataFrame) -> DataFrame:
    """Hedge size where an exposure passes its limit, in order of excess."""
    out = exposures.join(F.broadcast(limits), "factor").withColumn("excess", F.abs("beta") - F.col("limit")).where("excess > 0")  # a limit a factor
    out = out.withColumn("hedge", -F.signum("beta") * F.col("excess"))
    return out.withColumn("priority", F.row_number().over(W.orderBy(F.round("excess", 9).desc(), "factor"))).select("factor", "beta", "limit", "hedge", "priority")


def shrinkage(df: DataFrame, entity: str = "entity", ts: str = "date", ret: str = "r") -> DataFrame:
    """Shrinkage intensity of the covariance to a multiple of the identity, from pairwise second and fourth moments over common dates."""
    n_all = df.agg(F.countDistinct(entity).alias("p")).first()["p"]
    whole = df.join(df.groupBy(ts).agg(F.count("*").alias("_c")).where(F.col("_c") == n_all).select(ts), ts, "left_semi")
    x = whole.withColumn("d", F.col(ret) - F.avg(ret).over(W.partitionBy(entity)))
    a, b = x.select(F.col(entity).alias("a"), ts, F.col("d").alias("da")), x.select(F.col(entity).alias("b"), ts, F.col("d").alias("db"))
    pair = a.join(b, ts).groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(F.col("da") * F.col("db")).alias("s"), F.avg(F.pow(F.col("da") * F.col("db"), 2)).alias("q"))
    m = pair.agg(F.max("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("s"))).alias("trace"), F.sum(F.pow("s", 2)).alias("ss"), F.sum(F.col("q") - F.pow("s", 2)).alias("beta"), F.count_if(F.col("a") == F.col("b")).alias("p"))
    mu = F.col("trace") / F.col("p")
    delta = F.col("ss") - F.col("p") * mu * mu
    return m.select("n", "p", mu.alias("target"), F.greatest(F.least(F.try_divide(F.col("beta") / F.col("n"), delta), F.lit(1.0)), F.lit(0.0)).alias("intensity"))


def group_distance(df: DataFrame, group: str, key: str, xs: list[str], shrink: float = 0.1) -> DataFrame:
    """Mahalanobis distance within each group, with covariance (1 - shrink) S + shrink I; the inverse is taken on the group's moments."""
    full = df.dropna(subset=xs)
    k = len(xs)
    moments = full.groupBy(group).agg(F.count("*").alias("n"), F.array(*[F.avg(x) for x in xs]).alias("mean"), F.array(*[F.covar_samp(a, b) for a in xs for b in xs]).alias("cov")).where(F.col("n") > 2)

    def invert(batches):
        for pdf in batches:
            pdf["inverse"] = [np.linalg.inv((1 - shrink) * np.array(c, float).reshape(k, k) + shrink * np.eye(k)).ravel().tolist() for c in pdf["cov"]]
            yield pdf[[group, "mean", "inverse"]]

    inverse = moments.mapInPandas(invert, f"{group} {dict(df.dtypes)[group]}, mean array<double>, inverse array<double>")
    own = full.join(F.broadcast(inverse), group)  # one row a group
    d = [F.col(x) - F.col("mean")[i] for i, x in enumerate(xs)]
    return own.select(key, group, F.sqrt(sum(d[i] * d[j] * F.col("inverse")[i * k + j] for i in range(k) for j in range(k))).alias("distance"))


def common_factor(df: DataFrame, xs: list[str], anchor: str) -> tuple[DataFrame, list[float]]:
    """Scores and loadings of the first principal component of standardised columns, its sign that of the correlation with ``anchor``."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    full = VectorAssembler(inputCols=xs, outputCol="_v").transform(df.dropna(subset=xs))
    scaled = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(full).transform(full)
    model = PCA(k=1, inputCol="_s", outputCol="_p").fit(scaled)
    out = model.transform(scaled).withColumn("factor", vector_to_array("_p")[0])
    sign = 1.0 if (out.agg(F.corr("factor", anchor)).first()[0] or 1.0) >= 0 else -1.0
    return out.withColumn("factor", F.col("factor") * sign).drop("_v", "_s", "_p"), [sign * float(x) for x in model.pc.toArray()[:, 0]]


#: What speaks for each regime, by standardised column; a state none of whose scores reaches ``MIXED`` is in transition.
REGIMES = {
    "risk_on": {"bullish": 1.0, "hawkish": -0.4, "credit_spread": -0.35, "volatility": -0.25},
    "inflation_shock": {"hawkish": 1.0, "inflation": 1.0, "term_premium": 0.35},
    "credit_stress": {"credit_spread": 1.0, "volatility": 0.5, "bullish": -0.6},
    "liquidity_or_recession": {"bullish": -1.0, "curve": -0.5, "industry": -0.35, "credit_spread": 0.25},
}
MIXED = 0.15


def _log_densities(z: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Log of weight times density by row and state."""
    out = np.empty((len(z), len(weights)))
    for j, (w, m, c) in enumerate(zip(weights, means, covs)):
        low = np.linalg.cholesky(c)
        y = np.linalg.solve(low, (z - m).T)
        out[:, j] = np.log(w) - 0.5 * (y * y).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * z.shape[1] * np.log(2 * np.pi)
    return out


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = x.max(axis=1, keepdims=True)
    e = np.exp(x - top)
    total = e.sum(axis=1, keepdims=True)
    return e / total, (top + np.log(total))[:, 0]


def gaussian_mixture(z: np.ndarray, k: int, seed: int = 17, starts: int = 3, rounds: int = 100, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances of the likeliest of some seeded EM runs over a bounded window."""
    rng, best, found = np.random.default_rng(seed), -np.inf, None
    eye = ridge * np.eye(z.shape[1])
    for _ in range(starts):
        centres = z[[rng.integers(len(z))]]
        while len(centres) < k:
            far = ((z[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
            pick = rng.choice(len(z), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(z))
            centres = np.vstack([centres, z[pick]])
        share = np.eye(k)[((z[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)]
        last = -np.inf
        for _ in range(rounds):
            n = share.sum(axis=0) + 1e-9
            means = share.T @ z / n[:, None]
            covs = np.array([(share[:, j, None] * (z - means[j])).T @ (z - means[j]) / n[j] + eye for j in range(k)])
            fit = n / n.sum(), means, covs
            share, like = _softmax(_log_densities(z, *fit))
            if like.mean() - last < 1e-3:
                break
            last = like.mean()
        if like.mean() > best:
            best, found = like.mean(), fit
    return found


def regime_labels(means: np.ndarray, xs: list[str], regimes: dict[str, dict[str, float]] | None = None) -> list[str]:
    """The regime with the highest score of each state's means."""
    regimes = REGIMES if regimes is None else regimes
    scores = means @ np.array([[w.get(x, 0.0) for w in regimes.values()] for x in xs])
    return [list(regimes)[int(r.argmax())] if r.max() >= MIXED else "mixed_transition" for r in scores]


def latent_regimes(df: DataFrame, xs: list[str], ts: str, k: int = 4, min_train: int = 252, refit: int = 21, seed: int = 17) -> DataFrame:
    """``ts, refit_at, state, probability, entropy, label, posterior`` of one series with one row a day.

    Every ``refit`` rows from row ``min_train`` on, and at the last, a Gaussian mixture is fitted on the
    last ``3 * min_train`` rows up to there, standardised within them and cut at 5; what it says of its
    last row holds until the next fit. States stand in the order of the first column's mean, and entropy is
    a share of the greatest. Windows are dealt out by fit, so a task holds ``3 * min_train`` rows of each.
    Gaps are filled with the value before, then with the window's median; rows before the first fit are
    null, and so are all of a table of fewer rows.
    """
    span = 3 * min_train
    order = W.orderBy(ts)  # one series
    filled = df.select(ts, *[F.last(F.when(F.isnan(x), None).otherwise(F.col(x)), ignorenulls=True).over(order).alias(x) for x in xs]).dropna("all", subset=xs)
    rows = filled.withColumn("_at", F.row_number().over(order) - 1)
    total = rows.agg(F.max("_at").alias("_last"))  # one row
    own = rows.crossJoin(F.broadcast(total))
    first = F.greatest(F.lit(0), F.ceil((F.col("_at") - min_train) / refit))
    final = F.floor((F.least(F.col("_at") + span - 1, F.col("_last")) - min_train) / refit)
    regular = F.when(final >= first, F.transform(F.sequence(first, F.greatest(first, final)), lambda q: q * refit + min_train)).otherwise(F.array().cast("array<bigint>"))
    latest = F.when((F.col("_last") >= min_train) & (F.col("_at") > F.col("_last") - span), F.array(F.col("_last").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    dealt = own.select(ts, *xs, F.explode(F.array_distinct(F.concat(regular, latest))).alias("_fit"))
    # small windows with much work each: not to be put into one task
    dealt = dealt.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_fit")

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(ts)[xs].astype(float)
        x = x.fillna(x.median()).fillna(0.0).to_numpy()
        sd = x.std(axis=0)
        z = np.clip((x - x.mean(axis=0)) / np.where(sd > 0, sd, 1.0), -5, 5)
        weights, means, covs = gaussian_mixture(z, min(k, max(2, len(z) // 60)), seed)
        ranks = np.argsort(means[:, 0], kind="stable")
        weights, means, covs = weights[ranks], means[ranks], covs[ranks]
        q = _softmax(_log_densities(z[-1:], weights, means, covs))[0][0]
        state = int(q.argmax())
        entropy = float(-(q * np.log(np.clip(q, 1e-300, None))).sum() / np.log(len(q)))
        told = [pdf[ts].max(), state, float(q.max()), entropy, regime_labels(means, xs)[state], q.tolist()]
        return pd.DataFrame([told], columns=["refit_at", "state", "probability", "entropy", "label", "posterior"])

    said = dealt.groupBy("_fit").applyInPandas(fit, f"refit_at {dict(df.dtypes)[ts]}, state int, probability double, entropy double, label string, posterior array<double>")
    told = F.struct("refit_at", "state", "probability", "entropy", "label", "posterior")
    out = rows.select(ts).join(said.select(F.col("refit_at").alias(ts), told.alias("_told")), ts, "left")
    return out.withColumn("_told", F.last("_told", ignorenulls=True).over(order)).select(ts, "_told.*")
