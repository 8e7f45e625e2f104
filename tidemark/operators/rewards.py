"""Scores of actions from a log of rewards in contexts: ridge regression by action with an exploration bonus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_FEATURES = 16


def contextual_scores(log: DataFrame, context: DataFrame, keys: list[str], xs: list[str], reward: str = "reward", alpha: float = 0.35, least: int = 4, priors: DataFrame | None = None) -> DataFrame:
    """``*keys, n, mean, prediction, bonus, prior, score, recommended`` for every combination of keys in the log.

    ``context``: one row with ``xs``, at which actions are scored. With A the identity
    plus the sum of outer products of an action's contexts, and b its contexts times
    rewards, the prediction is x'A^-1 b and the bonus alpha times the root of x'A^-1 x.
    Actions of fewer rows than ``least`` or than features and one have no prediction: they are scored by
    their mean, with the bonus alpha over the root of n + 1. Null features and rewards are zero.
    ``priors``: ``*keys, prior`` (a fixed table) is added. Only sums of a fixed width (at most
    16 features) reach numpy.
    """
    k = len(xs)
    if not 0 < k <= MOST_FEATURES:
        raise ValueError(f"1 to {MOST_FEATURES} features")
    own = log.select(*keys, F.col(reward).alias("_seen"), F.coalesce(reward, F.lit(0.0)).alias("_y"), *[F.coalesce(F.when(~F.isnan(x), F.col(x)), F.lit(0.0)).alias(f"_x{i}") for i, x in enumerate(xs)])
    cols = [F.col(f"_x{i}") for i in range(k)]
    sums = own.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_seen").alias("mean"), F.array(*[F.sum(a * b) for a in cols for b in cols]).alias("xx"), F.array(*[F.sum(a * F.col("_y")) for a in cols]).alias("xy"))
    at = context.select(F.array(*[F.coalesce(F.col(x).cast("double"), F.lit(0.0)) for x in xs]).alias("at"))
    met = sums.crossJoin(F.broadcast(at))  # one row
    types = dict(log.dtypes)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                inverse = np.linalg.pinv(np.eye(k) + np.array(row.xx, float).reshape(k, k))
                x = np.array(row.at, float)
                fits = row.n >= max(least, k + 1)
                bonus = alpha * (np.sqrt(max(x @ inverse @ x, 0.0)) if fits else 1 / np.sqrt(row.n + 1.0))
                out.append((*(getattr(row, c) for c in keys), row.n, row.mean, float(x @ inverse @ np.array(row.xy, float)) if fits else None, float(bonus)))
            yield pd.DataFrame(out, columns=[*keys, "n", "mean", "prediction", "bonus"])

    said = met.mapInPandas(solve, ", ".join(f"{c} {types[c]}" for c in keys) + ", n long, mean double, prediction double, bonus double")
    said = said.join(F.broadcast(priors), keys, "left") if priors is not None else said.withColumn("prior", F.lit(0.0))  # a fixed table
    said = said.withColumn("prior", F.coalesce("prior", F.lit(0.0))).withColumn("score", F.coalesce("prediction", "mean", F.lit(0.0)) + F.col("bonus") + F.col("prior"))
    first = F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), *keys)) == 1  # one row a combination
    return said.withColumn("recommended", first)


def reward_matrix(log: DataFrame, row: str, column: str, names: list[str], reward: str = "reward") -> DataFrame:
    """Mean reward of each ``row`` by the given values of ``column``."""
    return log.groupBy(row).pivot(column, names).agg(F.avg(reward))
