"""Spectrum of a covariance matrix of very many series over a bounded window of days.

With N series over T days, the T by T matrix of the days' products has the same
eigenvalues as the N by N covariance, but for zeros. Tasks sum the products of the
series they hold; only rows of a T by T matrix are shuffled, and one task solves it.
T is bounded by the window, N by nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_EIGENVALUE = 1e-12
MOST_DAYS = 756


def centred_window(df: DataFrame, entity: str = "entity", ts: str = "date", value: str = "r", window: int = 252) -> tuple[DataFrame, int]:
    """``entity, xs`` over the last ``window`` days of the table (at most ``MOST_DAYS``), gaps as zero, less their mean; and the number of days."""
    if not 1 < window <= MOST_DAYS:
        raise ValueError(f"a window of 2 to {MOST_DAYS} days")
    days = sorted(r[0] for r in df.where(F.col(value).isNotNull()).select(ts).distinct().orderBy(F.col(ts).desc()).limit(window).collect())
    spark, t = df.sparkSession, len(days)
    at = spark.createDataFrame([(d, i) for i, d in enumerate(days)], f"{ts} {dict(df.dtypes)[ts]}, _i int")
    own = df.where(F.col(value).isNotNull() & ~F.isnan(value)).join(F.broadcast(at), ts)  # a row a day of the window
    held = own.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("_i", value))).alias("m"))
    xs = F.transform(F.sequence(F.lit(0), F.lit(max(t - 1, 0))), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    mean = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x) / F.lit(float(max(t, 1)))
    return held.select(entity, xs.alias("xs")).select(entity, F.transform("xs", lambda x: x - mean).alias("xs")), t


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def _products(days: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros((days, days)), 0
        for batch in batches:
            x = _matrix(batch.column("xs"), days)
            total += x.T @ x
            many += len(x)
        if many:
            ids = pa.array(np.arange(days), pa.int32())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(days + 1) * days, pa.int32()), pa.array(total.ravel()))
            yield pa.record_batch([ids, rows, pa.array(np.full(days, many), pa.int64())], names=["i", "row", "many"])

    return run


_MODES = "k int, eigenvalue double, series long, days int, mode array<double>"


def modes(xs: DataFrame, days: int) -> DataFrame:
    """``k, eigenvalue, series, days, mode``: the eigenvalues of the series' sample covariance that can differ from zero, largest first, with the unit vectors over the days that belong to them."""
    sums = xs.select("xs").mapInArrow(_products(days), "i int, row array<double>, many long")
    row = F.array(*[F.sum(F.col("row")[j]) for j in range(days)]) if days <= 64 else None
    if row is not None:
        gram = sums.groupBy("i").agg(row.alias("row"), F.sum("many").alias("many"))
    else:
        # wide rows: added up by element, long form
        cells = sums.select("i", "many", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("many").alias("many"))
        gram = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("row"), F.max("many").alias("many"))

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        g, n = _matrix(table.column("row").combine_chunks(), days), int(table.column("many")[0].as_py())
        values, vectors = np.linalg.eigh((g + g.T) / 2 / max(days - 1, 1))
        order = np.argsort(-values, kind="stable")[: min(n, days)]
        return pa.table({"k": pa.array(np.arange(1, len(order) + 1), pa.int32()), "eigenvalue": values[order], "series": pa.array([n] * len(order), pa.int64()), "days": pa.array([days] * len(order), pa.int32()), "mode": pa.array(vectors[:, order].T.tolist(), pa.list_(pa.float64()))})

    # one group of as many rows as the window has days
    return gram.groupBy(F.lit(0).alias("all")).applyInArrow(solve, _MODES)


def spectrum(found: DataFrame) -> DataFrame:
    """``modes`` with ``noise`` (at most the edge), ``edge``, ``noise_fraction``, ``signal_modes`` and ``effective_rank``.

    The edge is the median of all eigenvalues, those that must be zero counted as the
    least one, times (1 + sqrt(N / T)) squared; the rank is the exponential of the
    entropy of the eigenvalues' shares.
    """
    x = found.withColumn("eigenvalue", F.greatest("eigenvalue", F.lit(LEAST_EIGENVALUE)))
    own = x.agg(F.sort_array(F.collect_list("eigenvalue")).alias("values"), F.max("series").alias("n"), F.max("days").alias("t"))  # a window's eigenvalues
    zeros = F.col("n") - F.size("values")
    # ascending places of the middle ones, with the zeros first
    middle = [F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)]
    at = [F.when(m < zeros, F.lit(LEAST_EIGENVALUE)).otherwise(F.get("values", (m - zeros).cast("int"))) for m in middle]
    edge = (at[0] + at[1]) / 2 * F.pow(1 + F.sqrt(F.col("n") / F.col("t")), 2)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v) + zeros * LEAST_EIGENVALUE

    def part(v):
        return -(v / F.col("total")) * F.log(v / F.col("total"))

    entropy = F.aggregate("values", F.lit(0.0), lambda a, v: a + part(v)) + zeros * part(F.lit(LEAST_EIGENVALUE))
    signal = F.size(F.filter("values", lambda v: v > F.col("edge")))
    said = own.withColumn("total", total).withColumn("edge", edge).withColumn("signal_modes", signal.cast("long"))
    said = said.select("edge", "signal_modes", (1 - F.col("signal_modes") / F.col("n")).alias("noise_fraction"), F.exp(entropy).alias("effective_rank"), "total")
    return x.crossJoin(F.broadcast(said)).withColumn("noise", F.col("eigenvalue") <= F.col("edge"))  # one row


def cleaned_variances(xs: DataFrame, days: int, told: DataFrame, entity: str = "entity") -> DataFrame:
    """``entity, variance, cleaned``: each series' sample variance, and its variance where all noisy eigenvalues are their mean.

    What is kept of a series is its loadings on the signal modes, so nothing of the size N by N arises.
    """
    signal = told.where("not noise").agg(F.array_sort(F.collect_list(F.struct("k", "eigenvalue", "mode"))).alias("signal"))
    # the sum of all eigenvalues is known, so the noisy ones' mean follows from the signal's
    rest = told.agg((F.max("total") - F.coalesce(F.sum(F.when(~F.col("noise"), F.col("eigenvalue"))), F.lit(0.0))).alias("left"), (F.max("series") - F.max("signal_modes")).alias("noisy"))
    met = xs.crossJoin(F.broadcast(signal)).crossJoin(F.broadcast(rest))  # one row each, at most a window's modes

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    squared = F.transform("signal", lambda m: F.struct((F.pow(dot(F.col("xs"), m["mode"]), 2) / (m["eigenvalue"] * (days - 1))).alias("load"), m["eigenvalue"].alias("value")))
    met = met.withColumn("loads", squared).withColumn("noise", F.coalesce(F.try_divide("left", "noisy"), F.lit(0.0)))
    cleaned = F.aggregate("loads", F.lit(0.0), lambda a, m: a + m["load"] * (m["value"] - F.col("noise"))) + F.col("noise")
    return met.select(entity, (dot(F.col("xs"), F.col("xs")) / (days - 1)).alias("variance"), cleaned.alias("cleaned"))
