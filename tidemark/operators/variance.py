"""Architectures of conditional variance: likelihoods over a parameter grid, paths and cones.

Every architecture with a recursion is one fold with two lags of squared residuals and two
of the variance; those with fewer lags have zeros in the grid. A series is its last
``window`` rows, so an array is bounded whatever the history.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW, LEAST = 756, 80
TWO_PI = 6.283185307179586
FLOOR = 1e-12

#: (a1, a2, b1, b2) by architecture; the constant is what leaves the sample variance unchanged.
GRID: dict[str, list[tuple[float, float, float, float]]] = {
    "CONST": [(0.0, 0.0, 0.0, 0.0)],
    "ARCH1": [(a, 0.0, 0.0, 0.0) for a in (0.02, 0.05, 0.1, 0.2, 0.3, 0.45)],
    "ARCH2": [(a, b, 0.0, 0.0) for a in (0.02, 0.05, 0.12, 0.25) for b in (0.02, 0.08, 0.2)],
    "GARCH11": [(a, 0.0, b, 0.0) for a in (0.02, 0.05, 0.1, 0.2) for b in (0.5, 0.7, 0.79)],
    "GARCH12": [(a, 0.0, b, c) for a in (0.02, 0.05, 0.1) for b in (0.3, 0.5, 0.7) for c in (0.05, 0.15)],
    "GARCH21": [(a, c, b, 0.0) for a in (0.02, 0.04, 0.08) for c in (0.02, 0.06) for b in (0.5, 0.7, 0.8)],
}
DEGREES = (4.0, 8.0, 20.0)
#: Exponents and lengths of the power-law kernel: the weight of lag j is j ** (hurst - 0.5).
HURST, LENGTHS = (0.05, 0.1, 0.2, 0.35, 0.45), (21, 63, 126)


def grid_rows() -> list[tuple]:
    """``model, a1, a2, b1, b2, nu, shift, k``: ``shift`` is the constant of the density's logarithm, ``k`` counts the constant, the coefficients and the mean."""
    rows = []
    for model, points in GRID.items():
        k = 2 + (0 if model == "CONST" else sum(any(p[i] for p in points) for i in range(4)))
        rows += [(model, *p, None, -0.5 * math.log(TWO_PI), k) for p in points]
    for nu in DEGREES:
        shift = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)
        rows += [("T_GARCH11", *p, nu, shift, 5) for p in GRID["GARCH11"]]
    return rows


def kernel_rows() -> list[tuple]:
    """``hurst, length, least, kernel, sums``: weights by lag, and their running sums."""
    out = []
    for hurst in HURST:
        for length in LENGTHS:
            kernel = [j ** (hurst - 0.5) for j in range(1, length + 1)]
            sums = [sum(kernel[: j + 1]) for j in range(length)]
            out.append((hurst, length, max(10, min(20, length // 2)), kernel, sums))
    return out


def residuals(df: DataFrame, entity: str = "entity", ts: str = "date", value: str = "r", window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """``entity, n, dates, xs, ys, var0`` of the last ``window`` rows: values, values less their mean, and population variance; series of fewer than ``least`` rows or without variance go."""
    newest = W.partitionBy(entity).orderBy(F.col(ts).desc())
    last = df.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= window)
    rows = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("x"))))
    s = last.groupBy(entity).agg(rows.alias("rows"), F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var0")).where((F.col("n") >= least) & (F.col("var0") > 0))
    return s.select(entity, "n", F.col("rows.t").alias("dates"), F.col("rows.x").alias("xs"), F.transform("rows.x", lambda x: x - F.col("mean")).alias("ys"), "var0")


def _next(a: Column, var0: Column, a1: Column, a2: Column, b1: Column, b2: Column, e: Column) -> Column:
    return var0 * (1 - a1 - a2 - b1 - b2) + a1 * e + a2 * a["e"] + b1 * a["h"] + b2 * a["g"]


def recursions(series: DataFrame, entity: str = "entity") -> DataFrame:
    """Every series under every row of the grid: ``ll, qlike, last, ahead`` (the variance of the last row and of the next) and the state that goes on from there."""
    grid = series.sparkSession.createDataFrame(grid_rows(), "model string, a1 double, a2 double, b1 double, b2 double, nu double, shift double, k int")
    s = series.crossJoin(F.broadcast(grid))  # a fixed grid
    var0, ps = F.col("var0"), [F.col(c) for c in ("a1", "a2", "b1", "b2")]
    # h: this row's variance; g: the one before; e: the square before
    zero = F.struct(var0.alias("h"), var0.alias("g"), var0.alias("e"), F.lit(0.0).alias("last"), F.lit(0.0).alias("ll"), F.lit(0.0).alias("q"))

    def step(a: Column, y: Column) -> Column:
        e = y * y
        ratio = e / a["h"]
        tail = F.when(F.col("nu").isNull(), ratio).otherwise((F.col("nu") + 1) * F.log1p(ratio / F.col("nu")))
        ll = a["ll"] + F.col("shift") - 0.5 * (F.log(a["h"]) + tail)
        return F.struct(_next(a, var0, *ps, e).alias("h"), a["h"].alias("g"), e.alias("e"), a["h"].alias("last"), ll.alias("ll"), (a["q"] + ratio + F.log(a["h"])).alias("q"))

    out = s.withColumn("a", F.aggregate("ys", zero, step))
    return out.select(entity, "model", "a1", "a2", "b1", "b2", "nu", "n", F.col("k").cast("long").alias("k"), F.col("a.ll").alias("ll"), (F.col("a.q") / F.col("n")).alias("qlike"), F.col("a.last").alias("last"), F.col("a.h").alias("ahead"))


def _kernel_variance(t: Column, squares: Column) -> Column:
    """The power-law variance of row ``t`` (from 0) from the squares before it, as far as the kernel reaches."""
    m = F.least(F.col("length"), t)
    return F.greatest(F.aggregate(F.sequence(F.lit(1), m), F.lit(0.0), lambda a, j: a + F.get(squares, t - j) * F.get("kernel", j - 1)) / F.get("sums", m - 1), F.lit(FLOOR))


def power_laws(series: DataFrame, entity: str = "entity") -> DataFrame:
    """Every series under every power-law kernel, over the rows that have enough squares before them; the columns of ``recursions``."""
    kernels = series.sparkSession.createDataFrame(kernel_rows(), "hurst double, length int, least int, kernel array<double>, sums array<double>")
    s = series.crossJoin(F.broadcast(kernels)).where("length < n - 5 and n - least >= 40")  # a fixed grid
    s = s.withColumn("squares", F.transform("xs", lambda x: x * x)).withColumn("m", (F.col("n") - F.col("least")).cast("int"))
    s = s.withColumn("hs", F.transform(F.sequence(F.col("least"), (F.col("n") - 1).cast("int")), lambda t: _kernel_variance(t, F.col("squares"))))
    s = s.withColumn("tail", F.slice("xs", F.col("least") + 1, F.col("m")))
    mean = F.aggregate("tail", F.lit(0.0), lambda a, x: a + x) / F.col("m")
    terms = F.zip_with("tail", "hs", lambda x, h: F.struct(x.alias("x"), h.alias("h")))
    zero = F.struct(F.lit(0.0).alias("ll"), F.lit(0.0).alias("q"))

    def step(a: Column, p: Column) -> Column:
        y = p["x"] - F.col("mean")
        return F.struct((a["ll"] - 0.5 * (math.log(TWO_PI) + F.log(p["h"]) + y * y / p["h"])).alias("ll"), (a["q"] + p["x"] * p["x"] / p["h"] + F.log(p["h"])).alias("q"))

    s = s.withColumn("mean", mean).withColumn("a", F.aggregate(terms, zero, step))
    none = F.lit(0.0)
    return s.select(
        entity, F.lit("POWER_LAW").alias("model"), F.col("hurst").alias("a1"), F.col("length").cast("double").alias("a2"), none.alias("b1"), none.alias("b2"), F.lit(None).cast("double").alias("nu"), F.col("m").cast("long").alias("n"),
        F.lit(3).cast("long").alias("k"), F.col("a.ll").alias("ll"), (F.col("a.q") / F.col("m")).alias("qlike"), F.element_at("hs", -1).alias("last"), _kernel_variance(F.size("xs"), F.col("squares")).alias("ahead"),
    )


def architectures(df: DataFrame, entity: str = "entity", ts: str = "date", value: str = "r", window: int = WINDOW) -> DataFrame:
    """The likeliest point of each architecture for each series, with AIC, BIC and QLIKE and what is best by each; ties in 6 digits are all best.

    ``a1, a2`` of POWER_LAW are its exponent and length. Within an architecture points are
    compared by likelihood, power laws by BIC, as their rows differ in number; ties go to
    the smaller parameters.
    """
    s = residuals(df, entity, ts, value, window)
    every = recursions(s, entity).union(power_laws(s, entity))
    every = every.withColumn("aic", 2 * F.col("k") - 2 * F.col("ll")).withColumn("bic", F.col("k") * F.log(F.col("n").cast("double")) - 2 * F.col("ll"))
    kept = [c for c in every.columns if c not in (entity, "model")]
    key = F.struct(F.round("bic", 6), "a1", "a2", "b1", "b2", F.coalesce("nu", F.lit(0.0)))
    chosen = every.groupBy(entity, "model").agg(F.min_by(F.struct(*kept), key).alias("b")).select(entity, "model", "b.*")
    whole = W.partitionBy(entity)
    for c in ("aic", "bic", "qlike"):
        chosen = chosen.withColumn(f"best_{c}", F.round(c, 6) == F.min(F.round(c, 6)).over(whole))
    return chosen


def conditional_path(df: DataFrame, chosen: DataFrame, entity: str = "entity", ts: str = "date", value: str = "r", window: int = WINDOW) -> DataFrame:
    """``entity, date, variance, daily_vol, annual_vol, price_index, upper, lower`` of each series under its row of ``chosen`` (any recursion; POWER_LAW rows have none)."""
    s = residuals(df, entity, ts, value, window).join(chosen.where("model <> 'POWER_LAW'").select(entity, "model", "a1", "a2", "b1", "b2"), entity)
    var0, ps = F.col("var0"), [F.col(c) for c in ("a1", "a2", "b1", "b2")]
    zero = F.struct(var0.alias("h"), var0.alias("g"), var0.alias("e"), F.lit(100.0).alias("p"), F.array().cast("array<struct<h: double, p: double>>").alias("path"))

    def step(a: Column, row: Column) -> Column:
        e, price = row["y"] * row["y"], a["p"] * (1 + row["x"])
        path = F.concat(a["path"], F.array(F.struct(F.greatest(a["h"], F.lit(FLOOR)).alias("h"), price.alias("p"))))
        return F.struct(_next(a, var0, *ps, e).alias("h"), a["h"].alias("g"), e.alias("e"), price.alias("p"), path.alias("path"))

    rows = F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    s = s.withColumn("path", F.aggregate(rows, zero, step, lambda a: a["path"]))
    each = s.select(entity, "model", F.posexplode(F.arrays_zip("dates", "path")).alias("_at", "_row")).select(entity, "model", F.col("_row.dates").alias(ts), F.col("_row.path.h").alias("variance"), F.col("_row.path.p").alias("price_index"))
    vol = F.sqrt("variance")
    return each.withColumn("daily_vol", vol).withColumn("annual_vol", vol * math.sqrt(252.0)).withColumn("upper", F.col("price_index") * (1 + vol)).withColumn("lower", F.col("price_index") * (1 - vol))


def architecture_cone(df: DataFrame, chosen: DataFrame, horizon: int, entity: str = "entity", ts: str = "date", value: str = "r", window: int = WINDOW) -> DataFrame:
    """``entity, h, variance, low, high`` ahead: expected variances by the recursion, and the price index within 1.96 deviations of the variance summed up to then."""
    s = residuals(df, entity, ts, value, window).join(chosen.where("model <> 'POWER_LAW'").select(entity, "model", "a1", "a2", "b1", "b2", "last", "ahead"), entity)
    price = F.aggregate("xs", F.lit(100.0), lambda a, x: a * (1 + x))
    # an expected square is the variance; the last square is known
    square = F.pow(F.element_at("ys", -1), 2)
    zero = F.struct(F.col("ahead").alias("h"), F.col("last").alias("g"), square.alias("e"), F.lit(0.0).alias("sum"), F.array().cast("array<struct<h: double, sum: double>>").alias("path"))
    ps = [F.col(c) for c in ("a1", "a2", "b1", "b2")]

    def step(a: Column, _: Column) -> Column:
        total = a["sum"] + a["h"]
        return F.struct(_next(a, F.col("var0"), *ps, a["h"]).alias("h"), a["h"].alias("g"), a["h"].alias("e"), total.alias("sum"), F.concat(a["path"], F.array(F.struct(a["h"].alias("h"), total.alias("sum")))).alias("path"))

    s = s.withColumn("price", price).withColumn("path", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), zero, step, lambda a: a["path"]))
    each = s.select(entity, "model", "price", F.posexplode("path").alias("_at", "_row"))
    band = 1.96 * F.sqrt("_row.sum")
    return each.select(entity, "model", (F.col("_at") + 1).cast("int").alias("h"), F.col("_row.h").alias("variance"), (F.col("price") * (1 - band)).alias("low"), (F.col("price") * (1 + band)).alias("high"))
