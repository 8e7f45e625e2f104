"""Change points of mean and variance by binary splitting to the end, with regimes and kinds of change.

A segment is one row of a small table. In a round every open segment meets the prefix
sums of its series (arrays of at most ``window`` rows), takes its best cut if the gain
passes the penalty, and becomes two open ones; else it is done. Rounds end when none is open.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.files import cut

WINDOW, LEAST, FEWEST = 756, 21, 60
FLOOR = 1e-12
#: Ratios of annual volatility beyond which a change is one of variance.
UP, DOWN = 1.25, 0.8


def _cost(m: Column, s1: Column, s2: Column) -> Column:
    """Rows times one more than the logarithm of their variance."""
    return m * (F.log(F.greatest((s2 - s1 * s1 / m) / m, F.lit(FLOOR))) + 1)


def _series(df: DataFrame, entity: str, ts: str, value: str, window: int, least: int) -> DataFrame:
    """``entity, n, dates, xs, s1, s2``: the last ``window`` rows and their prefix sums, which begin with zero."""
    own = W.partitionBy(entity)
    last = df.where(F.col(value).isNotNull() & ~F.isnan(value)).withColumn("_k", F.row_number().over(own.orderBy(F.col(ts).desc()))).where(F.col("_k") <= window)
    run = own.orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    last = last.select(entity, F.struct(F.col(ts).alias("t"), F.col(value).alias("x"), F.sum(value).over(run).alias("s1"), F.sum(F.col(value) * F.col(value)).over(run).alias("s2")).alias("row"))
    s = last.groupBy(entity).agg(F.array_sort(F.collect_list("row")).alias("rows"), F.count("*").cast("int").alias("n")).where(F.col("n") >= max(3 * least, FEWEST))
    zero = F.array(F.lit(0.0))
    return s.select(entity, "n", F.col("rows.t").alias("dates"), F.col("rows.x").alias("xs"), F.concat(zero, "rows.s1").alias("s1"), F.concat(zero, "rows.s2").alias("s2"))


def segment_bounds(df: DataFrame, entity: str = "entity", ts: str = "date", value: str = "r", window: int = WINDOW, least: int = LEAST, penalty: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``entity, a, b`` of all segments (rows a up to b of the series, b not in it), and the series.

    A cut gains what it takes off the cost; it is made while that is more than ``penalty``, by
    default three times the logarithm of the series' rows. Of equal gains (6 digits) the first cut is taken.
    """
    series = cut(_series(df, entity, ts, value, window, least))
    state = series.select(entity, F.lit(0).alias("a"), F.col("n").alias("b"), F.lit(True).alias("open"))
    deny = F.lit(float(penalty)) if penalty is not None else 3 * F.log(F.col("n").cast("double"))

    def sums(i: Column, j: Column, s: str) -> Column:
        return F.get(s, j) - F.get(s, i)

    def gain(i: Column) -> Column:
        a, b = F.col("a"), F.col("b")
        parts = [_cost((y - x).cast("double"), sums(x, y, "s1"), sums(x, y, "s2")) for x, y in ((a, b), (a, i), (i, b))]
        return parts[0] - parts[1] - parts[2]

    done = []
    for _ in range(window // least + 1):
        met = state.where("open").join(series.select(entity, "n", "s1", "s2"), entity)
        places = F.when(F.col("b") - F.col("a") >= 2 * least, F.sequence(F.col("a") + least, F.col("b") - least)).otherwise(F.array().cast("array<int>"))
        cuts = F.transform(places, lambda i: F.struct(F.round(gain(i), 6).alias("gain"), (-i).alias("i")))
        met = met.withColumn("best", F.array_max(F.filter(cuts, lambda c: c["gain"] > deny)))
        step = cut(met.select(entity, "a", "b", (-F.col("best.i")).alias("cut")))
        done.append(step.where("cut is null").select(entity, "a", "b"))
        two = F.explode(F.array(F.struct(F.col("a"), F.col("cut").alias("b")), F.struct(F.col("cut").alias("a"), F.col("b"))))
        state = step.where("cut is not null").select(entity, two.alias("s")).select(entity, "s.a", "s.b", F.lit(True).alias("open"))
        if state.isEmpty():
            break
    else:
        # a segment of 2 * least rows cannot be split further, so this is never reached
        raise RuntimeError("segments are still split after as many rounds as there can be")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out, series


def segments(df: DataFrame, entity: str = "entity", ts: str = "date", value: str = "r", window: int = WINDOW, least: int = LEAST, penalty: float | None = None) -> DataFrame:
    """A row for each segment: ``entity, segment, start, end, n, mean, annual_return, annual_vol, downside_vol, skew, kurtosis, total_return, max_drawdown, regime``.

    ``regime``: high variance and high drift from the median of the entity's segments on.
    Series of fewer rows than three segments, or than ``FEWEST``, have none.
    """
    bounds, series = segment_bounds(df, entity, ts, value, window, least, penalty)
    numbered = bounds.withColumn("segment", F.row_number().over(W.partitionBy(entity).orderBy("a")))  # a bounded number an entity
    met = numbered.join(series.select(entity, "dates", "xs"), entity)
    own = met.select(entity, "segment", F.posexplode(F.arrays_zip(F.slice("dates", F.col("a") + 1, F.col("b") - F.col("a")).alias("t"), F.slice("xs", F.col("a") + 1, F.col("b") - F.col("a")).alias("x"))).alias("i", "row")).select(entity, "segment", "i", "row.t", "row.x")
    run = W.partitionBy(entity, "segment").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    own = own.withColumn("up", F.sum(F.log1p("x")).over(run)).withColumn("peak", F.max("up").over(run))
    n, year = F.count("*").cast("double"), math.sqrt(252.0)
    m = F.avg("x")
    s2, s3, s4 = F.var_pop("x"), F.skewness("x"), F.kurtosis("x")
    stats = own.groupBy(entity, "segment").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n"), m.alias("mean"), (m * 252).alias("annual_return"), (F.stddev_samp("x") * year).alias("annual_vol"),
        (F.sqrt(F.coalesce(F.avg(F.when(F.col("x") < 0, F.col("x") * F.col("x"))), F.lit(0.0))) * year).alias("downside_vol"), F.when((n > 2) & (s2 > 0), s3 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when((n > 3) & (s2 > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * s4 + 6)).alias("kurtosis"), (F.exp(F.sum(F.log1p("x"))) - 1).alias("total_return"), (F.exp(F.min(F.col("up") - F.col("peak"))) - 1).alias("max_drawdown"),
    )
    own = W.partitionBy(entity)
    high = [F.round(c, 10) >= F.percentile(F.round(c, 10), 0.5).over(own) for c in ("annual_vol", "mean")]
    label = F.concat(F.when(high[0], "High variance").otherwise("Low variance"), F.lit(" / "), F.when(high[1], "High drift").otherwise("Low drift"))
    return stats.withColumn("regime", label)


def change_events(found: DataFrame, entity: str = "entity") -> DataFrame:
    """``entity, changed, segment, vol_before, vol_after, vol_ratio, mean_before, mean_after, kind`` between neighbouring rows of ``segments``."""
    order = W.partitionBy(entity).orderBy("segment")
    x = found.select(entity, F.col("start").alias("changed"), "segment", F.lag("annual_vol").over(order).alias("vol_before"), F.col("annual_vol").alias("vol_after"), F.lag("mean").over(order).alias("mean_before"), F.col("mean").alias("mean_after"))
    x = x.where("segment > 1").withColumn("vol_ratio", F.try_divide("vol_after", "vol_before"))
    kind = F.when(F.round("vol_ratio", 9) > UP, "Variance up").when(F.round("vol_ratio", 9) < DOWN, "Variance down").otherwise("Mean/variance shift")
    return x.withColumn("kind", kind)
