"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column, least: float = 0.0) -> Column:
    """a / b, null where either is null or |b| is at most ``least``."""
    return F.try_divide(col(a), F.when(F.abs(col(b)) > least, col(b)))


def clip(x: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; null stays null."""
    out = col(x)
    if low is not None:
        out = F.when(col(x).isNotNull(), F.greatest(out, F.lit(low)))
    if high is not None:
        out = F.when(col(x).isNotNull(), F.least(out, F.lit(high)))
    return out


def finite(x: str | Column) -> Column:
    """x with NaN and infinities as null."""
    return F.when(~F.isnan(col(x)) & (F.abs(col(x)) < F.lit(float("inf"))), col(x))


def by(entity: str | list[str], ts: str | list) -> WindowSpec:
    return W.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(*([ts] if isinstance(ts, str) else ts))


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling(agg, x: str | Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """``agg`` of x over the last ``n`` rows, null with fewer than ``least`` values (``n`` if not given)."""
    over = last_rows(w, n)
    return F.when(F.count(col(x)).over(over) >= (n if least is None else least), agg(col(x)).over(over))


def average_rank(x: str | Column, *groups: str) -> Column:
    """Rank from 1 with ties averaged, among the non-null values of the group."""
    part = W.partitionBy(*groups)
    ties = F.count(col(x)).over(W.partitionBy(*groups, col(x)))
    return F.when(col(x).isNotNull(), F.rank().over(part.orderBy(col(x).asc_nulls_last())) + (ties - 1) / 2)


def percent_of_rank(x: str | Column, *groups: str) -> Column:
    """Average-tie rank divided by the number of non-null values."""
    return average_rank(x, *groups) / F.count(col(x)).over(W.partitionBy(*groups))


def logistic(x: str | Column) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def softmax(x: str | Column, *groups: str, temperature: float = 1.0) -> Column:
    part = W.partitionBy(*groups)
    e = F.exp((col(x) - F.max(col(x)).over(part)) / temperature)
    return e / F.sum(e).over(part)


def sample_skewness(x: str | Column) -> Column:
    """Bias-corrected skewness, as an aggregate; null for fewer than 3 values or no spread."""
    n = F.count(col(x)).cast("double")
    return F.when((n > 2) & (F.var_pop(col(x)) > 0), F.skewness(col(x)) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def sample_kurtosis(x: str | Column) -> Column:
    """Bias-corrected excess kurtosis, as an aggregate; null for fewer than 4 values or no spread."""
    n = F.count(col(x)).cast("double")
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when((n > 3) & (F.var_pop(col(x)) > 0), scale * ((n + 1) * F.kurtosis(col(x)) + 6))


def draw(*parts: str | Column) -> Column:
    """A reproducible number in [0, 1) from the md5 of the parts joined by |."""
    text = F.concat_ws("|", *[col(p).cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def exp(x: str | Column) -> Column:
    """e to the x, with one Newton step: the last bit of Spark's own is wrong for one value in ten, which shows where a result is a tie of rounding."""
    e = F.exp(col(x))
    return F.coalesce(finite(e + e * (col(x) - F.ln(e))), e)


def round_scaled(x: str | Column, digits: int) -> Column:
    """x times a power of ten, rounded half away from zero and divided again, as SQL rounds doubles; ``F.round`` takes ties from the shortest decimal, so that a double just below one goes up."""
    scaled = F.abs(col(x)) * F.lit(10.0**digits)
    even = F.rint(scaled)
    return F.signum(col(x)) * F.when(scaled - even == 0.5, even + 1).otherwise(even) / F.lit(10.0**digits)


def rounded(df, digits: int = 6):
    """All doubles of a result rounded, as its SQL does too."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def with_group(df, keys: list[str], source=None, **aggregates: Column):
    """Each row with aggregates of its group (of all rows, without keys): map-side sums and a join, so no group meets in one task.

    ``source``: the rows that are aggregated, if not ``df``. Each call reads them once more, so take all aggregates of a group in one.
    """
    stats = (df if source is None else source).groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(*[v.alias(k) for k, v in aggregates.items()])
    if not keys:
        return df.crossJoin(F.broadcast(stats))  # one row
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return df.join(stats, same).drop(*[f"_key{i}" for i in range(len(keys))])
