"""As-of joins and other point-in-time joins.

An as-of join is a union of both sides and the last known right row in time order:
linear, one shuffle by key, and no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], left_ts: str, right_ts: str, direction: str = "backward", tolerance: int | None = None, prefix: str = "r_", slices: str | None = None) -> DataFrame:
    """``left`` with the right row last known at its time (``forward``: the next one, ``nearest``: the nearer, ties backward).

    Equal times match. ``tolerance``: most days between them. Rows of ``left`` without a
    match, with a null time or a null key stay, with nulls. Right columns get ``prefix``.
    Several right rows at one time: the largest struct of them counts. ``slices``: a unit of time
    (as ``month``) by which a key's rows are sorted apart, for a key that is hot or none at all; what
    is known at the end of a slice is carried on over one row for each key and slice.
    """
    if direction == "nearest":
        keyed = left.withColumn("_row", F.struct(*left.columns))
        both = asof_join(keyed, right, by=by, left_ts=left_ts, right_ts=right_ts, tolerance=tolerance, prefix="b_", slices=slices)
        both = asof_join(both, right, by=by, left_ts=left_ts, right_ts=right_ts, direction="forward", tolerance=tolerance, prefix="f_", slices=slices)
        back = F.col(f"b_{right_ts}").isNotNull() & (F.col(f"f_{right_ts}").isNull() | (F.date_diff(F.col(left_ts), F.col(f"b_{right_ts}")) <= F.date_diff(F.col(f"f_{right_ts}"), F.col(left_ts))))
        values = [c for c in right.columns if c not in by]
        return both.select(*left.columns, *[F.when(back, F.col(f"b_{c}")).otherwise(F.col(f"f_{c}")).alias(f"{prefix}{c}") for c in values])
    values = [c for c in right.columns if c not in by]
    own = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
    known = right.where(F.col(right_ts).isNotNull()).groupBy(*by, right_ts).agg(F.max(F.struct(*[c for c in values])).alias("_r"))
    other = known.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), "_r")
    keys = [f"_k{i}" for i in range(len(by))]
    back = direction == "backward"
    ordered = lambda c: F.col(c).asc_nulls_first() if back else F.col(c).desc_nulls_first()
    both = own.unionByName(other, allowMissingColumns=True)
    if slices is None:
        order = W.partitionBy(*keys).orderBy(ordered("_t"), "_side").rowsBetween(W.unboundedPreceding, 0)
        out = both.withColumn("_m", F.last("_r", ignorenulls=True).over(order))
    else:
        both = both.withColumn("_slice", F.date_trunc(slices, "_t"))
        at = F.when(F.col("_side") == 0, F.col("_t"))
        ends = both.groupBy(*keys, "_slice").agg((F.max_by if back else F.min_by)("_r", at).alias("_end"))
        before = W.partitionBy(*keys).orderBy(ordered("_slice")).rowsBetween(W.unboundedPreceding, -1)
        carried = ends.select(*keys, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_c"))
        order = W.partitionBy(*keys, "_slice").orderBy(ordered("_t"), "_side").rowsBetween(W.unboundedPreceding, 0)
        out = both.join(carried, [*keys, "_slice"], "left").withColumn("_m", F.coalesce(F.last("_r", ignorenulls=True).over(order), "_c"))
    out = out.where("_side = 1")
    good: Column = F.col("_t").isNotNull()
    for k in keys:
        good &= F.col(k).isNotNull()
    if tolerance is not None:
        good &= F.abs(F.date_diff(F.col(f"_m.{right_ts}"), F.col("_t"))) <= tolerance
    return out.select("_l.*", *[F.when(good, F.col(f"_m.{c}")).alias(f"{prefix}{c}") for c in values])


def latest_known(facts: DataFrame, as_of: Column, *, by: list[str], available: str, order: list[str]) -> DataFrame:
    """The row of each key known at ``as_of`` that is last in ``order``."""
    w = W.partitionBy(*by).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return facts.where(F.col(available) <= as_of).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def latest_known_at(facts: DataFrame, dates: DataFrame, *, by: list[str], available: str, order: list[str], date: str = "as_of") -> DataFrame:
    """``latest_known`` at each of many dates.

    Each fact is dealt to the first date it is known at, the best of a key and date is kept, and a
    running best carries it to the dates after: no fact meets a date twice.
    """
    own = facts.columns
    schedule = dates.agg(F.array_sort(F.collect_set(date)).alias("_dates"))  # one row: a schedule of dates
    met = facts.crossJoin(F.broadcast(schedule)).withColumn("_known", F.filter("_dates", lambda x: x >= F.col(available)))
    best = met.where(F.size("_known") > 0).groupBy(*by, F.col("_known")[0].alias(date)).agg(F.max(F.struct(F.struct(*order).alias("o"), F.struct(*own).alias("f"))).alias("_b"))
    starts = best.groupBy(*by).agg(F.min(date).alias("_from")).crossJoin(F.broadcast(schedule))
    grid = starts.select(*by, F.explode(F.filter("_dates", lambda x: x >= F.col("_from"))).alias(date))
    running = F.max("_b").over(W.partitionBy(*by).orderBy(date).rowsBetween(W.unboundedPreceding, 0))
    out = grid.unionByName(best, allowMissingColumns=True).groupBy(*by, date).agg(F.max("_b").alias("_b")).withColumn("_b", running)
    return out.select(*by, date, *[F.col(f"_b.f.{c}").alias(c) for c in own if c not in by])


def fill_from(a: DataFrame, b: DataFrame, fields: list[str], *, by: list[str], ts: str) -> DataFrame:
    """Missing fields of ``a`` from the last row of ``b`` known at its time, with the number filled."""
    out = asof_join(a, b.select(*by, ts, *fields), by=by, left_ts=ts, right_ts=ts, prefix="_b_")
    n = sum(((F.col(c).isNull()) & F.col(f"_b_{c}").isNotNull()).cast("int") for c in fields)
    return out.withColumn("filled", n).withColumns({c: F.coalesce(F.col(c), F.col(f"_b_{c}")) for c in fields}).select(*a.columns, "filled")


def prefer(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer join where the right value goes first."""
    r = right.select(*keys, F.col(value).alias("_v"))
    return left.select(*keys, value).join(r, keys, "full").select(*keys, F.coalesce("_v", value).alias(value))


def fill_sparse(a: DataFrame, b: DataFrame, entity: str, ts: str, value: str, least: int = 5) -> DataFrame:
    """``a``; entities with fewer than ``least`` values, and gaps, are taken from ``b``; with the source of each value."""
    few = a.groupBy(entity).agg((F.count(value) < least).alias("_few"))
    both = a.select(entity, ts, F.col(value).alias("_a")).join(b.select(entity, ts, F.col(value).alias("_b")), [entity, ts], "full").join(few, entity, "left")
    use_b = F.coalesce("_few", F.lit(True)) & F.col("_b").isNotNull()
    return both.select(entity, ts, F.when(use_b, F.col("_b")).otherwise(F.coalesce("_a", "_b")).alias(value), F.when(use_b | F.col("_a").isNull(), "secondary").otherwise("primary").alias("source"))


def reconcile(a: DataFrame, b: DataFrame, entity: str, ts: str, value: str, bound: float = 0.005, share: float = 0.01, least: int = 20) -> DataFrame:
    """By entity: overlap, share of relative differences over ``bound``, the largest, and whether to warn."""
    both = a.select(entity, ts, F.col(value).alias("_a")).join(b.select(entity, ts, F.col(value).alias("_b")), [entity, ts], "full")
    diff = F.abs(F.try_divide(F.col("_b") - F.col("_a"), F.col("_a")))
    out = both.groupBy(entity).agg(F.count(diff).alias("overlap"), F.avg((diff > bound).cast("double")).alias("share_over"), F.max(diff).alias("max_diff"), F.count(F.coalesce("_a", "_b")).alias("consensus_rows"))
    return out.withColumn("warn", (F.col("overlap") >= least) & (F.coalesce("share_over", F.lit(0.0)) > share))


def membership_at(current: DataFrame, changes: DataFrame, date: Column, *, key: str = "ticker") -> DataFrame:
    """The members at ``date``, from those of now and the log of changes (``added`` or ``removed`` on a day): the first change after the date is undone."""
    later = changes.where(F.col("day") > date).groupBy(key).agg(F.min_by("action", F.struct("day", "action")).alias("first"))
    kept = current.select(key).distinct().join(later.where("first = 'added'"), key, "left_anti")
    back = later.where("first = 'removed'").select(key)
    return kept.union(back).distinct()


def in_windows(rows: DataFrame, windows: DataFrame, ts: str = "date") -> DataFrame:
    """Rows inside each window (start, end], met by month so that no row meets a window far from it."""
    months = windows.withColumn("_m", F.explode(F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))))
    own = rows.withColumn("_m", F.trunc(ts, "month"))
    return own.join(months, "_m").where((F.col(ts) > F.col("start")) & (F.col(ts) <= F.col("end"))).drop("_m")


def combinations(items: DataFrame, k: int, group: str, most_of_group: int, key: str = "id", limit: int = 2_000_000) -> DataFrame:
    """Combinations of ``k`` (2 to 4) items in order of key, at most ``most_of_group`` of one group; refused beyond ``limit``."""
    from math import comb

    n = items.count()
    if comb(n, k) > limit:
        raise ValueError(f"{comb(n, k)} combinations of {n} items; choose fewer")
    base = items.select(F.col(key), F.col(group))
    out = base.select(F.array(key).alias("members"), F.array(group).alias("groups"), F.col(key).alias("_last"))
    for _ in range(k - 1):
        nxt = base.select(F.col(key).alias("_key"), F.col(group).alias("_group"))
        out = out.join(nxt, F.col("_key") > F.col("_last")).select(F.concat("members", F.array("_key")).alias("members"), F.concat("groups", F.array("_group")).alias("groups"), F.col("_key").alias("_last"))
        out = out.where(F.array_max(F.transform("groups", lambda g: F.size(F.filter("groups", lambda x: x == g)))) <= most_of_group)
    return out.select("members", "groups")
