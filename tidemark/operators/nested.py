"""Nested walk-forward selection: train, purge, validation, embargo, test, and a holdout judged once.

Every window picks the candidate with the best robust score of train and validation; the
picked candidates' test days make one path. The candidate picked most often is frozen and
judged on the holdout, which no selection has seen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X

FEWEST = 20


@dataclass(frozen=True)
class Schedule:
    """Lengths in days; at most a few years, so a part's rows are a bounded array."""

    train: int = 504
    purge: int = 21
    validation: int = 126
    embargo: int = 5
    test: int = 42
    holdout: int = 252

    @property
    def first_test(self) -> int:
        return self.train + self.purge + self.validation + self.embargo


def complete_days(df: DataFrame, candidate: str, ts: str, value: str) -> DataFrame:
    """``ts, pos``: the days on which all candidates have a value, numbered from 0; one row a day."""
    n = df.select(candidate).distinct().agg(F.count("*").alias("_all"))
    full = df.where(F.col(value).isNotNull()).groupBy(ts).agg(F.count("*").alias("_k")).crossJoin(F.broadcast(n)).where("_k = _all")  # one row
    return full.select(ts, (F.row_number().over(W.orderBy(ts)) - 1).alias("pos"))


def window_parts(days: DataFrame, s: Schedule, ts: str = "date") -> DataFrame:
    """``window, part, ts, pos``: the days of each window's train, validation and test; windows step by the test's length up to the holdout, and the last test may be short.

    Without as many days as one whole window and the holdout there are no windows.
    """
    n = days.agg(F.count("*").alias("_n")).where(F.col("_n") >= s.first_test + s.test + s.holdout)
    starts = n.select("_n", F.explode(F.sequence(F.lit(s.first_test).cast("long"), F.col("_n") - s.holdout - 1, F.lit(s.test).cast("long"))).alias("_at"))
    edges = {
        "train": (-s.first_test, -s.first_test + s.train),
        "validation": (-s.embargo - s.validation, -s.embargo),
        "test": (0, s.test),
    }
    parts = F.array(*[F.struct(F.lit(k).alias("part"), (F.col("_at") + a).alias("low"), F.least(F.col("_at") + b, F.col("_n") - s.holdout).alias("high")) for k, (a, b) in edges.items()])
    numbered = starts.withColumn("window", ((F.col("_at") - s.first_test) / s.test).cast("int")).select("window", F.explode(parts).alias("p"))
    each = numbered.select("window", "p.part", F.explode(F.sequence(F.col("p.low"), F.col("p.high") - 1)).alias("pos"))
    return each.join(days, "pos").select("window", "part", ts, "pos")


def performance(df: DataFrame, keys: list[str], ts: str = "date", value: str = "r", bench: str = "rb") -> DataFrame:
    """Annual return, downside deviation, worst drawdown, mean of the worst 5 per cent, and captures of each group against its benchmark; groups of fewer than 20 days have none."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("r"), F.col(bench).alias("b"))))
    year = F.sqrt(F.lit(252.0))
    down = F.pow(F.least(F.col(value), F.lit(0.0)), 2)
    up, low = F.col(bench) > 0, F.col(bench) < 0

    def capture(days: Column) -> Column:
        base = F.avg(F.when(days, F.col(bench)))
        return F.when(F.abs(base) > 1e-12, F.avg(F.when(days, F.col(value))) / base)

    annual = F.exp(F.sum(F.log1p(value)) * 252.0 / F.count("*")) - 1
    g = df.groupBy(*keys).agg(
        F.count("*").alias("days"), annual.alias("annual_return"), (F.exp(F.sum(F.log1p(bench)) * 252.0 / F.count("*")) - 1).alias("bench_return"), (F.sqrt(F.avg(down)) * year).alias("downside"),
        capture(up).alias("upside_capture"), capture(low).alias("downside_capture"), F.percentile(value, 0.05).alias("_q"), rows.alias("_rows"),
    )
    zero = F.struct(F.lit(1.0).alias("nav"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(a: Column, x: Column) -> Column:
        nav = a["nav"] * (1 + x["r"])
        peak = F.greatest(a["peak"], nav)
        return F.struct(nav.alias("nav"), peak.alias("peak"), F.least(a["worst"], nav / peak - 1).alias("worst"))

    tail = F.filter("_rows.r", lambda r: F.round(r, 12) <= F.round(F.col("_q"), 12))
    g = g.withColumn("max_drawdown", F.aggregate("_rows", zero, step, lambda a: a["worst"]))
    g = g.withColumn("cvar", F.aggregate(tail, F.lit(0.0), lambda a, r: a + r) / F.size(tail)).drop("_rows", "_q")
    return g.where(F.col("days") >= FEWEST)


def utility(own: str = "own", bench: str = "bench") -> Column:
    """Active return and captures, less what downside, tail and drawdown exceed the benchmark's by."""

    def x(side: str, c: str) -> Column:
        return F.col(f"{side}.{c}")

    def more(c: str) -> Column:
        return F.greatest(F.abs(x(own, c)) - F.abs(x(bench, c)), F.lit(0.0))

    active = x(own, "annual_return") - x(bench, "annual_return")
    captured = 0.1 * (x(own, "upside_capture") - 1) - 0.1 * F.greatest(x(own, "downside_capture") - 1, F.lit(0.0))
    return active + captured - more("downside") - 2 * F.sqrt(F.lit(252.0)) * more("cvar") - 0.5 * more("max_drawdown")


@dataclass(frozen=True)
class Selection:
    """``scores``: window, candidate and utilities; ``windows``: a row for each window with its pick; ``path``: the picked test days; ``stability``: picks by candidate, the first frozen."""

    scores: DataFrame
    windows: DataFrame
    path: DataFrame
    stability: DataFrame
    holdout: DataFrame


def nested_selection(df: DataFrame, schedule: Schedule, candidate: str = "entity", ts: str = "date", value: str = "r", bench: str = "rb") -> Selection:
    """Selection over long ``candidate, ts, value, bench`` rows.

    The robust score is the validation's utility less a quarter of its distance from the
    train's; ties in 9 digits go to the smaller candidate. A candidate without a score in a window is
    not picked there; the frozen one has most picks, then the best mean utility, then the smaller name.
    """
    days = complete_days(df, candidate, ts, value)
    parts = window_parts(days, schedule, ts)
    rows = df.select(candidate, ts, value, bench).join(parts, ts)
    keys = ["window", "part"]
    stats = performance(rows, [*keys, candidate], ts, value, bench)
    one = rows.select(*keys, ts, bench).distinct()
    base = performance(one.withColumn("_b", F.col(bench)), keys, ts, "_b", bench)
    names = [c for c in base.columns if c not in keys]
    both = stats.select(*keys, candidate, F.struct(*names).alias("own")).join(base.select(*keys, F.struct(*names).alias("bench")), keys)
    active = F.col("own.annual_return") - F.col("bench.annual_return")
    judged = both.withColumn("_u", utility()).groupBy("window", candidate).agg(
        *[F.max(F.when(F.col("part") == p, F.col("_u"))).alias(f"{p}_utility") for p in ("train", "validation")], F.max(F.when(F.col("part") == "test", active)).alias("test_active")
    )
    judged = judged.withColumn("robust", F.col("validation_utility") - 0.25 * F.abs(F.col("validation_utility") - F.col("train_utility")))
    best = judged.where(F.col("robust").isNotNull()).groupBy("window").agg(F.min_by(F.struct(candidate, "train_utility", "validation_utility", "robust", "test_active"), F.struct(-F.round("robust", 9), F.col(candidate))).alias("b")).select("window", "b.*")
    edges = parts.groupBy("window").agg(*[f(F.when(F.col("part") == p, F.col(ts))).alias(f"{p}_{e}") for p in ("train", "validation", "test") for e, f in (("start", F.min), ("end", F.max))])
    windows = best.join(edges, "window")
    path = rows.where("part = 'test'").join(best.select("window", candidate), ["window", candidate]).select("window", candidate, ts, value, bench)
    many = best.agg(F.count("*").alias("_windows"))
    stability = judged.groupBy(candidate).agg(F.avg("validation_utility").alias("mean_utility"), F.stddev_samp("validation_utility").alias("utility_sd"))
    stability = stability.join(best.groupBy(candidate).agg(F.count("*").alias("picked")), candidate, "left").fillna(0, ["picked"]).crossJoin(F.broadcast(many))  # one row
    order = W.orderBy(F.desc("picked"), F.desc_nulls_last(F.round("mean_utility", 9)), candidate)  # one row a candidate
    stability = stability.select(candidate, "picked", X.ratio(F.col("picked").cast("double"), F.col("_windows").cast("double")).alias("rate"), "mean_utility", "utility_sd", (F.row_number().over(order) == 1).alias("frozen"))
    last = days.agg((F.max("pos") + 1 - schedule.holdout).alias("_from"))
    kept = days.crossJoin(F.broadcast(last)).where("pos >= _from").select(ts)  # one row
    holdout = df.select(candidate, ts, value, bench).join(kept, ts).join(F.broadcast(stability.where("frozen and picked > 0").select(candidate)), candidate)  # one row
    return Selection(judged, windows, path, stability, holdout)
