"""Data quality: anomalies, freshness, frequency, duplicates and table gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def freshness(inventory: DataFrame, ttl: DataFrame, as_of: Column) -> DataFrame:
    """Per source: latest time, age in hours, and fresh, stale (within three times its limit) or expired."""
    last = inventory.groupBy("source").agg(F.max("ts").alias("latest"), F.count("*").alias("rows"))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("latest")) / 3600.0
    out = last.join(F.broadcast(ttl), "source", "left").withColumn("age_hours", age)  # a rule for each source
    limit = F.coalesce("ttl_hours", F.lit(24.0))
    return out.withColumn("status", F.when(F.col("age_hours") <= limit, "fresh").when(F.col("age_hours") <= limit * 3, "stale").otherwise("expired")).select("source", "latest", "rows", "age_hours", "status")


def frequency(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """Frequency by the median gap in days."""
    gap = F.date_diff(F.col(ts), F.lag(ts).over(W.partitionBy(entity).orderBy(ts)))
    out = df.select(entity, ts).distinct().withColumn("gap", gap).groupBy(entity).agg(F.median("gap").alias("median_gap"), F.count("*").alias("n"))
    g = F.col("median_gap")
    return out.withColumn("frequency", F.when(g.isNull(), "unknown").when(g <= 3, "daily").when(g <= 10, "weekly").when(g <= 45, "monthly").when(g <= 120, "quarterly").otherwise("annual"))


def duplicate_paths(df: DataFrame, key: str, ts: str, value: str, digits: int = 12) -> DataFrame:
    """Series equal at every point (to ``digits``): each gets the smallest key of its class. No pairs are made: series meet by their digest."""
    points = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(ts, F.round(value, digits).alias("v")))).alias("path"))
    digest = points.select(key, F.sha2(F.to_json(F.struct("path")), 256).alias("digest"), F.size("path").alias("n"))
    return digest.withColumn("canonical", F.min(key).over(W.partitionBy("digest"))).select(key, "n", "canonical")


def removed_not_listed(removed: DataFrame, listed: DataFrame, recoverable: DataFrame, key: str = "ticker") -> DataFrame:
    """Keys that were removed and are not listed now, with whether they can be recovered."""
    gone = removed.join(listed.select(key).distinct(), key, "left_anti")
    return gone.join(recoverable.select(key).distinct().withColumn("_yes", F.lit(True)), key, "left").select(*removed.columns, F.coalesce("_yes", F.lit(False)).alias("recoverable"))


def gate(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """``test, observed, threshold, direction, passed``: long metrics against a table of rules; a missing metric fails."""
    out = F.broadcast(rules).join(metrics, "test", "left")  # few rules
    passed = F.coalesce(F.when(F.col("direction") == "min", F.col("observed") >= F.col("threshold")).otherwise(F.col("observed") <= F.col("threshold")), F.lit(False))
    return out.withColumn("passed", passed)


def verdict(gated: DataFrame, *by: str) -> DataFrame:
    """Status, share passed and the failed tests in order."""
    out = gated.groupBy(*by).agg(F.bool_and("passed").alias("all"), F.avg(F.col("passed").cast("double")).alias("score"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("test")))).alias("failed"))
    return out.select(*by, F.when(F.col("all"), "pass").when(F.col("score") >= 0.5, "review").otherwise("fail").alias("status"), "score", F.array_join("failed", ";").alias("failed"))


def completeness(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """``module, cadence, checks, passed, score, status, missing``: how much of each module's evidence is there.

    ``counts``: ``part, n``; ``rules``: ``module, cadence, part, need``, a fixed table. A part that is not counted has nothing. Status is
    complete, partial or missing; ``missing`` lists the parts below their need with what they have.
    """
    own = counts.groupBy("part").agg(F.sum("n").alias("n"))
    x = F.broadcast(rules).join(own, "part", "left").withColumn("n", F.coalesce("n", F.lit(0)))  # a fixed table
    short = F.when(F.col("n") < F.col("need"), F.concat_ws(" ", "part", F.concat_ws("/", F.col("n").cast("string"), F.col("need").cast("string"))))
    g = x.groupBy("module", "cadence").agg(F.count("*").alias("checks"), F.count_if(F.col("n") >= F.col("need")).alias("passed"), F.array_join(F.array_sort(F.collect_list(short)), "; ").alias("missing"))
    score = F.col("passed") / F.col("checks")
    return g.select("module", "cadence", "checks", "passed", score.alias("score"), F.when(score >= 1, "complete").when(score > 0, "partial").otherwise("missing").alias("status"), "missing")


def promotion(metrics: DataFrame, rules: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """The tests of each candidate, and its status, score, number of valid tests and failed ones in order.

    ``metrics``: ``*by, test, observed``; ``rules``: ``test, threshold, direction``, a fixed table. ``higher``: above the threshold,
    ``lower``: below it, ``lower_abs``: within it whatever the sign. A missing metric is no valid test: a
    candidate without valid tests is on the watchlist, one with two or more and none failed is promoted,
    any other rejected.
    """
    wanted = metrics.select(*by).distinct().crossJoin(F.broadcast(rules))  # a table of rules
    seen = F.col("observed")
    value = F.round("observed", 9)
    passed = F.when(F.col("direction") == "higher", value > F.col("threshold")).when(F.col("direction") == "lower", value < F.col("threshold")).otherwise(F.abs(value) <= F.col("threshold"))
    tests = wanted.join(metrics, [*by, "test"], "left").withColumn("observed", F.when(~F.isnan(seen), seen)).withColumn("passed", F.coalesce(passed, F.lit(False)))
    valid = F.col("observed").isNotNull()
    g = tests.groupBy(*by).agg(F.count_if(valid).alias("valid"), F.avg(F.when(valid, F.col("passed").cast("double"))).alias("score"), F.array_join(F.array_sort(F.collect_list(F.when(valid & ~F.col("passed"), F.col("test")))), ";").alias("failed"))
    status = F.when(F.col("valid") == 0, "watchlist").when((F.col("failed") == "") & (F.col("valid") >= 2), "promoted").otherwise("rejected")
    return tests, g.select(*by, status.alias("status"), F.coalesce("score", F.lit(0.0)).alias("score"), "valid", "failed")


#: The share below which a universe is not mostly of its dominant group, and sectors that suit any sector mandate.
MOSTLY, BROAD = 0.5, ("Broad", "Technology/Growth")


def benchmark_governance(holdings: DataFrame, mandates: DataFrame, benchmarks: DataFrame, home: DataFrame) -> DataFrame:
    """A row for each portfolio: dominant country and sector with their shares, suggested benchmark, and what speaks against its own.

    ``holdings``: ``portfolio, country, sector``, a row a holding; ``mandates``: ``portfolio, mandate`` (country, sector,
    international or else), ``benchmark, benchmark_group, mandate_country, relative``; ``benchmarks``: ``benchmark, benchmark_scope,
    benchmark_country, benchmark_sector``; ``home``: ``kind`` (country or sector)``, name, suggested``. The last three are fixed
    tables. Of groups equally large the first by name is dominant; nulls are no group but count as holdings.
    """

    def dominant(c: str) -> DataFrame:
        n = holdings.groupBy("portfolio", c).agg(F.count("*").alias("n"))
        return n.groupBy("portfolio").agg(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(-F.col("n"), c))).alias(f"dominant_{c}"), (F.max(F.when(F.col(c).isNotNull(), F.col("n"))) / F.sum("n")).alias(f"{c}_share"))

    x = F.broadcast(mandates).join(dominant("country"), "portfolio", "left").join(dominant("sector"), "portfolio", "left").join(F.broadcast(benchmarks), "benchmark", "left")  # fixed tables
    for kind, name in (("country", "mandate_country"), ("sector", "dominant_sector")):
        x = x.join(F.broadcast(home.where(F.col("kind") == kind).select(F.col("name").alias(name), F.col("suggested").alias(f"_{kind}"))), name, "left")
    mandate = F.lower("mandate")
    suggested = F.when(mandate == "international", "ACWI").when(mandate == "sector", F.coalesce("_sector", F.lit("SPY"))).otherwise(F.coalesce("_country", F.when(mandate == "country", "ACWI").otherwise("SPY")))
    x = x.withColumn("suggested", suggested)
    known, scope = F.col("benchmark_scope").isNotNull(), F.lower("benchmark_scope")
    group = F.lower("benchmark_group")
    off_country = ~F.coalesce(F.col("benchmark_country").eqNullSafe(F.col("dominant_country")) | F.col("benchmark_country").eqNullSafe(F.col("mandate_country")) | (F.col("benchmark_country") == "Global"), F.lit(False))
    off_sector = ~F.coalesce(F.col("benchmark_sector").eqNullSafe(F.col("dominant_sector")) | F.col("benchmark_sector").isin(*BROAD), F.lit(False))
    warnings = {
        "benchmark not recognised": F.col("relative") & ~known,
        "benchmark is not of the dominant country": (mandate == "country") & off_country,
        "benchmark is not of the dominant sector": (mandate == "sector") & off_sector,
        "international mandate without a global benchmark": (mandate == "international") & ~F.coalesce(scope == "international", F.lit(False)),
        "universe is not mostly of one sector": (group == "sector") & (F.col("sector_share") < MOSTLY),
        "universe is not mostly of one country": (group == "country") & (F.col("country_share") < MOSTLY),
        "another benchmark is suggested": F.col("relative") & (F.col("benchmark") != F.col("suggested")),
    }
    said = F.array_join(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(w)) for w, c in warnings.items()]), " | ")
    return x.withColumn("warnings", said).select("portfolio", "benchmark", "mandate", "dominant_country", "country_share", "dominant_sector", "sector_share", "suggested", (F.col("warnings") == "").alias("coherent"), "warnings")


def plausible(df: DataFrame, bounds: dict[str, tuple[float, float]], most_null: float = 0.2) -> DataFrame:
    """Violations by column: share of nulls, rows out of range."""
    made = []
    for c, (low, high) in bounds.items():
        made += [F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__null_share"), F.coalesce(F.sum((~F.col(c).between(low, high)).cast("double")), F.lit(0.0)).alias(f"{c}__out_of_range")]
    out = df.agg(*made)
    long = out.unpivot([], out.columns, "rule", "observed")
    limit = F.when(F.col("rule").endswith("null_share"), F.lit(most_null)).otherwise(F.lit(0.0))
    return long.select("rule", "observed", (F.col("observed") > limit).alias("violated"))


def future_dated(tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Tables (``ts`` column) that hold times after ``as_of``."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.max("ts").alias("latest"), F.count_if(F.col("ts") > as_of).alias("future_rows")).select(F.lit(name).alias("module"), "latest", "future_rows", (F.col("future_rows") > 0).alias("violated"))
        out = one if out is None else out.union(one)
    return out


def last_write_wins(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Union of both where the highest version of a key stays; at equal versions the new row."""
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.col("_n").desc())
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_n")
