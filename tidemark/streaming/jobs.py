"""Streaming twins of batch operators.

Each function turns streaming frames into a streaming frame; ``run_available`` runs one
over what there is and gives the rows written, which lie in the shared folder. Those that
keep a table between batches run themselves and give that table.
Availability time is the event time and carries the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.files import new_folder


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of a Parquet table; times without a zone are UTC."""
    schema = spark.read.parquet(path).schema
    out = spark.readStream.schema(schema).parquet(f"{path}*")
    zoneless = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return out.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else out


def _write_batches(df: DataFrame, home: str, mode: str, schema, turn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Each batch in a folder named by its number and overwritten when the batch is tried again, so no row is written twice."""
    spark = df.sparkSession
    out = f"{home}/rows"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/_batch=-1")
    write = lambda rows, batch: turn(rows).write.mode("overwrite").parquet(f"{out}/_batch={batch}")
    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def run_available(df: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """All rows that the stream gives for the input there is, with their ``_batch``.

    With the ``folder`` of an earlier run (in shared storage) the stream goes on from there.
    """
    return _write_batches(df, folder or new_folder(df.sparkSession, name), mode, df.schema, lambda rows: rows)


def topic_volume(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Events and their mean value by type in sliding windows; later rows than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, once the watermark has closed them."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def ewma_state(events: DataFrame, name: str, key: str = "event_type", value: str = "value", decay: float = 0.94, folder: str | None = None) -> DataFrame:
    """``n`` and exponentially weighted mean square of each key, a table kept between batches.

    A batch comes after those before it. Within it each hour of a key is summed on its own, so a
    hot key is spread over tasks, and only the sums of the hours meet in a window.
    Null values are left out; rows without a time come first.
    """

    def fold(held: DataFrame, rows: DataFrame) -> DataFrame:
        own = rows.where(F.col(value).isNotNull()).select(key, "ts", "event_id", F.pow(value, F.lit(2)).alias("sq"), F.date_trunc("hour", "ts").alias("hour"))
        within = W.partitionBy(key, "hour").orderBy(F.desc("ts"), F.desc("event_id"))
        own = own.withColumn("weight", F.pow(F.lit(decay), F.row_number().over(within) - 1))
        hours = own.groupBy(key, "hour").agg(F.count("*").alias("n"), F.sum(F.col("weight") * F.col("sq")).alias("s"), F.min_by("sq", F.struct("ts", "event_id")).alias("first"))
        later = F.coalesce(F.sum("n").over(W.partitionBy(key).orderBy(F.desc("hour")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        new = hours.withColumn("s", F.col("s") * F.pow(F.lit(decay), later)).groupBy(key).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min_by("first", F.struct("hour")).alias("first"))
        both = new.unionByName(held.select(key, F.col("n").alias("old"), F.col("ewma").alias("before")), allowMissingColumns=True)
        both = both.groupBy(key).agg(*[F.max(c).alias(c) for c in ("n", "s", "first", "old", "before")])  # one row a side
        shrunk = F.pow(F.lit(decay), F.coalesce("n", F.lit(0)))
        start = F.when(F.col("old").isNull(), F.col("first") * shrunk).otherwise(F.col("before") * shrunk)
        return both.select(key, (F.coalesce("n", F.lit(0)) + F.coalesce("old", F.lit(0))).alias("n"), (start + (1 - decay) * F.coalesce("s", F.lit(0.0))).alias("ewma"))

    return per_batch(events, name, fold, f"{key} string, n long, ewma double", folder)


def throttle_state(events: DataFrame, name: str, key: str = "event_type", value: str = "value", cut: float = 0.1, restore: float = 0.05, folder: str | None = None) -> DataFrame:
    """Exposure of each path: halved beyond a drawdown of ``cut``, whole again within ``restore``; a table kept between batches.

    Returns are (value - 25) / 10,000. A path is stepped through in order, so a key is one task,
    but its rows are sorted by Spark and read slice by slice: none holds a whole key in memory.
    """
    shape = f"{key} string, n long, exposure double, index double, peak double"

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, open_, names = None, None, [key, "n", "exposure", "index", "peak"]
        for part in parts:
            done = []
            for k, x, n, exposure, index, peak in part[[key, "x", "n", "exposure", "index", "peak"]].itertuples(index=False, name=None):
                if open_ is None or k != at:
                    if open_ is not None:
                        done.append((at, *open_))
                    at, open_ = k, (0, 1.0, 1.0, 1.0)
                if pd.isna(x):  # what the batches before left
                    open_ = (int(n), exposure, index, peak)
                    continue
                n, exposure, index, peak = open_
                index *= 1 + exposure * (x - 25.0) / 10000.0
                peak = max(peak, index)
                dd = index / peak - 1
                open_ = (n + 1, 0.5 if dd < -cut else 1.0 if dd > -restore else exposure, index, peak)
            if done:
                yield pd.DataFrame(done, columns=names)
        if open_ is not None:
            yield pd.DataFrame([(at, *open_)], columns=names)

    def fold(held: DataFrame, rows: DataFrame) -> DataFrame:
        own = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(key, "ts", "event_id", F.col(value).cast("double").alias("x"))
        both = own.unionByName(held, allowMissingColumns=True)
        order = [key, F.col("x").isNotNull(), "ts", "event_id"]
        return both.repartition(key).sortWithinPartitions(*order).mapInPandas(step, shape)

    return per_batch(events, name, fold, shape, folder)


def first_wins(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def last_wins(df: DataFrame, keys: list[str], version: str, name: str, folder: str | None = None) -> DataFrame:
    """The row of the highest version of each key after all batches: every batch is folded into the table before it."""
    from tidemark.operators.quality import last_write_wins

    return per_batch(df, name, lambda held, rows: last_write_wins(held, rows, keys, version), folder=folder)


def per_batch(df: DataFrame, name: str, fold: Callable[[DataFrame, DataFrame], DataFrame], schema=None, folder: str | None = None) -> DataFrame:
    """A table folded with each batch; ``fold`` never empties it. ``schema``: of the table, where it is not that of the stream.

    Version N comes of version N - 1 and batch N alone and is overwritten if the batch is tried
    again. With the ``folder`` of an earlier run (in shared storage) the table goes on from there.
    """
    spark = df.sparkSession
    home, shape = folder or new_folder(spark, name), schema or df.schema
    at = lambda version: f"{home}/versions/_version={version}"
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(at(-1))

    def write(rows: DataFrame, batch: int) -> None:
        fold(spark.read.parquet(at(batch - 1)), rows).write.mode("overwrite").parquet(at(batch))

    df.writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    last = spark.read.parquet(f"{home}/versions").agg(F.max("_version")).first()[0]
    return spark.read.parquet(at(-1 if last is None else last))


def enriched(events: DataFrame, facts: DataFrame, name: str, *, by: list[str], ts: str, available: str, folder: str | None = None) -> DataFrame:
    """Stream rows with the static fact last known at their time, batch by batch."""
    from tidemark.operators.asof import asof_join

    spark = events.sparkSession
    turn = lambda rows: asof_join(rows, facts, by=by, left_ts=ts, right_ts=available)
    return _write_batches(events, folder or new_folder(spark, name), "append", turn(spark.createDataFrame([], events.schema)).schema, turn)


def stale_sources(events: DataFrame, ttl: DataFrame, as_of, name: str, source: str = "event_type") -> DataFrame:
    """Alerts for sources whose latest row so far is older than their limit, after the last batch."""
    from tidemark.operators.quality import freshness

    latest = events.select(F.col(source).alias("source"), "ts")
    table = per_batch(latest, name, lambda held, rows: held.unionByName(rows).groupBy("source").agg(F.max("ts").alias("ts")))
    return freshness(table, ttl, as_of).where("status <> 'fresh'")


def reactions(events: DataFrame, others: DataFrame, before: str = "6 hours", after: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Pairs of an event and a reaction of the same user from ``before`` to ``after`` it; both sides are watermarked."""
    a = events.select("event_id", F.col("user_id").alias("user"), F.col("ts").alias("ts_a")).withWatermark("ts_a", late)
    b = others.select(F.col("event_id").alias("reaction_id"), "user_id", F.col("ts").alias("ts_b")).withWatermark("ts_b", late)
    near = F.expr(f"user = user_id and ts_b >= ts_a - interval {before} and ts_b <= ts_a + interval {after}")
    return a.join(b, near).select("event_id", "reaction_id", "user", "ts_a", "ts_b")
