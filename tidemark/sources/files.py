"""Readers and writers of market files; every reader has a declared schema."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import expr as X


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one where that is unset and Spark runs on one machine, an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: what is missing is null, what does not cast is null, NaN and infinities are null."""
    have = set(df.columns)
    out = []
    for f in schema.fields:
        c = F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        out.append((X.finite(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c).alias(f.name))
    return df.select(*out)


def read_panel(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return conform(spark.read.parquet(path), schema)


def write_panel(df: DataFrame, path: str, ts: str = "date", mode: str = "overwrite") -> None:
    """Parquet by month of ``ts``, so that readers of a span skip the rest."""
    df.withColumn("month", F.date_format(ts, "yyyy-MM")).repartition("month").write.mode(mode).partitionBy("month").parquet(path)


def read_closes(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """CSV of daily closes: bad dates and empty closes go (a "no data" body has none that are good). ``keys``: names of folders, as in ``entity=7``."""
    raw = spark.read.schema("Date string, Open string, High string, Low string, Close string, Volume string").csv(path, header=True, mode="PERMISSIVE")
    out = raw.select(*keys, F.col("Date").try_cast("date").alias("date"), F.col("Close").try_cast("double").alias("close"))
    return out.where("date is not null and close is not null")


def read_wide_series(spark: SparkSession, path: str, codes: list[str], null: str = ".") -> DataFrame:
    """CSV with a date and a column for each code to ``date, code, value``; ``null`` and blanks are missing."""
    raw = spark.read.schema(", ".join(["date string", *[f"`{c}` string" for c in codes]])).csv(path, header=True, nullValue=null)
    long = raw.select(F.col("date").try_cast("date").alias("date"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in codes]).unpivot("date", codes, "code", "value")
    return long.where("date is not null and value is not null")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited listing: trailer and test issues go, one row for each symbol."""
    raw = spark.read.schema("Symbol string, Name string, Test string, Etf string").csv(path, header=True, sep="|")
    good = raw.where("not startswith(Symbol, 'File Creation Time') and coalesce(Test, 'N') <> 'Y' and Symbol is not null")
    one = F.row_number().over(W.partitionBy("symbol").orderBy("name"))
    return good.select(symbol(F.col("Symbol")).alias("symbol"), F.col("Name").alias("name"), (F.col("Etf") == "Y").alias("etf")).withColumn("k", one).where("k = 1").drop("k")


def symbol(c: Column) -> Column:
    """Upper case, trimmed, class separators as a dash."""
    return F.translate(F.upper(F.trim(c)), "./ ", "--")


_FACT = "struct<val: double, start: date, end: date, filed: date, form: string, accn: string, frame: string>"
FACTS = f"entity long, facts map<string, struct<units: map<string, array<{_FACT}>>>>"


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Nested filing facts to long rows: yearly and quarterly forms only, units preferred USD, then shares, then the first."""
    raw = spark.read.schema(FACTS).json(path)
    by_metric = raw.select("entity", F.explode("facts").alias("metric", "body"))
    units = F.col("body.units")
    chosen = F.coalesce(F.try_element_at(units, F.lit("USD")), F.try_element_at(units, F.lit("shares")), F.try_element_at(F.map_values(units), F.lit(1)))
    rows = by_metric.select("entity", "metric", F.explode(chosen).alias("f")).select("entity", "metric", "f.*")
    return rows.where(F.col("form").isin("10-K", "10-Q", "20-F", "40-F"))


def facts_wide(facts: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each filing and period: the last value of each metric, least start, longest duration, the sorted frames."""
    keys = ["entity", "end", "form", "accn"]
    last = facts.groupBy(*keys, "metric").agg(F.max_by("val", F.struct("filed", "val")).alias("val"))
    wide = last.groupBy(*keys).pivot("metric", metrics).agg(F.first("val"))
    rest = facts.groupBy(*keys).agg(F.min("start").alias("start"), F.max(F.date_diff("end", "start")).alias("days"), F.array_join(F.sort_array(F.collect_set("frame")), ";").alias("frames"))
    return wide.join(rest, keys)


NEWS = "struct<timeline: array<struct<series: string, data: array<struct<date: string, value: double>>>>>"


def news_timeline(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON timelines to ``series, ts, value``; a body that does not parse gives no rows."""
    parsed = df.select(F.from_json(body, NEWS).alias("j")).select(F.explode("j.timeline").alias("t"))
    points = parsed.select(F.col("t.series").alias("series"), F.explode("t.data").alias("p"))
    return points.select("series", F.try_to_timestamp(F.col("p.date"), F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("ts"), F.col("p.value").alias("value")).where("ts is not null")


def read_calendar(spark: SparkSession, path: str, zone: str = "America/Mexico_City") -> DataFrame:
    """XML calendar events with impact weight, in UTC and in ``zone``; times are New York's."""
    raw = spark.read.schema("title string, country string, date string, time string, impact string").format("xml").option("rowTag", "event").load(path)
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (("High", 3), ("Medium", 2), ("Low", 1)) for x in kv]), F.trim("impact")), F.lit(0))
    local = F.try_to_timestamp(F.concat_ws(" ", F.trim("date"), F.upper(F.trim("time"))), F.lit("MM-dd-yyyy h:mma"))
    utc = F.to_utc_timestamp(local, "America/New_York")
    return raw.select(F.trim("title").alias("title"), F.upper(F.trim("country")).alias("currency"), weight.alias("impact"), utc.alias("ts"), F.from_utc_timestamp(utc, zone).alias("local_ts"))


def constituents(df: DataFrame, html: str = "html") -> DataFrame:
    """Constituents tables of pages to ``ticker, name, sector``, normalised, one row a ticker."""
    from tidemark.operators.text import table_rows

    rows = df.select(F.explode(table_rows(F.col(html))).alias("c")).where(F.size("c") >= 3)
    out = rows.select(symbol(F.col("c")[0]).alias("ticker"), F.col("c")[1].alias("name"), F.col("c")[2].alias("sector")).where("ticker rlike '^[A-Z0-9-]{1,10}$' and ticker not in ('SYMBOL', 'TICKER')")
    return out.withColumn("k", F.row_number().over(W.partitionBy("ticker").orderBy("name", "sector"))).where("k = 1").drop("k")


def liquid_market(panel: DataFrame, n: int, required: DataFrame, entity: str = "entity", ts: str = "date", days: int = 252) -> DataFrame:
    """The panel of the ``n`` entities with the highest median money volume of their last ``days`` rows, and those required."""
    last = panel.withColumn("_k", F.row_number().over(W.partitionBy(entity).orderBy(F.desc(ts)))).where(F.col("_k") <= days)
    rank = last.groupBy(entity).agg(F.median(F.col("close") * F.col("volume")).alias("_m")).orderBy(F.desc("_m"), entity).limit(n)
    return panel.join(rank.select(entity).union(required.select(entity)).distinct(), entity, "left_semi")


def provenance(df: DataFrame, body: str, retrieved: Column, key: str) -> DataFrame:
    """Digest and size of each body, with its status."""
    return df.select(key, F.sha2(F.col(body).cast("binary"), 256).alias("sha256"), F.octet_length(body).alias("bytes"), F.when(F.coalesce(F.octet_length(body), F.lit(0)) > 0, "ok").otherwise("empty").alias("status"), retrieved.alias("retrieved_at"))
