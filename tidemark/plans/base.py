"""Domain tables derived from the driver tables, as DataFrames and as SQL for the oracles.

Daily returns are means of discounts less 0.05, taken over whole hundredths, so both
engines get the same doubles whatever the order of summation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.plans.catalog import ORACLES, QUERIES


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL that it must equal."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _returns(lines: DataFrame, *keys: str) -> DataFrame:
    mean = F.sum(F.round(F.col("l_discount") * 100).cast("long")) / (100.0 * F.count("*"))
    return lines.groupBy(*keys, F.to_date("l_shipdate").alias("date")).agg((mean - 0.05).alias("r"), F.sum("l_quantity").alias("volume"))


def _closes(panel: DataFrame) -> DataFrame:
    up = F.sum(F.log1p("r")).over(W.partitionBy("entity").orderBy("date"))
    return panel.withColumn("close", 100 * F.exp(up))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, date, r, volume, close`` by supplier and day."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"), "l_shipdate", "l_discount", "l_quantity")
    # ln(1 + r) as in the SQL: log1p sees digits of r that 1 + r has lost, and a close at a tie of rounding goes the other way
    up = F.sum(F.ln(1 + F.col("r"))).over(W.partitionBy("entity").orderBy("date"))
    return _returns(lines, "entity").withColumn("_up", up).select("entity", "date", "r", "volume", (100 * X.exp("_up")).alias("close"))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, country, sector`` of each supplier."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return own.select(F.col("s_suppkey").alias("entity"), F.col("n_name").alias("country"), F.col("r_name").alias("sector"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price panel by region and day: ``entity`` is the region's name."""
    lines = table(spark, sf_dir, "lineitem").join(sectors(spark, sf_dir), F.col("l_suppkey") == F.col("entity"))
    lines = lines.select(F.col("sector").alias("entity"), "l_shipdate", "l_discount", "l_quantity")
    return _closes(_returns(lines, "entity")).select("entity", "date", "r", "volume", "close")


def market(panel: DataFrame) -> DataFrame:
    """``date, rb``: the mean return of all entities."""
    return panel.groupBy("date").agg(F.round(F.avg("r"), 10).alias("rb"))


_ITEMS = ("shares", "debt", "cash", "ebit", "revenue", "net_income", "equity", "assets", "liabilities", "cfo", "capex", "depreciation", "interest", "retained", "tax", "pretax", "working_capital", "current_assets", "current_liabilities", "gross_profit")
_FORMULAS = {
    "shares": "n * 100.0", "debt": "t * 0.3", "cash": "q * 20.0", "ebit": "t * 0.2 - q * 40.0", "revenue": "t", "net_income": "t * 0.1 - q * 20.0", "equity": "t * 0.4 + q * 10.0",
    "assets": "t * 0.9 + q * 30.0", "liabilities": "t * 0.5 + q * 20.0", "cfo": "t * 0.15 - q * 5.0", "capex": "q * 15.0", "depreciation": "q * 4.0", "interest": "t * 0.02", "retained": "t * 0.2 - q * 30.0",
    "tax": "t * 0.03", "pretax": "t * 0.13 - q * 20.0", "working_capital": "t * 0.1 - q * 2.0", "current_assets": "t * 0.35 + q * 8.0", "current_liabilities": "t * 0.25 + q * 10.0", "gross_profit": "t * 0.4",
}


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitemporal statements: a row for each order, known at its date, for the quarter that ended before it."""
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("filing")).agg(F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("filing"), F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("available"), F.col("o_totalprice").alias("t"))
    known = orders.join(own, "filing").withColumn("period_end", F.date_sub(F.trunc("available", "quarter"), 1))
    return known.select("filing", "entity", "available", "period_end", *[F.expr(_FORMULAS[c]).alias(c) for c in _ITEMS])


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity, country, sector, segment, balance`` of each customer."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return own.select(F.col("c_custkey").alias("entity"), F.col("n_name").alias("country"), F.col("r_name").alias("sector"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``country, tenor, date, rate``: nation, line number as tenor in years, mean discount in per cent."""
    lines = table(spark, sf_dir, "lineitem").join(sectors(spark, sf_dir), F.col("l_suppkey") == F.col("entity"))
    mean = F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*")
    return lines.groupBy("country", F.col("l_linenumber").cast("int").alias("tenor"), F.to_date("l_shipdate").alias("date")).agg(mean.alias("rate"))


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An option chain: ``entity, kind, dte, moneyness, iv, open_interest, bid, ask``."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_suppkey").alias("entity"), F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("kind"), (1 + F.col("l_orderkey") % 365).cast("int").alias("dte"),
        (0.6 + 12.5 * F.round("l_tax", 2)).alias("moneyness"), (0.05 + F.round("l_discount", 2)).alias("iv"), F.col("l_quantity").alias("open_interest"), (F.col("l_extendedprice") * 0.99).alias("bid"), (F.col("l_extendedprice") * 1.01).alias("ask"), F.col("l_orderkey").alias("contract"), F.col("l_linenumber").alias("leg"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trial, month, r, n``: a supplier's mean return of each month, as a trial's out-of-sample result."""
    p = prices(spark, sf_dir)
    return p.groupBy(F.col("entity").alias("trial"), F.to_date(F.trunc("date", "month")).alias("month")).agg(F.round(F.avg("r"), 10).alias("r"), F.count("*").alias("n"))


_SECTORS_SQL = """sectors as (
  select s_suppkey as entity, n_name as country, r_name as sector from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
_CLOSE_SQL = "100 * exp(sum(ln(1 + r)) over (partition by entity order by date)) as close"
_R_SQL = "sum(round(l_discount * 100)::bigint) / (100.0::double * count(*)) - 0.05 as r, sum(l_quantity) as volume"

#: CTEs of the tables above; an oracle is ``with`` and those it needs.
PX = f"""px0 as (select l_suppkey as entity, l_shipdate::date as date, {_R_SQL} from lineitem group by 1, 2),
px as (select entity, date, r, volume, {_CLOSE_SQL} from px0)"""
SECTORS = _SECTORS_SQL
DENSE = f"""{_SECTORS_SQL},
dn0 as (select sector as entity, l_shipdate::date as date, {_R_SQL} from lineitem join sectors on l_suppkey = entity group by 1, 2),
dn as (select entity, date, r, volume, {_CLOSE_SQL} from dn0)"""
MARKET = "mk as (select date, round(avg(r), 10) as rb from px group by date)"
FILINGS = (
    "fl0 as (select l_orderkey as filing, sum(l_quantity) as q, count(*)::double as n from lineitem group by 1), "
    "fl as (select filing, o_custkey as entity, o_orderdate::date as available, (date_trunc('quarter', o_orderdate) - interval 1 day)::date as period_end, "
    + ", ".join(f"{_FORMULAS[c].replace('t ', 'o_totalprice ') if c != 'revenue' else 'o_totalprice'} as {c}" for c in _ITEMS)
    + " from orders join fl0 on o_orderkey = filing)"
)
CUSTOMERS = "cu as (select c_custkey as entity, n_name as country, r_name as sector, c_mktsegment as segment, c_acctbal as balance from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
RATES = f"{_SECTORS_SQL}, rt as (select country, l_linenumber::int as tenor, l_shipdate::date as date, sum(round(l_discount * 100)::bigint)::double / count(*) as rate from lineitem join sectors on l_suppkey = entity group by 1, 2, 3)"
OPTIONS = "op as (select l_suppkey as entity, case when l_linestatus = 'O' then 'call' else 'put' end as kind, (1 + l_orderkey % 365)::int as dte, 0.6::double + 12.5::double * round(l_tax, 2) as moneyness, 0.05::double + round(l_discount, 2) as iv, l_quantity as open_interest, l_extendedprice * 0.99::double as bid, l_extendedprice * 1.01::double as ask, l_orderkey as contract, l_linenumber as leg from lineitem)"
TRIALS = f"{PX}, tr as (select entity as trial, date_trunc('month', date)::date as month, round(avg(r), 10) as r, count(*) as n from px group by 1, 2)"
