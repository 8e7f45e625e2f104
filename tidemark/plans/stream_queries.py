"""Streaming (ST) and source (S) queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import expr as X
from tidemark.plans import base as B
from tidemark.sources import files as S
from tidemark.streaming import jobs as J

_MARK = "wm as (select date_trunc('millisecond', max(ts)) - interval 10 minute as t from events)"


def _events(spark, d):
    return J.stream(spark, f"{d}/events.parquet")


def _zoneless(df):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes if c != "_batch"])


@B.query("st1_topic_volume", f"""with {_MARK}, w as (select event_type, value, unnest([time_bucket(interval 15 minute, ts) - interval (15 * k) minute for k in [0, 1, 2, 3]]) as start from events), g as (select start, start + interval 1 hour as "end", event_type, count(*) as n, sum(value) as total from w group by 1, 2, 3)
select start, "end", event_type, n, round(total, 4) as total from g, wm where "end" <= t""")
def st1(spark, d):
    return X.rounded(_zoneless(J.run_available(J.topic_volume(_events(spark, d)), "st1")), 4)


@B.query("st2_sessions", f"""with {_MARK}, g as (select user_id, ts, case when ts - lag(ts) over w >= interval 30 minute or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)), i as (select *, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g),
s as (select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from i group by user_id, k) select user_id, start, "end", n from s, wm where "end" <= t""")
def st2(spark, d):
    return _zoneless(J.run_available(J.sessions(_events(spark, d)), "st2"))


_SEQ = "sq as (select event_type, value as x, row_number() over (partition by event_type order by ts, event_id) as i, count(*) over (partition by event_type) as n from events where value is not null)"


@B.query("st3_ewma_state", f"""with {_SEQ} select event_type, n, round(sum(case when i = 1 then pow(0.94::double, n - 1) else 0.06::double * pow(0.94::double, n - i) end * x * x), 5) as ewma from sq group by event_type, n""")
def st3(spark, d):
    return X.rounded(J.ewma_state(_events(spark, d), "st3"), 5)


@B.query("st4_throttle_state", f"""with recursive {_SEQ}, f(event_type, i, n, e, idx, peak) as (select distinct event_type, 0::bigint, n, 1.0::double, 1.0::double, 1.0::double from sq union all
select f.event_type, sq.i, f.n, case when f.idx * (1 + f.e * (x - 25.0) / 10000.0) / greatest(f.peak, f.idx * (1 + f.e * (x - 25.0) / 10000.0)) - 1 < -0.1 then 0.5 when f.idx * (1 + f.e * (x - 25.0) / 10000.0) / greatest(f.peak, f.idx * (1 + f.e * (x - 25.0) / 10000.0)) - 1 > -0.05 then 1.0 else f.e end, f.idx * (1 + f.e * (x - 25.0) / 10000.0), greatest(f.peak, f.idx * (1 + f.e * (x - 25.0) / 10000.0)) from f join sq on sq.event_type = f.event_type and sq.i = f.i + 1)
select event_type, n, e as exposure, round(idx, 6) as index from f where i = n""")
def st4(spark, d):
    return X.rounded(J.throttle_state(_events(spark, d), "st4").drop("peak"))


@B.query("st5_first_wins", "select count(distinct (user_id, event_type)) as n from events")
def st5(spark, d):
    return J.run_available(J.first_wins(_events(spark, d), ["user_id", "event_type"], "60 days"), "st5").agg(F.count("*").alias("n"))


@B.query("st5_last_wins", "select user_id, event_type, max(event_id) as event_id, arg_max(value, event_id) as value from events group by 1, 2")
def st5b(spark, d):
    return J.last_wins(_events(spark, d), ["user_id", "event_type"], "event_id", "st5b").select("user_id", "event_type", "event_id", "value")


@B.query("st6_stream_asof", """with f as (select o_custkey % 150 as user_id, (o_orderdate + interval 9300 day)::date as available, max(o_totalprice) as price from orders group by 1, 2), e as (select event_id, user_id, ts::date as day from events), m as (select event_id, max(available) as a from e join f on f.user_id = e.user_id and f.available <= e.day group by 1)
select e.event_id, m.a as r_available, f.price as r_price from e left join m using (event_id) left join f on f.user_id = e.user_id and f.available = m.a""")
def st6(spark, d):
    o = B.table(spark, d, "orders")
    f = o.groupBy((F.col("o_custkey") % 150).alias("user_id"), F.to_date(F.col("o_orderdate") + F.expr("interval 9300 day")).alias("available")).agg(F.max("o_totalprice").alias("price"))
    e = _events(spark, d).select("event_id", "user_id", F.to_date("ts").alias("day"))
    return J.enriched(e, f, "st6", by=["user_id"], ts="day", available="available").select("event_id", "r_available", "r_price")


@B.query("st7_stale_sources", """with l as (select event_type as source, max(ts) as latest from events where event_type <> 'click' or ts < timestamp '2024-01-20' group by 1) select source, case when date_diff('second', latest, timestamp '2024-01-31 00:00:00') / 3600.0 <= 72 then 'stale' else 'expired' end as status from l where date_diff('second', latest, timestamp '2024-01-31 00:00:00') / 3600.0 > 24""")
def st7(spark, d):
    e = _events(spark, d).where("event_type <> 'click' or ts < timestamp '2024-01-20'")
    ttl = spark.sql("select * from values ('none', 1.0D) as t(source, ttl_hours)")
    return J.stale_sources(e, ttl, F.lit("2024-01-31 00:00:00").cast("timestamp"), "st7").select("source", "status")


@B.query("st8_interval_join", "select a.event_id, b.event_id as reaction_id from events a join events b on a.user_id = b.user_id and b.ts >= a.ts - interval 6 hour and b.ts <= a.ts + interval 7 day where a.event_type = 'signup' and b.event_type = 'purchase'")
def st8(spark, d):
    e = _events(spark, d)
    return J.run_available(J.reactions(e.where("event_type = 'signup'"), _events(spark, d).where("event_type = 'purchase'")), "st8").select("event_id", "reaction_id")


@B.query("s01_panel_round_trip", f"with {B.PX} select entity, count(*) as n, round(sum(volume), 2) as volume from px where date >= date '1998-01-01' group by 1")
def s01(spark, d):
    path = S.new_folder(spark, "panel")
    S.write_panel(B.prices(spark, d), path)
    schema = T.StructType().add("entity", "long").add("date", "date").add("volume", "double").add("missing", "string")
    x = S.read_panel(spark, path, schema).where("date >= date '1998-01-01'")
    return X.rounded(x.groupBy("entity").agg(F.count("*").alias("n"), F.sum("volume").alias("volume")), 2)


@B.query("s02_closes_csv", f"with {B.PX} select entity, date, round(close, 4) as close from px where day(date) <> 13")
def s02(spark, d):
    path = S.new_folder(spark, "closes")
    p = B.prices(spark, d)
    rows = p.select("entity", F.date_format("date", "yyyy-MM-dd").alias("Date"), F.lit("").alias("Open"), F.lit("").alias("High"), F.lit("").alias("Low"), F.when(F.dayofmonth("date") != 13, F.col("close").cast("string")).otherwise("no data").alias("Close"), F.col("volume").cast("string").alias("Volume"))
    # a file for each entity
    rows.repartition("entity").write.partitionBy("entity").csv(path, header=True)
    return S.read_closes(spark, path, "entity").select(F.col("entity").cast("long").alias("entity"), "date", X.round_scaled("close", 4).alias("close"))


@B.query("s03_wide_series_csv", f"with {B.RATES} select date, 't' || tenor as code, round(avg(rate), 6) as value from rt group by 1, 2")
def s03(spark, d):
    path = S.new_folder(spark, "series")
    tenors = range(1, 8)
    wide = B.rates(spark, d).groupBy("date").pivot("tenor", list(tenors)).agg(F.avg("rate"))
    wide.select(F.col("date").cast("string").alias("date"), *[F.coalesce(F.col(str(k)).cast("string"), F.lit(".")).alias(f"t{k}") for k in tenors]).write.csv(path, header=True)
    return X.rounded(S.read_wide_series(spark, path, [f"t{k}" for k in tenors]))


@B.query("s04_listing", "select distinct 'T-' || (p_partkey % 500) as symbol from part where p_partkey % 10 <> 3")
def s04(spark, d):
    path = S.new_folder(spark, "listing")
    p = B.table(spark, d, "part")
    rows = p.select(F.concat(F.lit(" t."), (F.col("p_partkey") % 500).cast("string")).alias("Symbol"), F.col("p_name").alias("Name"), F.when(F.col("p_partkey") % 10 == 3, "Y").otherwise("N").alias("Test"), F.lit("N").alias("Etf"))
    rows.union(spark.sql("select 'File Creation Time: 0101', '', '', ''")).write.csv(path, header=True, sep="|")
    return S.read_listing(spark, path).select("symbol")


@B.query("s05_filing_facts", f"""with {B.FILINGS} select entity, metric, count(*) as n, round(sum(val), 2) as total from (select entity, 'Revenue' as metric, revenue as val, filing from fl where filing % 4 <> 0 union all select entity, 'Shares', shares, filing from fl where filing % 4 <> 0) group by 1, 2""")
def s05(spark, d):
    return X.rounded(S.read_facts(spark, _facts_json(spark, d)).groupBy("entity", "metric").agg(F.count("*").alias("n"), F.sum("val").alias("total")), 2)


def _facts_json(spark, d) -> str:
    path = S.new_folder(spark, "facts")
    f = B.filings(spark, d)
    form = F.when(F.col("filing") % 4 == 0, "8-K").when(F.col("filing") % 4 == 1, "10-K").otherwise("10-Q")
    fact = lambda c: F.struct(F.col(c).alias("val"), F.trunc("period_end", "quarter").alias("start"), F.col("period_end").alias("end"), F.col("available").alias("filed"), form.alias("form"), F.col("filing").cast("string").alias("accn"), F.concat(F.lit("CY"), F.year("period_end").cast("string")).alias("frame"))
    g = f.groupBy("entity").agg(F.collect_list(fact("revenue")).alias("rev"), F.collect_list(fact("shares")).alias("sh"))
    unit = lambda k, c: F.struct(F.create_map(F.lit(k), F.col(c)).alias("units"))
    g.select("entity", F.create_map(F.lit("Revenue"), unit("USD", "rev"), F.lit("Shares"), unit("shares", "sh")).alias("facts")).write.json(path)
    return path


@B.query("a01_facts_wide", f"""with {B.FILINGS} select entity, period_end as "end", filing::varchar as accn, round(revenue, 2) as "Revenue", round(shares, 2) as "Shares", (period_end - date_trunc('quarter', period_end)::date)::int as days, 'CY' || year(period_end) as frames from fl where filing % 4 <> 0""")
def a01(spark, d):
    x = S.facts_wide(S.read_facts(spark, _facts_json(spark, d)), ["Revenue", "Shares"])
    return X.rounded(x.select("entity", "end", "accn", "Revenue", "Shares", "days", "frames"), 2)


@B.query("s06_news_timeline", "select event_type as series, date_trunc('hour', ts) as ts, count(*)::double as value from events group by 1, 2")
def s06(spark, d):
    h = B.table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").cast("double").alias("n"))
    point = F.struct(F.date_format("h", "yyyyMMdd'T'HHmmss'Z'").alias("date"), F.col("n").alias("value"))
    series = h.groupBy("event_type").agg(F.collect_list(point).alias("data"))
    body = series.select(F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("series"), "data")).alias("timeline"))).alias("body"))
    return _zoneless(S.news_timeline(body.union(spark.sql("select 'not json'"))))


@B.query("s07_calendar_xml", "select event_type as title, 'USD' as currency, case user_id % 3 when 0 then 3 when 1 then 2 else 1 end as impact, date_trunc('minute', ts) + interval 5 hour as ts, date_trunc('minute', ts) - interval 1 hour as local_ts from events")
def s07(spark, d):
    path = S.new_folder(spark, "calendar")
    e = B.table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("title"), F.lit("usd").alias("country"), F.date_format("ts", "MM-dd-yyyy").alias("date"), F.date_format("ts", "h:mma").alias("time"), F.element_at(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), (F.col("user_id") % 3 + 1).cast("int")).alias("impact"))
    rows.write.format("xml").option("rowTag", "event").option("rootTag", "events").save(path)
    return _zoneless(S.read_calendar(spark, path))


@B.query("s09_constituents", "select 'P' || p_partkey as ticker, 'Part ' || p_partkey as name, 'Group ' || p_partkey % 7 as sector from part")
def s09(spark, d):
    p = B.table(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    row = F.concat(F.lit("<tr><td><a href='#'>p"), k, F.lit("</a></td><td>Part "), k, F.lit("</td><td>Group "), (F.col("p_partkey") % 7).cast("string"), F.lit("</td></tr>"))
    pages = p.groupBy((F.col("p_partkey") % 20).alias("page")).agg(F.concat(F.lit("<table><tr><th>Symbol</th><th>Name</th><th>Sector</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    return S.constituents(pages)


@B.query("s10_liquid_market", f"""with {B.PX}, k as (select *, row_number() over (partition by entity order by date desc) as k from px), m as (select entity, median(close * volume) as m from k where k <= 252 group by 1 order by m desc, entity limit 30), u as (select entity from m union select 1) select entity, count(*) as n from px where entity in (select entity from u) group by 1""")
def s10(spark, d):
    need = spark.range(1).select(F.lit(1).cast("long").alias("entity"))
    return S.liquid_market(B.prices(spark, d), 30, need).groupBy("entity").agg(F.count("*").alias("n"))


@B.query("s11_shards_merge", f"with {B.TRIALS} select trial, count(*) as n, min(month) as first, max(month) as last from tr group by 1")
def s11(spark, d):
    path = S.new_folder(spark, "shards")
    B.trials(spark, d).select("trial", F.col("month").cast("string").alias("month"), "r").repartition(7, "trial").write.csv(path, header=True)
    x = spark.read.schema("trial long, month date, r double").csv(path, header=True)
    return x.groupBy("trial").agg(F.count("*").alias("n"), F.min("month").alias("first"), F.max("month").alias("last"))


@B.query("s13_provenance", "select page_id, sha256(html) as sha256, strlen(html)::int as bytes, case when coalesce(strlen(html), 0) > 0 then 'ok' else 'empty' end as status, date '2024-02-01' as retrieved_at from pages")
def s13(spark, d):
    return S.provenance(B.table(spark, d, "pages"), "html", F.lit("2024-02-01").cast("date"), "page_id")
