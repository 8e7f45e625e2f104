"""Join (J), quality (Q), sort and set (T) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import asof as J
from tidemark.operators import panel as P
from tidemark.operators import quality as Q
from tidemark.plans import base as B

_EV = "ev as (select user_id % 100 + 1 as entity, (ts + interval 1277 day)::date as date, event_id from events)"


def _events(spark, d):
    return B.table(spark, d, "events").select((F.col("user_id") % 100 + 1).alias("entity"), F.to_date(F.col("ts") + F.expr("interval 1277 day")).alias("date"), "event_id")


def _asof_sql(direction: str, tolerance: str = "") -> str:
    f, op = ("max", "<=") if direction == "backward" else ("min", ">=")
    return f"select e.event_id, {f}(p.date) as d from ev e join px p on p.entity = e.entity and p.date {op} e.date {tolerance} group by 1"


@B.query("j01_asof_backward", f"with {B.PX}, {_EV}, m as ({_asof_sql('backward')}) select ev.event_id, ev.entity, ev.date, m.d as r_date, round(px.close, 6) as r_close from ev left join m using (event_id) left join px on px.entity = ev.entity and px.date = m.d")
def j01(spark, d):
    return X.rounded(J.asof_join(_events(spark, d), B.prices(spark, d).select("entity", "date", "close"), by=["entity"], left_ts="date", right_ts="date").select("event_id", "entity", "date", "r_date", "r_close"))


@B.query("j02_asof_text_features", """with dv as (select source as entity, date '1995-01-01' + (doc_id % 2000)::int as available, doc_id, n_chars from documents), k as (select entity, available, max((n_chars, doc_id)) as v from dv group by 1, 2),
fl as (select o_orderkey as filing, 'src' || (o_custkey % 20) as entity, o_orderdate::date as available from orders), m as (select filing, max(k.available) as a from fl join k on k.entity = fl.entity and k.available <= fl.available group by 1)
select fl.filing, fl.entity, fl.available, m.a as r_available, k.v[1] as r_n_chars, k.v[2] as r_doc_id from fl left join m using (filing) left join k on k.entity = fl.entity and k.available = m.a""")
def j02(spark, d):
    docs = B.table(spark, d, "documents").select(F.col("source").alias("entity"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int")).alias("available"), "n_chars", "doc_id")
    own = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("filing"), F.concat(F.lit("src"), (F.col("o_custkey") % 20).cast("string")).alias("entity"), F.to_date("o_orderdate").alias("available"))
    # ties of a day by the larger struct: put the length first
    return J.asof_join(own, docs.select("entity", "n_chars", "doc_id", "available"), by=["entity"], left_ts="available", right_ts="available").select("filing", "entity", "available", "r_available", "r_n_chars", "r_doc_id")


@B.query("j04_asof_nearest_week", f"""with {B.PX}, {_EV}, q as (select * from px where volume > 60), b as (select e.event_id, max(p.date) as d from ev e join q p on p.entity = e.entity and p.date <= e.date and e.date - p.date <= 7 group by 1),
f as (select e.event_id, min(p.date) as d from ev e join q p on p.entity = e.entity and p.date >= e.date and p.date - e.date <= 7 group by 1),
n as (select ev.*, case when b.d is not null and (f.d is null or ev.date - b.d <= f.d - ev.date) then b.d else f.d end as r_date from ev left join b using (event_id) left join f using (event_id))
select n.event_id, n.entity, n.date, n.r_date, q.volume as r_volume from n left join q on q.entity = n.entity and q.date = n.r_date""")
def j04(spark, d):
    q = B.prices(spark, d).where("volume > 60").select("entity", "date", "volume")
    return J.asof_join(_events(spark, d), q, by=["entity"], left_ts="date", right_ts="date", direction="nearest", tolerance=7).select("event_id", "entity", "date", "r_date", "r_volume")


@B.query("j05_latest_known_facts", f"""with {B.FILINGS}, k as (select *, row_number() over (partition by entity order by period_end desc, available desc, filing desc) as k from fl where available <= date '1998-06-30')
select entity, filing, period_end, available, round(revenue, 2) as revenue from k where k = 1""")
def j05(spark, d):
    x = J.latest_known(B.filings(spark, d), F.lit("1998-06-30").cast("date"), by=["entity"], available="available", order=["period_end", "available", "filing"])
    return x.select("entity", "filing", "period_end", "available", F.round("revenue", 2).alias("revenue"))


@B.query("j05_latest_known_at_dates", f"""with {B.FILINGS}, s as (select unnest([date '1996-01-01', date '1997-01-01', date '1998-01-01', date '1999-01-01']) as as_of), k as (select *, row_number() over (partition by entity, as_of order by period_end desc, available desc, filing desc) as k from fl join s on available <= as_of)
select entity, as_of, filing, period_end from k where k = 1""")
def j05b(spark, d):
    dates = spark.range(4).select(F.make_date(1996 + F.col("id"), F.lit(1), F.lit(1)).alias("as_of"))
    x = J.latest_known_at(B.filings(spark, d).select("entity", "filing", "period_end", "available"), dates, by=["entity"], available="available", order=["period_end", "available", "filing"])
    return x.select("entity", "as_of", "filing", "period_end")


_GAPPED = "a as (select filing, entity, available, case when filing % 3 <> 0 then revenue end as revenue, case when filing % 5 <> 0 then equity end as equity from fl where filing % 2 = 0), b as (select entity, available, max((revenue, equity)) as v from fl where filing % 2 = 1 group by 1, 2)"


@B.query("j06_fallback_fill", f"""with {B.FILINGS}, {_GAPPED}, m as (select a.filing, max(b.available) as t from a join b on a.entity = b.entity and b.available <= a.available group by 1)
select a.filing, a.entity, a.available, round(coalesce(a.revenue, b.v[1]), 2) as revenue, round(coalesce(a.equity, b.v[2]), 2) as equity, ((a.revenue is null and b.v[1] is not null)::int + (a.equity is null and b.v[2] is not null)::int) as filled
from a left join m using (filing) left join b on b.entity = a.entity and b.available = m.t""")
def j06(spark, d):
    f = B.filings(spark, d)
    a = f.where("filing % 2 = 0").select("filing", "entity", "available", F.when(F.col("filing") % 3 != 0, F.col("revenue")).alias("revenue"), F.when(F.col("filing") % 5 != 0, F.col("equity")).alias("equity"))
    b = f.where("filing % 2 = 1").select("entity", "revenue", "equity", "available")
    # ties of a day by revenue, then equity
    b = b.groupBy("entity", "available").agg(F.max(F.struct("revenue", "equity")).alias("v")).select("entity", "available", "v.*")
    x = J.fill_from(a, b, ["revenue", "equity"], by=["entity"], ts="available")
    return x.select("filing", "entity", "available", F.round("revenue", 2).alias("revenue"), F.round("equity", 2).alias("equity"), "filled")


_SECOND = "second as (select entity, date, case when (entity + date_diff('day', date '1995-01-01', date)) % 50 = 0 then close * 1.01 else close end as close from px where (entity * 7 + date_diff('day', date '1995-01-01', date)) % 3 <> 0)"


def _second(p):
    day = F.date_diff("date", F.lit("1995-01-01"))
    return p.where((F.col("entity") * 7 + day) % 3 != 0).select("entity", "date", F.when((F.col("entity") + day) % 50 == 0, F.col("close") * 1.01).otherwise(F.col("close")).alias("close"))


@B.query("j09_prefer_right", f"with {B.PX}, {_SECOND}, u as (select entity, date, close, 2 as o from px where entity % 2 = 0 union all select entity, date, close, 1 from second) select entity, date, round(arg_min(close, o) + 1e-9, 6) as close from u group by 1, 2")
def j09(spark, d):
    p = B.prices(spark, d)
    return X.rounded(J.prefer(p.where("entity % 2 = 0"), _second(p), ["entity", "date"], "close").withColumn("close", F.col("close") + 1e-9))


@B.query("j10_source_chain_fill", f"""with {B.PX}, {_SECOND}, a as (select entity, date, case when entity % 4 <> 0 or date < date '1995-01-20' then close end as close from px where entity % 5 <> 0), w as (select entity, count(close) < 5 as few from a group by 1)
select entity, date, round(case when coalesce(few, true) and s.close is not null then s.close else coalesce(a.close, s.close) end + 1e-9, 6) as close, case when (coalesce(few, true) and s.close is not null) or a.close is null then 'secondary' else 'primary' end as source from a full join second s using (entity, date) left join w using (entity)""")
def j10(spark, d):
    p = B.prices(spark, d)
    a = p.where("entity % 5 <> 0").withColumn("close", F.when((F.col("entity") % 4 != 0) | (F.col("date") < "1995-01-20"), F.col("close")))
    return X.rounded(J.fill_sparse(a, _second(p), "entity", "date", "close").withColumn("close", F.col("close") + 1e-9))


@B.query("j11_reconciliation", f"""with {B.PX}, {_SECOND}, b as (select entity, abs((s.close - px.close) / px.close) as diff, coalesce(px.close, s.close) as c from px full join second s using (entity, date))
select entity, count(diff) as overlap, round(avg((diff > 0.005)::int::double), 6) as share_over, round(max(diff), 6) as max_diff, count(c) as consensus_rows, count(diff) >= 20 and coalesce(avg((diff > 0.005)::int::double), 0) > 0.01 as warn from b group by entity""")
def j11(spark, d):
    p = B.prices(spark, d)
    return X.rounded(J.reconcile(p, _second(p), "entity", "date", "close"))


_PAIRS = f"ra as (select country, avg(rate) as rate, count(*) as n from rt where tenor <= 2 group by 1)"


@B.query("j12_carry_pairs", f"""with {B.RATES}, {_PAIRS}, er as (select n_name as country, (n_nationkey % 5) / 10.0::double as risk from nation)
select a.country as long, b.country as short, round(a.rate - b.rate, 6) as spread, round((a.rate - b.rate) * (1 - x.risk) * (1 - y.risk), 6) as score from ra a join ra b on a.country <> b.country join er x on x.country = a.country join er y on y.country = b.country""")
def j12(spark, d):
    r = B.rates(spark, d).where("tenor <= 2").groupBy("country").agg(F.avg("rate").alias("rate"))
    risk = B.table(spark, d, "nation").select(F.col("n_name").alias("country"), ((F.col("n_nationkey") % 5) / 10.0).alias("risk"))
    own = r.join(F.broadcast(risk), "country")  # one row for each nation
    a, b = (own.select(F.col("country").alias(n), F.col("rate").alias(f"rate_{n}"), F.col("risk").alias(f"risk_{n}")) for n in ("long", "short"))
    pairs = a.join(F.broadcast(b), F.col("long") != F.col("short"))
    spread = F.col("rate_long") - F.col("rate_short")
    return X.rounded(pairs.select("long", "short", spread.alias("spread"), (spread * (1 - F.col("risk_long")) * (1 - F.col("risk_short"))).alias("score")))


@B.query("j13_removed_not_listed", """with s as (select l_suppkey % 100 * 40 + l_partkey % 40 as ticker, max(l_shipdate)::date as last from lineitem group by 1), m as (select max(last) as m from s)
select ticker, last as removed_date, ticker % 3 = 0 as recoverable from s, m where last < m - 365""")
def j13(spark, d):
    s = B.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 100 * 40 + F.col("l_partkey") % 40).alias("ticker")).agg(F.to_date(F.max("l_shipdate")).alias("removed_date"))
    last = s.agg(F.max("removed_date").alias("m"))
    marked = s.crossJoin(F.broadcast(last))  # one row
    listed = marked.where("removed_date >= date_sub(m, 365)").select("ticker")
    return Q.removed_not_listed(s, listed, s.where("ticker % 3 = 0").select("ticker"))


@B.query("j14_membership_at", """with c as (select user_id as ticker, ts::date as day, case when event_type in ('click', 'view') then 'added' else 'removed' end as action from events), cur as (select distinct ticker from c where ticker % 2 = 0),
f as (select ticker, arg_min(action, (day, action)) as first from c where day > (select min(day) + 20 from c) group by 1)
select ticker from cur where ticker not in (select ticker from f where first = 'added') union select ticker from f where first = 'removed'""")
def j14(spark, d):
    c = B.table(spark, d, "events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("day"), F.when(F.col("event_type").isin("click", "view"), "added").otherwise("removed").alias("action"))
    date = c.agg(F.date_add(F.min("day"), 20)).first()[0]
    return J.membership_at(c.where("ticker % 2 = 0"), c, F.lit(date))


_WINDOWS = "wn as (select date '1995-03-31' + interval (3 * i) month as s, date '1995-03-31' + interval (3 * i + 3) month as e from range(20) t(i)), wd as (select s::date as start, e::date as \"end\" from wn)"


def _windows(spark):
    first = F.lit("1995-03-31").cast("date")
    return spark.range(20).select(F.add_months(first, (F.col("id") * 3).cast("int")).alias("start"), F.add_months(first, (F.col("id") * 3 + 3).cast("int")).alias("end"))


@B.query("j16_returns_in_windows", f"""with {B.PX}, {_WINDOWS} select start, "end", entity, count(*) as n, round(exp(sum(ln(1 + r))) - 1, 7) as total, min(date) as first_day, max(date) as last_day from px join wd on date > start and date <= "end" group by 1, 2, 3""")
def j16(spark, d):
    x = J.in_windows(B.prices(spark, d), _windows(spark)).groupBy("start", "end", "entity").agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("total"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    return X.rounded(x, 7)


@B.query("j18_portfolio_return", f"""with {B.PX}, w as (select entity, sum(volume) / (select sum(volume) from px where date < date '1995-07-01') as w from px where date < date '1995-07-01' group by 1)
select date, round(sum(w * r), 8) as r, count(*) as names from px join w using (entity) where date >= date '1995-07-01' group by date""")
def j18(spark, d):
    from pyspark.sql import Window as W

    p = B.prices(spark, d)
    w = p.where("date < date '1995-07-01'").groupBy("entity").agg(F.sum("volume").alias("v")).select("entity", (F.col("v") / F.sum("v").over(W.partitionBy())).alias("w"))
    return X.rounded(p.where("date >= date '1995-07-01'").join(w, "entity").groupBy("date").agg(F.sum(F.col("w") * F.col("r")).alias("r"), F.count("*").alias("names")), 8)


@B.query("j19_capped_combinations", f"""with {B.PX}, {B.SECTORS}, t as (select entity as id, sector as g from (select entity, sum(volume) as v from px group by 1 order by v desc, entity limit 16) join sectors using (entity))
select [a.id, b.id, c.id] as members, [a.g, b.g, c.g] as groups from t a join t b on b.id > a.id join t c on c.id > b.id where not (a.g = b.g and b.g = c.g)""")
def j19(spark, d):
    top = B.prices(spark, d).groupBy("entity").agg(F.sum("volume").alias("v")).orderBy(F.desc("v"), "entity").limit(16)
    return J.combinations(top.join(B.sectors(spark, d), "entity").select(F.col("entity").alias("id"), F.col("sector").alias("g")), 3, "g", 2)


@B.query("a50_source_freshness", """with i as (select event_type as source, ts from events), l as (select source, max(ts) as latest, count(*) as n from i group by 1), t as (select 'click' as source, 1.0::double as ttl union all select 'view', 0.5)
select source, latest, n as rows, round(date_diff('second', latest, (select max(ts) from events)) / 3600.0::double, 6) as age_hours,
case when date_diff('second', latest, (select max(ts) from events)) / 3600.0 <= coalesce(ttl, 24) then 'fresh' when date_diff('second', latest, (select max(ts) from events)) / 3600.0 <= 3 * coalesce(ttl, 24) then 'stale' else 'expired' end as status from l left join t using (source)""")
def a50(spark, d):
    e = B.table(spark, d, "events")
    ttl = spark.sql("select * from values ('click', 1.0D), ('view', 0.5D) as t(source, ttl_hours)")
    return X.rounded(Q.freshness(e.select(F.col("event_type").alias("source"), "ts"), ttl, F.lit(e.agg(F.max("ts")).first()[0])))


@B.query("a63_frequency", f"""with {B.PX}, u as (select entity, date from px union all select 1000 + entity, date from px where day(date) = 15 and entity % 2 = 0), g as (select entity, date - lag(date) over (partition by entity order by date) as gap from (select distinct * from u)),
m as (select entity, median(gap) as median_gap, count(*) as n from g group by 1) select entity, median_gap::double as median_gap, n, case when median_gap is null then 'unknown' when median_gap <= 3 then 'daily' when median_gap <= 10 then 'weekly' when median_gap <= 45 then 'monthly' when median_gap <= 120 then 'quarterly' else 'annual' end as frequency from m""")
def a63(spark, d):
    p = B.prices(spark, d).select("entity", "date")
    return Q.frequency(p.union(p.where("day(date) = 15 and entity % 2 = 0").select(F.col("entity") + 1000, "date")), "entity", "date")


@B.query("a56_duplicate_paths", f"""with {B.TRIALS}, u as (select trial, month, r from tr union all select trial + 1000, month, r from tr where trial % 10 = 0), p as (select trial, list((month, round(r, 9)) order by month) as path, count(*) as n from u group by 1)
select trial, n::int as n, min(trial) over (partition by path) as canonical from p""")
def a56(spark, d):
    t = B.trials(spark, d).select("trial", "month", "r")
    return Q.duplicate_paths(t.union(t.where("trial % 10 = 0").select(F.col("trial") + 1000, "month", "r")), "trial", "month", "r", 9)


_RULES = "(values ('max_drawdown', -0.5::double, 'min'), ('sharpe', -0.05::double, 'min'), ('volatility', 0.5::double, 'max')) t(test, threshold, direction)"


@B.query("a54_gate_verdicts", f"""with {B.PX}, m as (select entity, 'sharpe' as test, avg(r) / nullif(stddev_samp(r), 0) as observed from px group by 1 union all select entity, 'volatility', stddev_samp(r) * sqrt(252.0) from px group by 1),
g as (select e.entity, t.test, coalesce(case when direction = 'min' then observed >= threshold else observed <= threshold end, false) as passed from (select distinct entity from px) e cross join {_RULES} left join m on m.entity = e.entity and m.test = t.test)
select entity, case when bool_and(passed) then 'pass' when avg(passed::int) >= 0.5 then 'review' else 'fail' end as status, round(avg(passed::int), 6) as score, coalesce(string_agg(test, ';' order by test) filter (where not passed), '') as failed from g group by entity""")
def a54(spark, d):
    x = B.prices(spark, d).groupBy("entity").agg(X.ratio(F.avg("r"), F.stddev_samp("r")).alias("sharpe"), (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("volatility"))
    x = x.withColumn("max_drawdown", F.lit(None).cast("double"))
    long = x.unpivot("entity", ["sharpe", "volatility", "max_drawdown"], "test", "observed")
    rules = spark.sql("select * from values ('max_drawdown', -0.5D, 'min'), ('sharpe', -0.05D, 'min'), ('volatility', 0.5D, 'max') as t(test, threshold, direction)")
    return X.rounded(Q.verdict(Q.gate(long, rules), "entity"))


@B.query("q1_plausibility", f"""with {B.FILINGS}, p as (select *, case when filing % 4 <> 0 then ebit end as e from fl) select 'e__null_share' as rule, round(avg((e is null)::int), 6)::double as observed, avg((e is null)::int) > 0.2 as violated from p union all select 'e__out_of_range', coalesce(sum((e not between 0 and 50000)::int), 0)::double, coalesce(sum((e not between 0 and 50000)::int), 0) > 0 from p
union all select 'revenue__null_share', avg((revenue is null)::int)::double, avg((revenue is null)::int) > 0.2 from p union all select 'revenue__out_of_range', coalesce(sum((revenue not between 0 and 1e9)::int), 0)::double, coalesce(sum((revenue not between 0 and 1e9)::int), 0) > 0 from p""")
def q1(spark, d):
    f = B.filings(spark, d).withColumn("e", F.when(F.col("filing") % 4 != 0, F.col("ebit")))
    return X.rounded(Q.plausible(f, {"e": (0.0, 50000.0), "revenue": (0.0, 1e9)}))


@B.query("q2_registry_rules", """with r as (select s_suppkey as id, s_name as name, s_acctbal as balance from supplier) select 'duplicate_name' as rule, count(*) as violations from (select name from r group by 1 having count(*) > 1) union all select 'missing_name', count(*) from r where name is null or name = '' union all select 'negative_balance', count(*) from r where balance < 0""")
def q2(spark, d):
    r = B.table(spark, d, "supplier")
    rules = {"duplicate_name": r.groupBy("s_name").count().where("count > 1"), "missing_name": r.where("s_name is null or s_name = ''"), "negative_balance": r.where("s_acctbal < 0")}
    parts = [df.agg(F.lit(k).alias("rule"), F.count("*").alias("violations")) for k, df in rules.items()]
    return parts[0].union(parts[1]).union(parts[2])


@B.query("q3_future_dated", """select 'orders' as module, max(o_orderdate) as latest, count(*) filter (where o_orderdate > timestamp '2001-01-01') as future_rows, count(*) filter (where o_orderdate > timestamp '2001-01-01') > 0 as violated from orders union all select 'lineitem', max(l_shipdate), count(*) filter (where l_shipdate > timestamp '2001-01-01'), count(*) filter (where l_shipdate > timestamp '2001-01-01') > 0 from lineitem""")
def q3(spark, d):
    tables = {n: B.table(spark, d, n).select(F.col(c).alias("ts")) for n, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))}
    return Q.future_dated(tables, F.lit("2001-01-01").cast("timestamp_ntz"))


@B.query("s12_last_write_wins", """with o as (select o_custkey as k, o_orderkey as v, o_totalprice as x, 0 as n from orders where o_orderkey % 2 = 0 union all select o_custkey, o_orderkey - 1, o_totalprice, 1 from orders where o_orderkey % 2 = 1),
r as (select *, row_number() over (partition by k order by v desc, n desc) as i from o) select k, v, x from r where i = 1""")
def s12(spark, d):
    o = B.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_totalprice").alias("x"))
    return Q.last_write_wins(o.where("v % 2 = 0"), o.where("v % 2 = 1").withColumn("v", F.col("v") - 1), ["k"], "v")


@B.query("t2_top_per_group", f"with {B.PX}, k as (select *, row_number() over (partition by entity order by volume desc, date) as k from px) select entity, date, volume, k from k where k <= 3")
def t2(spark, d):
    from pyspark.sql import Window as W

    return B.prices(spark, d).withColumn("k", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("volume"), "date")).cast("long")).where("k <= 3").select("entity", "date", "volume", "k")


@B.query("t4_ordered_union", f"""with {B.PX}, m as (select entity, sum(volume) as v, count(*) as n from px group by 1), u as (select entity, 1 as p, v as s from m where v > (select median(v) from m) union all select entity, 2, n from m where n > 520 union all select entity, 3, 0 from m where entity <= 10), k as (select *, row_number() over (partition by entity order by p) as k from u)
select entity, p as quota from k where k = 1""")
def t4(spark, d):
    from pyspark.sql import Window as W

    m = B.prices(spark, d).groupBy("entity").agg(F.sum("volume").alias("v"), F.count("*").alias("n")).withColumn("mid", F.median("v").over(W.partitionBy()))
    u = m.where("v > mid").select("entity", F.lit(1).alias("quota")).union(m.where("n > 520").select("entity", F.lit(2))).union(m.where("entity <= 10").select("entity", F.lit(3)))
    return u.withColumn("k", F.row_number().over(W.partitionBy("entity").orderBy("quota"))).where("k = 1").select("entity", "quota")


@B.query("t6_set_operations", "select 'both' as part, count(*) as n from (select o_custkey from orders where o_orderdate < timestamp '1998-01-01' intersect select o_custkey from orders where o_orderdate >= timestamp '1998-01-01') union all select 'early_only', count(*) from (select o_custkey from orders where o_orderdate < timestamp '1998-01-01' except select o_custkey from orders where o_orderdate >= timestamp '1998-01-01')")
def t6(spark, d):
    o = B.table(spark, d, "orders")
    a, b = o.where("o_orderdate < timestamp_ntz '1998-01-01 00:00:00'").select("o_custkey"), o.where("o_orderdate >= timestamp_ntz '1998-01-01 00:00:00'").select("o_custkey")
    return a.intersect(b).agg(F.lit("both").alias("part"), F.count("*").alias("n")).union(a.subtract(b).agg(F.lit("early_only"), F.count("*")))


@B.query("t8_pivot_tenors", f"with {B.RATES} select country, " + ", ".join(f"round(avg(rate) filter (where tenor = {k}), 6) as t{k}" for k in range(1, 8)) + " from rt group by country")
def t8(spark, d):
    x = B.rates(spark, d).withColumn("t", F.concat(F.lit("t"), F.col("tenor").cast("string"))).groupBy("country").pivot("t", [f"t{k}" for k in range(1, 8)]).agg(F.avg("rate"))
    return X.rounded(x)


@B.query("p28_coverage_filter", f"with {B.PX}, c as (select entity, count(*) as n, max(date) - min(date) as span from px where entity % 3 <> 0 or date < date '1997-01-01' group by 1) select px.entity, count(*) as n from px join c using (entity) where c.n >= 400 and span >= 3 * 365 - 14 group by 1")
def p28(spark, d):
    p = B.prices(spark, d)
    good = p.where("entity % 3 <> 0 or date < date '1997-01-01'").groupBy("entity").agg(F.count("*").alias("n"), F.date_diff(F.max("date"), F.min("date")).alias("span")).where("n >= 400 and span >= 3 * 365 - 14")
    return p.join(good, "entity", "left_semi").groupBy("entity").agg(F.count("*").alias("n"))


__all__ = ["P"]
