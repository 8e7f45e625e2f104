"""Scores, universes, attribution, action logs and other compositions of the operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import asof as J
from tidemark.operators import books as K2
from tidemark.operators import market_state as M
from tidemark.operators import panel as P
from tidemark.operators import quality as Q
from tidemark.operators import resample as S
from tidemark.operators import rewards as A
from tidemark.operators import risk as K
from tidemark.plans import base as B

_UP = "(partition by entity order by date rows between unbounded preceding and current row)"
_BASE = f"{B.MARKET}, jj as (select * from px join mk using (date)), ix as (select entity, date, exp(sum(ln(1 + greatest(r, -0.999999))) over {_UP}) as idx from px), dw as (select entity, -min(dd) as mdd from (select entity, idx / greatest(max(idx) over {_UP}, 1.0) - 1 as dd from ix) group by 1), v0 as (select entity, -r as loss, quantile_cont(-r, 0.95) over (partition by entity) as v from px), cv as (select entity, avg(loss) filter (where loss >= v) as cvar from v0 group by 1), bs as (select entity, avg(r - rb) * 252.0 as active, sqrt(avg(pow(least(r, 0.0), 2))) * sqrt(252.0) as downside, stddev_samp(r - rb) * sqrt(252.0) as tracking, avg((r - rb < 0)::int::double) as behind, avg(r) filter (where rb > 0) / avg(rb) filter (where rb > 0) as up, avg(r) filter (where rb < 0) / avg(rb) filter (where rb < 0) as down from jj group by 1)"


def _score(l: str = "1.0", c: str = "0.5", m: str = "0.5", t: str = "0.5") -> str:
    return f"((active + (up - down) * 0.1) / ({l} * downside + {c} * cvar + {m} * mdd + {t} * tracking) - 0.25 * greatest(behind - 0.5, 0.0))"


def _both(spark, d):
    p = B.prices(spark, d)
    return p.join(B.market(p), "date")


@B.query("a16_score_families", f"with {B.PX}, {_BASE} select entity, round({_score()}, 6) as balanced, round({_score('2.0::double', '1.0')}, 6) as defensive, round({_score('0.5', '0.25::double')}, 6) as bold from bs join dw using (entity) join cv using (entity)")
def a16(spark, d):
    x = _both(spark, d)
    out = None
    for name, k in (("balanced", {}), ("defensive", {"downside": 2.0, "cvar": 1.0}), ("bold", {"downside": 0.5, "cvar": 0.25})):
        one = K.relative_score(x, "entity", lambdas=k).select("entity", F.col("score").alias(name))
        out = one if out is None else out.join(one, "entity")
    return X.rounded(out)


_PERT = "(values ('base', 1.0::double, 1.0::double, 1.0::double, 1.0::double), ('downside_up', 1.5, 1.0, 1.0, 1.0), ('downside_down', 0.5, 1.0, 1.0, 1.0), ('cvar_up', 1.0, 1.5, 1.0, 1.0), ('cvar_down', 1.0, 0.5, 1.0, 1.0), ('tracking_up', 1.0, 1.0, 1.0, 1.5)) p(name, kl, kc, km, kt)"


@B.query("a18_lambda_sensitivity", f"""with {B.PX}, {_BASE}, s as (select entity, name, round({_score('kl', '0.5 * kc', '0.5 * km', '0.5 * kt')}, 9) as score from bs join dw using (entity) join cv using (entity) cross join {_PERT}), r as (select *, rank() over (partition by name order by score) + (count(*) over (partition by name, score) - 1) / 2.0 as rk from s), b as (select entity, rk as base_rk from r where name = 'base'), t as (select name, arg_max(entity, (score, -entity)) as top from s group by 1)
select r.name, round(corr(rk, base_rk), 6) as rank_correlation, any_value(t.top) <> (select top from t where name = 'base') as top_changed from r join b using (entity) join t on t.name = r.name group by 1""")
def a18(spark, d):
    x = _both(spark, d)
    k = {"base": {}, "downside_up": {"downside": 1.5}, "downside_down": {"downside": 0.5}, "cvar_up": {"cvar": 0.75}, "cvar_down": {"cvar": 0.25}, "tracking_up": {"tracking": 0.75}}
    out = None
    for name, lambdas in k.items():
        one = K.relative_score(x, "entity", lambdas=lambdas).select(F.lit(name).alias("name"), "entity", F.round("score", 9).alias("score"))
        out = one if out is None else out.union(one)
    r = out.withColumn("rk", X.average_rank("score", "name"))
    top = r.groupBy("name").agg(F.max_by("entity", F.struct("score", -F.col("entity"))).alias("top"))
    base = r.where("name = 'base'").select("entity", F.col("rk").alias("base_rk"))
    base_top = top.where("name = 'base'").select(F.col("top").alias("base_top"))
    g = r.join(base, "entity").groupBy("name").agg(F.corr("rk", "base_rk").alias("rank_correlation")).join(top, "name").crossJoin(F.broadcast(base_top))  # one row
    return X.rounded(g.select("name", "rank_correlation", (F.col("top") != F.col("base_top")).alias("top_changed")))


@B.query("a17_benchmark_dominance", f"""with {B.PX}, {B.DENSE}, f as (select px.entity, dn.entity as benchmark, avg(px.r - dn.r) * 252.0 as active, avg(dn.r) filter (where dn.r < 0) as down from px join dn using (date) group by 1, 2) select entity, round(quantile_cont(active, 0.1), 6) as worst_decile, round(median(active), 6) as mid, count(*) filter (where active > 0) as beaten, count(*) as benchmarks from f group by 1""")
def a17(spark, d):
    c = B.dense(spark, d).select("date", F.col("entity").alias("benchmark"), F.col("r").alias("rb"))
    f = B.prices(spark, d).select("entity", "date", "r").join(c, "date").groupBy("entity", "benchmark").agg((F.avg(F.col("r") - F.col("rb")) * 252.0).alias("active"))
    return X.rounded(f.groupBy("entity").agg(F.percentile("active", 0.1).alias("worst_decile"), F.median("active").alias("mid"), F.count_if(F.col("active") > 0).alias("beaten"), F.count("*").alias("benchmarks")))


@B.query("a19_preservation_test", f"with {B.PX}, {_BASE} select entity, round(up, 6) as up_capture, round(down, 6) as down_capture, up >= 0.9 and down <= 1.0 as preserved from bs")
def a19(spark, d):
    c = K.capture(_both(spark, d), "entity")
    return X.rounded(c.select("entity", "up_capture", "down_capture", ((F.col("up_capture") >= 0.9) & (F.col("down_capture") <= 1.0)).alias("preserved")))


@B.query("a20_drawdown_budget", f"""with {B.DENSE}, mk as (select date, round(avg(r), 10) as rb from dn group by date), a as (select entity, date, exp(sum(ln(1 + r)) over {_UP}) as i, exp(sum(ln(1 + rb)) over {_UP}) as b from dn join mk using (date)), p as (select entity, date, i / greatest(max(i) over {_UP}, 1.0) - 1 as dd, b / greatest(max(b) over {_UP}, 1.0) - 1 as bd from a), e as (select entity, greatest(-dd - (-bd * 1.15::double + 0.008::double), 0.0) as ex from p)
select entity, round(max(ex), 6) as max_excess, round(avg(ex), 6) as mean_excess, count(*) filter (where ex > 0) as days_over from e group by 1""")
def a20(spark, d):
    dn = B.dense(spark, d)
    a = P.drawdown_path(dn).select("entity", "date", "drawdown")
    b = P.drawdown_path(dn.join(B.market(dn), "date").select("entity", "date", F.col("rb").alias("r"))).select("entity", "date", F.col("drawdown").alias("bd"))
    e = a.join(b, ["entity", "date"]).withColumn("ex", F.greatest(-F.col("drawdown") - (-F.col("bd") * 1.15 + 0.008), F.lit(0.0)))
    return X.rounded(e.groupBy("entity").agg(F.max("ex").alias("max_excess"), F.avg("ex").alias("mean_excess"), F.count_if(F.col("ex") > 0).alias("days_over")))


@B.query("a21_red_team", f"""with {B.DENSE}, q as (select *, quantile_cont(r, 0.95) over (partition by entity) as top from dn), s as (select entity, r, 'base' as scenario from q union all select entity, r - 0.0002::double, 'cost' from q union all select entity, r, 'trim_top' from q where r < top union all select entity, case when r < 0 then r * 1.1::double else r end, 'worse_down' from q)
select entity, scenario, count(*) as n, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0), 6) as sharpe from s group by 1, 2""")
def a21(spark, d):
    q = B.dense(spark, d).withColumn("top", F.percentile("r", 0.95).over(W.partitionBy("entity")))
    case = lambda name, x: F.struct(F.lit(name).alias("scenario"), x.alias("x"))
    made = [case("base", F.col("r")), case("cost", F.col("r") - 0.0002), F.when(F.col("r") < F.col("top"), case("trim_top", F.col("r"))), case("worse_down", F.when(F.col("r") < 0, F.col("r") * 1.1).otherwise(F.col("r")))]
    cases = F.explode(F.array_compact(F.array(*made)))
    x = q.select("entity", cases.alias("c")).select("entity", "c.*")
    return X.rounded(x.groupBy("entity", "scenario").agg(F.count("*").alias("n"), (X.ratio(F.avg("x"), F.stddev_samp("x")) * F.sqrt(F.lit(252.0))).alias("sharpe")))


@B.query("a22_objective_summary", f"with {B.TRIALS} select trial % 7 as objective, count(*) as n, round(avg(r), 8) as mean, round(median(r), 8) as mid, round(avg((r > 0)::int::double), 6) as hit_rate, round(min(r), 8) as worst from tr group by 1 order by mean desc, mid desc, objective")
def a22(spark, d):
    x = B.trials(spark, d).groupBy((F.col("trial") % 7).alias("objective")).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.median("r").alias("mid"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.min("r").alias("worst"))
    return x.select("objective", "n", F.round("mean", 8).alias("mean"), F.round("mid", 8).alias("mid"), F.round("hit_rate", 6).alias("hit_rate"), F.round("worst", 8).alias("worst")).orderBy(F.desc("mean"), F.desc("mid"), "objective")


@B.query("a25_model_confidence", f"""with {B.TRIALS}, s as (select trial, month, lag(r) over (partition by trial order by month) as a, r as b, dense_rank() over (order by month desc) as k from tr), x as (select * from s where k <= 6 and a is not null), r as (select month, rank() over (partition by month order by a) + (count(*) over (partition by month, a) - 1) / 2.0 as ra, rank() over (partition by month order by b) + (count(*) over (partition by month, b) - 1) / 2.0 as rb, count(*) over (partition by month) as n, b from x),
m as (select month, corr(ra, rb) as c, avg(b) filter (where ra > 0.8::double * n) as top, avg(b) as mean from r group by 1) select round(avg(c), 6) as rank_correlation, round(avg(top - mean), 8) as top_edge, round(1 / (1 + exp(-(3 * avg(c) + 100 * avg(top - mean)))), 6) as confidence from m""")
def a25(spark, d):
    t = B.trials(spark, d).withColumn("a", F.lag("r").over(X.by("trial", "month")))
    months = t.select("month").distinct().withColumn("k", F.row_number().over(W.orderBy(F.desc("month"))))  # a calendar
    x = t.join(F.broadcast(months), "month").where("k <= 6 and a is not null").withColumn("ra", X.average_rank("a", "month")).withColumn("rb", X.average_rank("r", "month")).withColumn("n", F.count("*").over(W.partitionBy("month")))
    m = x.groupBy("month").agg(F.corr("ra", "rb").alias("c"), F.avg(F.when(F.col("ra") > 0.8 * F.col("n"), F.col("r"))).alias("top"), F.avg("r").alias("mean"))
    y = m.agg(F.avg("c").alias("c"), F.avg(F.col("top") - F.col("mean")).alias("e"))
    return y.select(F.round("c", 6).alias("rank_correlation"), F.round("e", 8).alias("top_edge"), F.round(X.logistic(3 * F.col("c") + 100 * F.col("e")), 6).alias("confidence"))


@B.query("a49_benchmark_governance", f"""with {B.CUSTOMERS}, n as (select sector, country, count(*) as c, sum(balance) as b from cu group by 1, 2) select sector, arg_min(country, (-c, country)) as dominant, round(max(c) / sum(c), 6) as share, max(c) / sum(c) < 0.25 as fragmented from n group by 1""")
def a49(spark, d):
    n = B.customers(spark, d).groupBy("sector", "country").agg(F.count("*").alias("c"))
    share = F.max("c") / F.sum("c")
    return X.rounded(n.groupBy("sector").agg(F.min_by("country", F.struct(-F.col("c"), "country")).alias("dominant"), share.alias("share"), (share < 0.25).alias("fragmented")))


_MANDATES = [("AUTOMOBILE", "Country", "EWQ", "Country", "FRANCE", True), ("BUILDING", "Sector", "XLE", "Sector", "CHINA", False), ("FURNITURE", "International", "SPY", "Broad", "UNITED STATES", True), ("HOUSEHOLD", "Balanced", "SPY", "Broad", "UNITED STATES", True), ("MACHINERY", "Sector", "CUSTOM", "Sector", "JAPAN", True)]
_BENCHMARKS = [("SPY", "Broad", "UNITED STATES", "Broad"), ("EWQ", "Country", "FRANCE", "Broad"), ("ACWI", "International", "Global", "Broad"), ("XLE", "Sector", "UNITED STATES", "Energy"), ("VGK", "Sector", "Global", "EUROPE")]
_HOMES = [("country", "FRANCE", "EWQ"), ("country", "UNITED STATES", "SPY"), ("country", "JAPAN", "EWJ"), ("sector", "EUROPE", "VGK"), ("sector", "ASIA", "AAXJ"), ("sector", "AFRICA", "AFK")]
_row = lambda rows: ", ".join("(" + ", ".join(repr(v) if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in rows)


@B.query("a49_mandate_checks", f"""with {B.CUSTOMERS}, gm as (select * from (values {_row(_MANDATES)}) t(portfolio, mandate, benchmark, benchmark_group, mandate_country, relative)), gb as (select * from (values {_row(_BENCHMARKS)}) t(benchmark, scope, bc, bs)), gh as (select * from (values {_row(_HOMES)}) t(kind, name, home)),
gc as (select segment as portfolio, arg_min(country, (-n, country)) as dc, max(n) / sum(n) as cs from (select segment, country, count(*) as n from cu group by 1, 2) group by 1), gs as (select segment as portfolio, arg_min(sector, (-n, sector)) as ds, max(n) / sum(n) as ss from (select segment, sector, count(*) as n from cu group by 1, 2) group by 1),
gx as (select gm.*, dc, cs, ds, ss, scope, bc, bs, case lower(mandate) when 'international' then 'ACWI' when 'sector' then coalesce(s.home, 'SPY') when 'country' then coalesce(c.home, 'ACWI') else coalesce(c.home, 'SPY') end as suggested from gm left join gc using (portfolio) left join gs using (portfolio) left join gb using (benchmark)
  left join gh c on c.kind = 'country' and c.name = mandate_country left join gh s on s.kind = 'sector' and s.name = ds),
gw as (select *, array_to_string(list_filter([case when relative and scope is null then 'benchmark not recognised' end, case when mandate = 'Country' and not coalesce(bc in (dc, mandate_country, 'Global'), false) then 'benchmark is not of the dominant country' end, case when mandate = 'Sector' and not coalesce(bs in (ds, 'Broad', 'Technology/Growth'), false) then 'benchmark is not of the dominant sector' end,
  case when mandate = 'International' and scope is distinct from 'International' then 'international mandate without a global benchmark' end, case when benchmark_group = 'Sector' and ss < 0.5 then 'universe is not mostly of one sector' end, case when benchmark_group = 'Country' and cs < 0.5 then 'universe is not mostly of one country' end,
  case when relative and benchmark <> suggested then 'another benchmark is suggested' end], lambda x: x is not null), ' | ') as warnings from gx)
select portfolio, benchmark, mandate, dc as dominant_country, round(cs, 6) as country_share, ds as dominant_sector, round(ss, 6) as sector_share, suggested, warnings = '' as coherent, warnings from gw""")
def a49_mandates(spark, d):
    """Customers as holdings of their segment's portfolio, under a table of mandates."""
    holdings = B.customers(spark, d).select(F.col("segment").alias("portfolio"), "country", "sector")
    mandates = spark.createDataFrame(_MANDATES, "portfolio string, mandate string, benchmark string, benchmark_group string, mandate_country string, relative boolean")
    known = spark.createDataFrame(_BENCHMARKS, "benchmark string, benchmark_scope string, benchmark_country string, benchmark_sector string")
    return X.rounded(Q.benchmark_governance(holdings, mandates, known, spark.createDataFrame(_HOMES, "kind string, name string, suggested string")))


@B.query("a51_latest_signals", f"""with {B.PX}, k as (select *, row_number() over (partition by entity order by date desc) as k from px) select entity, max(date) as latest, round((arg_max(volume, date) - avg(volume)) / nullif(stddev_samp(volume), 0), 6) as z from k where k <= 252 group by 1""")
def a51(spark, d):
    k = B.prices(spark, d).withColumn("k", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("date")))).where("k <= 252")
    return X.rounded(k.groupBy("entity").agg(F.max("date").alias("latest"), X.ratio(F.max_by("volume", "date") - F.avg("volume"), F.stddev_samp("volume")).alias("z")))


@B.query("a52_market_state", f"""with {B.PX}, x as (select date, avg(r) as m, stddev_samp(r) as disp, avg((r < 0)::int::double) as down, count(*) as n from px group by 1), w as (select *, case when count(m) over v >= 21 then stddev_samp(m) over v end as vol from x window v as (order by date rows between 20 preceding and current row)), k as (select *, (rank() over (order by round(vol, 12)) + (count(*) over (partition by round(vol, 12)) - 1) / 2.0) / count(*) over () as vr from w where vol is not null)
select date, round(vol, 6) as vol, round(vr, 6) as vol_rank, round(disp, 6) as dispersion, case when vr >= 0.9 and down > 0.6 then 'stress' when vr >= 0.7 then 'elevated' else 'calm' end as state from k""")
def a52(spark, d):
    x = B.prices(spark, d).groupBy("date").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("dispersion"), F.avg((F.col("r") < 0).cast("double")).alias("down"))
    x = x.withColumn("vol", X.rolling(F.stddev_samp, "m", W.orderBy("date"), 21)).where("vol is not null")  # one row a day
    x = x.withColumn("v", F.round("vol", 12)).withColumn("vol_rank", X.percent_of_rank("v"))
    state = F.when((F.col("vol_rank") >= 0.9) & (F.col("down") > 0.6), "stress").when(F.col("vol_rank") >= 0.7, "elevated").otherwise("calm")
    return X.rounded(x.select("date", "vol", "vol_rank", "dispersion", state.alias("state")))


@B.query("a53_strategy_consensus", f"""with {B.PX}, s as (select entity, entity % 4 as strategy, date, volume from px union all select entity, 4 + entity % 3, date, volume * (1 + entity % 5) from px), l as (select strategy, max(date) as d from s where date <= date '1999-12-31' group by 1), c as (select s.* from s join l on l.strategy = s.strategy and s.date > l.d - 30 and s.date <= l.d), g as (select strategy, entity, avg(volume) as v from c group by 1, 2),
r as (select *, (rank() over (partition by strategy order by v) + (count(*) over (partition by strategy, v) - 1) / 2.0) / count(*) over (partition by strategy) as p from g) select entity, count(*) as strategies, round(avg(p), 6) as consensus, round(avg((p >= 0.8)::int::double), 6) as breadth from r group by 1""")
def a53(spark, d):
    p = B.prices(spark, d)
    s = p.select("entity", (F.col("entity") % 4).alias("strategy"), "date", "volume").union(p.select("entity", 4 + F.col("entity") % 3, "date", F.col("volume") * (1 + F.col("entity") % 5)))
    last = s.where("date <= date '1999-12-31'").groupBy("strategy").agg(F.max("date").alias("last"))
    g = s.join(F.broadcast(last), "strategy").where("date > date_sub(last, 30) and date <= last").groupBy("strategy", "entity").agg(F.avg("volume").alias("v"))  # a row a strategy
    r = g.withColumn("p", X.percent_of_rank("v", "strategy"))
    return X.rounded(r.groupBy("entity").agg(F.count("*").alias("strategies"), F.avg("p").alias("consensus"), F.avg((F.col("p") >= 0.8).cast("double")).alias("breadth")))


@B.query("a55_effective_trials", f"with {B.TRIALS} select count(distinct trial) as trials, count(distinct round(r, 6)) as different_results, round(ln(count(distinct trial)), 6) as log_trials from tr")
def a55(spark, d):
    return X.rounded(B.trials(spark, d).agg(F.countDistinct("trial").alias("trials"), F.countDistinct(F.round("r", 6)).alias("different_results"), F.log(F.countDistinct("trial").cast("double")).alias("log_trials")))


@B.query("a61_completeness", "with c as (select 'orders' as module, count(*) as n from orders union all select 'events', count(*) from events union all select 'part', count(*) from part) select module, n, need, n >= need as complete from c join (values ('orders', 1000), ('events', 100), ('part', 1000000000)) r(module, need) using (module)")
def a61(spark, d):
    parts = [B.table(spark, d, n).agg(F.lit(n).alias("module"), F.count("*").alias("n")) for n in ("orders", "events", "part")]
    rules = spark.sql("select * from values ('orders', 1000), ('events', 100), ('part', 1000000000) as t(module, need)")
    return parts[0].union(parts[1]).union(parts[2]).join(F.broadcast(rules), "module").withColumn("complete", F.col("n") >= F.col("need"))  # a rule a module


_NEEDS = [
    ("Market", "daily", "event_types", 3), ("Market", "daily", "events", 100), ("Market", "daily", "calendar", 1),
    ("Rates", "daily", "curve_countries", 20), ("Rates", "daily", "rate_history", 250),
    ("Fundamentals", "run", "filings", 1000), ("Fundamentals", "run", "filers", 50), ("Fundamentals", "run", "rejections", 1),
    ("Research", "run", "entities", 10), ("Research", "run", "return_days", 252),
]
_PARTS = {
    "events": ("events", "count(*)"), "event_types": ("events", "count(distinct event_type)"), "curve_countries": ("nation", "count(distinct n_nationkey)"), "rate_history": ("lineitem", "count(distinct l_shipdate)"),
    "filings": ("orders", "count(*)"), "filers": ("orders", "count(distinct o_custkey)"), "entities": ("lineitem", "count(distinct l_suppkey)"), "return_days": ("lineitem", "count(distinct l_shipdate)"),
}


@B.query("a61_module_evidence", f"""with c as ({" union all ".join(f"select '{k}' as part, {v} as n from {t}" for k, (t, v) in _PARTS.items())}), r as (select * from (values {", ".join(map(str, _NEEDS))}) t(module, cadence, part, need)), x as (select r.*, coalesce(n, 0) as n from r left join c using (part)),
g as (select module, cadence, count(*) as checks, count(*) filter (where n >= need) as passed, coalesce(string_agg(part || ' ' || n || '/' || need, '; ' order by part) filter (where n < need), '') as missing from x group by 1, 2)
select module, cadence, checks, passed, round(passed / checks, 6) as score, case when passed = checks then 'complete' when passed > 0 then 'partial' else 'missing' end as status, missing from g""")
def a61_evidence(spark, d):
    """Counts of each table are taken in one pass over it."""
    counted = []
    for name in dict.fromkeys(t for t, _ in _PARTS.values()):
        own = {k: v for k, (t, v) in _PARTS.items() if t == name}
        counted.append(B.table(spark, d, name).agg(*[F.expr(v).alias(k) for k, v in own.items()]).unpivot([], list(own), "part", "n"))
    counts = counted[0]
    for more in counted[1:]:
        counts = counts.union(more)
    return X.rounded(Q.completeness(counts, spark.createDataFrame(_NEEDS, "module string, cadence string, part string, need long")))


@B.query("a62_action_rewards", f"""with {B.TRIALS}, a as (select trial % 6 as action, 'p' || trial % 3 as profile, r * 100 as reward from tr), t as (select count(*) as n from a) select action, profile, count(*) as n, round(avg(reward), 6) as mean, round(avg(reward) + sqrt(2 * ln((select n from t)) / count(*)), 6) as ucb from a group by 1, 2""")
def a62(spark, d):
    a = B.trials(spark, d).select((F.col("trial") % 6).alias("action"), F.concat(F.lit("p"), (F.col("trial") % 3).cast("string")).alias("profile"), (F.col("r") * 100).alias("reward"))
    g = a.groupBy("action", "profile").agg(F.count("*").alias("n"), F.avg("reward").alias("mean"))
    total = F.sum("n").over(W.partitionBy())
    return X.rounded(g.withColumn("ucb", F.col("mean") + F.sqrt(2 * F.log(total.cast("double")) / F.col("n"))))


def _clip_sql(x: str, low: float, high: float) -> str:
    return f"greatest(least({x}, {high}::double), {low}::double)"


_CAPS_SQL = ", ".join(f"{_clip_sql(f'{c[0]}::double + {c[1]}::double * stress + {c[2]}::double * risk_on + {c[3]}::double * recovery', c[4], c[5])} as {k}_cap" for k, c in M.CAPS.items())
_STATES = f"""mkd as (select date, round(avg(r), 10) as rb from dn group by date), md as (select date, rb, row_number() over (order by date) - 1 as pos, case when count(rb) over v >= {M.SHORT} then stddev_samp(rb) over v * sqrt(252.0::double) end as vol from mkd window v as (order by date rows between {M.SHORT - 1} preceding and current row)),
ma as (select signal, pos as at_, vol as now from (select max(date) as signal from mkd group by date_trunc('month', date)) join md on date = signal where pos >= {M.WINDOW - 1}), ms as (select signal, at_, now, date, rb, pos, vol from md join ma on pos <= at_),
mr as (select signal, count(*) filter (where round(vol, 12) <= round(now, 12))::double / count(vol) as vol_rank from ms group by 1), mi as (select * from ms where pos > at_ - {M.WINDOW}),
mn as (select *, greatest(max(up) over (partition by signal order by date), 0) as peak from (select *, sum(ln(1 + rb)) over (partition by signal order by date) as up from mi)),
mp as (select signal, 1 - exp(min(up - peak)) as drawdown, exp(sum(ln(1 + rb)) filter (where pos > at_ - {M.MEDIUM}) * 252.0 / count(*) filter (where pos > at_ - {M.MEDIUM})) - 1 as trend_63, exp(sum(ln(1 + rb)) * 252.0 / count(*)) - 1 as trend_126 from mn group by 1),
mg as (select signal, date, entity, coalesce(dn.r, 0.0::double) as x from mi cross join (select distinct entity from dn) left join dn using (entity, date)), mz as (select *, stddev_samp(x) over (partition by signal, entity) as sd from mg),
mc as (select a.signal, a.entity as a, b.entity as b, corr(a.x, b.x) as c from mz a join mz b on a.signal = b.signal and a.date = b.date and a.entity < b.entity where a.sd > 1e-12 and b.sd > 1e-12 group by 1, 2, 3), mw as (select signal, avg(c) as crowding from mc group by 1),
mo as (select signal, quantile_cont(sd, 0.5) * sqrt(252.0::double) as dispersion from (select signal, date, stddev_samp(x) as sd from mg group by 1, 2) group by 1),
mt as (select *, {M.STRESS["vol"]}::double * {_clip_sql("vol_rank", 0, 1)} + {M.STRESS["drawdown"]}::double * {_clip_sql(f"drawdown / {M.SCALES['drawdown']}::double", 0, 1)} + {M.STRESS["crowding"]}::double * {_clip_sql(f"crowding / {M.SCALES['crowding']}::double", 0, 1)} + {M.STRESS["trend"]}::double * (trend_63 < 0)::int as stress,
  (trend_63 > 0 and trend_126 > 0 and vol_rank < {M.CALM_RANK})::int::double as risk_on, (trend_63 > 0 and trend_126 <= 0 and drawdown > {M.RECOVERY_DRAWDOWN})::int::double as recovery from mr join mp using (signal) join mw using (signal) join mo using (signal)),
mx as (select *, case when risk_on = 1 then 'expansion' when recovery = 1 then 'recovery' when round(stress, 9) > {M.STRESSED} then 'stress' else 'fragile' end as state, {_CAPS_SQL} from mt)"""


@B.query("a52_market_states", f"""with {B.DENSE}, {_STATES} select signal, round(vol_rank, 6) as vol_rank, round(drawdown, 6) as drawdown, round(trend_63, 6) as trend_63, round(trend_126, 6) as trend_126, round(crowding, 6) as crowding, round(dispersion, 6) as dispersion, round(stress, 6) as stress, risk_on, recovery, state,
round(growth_cap, 6) as growth_cap, round(alpha_cap, 6) as alpha_cap, round({_clip_sql("growth_cap + alpha_cap", *M.TOTAL_CAP)}, 6) as total_cap from mx""")
def a52_states(spark, d):
    """At the last day of each month of the regional panel."""
    dn = B.dense(spark, d)
    mk = B.market(dn)
    signals = mk.groupBy(F.trunc("date", "month")).agg(F.max("date").alias("signal")).select("signal")
    return X.rounded(M.market_states(dn, mk, signals))


_OBJECTIVES = ("min_variance", "cvar_min", "risk_parity", "hrp", "mean_variance", "sortino")
_PRIORS = [("p0", o, 0.015) for o in _OBJECTIVES[:4]] + [("p2", o, 0.01) for o in _OBJECTIVES[4:]]
_LOG = f"""lm as (select month, avg(r) * 100 as level, stddev_samp(r) * 100 as spread from tr group by 1), lk as (select month, lag(level) over o as level, lag(spread) over o as spread from lm window o as (order by month)),
lg as (select [{", ".join(map(repr, _OBJECTIVES))}][trial % 6 + 1] as objective, 'p' || (trial // 6) % 3 as profile, r * 100 as reward, coalesce(level, 0) as u, coalesce(spread, 0) as v from tr join lk using (month)), lx as (select level as u, spread as v from lm where month = (select max(month) from lm))"""


def _log(spark, d):
    """Rewards by objective and profile, with the level and spread of all trials in the month before as context; and the latest context."""
    tr = B.trials(spark, d)
    months = tr.groupBy("month").agg((F.avg("r") * 100).alias("level"), (F.stddev_samp("r") * 100).alias("spread"))
    order = W.orderBy("month")  # one row a month
    known = months.select("month", *[F.lag(c).over(order).alias(c) for c in ("level", "spread")])
    names = F.array(*map(F.lit, _OBJECTIVES))
    log = tr.join(F.broadcast(known), "month").select(F.element_at(names, (F.col("trial") % 6 + 1).cast("int")).alias("objective"), F.concat(F.lit("p"), (F.floor(F.col("trial") / 6) % 3).cast("string")).alias("profile"), (F.col("r") * 100).alias("reward"), "level", "spread")  # a row a month
    return log, months.orderBy(F.desc("month")).limit(1)


@B.query("a62_contextual_scores", f"""with {B.TRIALS}, {_LOG}, s as (select profile, objective, count(*) as n, avg(reward) as mean, 1 + sum(u * u) as a, sum(u * v) as b, 1 + sum(v * v) as c, sum(u * reward) as p, sum(v * reward) as q from lg group by 1, 2),
t as (select *, n >= 4 as fits, a * c - b * b as det from s), w as (select t.*, case when fits then (x.u * (c * p - b * q) + x.v * (a * q - b * p)) / det end as prediction, 0.35::double * case when fits then sqrt(greatest((x.u * x.u * c - 2 * x.u * x.v * b + x.v * x.v * a) / det, 0)) else 1 / sqrt(n + 1.0::double) end as bonus from t, lx x),
h as (select * from (values {", ".join(f"('{a}', '{b}', {c}::double)" for a, b, c in _PRIORS)}) t(profile, objective, prior)), z as (select w.*, coalesce(prior, 0) as prior from w left join h using (profile, objective)), f as (select *, coalesce(prediction, mean, 0) + bonus + prior as score from z)
select profile, objective, n, round(mean, 6) as mean, round(prediction, 6) as prediction, round(bonus, 6) as bonus, prior, round(score, 6) as score, row_number() over (order by round(score, 9) desc, profile, objective) = 1 as recommended from f""")
def a62_scores(spark, d):
    priors = spark.createDataFrame(_PRIORS, "profile string, objective string, prior double")
    return X.rounded(A.contextual_scores(*_log(spark, d), ["profile", "objective"], ["level", "spread"], priors=priors))


@B.query("a62_reward_matrix", f"""with {B.TRIALS}, {_LOG} select profile, {", ".join(f"round(avg(reward) filter (where objective = '{o}'), 6) as {o}" for o in _OBJECTIVES)} from lg group by 1""")
def a62_matrix(spark, d):
    return X.rounded(A.reward_matrix(_log(spark, d)[0], "profile", "objective", list(_OBJECTIVES)))


@B.query("a65_holding_sensitivity", f"""with {B.PX}, {B.MARKET}, q as (select quantile_cont(rb, 0.05) as c from mk), w as (select entity, sum(volume) as v from px group by 1) select entity, round(stddev_samp(r) * any_value(v) / (select sum(v) from w), 8) as local_risk, round(avg(r) filter (where rb <= (select c from q)) * any_value(v) / (select sum(v) from w), 8) as tail_risk from px join mk using (date) join w using (entity) group by 1""")
def a65(spark, d):
    x = _both(spark, d)
    cut = B.market(B.prices(spark, d)).agg(F.percentile("rb", 0.05).alias("cut"))
    g = x.crossJoin(F.broadcast(cut)).groupBy("entity").agg(F.stddev_samp("r").alias("sd"), F.avg(F.when(F.col("rb") <= F.col("cut"), F.col("r"))).alias("tail"), F.sum("volume").alias("v"))  # one row
    w = F.col("v") / F.sum("v").over(W.partitionBy())
    return X.rounded(g.select("entity", (F.col("sd") * w).alias("local_risk"), (F.col("tail") * w).alias("tail_risk")), 8)


@B.query("j03_asof_without_key", f"""with {B.DENSE}, a as (select date, exp(sum(ln(1 + r)) over (order by date)) as e from dn where entity = 'ASIA'), b as (select date, exp(sum(ln(1 + r)) over (order by date)) as s from dn where entity = 'EUROPE' and extract('day' from date) % 3 = 0), m as (select a.date, max(b.date) as d from a join b on b.date <= a.date group by 1) select a.date, round(e, 6) as equity, round(s, 6) as sleeve from a left join m using (date) left join b on b.date = m.d""")
def j03(spark, d):
    dn = B.dense(spark, d)
    run = lambda k: F.exp(F.sum(F.log1p("r")).over(W.partitionBy("entity").orderBy("date"))).alias(k)
    a = dn.where("entity = 'ASIA'").select("date", run("equity"))
    b = dn.where("entity = 'EUROPE' and day(date) % 3 = 0").select("date", run("sleeve"))
    return X.rounded(J.asof_join(a, b, by=[], left_ts="date", right_ts="date", slices="month").select("date", "equity", F.col("r_sleeve").alias("sleeve")))


@B.query("j08_exact_else_asof", f"""with {B.PX}, e as (select event_id, user_id % 100 + 1 as entity, (ts + interval 1277 day)::date as date from events), m as (select event_id, max(px.date) as d from e join px on px.entity = e.entity and px.date <= e.date group by 1) select event_id, round(px.volume, 2) as volume, case when m.d = e.date then 'exact' when m.d is not null then 'asof' end as how from e left join m using (event_id) left join px on px.entity = e.entity and px.date = m.d""")
def j08(spark, d):
    e = B.table(spark, d, "events").select("event_id", (F.col("user_id") % 100 + 1).alias("entity"), F.to_date(F.col("ts") + F.expr("interval 1277 day")).alias("date"))
    p = B.prices(spark, d).select("entity", "date", "volume")
    exact = e.join(p, ["entity", "date"]).select("event_id", "volume", F.lit("exact").alias("how"))
    rest = J.asof_join(e.join(p, ["entity", "date"], "left_anti"), p, by=["entity"], left_ts="date", right_ts="date")
    return X.rounded(exact.union(rest.select("event_id", F.col("r_volume").alias("volume"), F.when(F.col("r_date").isNotNull(), "asof"))), 2)


@B.query("j15_membership_universe", f"""with {B.PX}, m as (select entity from px where date < date '1996-01-01' group by 1 having sum(volume) > 100), k as (select count(*) as n from m), u as (select count(distinct entity) as n from px) select entity, count(*) as n from px where (select k.n >= greatest(20, 0.25 * u.n) from k, u) and entity in (select entity from m) or not (select k.n >= greatest(20, 0.25 * u.n) from k, u) group by 1""")
def j15(spark, d):
    p = B.prices(spark, d)
    m = p.where("date < date '1996-01-01'").groupBy("entity").agg(F.sum("volume").alias("v")).where("v > 100").select("entity")
    enough = m.agg(F.count("*").alias("k")).crossJoin(p.agg(F.countDistinct("entity").alias("u"))).select((F.col("k") >= F.greatest(F.lit(20), 0.25 * F.col("u"))).alias("enough"))  # one row each
    x = p.join(m.withColumn("member", F.lit(True)), "entity", "left").crossJoin(F.broadcast(enough))
    return x.where("member or not enough").groupBy("entity").agg(F.count("*").alias("n"))


@B.query("j17_window_prices", f"""with {B.PX}, w as (select entity, date_trunc('month', date)::date as month, min(date) as a, max(date) as b from px group by 1, 2) select w.entity, month, a as entry_date, b as exit_date, round(y.close / x.close - 1 + 1e-10, 6) as ret from w join px x on x.entity = w.entity and x.date = a join px y on y.entity = w.entity and y.date = b""")
def j17(spark, d):
    p = B.prices(spark, d)
    w = p.groupBy("entity", F.to_date(F.trunc("date", "month")).alias("month")).agg(F.min("date").alias("entry_date"), F.max("date").alias("exit_date"))
    at = lambda c, v: p.select("entity", F.col("date").alias(c), F.col("close").alias(v))
    x = w.join(at("entry_date", "c0"), ["entity", "entry_date"]).join(at("exit_date", "c1"), ["entity", "exit_date"])
    return X.rounded(x.select("entity", "month", "entry_date", "exit_date", (F.col("c1") / F.col("c0") - 1 + 1e-10).alias("ret")))


@B.query("j20_survivorship_compare", f"""with {B.PX}, s as (select entity from px group by 1 having max(date) >= date '2001-06-01'), a as (select avg(r) * 1e4 as m, stddev_samp(r) as s from px), b as (select avg(r) * 1e4 as m, stddev_samp(r) as s from px where entity in (select entity from s)) select 'mean_bp' as metric, round(a.m, 6) as before, round(b.m, 6) as after, round(b.m - a.m, 6) as delta, round(b.m, 6) > round(a.m, 6) as inflated from a, b union all select 'sd', round(a.s, 6), round(b.s, 6), round(b.s - a.s, 6), round(b.s, 6) > round(a.s, 6) from a, b""")
def j20(spark, d):
    p = B.prices(spark, d)
    s = p.groupBy("entity").agg(F.max("date").alias("m")).where("m >= date '2001-06-01'")
    agg = lambda x: x.agg((F.avg("r") * 1e4).alias("mean_bp"), F.stddev_samp("r").alias("sd")).unpivot([], ["mean_bp", "sd"], "metric", "value")
    x = agg(p).withColumnRenamed("value", "before").join(agg(p.join(s, "entity", "left_semi")).withColumnRenamed("value", "after"), "metric")
    return X.rounded(x.withColumn("delta", F.col("after") - F.col("before")).withColumn("inflated", F.round("after", 6) > F.round("before", 6)))


@B.query("j21_carry_validation", f"""with {B.RATES}, ra as (select country, avg(rate) as rate from rt where tenor <= 2 group by 1), pn as (select country, date, avg(rate) as lv from rt group by 1, 2),
x as (select a.country as l, b.country as s, a.date, a.lv / nullif(b.lv, 0) as q from pn a join pn b using (date) where a.country <> b.country and a.lv / nullif(b.lv, 0) > 0),
y as (select *, ln(q) - ln(lag(q) over w) as r, q / max(q) over (w rows between unbounded preceding and current row) - 1 as dd, row_number() over w as k, row_number() over (partition by l, s order by date desc) as back, count(*) over (partition by l, s) as n from x window w as (partition by l, s order by date)),
m as (select l, s, any_value(n) as n, stddev_samp(r) * sqrt(252.0::double) * 100 as vol, min(dd) * 100 as mdd, (max(q) filter (where back = 1) / max(q) filter (where back = least(n, 252)) - 1) * 100 as trend from y group by 1, 2),
g as (select l, s, n, p.rate - o.rate as spread, case when n >= 60 then vol end as vol, case when n >= 60 then mdd end as mdd, case when n >= 60 then trend end as trend from m join ra p on p.country = l join ra o on o.country = s),
h as (select median(spread) as mid, greatest(quantile_cont(spread, 0.75) - quantile_cont(spread, 0.25), 1e-9) as iqr from g),
f as (select *, spread - 0.25 * coalesce(vol, 20) - 0.1 * coalesce(abs(mdd), 20) as adjusted from g, h)
select l as long, s as short, n, round(spread, 5) as spread, round(vol, 5) as vol, round(mdd, 5) as max_drawdown, round(trend, 5) as trend, round((spread - mid) / iqr, 5) as z, round(spread / nullif(vol, 0), 5) as coverage, round(adjusted, 5) as adjusted, round(spread, 9) > 0 and round(adjusted, 9) > 0 as admissible from f""")
def j21(spark, d):
    r = B.rates(spark, d)
    rate = r.where("tenor <= 2").groupBy("country").agg(F.avg("rate").alias("rate"))
    return X.rounded(K.carry_validation(r.groupBy("country", "date").agg(F.avg("rate").alias("lv")), rate), 5)


@B.query("w35_score_books", f"""with {B.PX}, {B.SECTORS}, f as (select entity, sector, avg(r) * 1e4 as m, stddev_samp(r) * 100 as v, avg(volume) as q from px join sectors using (entity) group by 1, 2), l as (select entity, sector, feature, x from (unpivot f on m, v, q into name feature value x)), a as (select *, median(x) over (partition by sector, feature) as mid, count(x) over (partition by sector, feature) as n from l), b as (select *, median(abs(x - mid)) over (partition by sector, feature) * 1.4826::double as mad from a),
z as (select entity, feature, case when n >= 3 then greatest(least((x - mid) / case when mad > 1e-12 then mad end, 3.0), -3.0) end as z from b), k as (select * from (values ('trend', 'm', 1.0::double), ('trend', 'v', -0.5), ('calm', 'v', -1.0), ('liquid', 'q', 1.0), ('liquid', 'm', 0.25)) t(book, feature, coef)) select book, entity, round(sum(coef * z), 6) as score from z join k using (feature) group by 1, 2""")
def w35(spark, d):
    f = B.prices(spark, d).join(B.sectors(spark, d), "entity").groupBy("entity", "sector").agg((F.avg("r") * 1e4).alias("m"), (F.stddev_samp("r") * 100).alias("v"), F.avg("volume").alias("q"))
    z = P.mad_z(f.unpivot(["entity", "sector"], ["m", "v", "q"], "feature", "x"), "x", "sector", "feature")
    k = spark.sql("select * from values ('trend', 'm', 1D), ('trend', 'v', -0.5D), ('calm', 'v', -1D), ('liquid', 'q', 1D), ('liquid', 'm', 0.25D) as t(book, feature, coef)")
    return X.rounded(z.join(F.broadcast(k), "feature").groupBy("book", "entity").agg(F.sum(F.col("coef") * F.col("z_x")).alias("score")))  # a table of coefficients


def _cond(days: str, otherwise: str) -> str:
    return f"case when count(*) filter (where {days}) > {K2.FEW} and abs(avg(rb) filter (where {days})) > 1e-12 then avg(r) filter (where {days}) / avg(rb) filter (where {days}) else {otherwise} end"


_Z_ALL = [*K2.FEATURES, *[k for k in K2.DERIVED if k != "tail_beta"], "crowding"]


def _robust(src: str, names: list[str], out: str) -> str:
    mid, far = ", ".join(f"median({v}) as m_{v}, stddev_pop({v}) as s_{v}" for v in names), ", ".join(f"median(abs({v} - m_{v})) as d_{v}" for v in names)
    z = ", ".join(f"greatest(least(({v} - m_{v}) / case when d_{v} * 1.4826::double > 1e-12 then d_{v} * 1.4826::double when s_{v} > 1e-12 then s_{v} else 1 end, 3.0), -3.0) as z_{v}" for v in names)
    return f"{out}m as (select {mid} from {src}), {out}d as (select {far} from {src}, {out}m), {out} as (select {src}.*, {z} from {src}, {out}m, {out}d)"


def _books_sql() -> str:
    """The books one after the other, each with its floor."""
    steps, at = [], "wz"
    for k, (book, (_, _, gate, _)) in enumerate(K2.BOOKS.items()):
        steps.append(f"wb{k}r as (select *, {K2.terms(book)} as raw from {at})")
        least = "raw" if book == K2.FLOOR_BOOK else K2.FLOOR_BOOK
        value = f"case when {K2.GATES[gate]} then raw else min({least}) over () - {K2.FLOOR}::double end" if gate else "raw"
        steps.append(f"wb{k} as (select * exclude (raw), {value} as {book} from wb{k}r)")
        at = f"wb{k}"
    return ", ".join(steps) + f", wl as (select entity, book, score from (unpivot (select entity, {', '.join(K2.BOOKS)} from {at}) on {', '.join(K2.BOOKS)} into name book value score))"


_WB = f"""wd as (select * from mk order by date desc limit 504), wq as (select quantile_cont(rb, {K2.TAIL}) as low, quantile_cont(rb, {K2.TOP}) as high from wd),
wx as (select entity, date, r, rb, low, high, row_number() over (partition by entity order by date desc) as k, sum(ln(1 + r)) over (partition by entity order by date) as up, case when count(r) over l = 21 then (sum(r) over l > 1e-12)::int::double end as trend from px join wd using (date), wq window l as (partition by entity order by date rows between 20 preceding and current row)),
wy as (select *, exp(up - max(up) over (partition by entity order by date)) - 1 as dd from wx), wr as (select entity, regr_slope(r, rb) as b, regr_intercept(r, rb) as a, quantile_cont(-r, 0.95) as q from wy group by 1),
we as (select wy.*, q, case when k <= 126 then r - coalesce(a + b * rb, 0) end as e, round(rb, 12) <= round(low, 12) as tail, round(rb, 12) >= round(high, 12) as top from wy join wr using (entity)),
wf as (select entity, avg(e) * 252 as resid_mom, avg(e) / (stddev_samp(e) + 1e-12) * sqrt(252.0::double) as resid_ir, {_cond("rb > 0", "0.0")} as upside_beta, {_cond("rb < 0", "1.0")} as downside_beta, {_cond("tail", "1.0")} as tail_beta0,
  case when count(*) filter (where tail) > {K2.FEW} then greatest(-avg(r) filter (where tail), 0.0) else avg(-r) filter (where round(-r, 12) >= round(q, 12)) end as tail_loss, {_cond("top", _cond("rb > 0", "0.0"))} as large_up_beta,
  case when count(*) filter (where top) > {K2.FEW} then avg((r > rb)::int::double) filter (where top) else 0 end as upside_hit, case when count(*) filter (where top) > {K2.FEW} then avg(r - rb) filter (where top) * 252 else 0 end as upside_excess,
  case when count(*) filter (where top) > {K2.FEW} then sqrt(avg(pow(greatest(r, 0.0), 2)) filter (where top)) * sqrt(252.0::double) else 0 end as upside_power, coalesce(avg(trend), 0) as trend_quality, max(dd) filter (where k = 1) - min(dd) as recovery, case when count(r) > 30 then -quantile_cont(r, {K2.CRASH}) else 0 end as crash,
  avg(r) filter (where k <= 126) * 252 as mom, avg(r) filter (where k <= 63) * 252 as mom_63, avg(r) filter (where k <= 252) * 252 as mom_252, avg(r) * 252 as total, sqrt(avg(pow(least(r, 0.0), 2))) * sqrt(252.0::double) as downside, avg(-r) filter (where round(-r, 12) >= round(q, 12)) as cvar, -min(dd) as drawdown from we group by 1),
wg as (select entity, date, coalesce(px.r, 0.0::double) as x from wd cross join (select distinct entity from wx) left join px using (entity, date)), wc as (select a.entity, avg(c) as crowding from (select a.entity, b.entity as other, corr(a.x, b.x) as c from wg a join wg b using (date) where a.entity <> b.entity group by 1, 2) a group by 1),
wh as (select wf.* exclude (tail_beta0), {K2.DERIVED["tail_beta"].replace("tail_beta", "tail_beta0")} as tail_beta, {", ".join(f"{v.replace('tail_beta', 'tail_beta0')} as {k}" for k, v in K2.DERIVED.items() if k != "tail_beta")}, coalesce(crowding, 0) as crowding, s_acctbal as fundamental
  from wf left join wc using (entity) join supplier on s_suppkey = wf.entity), {_robust("wh", _Z_ALL, "wi")}, wj as (select *, greatest(z_crowding, 0) as crowd, {K2.REAL_CONVEXITY} as real_convexity from wi), {_robust("wj", ["real_convexity"], "wz")}, {_books_sql()},
wm as (select *, greatest(score - min(score) over (partition by book) + 1e-6, 1e-6) as raw from wl), wn as (select *, raw / sum(raw) over (partition by book) as w from wm), wo as (select *, least(w, 0.1) as c from wn),
wp as (select *, c + case when 1 - sum(c) over b > 1e-12 and sum(0.1 - c) over b > 0 then least(1 - sum(c) over b, sum(0.1 - c) over b) * (0.1 - c) / sum(0.1 - c) over b else 0 end as capped from wo window b as (partition by book))"""


@B.query("w35_eighteen_books", f"""with {B.PX}, {B.MARKET}, {_WB} select book, entity, round(score, 6) as score, round(capped / sum(capped) over (partition by book), 6) as weight from wp""")
def w35_books(spark, d):
    """All books over suppliers on the last 504 days, with the account's balance as fundamental score; no weight above a tenth."""
    p = B.prices(spark, d)
    mk = B.market(p)
    own = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").cast("double").alias("fundamental"))
    x = K2.window_features(p, mk).join(K2.mean_correlation(p, mk), "entity", "left").join(own, "entity")
    return X.rounded(K2.book_weights(K2.book_scores(x), 0.1))


@B.query("w39_snapshot_weights", f"""with {B.PX}, k as (select *, row_number() over (partition by entity order by date desc) as k from px), s as (select entity, exp(sum(ln(1 + r))) - 1 as t, sqrt(avg(pow(least(r, 0.0), 2))) as dn, stddev_samp(r) as v from k where k <= 126 group by 1), o as (select *, row_number() over (order by round(t / nullif(dn, 0), 9) desc nulls last, entity) as o from s) select entity, round((1 / v) / sum(1 / v) over (), 6) as weight from o where o <= 10""")
def w39(spark, d):
    k = B.prices(spark, d).withColumn("k", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("date")))).where("k <= 126")
    s = k.groupBy("entity").agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("t"), F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2))).alias("dn"), F.stddev_samp("r").alias("v"))
    top = s.withColumn("score", F.round(X.ratio("t", "dn"), 9)).orderBy(F.desc_nulls_last("score"), "entity").limit(10)
    return X.rounded(top.select("entity", (X.ratio(F.lit(1.0), "v") / F.sum(X.ratio(F.lit(1.0), "v")).over(W.partitionBy())).alias("weight")))


@B.query("w46_fixed_sleeve", f"""with {B.PX}, w as (select * from (values (1, 0.3::double), (2, 0.3), (999999, 0.2)) t(entity, w)), d as (select distinct date from px) select d.date, round(sum(w.w * coalesce(px.r, 0)), 8) as r, round(1 - sum(case when px.r is not null then w.w else 0 end), 6) as cash from d cross join w left join px on px.entity = w.entity and px.date = d.date group by 1""")
def w46(spark, d):
    p = B.prices(spark, d)
    w = spark.sql("select * from values (1L, 0.3D), (2L, 0.3D), (999999L, 0.2D) as t(entity, w)")
    held = p.join(F.broadcast(w), "entity").groupBy("date").agg(F.sum(F.col("w") * F.col("r")).alias("r"), F.sum("w").alias("in"))  # fixed names
    x = p.select("date").distinct().join(held, "date", "left")
    return x.select("date", F.round(F.coalesce("r", F.lit(0.0)), 8).alias("r"), F.round(1 - F.coalesce("in", F.lit(0.0)), 6).alias("cash"))


@B.query("w47_factor_returns", f"""with {B.DENSE}, w as (select date, avg(r) as market, max(r) filter (where entity = 'EUROPE') - max(r) filter (where entity = 'ASIA') as spread, sum(volume) as volume from dn group by 1) select date, round(market, 6) as market, round(spread, 6) as spread, round(volume / lag(volume) over (order by date) - 1, 6) as volume_change from w""")
def w47(spark, d):
    at = lambda k: F.max(F.when(F.col("entity") == k, F.col("r")))
    w = B.dense(spark, d).groupBy("date").agg(F.avg("r").alias("market"), (at("EUROPE") - at("ASIA")).alias("spread"), F.sum("volume").alias("volume"))
    return X.rounded(w.select("date", (F.col("market")).alias("market"), "spread", (X.ratio("volume", F.lag("volume").over(W.orderBy("date"))) - 1).alias("volume_change")))  # one row a day


@B.query("b10_bootstrap_selection", f"""with {B.TRIALS}, {B.SECTORS}, top as (select trial as id, sector as g from (select trial from tr group by 1 order by count(*) desc, trial limit 12) join sectors on entity = trial),
cb as (select [a.id, b.id, c.id] as members from top a join top b on b.id > a.id join top c on c.id > b.id where not (a.g = b.g and b.g = c.g)),
mo as (select distinct month from tr), cr as (select members, month, round(sum(coalesce(r, 0)) / 3, 12) as r from (select members, unnest(members) as trial from cb) cross join mo left join tr using (trial, month) group by 1, 2),
dr as (select rep, month, floor((('0x' || substr(md5('3|' || rep || '|' || month), 1, 8))::ubigint / 4294967296.0::double) * 3)::int as k from range(64) t(rep), mo),
x as (select rep, members, round((sum(k * r) / sum(k)) / nullif(sqrt(sum(k * pow(least(r, 0.0), 2)) / sum(k)), 0), 9) as s from dr join cr using (month) group by 1, 2),
b as (select rep, members, row_number() over (partition by rep order by s desc nulls last, members) as o from x)
select trial, round(count(*) / 64.0::double, 6) as selected from (select unnest(members) as trial from b where o = 1) group by 1""")
def b10(spark, d):
    t = B.trials(spark, d)
    top = t.groupBy("trial").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "trial").limit(12)  # the candidates, from which combinations are made
    named = top.join(B.sectors(spark, d), F.col("trial") == F.col("entity")).select(F.col("trial").alias("id"), F.col("sector").alias("g"))
    return X.rounded(S.combination_stability(J.combinations(named, 3, "g", 2), t, "trial", "month", "r", reps=64, seed=3))
