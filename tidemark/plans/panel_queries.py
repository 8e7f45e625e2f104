"""Window queries (W) over the price panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import panel as P
from tidemark.plans import base as B

ROWS = "partition by entity order by date"


def _avg(x: str, n: int, least: int | None = None, f: str = "avg") -> str:
    over = f"(partition by entity order by date rows between {n - 1} preceding and current row)"
    return f"case when count({x}) over {over} >= {least or n} then {f}({x}) over {over} end"


@B.query("w01_momentum", f"with {B.PX} select entity, date, " + ", ".join(f"round(close / lag(close, {n}) over ({ROWS}) - 1, 6) as mom_{n}" for n in (21, 63, 126, 252)) + f", round(lag(close, 21) over ({ROWS}) / lag(close, 252) over ({ROWS}) - 1, 6) as mom_12_1 from px")
def w01(spark, d):
    return X.rounded(P.momentum(B.prices(spark, d)).select("entity", "date", "mom_21", "mom_63", "mom_126", "mom_252", "mom_12_1"))


@B.query("w02_moving_averages", f"""with {B.PX}, m as (select entity, date, close, {', '.join(f'{_avg("close", n)} as ma_{n}' for n in (50, 63, 126, 200))} from px)
select entity, date, round(ma_50, 6) as ma_50, round(ma_63, 6) as ma_63, round(ma_126, 6) as ma_126, round(ma_200, 6) as ma_200,
case when ma_200 is null then 'unknown' when close > ma_50 and ma_50 > ma_200 then 'up' when close < ma_50 and ma_50 < ma_200 then 'down' else 'mixed' end as trend from m""")
def w02(spark, d):
    return X.rounded(P.trend(B.prices(spark, d)).select("entity", "date", "ma_50", "ma_63", "ma_126", "ma_200", "trend"))


@B.query("w03_rolling_risk", f"""with {B.DENSE} select entity, date, round({_avg('r', 63, 20, 'stddev_samp')} * sqrt(252.0), 6) as vol, round(sqrt({_avg('pow(least(r, 0.0), 2)', 63, 20)}) * sqrt(252.0), 6) as downside from dn""")
def w03(spark, d):
    return X.rounded(P.rolling_risk(B.dense(spark, d)).select("entity", "date", "vol", "downside"))


@B.query("w04_rolling_z", f"""with {B.DENSE} select entity, date, round((volume - {_avg('volume', 252, 60)}) / nullif({_avg('volume', 252, 60, 'stddev_samp')}, 0), 6) as z from dn""")
def w04(spark, d):
    return X.rounded(P.rolling_z(B.dense(spark, d), "volume").select("entity", "date", "z"))


@B.query("w05_forward_fill", f"""with {B.DENSE}, cal as (select distinct date from dn), ent as (select distinct entity from dn),
g as (select entity, date, close from cal cross join ent left join dn using (entity, date))
select entity, date, close, last_value(close ignore nulls) over (partition by entity order by date rows between unbounded preceding and current row) as carried from g""")
def w05(spark, d):
    dn = B.dense(spark, d)
    grid = dn.select("date").distinct().crossJoin(F.broadcast(dn.select("entity").distinct()))  # five regions
    return P.carried(grid.join(dn.select("entity", "date", "close"), ["entity", "date"], "left"), "close").select("entity", "date", "close", "carried")


@B.query("w06_breadth", f"""with {B.PX}, a as (select *, {_avg('close', 50)} as ma from px)
select date, round(avg((close > ma)::int::double), 6) as above_ma, round(avg((r > 0)::int::double), 6) as positive, count(*) as entities from a group by date""")
def w06(spark, d):
    return X.rounded(P.breadth(B.prices(spark, d)))


_UP = "(partition by entity order by date rows between unbounded preceding and current row)"


@B.query("w07_drawdown_path", f"""with {B.DENSE}, i as (select entity, date, exp(sum(ln(1 + greatest(r, -0.999999))) over {_UP}) as idx from dn),
p as (select *, greatest(max(idx) over {_UP}, 1.0) as peak from i) select entity, date, round(idx, 8) as index, round(peak, 8) as peak, round(idx / peak - 1, 8) as drawdown from p""")
def w07(spark, d):
    return X.rounded(P.drawdown_path(B.dense(spark, d)).select("entity", "date", "index", "peak", "drawdown"), 8)


@B.query("w09_percentile_rank", f"""with {B.PX} select entity, date, round((rank() over (partition by date order by volume) + (count(*) over (partition by date, volume) - 1) / 2.0) / count(*) over (partition by date), 6) as pct from px""")
def w09(spark, d):
    return X.rounded(P.percentile_rank(B.prices(spark, d), "volume", "date").select("entity", "date", "pct"))


@B.query("w10_top_weights", f"""with {B.PX}, c as (select *, row_number() over (partition by date order by volume desc, entity) as rank from px),
t as (select *, count(*) over (partition by date) - rank + 1 as points from c where rank <= 5)
select date, entity, rank, round(points / sum(points) over (partition by date), 6) as weight from t""")
def w10(spark, d):
    return X.rounded(P.top_weights(B.prices(spark, d), "volume", 5, "date").select("date", "entity", F.col("rank").cast("long").alias("rank"), "weight"))


@B.query("w11_group_robust_z", f"""with {B.PX}, {B.SECTORS}, m as (select entity, sector, avg(volume) as x from px join sectors using (entity) group by 1, 2),
s as (select *, count(x) over g as n, case when n >= 4 then median(x) over g else median(x) over () end as mid,
case when n >= 4 then quantile_cont(x, 0.75) over g - quantile_cont(x, 0.25) over g else quantile_cont(x, 0.75) over () - quantile_cont(x, 0.25) over () end as iqr from m window g as (partition by sector))
select entity, sector, round(greatest(least((x - mid) / case when abs(iqr) > 1e-12 then iqr end, 8.0), -8.0), 6) as z from s""")
def w11(spark, d):
    x = B.prices(spark, d).join(B.sectors(spark, d), "entity").groupBy("entity", "sector").agg(F.avg("volume").alias("x"))
    return X.rounded(P.group_robust_z(x, "x", "sector").select("entity", "sector", F.col("z_x").alias("z")))


@B.query("w12_mad_z", f"""with {B.PX}, {B.SECTORS}, m as (select entity, sector, avg(volume) as x from px join sectors using (entity) group by 1, 2),
a as (select *, median(x) over (partition by sector) as mid, count(x) over (partition by sector) as n from m),
b as (select *, median(abs(x - mid)) over (partition by sector) * 1.4826::double as mad from a)
select entity, sector, case when n >= 5 then round(greatest(least((x - mid) / case when mad > 1e-12 then mad end, 3.0), -3.0), 6) end as z from b""")
def w12(spark, d):
    x = B.prices(spark, d).join(B.sectors(spark, d), "entity").groupBy("entity", "sector").agg(F.avg("volume").alias("x"))
    return X.rounded(P.mad_z(x, "x", "sector", least=5).select("entity", "sector", F.col("z_x").alias("z")))


_W126 = "(partition by entity order by date rows between 125 preceding and current row)"


@B.query("w16_residual_momentum", f"""with {B.DENSE}, mk as (select date, round(avg(r), 10) as rb from dn group by date),
a as (select entity, date, r, rb, case when count(r) over {_W126} >= 63 then covar_samp(r, rb) over {_W126} / nullif(var_samp(rb) over {_W126}, 0) end as beta, avg(r) over {_W126} as mr, avg(rb) over {_W126} as mb from dn join mk using (date)),
b as (select *, r - (mr - beta * mb) - beta * rb as residual from a)
select entity, date, round(beta, 6) as beta, round({_avg('residual', 126, 63, 'stddev_samp')} * sqrt(252.0), 6) as idio_vol,
round({_avg('residual', 126, 63)} / nullif({_avg('residual', 126, 63, 'stddev_samp')}, 0) * sqrt(252.0), 6) as residual_ir,
case when count(residual) over {_W126} >= 63 then round(exp(sum(ln(1 + greatest(residual, -0.999999))) over {_W126}) - 1, 6) end as residual_mom from b""")
def w16(spark, d):
    dn = B.dense(spark, d)
    return X.rounded(P.market_residuals(dn, B.market(dn)).select("entity", "date", "beta", "idio_vol", "residual_ir", "residual_mom"))


@B.query("w18_exposure_state", f"""with {B.DENSE}, a as (select entity, date, (close < {_avg('close', 126)})::int::double as below, close / max(close) over (partition by entity order by date rows between 251 preceding and current row) - 1 as dd,
{_avg('r', 21, None, 'stddev_samp')} / nullif({_avg('r', 126, None, 'stddev_samp')}, 0) as vr, sqrt({_avg('pow(least(r, 0.0), 2)', 63)}) / nullif({_avg('r', 63, None, 'stddev_samp')}, 0) as dr from dn)
select entity, date, round(greatest(least(1 - (0.25 * coalesce(below, 0) + greatest(least(abs(dd), 0.4), 0) + 0.2 * greatest(least(coalesce(vr, 1.0) - 1, 1.0), 0) + 0.2 * greatest(least(coalesce(dr, 0.7) - 0.7, 1.0), 0)), 1.0), 0.25), 6) as exposure from a""")
def w18(spark, d):
    return X.rounded(P.exposure_state(B.dense(spark, d)).select("entity", "date", "exposure"))


_REGIME = f"""rg as (select entity, date, r, close / lag(close, 63) over ({ROWS}) - 1 as t, {_avg('r', 21, None, 'stddev_samp')} / nullif({_avg('r', 126, None, 'stddev_samp')}, 0) as v from dn),
rl as (select entity, date, r, case when t is null or v is null then 'unknown' else (case when t >= 0 then 'bull' else 'bear' end) || (case when v > 1.25 then '_stress' when v < 0.8 then '_calm' else '_normal' end) end as regime from rg)"""


@B.query("w19_regime_labels", f"with {B.DENSE}, {_REGIME} select entity, date, regime from rl")
def w19(spark, d):
    return P.regime(B.dense(spark, d)).select("entity", "date", "regime")


@B.query("w21_markov_transitions", f"""with {B.DENSE}, {_REGIME}, n as (select entity, regime as "from", lead(regime) over ({ROWS}) as "to" from rl),
c as (select entity, "from", "to", count(*) as n from n where "to" is not null group by 1, 2, 3)
select entity, "from", "to", n, round((n + 1.0) / (sum(n) over (partition by entity, "from") + 1.0 * (select count(distinct regime) from rl)), 6) as p from c""")
def w21(spark, d):
    return X.rounded(P.transitions(P.regime(B.dense(spark, d)), "regime"))


_SEEN = lambda k: f"sum((f = {k})::int) over u"


@B.query("w21_expanding_transition", f"""with {B.DENSE}, s as (select entity, date, (r < 0)::int as s from dn), q as (select *, lag(s) over ({ROWS}) as f from s),
c as (select *, coalesce({_SEEN(0)}, 0) as n0, coalesce({_SEEN(1)}, 0) as n1, coalesce(sum((f = 0 and s = 1)::int) over u, 0) as k0, coalesce(sum((f = 1 and s = 1)::int) over u, 0) as k1 from q window u as (partition by entity order by date rows between unbounded preceding and current row))
select entity, date, s as state, case when s = 1 then n1 else n0 end::bigint as n, round((case when s = 1 then k1 else k0 end + 1.0::double) / (case when s = 1 then n1 else n0 end + 2.0::double), 6) as p from c""")
def w21b(spark, d):
    x = B.dense(spark, d).withColumn("state", (F.col("r") < 0).cast("int"))
    return X.rounded(P.expanding_transition(x, "state", 1))


@B.query("w22_runs_and_gaps", f"""with {B.PX}, f as (select entity, date, r = 0 as st, abs(r) > 0.04 as jump, date - lag(date) over ({ROWS}) as gap from px),
i as (select *, sum(case when coalesce(st, false) then 0 else 1 end) over {_UP} as island from f),
n as (select entity, island, sum(coalesce(st, false)::int) as n from i group by 1, 2)
select entity, (select max(n) from n where n.entity = f.entity)::bigint as longest_run, sum(jump::int)::bigint as jumps, max(gap)::int as longest_gap from f group by entity""")
def w22(spark, d):
    p = B.prices(spark, d)
    w = X.by("entity", "date")
    stale = P.runs(p, F.col("r") == 0)
    rest = p.withColumn("gap", F.date_diff("date", F.lag("date").over(w))).groupBy("entity").agg(F.sum((F.abs("r") > 0.04).cast("long")).alias("jumps"), F.max("gap").alias("longest_gap"))
    return stale.join(rest, "entity")


@B.query("w38_capped_weights", f"""with recursive {B.PX}, m as (select entity, sum(volume) as v from px group by 1), b as (select entity, v, v / sum(v) over () as w, count(*) over () as n from m),
o as (select entity, w, greatest(0.02::double, 1.0 / n) as cap, row_number() over (order by w desc, entity) - 1 as k, 1 - coalesce(sum(w) over (order by w desc, entity rows between unbounded preceding and 1 preceding), 0) as rest from b),
f as (select min(k) as k from o where w * (1 - k * cap) <= cap * rest + 1e-12),
p as (select o.*, f.k as fk, (select rest from o x where x.k = f.k) as frest from o, f),
c as (select entity, least(w, 0.02::double) as c from b), r as (select *, 0.02::double - c as room, 1 - sum(c) over () as over_, sum(0.02::double - c) over () as rooms from c)
select entity, round(case when k < fk then cap else w * (1 - fk * cap) / frest end, 6) as proportional, round(c + case when over_ > 1e-12 and rooms > 0 then least(over_, rooms) * room / rooms else 0 end, 6) as by_room from p join r using (entity)""")
def w38(spark, d):
    m = B.prices(spark, d).groupBy("entity").agg(F.sum("volume").alias("v"))
    from pyspark.sql import Window as W

    m = m.withColumn("weight", F.col("v") / F.sum("v").over(W.partitionBy()))
    a = P.capped_in_proportion(m, 0.02).select("entity", F.col("capped").alias("proportional"))
    b = P.capped_by_room(m, 0.02).select("entity", F.col("capped").alias("by_room"))
    return X.rounded(a.join(b, "entity"))
