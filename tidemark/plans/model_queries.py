"""Queries over recursions, factor models and text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import linalg as L
from tidemark.operators import panel as P
from tidemark.operators import recursion as R
from tidemark.operators import risk as K
from tidemark.operators import segments as G
from tidemark.operators import spectra as S
from tidemark.operators import text as T
from tidemark.operators import variance as V
from tidemark.plans import base as B

_RN = "rn as (select entity, date, r, row_number() over (partition by entity order by date) as i, count(*) over (partition by entity) as n, var_samp(r) over (partition by entity) as v0 from dn)"


@B.query("w24_ewma_variance", f"""with {B.DENSE}, {_RN} select entity, n, round(1e6 * (max(v0) * pow(0.94::double, n) + sum(0.06::double * pow(0.94::double, n - i) * r * r)), 6) as ewma_variance_e6 from rn group by entity, n""")
def w24(spark, d):
    x = R.ewma_variance(B.dense(spark, d))
    return X.rounded(x.select("entity", "n", (F.col("ewma_variance") * 1e6).alias("ewma_variance_e6")))


@B.query("w25_power_law_variance", f"""with {B.PX}, k as (select entity, r, row_number() over (partition by entity order by date desc) as k from px) select entity, count(*) as n, case when count(*) >= 20 then round(1e6 * sum(pow(k, -0.6) * r * r) / sum(pow(k, -0.6)), 6) end as v_e6 from k where k <= 60 group by entity""")
def w25(spark, d):
    x = R.power_law_variance(B.prices(spark, d))
    return X.rounded(x.select("entity", "n", (F.col("power_law_variance") * 1e6).alias("v_e6")))


_INC = ", ".join(f"avg(pow(l - l{k}, 2)) as m{k}" for k in (1, 2, 4, 8, 16))


@B.query("w26_roughness", f"""with {B.DENSE}, v as (select entity, date, case when count(r) over w >= 5 then stddev_samp(r) over w end as vol from dn window w as (partition by entity order by date rows between 20 preceding and current row)), l as (select entity, date, ln(vol) as l from v where vol > 0),
g as (select entity, l, """ + ", ".join(f"lag(l, {k}) over (partition by entity order by date) as l{k}" for k in (1, 2, 4, 8, 16)) + f""" from l), m as (select entity, {_INC} from g group by 1),
u as (select entity, k, m from (select entity, unnest([1, 2, 4, 8, 16]) as k, unnest([m1, m2, m4, m8, m16]) as m from m) where m > 0) select entity, round(regr_slope(ln(m), ln(k)) / 2, 6) as roughness, round(regr_r2(ln(m), ln(k)), 6) as r2 from u group by entity""")
def w26(spark, d):
    v = B.dense(spark, d).withColumn("vol", X.rolling(F.stddev_samp, "r", X.by("entity", "date"), 21, 5))
    return X.rounded(R.roughness(v))


_REC = "with recursive "


@B.query("w27_local_level", f"""{_REC}{B.DENSE}, {_RN}, f(entity, i, n, m, p, k) as (select distinct entity, 0::bigint, n, 0.0::double, 1.0::double, 0.0::double from rn union all
select f.entity, rn.i, f.n, f.m + (f.p + 0.01) / (f.p + 0.01 + 1) * (rn.r - f.m), (1 - (f.p + 0.01) / (f.p + 0.01 + 1)) * (f.p + 0.01), (f.p + 0.01) / (f.p + 0.01 + 1) from f join rn on rn.entity = f.entity and rn.i = f.i + 1)
select entity, n, round(m * 1e3, 6) as level_e3, round(k, 6) as gain from f where i = n""")
def w27(spark, d):
    x = R.local_level(B.dense(spark, d))
    return X.rounded(x.select("entity", "n", (F.col("level") * 1e3).alias("level_e3"), "gain"))


_GRID = "(values ('const', 0.0::double, 0.0::double, 1), ('arch', 0.1, 0.0, 2), ('arch', 0.3, 0.0, 2), ('garch', 0.05, 0.9, 3), ('garch', 0.1, 0.8, 3), ('garch', 0.05, 0.5, 3)) g(model, alpha, beta, k)"


def _grid(spark):
    return spark.sql("select * from values ('const', 0D, 0D, 1), ('arch', 0.1D, 0D, 2), ('arch', 0.3D, 0D, 2), ('garch', 0.05D, 0.9D, 3), ('garch', 0.1D, 0.8D, 3), ('garch', 0.05D, 0.5D, 3) as t(model, alpha, beta, k)")


_VM = f"""{_RN}, gr as (select * from {_GRID}), vm(entity, model, alpha, beta, k, n, v0, i, v, ll) as (select distinct entity, model, alpha, beta, k, n, v0, 0::bigint, v0, 0.0::double from rn, gr union all
select f.entity, f.model, f.alpha, f.beta, f.k, f.n, f.v0, rn.i, (1 - f.alpha - f.beta) * f.v0 + f.alpha * rn.r * rn.r + f.beta * f.v, f.ll - 0.5 * (ln(2 * 3.141592653589793::double * f.v) + rn.r * rn.r / f.v) from vm f join rn on rn.entity = f.entity and rn.i = f.i + 1), vl as (select *, k * ln(n) - 2 * ll as bic from vm where i = n)"""


@B.query("w28_variance_models", f"""{_REC}{B.DENSE}, {_VM} select entity, model, alpha, beta, round(ll, 4) as ll, round(bic, 4) as bic, row_number() over (partition by entity order by round(bic, 6), model, alpha, beta) = 1 as best from vl""")
def w28(spark, d):
    x = R.variance_models(B.dense(spark, d), _grid(spark))
    return x.select("entity", "model", "alpha", "beta", F.round("ll", 4).alias("ll"), F.round("bic", 4).alias("bic"), "best")


@B.query("w29_forecast_cone", f"""{_REC}{B.DENSE}, {_VM}, b as (select *, row_number() over (partition by entity order by round(bic, 6), model, alpha, beta) as o from vl), h as (select entity, h, v0 + pow(alpha + beta, h - 1) * (v - v0) as variance from b, range(1, 22) t(h) where o = 1) select entity, h::int as h, round(variance * 1e6, 5) as variance_e6, round(1.96 * sqrt(variance), 6) as band from h""")
def w29(spark, d):
    x = B.dense(spark, d)
    best = R.variance_models(x, _grid(spark)).where("best")
    v0 = x.groupBy("entity").agg(F.var_samp("r").alias("var0"))
    c = R.forecast_cone(best.join(v0, "entity"), 21)
    return c.select("entity", "h", F.round(F.col("variance") * 1e6, 5).alias("variance_e6"), F.round("band", 6).alias("band"))


def _values(rows: list[tuple]) -> str:
    """SQL rows of fixed values."""
    lit = {type(None): lambda _: "null::double", float: lambda x: f"{x!r}::double", int: str, str: lambda x: f"'{x}'", list: lambda x: "[" + ", ".join(f"{v!r}::double" for v in x) + "]"}
    return ", ".join("(" + ", ".join(lit[type(v)](v) for v in row) + ")" for row in rows)


_VA = f"""va as (select entity, date, r, row_number() over (partition by entity order by date) - 1 as i, count(*) over (partition by entity) as n, r - avg(r) over (partition by entity) as y, var_pop(r) over (partition by entity) as v0
  from (select entity, date, r, row_number() over (partition by entity order by date desc) as k from dn where r is not null) where k <= {V.WINDOW}),
vg as (select * from (values {_values(V.grid_rows())}) t(model, a1, a2, b1, b2, nu, shift, k)),
vr(entity, model, a1, a2, b1, b2, nu, shift, k, n, i, v0, h, g, e, last, ll, q) as (
  select entity, model, a1, a2, b1, b2, nu, shift, k, n, 0::bigint, v0, v0, v0, v0, 0.0::double, 0.0::double, 0.0::double from va, vg where i = 0 and n >= {V.LEAST} and v0 > 0
  union all select f.entity, model, a1, a2, b1, b2, nu, shift, k, f.n, f.i + 1, f.v0, f.v0 * (1 - a1 - a2 - b1 - b2) + a1 * y * y + a2 * e + b1 * h + b2 * g, h, y * y, h,
    ll + shift - 0.5 * (ln(h) + case when nu is null then y * y / h else (nu + 1) * ln(1 + y * y / h / nu) end), q + y * y / h + ln(h) from vr f join va on va.entity = f.entity and va.i = f.i),
vk as (select * from (values {_values(V.kernel_rows())}) t(hurst, length, least, kernel, sums)),
vj as (select a.entity, hurst, length, least, any_value(a.n) as n, a.i, any_value(a.r) as r, greatest(sum(b.r * b.r * kernel[a.i - b.i]) / any_value(sums[least(length, a.i)]), 1e-12) as h
  from (select entity, n, i, r from va union select entity, n, n, null from va) a, vk, va b where b.entity = a.entity and b.i < a.i and b.i >= a.i - length and a.i >= least and length < a.n - 5 and a.n - least >= 40 group by all),
vm as (select *, avg(r) over (partition by entity, hurst, length) as mean from vj),
vp as (select entity, 'POWER_LAW' as model, hurst as a1, length::double as a2, 0.0::double as b1, 0.0::double as b2, null::double as nu, any_value(n) - least as n, 3 as k,
  sum(-0.5 * (ln({V.TWO_PI}::double) + ln(h) + (r - mean) * (r - mean) / h)) as ll, avg(case when r is not null then r * r / h + ln(h) end) as qlike, arg_max(h, case when r is not null then i end) as last, arg_max(h, i) as ahead
  from vm group by entity, hurst, length, least),
ve as (select *, 2 * k - 2 * ll as aic, k * ln(n) - 2 * ll as bic from (select entity, model, a1, a2, b1, b2, nu, n, k, ll, q / n as qlike, last, h as ahead from vr where i = n union all select * from vp)),
vc as (select * exclude o, round(aic, 6) = min(round(aic, 6)) over w as best_aic, round(bic, 6) = min(round(bic, 6)) over w as best_bic, round(qlike, 6) = min(round(qlike, 6)) over w as best_qlike
  from (select *, row_number() over (partition by entity, model order by round(bic, 6), a1, a2, b1, b2, coalesce(nu, 0)) as o from ve) where o = 1 window w as (partition by entity)),
vb as (select entity, arg_min(struct_pack(model := model, a1 := a1, a2 := a2, b1 := b1, b2 := b2, last := last, ahead := ahead), (round(bic, 6), model)) as b from vc where model <> 'POWER_LAW' group by entity),
vpath(entity, model, i, date, v0, h, g, e, hh, p) as (
  select va.entity, b.model, 0::bigint, null::date, v0, v0, v0, v0, null::double, 100.0::double from va join vb using (entity) where i = 0
  union all select f.entity, f.model, f.i + 1, va.date, f.v0, f.v0 * (1 - b.a1 - b.a2 - b.b1 - b.b2) + b.a1 * y * y + b.a2 * e + b.b1 * h + b.b2 * g, h, y * y, greatest(h, 1e-12), p * (1 + r) from vpath f join va on va.entity = f.entity and va.i = f.i join vb on vb.entity = f.entity),
vcone(entity, model, step, v0, h, g, e, total, price) as (
  select vpath.entity, vpath.model, 1, vpath.v0, b.ahead, b.last, y * y, b.ahead, p from vpath join va on va.entity = vpath.entity and va.i = va.n - 1 and vpath.i = va.n join vb on vb.entity = vpath.entity
  union all select f.entity, f.model, step + 1, v0, v0 * (1 - b.a1 - b.a2 - b.b1 - b.b2) + b.a1 * h + b.a2 * e + b.b1 * h + b.b2 * g, h, h, total + v0 * (1 - b.a1 - b.a2 - b.b1 - b.b2) + b.a1 * h + b.a2 * e + b.b1 * h + b.b2 * g, price
    from vcone f join vb using (entity) where step < 21)"""


@B.query("w28_variance_architectures", f"""{_REC}{B.DENSE}, {_VA} select entity, model, a1, a2, b1, b2, nu, n, k::bigint as k, round(ll, 4) as ll, round(aic, 4) as aic, round(bic, 4) as bic, round(qlike, 6) as qlike, round(last * 1e6, 4) as last_e6, round(ahead * 1e6, 4) as ahead_e6, best_aic, best_bic, best_qlike from vc""")
def w28_architectures(spark, d):
    x = V.architectures(B.dense(spark, d))
    small = [F.round(F.col(c) * 1e6, 4).alias(f"{c}_e6") for c in ("last", "ahead")]
    return x.select("entity", "model", "a1", "a2", "b1", "b2", "nu", "n", "k", *[F.round(c, 4).alias(c) for c in ("ll", "aic", "bic")], F.round("qlike", 6).alias("qlike"), *small, "best_aic", "best_bic", "best_qlike")


def _best_recursion(x):
    own = V.architectures(x).where("model <> 'POWER_LAW'")
    kept = ("model", "a1", "a2", "b1", "b2", "last", "ahead")
    return own.groupBy("entity").agg(F.min_by(F.struct(*kept), F.struct(F.round("bic", 6), "model")).alias("b")).select("entity", "b.*")


@B.query("w29_conditional_path", f"""{_REC}{B.DENSE}, {_VA} select entity, model, date, round(hh * 1e6, 4) as variance_e6, round(sqrt(hh), 6) as daily_vol, round(sqrt(hh) * sqrt(252.0::double), 6) as annual_vol, round(p, 6) as price_index, round(p * (1 + sqrt(hh)), 6) as upper, round(p * (1 - sqrt(hh)), 6) as lower from vpath where i > 0""")
def w29_path(spark, d):
    x = B.dense(spark, d)
    y = V.conditional_path(x, _best_recursion(x))
    return y.select("entity", "model", "date", F.round(F.col("variance") * 1e6, 4).alias("variance_e6"), *[F.round(c, 6).alias(c) for c in ("daily_vol", "annual_vol", "price_index", "upper", "lower")])


@B.query("w29_price_cone", f"""{_REC}{B.DENSE}, {_VA} select entity, model, step as h, round(h * 1e6, 4) as variance_e6, round(price * (1 - 1.96::double * sqrt(total)), 6) as low, round(price * (1 + 1.96::double * sqrt(total)), 6) as high from vcone""")
def w29_cone(spark, d):
    x = B.dense(spark, d)
    y = V.architecture_cone(x, _best_recursion(x), 21)
    return y.select("entity", "model", "h", F.round(F.col("variance") * 1e6, 4).alias("variance_e6"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))



def _cost(n: str, a: str, b: str) -> str:
    return f"({n} * ln(greatest(({b}) / {n} - pow(({a}) / {n}, 2), 1e-12)))"


def _split(src: str, out: str) -> str:
    p, u = "(partition by entity, segment)", "(partition by entity, segment order by date rows between unbounded preceding and current row)"
    return f"""{out}1 as (select *, count(*) over {u} as i, count(*) over {p} as n, sum(x) over {u} as s1, sum(x * x) over {u} as s2, sum(x) over {p} as t1, sum(x * x) over {p} as t2 from {src}),
{out}2 as (select *, case when i >= 21 and n - i >= 21 then round({_cost('n', 't1', 't2')} - {_cost('i', 's1', 's2')} - {_cost('(n - i)', 't1 - s1', 't2 - s2')}, 6) end as gain from {out}1 where n > i),
{out}3 as (select entity, segment, arg_min(date, (-gain, date)) as cut from {out}2 where gain > 3 * ln(n) group by 1, 2), {out} as (select s.entity, s.date, s.x, s.segment || case when cut is null then '' when date <= cut then 'a' else 'b' end as segment from {src} s left join {out}3 using (entity, segment))"""


@B.query("w30_change_points", f"""with {B.DENSE}, g0 as (select entity, date, r as x, '1' as segment from dn), {_split('g0', 'g1')}, {_split('g1', 'g2')} select entity, segment, min(date) as start, max(date) as "end", count(*) as n, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as sd from g2 group by 1, 2""")
def w30(spark, d):
    return X.rounded(R.change_points(B.dense(spark, d)))


_SGC = lambda m, a, b: f"(({m}) * (ln(greatest((({b}) - ({a}) * ({a}) / ({m})) / ({m}), {G.FLOOR}::double)) + 1))"
_SGG = f"round({_SGC('(b - a)::double', 'y.s1 - x.s1', 'y.s2 - x.s2')} - {_SGC('(c.i - a)::double', 'c.s1 - x.s1', 'c.s2 - x.s2')} - {_SGC('(b - c.i)::double', 'y.s1 - c.s1', 'y.s2 - c.s2')}, 6)"
_SGJ = f"join sp x on x.entity = sg.entity and x.i = a join sp y on y.entity = sg.entity and y.i = b join sp c on c.entity = sg.entity and c.i between a + {G.LEAST} and b - {G.LEAST}"
_SG = f"""sv as (select entity, date, r, row_number() over (partition by entity order by date) as i, count(*) over (partition by entity) as n from (select entity, date, r * case when month(date) > 6 then 3 else 1 end as r, row_number() over (partition by entity order by date desc) as k from dn where r is not null) where k <= {G.WINDOW}),
sp as (select entity, i, n, sum(r) over u as s1, sum(r * r) over u as s2 from sv where n >= {max(3 * G.LEAST, G.FEWEST)} window u as (partition by entity order by i rows between unbounded preceding and current row) union all select distinct entity, 0, n, 0.0::double, 0.0::double from sv where n >= {max(3 * G.LEAST, G.FEWEST)}),
sg(entity, n, a, b) as (select entity, n, 0::bigint, n from sp where i = 0
  union all select entity, n, unnest([a, cut]), unnest([cut, b]) from (select sg.entity, sg.n, a, b, arg_min(c.i, (-{_SGG}, c.i)) as cut, max({_SGG}) as gain from sg {_SGJ} group by 1, 2, 3, 4) where gain > 3 * ln(n)),
so as (select sg.entity, a, b from sg where not exists (select 1 from sg o where o.entity = sg.entity and o.a >= sg.a and o.b <= sg.b and (o.a > sg.a or o.b < sg.b))),
sn as (select *, row_number() over (partition by entity order by a) as segment from so),
sw as (select sn.entity, segment, i, date, r, sum(ln(1 + r)) over (partition by sn.entity, segment order by i) as up from sn join sv on sv.entity = sn.entity and i > a and i <= b), sx as (select *, max(up) over (partition by entity, segment order by i) as peak from sw),
ss as (select entity, segment, min(date) as start, max(date) as "end", count(*) as n, avg(r) as mean, avg(r) * 252 as annual_return, stddev_samp(r) * sqrt(252.0::double) as annual_vol, sqrt(coalesce(avg(case when r < 0 then r * r end), 0)) * sqrt(252.0::double) as downside_vol,
  case when var_pop(r) > 0 then skewness(r) end as skew, case when var_pop(r) > 0 then kurtosis(r) end as kurtosis, exp(sum(ln(1 + r))) - 1 as total_return, exp(min(up - peak)) - 1 as max_drawdown from sx group by 1, 2),
sr as (select *, case when round(annual_vol, 10) >= quantile_cont(round(annual_vol, 10), 0.5) over (partition by entity) then 'High variance' else 'Low variance' end || ' / ' || case when round(mean, 10) >= quantile_cont(round(mean, 10), 0.5) over (partition by entity) then 'High drift' else 'Low drift' end as regime from ss)"""


def _sized(spark, d):
    """Regional returns of a book that is three times as large in the second half of each year."""
    return B.dense(spark, d).withColumn("r", F.col("r") * F.when(F.month("date") > 6, 3).otherwise(1))


@B.query("w30_segments", f"""{_REC}{B.DENSE}, {_SG} select entity, segment::int as segment, start, "end", n, round(mean * 1e3, 6) as mean_e3, round(annual_return, 6) as annual_return, round(annual_vol, 6) as annual_vol, round(downside_vol, 6) as downside_vol, round(skew, 5) as skew, round(kurtosis, 5) as kurtosis, round(total_return, 6) as total_return, round(max_drawdown, 6) as max_drawdown, regime from sr""")
def w30_segments(spark, d):
    x = G.segments(_sized(spark, d))
    six = [F.round(c, 6).alias(c) for c in ("annual_return", "annual_vol", "downside_vol", "total_return", "max_drawdown")]
    return x.select("entity", "segment", "start", "end", "n", F.round(F.col("mean") * 1e3, 6).alias("mean_e3"), *six, F.round("skew", 5).alias("skew"), F.round("kurtosis", 5).alias("kurtosis"), "regime")


@B.query("w30_change_events", f"""{_REC}{B.DENSE}, {_SG}, e as (select entity, start as changed, segment, lag(annual_vol) over o as vol_before, annual_vol as vol_after, lag(mean) over o as mean_before, mean as mean_after from sr window o as (partition by entity order by segment))
select entity, changed, segment::int as segment, round(vol_before, 6) as vol_before, round(vol_after, 6) as vol_after, round(mean_before * 1e3, 6) as mean_before_e3, round(mean_after * 1e3, 6) as mean_after_e3, round(vol_after / nullif(vol_before, 0), 6) as vol_ratio,
case when round(vol_after / nullif(vol_before, 0), 9) > {G.UP} then 'Variance up' when round(vol_after / nullif(vol_before, 0), 9) < {G.DOWN} then 'Variance down' else 'Mean/variance shift' end as kind from e where segment > 1""")
def w30_events(spark, d):
    x = G.change_events(G.segments(_sized(spark, d)))
    return x.select("entity", "changed", "segment", F.round("vol_before", 6).alias("vol_before"), F.round("vol_after", 6).alias("vol_after"), F.round(F.col("mean_before") * 1e3, 6).alias("mean_before_e3"), F.round(F.col("mean_after") * 1e3, 6).alias("mean_after_e3"), F.round("vol_ratio", 6).alias("vol_ratio"), "kind")



_TH = f"""{_RN}, tg as (select * from (values (0.05::double, 0.02::double), (0.05, 0.03), (0.1, 0.05), (0.15, 0.05)) t(cut, restore)), th(entity, cut, restore, n, i, e, idx, peak, th, worst) as (select distinct entity, cut, restore, n, 0::bigint, 1.0::double, 1.0::double, 1.0::double, 0, 0.0::double from rn, tg union all
select f.entity, f.cut, f.restore, f.n, rn.i, case when f.idx * (1 + f.e * rn.r) / greatest(f.peak, f.idx * (1 + f.e * rn.r)) - 1 < -f.cut then 0.5 when f.idx * (1 + f.e * rn.r) / greatest(f.peak, f.idx * (1 + f.e * rn.r)) - 1 > -f.restore then 1.0 else f.e end, f.idx * (1 + f.e * rn.r), greatest(f.peak, f.idx * (1 + f.e * rn.r)),
f.th + (case when f.idx * (1 + f.e * rn.r) / greatest(f.peak, f.idx * (1 + f.e * rn.r)) - 1 < -f.cut then 1 when f.idx * (1 + f.e * rn.r) / greatest(f.peak, f.idx * (1 + f.e * rn.r)) - 1 > -f.restore then 0 else (f.e < 1)::int end), least(f.worst, f.idx * (1 + f.e * rn.r) / greatest(f.peak, f.idx * (1 + f.e * rn.r)) - 1) from th f join rn on rn.entity = f.entity and rn.i = f.i + 1), tl as (select * from th where i = n)"""


def _throttled(spark, d):
    g = spark.sql("select * from values (0.05D, 0.02D), (0.05D, 0.03D), (0.1D, 0.05D), (0.15D, 0.05D) as t(cut, restore)")
    return R.throttle(B.dense(spark, d), g)


@B.query("w31_exposure_throttle", f"""{_REC}{B.DENSE}, {_TH} select entity, cut, restore, n, e as exposure, round(idx, 6) as index, th as throttled, round(worst, 6) as worst from tl""")
def w31(spark, d):
    return X.rounded(_throttled(spark, d))


@B.query("w32_throttle_choice", f"""{_REC}{B.DENSE}, {_TH}, o as (select *, row_number() over (partition by entity order by round(-worst, 9), round(-idx, 9), cut, restore) as o from tl) select entity, cut, restore, round(idx, 6) as index, round(worst, 6) as worst from o where o = 1""")
def w32(spark, d):
    return X.rounded(R.choose_throttle(_throttled(spark, d)))


def _factors(spark, d):
    """Supplier returns with two factors of the day: the market and the spread of two regions."""
    p, dn = B.prices(spark, d), B.dense(spark, d)
    at = lambda k: F.max(F.when(F.col("entity") == k, F.col("r")))
    spread = dn.groupBy("date").agg((at("EUROPE") - at("ASIA")).alias("spread"))
    return p.join(B.market(p), "date").join(spread, "date").select("entity", "date", "r", "rb", "spread").dropna()


_FX = f"""{B.MARKET}, fs as (select date, max(r) filter (where entity = 'EUROPE') - max(r) filter (where entity = 'ASIA') as spread from dn group by 1), fx as (select px.entity, px.date, px.r, rb, spread from px join mk using (date) join fs using (date) where spread is not null),
fm as (select entity, count(*) as n, avg(r) as my, avg(rb) as m1, avg(spread) as m2, var_pop(rb) as v1, var_pop(spread) as v2, covar_pop(rb, spread) as c12, covar_pop(rb, r) as c1, covar_pop(spread, r) as c2, var_pop(r) as vy from fx group by 1),
fb as (select *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) as b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) as b2 from fm)"""


@B.query("a35_factor_betas", f"""with {B.PX}, {B.DENSE}, {_FX} select entity, 'rb' as factor, round(b1, 6) as beta, n, round((b1 * c1 + b2 * c2) / vy, 6) as r2 from fb union all select entity, 'spread', round(b2, 6), n, round((b1 * c1 + b2 * c2) / vy, 6) from fb union all select entity, 'alpha', round(my - b1 * m1 - b2 * m2, 6), n, round((b1 * c1 + b2 * c2) / vy, 6) from fb""")
def a35(spark, d):
    return X.rounded(L.factor_betas(_factors(spark, d), "entity", "r", ["rb", "spread"]).drop("residual_variance"))


@B.query("a36_risk_decomposition", f"""with {B.PX}, {B.DENSE}, {_FX}, w as (select 1.0 / count(*) as w from fb), p as (select sum(w * b1) as p1, sum(w * b2) as p2, sum(w * w * n * (vy - b1 * c1 - b2 * c2) / (n - 3)) as s from fb, w), c as (select var_samp(rb) as f1, var_samp(spread) as f2, covar_samp(rb, spread) as f12 from mk join fs using (date) where spread is not null),
v as (select p1 * p1 * f1 + p2 * p2 * f2 + 2 * p1 * p2 * f12 as f, s from p, c) select round(f * 1e6, 5) as factor_e6, round(s * 1e6, 5) as specific_e6, round(f / (f + s), 6) as factor_share from v""")
def a36(spark, d):
    x = _factors(spark, d)
    betas = L.factor_betas(x, "entity", "r", ["rb", "spread"])
    w = betas.select("entity").distinct().withColumn("weight", 1 / F.count("*").over(W.partitionBy()))
    f = x.select("date", "rb", "spread").distinct()
    long = f.unpivot("date", ["rb", "spread"], "entity", "r")
    cov = K.pairwise(long, least=2)
    both = cov.select(F.col("a").alias("i"), F.col("b").alias("j"), "cov").union(cov.where("a <> b").select("b", "a", "cov"))
    y = L.risk_decomposition(betas, w, both, "entity")
    return y.select(F.round(F.col("factor_variance") * 1e6, 5).alias("factor_e6"), F.round(F.col("specific_variance") * 1e6, 5).alias("specific_e6"), F.round("factor_share", 6).alias("factor_share"))


_AR = f"""{_FX}, aw as (select l_suppkey as entity, sum(l_quantity) as q from lineitem group by 1), ab as (select entity, b1, b2, n * (vy - b1 * c1 - b2 * c2) / (n - 3) as d, q / sum(q) over () as w from fb join aw using (entity) where n >= 40),
ac as (select var_samp(rb) as f1, var_samp(spread) as f2, covar_samp(rb, spread) as f12 from mk join fs using (date) where spread is not null),
ap as (select sum(w * b1) as p1, sum(w * b2) as p2, sum(w * w * d) as s from ab), aq as (select *, p1 * (f1 * p1 + f12 * p2) as v1, p2 * (f12 * p1 + f2 * p2) as v2 from ap, ac), tot as (select *, v1 + v2 + s as v from aq)"""


def _risk_model(spark, d):
    """Betas, weights by volume and factor covariance."""
    x = _factors(spark, d)
    long = x.select("date", "rb", "spread").distinct().unpivot("date", ["rb", "spread"], "entity", "r")
    cov = K.pairwise(long, least=2)
    both = cov.select(F.col("a").alias("i"), F.col("b").alias("j"), "cov").union(cov.where("a <> b").select("b", "a", "cov"))
    weights = B.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(F.sum("l_quantity").cast("double").alias("weight"))
    return L.factor_betas(x, "entity", "r", ["rb", "spread"]), weights, both


@B.query("a36_asset_risk", f"""with {B.PX}, {B.DENSE}, {_AR}, g as (select entity, w, d, b1 * (f1 * p1 + f12 * p2) + b2 * (f12 * p1 + f2 * p2) + w * d as sw, b1 * b1 * f1 + b2 * b2 * f2 + 2 * b1 * b2 * f12 + d as own, v from ab, tot)
select entity, round(w, 8) as weight, round(sw / sqrt(v), 8) as marginal, round(w * sw / sqrt(v), 9) as component, round(w * sw / v, 8) as share, round(sqrt(own), 8) as standalone, round(d * 1e6, 4) as residual_e6 from g""")
def a36_asset(spark, d):
    y = L.asset_risk(*_risk_model(spark, d), "entity")
    return y.select("entity", F.round("weight", 8).alias("weight"), F.round("marginal", 8).alias("marginal"), F.round("component", 9).alias("component"), F.round("share", 8).alias("share"), F.round("standalone", 8).alias("standalone"), F.round(F.col("residual_variance") * 1e6, 4).alias("residual_e6"))


@B.query("a36_factor_risk", f"""with {B.PX}, {B.DENSE}, {_AR}, u as (select 'factor' as block, 'rb' as name, p1 as beta, v1 as x, v, v1 + v2 as f from tot union all select 'factor', 'spread', p2, v2, v, v1 + v2 from tot union all select 'specific', 'specific', null, s, v, null from tot
union all select 'total', 'factor_share', null, v1 + v2, v, null from tot union all select 'total', 'specific_share', null, s, v, null from tot union all select 'total', 'variance', null, v, v, null from tot)
select block, name, round(beta, 6) as beta, round(x * 1e6, 5) as variance_e6, round(x / v, 6) as share, round(x / f, 6) as factor_share from u""")
def a36_factor(spark, d):
    y = L.factor_risk(*_risk_model(spark, d), "entity")
    return y.select("block", "name", F.round("beta", 6).alias("beta"), F.round(F.col("variance") * 1e6, 5).alias("variance_e6"), F.round("share", 6).alias("share"), F.round("factor_share", 6).alias("factor_share"))


@B.query("a38_scenario_stress", f"""with {B.PX}, {B.DENSE}, {_FX}, s as (select * from (values ('crash', -0.1::double, 0.02::double), ('rally', 0.05, 0.0), ('rotation', 0.0, 0.05)) t(scenario, s1, s2)) select entity, scenario, round(b1 * s1 + b2 * s2, 6) as impact from fb, s""")
def a38(spark, d):
    s = spark.sql("select * from values ('crash', 'rb', -0.1D), ('crash', 'spread', 0.02D), ('rally', 'rb', 0.05D), ('rally', 'spread', 0D), ('rotation', 'rb', 0D), ('rotation', 'spread', 0.05D) as t(scenario, factor, shock)")
    return X.rounded(L.scenario_stress(L.factor_betas(_factors(spark, d), "entity", "r", ["rb", "spread"]), s, "entity"))


@B.query("a39_hedges", f"""with {B.PX}, {B.DENSE}, {_FX}, p as (select 'rb' as factor, avg(b1) as beta, 0.5::double as lim from fb union all select 'spread', avg(b2), 0.001 from fb) select factor, round(beta, 6) as beta, lim as "limit", round(-sign(beta) * (abs(beta) - lim), 6) as hedge, row_number() over (order by round(abs(beta) - lim, 9) desc, factor) as priority from p where abs(beta) > lim""")
def a39(spark, d):
    b = L.factor_betas(_factors(spark, d), "entity", "r", ["rb", "spread"]).groupBy("factor").agg(F.avg("beta").alias("beta"))
    lim = spark.sql("select * from values ('rb', 0.5D), ('spread', 0.001D) as t(factor, limit)")
    return X.rounded(L.hedges(b, lim).withColumn("priority", F.col("priority").cast("long")))


@B.query("a42_shrinkage", f"""with {B.DENSE}, ok as (select date from dn group by 1 having count(*) = (select count(distinct entity) from dn)), x as (select entity, date, r - avg(r) over (partition by entity) as d from dn where date in (select date from ok)), p as (select a.entity as a, b.entity as b, count(*) as n, avg(a.d * b.d) as s, avg(pow(a.d * b.d, 2)) as q from x a join x b using (date) group by 1, 2),
m as (select max(n) as n, sum(s) filter (where a = b) as tr, sum(s * s) as ss, sum(q - s * s) as beta, count(*) filter (where a = b) as p from p) select n, p, round(tr / p * 1e6, 5) as target_e6, round(greatest(least(beta / n / nullif(ss - tr * tr / p, 0), 1.0), 0.0), 6) as intensity from m""")
def a42(spark, d):
    x = L.shrinkage(B.dense(spark, d))
    return x.select("n", "p", F.round(F.col("target") * 1e6, 5).alias("target_e6"), F.round("intensity", 6).alias("intensity"))


@B.query("a43_spectrum")
def a43(spark, d):
    found = S.modes(*S.centred_window(B.prices(spark, d)))
    x = S.spectrum(found).select("k", (F.col("eigenvalue") * 1e6).alias("eigenvalue_e6"), "noise", (F.col("edge") * 1e6).alias("edge_e6"), "noise_fraction", "signal_modes", "effective_rank", "series", "days")
    return X.rounded(x, 4)


@B.query("a43_cleaned_variance")
def a43_cleaned(spark, d):
    xs, days = S.centred_window(B.prices(spark, d))
    y = S.cleaned_variances(xs, days, S.spectrum(S.modes(xs, days)))
    return y.select("entity", F.round(F.col("variance") * 1e6, 4).alias("variance_e6"), F.round(F.col("cleaned") * 1e6, 4).alias("cleaned_e6"))


@B.query("w13_group_distance")
def w13(spark, d):
    x = B.prices(spark, d).join(B.sectors(spark, d), "entity").groupBy("entity", "sector").agg(F.avg("volume").alias("a"), (F.avg("r") * 100).alias("b"), (F.stddev_samp("r") * 100).alias("c"))
    return X.rounded(L.group_distance(P.mad_z(x, ["a", "b", "c"], "sector"), "sector", "entity", ["z_a", "z_b", "z_c"]))


@B.query("w33_common_factor")
def w33(spark, d):
    dn = B.dense(spark, d).groupBy("date").pivot("entity", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]).agg(F.first("r"))
    out, _ = L.common_factor(dn.withColumnRenamed("MIDDLE EAST", "MIDDLE_EAST"), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE_EAST"], "EUROPE")
    return X.rounded(out.select("date", "factor"))


@B.query("w34_latent_regimes")
def w34(spark, d):
    days = B.dense(spark, d).groupBy("date").agg(F.avg("r").alias("rb"), F.stddev_samp("r").alias("credit_spread"))
    w = W.orderBy("date").rowsBetween(-20, 0)  # one series
    m = days.select("date", "credit_spread", F.avg("rb").over(w).alias("bullish"), F.stddev_samp("rb").over(w).alias("volatility"))
    out = L.latent_regimes(m, ["bullish", "volatility", "credit_spread"], "date")
    return X.rounded(out.select("date", "refit_at", "state", "label", "probability", "entropy"))


def _mentions(said: list[str]) -> str:
    words, phrases = [t for t in said if " " not in t], [t for t in said if " " in t]
    counted = [f"len(list_filter(tk, lambda x: x in ({', '.join(map(repr, words))})))"] if words else []
    return "(" + " + ".join(counted + [f"(length(low) - length(replace(low, '{p}', ''))) / {len(p)}" for p in phrases]) + ") * 1e4::double / nullif(tokens, 0)"


_RISKS = " + ".join(f"coalesce({k}, 0)" for k in T.RISK_TERMS if k not in T.NO_RISK)


@B.query("a58_text_risk", f"""with d as (select doc_id, source, lower(text) as low, list_filter(regexp_split_to_array(lower(text), '[^a-z-]+'), lambda x: x <> '') as tk from documents), t as (select *, len(tk) as tokens from d),
c as (select doc_id, source, tokens, {", ".join(f"{_mentions(v)} as {k}" for k, v in T.RISK_TERMS.items())} from t), r as (select *, {_RISKS} as risk from c)
select doc_id, tokens::int as tokens, {", ".join(f"round({k}, 5) as {k}_per_10k" for k in T.RISK_TERMS)}, round(coalesce(greatest(risk - lag(risk) over (partition by source order by doc_id), 0), 0), 5) as worsening from r""")
def a58(spark, d):
    x = T.risk_features(B.table(spark, d, "documents"), "source", "doc_id")
    return X.rounded(x.select("doc_id", "tokens", *[f"{k}_per_10k" for k in T.RISK_TERMS], "worsening"), 5)


@B.query("a58_similarity_to_prior", r"""with k as (select doc_id, text, lag(doc_id) over (partition by source order by doc_id) as prior from documents), w as (select doc_id, word, count(*) as n from (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda x: x <> '')) as word from documents) group by 1, 2), nm as (select doc_id, sqrt(sum(n * n)) as norm from w group by 1),
d as (select k.doc_id, sum(a.n * b.n) as dot from k join w a on a.doc_id = k.doc_id join w b on b.doc_id = k.prior and b.word = a.word group by 1) select k.doc_id, k.prior, round(coalesce(dot, 0) / (x.norm * y.norm), 6) as similarity from k left join d using (doc_id) left join nm x on x.doc_id = k.doc_id left join nm y on y.doc_id = k.prior where prior is not null""")
def a58b(spark, d):
    return X.rounded(T.similarity_to_prior(B.table(spark, d, "documents"), "source", "doc_id"))


def _terms(rel: str, key: str) -> str:
    words = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    both = "t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
    return f"select {key}, term, count(*) as n from (select {key}, unnest({both}) as term from (select {key}, {words} as t from {rel})) group by 1, 2"


@B.query("a59_retrieval", f"""with p as (select conv_id * 1000 + turn as id, text from conversations where role = 'assistant'), s as (select conv_id as q, text from conversations where role = 'user' and turn = 0), o as ({_terms('p', 'id')}), a as ({_terms('s', 'q')}),
idf as (select term, ln((1 + (select count(*) from p))::double / (1 + count(*))) + 1 as idf from o group by 1), w as (select id, term, n * idf as w from o join idf using (term)), nm as (select id, sqrt(sum(w * w)) as norm from w group by 1),
g as (select q, id, sum(a.n * idf * w) as dot from a join idf using (term) join w using (term) group by 1, 2), k as (select q, id, round(dot / norm, 9) as score from g join nm using (id)), r as (select *, row_number() over (partition by q order by score desc, id)::int as rank from k) select q, id, score, rank from r where rank <= 6""")
def a59(spark, d):
    c = B.table(spark, d, "conversations")
    answers = c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    asked = c.where("role = 'user' and turn = 0").select(F.col("conv_id").alias("q"), "text")
    return T.retrieve(answers, asked)


@B.query("a60_chunks")
def a60(spark, d):
    return T.chunks(B.table(spark, d, "documents"), "doc_id").select("doc_id", "chunk", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("digest"))


@B.query("p18_needs_translation", r"""select doc_id, coalesce(lang <> 'en', false) or coalesce(length(regexp_replace(text, '[^\p{L}]|[A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 0)::double >= 0.08, false) as needs from documents""")
def p18(spark, d):
    return B.table(spark, d, "documents").select("doc_id", T.needs_translation(F.col("text"), F.col("lang")).alias("needs"))


@B.query("p19_countries", r"""with t as (select n_nationkey as id, n_comment_ as title, 'from ' || n_name as query from (select n_nationkey, n_name, case when n_nationkey % 2 = 0 then 'trade between ' || n_name || ' and China' else 'nothing here' end as n_comment_ from nation)), f as (select id, list_sort(list(distinct n_name) filter (where regexp_matches(title, '(?i)(^|[^\p{L}])' || n_name || '($|[^\p{L}])'))) as a, list_sort(list(distinct n_name) filter (where regexp_matches(query, '(?i)(^|[^\p{L}])' || n_name || '($|[^\p{L}])'))) as b from t, nation group by 1)
select id, case when len(a) > 0 then 'title' when len(b) > 0 then 'query' end as tier, case when len(a) > 0 then a when len(b) > 0 then b end as countries from f""")
def p19(spark, d):
    n = B.table(spark, d, "nation")
    title = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("trade between "), "n_name", F.lit(" and China"))).otherwise(F.lit("nothing here"))
    docs = n.select(F.col("n_nationkey").alias("id"), title.alias("title"), F.concat(F.lit("from "), "n_name").alias("query"))
    return T.countries(docs, n.select(F.col("n_name").alias("alias"), F.col("n_name").alias("country")), "id", ["title", "query"])


#: A table of aliases: words of the documents' languages, and a source.
_ALIASES = [("the", "Alpha"), ("that", "Alpha"), ("ing", "Alpha"), ("die", "Beta"), ("und", "Beta"), ("ver", "Beta"), ("que", "Gamma"), ("los", "Gamma"), ("les", "Delta"), ("dans", "Delta"), ("une", "Delta"), ("src3", "Epsilon"), ("src5", "Epsilon")]


@B.query("p19_event_countries", rf"""with al as (select * from (values {", ".join(f"('{a}', '{c}')" for a, c in _ALIASES)}) t(alias, country)),
d as (select doc_id, source, split_part(text, chr(10), 1) as title, split_part(text, chr(10), 2) as query from documents), w as (select doc_id, 'title' as method, unnest(regexp_split_to_array(lower(title), '[^\p{{L}}]+')) as alias from d union all select doc_id, 'query', unnest(regexp_split_to_array(lower(query), '[^\p{{L}}]+')) from d),
n as (select doc_id, method, list_sort(list(distinct country)) as countries from w join al using (alias) group by 1, 2), b as (select doc_id, arg_max(method, (method = 'title')::int) as method, arg_max(countries, (method = 'title')::int) as countries from n group by 1),
h as (select doc_id, coalesce(country, case when lower(trim(source)) not in ('global', 'unknown', 'none', 'nan', '') then trim(source) end) as home from d left join al on alias = lower(trim(source)))
select doc_id, coalesce(countries, case when home is not null then [home] else [] end) as countries, coalesce(method || '_text', case when home is not null then 'source' end, 'unresolved') as method,
round(case when method = 'title' then least(0.95, 0.75 + 0.08 * len(countries)) when method = 'query' then least(0.8, 0.55 + 0.07 * len(countries)) when home is not null then 0.35 else 0 end::double, 6) as confidence from h left join b using (doc_id)""")
def p19_events(spark, d):
    """First line of each document as title, second as query."""
    line = lambda k: F.coalesce(F.get(F.split("text", "\n"), F.lit(k)), F.lit(""))
    docs = B.table(spark, d, "documents").select("doc_id", line(0).alias("title"), line(1).alias("query"), "source")
    return X.rounded(T.event_countries(docs, spark.createDataFrame(_ALIASES, "alias string, country string"), "doc_id"))


@B.query("s08_strip_html", r"""select page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&[#\w]+;', ' ', 'g'), '\s+', ' ', 'g'))) as text from pages""")
def s08(spark, d):
    return B.table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))
