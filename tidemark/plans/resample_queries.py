"""Walk-forward (W42 on) and resampling (B) queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import nested as N
from tidemark.operators import resample as R
from tidemark.plans import base as B

_POS = "ps as (select date, row_number() over (order by date) - 1 as pos from (select distinct date from px))"
_DRAW = lambda *parts: "(('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8))::ubigint / 4294967296.0::double)"


@B.query("w43_walk_forward", f"""with {B.PX}, {_POS}, w as (select unnest(range(0, (select count(*) from ps) - (756 + 5 + 126 + 5 + 42) + 1, 42)) as at_), k as (select at_, row_number() over (order by at_) as "window" from w)
select k."window", a.date as train_start, b.date as train_end, c.date as validation_start, d.date as validation_end, e.date as test_start, f.date as test_end from k join ps a on a.pos = at_ join ps b on b.pos = at_ + 755 join ps c on c.pos = at_ + 761 join ps d on d.pos = at_ + 886 join ps e on e.pos = at_ + 892 join ps f on f.pos = at_ + 933""")
def w43(spark, d):
    return R.walk_forward(B.prices(spark, d).select("date"), 756, 5, 126, 5, 42).withColumn("window", F.col("window").cast("long"))


@B.query("w42_holding_schedule", f"""with {B.PX}, {_POS}, r as (select (date '1995-06-30' + interval (i) month)::date as rebalance from range(60) t(i)), s as (select rebalance, max(pos) as at_ from r join ps on date <= rebalance group by 1)
select rebalance, a.date as trade_date, b.date as signal_date from s join ps a on a.pos = at_ left join ps b on b.pos = at_ - 5""")
def w42(spark, d):
    r = spark.range(60).select(F.add_months(F.lit("1995-06-30").cast("date"), F.col("id").cast("int")).alias("rebalance"))
    return R.holding_schedule(B.prices(spark, d).select("date"), r, 5)


@B.query("w44_turnover_costs", f"""with {B.PX}, m as (select date_trunc('month', date)::date as month, entity, sum(volume) as v, stddev_samp(r) as vol from px group by 1, 2), w as (select month, entity, v / sum(v) over (partition by month) as w, coalesce(vol, 0) as vol from m), o as (select month, row_number() over (order by month) as k from (select distinct month from w)), x as (select o.k, entity, w, vol from w join o using (month)),
f as (select coalesce(a.k, b.k + 1) as k, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) as ch, coalesce(a.vol, b.vol) as vol from x a full join x b on a.entity = b.entity and a.k = b.k + 1), g as (select k, sum(ch) / 2 as turnover, sum(0.1::double * pow(ch, 1.5) * vol) as impact from f group by 1)
select month, round(turnover, 6) as turnover, round(turnover * 10.0 / 1e4, 8) as fixed_cost, round(impact, 8) as impact_cost from g join o using (k)""")
def w44(spark, d):
    m = B.prices(spark, d).groupBy(F.to_date(F.trunc("date", "month")).alias("month"), "entity").agg(F.sum("volume").alias("v"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("vol"))
    m = m.withColumn("weight", F.col("v") / F.sum("v").over(W.partitionBy("month")))
    x = R.turnover(m, period="month", key="entity")
    return x.select("month", F.round("turnover", 6).alias("turnover"), F.round("fixed_cost", 8).alias("fixed_cost"), F.round("impact_cost", 8).alias("impact_cost"))


_SER = "sr as (select row_number() over (order by month) - 1 as pos, r from (select month, round(avg(r), 10) as r from tr group by 1))"


def _series(spark, d):
    s = B.trials(spark, d).groupBy("month").agg(F.round(F.avg("r"), 10).alias("r"))
    return s.select((F.row_number().over(W.orderBy("month")) - 1).alias("pos"), "r")  # one row a month


_IDX = f"""n as (select count(*) as n from sr), ix as (select rep, i, (floor({_DRAW("'7'", "rep::varchar", "(i // 6)::varchar")} * n)::bigint + i % 6) % n as pos from range(64) a(rep), n, range(n) b(i))"""
_UPR = "(partition by rep order by i rows between unbounded preceding and current row)"


@B.query("b01_block_bootstrap", f"""with {B.TRIALS}, {_SER}, {_IDX}, x as (select rep, i, r, exp(sum(ln(1 + r)) over {_UPR}) as idx from ix join sr using (pos)), y as (select *, greatest(max(idx) over {_UPR}, 1.0) as peak from x),
p as (select rep, exp(sum(ln(1 + r))) - 1 as total, avg(r) as mean, avg(r) / nullif(sqrt(avg(pow(least(r, 0.0), 2))), 0) as sortino, min(idx / peak - 1) as drawdown from y group by 1), l as (select metric, value from (unpivot p on total, mean, sortino, drawdown into name metric value value))
select metric, round(quantile_cont(value, 0.05), 6) as p05, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from l group by 1""")
def b01(spark, d):
    s = _series(spark, d)
    n = s.count()
    return X.rounded(R.bootstrap_summary(s, R.block_indices(spark, n, 64, 6, 7)))


@B.query("b02_stationary_bootstrap", f"""with {B.TRIALS}, {_SER}, n as (select count(*) as n from sr), m as (select rep, i, n, case when i = 0 or {_DRAW("'11'", "'restart'", "rep::varchar", "i::varchar")} < 0.1 then floor({_DRAW("'11'", "'start'", "rep::varchar", "i::varchar")} * n)::bigint end as s from range(64) a(rep), n, range(n) b(i)),
l as (select rep, i, n, last_value(s ignore nulls) over u as s, max(case when s is not null then i end) over u as f from m window u as {_UPR}), x as (select rep, r from l join sr on sr.pos = (l.s + l.i - l.f) % l.n)
select rep::int as rep, round(avg(r), 8) as mean, round(exp(sum(ln(1 + r))) - 1, 6) as total from x group by 1""")
def b02(spark, d):
    s = _series(spark, d)
    x = R.stationary_indices(spark, s.count(), 64, 0.1, 11).join(F.broadcast(s), "pos")  # one series
    x = x.groupBy("rep").agg(F.avg("r").alias("mean"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("total"))
    return x.select("rep", F.round("mean", 8).alias("mean"), F.round("total", 6).alias("total"))


_FULL = "fm as (select trial, month, r from tr where month < date '2001-06-01'), tk as (select trial from fm group by 1 having count(*) = (select count(distinct month) from fm)), tp as (select fm.trial, r, dense_rank() over (order by month) - 1 as pos from fm join tk using (trial))"


def _full(spark, d):
    t = B.trials(spark, d).where("month < date '2001-06-01'")
    months = t.agg(F.countDistinct("month").alias("all_months"))
    good = t.groupBy("trial").agg(F.count("*").alias("k")).crossJoin(F.broadcast(months)).where("k = all_months")  # one row
    pos = t.select("month").distinct().withColumn("pos", (F.row_number().over(W.orderBy("month")) - 1).cast("int"))
    return t.join(good.select("trial"), "trial", "left_semi").join(F.broadcast(pos), "month").select("trial", "pos", "r")


@B.query("b04_reality_check", f"""with {B.TRIALS}, {_FULL}, n as (select max(pos) + 1 as n from tp), ix as (select rep, (floor({_DRAW("'5'", "rep::varchar", "(i // 4)::varchar")} * n)::bigint + i % 4) % n as pos from range(100) a(rep), n, range(n) b(i)), c as (select rep, pos, count(*) as k from ix group by 1, 2),
s0 as (select trial, avg(r) as mean, stddev_samp(r) / sqrt(count(*)) as se from tp group by 1), s as (select *, mean / case when abs(se) > 1e-12 then se end as t, row_number() over (order by round(mean / case when abs(se) > 1e-12 then se end, 9) desc nulls last, trial) as rank from s0),
b as (select rep, trial, sum(r * k) / sum(k) as m from c join tp using (pos) group by 1, 2), x as (select b.*, s.mean, s.t, s.rank, m - s.mean as ce, (m - s.mean) / case when abs(se) > 1e-12 then se end as ct from b join s using (trial)), y as (select *, max(ct) over (partition by rep order by rank desc rows between unbounded preceding and current row) as rest from x),
st as (select trial, avg((rest >= t)::int::double) as raw from y group by 1), w as (select avg((mc >= (select max(mean) from s))::int::double) as white_p, avg((mt >= (select max(t) from s))::int::double) as spa_p from (select rep, max(ce) as mc, max(ct) as mt from x group by 1))
select trial, round(s.mean, 8) as mean, round(s.t, 6) as t, s.rank, round(max(raw) over (order by s.rank rows between unbounded preceding and current row), 6) as stepdown_p, round(white_p, 6) as white_p, round(spa_p, 6) as spa_p from s join st using (trial), w""")
def b04(spark, d):
    t = _full(spark, d)
    n = t.agg(F.max("pos")).first()[0]
    x = R.reality_check(t, R.block_indices(spark, (n if n is not None else -1) + 1, 100, 4, 5))
    return x.select("trial", F.round("mean", 8).alias("mean"), F.round("t", 6).alias("t"), F.col("rank").cast("long").alias("rank"), F.round("stepdown_p", 6).alias("stepdown_p"), F.round("white_p", 6).alias("white_p"), F.round("spa_p", 6).alias("spa_p"))


@B.query("b06_overfit_by_folds", f"""with {B.TRIALS}, {_FULL}, f as (select pos, ntile(8) over (order by pos) as fold from (select distinct pos from tp)), g as (select trial, fold, sum(r) as s, count(*) as k from tp join f using (pos) group by 1, 2),
x as (select trial, fold, round((sum(s) over (partition by trial) - s) / (sum(k) over (partition by trial) - k), 12) as train, round(s / k, 12) as test from g), y as (select *, rank() over (partition by fold order by test) + (count(*) over (partition by fold, test) - 1) / 2.0 as rank, count(*) over (partition by fold) as n from x),
b as (select fold, arg_max(trial, (train, -trial)) as best, arg_max(rank, (train, -trial)) as rank, arg_max(n, (train, -trial)) as n from y group by 1), l as (select *, ln(rank / (n + 1) / (1 - rank / (n + 1))) as logit from b)
select fold::int as fold, best, rank::double as rank, round(logit, 6) as logit, round(avg((logit < 0)::int::double) over (), 6) as pbo from l""")
def b06(spark, d):
    return X.rounded(R.overfit_by_folds(_full(spark, d), 8).withColumn("rank", F.col("rank").cast("double")))


@B.query("b08_overfit_by_masks", f"""with {B.TRIALS}, {_FULL}, w as (select trial, ntile(8) over (partition by trial order by pos) - 1 as "window", r from tp), v as (select trial, "window", avg(r) as r from w group by 1, 2), m as (select i as mask from range(256) t(i) where bit_count(i) = 4 and i % 2 = 1),
g as (select mask, trial, round(avg(r) filter (where (mask >> "window") & 1 = 1), 12) as train, round(avg(r) filter (where (mask >> "window") & 1 = 0), 12) as test from v, m group by 1, 2), y as (select *, rank() over (partition by mask order by test) + (count(*) over (partition by mask, test) - 1) / 2.0 as rank, count(*) over (partition by mask) as n from g),
b as (select mask, arg_max(trial, (train, -trial)) as best, arg_max(rank, (train, -trial)) as rank, arg_max(n, (train, -trial)) as n from y group by 1) select mask, best, rank::double as rank, round(ln(rank / (n + 1) / (1 - rank / (n + 1))), 6) as logit from b""")
def b08(spark, d):
    t = _full(spark, d).withColumn("window", F.ntile(8).over(W.partitionBy("trial").orderBy("pos")) - 1)
    v = t.groupBy("trial", "window").agg(F.avg("r").alias("r"))
    return X.rounded(R.overfit_by_masks(v, 8).withColumn("rank", F.col("rank").cast("double")))


@B.query("b09_deflated_best", f"""with {B.TRIALS}, s as (select trial, avg(r) / nullif(sqrt(avg(pow(least(r, 0.0), 2))), 0) as sortino, count(*) as n from tr group by 1 having count(*) >= 20), a as (select max(sortino) as best, stddev_samp(sortino) as sd, count(*) as trials from s), q as (select *, 1 - 1.0 / trials as p1, 1 - 1.0 / (trials * 2.718281828459045::double) as p2 from a),
z as (select *, sqrt(-2 * ln(1 - p1)) as t1, sqrt(-2 * ln(1 - p2)) as t2 from q), e as (select *, t1 - (2.515517::double + 0.802853::double * t1 + 0.010328::double * t1 * t1) / (1 + 1.432788::double * t1 + 0.189269::double * t1 * t1 + 0.001308::double * t1 * t1 * t1) as z1, t2 - (2.515517::double + 0.802853::double * t2 + 0.010328::double * t2 * t2) / (1 + 1.432788::double * t2 + 0.189269::double * t2 * t2 + 0.001308::double * t2 * t2 * t2) as z2 from z)
select trials, round(best, 6) as best, round(sd * ((1 - 0.5772156649::double) * z1 + 0.5772156649::double * z2), 6) as expected_best, best > sd * ((1 - 0.5772156649::double) * z1 + 0.5772156649::double * z2) as passes from e""")
def b09(spark, d):
    s = B.trials(spark, d).groupBy("trial").agg(X.ratio(F.avg("r"), F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2)))).alias("sortino"), F.count("*").alias("n")).where("n >= 20")
    a = s.agg(F.max("sortino").alias("best"), F.stddev_samp("sortino").alias("sd"), F.count("*").alias("trials"))
    k = F.col("trials").cast("double")
    e = F.col("sd") * ((1 - 0.5772156649) * R.normal_quantile(1 - 1 / k) + 0.5772156649 * R.normal_quantile(1 - 1 / (k * 2.718281828459045)))
    return X.rounded(a.select("trials", "best", e.alias("expected_best"), (F.col("best") > e).alias("passes")))


@B.query("b12_walk_forward_selection", f"""with {B.TRIALS}, {_FULL}, w as (select i as "window", i * 6 as at_ from range(8) t(i)), x as (select "window", trial, avg(r) filter (where pos < at_ + 24) as train, avg(r) filter (where pos >= at_ + 24 and pos < at_ + 30) as validation, avg(r) filter (where pos >= at_ + 30) as test from tp join w on pos >= at_ and pos < at_ + 36 group by 1, 2),
b as (select "window", arg_max(trial, (round(least(train, validation), 12), -trial)) as pick from x group by 1) select b."window", pick, round(x.train, 8) as train, round(x.validation, 8) as validation, round(x.test, 8) as test from b join x on x."window" = b."window" and x.trial = b.pick""")
def b12(spark, d):
    w = spark.range(8).select(F.col("id").alias("window"), (F.col("id") * 6).alias("at"))
    t = _full(spark, d).join(F.broadcast(w), (F.col("pos") >= F.col("at")) & (F.col("pos") < F.col("at") + 36))  # eight windows
    part = lambda a, b: F.avg(F.when((F.col("pos") >= F.col("at") + a) & (F.col("pos") < F.col("at") + b), F.col("r")))
    x = t.groupBy("window", "trial").agg(part(0, 24).alias("train"), part(24, 30).alias("validation"), part(30, 36).alias("test"))
    b = x.groupBy("window").agg(F.max_by(F.struct(F.col("trial").alias("pick"), "train", "validation", "test"), F.struct(F.round(F.least("train", "validation"), 12), -F.col("trial"))).alias("b")).select("window", "b.*")
    return X.rounded(b, 8)


_SCHEDULE = N.Schedule(train=504, purge=21, validation=126, embargo=5, test=42, holdout=252)


def _nested(spark, d):
    """Regions as candidates against the mean of all."""
    dn = B.dense(spark, d)
    return N.nested_selection(dn.join(B.market(dn), "date").select("entity", "date", "r", "rb"), _SCHEDULE)


def _perf(src: str, keys: str, r: str) -> str:
    """Performance of each group in the terms of ``performance``."""
    return f"""(select {keys}, count(*) as days, exp(sum(ln(1 + {r})) * 252.0::double / count(*)) - 1 as annual_return, sqrt(avg(pow(least({r}, 0.0), 2))) * sqrt(252.0::double) as downside,
  case when abs(avg(rb) filter (where rb > 0)) > 1e-12 then avg({r}) filter (where rb > 0) / avg(rb) filter (where rb > 0) end as upside_capture, case when abs(avg(rb) filter (where rb < 0)) > 1e-12 then avg({r}) filter (where rb < 0) / avg(rb) filter (where rb < 0) end as downside_capture,
  avg({r}) filter (where round({r}, 12) <= round(q, 12)) as cvar, min(nav / peak - 1) as max_drawdown
  from (select *, max(nav) over (partition by {keys} order by date) as peak from (select *, quantile_cont({r}, 0.05) over (partition by {keys}) as q, exp(sum(ln(1 + {r})) over (partition by {keys} order by date)) as nav from {src})) group by {keys} having count(*) >= {N.FEWEST})"""


_S = _SCHEDULE
_NS = f"""mkd as (select date, round(avg(r), 10) as rb from dn group by date), nd as (select date, row_number() over (order by date) - 1 as pos from (select date from dn group by 1 having count(*) = (select count(distinct entity) from dn))),
nn as (select count(*) as n from nd), nw as (select ((a - {_S.first_test}) // {_S.test})::int as w, a, n from (select unnest(range({_S.first_test}, n - {_S.holdout}, {_S.test})) as a, n from nn where n >= {_S.first_test + _S.test + _S.holdout})),
np as (select w, 'train' as part, a - {_S.first_test} as low, a - {_S.first_test} + {_S.train} as high from nw union all select w, 'validation', a - {_S.embargo + _S.validation}, a - {_S.embargo} from nw union all select w, 'test', a, least(a + {_S.test}, n - {_S.holdout}) from nw),
nr as (select w, part, entity, date, r, rb from np join nd on pos >= low and pos < high join dn using (date) join mkd using (date)), nb as (select distinct w, part, date, rb from nr),
n1 as {_perf("nr", "w, part, entity", "r")}, n2 as {_perf("nb", "w, part", "rb")},
nu as (select o.w, o.part, entity, o.annual_return - b.annual_return as active, o.annual_return - b.annual_return + 0.1::double * (o.upside_capture - 1) - 0.1::double * greatest(o.downside_capture - 1, 0.0) - greatest(abs(o.downside) - abs(b.downside), 0.0)
  - 2 * sqrt(252.0::double) * greatest(abs(o.cvar) - abs(b.cvar), 0.0) - 0.5::double * greatest(abs(o.max_drawdown) - abs(b.max_drawdown), 0.0) as u from n1 o join n2 b on b.w = o.w and b.part = o.part),
nj as (select w, entity, max(u) filter (where part = 'train') as tu, max(u) filter (where part = 'validation') as vu, max(active) filter (where part = 'test') as ta from nu group by 1, 2),
nk as (select *, vu - 0.25::double * abs(vu - tu) as robust from nj), nx as (select * from (select *, row_number() over (partition by w order by round(robust, 9) desc, entity) as o from nk where robust is not null) where o = 1),
ny as (select entity, coalesce(any_value(p.picked), 0) as picked, coalesce(any_value(p.picked), 0)::double / (select count(*) from nx) as rate, avg(vu) as mu, stddev_samp(vu) as sd from nk left join (select entity, count(*) as picked from nx group by 1) p using (entity) group by entity),
nz as (select *, row_number() over (order by picked desc, round(mu, 9) desc nulls last, entity) = 1 as frozen from ny)"""


@B.query("b12_nested_windows", f"""with {B.DENSE}, {_NS}, ne as (select w, min(date) filter (where part = 'train') as train_start, max(date) filter (where part = 'train') as train_end, min(date) filter (where part = 'validation') as validation_start, max(date) filter (where part = 'validation') as validation_end,
min(date) filter (where part = 'test') as test_start, max(date) filter (where part = 'test') as test_end from nr group by 1) select w as "window", entity as picked, round(tu, 6) as train_utility, round(vu, 6) as validation_utility, round(robust, 6) as robust, round(ta, 6) as test_active, train_start, train_end, validation_start, validation_end, test_start, test_end from nx join ne using (w)""")
def b12_windows(spark, d):
    return X.rounded(_nested(spark, d).windows.withColumnRenamed("entity", "picked"))


@B.query("b12_nested_path", f"""with {B.DENSE}, {_NS}, np1 as (select 'test' as part, date, entity, r, rb from nr join nx using (w, entity) where part = 'test' union all select 'holdout', date, entity, r, rb from nd join dn using (date) join mkd using (date) join nz using (entity), nn where frozen and picked > 0 and pos >= n - {_S.holdout})
select part, date, entity as picked, round(r, 8) as r, round(exp(sum(ln(1 + r)) over u), 6) as nav, round(exp(sum(ln(1 + rb)) over u), 6) as bench_nav from np1 window u as (partition by part order by date)""")
def b12_path(spark, d):
    found = _nested(spark, d)
    both = found.path.select(F.lit("test").alias("part"), "date", "entity", "r", "rb").union(found.holdout.select(F.lit("holdout"), "date", "entity", "r", "rb"))
    u = W.partitionBy("part").orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one row a day
    nav = [F.round(F.exp(F.sum(F.log1p(c)).over(u)), 6).alias(n) for c, n in (("r", "nav"), ("rb", "bench_nav"))]
    return both.select("part", "date", F.col("entity").alias("picked"), F.round("r", 8).alias("r"), *nav)


@B.query("b12_selection_stability", f"""with {B.DENSE}, {_NS}, nh as (select entity, date, r, rb from nd join dn using (date) join mkd using (date) join nz using (entity), nn where frozen and picked > 0 and pos >= n - {_S.holdout}), n3 as {_perf("nh", "entity", "r")}
select nz.entity, picked, round(rate, 6) as rate, round(mu, 6) as mean_utility, round(sd, 6) as utility_sd, frozen, round(n3.annual_return, 6) as holdout_return, round(n3.max_drawdown, 6) as holdout_drawdown from nz left join n3 using (entity)""")
def b12_stability(spark, d):
    found = _nested(spark, d)
    judged = N.performance(found.holdout, ["entity"]).select("entity", F.col("annual_return").alias("holdout_return"), F.col("max_drawdown").alias("holdout_drawdown"))
    return X.rounded(found.stability.join(judged, "entity", "left"))


#: Figures of the bundle: query, name and what it is in that query's rows, in Spark's and DuckDB's SQL alike.
_BUNDLE = {
    "b04_reality_check": {"white_p": "max(white_p)", "spa_p": "max(spa_p)", "least_stepdown_p": "min(stepdown_p)", "stepdown_rejected": "sum(case when stepdown_p <= 0.05 then 1 else 0 end)"},
    "b06_overfit_by_folds": {"pbo_folds": "max(pbo)"},
    "b08_overfit_by_masks": {"pbo_masks": "avg(case when logit < 0 then 1e0 else 0e0 end)"},
    "b09_deflated_best": {"best_sortino": "max(best)", "expected_best": "max(expected_best)", "trials": "max(trials)"},
    "b12_selection_stability": {"frozen_rate": "max(case when frozen then rate end)", "holdout_return": "max(holdout_return)", "holdout_drawdown": "min(holdout_drawdown)"},
}
_BUNDLE_SQL = " union all ".join(
    f"select metric, value from (unpivot (select {', '.join(f'({v})::double as {k}' for k, v in own.items())} from ({B.ORACLES[q]})) on {', '.join(own)} into name metric value value)" for q, own in _BUNDLE.items()
)


@B.query("b13_validation_metrics", f"select metric, round(value, 6) as value from ({_BUNDLE_SQL})")
def b13_metrics(spark, d):
    """The tests of this module in one long table of metric and value."""
    parts = []
    for name, own in _BUNDLE.items():
        one = B.QUERIES[name](spark, d).agg(*[F.expr(v).cast("double").alias(k) for k, v in own.items()])
        parts.append(one.unpivot([], list(own), "metric", "value").where("value is not null"))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return X.rounded(out)


@B.query("w08_daily_nav", f"""with {B.PX}, h as (select date_trunc('quarter', date)::date as q, entity, sum(volume) as v from px group by 1, 2), k as (select *, row_number() over (partition by q order by v desc, entity) as k from h), w as (select (q + interval 3 month)::date as q, entity, v / sum(v) over (partition by q) as w from k where k <= 20),
d as (select date, sum(w.w * r) / sum(w.w) as r from px join w on w.entity = px.entity and date_trunc('quarter', px.date)::date = w.q group by 1), c as (select *, row_number() over (partition by date_trunc('quarter', date) order by date) = 1 as first from d), n as (select date, r - case when first then 0.001 else 0 end as net from c)
select date, round(net, 8) as net, round(exp(sum(ln(1 + net)) over (order by date rows between unbounded preceding and current row)), 7) as nav from n""")
def w08(spark, d):
    p = B.prices(spark, d).withColumn("q", F.to_date(F.trunc("date", "quarter")))
    k = p.groupBy("q", "entity").agg(F.sum("volume").alias("v")).withColumn("k", F.row_number().over(W.partitionBy("q").orderBy(F.desc("v"), "entity"))).where("k <= 20")
    w = k.select(F.add_months("q", 3).alias("q"), "entity", (F.col("v") / F.sum("v").over(W.partitionBy("q"))).alias("w"))
    day = p.join(w, ["q", "entity"]).groupBy("q", "date").agg((F.sum(F.col("w") * F.col("r")) / F.sum("w")).alias("r"))
    first = F.row_number().over(W.partitionBy("q").orderBy("date")) == 1
    net = day.select("date", (F.col("r") - F.when(first, 0.001).otherwise(0.0)).alias("net"))
    nav = F.exp(F.sum(F.log1p("net")).over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)))  # one portfolio, one row a day
    return net.select("date", F.round("net", 8).alias("net"), F.round(nav, 7).alias("nav"))


@B.query("w23_delisting_return", f"""with {B.PX}, m as (select entity, date_trunc('month', date)::date as month, count(*) as n, count(distinct r) as dr, max(volume) as mv, exp(sum(ln(1 + r))) - 1 as total from px group by 1, 2) select entity, month, n, round(case when n >= 5 and dr = 1 and mv = 0 then -0.3 else total end + 1e-10, 7) as holding_return from m""")
def w23(spark, d):
    m = B.prices(spark, d).groupBy("entity", F.to_date(F.trunc("date", "month")).alias("month")).agg(F.count("*").alias("n"), F.countDistinct("r").alias("dr"), F.max("volume").alias("mv"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("total"))
    return X.rounded(m.select("entity", "month", "n", (F.when((F.col("n") >= 5) & (F.col("dr") == 1) & (F.col("mv") == 0), -0.3).otherwise(F.col("total")) + 1e-10).alias("holding_return")), 7)
