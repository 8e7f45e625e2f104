"""Aggregation queries (A) over returns.

Where values are often short decimals, a tiny amount is added before rounding, so that both engines round ties alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import panel as P
from tidemark.operators import quality as Q
from tidemark.operators import risk as R
from tidemark.plans import base as B

_J = f"with {B.PX}, {B.MARKET}, j as (select * from px join mk using (date))"
_UP = "(partition by entity order by date rows between unbounded preceding and current row)"
_DD = f"ix as (select entity, date, exp(sum(ln(1 + greatest(r, -0.999999))) over {_UP}) as idx from px), dd as (select *, greatest(max(idx) over {_UP}, 1.0) as peak, idx / greatest(max(idx) over {_UP}, 1.0) - 1 as drawdown from ix)"
_VAR = "v0 as (select entity, -r as loss, quantile_cont(-r, 0.95) over (partition by entity) as v from px), vr as (select entity, max(v) as var, avg(loss) filter (where loss >= v) as cvar, count(*) as n from v0 group by 1)"


def _both(spark, d):
    p = B.prices(spark, d)
    return p.join(B.market(p), "date")


@B.query("entity_risk_summary", f"""{_J}, {_DD}, w as (select entity, min(drawdown) as mdd from dd group by 1)
select entity, count(r) as n, case when count(r) >= 20 then round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0), 6) end as sharpe, case when count(r) >= 20 then round(avg(r) / nullif(sqrt(avg(pow(least(r, 0.0), 2))), 0) * sqrt(252.0), 6) end as sortino, round(any_value(mdd), 6) as max_drawdown
from j join w using (entity) group by entity""")
def summary_of_entities(spark, d):
    x = _both(spark, d)
    worst = P.drawdown_path(x).groupBy("entity").agg(F.min("drawdown").alias("max_drawdown"))
    return X.rounded(R.performance(x, "entity").select("entity", "n", "sharpe", "sortino").join(worst, "entity"))


@B.query("a02_performance_ratios", f"""{_J} select entity, count(r) as n, case when count(r) >= 20 then round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0), 6) end as sharpe, case when count(r) >= 20 then round(avg(r) / nullif(sqrt(avg(pow(least(r, 0.0), 2))), 0) * sqrt(252.0), 6) end as sortino,
case when count(r) >= 20 then round(avg(r - rb) / nullif(stddev_samp(r - rb), 0) * sqrt(252.0), 6) end as information, case when count(r) >= 20 then round(avg(r) * 252.0 / regr_slope(r, rb), 6) end as treynor,
case when count(r) >= 20 then round(regr_slope(r, rb), 6) end as beta, case when count(r) >= 20 then round(corr(r, rb), 6) end as correlation, case when count(r) >= 20 then round(regr_r2(r, rb), 6) end as r2 from j group by entity""")
def a02(spark, d):
    return X.rounded(R.performance(_both(spark, d), "entity"))


@B.query("a04_conditional_betas", f"""{_J}, q as (select *, quantile_cont(rb, 0.1) over (partition by entity) as c from j)
select entity, """ + ", ".join(f"case when count(*) filter (where {c}) >= 20 then round(regr_slope(r, rb) filter (where {c}), 6) end as beta_{k}" for k, c in (("up", "rb > 0"), ("down", "rb < 0"), ("tail", "rb <= c"))) + " from q group by entity")
def a04(spark, d):
    return X.rounded(R.conditional_betas(_both(spark, d), "entity"))


@B.query("a05_capture_ratios", f"""{_J} select entity, round(avg(r) filter (where rb > 0) / avg(rb) filter (where rb > 0), 6) as up_capture, round(avg(r) filter (where rb < 0) / avg(rb) filter (where rb < 0), 6) as down_capture, round(quantile_cont(r, 0.95) / abs(nullif(quantile_cont(r, 0.05), 0)), 6) as tail_ratio from j group by entity""")
def a05(spark, d):
    return X.rounded(R.capture(_both(spark, d), "entity"))


@B.query("a06_drawdowns", f"""with {B.PX}, {_DD}, w as (select entity, min(drawdown) as mdd, arg_min(date, (drawdown, date)) as trough, arg_max(drawdown, date) as cur from dd group by 1),
g as (select w.*, dd.peak as goal from w join dd on w.entity = dd.entity and w.trough = dd.date), b as (select g.entity, min(dd.date) as rec from g join dd on g.entity = dd.entity and dd.date >= g.trough and dd.idx >= g.goal * (1 - 1e-12) group by 1)
select entity, round(mdd, 6) as max_drawdown, round(cur, 6) as current_drawdown, trough, (rec - trough)::int as recovery_days, rec is not null as recovered from w left join b using (entity)""")
def a06(spark, d):
    return X.rounded(R.drawdowns(P.drawdown_path(B.prices(spark, d)), "entity"))


@B.query("a07_value_at_risk", f"with {B.PX}, {_VAR} select entity, round(var, 6) as var, round(cvar + 1e-10, 6) as cvar, n from vr")
def a07(spark, d):
    return X.rounded(R.value_at_risk(B.prices(spark, d), "entity").withColumn("cvar", F.col("cvar") + 1e-10))


@B.query("a08_liquidity", f"""with {B.PX}, k as (select *, row_number() over (partition by entity order by date desc) as k from px)
select entity, round(avg(volume), 6) as adv, round(avg(close * volume), 4) as dollar_adv, round(avg(abs(r) / nullif(close * volume, 0)) * 1e6, 6) as illiquidity, count(*) filter (where volume <= 0) as zero_days from k where k <= 63 group by entity""")
def a08(spark, d):
    x = R.liquidity(B.prices(spark, d), "entity")
    return x.select("entity", F.round("adv", 6).alias("adv"), F.round("dollar_adv", 4).alias("dollar_adv"), F.round(F.col("illiquidity") * 1e6, 6).alias("illiquidity"), "zero_days")


_EVT = f"""l0 as (select entity, -r as l, quantile_cont(-r, 0.9) over (partition by entity) as u from px), ev as (select entity, count(*) as n, max(u) as u from l0 group by 1),
ov as (select entity, l - u as y, row_number() over (partition by entity order by l - u) as i, count(*) over (partition by entity) as m from l0 where l > u),
bb as (select entity, count(*) as n_tail, avg(y) as b0, avg((i - 1)::double / nullif(m - 1, 0) * y) as b1 from ov group by 1),
st as (select entity, n, coalesce(n_tail, 0) as n_tail, u, b0, 2 * b1 - b0 as l2, case when coalesce(n_tail, 0) < 10 then 'too_few' when coalesce(2 * b1 - b0, 0) <= 1e-12 then 'degenerate' else 'ok' end as status from ev left join bb using (entity)),
sh as (select *, case when status = 'ok' then greatest(least(2 - b0 / l2, 0.95), -0.5) end as shape from st), sc as (select *, (1 - shape) * b0 as scale, n::double / nullif(n_tail, 0) * (1 - 0.99::double) as times from sh),
vv as (select *, case when status = 'ok' then u + case when abs(shape) < 1e-6 then -scale * ln(times) else scale / shape * (pow(times, -shape) - 1) end end as var from sc)"""


@B.query("a09_tail_fit", f"with {B.PX}, {_EVT} select entity, n, n_tail, status, round(u, 6) as u, round(shape, 5) as shape, round(scale, 6) as scale, round(var, 6) as var, round((var + scale - shape * u) / (1 - shape), 6) as cvar from vv")
def a09(spark, d):
    x = R.tail_fit(B.prices(spark, d), "entity")
    return X.rounded(x.withColumn("shape", F.round("shape", 5)))


@B.query("a10_pooled_tail", f"""with {B.PX}, {B.SECTORS}, {_EVT}, p as (select entity, sector, n_tail, shape, scale, median(shape) over (partition by sector) as m from vv join sectors using (entity)),
q as (select *, coalesce(n_tail / (n_tail + 20.0) * shape + (1 - n_tail / (n_tail + 20.0)) * m, m) as pooled from p) select entity, sector, n_tail, round(shape, 5) as shape, round(pooled, 5) as pooled, round(scale * (1 - pooled) / nullif(1 - shape, 0), 6) as pooled_scale from q""")
def a10(spark, d):
    x = R.pooled_shape(R.tail_fit(B.prices(spark, d), "entity"), B.sectors(spark, d).select("entity", "sector"), "entity", "sector")
    return x.select("entity", "sector", "n_tail", F.round("shape", 5).alias("shape"), F.round("pooled", 5).alias("pooled"), F.round("pooled_scale", 6).alias("pooled_scale"))


@B.query("a11_moments", f"with {B.PX} select entity, count(r) as n, round(avg(r), 6) as mean, round(stddev_samp(r), 6) as sd, round(skewness(r), 6) as skewness, round(kurtosis(r), 6) as kurtosis from px group by entity")
def a11(spark, d):
    return X.rounded(R.moments(B.prices(spark, d), "entity"))


@B.query("a12_sector_features", f"""with {B.PX}, {B.SECTORS}, s as (select sector as entity, date, avg(r) as r from px join sectors using (entity) group by 1, 2)
select entity as sector, round(exp(sum(ln(1 + r))) - 1, 5) as total, round(stddev_samp(r) * sqrt(252.0), 6) as vol, round(sqrt(avg(pow(least(r, 0.0), 2))) * sqrt(252.0), 6) as downside, count(*) as days from s group by 1""")
def a12(spark, d):
    s = B.prices(spark, d).join(B.sectors(spark, d), "entity").groupBy("sector", "date").agg(F.avg("r").alias("r"))
    year = F.sqrt(F.lit(252.0))
    x = s.groupBy("sector").agg(F.round(F.exp(F.sum(F.log1p("r"))) - 1, 5).alias("total"), (F.stddev_samp("r") * year).alias("vol"), (F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2))) * year).alias("downside"), F.count("*").alias("days"))
    return X.rounded(x)


@B.query("a13_portfolio_summary", f"""{_J}, {_DD}, {_VAR}, w as (select entity, min(drawdown) as mdd from dd group by 1),
b as (select entity, exp(sum(ln(1 + greatest(r, -0.999999)))) - 1 as total_return, exp(sum(ln(1 + greatest(r, -0.999999))) * 252.0 / count(r)) - 1 as annual_return, stddev_samp(r) * sqrt(252.0) as volatility, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0) as sharpe, avg(r) / nullif(sqrt(avg(pow(least(r, 0.0), 2))), 0) * sqrt(252.0) as sortino,
avg((r > 0)::int::double) as hit_rate, stddev_samp(r - rb) * sqrt(252.0) as tracking_error, avg(r - rb) / nullif(stddev_samp(r - rb), 0) * sqrt(252.0) as information_ratio, regr_slope(r, rb) as beta from j group by 1),
a as (select b.*, mdd as max_drawdown, var, cvar from b join w using (entity) join vr using (entity))
select entity, metric, round(value + 1e-9, 5) as value from (unpivot a on columns(* exclude entity) into name metric value value)""")
def a13(spark, d):
    # moved off the ties of rounding, on which whole hundredths fall
    return X.rounded(R.summary(_both(spark, d), "entity").withColumn("value", F.col("value") + 1e-9), 5)


_PROMOTE = [("sortino", 0.0, "higher"), ("information_ratio", 0.0, "higher"), ("beta", 1.5, "lower"), ("hit_rate", 0.4, "higher"), ("max_drawdown", 0.6, "lower_abs"), ("cvar", 0.05, "lower_abs"), ("qlike_delta", 0.0, "lower")]
_PT = f"""pm as (select * from ({B.ORACLES["a13_portfolio_summary"]})), pr as (select * from (values {", ".join(f"('{t}', {x}::double, '{d}')" for t, x, d in _PROMOTE)}) t(test, threshold, direction)),
pt as (select e.entity, pr.test, threshold, direction, pm.value as observed, coalesce(case direction when 'higher' then pm.value > threshold when 'lower' then pm.value < threshold else abs(pm.value) <= threshold end, false) as passed from (select distinct entity from pm) e cross join pr left join pm on pm.entity = e.entity and pm.metric = pr.test)"""


def _promotion(spark, d):
    """Suppliers as candidates; no source has the last test's metric."""
    metrics = a13(spark, d).select("entity", F.col("metric").alias("test"), F.col("value").alias("observed"))
    return Q.promotion(metrics, spark.createDataFrame(_PROMOTE, "test string, threshold double, direction string"), "entity")


@B.query("a54_promotion_tests", f"with {_PT} select entity, test, observed, threshold, direction, passed from pt")
def a54_tests(spark, d):
    return _promotion(spark, d)[0].select("entity", "test", "observed", "threshold", "direction", "passed")


@B.query("a54_promotion_status", f"""with {_PT}, ps as (select entity, count(observed) as valid, avg(passed::int::double) filter (where observed is not null) as score, coalesce(string_agg(test, ';' order by test) filter (where observed is not null and not passed), '') as failed from pt group by 1)
select entity, case when valid = 0 then 'watchlist' when failed = '' and valid >= 2 then 'promoted' else 'rejected' end as status, round(coalesce(score, 0), 6) as score, valid, failed from ps""")
def a54_status(spark, d):
    return X.rounded(_promotion(spark, d)[1])


@B.query("a14_performance_by_state", f"""{_J}, s as (select *, case when rb >= 0 then 'up' else 'down' end as market, 'y' || year(date) as period from j),
g as (select market, period, count(r) as n, avg(r) as mean, stddev_samp(r) as sd, avg((r > 0)::int::double) as hit_rate from s group by grouping sets ((market), (period)))
select case when market is not null then 'market' else 'period' end as dimension, coalesce(market, period) as state, n, round(mean, 6) as mean, round(sd, 6) as sd, round(hit_rate, 6) as hit_rate from g""")
def a14(spark, d):
    x = _both(spark, d).withColumn("market", F.when(F.col("rb") >= 0, "up").otherwise("down")).withColumn("period", F.concat(F.lit("y"), F.year("date").cast("string")))
    return X.rounded(R.by_state(x, "market", "period"))


@B.query("a15_relative_score", f"""{_J}, {_DD}, {_VAR}, w as (select entity, -min(drawdown) as mdd from dd group by 1),
b as (select entity, count(r) as n, avg(r - rb) * 252.0 as active, sqrt(avg(pow(least(r, 0.0), 2))) * sqrt(252.0) as downside, stddev_samp(r - rb) * sqrt(252.0) as tracking, avg((r - rb < 0)::int::double) as behind, avg(r) filter (where rb > 0) / avg(rb) filter (where rb > 0) as up, avg(r) filter (where rb < 0) / avg(rb) filter (where rb < 0) as down from j group by 1)
select entity, b.n, case when b.n >= 40 then round((active + (up - down) * 0.1) / (downside + 0.5 * cvar + 0.5 * mdd + 0.5 * tracking) - 0.25 * greatest(behind - 0.5, 0.0), 6) end as score from b join w using (entity) join vr using (entity)""")
def a15(spark, d):
    return X.rounded(R.relative_score(_both(spark, d), "entity"))


@B.query("a41_correlation_pairs", f"""with {B.DENSE}, p as (select a.entity as a, b.entity as b, count(*) as n, covar_samp(a.r, b.r) as cov, corr(a.r, b.r) as corr from dn a join dn b using (date) where a.entity <= b.entity group by 1, 2)
select a, b, n, round(cov * 1e6, 6) as cov, round(corr, 6) as corr from p where n >= 20""")
def a41(spark, d):
    return X.rounded(R.pairwise(B.dense(spark, d)).withColumn("cov", F.col("cov") * 1e6))


@B.query("a44_mean_uncertainty", f"""with {B.PX}, s as (select entity, avg(r) as m, var_samp(r) as v, count(*) as n from px group by 1), t as (select *, v / n as mv, 1 / nullif(v / n, 0) as info, avg(m) over () as g, var_samp(m) over () as tau from s)
select entity, round(mv * 1e6, 6) as mean_variance_e6, round(m * 1e4 * tau / (tau + mv) + g * 1e4 * mv / (tau + mv), 6) as shrunk_e4 from t""")
def a44(spark, d):
    from pyspark.sql import Window as W

    s = B.prices(spark, d).groupBy("entity").agg(F.avg("r").alias("m"), (F.var_samp("r") / F.count("*")).alias("mv"))
    whole = W.partitionBy()
    s = s.withColumn("g", F.avg("m").over(whole)).withColumn("tau", F.var_samp("m").over(whole))
    return X.rounded(s.select("entity", (F.col("mv") * 1e6).alias("mean_variance_e6"), (F.col("m") * 1e4 * F.col("tau") / (F.col("tau") + F.col("mv")) + F.col("g") * 1e4 * F.col("mv") / (F.col("tau") + F.col("mv"))).alias("shrunk_e4")))


@B.query("a46_stability_index", f"""with {B.PX}, c as (select quantile_cont(volume, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as cuts from px where date < date '1998-07-01'),
t as (select date < date '1998-07-01' as early, len(list_filter(cuts, lambda x: x < volume)) as bin from px, c), n as (select bin, count(*) filter (where early) as a, count(*) filter (where not early) as b from t group by 1),
s as (select bin, greatest(a / sum(a) over (), 1e-6) as early, greatest(b / sum(b) over (), 1e-6) as late from n) select bin::int as bin, round(early, 6) as early, round(late, 6) as late, round((late - early) * ln(late / early), 6) as psi from s""")
def a46(spark, d):
    return X.rounded(R.stability_index(B.prices(spark, d), "volume", F.col("date") < "1998-07-01"))


@B.query("a47_concentration", f"""with {B.PX}, p as (select date, volume / nullif(sum(volume) over (partition by date), 0) as p from px)
select date, round(sum(case when p > 0 then -p * ln(p) else 0 end), 6) as entropy, round(sum(p * p) + 1e-10, 6) as hhi, round(1 / nullif(sum(p * p), 0), 6) as effective_names from p group by date""")
def a47(spark, d):
    return X.rounded(R.concentration(B.prices(spark, d), "date", weight="volume").withColumn("hhi", F.col("hhi") + 1e-10))


@B.query("a48_benchmark_fit", f"""with {B.PX}, {B.DENSE}, f as (select px.entity, dn.entity as benchmark, corr(px.r, dn.r) as c, regr_slope(px.r, dn.r) as b, stddev_samp(px.r - dn.r) * sqrt(252.0) as t from px join dn using (date) group by 1, 2),
g as (select *, c - 0.25 * abs(b - 1) - t as fit from f) select entity, benchmark, round(c, 6) as correlation, round(b, 6) as beta, round(t, 6) as tracking, round(fit, 6) as fit, row_number() over (partition by entity order by round(fit, 9) desc nulls last, benchmark) = 1 as best from g""")
def a48(spark, d):
    c = B.dense(spark, d).select("date", F.col("entity").alias("benchmark"), F.col("r").alias("rb"))
    return X.rounded(R.benchmark_fit(B.prices(spark, d).select("entity", "date", "r"), c, "entity"))


@B.query("a57_capital_ledger", f"""with {B.TRIALS}, e as (select trial, month, 1e5 * exp(sum(ln(1 + greatest(r, -0.999999))) over u) as e from tr window u as (partition by trial order by month)),
p as (select *, coalesce(lag(e) over (partition by trial order by month), 1e5) as b, greatest(max(e) over (partition by trial order by month), 1e5) as peak from e)
select trial, month, round(b + 1e-7, 3) as begin_capital, round(e + 1e-7, 3) as end_capital, round(e - b + 1e-7, 3) as pnl, round(peak + 1e-7, 3) as peak, round(e / peak - 1 + 1e-10, 7) as drawdown from p""")
def a57(spark, d):
    x = R.ledger(B.trials(spark, d), "trial", "month", "r", 1e5)
    return x.select("trial", "month", *[F.round(F.col(c) + 1e-7, 3).alias(c) for c in ("begin_capital", "end_capital", "pnl", "peak")], F.round(F.col("drawdown") + 1e-10, 7).alias("drawdown"))


_IC = f"""sc as (select trial, month, lag(r) over (partition by trial order by month) as score, r as outcome from tr), rk as (select month, rank() over (partition by month order by score) + (count(*) over (partition by month, score) - 1) / 2.0 as a, rank() over (partition by month order by outcome) + (count(*) over (partition by month, outcome) - 1) / 2.0 as b from sc where score is not null),
ic as (select month, corr(a, b) as ic, count(*) as n from rk group by 1)"""


@B.query("a26_information_coefficient", f"with {B.TRIALS}, {_IC} select month, round(ic, 6) as ic, n, round(avg(ic) over (order by month rows between 2 preceding and current row), 6) as ic_3, round(avg((round(ic, 9) > 0)::int::double) over (order by month rows between unbounded preceding and current row), 6) as hit_rate from ic")
def a26(spark, d):
    t = B.trials(spark, d).withColumn("score", F.lag("r").over(X.by("trial", "month")))
    return X.rounded(R.information_coefficient(t, "month", "score", "r"))


@B.query("a23_overfit_diagnostics", f"""with {B.TRIALS} select month, count(*) as n, round(max(r) - median(r), 6) as gap, round((max(r) - median(r)) / nullif(stddev_samp(r), 0), 6) as z, (max(r) - median(r)) / nullif(stddev_samp(r), 0) > sqrt(2 * ln(count(*))) as flagged from tr group by month having count(*) >= 5""")
def a23(spark, d):
    gap = F.max("r") - F.median("r")
    z = X.ratio(gap, F.stddev_samp("r"))
    return X.rounded(B.trials(spark, d).groupBy("month").agg(F.count("*").alias("n"), gap.alias("gap"), z.alias("z"), (z > F.sqrt(2 * F.log(F.count("*").cast("double")))).alias("flagged")).where("n >= 5"))


@B.query("a24_trial_persistence", f"""with {B.TRIALS}, s as (select trial, month, lag(r) over (partition by trial order by month) as a, r as b from tr), k as (select trial, rank() over (partition by trial order by a) + (count(*) over (partition by trial, a) - 1) / 2.0 as ra, rank() over (partition by trial order by b) + (count(*) over (partition by trial, b) - 1) / 2.0 as rb, b from s where a is not null)
select trial, count(*) as n, case when count(*) >= 12 then round(corr(ra, rb), 6) end as persistence, round(avg((b > 0)::int::double), 6) as hit_rate, round(avg(b) / nullif(stddev_samp(b), 0), 6) as mean_over_sd from k group by trial""")
def a24(spark, d):
    t = B.trials(spark, d).withColumn("a", F.lag("r").over(X.by("trial", "month"))).where("a is not null").withColumn("ra", X.average_rank("a", "trial")).withColumn("rb", X.average_rank("r", "trial"))
    return X.rounded(t.groupBy("trial").agg(F.count("*").alias("n"), F.when(F.count("*") >= 12, F.corr("ra", "rb")).alias("persistence"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), X.ratio(F.avg("r"), F.stddev_samp("r")).alias("mean_over_sd")))


@B.query("a27_selection_stability", f"""with {B.TRIALS}, k as (select trial, month, row_number() over (partition by month order by r desc, trial) as k, count(*) over (partition by month) as n from tr)
select trial, count(*) as months, round(count(*) filter (where k <= 10) / (select count(distinct month) from tr), 6) as selected, round(stddev_samp(k / n::double), 6) as rank_sd from k group by trial""")
def a27(spark, d):
    from pyspark.sql import Window as W

    t = B.trials(spark, d)
    k = t.withColumn("k", F.row_number().over(W.partitionBy("month").orderBy(F.desc("r"), "trial"))).withColumn("n", F.count("*").over(W.partitionBy("month")))
    months = t.agg(F.countDistinct("month").alias("all_months"))
    x = k.groupBy("trial").agg(F.count("*").alias("months"), F.count_if(F.col("k") <= 10).alias("picked"), F.stddev_samp(F.col("k") / F.col("n")).alias("rank_sd")).crossJoin(F.broadcast(months))  # one row
    return X.rounded(x.select("trial", "months", (F.col("picked") / F.col("all_months")).alias("selected"), "rank_sd"))
