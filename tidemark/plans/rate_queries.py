"""Queries over rates, options and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import panel as P
from tidemark.operators import rates as R
from tidemark.plans import base as B

_CV = f"cv as (select country, avg(rate) filter (where tenor = 1) as policy, avg(rate) filter (where tenor = 2) as y2, avg(rate) filter (where tenor = 5) as y5, avg(rate) filter (where tenor = 7) as y10 from rt where date >= date '1998-01-01' group by 1)"


def _curves(spark, d):
    r = B.rates(spark, d).where("date >= date '1998-01-01'")
    at = lambda k: F.avg(F.when(F.col("tenor") == k, F.col("rate")))
    return r.groupBy("country").agg(at(1).alias("policy"), at(2).alias("y2"), at(5).alias("y5"), at(7).alias("y10"))


@B.query("p12_curve_metrics", f"""with {B.RATES}, {_CV} select country, round((y2 + y5 + y10) / 3, 6) as level, round(y10 - y2, 6) as slope, round(y2 - policy, 6) as policy_gap, round(2 * y5 - y2 - y10, 6) as curvature, case when y10 - y2 is null then 'unknown' when y10 - y2 < -0.25 then 'inverted' when y10 - y2 < 0.25 then 'flat' when y10 - y2 < 1.5 then 'normal' else 'steep' end as state from cv""")
def p12(spark, d):
    return X.rounded(R.curve_metrics(_curves(spark, d)).select("country", "level", "slope", "policy_gap", "curvature", "state"))


_LT = "lt as (select country, tenor, arg_max(rate, date) as rate, max(date) as date from rt group by 1, 2)"


@B.query("p13_duration_convexity", f"with {B.RATES}, {_LT} select country, tenor, round(tenor / (1 + rate / 100), 6) as duration, round(tenor * (tenor + 1) / pow(1 + rate / 100, 2), 6) as convexity, round(-tenor / (1 + rate / 100) * 0.01 + 0.5 * tenor * (tenor + 1) / pow(1 + rate / 100, 2) * 0.0001, 8) as impact_100bp from lt")
def p13(spark, d):
    x = B.rates(spark, d).groupBy("country", "tenor").agg(F.max_by("rate", "date").alias("rate"))
    y, m = F.col("rate"), F.col("tenor").cast("double")
    return x.select("country", "tenor", F.round(R.modified_duration(y, m), 6).alias("duration"), F.round(R.convexity(y, m), 6).alias("convexity"), F.round(R.price_impact(y, m, F.lit(100.0)), 8).alias("impact_100bp"))


_SCEN = "(values ('up_100', 100.0::double, 100.0::double), ('down_100', -100.0, -100.0), ('steepen', -25.0, 50.0), ('flatten', 50.0, -25.0), ('short_shock', 150.0, 0.0), ('long_shock', 0.0, 150.0)) s(scenario, short_bp, long_bp)"


@B.query("a40_curve_stress", f"""with {B.RATES}, {_LT}, x as (select country, tenor, scenario, rate, case when tenor <= 2 then short_bp else long_bp end / 10000 as dy from lt cross join {_SCEN})
select country, tenor, scenario, round(-tenor / (1 + rate / 100) * dy + 0.5 * tenor * (tenor + 1) / pow(1 + rate / 100, 2) * dy * dy, 8) as impact from x""")
def a40(spark, d):
    s = spark.sql("select * from values ('up_100', 100D, 100D), ('down_100', -100D, -100D), ('steepen', -25D, 50D), ('flatten', 50D, -25D), ('short_shock', 150D, 0D), ('long_shock', 0D, 150D) as t(scenario, short_bp, long_bp)")
    x = B.rates(spark, d).groupBy("country", "tenor").agg(F.max_by("rate", "date").alias("rate"))
    return X.rounded(R.curve_stress(x, s).select("country", "tenor", "scenario", "impact"), 8)


@B.query("w40_period_change", f"""with {B.RATES}, k as (select a.country, a.tenor, a.date, a.rate, max(b.date) as then_ from rt a left join rt b on a.country = b.country and a.tenor = b.tenor and b.date <= a.date - interval 3 month where a.tenor = 1 group by 1, 2, 3, 4)
select k.country, k.date, round(k.rate - b.rate, 6) as change_3m from k left join rt b on b.country = k.country and b.tenor = k.tenor and b.date = k.then_""")
def w40(spark, d):
    x = R.change_since(B.rates(spark, d).where("tenor = 1"), 3, ["country", "tenor"], "date", "rate")
    return X.rounded(x.select("country", "date", "change_3m"))


@B.query("w45_latest_sample", f"with {B.RATES}, k as (select *, row_number() over (partition by country, tenor order by date desc) as k from rt) select country, tenor, date, round(rate, 6) as rate, k from k where k <= 5")
def w45(spark, d):
    from pyspark.sql import Window as W

    k = F.row_number().over(W.partitionBy("country", "tenor").orderBy(F.desc("date"))).cast("long")
    return X.rounded(B.rates(spark, d).withColumn("k", k).where("k <= 5").select("country", "tenor", "date", "rate", "k"))


@B.query("w41_monthly_change", f"""with {B.RATES}, m as (select country, date_trunc('month', date)::date as month, arg_max(rate, (date, tenor)) as rate from rt group by 1, 2) select country, month, round(rate, 6) as rate, round(rate - lag(rate, 12) over (partition by country order by month), 6) as yoy from m""")
def w41(spark, d):
    m = B.rates(spark, d).groupBy("country", F.to_date(F.trunc("date", "month")).alias("month")).agg(F.max_by("rate", F.struct("date", "tenor")).alias("rate"))
    return X.rounded(m.withColumn("yoy", F.col("rate") - F.lag("rate", 12).over(X.by("country", "month"))))


@B.query("w20_composite_tone", f"""with {B.DENSE}, z as (select entity, date, (volume - avg(volume) over w) / nullif(stddev_samp(volume) over w, 0) as a, (r - avg(r) over w) / nullif(stddev_samp(r) over w, 0) as b, count(*) over w as n from dn window w as (partition by entity order by date rows between 251 preceding and current row)), t as (select entity, date, case when n >= 60 then 0.6 * b - 0.4 * a end as tone from z)
select entity, date, round(tone, 6) as tone, case when tone is null then 'unknown' when tone > 0.5 then 'bullish' when tone < -0.5 then 'bearish' else 'neutral' end as label from t""")
def w20(spark, d):
    x = P.rolling_z(P.rolling_z(B.dense(spark, d), "volume", out="a"), "r", out="b").withColumn("tone", 0.6 * F.col("b") - 0.4 * F.col("a"))
    return X.rounded(x.select("entity", "date", "tone", F.when(F.col("tone").isNull(), "unknown").when(F.col("tone") > 0.5, "bullish").when(F.col("tone") < -0.5, "bearish").otherwise("neutral").alias("label")))


@B.query("a66_rate_summary", f"""with {B.RATES}, l as (select country, tenor, max(date) as latest, arg_max(rate, date) as rate, count(*) as n from rt group by 1, 2), t as (select max(date) as t from rt) select country, tenor, latest, round(rate, 6) as rate, n, (t - latest)::int as stale_days, (t - latest) <= 45 as comparable from l, t""")
def a66(spark, d):
    from pyspark.sql import Window as W

    x = B.rates(spark, d).groupBy("country", "tenor").agg(F.max("date").alias("latest"), F.max_by("rate", "date").alias("rate"), F.count("*").alias("n"))
    stale = F.date_diff(F.max("latest").over(W.partitionBy()), "latest")
    return X.rounded(x.withColumn("stale_days", stale).withColumn("comparable", F.col("stale_days") <= 45))


@B.query("a67_curve_quality", f"""with {B.RATES}, q as (select country, count(distinct tenor) as tenors, count(*) as n, max(date) as last from rt group by 1), t as (select max(last) as t from q) select country, tenors, n, round(0.4 * least(tenors / 7.0, 1.0) + 0.3 * least(n / 2000.0, 1.0) + 0.3 * exp(-(t - last) / 30.0), 6) as quality from q, t""")
def a67(spark, d):
    from pyspark.sql import Window as W

    x = B.rates(spark, d).groupBy("country").agg(F.countDistinct("tenor").alias("tenors"), F.count("*").alias("n"), F.max("date").alias("last"))
    age = F.date_diff(F.max("last").over(W.partitionBy()), "last")
    return X.rounded(x.select("country", "tenors", "n", (0.4 * F.least(F.col("tenors") / 7.0, F.lit(1.0)) + 0.3 * F.least(F.col("n") / 2000.0, F.lit(1.0)) + 0.3 * F.exp(-age / 30.0)).alias("quality")))


_CC = f"""kn as (select * from rt where date <= date '1998-09-30'), kl as (select country, arg_max(rate, case when tenor = 1 then date end) filter (where tenor = 1) as policy, arg_max(rate, date) filter (where tenor = 2) as short, arg_max(rate, date) filter (where tenor = 7) as long, max(date) filter (where tenor in (1, 2, 7)) as as_of from kn group by 1),
kd as (select country, date, avg(rate) filter (where tenor = 2) as a, avg(rate) filter (where tenor = 7) as b from kn where tenor in (2, 7) group by 1, 2 having a is not null and b is not null),
kh as (select country, date, b - a as slope, (a + b) / 2 as level, row_number() over (partition by country order by date desc) as k, ((a + b) / 2 - lag((a + b) / 2) over (partition by country order by date)) * 100 as step, max(date) over (partition by country) as last from kd),
kp as (select country, count(*) as history, {", ".join(f"(max(case when k = 1 then {v} end) - arg_max({v}, date) filter (where date <= last - {n})) * 100 as {v}_{m}_bp" for v, n, m in (("slope", 31, "1m"), ("slope", 92, "3m"), ("level", 92, "3m")))}, case when count(step) filter (where k <= {R.VOL_ROWS}) >= {R.LEAST_VOL_ROWS} then stddev_samp(step) filter (where k <= {R.VOL_ROWS}) end as change_vol_bp from kh group by 1),
kx as (select kl.*, coalesce(history, 0) as history, slope_1m_bp, slope_3m_bp, level_3m_bp, change_vol_bp, (short + long) / 2 as level, long - short as slope, short - policy as policy_gap, (short is not null)::int + (long is not null)::int as tenors, greatest(date '1998-09-30' - as_of, 0) as stale_days from kl left join kp using (country))"""


@B.query("a67_country_curves", f"""with {B.RATES}, {_CC} select country, as_of, round(policy, 6) as policy, round(short, 6) as short, round(long, 6) as long, round(level, 6) as level, round(slope, 6) as slope, round(policy_gap, 6) as policy_gap, case when slope is null then 'unknown' when slope < -0.25 then 'inverted' when slope < 0.25 then 'flat' when slope < 1.5 then 'normal' else 'steep' end as state,
round(slope_1m_bp, 5) as slope_1m_bp, round(slope_3m_bp, 5) as slope_3m_bp, round(level_3m_bp, 5) as level_3m_bp, round(change_vol_bp, 5) as change_vol_bp, round(2 / (1 + short / 100), 6) as duration_short, round(10 / (1 + long / 100), 6) as duration_long, round(6 / pow(1 + short / 100, 2), 6) as convexity_short, round(110 / pow(1 + long / 100, 2), 6) as convexity_long,
tenors::bigint as tenors, history, stale_days::int as stale_days, round({R.QUALITY["tenors"]} * tenors / 2 + {R.QUALITY["policy"]} * (policy is not null)::int + {R.QUALITY["history"]} * least(history / {R.FULL_HISTORY}.0, 1.0) + {R.QUALITY["recency"]} * case when stale_days <= {R.FRESH_DAYS} then 1.0 when stale_days <= {R.STALE_DAYS} then 0.5 else 0.0 end::double, 6) as quality_score,
case when tenors >= 2 and history >= {R.FEWEST_HISTORY} and stale_days <= {R.OLDEST_DAYS} then 'High' when tenors >= 2 then 'Medium' else 'Insufficient' end as quality from kx""")
def a67_curves(spark, d):
    x = R.country_curves(B.rates(spark, d), F.lit("1998-09-30").cast("date"), (1, 2, 7))
    five = [F.round(c, 5).alias(c) for c in ("slope_1m_bp", "slope_3m_bp", "level_3m_bp", "change_vol_bp")]
    six = [F.round(c, 6).alias(c) for c in ("policy", "short", "long", "level", "slope", "policy_gap", "duration_short", "duration_long", "convexity_short", "convexity_long", "quality_score")]
    return x.select("country", "as_of", "state", "tenors", "history", "stale_days", "quality", *five, *six)


_OS = """lv as (select * from op where dte >= 7), nr as (select entity, min(dte) as dte from lv group by 1), ow as (select lv.* from lv join nr using (entity, dte))"""


@B.query("a28_option_summary", f"""with {B.OPTIONS}, {_OS} select entity, dte, round(arg_min(iv, (abs(moneyness - 1.0), contract, leg)), 6) as atm_iv, round(arg_min(iv, (abs(moneyness - 0.95::double), contract, leg)) - arg_min(iv, (abs(moneyness - 1.05::double), contract, leg)), 6) as skew,
round(sum(case when kind = 'put' then open_interest else 0 end) / nullif(sum(case when kind = 'call' then open_interest else 0 end), 0), 6) as put_call, round(median((ask - bid) / ((ask + bid) / 2)), 6) as spread, count(*) as contracts from ow group by 1, 2""")
def a28(spark, d):
    return X.rounded(R.option_summary(B.options(spark, d)))


@B.query("a29_iv_surface", f"""with {B.OPTIONS} select entity, case when dte <= 30 then '000-030' when dte <= 90 then '031-090' when dte <= 180 then '091-180' else '181+' end as dte_bin, case when round(moneyness, 6) <= 0.9 then 'low' when round(moneyness, 6) <= 1.0 then 'below' when round(moneyness, 6) <= 1.1 then 'above' else 'high' end as moneyness_bin,
round(sum(iv * open_interest) / nullif(sum(open_interest), 0), 6) as iv, count(*) as contracts from op group by 1, 2, 3""")
def a29(spark, d):
    return X.rounded(R.iv_surface(B.options(spark, d)))


@B.query("a30_event_risk", """with e as (select event_type, ts, 1 + user_id % 3 as impact from events), h as (select *, (epoch_us(ts) - epoch_us(timestamp '2024-01-15 00:00:00')) / 3.6e9::double as h from e)
select event_type, round(sum(impact * exp(-abs(h) / 48.0)), 5) as risk, count(*) filter (where impact >= 3) as high, count(*) filter (where impact = 2) as medium, min(ts) filter (where h >= 0) as next_time from h where h between -6 and 168 group by 1""")
def a30(spark, d):
    e = B.table(spark, d, "events").select("event_type", "ts", (1 + F.col("user_id") % 3).alias("impact"))
    x = R.event_risk(e, F.lit("2024-01-15 00:00:00").cast("timestamp"), "event_type")
    return X.rounded(x, 5)


_HOURS = "hr as (select event_type, date_trunc('hour', ts) as hour, count(*) as n from events group by 1, 2)"


@B.query("a31_attention_shock", f"""with {_HOURS}, m as (select *, median(n) over (partition by event_type) as mid from hr), s as (select event_type, count(*) as n, count(distinct n) as dis, max(mid) as mid, median(abs(n - mid)) as mad, stddev_samp(n) as sd, avg(n) as mean, arg_max(n, hour) as latest from m group by 1)
select event_type, s.n, latest, round(greatest(least(case when mad > 1e-12 then (latest - mid) / (1.4826::double * mad) else (latest - mean) / case when sd > 1e-12 then sd end end, 5.0), -5.0), 6) as shock, round((select avg((hr.n <= s.latest)::int::double) from hr where hr.event_type = s.event_type), 6) as percentile, s.n >= 20 and dis >= 4 as admissible from s""")
def a31(spark, d):
    h = B.table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n_events"))
    return X.rounded(R.attention_shock(h, "event_type", "hour", "n_events"))


@B.query("a32_topic_audit", "select event_type, count(*) as n, count(distinct user_id) as users, count(*) filter (where value > 50) as large, round(max(value), 6) as worst from events group by 1")
def a32(spark, d):
    return X.rounded(B.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("large"), F.max("value").alias("worst")))


@B.query("a33_country_heat", """with a as (select n_name as country, event_type, user_id, value from events join nation on user_id % 25 = n_nationkey), h as (select country, count(*) as n, count(distinct user_id) / count(*)::double as diversity, avg(value) as intensity from a group by 1),
m as (select country, event_type, count(*) as c from a group by 1, 2), d as (select country, arg_min(event_type, (-c, event_type)) as dominant from m group by 1), x as (select h.*, dominant, ln(1 + n) * diversity * intensity as heat from h join d using (country)),
p as (select *, (rank() over (order by round(heat, 9)) + (count(*) over (partition by round(heat, 9)) - 1) / 2.0) / count(*) over () as pct from x)
select country, n, round(diversity, 6) as diversity, round(intensity, 6) as intensity, dominant, round(heat, 6) as heat, round(pct, 6) as percentile, case when pct >= 0.9 then 'extreme' when pct >= 0.7 then 'high' when pct >= 0.4 then 'medium' else 'low' end as level from p""")
def a33(spark, d):
    n = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("country"))
    a = B.table(spark, d, "events").join(F.broadcast(n), F.col("user_id") % 25 == F.col("k"))  # one row for each nation
    return X.rounded(R.heat(a, "country", "event_type", "user_id", "value"))


@B.query("p15_label_ladders", "select event_id, case when value >= 75 then 'high' when value >= 40 then 'medium' when value >= 10 then 'low' else 'none' end as level from events")
def p15(spark, d):
    v = F.col("value")
    return B.table(spark, d, "events").select("event_id", F.when(v >= 75, "high").when(v >= 40, "medium").when(v >= 10, "low").otherwise("none").alias("level"))


@B.query("p24_regime_decay", "with h as (select n_nationkey as id, case n_regionkey when 0 then 21.0 when 1 then 42.0 when 2 then 63.0 else 126.0 end as half from nation) select id, half::double as half_life, round(exp(-21 / half), 6) as decay from h")
def p24(spark, d):
    half = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in (0, 21.0, 1, 42.0, 2, 63.0)]), F.col("n_regionkey").cast("int")), F.lit(126.0))
    return X.rounded(B.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), half.alias("half_life"), F.exp(-21 / half).alias("decay")))


@B.query("p29_common_currency", "with q as (select n_nationkey as id, n_nationkey % 3 as kind, 0.5::double + n_nationkey as pair from nation) select id, round(case when kind = 0 then 1.0 when kind = 1 then pair else 1 / pair end, 6)::double as usd_value from q")
def p29(spark, d):
    kind, pair = F.col("n_nationkey") % 3, 0.5 + F.col("n_nationkey")
    return X.rounded(B.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(kind == 0, F.lit(1.0)).when(kind == 1, pair).otherwise(F.try_divide(F.lit(1.0), pair)).alias("usd_value")))


@B.query("p04_period_start", "with p as (select n_nationkey as id, (n_nationkey % 3 + 1) || (case n_nationkey % 3 when 0 then 'y' when 1 then 'mo' else 'd' end) as period from nation) select id, period, case when period like '%y' then (date '2001-06-30' - interval (12 * replace(period, 'y', '')::int) month)::date when period like '%mo' then (date '2001-06-30' - interval (replace(period, 'mo', '')::int) month)::date else date '2001-06-30' - replace(period, 'd', '')::int end as start from p")
def p04(spark, d):
    end = F.lit("2001-06-30").cast("date")
    p = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat((F.col("n_nationkey") % 3 + 1).cast("string"), F.element_at(F.array(F.lit("y"), F.lit("mo"), F.lit("d")), (F.col("n_nationkey") % 3 + 1).cast("int"))).alias("period"))
    n, unit = F.regexp_extract("period", r"^(\d+)", 1).cast("int"), F.regexp_extract("period", r"([a-z]+)$", 1)
    return p.withColumn("start", F.when(unit == "y", F.add_months(end, -12 * n)).when(unit == "mo", F.add_months(end, -n)).otherwise(F.date_sub(end, n)))


@B.query("p14_closed_bins", f"""with {B.OPTIONS}, b as (select iv, case when dte <= 30 then '000-030' when dte <= 90 then '031-090' when dte <= 180 then '091-180' else '181+' end as dte_bin, case when round(moneyness, 6) <= 0.9 then 'low' when round(moneyness, 6) <= 1.0 then 'below' when round(moneyness, 6) <= 1.1 then 'above' else 'high' end as moneyness_bin from op)
select dte_bin, moneyness_bin, count(*) as n, round(avg(iv), 6) as iv from b group by 1, 2""")
def p14(spark, d):
    x = B.options(spark, d)
    x = x.select(R.dte_bucket(F.col("dte")).alias("dte_bin"), R.moneyness_bucket(F.round("moneyness", 6)).alias("moneyness_bin"), "iv")
    return X.rounded(x.groupBy("dte_bin", "moneyness_bin").agg(F.count("*").alias("n"), F.avg("iv").alias("iv")))
