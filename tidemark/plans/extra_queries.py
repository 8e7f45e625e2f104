"""Small projections, strategy families, universes, attribution and validation summaries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import families as Y
from tidemark.operators import linalg as L
from tidemark.operators import panel as P
from tidemark.operators import recursion as R
from tidemark.operators import resample as S
from tidemark.operators import risk as K
from tidemark.operators import scoring as C
from tidemark.operators import spectra as Z
from tidemark.plans import base as B
from tidemark.sources.files import symbol

_UP = "(partition by entity order by date rows between unbounded preceding and current row)"


@B.query("p01_safe_ratio", "select l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity - 25, 0), 6) as ratio from lineitem")
def p01(spark, d):
    x = B.table(spark, d, "lineitem")
    return X.rounded(x.select("l_orderkey", "l_linenumber", X.ratio("l_extendedprice", F.col("l_quantity") - 25).alias("ratio")))


@B.query("p02_label_match", """with l as (select n_nationkey as id, ' ' || lower(n_name) || '--' as raw from nation), k as (select n_name as label, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') as key from nation) select id, label from l join k on regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') = key""")
def p02(spark, d):
    n = B.table(spark, d, "nation")
    key = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    raw = n.select(F.col("n_nationkey").alias("id"), key(F.concat(F.lit(" "), F.lower("n_name"), F.lit("--"))).alias("key"))
    return raw.join(n.select(F.col("n_name").alias("label"), key(F.col("n_name")).alias("key")), "key").select("id", "label")


@B.query("p03_symbols", "select s_suppkey as id, replace(replace(replace(upper(trim(' ' || s_name || ' ')), '.', '-'), '/', '-'), ' ', '-') as symbol from supplier")
def p03(spark, d):
    return B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), symbol(F.concat(F.lit(" "), "s_name", F.lit(" "))).alias("symbol"))


@B.query("p06_after_tax_profit", f"with {B.FILINGS} select filing, round(greatest(least(coalesce(tax / nullif(pretax, 0), 0.21), 0.45), 0.0), 6) as rate, round(ebit * (1 - greatest(least(coalesce(tax / nullif(pretax, 0), 0.21), 0.45), 0.0)), 3) as nopat from fl")
def p06(spark, d):
    x = B.filings(spark, d)
    return x.select("filing", F.round(C.tax_rate(), 6).alias("rate"), F.round(F.col("ebit") * (1 - C.tax_rate()), 3).alias("nopat"))


@B.query("p17_sign_splits", f"with {B.PX} select entity, date, round(greatest(r, 0) + 1e-10, 8) as up, round(least(r, 0) + 1e-10, 8) as down, round(ln(1 + volume), 6) as log_volume from px")
def p17(spark, d):
    x = B.prices(spark, d)
    return x.select("entity", "date", F.round(F.greatest("r", F.lit(0.0)) + 1e-10, 8).alias("up"), F.round(F.least("r", F.lit(0.0)) + 1e-10, 8).alias("down"), F.round(F.log1p("volume"), 6).alias("log_volume"))


@B.query("j07_keyed_side_data", f"with {B.FILINGS}, {B.CUSTOMERS}, m as (select entity, max(available) as last from fl group by 1) select cu.entity, sector, last from cu left join m using (entity)")
def j07(spark, d):
    m = B.filings(spark, d).groupBy("entity").agg(F.max("available").alias("last"))
    return B.customers(spark, d).select("entity", "sector").join(m, "entity", "left")


@B.query("t1_sorted_nulls_last", "select c_custkey as id, case when c_custkey % 5 <> 0 then c_acctbal end as balance from customer order by balance desc nulls last, id")
def t1(spark, d):
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("balance"))
    return c.orderBy(F.desc_nulls_last("balance"), "id")


@B.query("t3_lexicographic_best", f"with {B.TRIALS}, s as (select trial, count(*) as n, round(avg(r), 9) as m, round(stddev_samp(r), 9) as s from tr group by 1) select trial % 10 as g, arg_min(trial, (-n, -m, s, trial)) as best from s group by 1")
def t3(spark, d):
    s = B.trials(spark, d).groupBy("trial").agg(F.count("*").alias("n"), F.round(F.avg("r"), 9).alias("m"), F.round(F.stddev_samp("r"), 9).alias("s"))
    return s.groupBy((F.col("trial") % 10).alias("g")).agg(F.min_by("trial", F.struct(-F.col("n"), -F.col("m"), "s", "trial")).alias("best"))


@B.query("t5_misaligned_union", "select s_suppkey as id, s_acctbal as balance, null::varchar as segment from supplier union all select c_custkey, c_acctbal, c_mktsegment from customer")
def t5(spark, d):
    s = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    c = B.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return s.unionByName(c, allowMissingColumns=True)


@B.query("t7_keep_first_and_last", "select o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as last_order from orders group by 1")
def t7(spark, d):
    k = F.struct("o_orderdate", "o_orderkey")
    return B.table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", k).alias("first_order"), F.max_by("o_orderkey", k).alias("last_order"))


@B.query("a03_benchmark_relation", f"with {B.PX}, {B.MARKET} select entity, round(covar_samp(r, rb) / var_samp(rb), 6) as beta, round(corr(r, rb), 6) as correlation, round(pow(corr(r, rb), 2), 6) as r2 from px join mk using (date) group by 1")
def a03(spark, d):
    p = B.prices(spark, d)
    x = p.join(B.market(p), "date").groupBy("entity").agg((F.covar_samp("r", "rb") / F.var_samp("rb")).alias("beta"), F.corr("r", "rb").alias("correlation"), F.pow(F.corr("r", "rb"), 2).alias("r2"))
    return X.rounded(x)


@B.query("a34_article_proxy", "select source, count(*) as articles, count(distinct lang) as languages, round(avg(n_chars), 4) as mean_chars, round(ln(1 + count(*)) * avg((n_chars > 2000)::int::double), 6) as proxy from documents group by 1")
def a34(spark, d):
    x = B.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("articles"), F.countDistinct("lang").alias("languages"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), (F.log1p(F.count("*").cast("double")) * F.avg((F.col("n_chars") > 2000).cast("double"))).alias("proxy"))
    return X.rounded(x)


@B.query("a37_period_attribution", f"""with {B.PX}, {B.MARKET}, b as (select entity, regr_slope(r, rb) as beta from px join mk using (date) where date < date '1998-01-01' group by 1 having count(*) >= 40), x as (select date_trunc('month', date)::date as month, avg(beta * rb) as factor, avg(r - beta * rb) as specific, -0.0005::double as cost from px join mk using (date) join b using (entity) where date >= date '1998-01-01' group by 1)
select month, part, round(value, 8) as value from (unpivot x on factor, specific, cost into name part value value)""")
def a37(spark, d):
    p = B.prices(spark, d)
    x = p.join(B.market(p), "date")
    b = L.factor_betas(x.where("date < date '1998-01-01'"), "entity", "r", ["rb"]).where("factor = 'rb'").select("entity", "beta")
    y = x.where("date >= date '1998-01-01'").join(b, "entity").groupBy(F.to_date(F.trunc("date", "month")).alias("month")).agg(F.avg(F.col("beta") * F.col("rb")).alias("factor"), F.avg(F.col("r") - F.col("beta") * F.col("rb")).alias("specific"), F.lit(-0.0005).alias("cost"))
    return X.rounded(y.unpivot("month", ["factor", "specific", "cost"], "part", "value"), 8)


@B.query("a64_uncertainty_state")
def a64(spark, d):
    """One row: mean, volatility and information of all regions' returns, mean filter gain, confidence, concentration by volume, and the spectrum of the suppliers' returns."""
    dn = B.dense(spark, d)
    mean = dn.agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("vol"), X.ratio(F.count("*").cast("double"), F.var_samp("r")).alias("information"))
    gain = R.local_level(dn).agg(F.avg("gain").alias("filter_gain"))
    entropy = K.concentration(dn.groupBy("entity").agg(F.sum("volume").alias("weight"))).select("entropy", "effective_names")
    told = Z.spectrum(Z.modes(*Z.centred_window(B.prices(spark, d))))
    seen = told.agg(F.max("effective_rank").alias("effective_rank"), F.max("noise_fraction").alias("noise_fraction"), (F.max("edge") * 1e6).alias("edge_e6"), F.max("signal_modes").alias("signal_modes"))
    state = mean.crossJoin(gain).crossJoin(entropy).crossJoin(seen)  # one row each
    return X.rounded(state.withColumn("filter_confidence", 1 - F.col("filter_gain")))


@B.query("w15_penalties", f"""with {B.FILINGS}, r as (select filing, entity, net_income / revenue as x, (filing % 10) / 10.0::double as risk from fl), m as (select *, median(case when x > 0 then x end) over () as mid from r) select filing, round(x * (1 - 0.5::double * risk) * case when x > mid then 1.0 else 0.9 end, 6) as penalised from m""")
def w15(spark, d):
    x = B.filings(spark, d).select("filing", (F.col("net_income") / F.col("revenue")).alias("x"), ((F.col("filing") % 10) / 10.0).alias("risk"))
    x = X.with_group(x, [], mid=F.median(F.when(F.col("x") > 0, F.col("x"))))
    return X.rounded(x.select("filing", (F.col("x") * (1 - 0.5 * F.col("risk")) * F.when(F.col("x") > F.col("mid"), 1.0).otherwise(0.9)).alias("penalised")))


_F8 = "(partition by entity order by date rows between {n} preceding and current row)"


@B.query("w17_strategy_families", f"""with {B.DENSE}, mk as (select date, round(avg(r), 10) as rb from dn group by date), j as (select * from dn join mk using (date)), f as (select entity, date, row_number() over (partition by entity order by date) as i, close / lag(close, 252) over (partition by entity order by date) - 1 as mom, close / lag(close, 21) over (partition by entity order by date) - 1 as short, stddev_samp(r) over {_F8.format(n=62)} as vol, sqrt(avg(pow(least(r, 0.0), 2)) over {_F8.format(n=62)}) as dn,
avg(case when rb > 0 then r end) over {_F8.format(n=251)} / avg(case when rb > 0 then rb end) over {_F8.format(n=251)} as up, avg(case when rb < 0 then r end) over {_F8.format(n=251)} / avg(case when rb < 0 then rb end) over {_F8.format(n=251)} as down from j)
select entity, date, round(mom / nullif(vol, 0), 5) as vol_adjusted_trend, round(-short, 6) as reversal, round(case when mom > 0 then mom else 0 end, 6) as dual_momentum, round(up - down, 5) as asymmetric_capture, round(mom / nullif(dn, 0), 5) as downside_governed from f where i > 252""")
def w17(spark, d):
    dn = B.dense(spark, d)
    w = X.by("entity", "date")
    x = dn.join(B.market(dn), "date")
    over = lambda n: X.last_rows(w, n)
    side = lambda c: F.avg(F.when(c, F.col("r"))).over(over(252)) / F.avg(F.when(c, F.col("rb"))).over(over(252))
    x = x.withColumns({"i": F.row_number().over(w), "mom": F.try_divide(F.col("close"), F.lag("close", 252).over(w)) - 1, "short": F.try_divide(F.col("close"), F.lag("close", 21).over(w)) - 1, "vol": F.stddev_samp("r").over(over(63)), "down_dev": F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2)).over(over(63))), "up": side(F.col("rb") > 0), "down": side(F.col("rb") < 0)})
    return x.where("i > 252").select("entity", "date", F.round(X.ratio("mom", "vol"), 5).alias("vol_adjusted_trend"), F.round(-F.col("short"), 6).alias("reversal"), F.round(F.greatest("mom", F.lit(0.0)), 6).alias("dual_momentum"), F.round(F.col("up") - F.col("down"), 5).alias("asymmetric_capture"), F.round(X.ratio("mom", "down_dev"), 5).alias("downside_governed"))


def _wi(n: int, v: str = "1") -> str:
    return f"case when pos > at_ - {n} then {v} end"


_FAM = f"""mk as (select date, round(avg(r), 10) as rb from dn group by date), fd as (select *, lag(idx, {Y.SKIP}) over (order by date) as idxl from (select date, rb, row_number() over (order by date) as pos, exp(sum(ln(1 + rb)) over (order by date)) as idx from mk)),
fa as (select date as signal, pos as at_ from fd where pos >= 252 and date in (select max(date) from mk group by date_trunc('month', date))), fw as (select signal, at_, pos, date, rb, idx, idxl from fd join fa on pos <= at_ and pos > at_ - 252),
fm as (select signal, count(*) as days, arg_max(idxl, pos) / arg_min(idx, pos) - 1 as mm from fw group by 1), fr as (select *, lag(close, {Y.SKIP}) over (partition by entity order by date) as lg, row_number() over (partition by entity order by date) as i from dn),
fx as (select *, max(i) over (partition by signal, entity) - i + 1 as k from (select fr.*, signal, at_, pos, rb from fr join fw using (date))),
fg as (select signal, entity, {", ".join(f"count({_wi(n)}) as n{n}, covar_samp({_wi(n, 'r')}, {_wi(n, 'rb')}) / nullif(var_samp({_wi(n, 'rb')}), 0) as beta{n}, sum({_wi(n, 'r')}) as sum{n}, sum({_wi(n, 'rb')}) as bsum{n}, arg_min({_wi(n, 'close')}, {_wi(n, 'pos')}) as first{n}, quantile_cont({_wi(n, 'rb')}, {Y.TAIL}) as low{n}" for n in (63, 126, 252))},
  avg(r) filter (where pos > at_ - 126 and rb > 0) / avg(rb) filter (where pos > at_ - 126 and rb > 0) as cu, avg(r) filter (where pos > at_ - 126 and rb < 0) / avg(rb) filter (where pos > at_ - 126 and rb < 0) as cd, sqrt(avg({_wi(126, "pow(least(r, 0.0), 2)")})) as downside, stddev_samp(r) filter (where k <= 63) * sqrt(252.0::double) as vol,
  arg_max(lg, pos) as recent, arg_max(close, pos) as last, sum(r) filter (where k <= 5) as sum5, sum(rb) filter (where k <= 5) as bsum5, var_samp(r) filter (where k <= 21) as v21, var_samp(rb) filter (where k <= 21) as bv21, covar_samp(r, rb) filter (where k <= 21) as c21 from fx group by 1, 2),
ft as (select signal, entity, avg(r) / avg(rb) as tail_beta from fx join fg using (signal, entity) where pos > at_ - 126 and round(rb, 12) <= round(low126, 12) group by 1, 2),
fz as (select *, case when n252 >= {Y.LEAST_YEAR} then recent / first252 - 1 end as mom, sqrt(greatest(v21 + beta63 * beta63 * bv21 - 2 * beta63 * c21, 0)) as noise from fg join fm using (signal) left join ft using (signal, entity))"""


@B.query("w17_families_at_signals", f"""with {B.DENSE}, {_FAM} select signal, entity, round(case when n252 >= 126 then mom end, 6) as momentum_12_1, round(case when n252 >= 126 and mom > 0 and vol > 1e-12 then mom / vol end, 6) as vol_adjusted_trend, round(case when n252 >= 126 and mom > 0 and round(mom - mm, 12) > 0 and days >= {Y.LEAST_YEAR} then mom - mm end, 6) as dual_momentum,
round(case when n126 >= 63 then sum126 - beta126 * bsum126 end, 6) as residual_momentum, round(case when n126 >= 63 then cu - cd - 0.5::double * greatest(tail_beta - 1, 0) end, 6) as asymmetric_capture, round(case when n126 >= 63 then last / first126 - 1 + 0.35::double * (cu - cd) - 4 * downside end, 6) as defensive_convexity,
round(case when n63 >= 42 and noise > 1e-12 then -(sum5 - beta63 * bsum5) / noise end, 6) as residual_reversion, round(case when n252 >= 126 then mom end, 6) as downside_controlled_momentum from fz""")
def w17_families(spark, d):
    """At the last day of each month of the regional panel."""
    dn = B.dense(spark, d)
    mk = B.market(dn)
    signals = mk.groupBy(F.trunc("date", "month")).agg(F.max("date").alias("signal")).select("signal")
    return X.rounded(Y.family_scores(dn, mk, signals))


@B.query("w36_convex_universe", f"""with {B.PX}, {B.MARKET}, f as (select entity, avg(r) filter (where rb > 0) / avg(rb) filter (where rb > 0) as up, avg(r) filter (where rb < 0) / avg(rb) filter (where rb < 0) as down, stddev_samp(r) as v from px join mk using (date) group by 1), t as (select quantile_cont(up - down, 0.7) as c, quantile_cont(v, 0.8) as v from f),
u as (select entity, 1 as quota, up - down as s from f, t where up - down >= t.c union all select entity, 2, -down from f, t where f.v <= t.v), k as (select *, row_number() over (partition by entity order by quota) as k from u), o as (select *, row_number() over (order by quota, round(s, 9) desc, entity) as o from k where k = 1) select entity, quota, o::int as place from o""")
def w36(spark, d):
    p = B.prices(spark, d)
    x = p.join(B.market(p), "date")
    f = K.capture(x, "entity").join(x.groupBy("entity").agg(F.stddev_samp("r").alias("v")), "entity").withColumn("c", F.col("up_capture") - F.col("down_capture"))
    f = X.with_group(f, [], tc=F.percentile("c", 0.7), tv=F.percentile("v", 0.8))
    u = f.where("c >= tc").select("entity", F.lit(1).alias("quota"), F.col("c").alias("s")).union(f.where("v <= tv").select("entity", F.lit(2), -F.col("down_capture")))
    k = u.withColumn("k", F.row_number().over(W.partitionBy("entity").orderBy("quota"))).where("k = 1")
    place = F.row_number().over(W.orderBy("quota", F.round("s", 9).desc(), "entity"))  # one row an entity
    return k.select("entity", "quota", place.alias("place"))


@B.query("w37_defensive_anchor", f"""with {B.PX}, f as (select entity, stddev_samp(r) * 100 as v from px group by 1), a as (select *, median(v) over () as mid from f), b as (select *, median(abs(v - mid)) over () * 1.4826::double as mad from a), z as (select entity, greatest(-greatest(least((v - mid) / mad, 3.0), -3.0), 0.0) as w from b), n as (select entity, w / sum(w) over () as w from z), c as (select entity, least(w, 0.03::double) as c from n), r as (select *, 0.03::double - c as room, 1 - sum(c) over () as over_, sum(0.03::double - c) over () as rooms from c)
select entity, round(c + case when over_ > 1e-12 and rooms > 0 then least(over_, rooms) * room / rooms else 0 end, 6) as weight from r""")
def w37(spark, d):
    f = B.prices(spark, d).groupBy("entity").agg((F.stddev_samp("r") * 100).alias("v"))
    z = P.mad_z(f, "v").withColumn("weight", F.greatest(-F.col("z_v"), F.lit(0.0)))
    return X.rounded(P.capped_by_room(z, 0.03).select("entity", F.col("capped").alias("weight")))


@B.query("w48_rate_matrix", f"with {B.RATES} select country, " + ", ".join(f"round(arg_max(rate, date) filter (where tenor = {k}), 6) as y{k}" for k in range(1, 8)) + " from rt group by 1")
def w48(spark, d):
    x = B.rates(spark, d).groupBy("country").pivot("tenor", list(range(1, 8))).agg(F.max_by("rate", "date"))
    return X.rounded(x.select("country", *[F.col(str(k)).alias(f"y{k}") for k in range(1, 8)]))


@B.query("b03_circular_blocks", f"""with {B.PX}, sr as (select row_number() over (order by date) - 1 as pos, date, r from (select date, round(avg(r), 10) as r from px group by 1)), n as (select count(*) as n from sr),
ix as (select rep, i, (floor((('0x' || substr(md5('9|' || rep || '|' || (i // 10)), 1, 8))::ubigint / 4294967296.0::double) * n)::bigint + i % 10) % n as pos from range(20) a(rep), n, range(n) b(i))
select rep::int as rep, i::int as i, ix.pos::int as pos, date, round(r, 6) as r from ix join sr using (pos)""")
def b03(spark, d):
    days = B.prices(spark, d).groupBy("date").agg(F.round(F.avg("r"), 10).alias("r"))
    series = days.withColumn("pos", (F.row_number().over(W.orderBy("date")) - 1).cast("int"))  # one row a day
    return X.rounded(S.block_indices(spark, days.count(), 20, 10, 9).join(series, "pos"))


@B.query("b11_combination_grid")
def b11(spark, d):
    from tidemark.operators.asof import combinations

    t = B.trials(spark, d)
    top = t.groupBy("trial").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "trial").limit(10)
    pairs = combinations(top.select(F.col("trial").alias("id"), F.lit("all").alias("g")), 2, "g", 2).select("members", F.explode("members").alias("trial"))
    split = F.when(F.col("month") < "1999-01-01", "train").otherwise("validation").alias("split")
    s = F.broadcast(pairs).join(t, "trial").groupBy("members", "month", split).agg(F.avg("r").alias("r"))  # 45 pairs
    return X.rounded(s.groupBy("members", "split").agg(F.count("*").alias("n"), X.ratio(F.avg("r"), F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2)))).alias("sortino")))


@B.query("b13_validation_bundle", f"with {B.TRIALS} select metric, round(value, 8) as value from (unpivot (select count(distinct trial)::double as trials, count(distinct month)::double as periods, avg(r) as mean, stddev_samp(r) as sd, avg((r > 0)::int::double) as hit_rate from tr) on trials, periods, mean, sd, hit_rate into name metric value value)")
def b13(spark, d):
    x = B.trials(spark, d).agg(F.countDistinct("trial").cast("double").alias("trials"), F.countDistinct("month").cast("double").alias("periods"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"))
    return X.rounded(x.unpivot([], ["trials", "periods", "mean", "sd", "hit_rate"], "metric", "value"), 8)


@B.query("a30_exposure_multiplier", "with r as (select event_type, count(*) filter (where user_id % 3 = 2) as high from events group by 1) select event_type, high, round(1 - least(0.5::double, 0.0001::double * high), 6) as multiplier from r")
def a30b(spark, d):
    r = B.table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 3 == 2).alias("high"))
    return X.rounded(r.withColumn("multiplier", 1 - F.least(F.lit(0.5), 0.0001 * F.col("high"))))
