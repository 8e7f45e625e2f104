"""Projection (P) and scoring queries over statements, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import panel as P
from tidemark.operators import scoring as S
from tidemark.operators import styles as Y
from tidemark.plans import base as B

_RATIO_SQL = {
    "ev": "cap + debt - cash", "fcf": "cfo - capex", "roic": "ebit * (1 - greatest(least(coalesce(tax / nullif(pretax, 0), 0.21), 0.45), 0.0)) / nullif(debt + equity - cash, 0)", "ev_ebitda": "(cap + debt - cash) / nullif(ebit + depreciation, 0)", "fcf_yield": "(cfo - capex) / nullif(cap, 0)",
    "net_debt_ebitda": "(debt - cash) / nullif(ebit + depreciation, 0)", "turnover": "revenue / nullif(assets, 0)", "altman_z": "1.2 * working_capital / nullif(assets, 0) + 1.4 * retained / nullif(assets, 0) + 3.3 * ebit / nullif(assets, 0) + 0.6 * cap / nullif(liabilities, 0) + revenue / nullif(assets, 0)",
    "coverage": "ebit / nullif(abs(interest), 0)", "retention": "greatest(least(retained / nullif(net_income, 0), 2.0), -2.0)", "price_book": "cap / nullif(equity, 0)", "price_earnings": "cap / nullif(net_income, 0)", "eps": "net_income / nullif(shares, 0)", "solvency": "assets / nullif(liabilities, 0)", "roe": "net_income / nullif(equity, 0)",
    "current_ratio": "current_assets / nullif(current_liabilities, 0)", "gross_margin": "gross_profit / nullif(revenue, 0)", "net_margin": "net_income / nullif(revenue, 0)",
}
_RT = f"pr as (select *, 20.0::double + filing % 80 as price, (20.0::double + filing % 80) * shares as cap from fl), rr as (select *, {', '.join(f'{v} as {k}' for k, v in _RATIO_SQL.items())} from pr)"
_KNOWN = " + ".join(f"({k} is not null)::int" for k in _RATIO_SQL)


def _priced(spark, d):
    return B.filings(spark, d).withColumn("price", 20.0 + F.col("filing") % 80)


@B.query("p05_fundamental_ratios", f"with {B.FILINGS}, {_RT} select filing, entity, {', '.join(f'round({k} + 1.3e-7, 4) as {k}' for k in _RATIO_SQL)}, {_KNOWN} as known_ratios from rr")
def p05(spark, d):
    x = S.fundamental_ratios(_priced(spark, d))
    return X.rounded(x.select("filing", "entity", *[(F.col(r) + 1.3e-7).alias(r) for r in S.RATIOS], "known_ratios"), 4)


_W = "over (partition by entity order by period_end, available, filing)"
_TESTS = ["net_income > 0", "cfo > 0", f"net_income / assets > lag(net_income / assets) {_W}", "cfo > net_income", f"debt / assets < lag(debt / assets) {_W}", f"current_assets / current_liabilities > lag(current_assets / current_liabilities) {_W}", f"shares <= lag(shares) {_W}", f"gross_profit / revenue > lag(gross_profit / revenue) {_W}", f"revenue / assets > lag(revenue / assets) {_W}"]
_QT = f"qt as (select *, {' + '.join(f'(({t}) is not null)::int' for t in _TESTS)} as evaluable, {' + '.join(f'coalesce(({t})::int, 0)' for t in _TESTS)} as passed from fl)"


@B.query("p07_quality_tests", f"with {B.FILINGS}, {_QT} select filing, entity, evaluable, case when evaluable >= 7 then passed end as quality from qt")
def p07(spark, d):
    return S.quality_tests(B.filings(spark, d)).select("filing", "entity", "evaluable", "quality")


@B.query("p08_growth", f"""with {B.FILINGS} select filing, entity, round((revenue - lag(revenue) {_W}) / nullif(abs(lag(revenue) {_W}), 0), 6) as revenue_growth, round((ebit - lag(ebit) {_W}) / nullif(abs(lag(ebit) {_W}), 0), 6) as ebit_growth, round(net_income / revenue - lag(net_income / revenue) {_W}, 6) as net_margin_change from fl""")
def p08(spark, d):
    return X.rounded(S.growth(B.filings(spark, d), ["revenue", "ebit"]).select("filing", "entity", "revenue_growth", "ebit_growth", "net_margin_change"))


@B.query("p09_period_class", f"with {B.FILINGS} select filing, case when available - period_end between 70 and 115 then 'quarter' when available - period_end between 330 and 390 then 'year' else 'other' end as quarter_class, case when date_diff('day', date '1997-01-01', available) between 70 and 115 then 'quarter' when date_diff('day', date '1997-01-01', available) between 330 and 390 then 'year' else 'other' end as since_1997 from fl")
def p09(spark, d):
    return B.filings(spark, d).select("filing", S.period_class("period_end", "available").alias("quarter_class"), S.period_class(F.lit("1997-01-01").cast("date"), F.col("available")).alias("since_1997"))


@B.query("p10_pit_confidence", f"""with {B.FILINGS}, {_RT}, c as (select filing, (date '2001-08-02' - available) as age, ({_KNOWN}) / 18.0 as coverage, (filing % 2 = 0)::int as accepted from rr), k as (select *, greatest(least(0.20::double + 0.35::double + 0.20::double * accepted + 0.20::double * coverage - 0.20::double * greatest(least(age / 540.0, 1.0), 0.0), 0.95), 0.05) as confidence from c)
select filing, round(confidence, 6) as confidence, case when confidence >= 0.75 then 'high' when confidence >= 0.5 then 'medium' when confidence >= 0.25 then 'low' else 'weak' end as class, round(0.9 * exp(-greatest(age, 0) / 540.0) * coverage, 6) as decayed from k""")
def p10(spark, d):
    x = S.fundamental_ratios(_priced(spark, d)).select("filing", F.date_diff(F.lit("2001-08-02"), "available").alias("age"), (F.col("known_ratios") / 18.0).alias("coverage"))
    c = S.pit_confidence(F.lit(True), F.col("filing") % 2 == 0, F.col("coverage"), F.col("age"))
    x = x.withColumn("confidence", c)
    return X.rounded(x.select("filing", "confidence", S.confidence_class(F.col("confidence")).alias("class"), S.decayed_confidence(F.lit(0.9), F.col("age"), F.col("coverage")).alias("decayed")))


_HOLES = "case when filing % 7 <> 0 then equity end as equity, case when filing % 11 <> 0 then interest else 0 end as interest"


@B.query("p10_missing_reasons", f"""with {B.FILINGS}, h as (select filing, net_income, ebit, {_HOLES} from fl), r as (select filing, 'roe' as ratio, concat_ws(';', case when net_income is null then 'missing net_income' when net_income = 0 then 'zero net_income' end, case when equity is null then 'missing equity' when equity = 0 then 'zero equity' end) as reason from h
union all select filing, 'coverage', concat_ws(';', case when ebit is null then 'missing ebit' when ebit = 0 then 'zero ebit' end, case when interest is null then 'missing interest' when interest = 0 then 'zero interest' end) from h) select * from r where reason <> ''""")
def p10b(spark, d):
    h = B.filings(spark, d).select("filing", "net_income", "ebit", F.when(F.col("filing") % 7 != 0, F.col("equity")).alias("equity"), F.when(F.col("filing") % 11 != 0, F.col("interest")).otherwise(F.lit(0.0)).alias("interest"))
    return S.missing_reasons(h, {"roe": ["net_income", "equity"], "coverage": ["ebit", "interest"]}, "filing")


_LAST = "ls as (select *, row_number() over (partition by entity order by period_end desc, available desc, filing desc) as k from rr)"


@B.query("p26_fundamental_gate", f"""with {B.FILINGS}, {_QT}, {_RT}, a as (select rr.filing, rr.entity, {_KNOWN.replace('(', '(rr.', 1) if False else _KNOWN} as known, net_debt_ebitda, coverage, altman_z, current_ratio from rr),
q as (select filing, case when evaluable >= 7 then passed end as quality from qt), l as (select *, row_number() over (partition by entity order by period_end desc, available desc, filing desc) as k from fl), j as (select a.*, q.quality from a join q using (filing) join l using (filing) where l.k = 1),
g as (select *, case when count(quality) over () >= 10 then quantile_cont(quality, 0.3) over () end as low from j), r as (select filing, concat_ws(';', case when known < 6 then 'few_ratios' end, case when quality < low then 'low_quality' end, case when net_debt_ebitda > 4 then 'leverage' end, case when coverage < 1.5 then 'coverage' end, case when altman_z < 1.1 then 'distress' end, case when current_ratio < 0.8 then 'liquidity' end) as reasons from g)
select filing, reasons, reasons = '' as accepted from r""")
def p26(spark, d):
    from pyspark.sql import Window as W

    x = S.quality_tests(S.fundamental_ratios(_priced(spark, d)))
    w = W.partitionBy("entity").orderBy(F.desc("period_end"), F.desc("available"), F.desc("filing"))
    return S.fundamental_gate(x.withColumn("k", F.row_number().over(w)).where("k = 1")).select("filing", "reasons", "accepted")


@B.query("w14_composite_score", f"""with {B.FILINGS}, {_RT}, {B.CUSTOMERS}, {_LAST}, c as (select ls.entity, sector, fcf_yield, price_book, roic, net_margin, turnover from ls join cu using (entity) where k = 1),
z as (select entity, """ + ", ".join(f"greatest(least(({c} - median({c}) over s) / nullif(case when abs(quantile_cont({c}, 0.75) over s - quantile_cont({c}, 0.25) over s) > 1e-12 then quantile_cont({c}, 0.75) over s - quantile_cont({c}, 0.25) over s end, 0), 8.0), -8.0) as z_{c}" for c in ("fcf_yield", "price_book", "roic", "net_margin", "turnover")) + """ from c window s as (partition by sector))
select entity, round((z_fcf_yield - z_price_book) / 2, 6) as value_style, round((z_roic + z_net_margin + z_turnover) / 3, 6) as quality_style, round(0.4 * (z_fcf_yield - z_price_book) / 2 + 0.6 * (z_roic + z_net_margin + z_turnover) / 3, 6) as composite from z""")
def w14(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("entity").orderBy(F.desc("period_end"), F.desc("available"), F.desc("filing"))
    x = S.fundamental_ratios(_priced(spark, d)).withColumn("k", F.row_number().over(w)).where("k = 1").join(B.customers(spark, d).select("entity", "sector"), "entity")
    x = P.group_robust_z(x.select("entity", "sector", "fcf_yield", "price_book", "roic", "net_margin", "turnover"), ["fcf_yield", "price_book", "roic", "net_margin", "turnover"], "sector")
    x = S.composite(x, {"value": [("z_fcf_yield", 1.0), ("z_price_book", -1.0)], "quality": [("z_roic", 1.0), ("z_net_margin", 1.0), ("z_turnover", 1.0)]}, {"value": 0.4, "quality": 0.6})
    return X.rounded(x.select("entity", "value_style", "quality_style", "composite"))


_AS_OF = "1998-06-30"


def _style_mean(parts: dict[str, float], z: str = "z_") -> str:
    said = ", ".join(f"{z}{c} * {w!r}::double" for c, w in parts.items())
    return f"list_avg(list_filter([{said}], lambda x: x is not null))"


_MZ = lambda v: f"case when count({v}) over () >= 3 and {v} is not null and d_{v} * 1.4826::double > 1e-12 then greatest(least(({v} - m_{v}) / (d_{v} * 1.4826::double), 3.0), -3.0) end as z_{v}"
_WEIGHED = lambda w: " + ".join(f"{c!r}::double * coalesce({g}, 0)" for g, c in w.items())
_STYLE = f"""px1 as (select * from px where date <= date '{_AS_OF}'), pk as (select *, row_number() over (partition by entity order by date desc) as k from px1), pp as (select *, max(case when k <= 126 then close end) over (partition by entity order by date) as peak from pk where k <= 252),
pf as (select entity, {", ".join(f"max(close) filter (where k = 1) / nullif(max(close) filter (where k = {k + 1}), 0) - 1 as mom_{k}" for k in (21, 63, 126))}, case when count(*) >= 50 then avg(close) filter (where k <= 50) end / nullif(case when count(*) >= 200 then avg(close) filter (where k <= 200) end, 0) - 1 as trend_50_200,
  min(case when k <= 126 then close / peak - 1 end) as drawdown_126, stddev_samp(r) filter (where k <= 63) as vol_63, avg(close * volume) filter (where k <= 63) as dollar_volume_63, avg(case when close * volume > 0 then abs(r) / (close * volume) end) filter (where k <= 63) * 1e6 as illiquidity_63 from pp group by 1),
sg as (select *, row_number() over (partition by entity order by period_end desc, available desc, filing desc) as k, {", ".join(f"({c} - lag({c}) over o) / nullif(abs(lag({c}) over o), 0) as {c}_growth" for c in ("revenue", "net_income"))}, gross_profit / nullif(revenue, 0) - lag(gross_profit / nullif(revenue, 0)) over o as gross_margin_change,
  net_income / nullif(cap, 0) as earnings_yield, ln(greatest(cap, 1)) as log_cap from rr where available <= date '{_AS_OF}' window o as (partition by entity order by period_end, available, filing)),
cs as (select sg.entity, {", ".join(Y.FEATURES)} from (select * from sg where k = 1) sg left join pf using (entity)),
cm as (select {", ".join(f"median({v}) as m_{v}" for v in Y.FEATURES)} from cs), cd as (select {", ".join(f"median(abs({v} - m_{v})) as d_{v}" for v in Y.FEATURES)} from cs, cm), cz as (select entity, {", ".join(map(_MZ, Y.FEATURES))} from cs, cm, cd),
cg as (select entity, {", ".join(f"{_style_mean(p)} as {g}" for g, p in Y.GROUPS.items())}, {", ".join(f"{_style_mean(p)} as s_{g}" for g, p in Y.STYLES.items())} from cz),
ct as (select *, {_style_mean({k: 1.0 for k in ("value", "quality", "growth", "liquidity", *[f"s_{g}" for g in Y.STYLES])}, "")} as style from cg),
rx as (select avg(rb) filter (where k <= 63) < 0 as bear from (select rb, row_number() over (order by date desc) as k from mk where date <= date '{_AS_OF}')), rh as (select avg(rate) filter (where k <= 63) > avg(rate) filter (where k > 63 and k <= 126) as hawkish from (select date, avg(rate) as rate, row_number() over (order by date desc) as k from rt where date <= date '{_AS_OF}' group by date))"""


@B.query("w14_style_scores", f"""with {B.FILINGS}, {_RT}, {B.PX}, {B.MARKET}, {B.RATES}, {_STYLE} select entity, {", ".join(f"round({g}, 6) as {g}" for g in (*Y.GROUPS, "style"))}, round(case {" ".join(f"when hawkish = {h} and bear = {b} then {_WEIGHED(w)}" for (h, b), w in Y.REGIME_WEIGHTS.items())} end, 6) as regime_score,
{", ".join(f"round({_WEIGHED(w)}, 6) as {k}" for k, w in Y.MANDATES.items())}, hawkish, bear from ct, rx, rh""")
def w14_styles(spark, d):
    """Companies with their latest statement known, and prices up to the signal date; the regime is of the market's last 63 days and of rates against the 63 days before."""
    from pyspark.sql import Window as W

    day = F.lit(_AS_OF).cast("date")
    ratios = S.fundamental_ratios(_priced(spark, d))
    cap = F.col("price") * F.col("shares")
    own = Y.latest_statements(ratios, day).withColumn("earnings_yield", X.ratio("net_income", cap)).withColumn("log_cap", F.log(F.greatest(cap, F.lit(1.0))))
    prices = B.prices(spark, d)
    cross = own.join(Y.price_features(prices.where(F.col("date") <= day)), "entity", "left")
    newest = W.orderBy(F.desc("date"))  # one row a day
    market = B.market(prices).where(F.col("date") <= day).withColumn("k", F.row_number().over(newest)).agg((F.avg(F.when(F.col("k") <= 63, F.col("rb"))) < 0).alias("bear"))
    rates = B.rates(spark, d).where(F.col("date") <= day).groupBy("date").agg(F.avg("rate").alias("rate")).withColumn("k", F.row_number().over(newest))
    hawkish = rates.agg((F.avg(F.when(F.col("k") <= 63, F.col("rate"))) > F.avg(F.when((F.col("k") > 63) & (F.col("k") <= 126), F.col("rate")))).alias("hawkish"))
    return X.rounded(Y.style_scores(cross, market.crossJoin(hawkish)))  # one row each



_CDF = "case when z >= 0 then 1 - tail else tail end"


@B.query("a45_posterior", f"""with {B.PX}, {B.SECTORS}, m as (select entity, sector, avg(r) * 1e4 as x, var_samp(r) * 1e8 / count(*) as v from px join sectors using (entity) group by 1, 2),
a as (select *, count(x) over (partition by sector) as n, avg(x) over (partition by sector) as g, avg(x) over () as al, var_samp(x) over () as tau from m), b as (select *, n / (n + 5.0) * g + (1 - n / (n + 5.0)) * al as prior_mean, tau / (tau + v) as k from a),
c as (select *, k * x + (1 - k) * prior_mean as pm, sqrt(k * v) as sd from b), e as (select *, pm / nullif(sd, 0) as z, 1 / (1 + 0.2316419::double * abs(pm / nullif(sd, 0))) as t from c), f as (select *, exp(-z * z / 2) / 2.5066282746310002::double * t * (0.319381530::double + t * (-0.356563782::double + t * (1.781477937::double + t * (-1.821255978::double + t * 1.330274429::double)))) as tail from e)
select entity, sector, round(prior_mean, 6) as prior_mean, round(pm, 6) as posterior_mean, round(sd, 6) as posterior_sd, round({_CDF}, 6) as p_positive from f""")
def a45(spark, d):
    x = B.prices(spark, d).join(B.sectors(spark, d), "entity").groupBy("entity", "sector").agg((F.avg("r") * 1e4).alias("x"), (F.var_samp("r") * 1e8 / F.count("*")).alias("v"))
    return X.rounded(S.posterior(x, "x", "v", "sector").select("entity", "sector", "prior_mean", "posterior_mean", "posterior_sd", "p_positive"))


_INV = "iv as (select entity, balance, (entity % 25)::double as horizon_years, (entity % 50) / 100.0::double as max_drawdown, (entity % 10) / 10.0::double as liquidity_need from cu), sc as (select *, 100 * (0.25::double * greatest(least(balance / 10000.0, 1.0), 0.0) + 0.30::double * greatest(least(horizon_years / 20.0, 1.0), 0.0) + 0.30::double * greatest(least(max_drawdown / 0.5, 1.0), 0.0) + 0.15::double * (1 - greatest(least(liquidity_need, 1.0), 0.0))) as score from iv), pf as (select *, case when score >= 70 then 'aggressive' when score >= 50 then 'growth' when score >= 30 then 'balanced' else 'conservative' end as profile from sc)"


@B.query("p20_suitability", f"with {B.CUSTOMERS}, {_INV} select entity, round(score, 6) as score, profile, case profile when 'aggressive' then 0.15::double when 'growth' then 0.12 when 'balanced' then 0.10 else 0.07 end as weight_cap, max_drawdown > 0.35 and horizon_years < 3 as incoherent from pf")
def p20(spark, d):
    c = B.customers(spark, d).select("entity", "balance", (F.col("entity") % 25).cast("double").alias("horizon_years"), ((F.col("entity") % 50) / 100.0).alias("max_drawdown"), ((F.col("entity") % 10) / 10.0).alias("liquidity_need"))
    return X.rounded(S.suitability(c).select("entity", "score", "profile", "weight_cap", "incoherent"))


@B.query("p21_suggested_benchmark", f"with {B.CUSTOMERS} select entity, case when segment = 'BUILDING' then 'property' when country in ('UNITED STATES', 'CANADA') then 'north_america' when sector = 'EUROPE' then 'europe' when sector = 'ASIA' then 'asia' else 'world' end as benchmark from cu")
def p21(spark, d):
    c = F.when(F.col("segment") == "BUILDING", "property").when(F.col("country").isin("UNITED STATES", "CANADA"), "north_america").when(F.col("sector") == "EUROPE", "europe").when(F.col("sector") == "ASIA", "asia").otherwise("world")
    return B.customers(spark, d).select("entity", c.alias("benchmark"))


_LEGS = """wt as (select entity, sum(volume) filter (where date < date '1996-01-01') as a, sum(volume) filter (where date >= date '2001-01-01') as b, avg(volume) as adv, arg_max(close, date) as close from px group by 1),
lg as (select entity, coalesce(a / sum(a) over (), 0) as "from", case when entity % 9 <> 0 then coalesce(b / sum(b) over (), 0) else 0 end as "to", adv, close from wt), lo as (select *, "to" - "from" as ch, abs("to" - "from") * 1e6 as notional from lg where abs("to" - "from") > 1e-8)"""


def _legs(spark, d):
    from pyspark.sql import Window as W

    p = B.prices(spark, d)
    x = p.groupBy("entity").agg(F.sum(F.when(F.col("date") < "1996-01-01", F.col("volume"))).alias("a"), F.sum(F.when(F.col("date") >= "2001-01-01", F.col("volume"))).alias("b"), F.avg("volume").alias("adv"), F.max_by("close", "date").alias("close"))
    whole = W.partitionBy()
    x = x.withColumn("a", F.col("a") / F.sum("a").over(whole)).withColumn("b", F.col("b") / F.sum("b").over(whole))
    legs = S.orders(x.where("entity % 9 <> 0").select("entity", F.col("b").alias("weight")), x.select("entity", F.col("a").alias("weight")), x, 1e6)
    return legs.join(x.select("entity", "adv"), "entity")


@B.query("p22_order_legs", f"""with {B.PX}, {_LEGS} select entity, round("from", 6) as "from", round("to", 6) as "to", case when ch > 0 then 'buy' else 'sell' end as side, round(notional, 3) as notional, round(notional / nullif(close, 0), 4) as quantity from lo""")
def p22(spark, d):
    x = _legs(spark, d)
    return x.select("entity", F.round("from", 6).alias("from"), F.round("to", 6).alias("to"), "side", F.round("notional", 3).alias("notional"), F.round("quantity", 4).alias("quantity"))


@B.query("p23_pre_trade_checks", f"""with {B.PX}, {_LEGS}, c as (select entity, "to" <= 0.012 as weight_cap, coalesce(notional / nullif(adv * 1000, 0) <= 0.1, false) as adv_participation, notional * 1e-6 * 2 <= 0.01 as cost_cap, notional / nullif(close, 0) is not null as has_price from lo)
select entity, "check", passed from (unpivot c on weight_cap, adv_participation, cost_cap, has_price into name "check" value passed)""")
def p23(spark, d):
    x = _legs(spark, d).withColumn("adv", F.col("adv") * 1000).withColumn("cost", F.col("notional") * 1e-6 * 2)
    return S.pre_trade_checks(x, weight_cap=0.012)


@B.query("p30_contract_rows", f"""with {B.CUSTOMERS} select entity, segment, round(greatest(balance, 0) / nullif(sum(greatest(balance, 0)) over (partition by segment), 0), 8) as weight, round(greatest(least(balance / 5000.0, 1.0), 0.0), 6) as confidence, case when balance > 0 then balance end as price from cu""")
def p30(spark, d):
    x = B.customers(spark, d).select("entity", "segment", F.col("balance").alias("weight"), (F.col("balance") / 5000.0).alias("confidence"), F.col("balance").alias("price"))
    x = S.contract_rows(x, "segment")
    return x.select("entity", "segment", F.round("weight", 8).alias("weight"), F.round("confidence", 6).alias("confidence"), "price")


@B.query("p25_row_hash", """select n_nationkey as id, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') as digest from nation""")
def p25(spark, d):
    return B.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), S.row_hash("n_regionkey", "n_name", "n_nationkey").alias("digest"))


@B.query("p16_softmax", f"with {B.PX}, m as (select entity, entity % 5 as g, avg(r) * 100 as x from px group by 1, 2), e as (select *, exp((x - max(x) over (partition by g)) / 0.5) as e from m) select entity, round(1 / (1 + exp(-x)), 6) as logistic, round(e / sum(e) over (partition by g), 6) as softmax from e")
def p16(spark, d):
    m = B.prices(spark, d).groupBy("entity", (F.col("entity") % 5).alias("g")).agg((F.avg("r") * 100).alias("x"))
    return X.rounded(m.select("entity", X.logistic("x").alias("logistic"), X.softmax("x", "g", temperature=0.5).alias("softmax")))


@B.query("p27_rejections", f"""with {B.FILINGS}, {_RT}, {_LAST}, m as (select entity, roic, turnover, median(roic) over () as mr, median(turnover) over () as mt, coverage from ls where k = 1)
select entity, concat_ws(';', case when roic < mr then 'roic below median' end, case when turnover < mt then 'turnover below median' end, case when coverage < 1.5 then 'thin coverage' end) as reasons from m where roic < mr or coverage < 1.5""")
def p27(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("entity").orderBy(F.desc("period_end"), F.desc("available"), F.desc("filing"))
    x = S.fundamental_ratios(_priced(spark, d)).withColumn("k", F.row_number().over(w)).where("k = 1")
    x = X.with_group(x, [], mr=F.median("roic"), mt=F.median("turnover")).where("roic < mr or coverage < 1.5")
    reasons = F.array_compact(F.array(F.when(F.col("roic") < F.col("mr"), "roic below median"), F.when(F.col("turnover") < F.col("mt"), "turnover below median"), F.when(F.col("coverage") < 1.5, "thin coverage")))
    return x.select("entity", F.array_join(reasons, ";").alias("reasons"))
