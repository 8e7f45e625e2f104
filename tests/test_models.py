"""Operators that SQL cannot express against plain versions in numpy and Python."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, linalg, spectra, text
from tidemark.plans import base, registry


def test_group_distance_equals_numpy(spark):
    draw = np.random.default_rng(3)
    rows = [(g, f"{g}{i}", *map(float, draw.normal(size=3))) for g, n in (("a", 40), ("b", 9), ("few", 2)) for i in range(n)]
    rows.append(("a", "hole", None, 1.0, 2.0))
    df = spark.createDataFrame(rows, "g string, k string, x double, y double, z double")
    got = {r["k"]: r["distance"] for r in linalg.group_distance(df, "g", "k", ["x", "y", "z"]).collect()}
    want = {}
    for g in ("a", "b"):
        own = [r for r in rows if r[0] == g and r[2] is not None]
        m = np.array([r[2:] for r in own])
        inverse = np.linalg.inv(0.9 * np.cov(m, rowvar=False) + 0.1 * np.eye(3))
        for r, d in zip(own, m - m.mean(axis=0)):
            want[r[1]] = math.sqrt(d @ inverse @ d)
    assert got == pytest.approx(want)


@pytest.mark.parametrize("n, t", [(40, 60), (2000, 50), (30, 120), (1, 20)])
def test_spectrum_equals_numpy(spark, n, t):
    draw = np.random.default_rng(5)
    m = draw.normal(size=(t, n))
    m[:, : n // 3] += 3 * m[:, :1]
    m[3, n // 2] = np.nan
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(t)]
    ids, dates = np.meshgrid(np.arange(n), np.arange(t))
    pdf = pd.DataFrame({"entity": ids.ravel(), "date": [days[i] for i in dates.ravel()], "r": m.ravel()})
    xs, seen = spectra.centred_window(spark.createDataFrame(pdf), window=t)
    got = spectra.spectrum(spectra.modes(xs, seen))
    x = np.nan_to_num(m)
    x = x - x.mean(axis=0)
    cov = np.atleast_2d(np.cov(x, rowvar=False))
    values, vectors = np.linalg.eigh(cov)
    values = np.clip(values, 1e-12, None)
    edge = np.median(np.where(values < 1e-10, 1e-12, values)) * (1 + math.sqrt(n / t)) ** 2
    rows = sorted(got.collect(), key=lambda r: r.k)
    assert [r.eigenvalue for r in rows] == pytest.approx(list(values[::-1][: min(n, t)]), rel=1e-6, abs=1e-9)
    share = values / values.sum()
    assert rows[0].effective_rank == pytest.approx(math.exp(-(share * np.log(share)).sum()), rel=1e-6) and rows[0].edge == pytest.approx(edge, rel=1e-6, abs=1e-9)
    assert rows[0].signal_modes == (values > edge).sum() and rows[0].noise_fraction == pytest.approx((values <= edge).mean())
    noisy = values <= edge
    kept = np.where(noisy, values[noisy].mean() if noisy.any() else 0.0, values)
    want = np.diag(vectors @ np.diag(kept) @ vectors.T)
    told = {r.entity: r for r in spectra.cleaned_variances(xs, seen, got).collect()}
    assert [told[k].cleaned for k in range(n)] == pytest.approx(list(want), rel=1e-6) and [told[k].variance for k in range(n)] == pytest.approx(list(np.diag(cov)), rel=1e-9)


def test_uncertainty_state_equals_plain(spark, sf):
    got = registry.QUERIES["a64_uncertainty_state"](spark, sf).first()
    r = [x.r for x in base.dense(spark, sf).select("r").collect()]
    assert got.mean == pytest.approx(np.mean(r), abs=1e-6) and got.vol == pytest.approx(np.std(r, ddof=1), abs=1e-6) and got.information == pytest.approx(len(r) / np.var(r, ddof=1), rel=1e-6)
    rows = base.prices(spark, sf).select("entity", "date", "r").toPandas().pivot(index="date", columns="entity", values="r").sort_index().tail(252).dropna(axis=1, how="all").fillna(0.0).to_numpy()
    values = np.clip(np.linalg.eigvalsh(np.cov(rows, rowvar=False)), 1e-12, None)
    share = values / values.sum()
    assert got.effective_rank == pytest.approx(math.exp(-(share * np.log(share)).sum()), rel=1e-5)
    assert got.filter_confidence == pytest.approx(1 - got.filter_gain) and 0 < got.noise_fraction <= 1


def test_components_of_risk_add_up(spark, sf):
    asset, factor = (registry.QUERIES[q](spark, sf).collect() for q in ("a36_asset_risk", "a36_factor_risk"))
    total = next(r.variance_e6 for r in factor if r.name == "variance")
    assert sum(r.share for r in asset) == pytest.approx(1.0, abs=1e-5) and sum(r.component for r in asset) ** 2 * 1e6 == pytest.approx(total, rel=1e-4)
    assert sum(r.variance_e6 for r in factor if r.block != "total") == pytest.approx(total, rel=1e-6) and sum(r.factor_share for r in factor if r.block == "factor") == pytest.approx(1.0, abs=1e-5)


def test_common_factor_equals_numpy(spark, sf):
    got = {r["date"]: r["factor"] for r in registry.QUERIES["w33_common_factor"](spark, sf).collect()}
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    days = {}
    for r in base.dense(spark, sf).select("entity", "date", "r").collect():
        days.setdefault(r["date"], {})[r["entity"]] = r["r"]
    full = sorted(d for d, v in days.items() if len(v) == len(names))
    m = np.array([[days[d][n] for n in names] for d in full])
    z = (m - m.mean(axis=0)) / m.std(axis=0, ddof=1)
    factor = z @ np.linalg.eigh(np.cov(z, rowvar=False))[1][:, -1]
    factor *= 1 if np.corrcoef(factor, m[:, 3])[0, 1] >= 0 else -1
    assert sorted(got) == full
    assert [got[d] for d in full] == pytest.approx(list(factor), abs=2e-6)


def test_chunks_equal_a_loop(spark, sf):
    docs = base.table(spark, sf, "documents").select("doc_id", "text").collect()
    docs = [tuple(d) for d in docs] + [(-1, None), (-2, ""), (-3, "\n \n"), (-4, "x" * 3000 + "\na\n" + "y" * 1199), (-5, "a\n" + "b" * 1198 + "\nc")]
    want = []
    for key, whole in docs:
        packed = []
        for p in [p for p in (whole or "").split("\n") if p.strip(" ") != ""]:
            if packed and len(packed[-1]) + 1 + len(p) <= 1200:
                packed[-1] += "\n" + p
            else:
                packed.append(p)
        want += [(key, i, hashlib.sha256(c.encode()).hexdigest()) for i, c in enumerate(packed)]
    got = text.chunks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id").collect()
    assert sorted((r["doc_id"], r["chunk"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in got) == sorted(want)


def test_latest_known_at_equals_a_loop(spark):
    draw = random.Random(11)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    facts = [(draw.choice(["hot", "hot", "a", "b", None]), day(draw.randrange(60)), day(draw.randrange(50)), i) for i in range(300)] + [("late", day(99), day(0), 999)]
    dates = [day(n) for n in (0, 10, 10, 30, 59, 70)]
    got = asof.latest_known_at(spark.createDataFrame(facts, "k string, available date, period date, id long"), spark.createDataFrame([(d,) for d in dates], "as_of date"), by=["k"], available="available", order=["period", "available", "id"])
    want = {}
    for d in set(dates):
        for k in {f[0] for f in facts}:
            known = [f for f in facts if f[0] == k and f[1] <= d]
            if known:
                want[k, d] = max(known, key=lambda f: (f[2], f[1], f[3]))[3]
    assert {(r["k"], r["as_of"]): r["id"] for r in got.collect()} == want


def test_countries_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "Chad and NIGERIA", None), (2, "nothing", "from Niger"), (3, None, None), (4, "Nigeriana", "Chad, chad")], "id long, title string, query string")
    aliases = spark.createDataFrame([("chad", "TD"), ("niger", "NE"), ("nigeria", "NG"), ("n'djamena", "TD")], "alias string, country string")
    got = {r["id"]: (r["tier"], r["countries"]) for r in text.countries(docs, aliases, "id", ["title", "query"]).collect()}
    assert got == {1: ("title", ["NG", "TD"]), 2: ("query", ["NE"]), 3: (None, None), 4: ("query", ["TD"])}


def test_latent_regimes_against_a_plain_loop(spark):
    draw = np.random.default_rng(4)
    calm = np.repeat(draw.random(10) < 0.5, 12)[:115]
    x = np.where(calm, 1.0, -1.0)[:, None] * [1.0, -1.0, -1.0] + 0.1 * draw.normal(size=(115, 3))
    xs = ["bullish", "volatility", "credit_spread"]
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(115)]
    df = spark.createDataFrame([(t, *map(float, v)) for t, v in zip(days, x)], "date date, bullish double, volatility double, credit_spread double")
    run = lambda part: {r["date"]: r for r in linalg.latent_regimes(part, xs, "date", k=2, min_train=30, refit=7).collect()}
    got = run(df)
    fits = sorted({*range(30, 115, 7), 114})
    assert len(got) == 115 and all(got[t]["state"] is None for t in days[:30])
    for i in range(30, 115):
        at = max(f for f in fits if f <= i)
        own = got[days[i]]
        assert own["refit_at"] == days[at] and math.isclose(sum(own["posterior"]), 1)
        # the states are far apart, and the first column's mean orders them
        assert (own["state"], own["label"]) == ((1, "risk_on") if calm[at] else (0, own["label"])) and own["label"] != "mixed_transition"
        z = x[max(0, at - 89) : at + 1]
        z = np.clip((z - z.mean(axis=0)) / z.std(axis=0), -5, 5)
        weights, means, covs = linalg.gaussian_mixture(z, 2)
        dens = [w * math.exp(-0.5 * (z[-1] - m) @ np.linalg.inv(c) @ (z[-1] - m)) / math.sqrt(np.linalg.det(c)) for w, m, c in sorted(zip(weights, means, covs), key=lambda f: f[1][0])]
        assert np.allclose(own["posterior"], np.array(dens) / sum(dens), atol=1e-9)
    # nothing known later matters, but for the fit at the last row
    early = run(df.where(F.col("date") <= days[79]))
    assert all(early[t] == got[t] for t in days[:79])
    assert all(r["state"] is None for r in run(df.limit(20)).values()) and run(df.limit(0)) == {}


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_sliced_asof_join_equals_the_whole_one(spark, direction):
    draw = random.Random(6)
    day = lambda: None if draw.random() < 0.05 else dt.date(2020, 1, 1) + dt.timedelta(days=draw.randrange(500))
    left = spark.createDataFrame([(i, draw.choice(["a", "b", "none", None]), day()) for i in range(300)], "i int, k string, t date")
    right = spark.createDataFrame([(draw.choice(["a", "a", "b", None]), day(), j) for j in range(25)], "k string, t date, v int")
    for by in (["k"], []):
        sides = (left, right) if by else (left.drop("k"), right.drop("k"))
        for tolerance in (None, 20):
            run = lambda s: sorted(asof.asof_join(*sides, by=by, left_ts="t", right_ts="t", direction=direction, tolerance=tolerance, slices=s).collect(), key=lambda r: r["i"])  # noqa: B023, E731, used at once
            whole = run(None)
            assert len(whole) == 300 and any(r["r_v"] is not None for r in whole) and run("month") == whole
