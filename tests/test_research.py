"""Research operators: recovery of what is known, causality, and plain versions in numpy."""

import contextlib
import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tidemark.operators import books, families, market_state, nested, rewards, segments, text, variance

DAY = dt.date(2015, 1, 1)


def _days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def _panel(spark, m, names=None):
    """Long rows of a days by entities matrix."""
    n, k = m.shape
    names = names or [f"e{j:02}" for j in range(k)]
    return spark.createDataFrame(pd.DataFrame({"entity": np.tile(names, n), "date": np.repeat(_days(n), k), "r": m.ravel()}))


def _bench(panel):
    return panel.groupBy("date").agg(F.avg("r").alias("rb"))


def test_variance_shift_is_found_and_short_series_have_none(spark):
    draw = np.random.default_rng(20260518)
    shift = np.r_[draw.normal(0.001, 0.004, 80), draw.normal(-0.001, 0.03, 80)]
    df = _panel(spark, shift[:, None]).union(_panel(spark, shift[:50, None], ["short"]))
    found = segments.segments(df, least=20, penalty=10.0)
    rows = {(r.entity, r.segment): r for r in found.collect()}
    assert {e for e, _ in rows} == {"e00"} and len(rows) >= 2
    vols = [r.annual_vol for r in rows.values()]
    assert max(vols) > 3 * min(vols) and sum(r.n for r in rows.values()) == 160
    events = segments.change_events(found).collect()
    assert "Variance up" in {e.kind for e in events} and abs((min(e.changed for e in events if e.kind == "Variance up") - DAY).days - 80) <= 3


def test_segments_equal_a_plain_splitting(spark):
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(0, s, n) for s, n in ((0.01, 90), (0.05, 70), (0.005, 120), (0.02, 60))])
    bounds, _ = segments.segment_bounds(_panel(spark, x[:, None]))

    def cost(a, b):
        return (b - a) * (np.log(max(x[a:b].var(), 1e-12)) + 1)

    def split(a, b):
        cuts = [(cost(a, b) - cost(a, i) - cost(i, b), -i) for i in range(a + 21, b - 20)]
        gain, i = max(cuts, default=(0, 0))
        return split(a, -i) + split(-i, b) if gain > 3 * np.log(len(x)) else [(a, b)]

    assert sorted((r.a, r.b) for r in bounds.collect()) == split(0, len(x))


def test_variance_architectures(spark):
    draw = np.random.default_rng(20260519)
    n, h, calm = 700, [1e-4], draw.standard_normal(700)
    for t in range(1, n):
        h.append(1e-4 * 0.1 + 0.1 * (h[-1] * calm[t - 1] ** 2) + 0.8 * h[-1])
    m = np.column_stack([np.sqrt(h) * calm, draw.standard_t(4, n) * 0.01, draw.normal(0, 0.01, n)])
    rows = variance.architectures(_panel(spark, m)).collect()
    assert {r.model for r in rows} == {*variance.GRID, "T_GARCH11", "POWER_LAW"} and len(rows) == 24
    for e in ("e00", "e01", "e02"):
        own = [r for r in rows if r.entity == e]
        for c in ("aic", "bic", "qlike"):
            assert {r.model for r in own if r[f"best_{c}"]} == {r.model for r in own if round(r[c], 6) == min(round(x[c], 6) for x in own)}
    best = {r.entity: r.model for r in rows if r.best_aic}
    assert best["e00"] in ("GARCH11", "GARCH12", "GARCH21", "T_GARCH11") and best["e01"] == "T_GARCH11"
    garch = next(r for r in rows if r.entity == "e00" and r.model == "GARCH11")
    y = m[:, 0] - m[:, 0].mean()
    v, ll = [y.var()], 0.0
    for t in range(n):
        ll -= 0.5 * (np.log(2 * np.pi * v[-1]) + y[t] ** 2 / v[-1])
        v.append(y.var() * (1 - garch.a1 - garch.b1) + garch.a1 * y[t] ** 2 + garch.b1 * v[-1])
    assert garch.ll == pytest.approx(ll, rel=1e-9) and garch.ahead == pytest.approx(v[-1], rel=1e-9)


SCHEDULE = nested.Schedule(train=120, purge=21, validation=60, embargo=5, test=30, holdout=90)


def _candidates(m):
    return lambda spark: (lambda p: p.join(_bench(p), "date"))(_panel(spark, m))


def test_nested_windows_keep_purge_embargo_and_holdout(spark):
    draw = np.random.default_rng(2)
    m = draw.normal(0.0005, 0.01, (500, 4))
    found = nested.nested_selection(_candidates(m)(spark), SCHEDULE)
    windows = sorted(found.windows.collect(), key=lambda r: r.window)
    at = {d: i for i, d in enumerate(_days(500))}
    assert len(windows) == -(-(500 - 90 - 206) // 30)
    for k, w in enumerate(windows):
        test = 206 + 30 * k
        assert [at[w[c]] for c in ("train_start", "train_end", "validation_start", "validation_end", "test_start", "test_end")] == [test - 206, test - 87, test - 65, test - 6, test, min(test + 29, 409)]
    assert max(w.test_end for w in windows) < min(r.date for r in found.holdout.collect())
    path = found.path.groupBy("date").count()
    assert path.count() == 500 - 90 - 206 and path.where("count > 1").isEmpty()
    stability = found.stability.collect()
    assert sum(r.picked for r in stability) == len(windows) and sum(r.frozen for r in stability) == 1
    # what happens in the holdout changes nothing before it
    wild = m.copy()
    wild[410:] *= draw.normal(0, 8, (90, 4))
    again = nested.nested_selection(_candidates(wild)(spark), SCHEDULE)
    assert sorted(again.windows.select("window", "entity").collect()) == sorted(found.windows.select("window", "entity").collect())
    assert again.stability.where("frozen").first().entity == found.stability.where("frozen").first().entity


def test_too_few_days_make_no_windows(spark):
    found = nested.nested_selection(_candidates(np.full((200, 2), 0.001))(spark), SCHEDULE)
    assert found.windows.isEmpty() and found.path.isEmpty() and found.holdout.isEmpty()


def test_crowding_equals_all_pairs(spark):
    draw = np.random.default_rng(7)
    m = draw.normal(size=(126, 40)) * draw.uniform(0.5, 2, 40) + draw.normal(size=(126, 1))
    m[:, 3] = 0.0
    rows = _panel(spark, m).withColumn("signal", F.lit(DAY))
    got = market_state.crowding(rows, "entity", "date", "r").first()
    moving = np.delete(m, 3, axis=1)
    c = np.corrcoef(moving, rowvar=False)
    assert got.crowding == pytest.approx(c[~np.eye(39, dtype=bool)].mean(), rel=1e-9)
    assert got.dispersion == pytest.approx(np.median(m.std(axis=1, ddof=1)) * np.sqrt(252), rel=1e-9)


def test_market_states_are_causal(spark):
    draw = np.random.default_rng(8)
    m = draw.normal(0, 0.01, (220, 6))
    signals = spark.createDataFrame([(_days(220)[i],) for i in (100, 150, 180)], "signal date")
    first = sorted(market_state.market_states(_panel(spark, m), _bench(_panel(spark, m)), signals).collect())
    m[185:] = 0.3
    assert len(first) == 2 and first == sorted(market_state.market_states(_panel(spark, m), _bench(_panel(spark, m)), signals).collect())


def test_contextual_scores_equal_numpy(spark):
    draw = np.random.default_rng(3)
    rows = [(f"a{k % 5}", float(x), float(y), float(z), float(r)) for k, (x, y, z, r) in enumerate(draw.normal(size=(60, 4)))] + [("few", 1.0, 0.0, 0.0, 2.0)]
    log = spark.createDataFrame(rows, "action string, x double, y double, z double, reward double")
    at = spark.createDataFrame([(0.5, -1.0, 2.0)], "x double, y double, z double")
    got = {r.action: r for r in rewards.contextual_scores(log, at, ["action"], ["x", "y", "z"]).collect()}
    for a in {r[0] for r in rows} - {"few"}:
        m = np.array([r[1:4] for r in rows if r[0] == a])
        y = np.array([r[4] for r in rows if r[0] == a])
        inverse = np.linalg.inv(np.eye(3) + m.T @ m)
        v = np.array([0.5, -1.0, 2.0])
        assert got[a].prediction == pytest.approx(v @ inverse @ m.T @ y) and got[a].bonus == pytest.approx(0.35 * np.sqrt(v @ inverse @ v))
    assert got["few"].prediction is None and got["few"].score == pytest.approx(2.0 + 0.35 / np.sqrt(2))
    assert sum(r.recommended for r in got.values()) == 1


def test_books_weigh_all_and_floor_what_the_gates_shut(spark):
    draw = np.random.default_rng(12)
    names = [*books.FEATURES, "crowding"]
    pdf = pd.DataFrame(draw.normal(1.0, 0.4, (60, len(names))), columns=names)
    pdf.insert(0, "entity", [f"e{k:02}" for k in range(60)])
    scores = books.book_scores(spark.createDataFrame(pdf))
    weights = books.book_weights(scores, 0.1).collect()
    assert {r.book for r in weights} == set(books.BOOKS) and len(books.BOOKS) == 18
    for book in books.BOOKS:
        own = [r.weight for r in weights if r.book == book]
        assert sum(own) == pytest.approx(1.0) and max(own) <= 0.1 + 1e-9 and len(own) == 60
    rows = scores.withColumn("open", F.expr(books.GATES["real"])).collect()
    least = min(r.growth_upside_convex for r in rows)
    assert all(r.growth_real_upside_convex == pytest.approx(least - books.FLOOR) for r in rows if not r.open) and any(r.open for r in rows)
    z = {c: (pdf[c] - pdf[c].median()) / (1.4826 * (pdf[c] - pdf[c].median()).abs().median()) for c in ("downside", "cvar", "drawdown", "total")}
    want = sum(w * z[c].clip(-3, 3) for c, w in books.BOOKS["capital"][3].items())
    assert [r.capital for r in sorted(rows, key=lambda r: r.entity)] == pytest.approx(list(want))


def test_mean_correlation_equals_all_pairs(spark):
    draw = np.random.default_rng(13)
    m = draw.normal(size=(90, 12)) + draw.normal(size=(90, 1))
    p = _panel(spark, m)
    got = {r.entity: r.crowding for r in books.mean_correlation(p, _bench(p), window=90).collect()}
    c = np.corrcoef(m, rowvar=False)
    assert [got[f"e{k:02}"] for k in range(12)] == pytest.approx([(c[k].sum() - 1) / 11 for k in range(12)])


def test_families_do_not_see_later_rows(spark):
    draw = np.random.default_rng(14)
    m = draw.normal(0.0004, 0.01, (330, 5))

    def scores(x):
        p = _panel(spark, x)
        p = p.join(spark.createDataFrame(pd.DataFrame({"entity": np.tile([f"e{j:02}" for j in range(5)], 330), "date": np.repeat(_days(330), 5), "close": (100 * np.cumprod(1 + x, axis=0)).ravel()})), ["entity", "date"])
        signals = spark.createDataFrame([(_days(330)[i],) for i in (200, 260, 300)], "signal date")
        return sorted(families.family_scores(p, _bench(p), signals).collect())

    first = scores(m)
    assert len(first) == 10 and set(families.LOOKBACKS) < set(first[0].asDict())
    late = m.copy()
    late[301:] = 0.05
    assert [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in scores(late)] == [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in first]
    x, b = m[175:301], m[175:301].mean(axis=1)
    beta = [np.cov(x[:, k], b)[0, 1] / b.var(ddof=1) for k in range(5)]
    got = {r.entity: r.residual_momentum for r in first if r.signal == _days(330)[300]}
    assert [got[f"e{k:02}"] for k in range(5)] == pytest.approx([x[:, k].sum() - beta[k] * b.sum() for k in range(5)])


def test_event_countries(spark):
    aliases = spark.createDataFrame([("China", "China"), ("Beijing", "China"), ("South Korea", "South Korea"), ("Korea", "Korea"), ("U.S.", "United States"), ("Brazil", "Brazil")], "alias string, country string")
    rows = [
        (1, "Trade between BEIJING and Brazil", "Korea", "France"), (2, "South Korea votes", None, None), (3, "nothing", "the U.S. and Chinatown, China", "x"), (4, "", "", "brazil"),
        (5, None, None, "Atlantis"), (6, "Brazilian coffee", "unknown", "Global"), (7, "UXSX", "", None), (8, "Korea China Brazil U.S. South Korea Beijing", "", ""),
    ]
    got = {r.id: (r.countries, r.method, round(r.confidence, 6)) for r in text.event_countries(spark.createDataFrame(rows, "id int, title string, query string, source string"), aliases, "id").collect()}
    assert got == {
        1: (["Brazil", "China"], "title_text", 0.91), 2: (["South Korea"], "title_text", 0.83), 3: (["China", "United States"], "query_text", 0.69), 4: (["Brazil"], "source", 0.35),
        5: (["Atlantis"], "source", 0.35), 6: ([], "unresolved", 0.0), 7: ([], "unresolved", 0.0), 8: (["Brazil", "China", "Korea", "South Korea", "United States"], "title_text", 0.95),
    }


def _retrieved(passages, questions, k):
    """``retrieve`` by its definition, one pair after another."""
    terms = lambda t: (w := (t or "").split()) + [" ".join(x) for x in zip(w, w[1:])]
    own, asked = {}, {}
    for rows, out in ((passages, own), (questions, asked)):
        for key, t in rows:
            out.setdefault(key, Counter()).update(terms(t))
    df = Counter(t for x in own.values() for t in x)
    idf = {t: math.log((1 + len(passages)) / (1 + n)) + 1 for t, n in df.items()}
    found = []
    for q, a in asked.items():
        scored = []
        for i, x in own.items():
            if i is not None and (both := a.keys() & x.keys()):
                dot, norm = sum(a[t] * x[t] * idf[t] ** 2 for t in both), math.sqrt(sum((n * idf[t]) ** 2 for t, n in x.items()))
                scored.append((-round(dot / norm, 9), i))
        found += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return found


def test_retrieval_by_blocks_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(text, "QUESTIONS", 20)
    monkeypatch.setattr(text, "PASSAGES", 50)
    monkeypatch.setattr(text, "CELLS", 300)
    monkeypatch.setattr(text, "SPAN", 3)
    pick = random.Random(9)
    words = ["the", "the", "of", *(f"w{k}" for k in range(40))]
    said = lambda n: " ".join(pick.choice(words) for _ in range(n))
    same = said(9)
    # copies, a key of two rows, rows without a key or a text, a question that meets nothing
    passages = [(k, same if k % 4 == 0 else said(pick.randint(1, 12))) for k in range(120)] + [(7, said(5)), (None, "the of"), (200, None), (201, "")]
    questions = [(k, said(pick.randint(1, 8))) for k in range(50)] + [(3, "w1 w2"), (60, same), (61, "nowhere"), (62, None)]
    got = text.retrieve(spark.createDataFrame(passages, "id long, text string"), spark.createDataFrame(questions, "q long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(_retrieved(passages, questions, 6))


def test_retrieval_shuffles_no_pairs(spark):
    passages, questions = ([(k, f"the x{k} y{k % 7}") for k in range(400)] for _ in range(2))
    context = spark.sparkContext
    last = lambda: max(s for j in context.statusTracker().getJobIdsForGroup("pairs") for s in context.statusTracker().getJobInfo(j).stageIds)
    mark = lambda: (context.setJobGroup("pairs", ""), spark.range(1).count(), context._jsc.sc().listenerBus().waitUntilEmpty(10_000), last())[-1]
    first = mark()
    assert len(text.retrieve(spark.createDataFrame(passages, "id long, text string"), spark.createDataFrame(questions, "q long, text string")).collect()) == 2400
    written = []
    for k in range(first + 1, mark()):
        with contextlib.suppress(Py4JJavaError):  # some stages are never run
            written.append(context._jsc.sc().statusStore().lastStageAttempt(k).shuffleWriteRecords())
    # 160,000 pairs share a term
    assert 0 < max(written) < 10_000
