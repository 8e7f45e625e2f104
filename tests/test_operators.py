"""Closed-form pins and leakage properties of the operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, panel, quality, recursion, risk
from tidemark.plans import base


def _days(n):
    return [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(n)]


@pytest.fixture(scope="module")
def px(spark, sf):
    return base.dense(spark, sf).cache()


@pytest.mark.parametrize("op", [panel.momentum, panel.trend, panel.rolling_risk, panel.drawdown_path, panel.exposure_state, panel.regime, lambda x: panel.rolling_z(x, "volume"), lambda x: panel.expanding_transition(x.withColumn("s", (F.col("r") < 0).cast("int")), "s", 1)])
def test_the_future_does_not_change_the_past(px, op):
    cut = "1998-01-01"
    changed = px.withColumn("r", F.when(F.col("date") >= cut, -F.col("r")).otherwise(F.col("r"))).withColumn("close", F.when(F.col("date") >= cut, F.col("close") * 3).otherwise(F.col("close"))).withColumn("volume", F.when(F.col("date") >= cut, 0.0).otherwise(F.col("volume")))
    before = lambda x: sorted(map(str, op(x).where(F.col("date") < cut).collect()))
    assert before(px) == before(changed)


def test_asof_join_edges(spark):
    d = _days(10)
    left = spark.createDataFrame([(1, "a", d[5]), (2, "a", d[0]), (3, "b", d[5]), (4, None, d[5]), (5, "a", None)], "id int, k string, t date")
    right = spark.createDataFrame([("a", d[1], 1), ("a", d[5], 2), ("a", d[6], 3), ("c", d[0], 4), ("a", None, 9)], "k string, u date, v int")

    def got(**more):
        return {r["id"]: r["r_v"] for r in asof.asof_join(left, right, by=["k"], left_ts="t", right_ts="u", **more).collect()}

    assert got() == {1: 2, 2: None, 3: None, 4: None, 5: None}
    assert got(direction="forward") == {1: 2, 2: 1, 3: None, 4: None, 5: None}
    assert got(direction="nearest", tolerance=1) == {1: 2, 2: 1, 3: None, 4: None, 5: None}
    assert got(tolerance=0)[1] == 2


def test_asof_join_never_sees_later_facts(spark):
    d = _days(6)
    left = spark.createDataFrame([(1, "a", d[3])], "id int, k string, t date")
    facts = [("a", d[2], 1)]
    later = facts + [("a", d[4], 99)]
    for rows in (facts, later):
        right = spark.createDataFrame(rows, "k string, u date, v int")
        assert asof.asof_join(left, right, by=["k"], left_ts="t", right_ts="u").first()["r_v"] == 1


def test_drawdown_and_recovery(spark):
    r = [0.1, -0.5, 0.2, 1.0, -0.1]
    df = spark.createDataFrame([("a", t, x) for t, x in zip(_days(5), r)], "entity string, date date, r double")
    row = risk.drawdowns(panel.drawdown_path(df), "entity").first()
    assert math.isclose(row["max_drawdown"], -0.5) and row["recovery_days"] == 2 and row["recovered"]
    assert math.isclose(row["current_drawdown"], -0.1)


def test_performance_needs_twenty_rows(spark):
    rows = [(t, 0.01 * (k % 3 - 1), 0.01 * (k % 2)) for k, t in enumerate(_days(19))]
    df = spark.createDataFrame([("a", *x) for x in rows], "entity string, date date, r double, rb double")
    assert risk.performance(df, "entity").first()["sharpe"] is None


def test_capped_weights(spark):
    df = spark.createDataFrame([("a", 0.7), ("b", 0.2), ("c", 0.1)], "entity string, weight double")
    got = {r["entity"]: round(r["capped"], 6) for r in panel.capped_in_proportion(df, 0.5).collect()}
    assert got == {"a": 0.5, "b": round(0.5 * 2 / 3, 6), "c": round(0.5 / 3, 6)}
    got = {r["entity"]: round(r["capped"], 6) for r in panel.capped_by_room(df, 0.5).collect()}
    assert got == {"a": 0.5, "b": round(0.2 + 0.2 * 0.3 / 0.7, 6), "c": round(0.1 + 0.2 * 0.4 / 0.7, 6)}


def test_tail_fit_recovers_an_exponential_tail(spark):
    rows = [("a", t, -(-math.log(1 - (k + 0.5) / 3000) * 0.01)) for k, t in enumerate(_days(3000))]
    row = risk.tail_fit(spark.createDataFrame(rows, "entity string, date date, r double"), "entity").first()
    assert row["status"] == "ok" and abs(row["shape"]) < 0.05 and abs(row["var"] - 0.01 * math.log(100)) < 0.002


def test_change_point_is_found(spark):
    rows = [("a", t, (0.01 if k < 60 else 0.05) * (1 if k % 2 else -1)) for k, t in enumerate(_days(120))]
    got = recursion.change_points(spark.createDataFrame(rows, "entity string, date date, r double"), rounds=1).orderBy("start").collect()
    assert [r["n"] for r in got] == [60, 60]


def test_combinations_are_refused_beyond_the_limit(spark):
    items = spark.range(50).select(F.col("id"), F.lit("g").alias("g"))
    with pytest.raises(ValueError):
        asof.combinations(items, 4, "g", 4, limit=1000)


def test_membership_is_rebuilt(spark):
    d = _days(5)
    now = spark.createDataFrame([("a",), ("b",)], "ticker string")
    log = spark.createDataFrame([("b", d[3], "added"), ("c", d[2], "removed"), ("d", d[1], "removed"), ("a", d[4], "added"), ("a", d[3], "removed")], "ticker string, day date, action string")
    assert {r[0] for r in asof.membership_at(now, log, F.lit(d[1])).collect()} == {"a", "c"}


def test_last_write_wins(spark):
    old = spark.createDataFrame([(1, 5, "old"), (2, 1, "old")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 5, "new"), (2, 0, "new"), (3, 1, "new")], "k int, v int, x string")
    assert {r["k"]: r["x"] for r in quality.last_write_wins(old, new, ["k"], "v").collect()} == {1: "new", 2: "old", 3: "new"}


def test_combination_grid_against_plain_python(spark, sf):
    from collections import defaultdict
    from itertools import combinations

    from tidemark.plans.registry import QUERIES

    rows = base.trials(spark, sf).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r["trial"]][r["month"]] = r["r"]
    top = sorted(by, key=lambda t: (-len(by[t]), t))[:10]
    want = {}
    for x, y in combinations(sorted(top), 2):
        for split in ("train", "validation"):
            months = [m for m in {*by[x], *by[y]} if (m < dt.date(1999, 1, 1)) == (split == "train")]
            r = [sum(v) / len(v) for v in ([by[k][m] for k in (x, y) if m in by[k]] for m in months)]
            down = math.sqrt(sum(min(v, 0.0) ** 2 for v in r) / len(r)) if r else 0.0
            if r:
                want[(x, y, split)] = (len(r), round(sum(r) / len(r) / down, 5) if down else None)
    got = {(*r["members"], r["split"]): (r["n"], None if r["sortino"] is None else round(r["sortino"], 5)) for r in QUERIES["b11_combination_grid"](spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and (got[k][1] is None) == (want[k][1] is None) and abs((got[k][1] or 0) - (want[k][1] or 0)) < 2e-5 for k in want)
