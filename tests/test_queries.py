"""Every registered query against its SQL on the smallest tables."""

import itertools
import math

import duckdb
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    out = duckdb.connect()
    out.sql("SET TimeZone='UTC'")
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return out


def _plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v + 0.0:.5g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _exact(v):
    """What must agree to the letter: everything but floats."""
    if isinstance(v, float):
        return 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_exact(x) for x in v)
    return v


def _same(a, b):
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, float) and isinstance(b, float):
        return (a != a and b != b) or math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-6)
    return _plain(a) == _plain(b)


def _ordered(rows):
    return sorted(rows, key=lambda r: (repr(_exact(r)), repr(_plain(r))))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = _ordered(tuple(r[c] for c in cols) for r in df.collect())
    rel = con.sql(registry.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    want = _ordered(tuple(r[i] for i in at) for r in rel.fetchall())
    assert sorted(rel.columns) == cols and len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if not _same(a, b)] == []


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_closes_at_ties_of_rounding_equal_their_sql(spark, tmp_path):
    """Three days of returns in half hundredths give closes whose fifth digit is the last and a 5; all digits must be the SQL's."""
    lines = [(k, f"1995-01-0{day}", (h + i) // 2 / 100, 1.0) for k, hs in enumerate(itertools.product(range(1, 21, 3), repeat=3)) for day, h in enumerate(hs, 1) for i in (0, 1)]
    df = spark.createDataFrame(lines, "l_suppkey long, day string, l_discount double, l_quantity double")
    df.selectExpr("l_suppkey", "cast(day as timestamp_ntz) as l_shipdate", "l_discount", "l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {(r.entity, r.date): r.close for r in registry.QUERIES["s02_closes_csv"](spark, str(tmp_path)).collect()}
    want = {(entity, date): close for entity, date, close in con.sql(registry.ORACLES["s02_closes_csv"]).fetchall()}
    assert len(got) == 7**3 * 3 and got == want
