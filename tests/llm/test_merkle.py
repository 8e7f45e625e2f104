import hashlib

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, oracles

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _rows(n):
    sources = ["a", None, "é", "Z", ""]
    out = [(i, sources[0] if i % 3 else sources[i % 5], "en" if i % 4 else None, i if i % 7 else None, None if i % 11 == 5 else f"line {i}\nmore é\n" if i % 2 else f"plain {i}") for i in range(n)]
    # rows of one id, equal rows, null ids, an empty and a very long text, a source of one row
    return out + [(3, "a", "en", 1, "other"), (3, "a", "en", 1, "other"), (None, "a", None, None, "x\ny"), (None, None, None, None, None), (n, "a", "en", 0, ""), (n + 1, "a", "en", 2, "long\n" * 200_000), (n + 2, "alone", "en", 1, "q")]


@pytest.mark.parametrize("n, levels", [(100, 1), (57, 2), (100, 6)])
def test_equals_the_definition(spark, n, levels):
    rows = _rows(n)
    got = sorted((tuple(r) for r in merkle.digest(spark.createDataFrame(rows, SCHEMA), levels).collect()), key=repr)
    assert got == sorted(merkle.brute_force(rows), key=repr)


def test_short_last_runs(spark):
    # a source of each number of rows, so that every shape of a last run is met
    rows = [(100 * n + i, f"s{n:02}", "en", 1, str(i)) for n in range(1, 29) for i in range(n)]
    got = sorted(tuple(r) for r in merkle.digest(spark.createDataFrame(rows, SCHEMA), 1).collect())
    assert got == sorted(merkle.brute_force(rows))


def test_one_row_and_no_rows(spark):
    assert merkle.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    got = merkle.digest(spark.createDataFrame([(7, "s", None, None, "t")], SCHEMA)).first()
    assert got.root == got.subroot == got.leaf == got.folded_root and got.proof_sha256 == hashlib.sha256(b"").hexdigest() and got.verified


def test_columns_with_clashing_names(spark):
    rows = _rows(40)
    plain = spark.createDataFrame(rows, SCHEMA)
    clashing = plain.select("*", *[F.lit("x").alias(c) for c in ("leaf", "root", "tree", "block", "path", "pos", "many", "held", "tie")])
    assert sorted(map(repr, merkle.digest(clashing, 1).collect())) == sorted(map(repr, merkle.digest(plain, 1).collect()))


def test_a_changed_row_fails_and_only_that(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b", "en", 1, f"text {i}") for i in range(50)], SCHEMA)
    changed = merkle.leaf_of([F.when(F.col("doc_id") == 17, F.lit("forged")).otherwise(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS])
    found = merkle.manifest(docs, changed, levels=1)
    assert [r.doc_id for r in found.where("not verified").collect()] == [17]


def test_the_definition_equals_its_sql():
    rows = _rows(60)
    con = duckdb.connect()
    con.register("documents", pa.table({k: [r[i] for r in rows] for i, k in enumerate(merkle.FIELDS)}))
    assert sorted(con.sql(oracles.MERKLE).fetchall(), key=repr) == sorted(merkle.brute_force(rows), key=repr)
