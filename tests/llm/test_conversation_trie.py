import random

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import conversation_trie as ct
from tidemark.llm import oracles

SCHEMA = "conv_id long, turn long, role string, text string"


def _rows():
    draw = random.Random(5)
    rows = []
    for c in [*range(-130, -90), *range(100, 160), 205, 206, 300, 301]:
        for t in range(draw.randrange(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", draw.choice(["yes", "no", "é\n", ""])))
    # a whole conversation repeated, long chains, null turn, role and text, repeated rows, ties in turn, null ids
    for c in range(400, 420):
        rows += [(c, t, "user", f"same {t}") for t in range(3)]
    rows += [(500, t, "user", f"deep {t}") for t in range(70)] + [(501, t, "user", f"deep {t}") for t in range(40)]
    rows += [(600, None, None, None), (600, None, "user", "x"), (600, 1, "user", "x"), (600, 1, "user", "x"), (600, 1, "b", "y"), (None, 0, "user", "gone"), (601, 0, "user", "long " * 100_000)]
    draw.shuffle(rows)
    return rows


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_equals_the_definition_and_its_sql(spark):
    rows = _rows()
    want = _sorted(ct.brute_force(rows))
    assert _sorted(ct.digest(spark.createDataFrame(rows, SCHEMA)).collect()) == want
    con = duckdb.connect()
    con.register("conversations", pa.table({k: [r[i] for r in rows] for i, k in enumerate(("conv_id", "turn", "role", "text"))}))
    assert _sorted(con.sql(oracles.TRIE).fetchall()) == want


def test_no_rows_and_clashing_columns(spark):
    assert ct.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(c, t, "user", f"{c % 2} {t}") for c in range(4) for t in range(3)]
    clashing = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("a", "b", "id", "pos", "parent", "depth", "chars")])
    assert _sorted(ct.digest(clashing).collect()) == _sorted(ct.brute_force(rows))


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(101, 140)]
    got = _sorted(ct.digest(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == _sorted(ct.brute_force(rows)) and len(got) == 2


def test_lists_of_ids_are_cut_and_joined_again(spark, monkeypatch):
    monkeypatch.setattr(ct, "LIST_BYTES", 64)
    rows = [(c, t, "user", "same") for c in range(90) for t in range(7)]
    assert _sorted(ct.digest(spark.createDataFrame(rows, SCHEMA)).collect()) == _sorted(ct.brute_force(rows))


def test_rounds_follow_the_logarithm_of_a_chain(spark):
    n = 2_000
    chain = spark.range(n).selectExpr("id", "if(id = 0, null, id - 1) as parent", "id as depth", f"if(id = {n - 1}, 0L, 1L) as n", f"if(id = {n - 1}, 0L, id + 1) as child", f"if(id = {n - 1}, 0L, id + 1) as child_depth", f"if(id = {n - 1}, 1L, 0L) as leaves", "id as saved")
    totals, rounds = ct.subtree_totals(chain)
    assert {(r.id, r.leaves, r.saved) for r in totals.collect()} == {(k, 1, sum(range(k, n))) for k in range(n)} and rounds <= 16
