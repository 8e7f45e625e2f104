import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import interpolated_lm as lm

SCHEMA = "doc_id long, text string"


def _rows():
    draw = random.Random(3)
    words = ["The", "the", "cat", "sat", "Éa", "on", "mat", *[f"w{k}" for k in range(40)]]
    rows = [(i, " ".join(draw.choice(words[: draw.randrange(2, 47)]) for _ in range(draw.randrange(0, 60)))) for i in range(300)]
    # null and empty texts, a null id, repeated rows and ids, a very long text, white space of all kinds
    return rows + [(300, None), (301, ""), (302, " \n\t"), (None, "the cat sat"), (None, None), (7, "the cat"), (7, "the cat"), (303, "the mat " * 60_000), (304, "a\x0bb\x0cc\rd e f")]


def _same(got, want):
    got, want = (sorted(map(tuple, x), key=repr) for x in (got, want))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[5:], b[5:]))


@pytest.mark.parametrize("chunk_bytes", [1 << 10, lm.CHUNK_BYTES])
def test_equals_the_definition(spark, chunk_bytes):
    rows = _rows()
    _same(lm.score(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk_bytes=chunk_bytes).collect(), lm.brute_force(rows))


def test_no_rows_one_row_and_clashing_columns(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(i, f"a b c{i % 3}") for i in range(25)]
    clashing = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("fold", "chunk", "ids", "counts", "bucket", "size")])
    _same(lm.score(clashing).collect(), lm.brute_force(rows))
    _same(lm.score(spark.createDataFrame([(1, "only one")], SCHEMA)).collect(), lm.brute_force([(1, "only one")]))


def test_held_out_texts_are_better_told_than_by_the_base(spark):
    draw = random.Random(9)
    rows = [(i, " ".join(w for _ in range(30) for w in draw.choice((("red", "apple"), ("blue", "sky"), ("green", "field"))))) for i in range(400)]
    found = lm.score(spark.createDataFrame(rows, SCHEMA)).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert found[1] > 0.7 * found[0]


def test_weights_of_buckets_without_tokens():
    table = lm.filled({3: (0.7, 0.2, 0.1), lm.ONE_WORD + 5: (0.0, 0.6, 0.4)})
    assert all(math.isclose(sum(w), 1.0) for w in table[1:])
    assert table[30].tolist() == table[1].tolist() == [0.7, 0.2, 0.1] and table[lm.ONE_WORD + 9].tolist() == [0.0, 0.6, 0.4] and table[lm.ONE_WORD].tolist() == [0.0, 0.0, 1.0]
    assert all(w[0] == 0 for w in lm.filled({})[lm.ONE_WORD :])
