import math
import random

import pytest

from tidemark.llm import topk


def _brute(queries, rows, k):
    def whole(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and whole(v)]
    out = []
    for i, v in ints:
        if i in queries:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ints if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_given_embeddings(spark, sf, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 10)
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()]
    got = topk.search(df.where("vec_id % 5 = 0"), df, 5)
    assert sorted(map(tuple, got.collect())) == _brute({i for i, _ in rows if i % 5 == 0}, rows, 5)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0]), (1, [1.0, -2.0]), (2, [1.0, -2.0]), (3, [-1.0, 2.0]), (50, [0.001, -0.001]), (100, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (150, [3.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, score int")
    for k in (1, 2, 10):
        got = sorted(map(tuple, topk.search(df.where("vec_id % 50 = 0"), df, k).collect()))
        assert got == _brute({0, 50, 100, 150}, rows, k)
    assert topk.search(df.limit(0), df, 3).collect() == [] and topk.search(df, df.limit(0), 3).collect() == []
    assert topk.search(df.limit(0), df.limit(0), 3).collect() == []


def test_large_components_and_ragged_rows(spark, monkeypatch):
    """Exact beyond 2^53, with slices that only some rows have."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    pick = random.Random(3)
    for size in (1.0, 1e6, 1e5 + 0.37):
        rows = [(i, [pick.uniform(-size, size) for _ in range(pick.choice([0, 1, 5, 16, 17, 40, 200 if i == 7 else 40]))]) for i in range(60)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert sorted(map(tuple, topk.search(df.where("vec_id % 6 = 0"), df, 4).collect())) == _brute(set(range(0, 60, 6)), rows, 4)
    # 1e9 in few dimensions: whole numbers far beyond 2^53, within a long only where the other row is small
    rows = [(0, [1e9 + 1, -3.0]), (1, [1e4 + 0.5, 1e9]), (2, [-1e4, 7e8]), (3, [1e3, -1e9 - 1]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(df.where("vec_id = 0"), df, 3).collect())) == _brute({0}, rows, 3)


def test_what_fits_no_long_raises(spark):
    for rows in ([(0, [1e17]), (1, [1.0])], [(0, [1e9]), (1, [1e9])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="fit into a long|OverflowError"):
            topk.search(df, df, 2).collect()


def test_repeated_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (5, [4.0, 0.0]), (7, [0.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df.where("vec_id = 0"), df, 3).collect()
    assert sorted(map(tuple, got)) == sorted([(0, 1, 5, 4 * 65536), (0, 2, 5, 3 * 65536), (0, 3, 5, 3 * 65536)] * 2)


def test_blocks_meet_without_shuffling_entries(spark, monkeypatch):
    """What stands between two phases is ``k`` rows of each query and block of rows, however many entries nodes send."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 300)
    monkeypatch.setattr(topk, "QUERY_ROWS", 40)
    monkeypatch.setattr(topk, "CELLS", 5000)
    pick = random.Random(5)
    # nearly equal rows: most are entries of most queries
    rows = [(i, [1 + pick.random() / 8 for _ in range(pick.choice([32, 48]))]) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sizes, own = [], topk.cut
    monkeypatch.setattr(topk, "cut", lambda x: (lambda y: (sizes.append(sum(len(v) for r in y.collect() for v in r if isinstance(v, (bytes, bytearray)))), y)[1])(own(x)))
    got = sorted(map(tuple, topk.search(df.where("vec_id % 10 = 0"), df, 5).collect()))
    floats = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert got == _brute(set(range(0, 1000, 10)), floats, 5)
    # blocks of rows: two bytes a component and four numbers a row
    assert 0 < max(sizes) <= 1000 * (48 * 2 + 4 * 8)
