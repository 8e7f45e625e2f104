import numpy as np

from tidemark.llm import embedding_dedup as ed


def test_given_embeddings_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = ed.brute_force([(r[0], r[1], r[2]) for r in df.select("vec_id", "embedding", "label").collect()])
    got = {r[0]: (r[1], r[2]) for r in ed.near_duplicates(df).collect()}
    assert set(got) == set(want)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] and got[i][1] >= want[i][1] for i in want)


def test_crowds_copies_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    rows = [(k, [float(x) for x in base + 0.05 * rng.standard_normal(16) * (k % 3)], "a") for k in range(300)]
    monkeypatch.setattr(ed, "BLOCK", 50)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    want = ed.brute_force(rows)
    got = {r[0]: (r[1], r[2]) for r in ed.near_duplicates(df).collect()}
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_edge_rows(spark):
    nan, one = float("nan"), [1.0, 2.0, 3.0]
    rows = [(1, one, 1), (2, one, 1), (3, [2.0, 4.0, 6.0], 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [], 1), (8, [0.0] * 3, 1), (9, [nan, 1.0, 1.0], 1), (10, [None, 1.0, 1.0], 1), (11, [1.0, 2.0], 1), (12, [1e-200, 2e-200, 3e-200], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = {r[0]: (r[1], r[2], r[3]) for r in ed.near_duplicates(df).collect()}
    assert got == {i: (3, 1, i == 1) if i in (1, 2, 3, 12) else (0, i, True) for i, *_ in rows}
    assert ed.near_duplicates(df.limit(0)).collect() == []
    lost = spark.createDataFrame([(None, one, 1)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in ed.near_duplicates(lost).collect()] == [(None, 0, None, None)]


def test_nearest_e8_point_is_nearest():
    x = np.random.default_rng(0).standard_normal((500, 8)) * 2
    at = ed.nearest_e8(x)
    d = ((x - at) ** 2).sum(axis=1)
    assert (((x[:, None] - at[:, None] - ed._NEAR[None]) ** 2).sum(axis=2) >= d[:, None] - 1e-9).all()
    assert d.max() <= 1 + 1e-9


def test_rows_of_one_id_link_each_by_its_own_vector(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.001]), (3, [0.0, 2.0]), (3, [0.0, 2.0]), (4, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "a") for r in rows], "vec_id long, embedding array<double>, label string")
    got = sorted(map(tuple, ed.near_duplicates(df).collect()))
    # (1, [1, 0]) links with 2; (1, [0, 1]) with both rows of 3
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_pairs_of_blocks_against_all_pairs():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(8) + 0.12 * rng.standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    here, sub, group = rng.random(300) < 0.3, rng.integers(0, 2, 300), np.sort(rng.integers(0, 4, 300) // 3)
    want = np.triu((x @ x.T >= ed.COSINE) & (group[:, None] == group) & (here[:, None] | here), 1)
    for cross in (False, True):
        own = want & (sub[:, None] != sub) if cross else want
        crossed, tab = np.full(300, cross), np.zeros(300, np.int64)
        found = [p for part in ed._near_pairs(group, x, here, sub, crossed) for p in zip(*part)]
        # no two rows share a cell, so none met before
        keys = np.arange(300 * ed.TABLES * (1 + ed.PROBES)).reshape(300, ed.TABLES, -1)
        for rows, others, near in ed._near_crowds(group, x, here, sub, crossed, tab, keys):
            found += [tuple(sorted((rows[i], others[j]))) for i, j in zip(*np.nonzero(near))]
        assert sorted(found) == sorted(zip(*np.nonzero(own)))


def test_a_crowd_of_copies_and_near_copies(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    rows = [(k, [float(x) for x in base + 0.12 * rng.standard_normal(64) * (k % 4 > 0)], "a") for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    want = ed.brute_force(rows)
    got = {r[0]: (r[1], r[2]) for r in ed.near_duplicates(df).collect()}
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] and got[i][1] >= want[i][1] for i in want)
