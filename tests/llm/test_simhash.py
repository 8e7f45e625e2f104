import numpy as np

from tidemark.llm import simhash as sh


def test_equals_brute_force_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(sh.brute_force([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]))
    assert sorted(map(tuple, sh.digest(docs).collect())) == want


def test_edge_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "A", 0), (4, "a", 0), (5, "a b", 0), (6, "a\tb", 1), (7, "a b c d é", 1), (8, " A  B C D É", 1), (8, "a b c d e", 1), (9, "x " * 3000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    want = sorted(sh.brute_force([r[:2] for r in rows]))
    assert sorted(map(tuple, sh.digest(docs).collect())) == want
    assert sh.digest(docs.limit(0)).collect() == []
    assert sh.keep_one(docs).columns == docs.columns


def _components(fps):
    from itertools import combinations

    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for f, g in combinations(fps, 2):
        if ((f ^ g) & (2**64 - 1)).bit_count() <= sh.RADIUS:
            a, b = top(f), top(g)
            root[max(a, b)] = min(a, b)
    return {f: top(f) for f in fps}


def test_crowds_and_chains_of_fingerprints(spark):
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    crowd = {base ^ (1 << a) ^ (1 << b) for a in range(30) for b in range(30)}
    chain, x = set(), int(rng.integers(1 << 62))
    for k in range(0, 60, 2):
        x ^= (1 << k) | (1 << (k + 1))
        chain.add(x)
    some = sorted(crowd | chain | {int(v) for v in rng.integers(1 << 62, size=200)})
    fps = spark.createDataFrame([(f,) for f in some], "fp long")
    got = dict(map(tuple, sh.connected_components(sh.links(fps)).collect()))
    assert {f: got.get(f, f) for f in some} == _components(some)


def test_thresholds_follow_the_general_pigeonhole_principle():
    together = np.full((64, 64), 250.0)
    np.fill_diagonal(together, 500.0)
    for total in (1e3, 1e6, 1e10):
        plan = sh.allocate(together * total / 1000, total)
        assert sum(t + 1 for _, t in plan) == sh.RADIUS + 1
        assert len({b for own, _ in plan for b in own}) == sum(len(own) for own, _ in plan)


def test_keep_one_drops_rows_not_ids(spark):
    same, other = "one two three four five six seven", "an unrelated text of quite other words altogether here"
    rows = [(1, same, 0), (5, same, 1), (5, other, 2), (7, same.upper(), 3), (None, same, 4), (8, other, 5), (9, None, 6), (10, "", 7), (1, same, 8), (5, other.upper(), 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted((str(r[0]), r[1], r[2]) for r in sh.keep_one(docs).collect())
    kept = {k for _, _, k in got}
    # of the two spellings of 5's other text one stays
    assert kept - {2, 9} == {0, 4, 6, 8} and len(kept & {2, 9}) == 1
    assert sh.keep_one(docs.limit(0)).collect() == []
