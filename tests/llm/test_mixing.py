import re

from tidemark.llm import mixing


def _targets(sizes, weights=mixing.WEIGHTS, most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if s not in full and out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def _check(docs):
    got = mixing.mix(docs).collect()
    rows = [(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["source"]) for r in docs.collect()]
    sizes: dict = {}
    for _, n, s in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = _targets(sizes)
    assert sorted((i, n, sizes[s], round(want[s], 6)) for i, n, s in rows if i is not None) == sorted((r[0], r[1], r[2], round(r[3], 6)) for r in got if r[0] is not None)
    assert len(got) == len(rows)
    largest = max([n for _, n, _ in rows], default=0)
    for s in sizes:
        taken = sum(r["taken"] for r in got if r["source_size"] == sizes[s] and round(r["target"], 6) == round(want[s], 6))
        same = sum(round(want[x], 6) == round(want[s], 6) and sizes[x] == sizes[s] for x in sizes)
        assert abs(taken - same * want[s]) <= 2 * same * largest
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    return got


def test_given_documents(spark, sf):
    _check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_edge_rows(spark):
    rows = [(k, "a b c " * (k % 7 + 1), f"s{k % 3}" if k % 5 else None, k) for k in range(200)]
    rows += [(900, None, "s0", 0), (901, "", "empty", 0), (902, " \t", None, 0), (903, "w " * 3000, "long", 0), (904, "x", "tiny", 1), (904, "x", "tiny", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target long")
    _check(docs)
    assert mixing.mix(docs.limit(0)).collect() == []
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.where("doc_id = 901").count() == 1
    few = spark.createDataFrame([(1, "a b", "x"), (2, "c d", "x")], "doc_id long, text string, source string")
    assert sorted(r["taken"] for r in _check(few)) == [2, 2]


def test_take_goes_by_row(spark):
    """One id on a long and a short text, repeated rows, and columns of the operator's own names."""
    rows = [(4, "w " * 1000, "a", 1), (4, "v", "a", 2), (5, "u u", "b", 3), (5, "u u", "b", 3), (None, "t t t", None, 4), (6, None, "b", 5)]
    docs = spark.createDataFrame([(*r, r[3], r[3], r[3]) for r in rows], "doc_id long, text string, source string, row int, _id int, _times int, held int")
    want = {}
    for r in mixing.mix(docs).collect():
        size = r["size"]
        want[(r["doc_id"], size)] = want.get((r["doc_id"], size), 0) + (r["taken"] // size if size else 1)
    got = {}
    for r in mixing.take(docs).collect():
        k = (r["doc_id"], len((r["text"] or "").split()))
        got[k] = got.get(k, 0) + 1
    assert mixing.take(docs).columns == docs.columns
    assert got == {k: n for k, n in want.items() if n}


def test_many_sources_by_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 8)
    rows = [(k, "a b c " * (k % 11 + 1), f"host{k % 100}") for k in range(400)]
    _check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
