from tidemark.llm import substring_dedup as sd


def test_equals_brute_force_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(sd.brute_force([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]))
    assert sorted(map(tuple, sd.digest(docs).collect())) == want


def test_edge_rows(spark):
    run = " ".join("abcdefghijklmnop")
    rows = [(1, None, 0), (None, run, 0), (2, run, 0), (3, run, 1), (3, run + " x", 1), (4, "", 1), (5, "a " * 40, 1), (6, "a\t" * 30, 1), (7, "é " + run + "\n" + run, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hashes int")
    want = sorted(sd.brute_force([r[:2] for r in rows]), key=str)
    assert sorted(map(tuple, sd.digest(docs).collect()), key=str) == want
    assert sd.digest(docs.limit(0)).collect() == []


def _same(spark, rows, **options):
    got = sd.drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), **options)
    want = {(r[0], r[1], r[2]) for r in sd.brute_force(rows)}
    assert {(r.doc_id, r.n_words, r.n_removed) for r in got.collect()} == want and got.count() == len(rows)


def test_passages_across_chunks_of_a_task(spark):
    """Several chunks in a task, and passages within one chunk, between chunks, and in both."""
    import random

    draw = random.Random(4)
    shared = [" ".join(f"s{k}x{j}" for j in range(20)) for k in range(6)]
    rows = [(i, " ".join([*(f"w{i}y{j}" for j in range(30)), draw.choice(shared), *(f"v{i}y{j}" for j in range(10)), draw.choice(shared)])) for i in range(120)]
    _same(spark, rows, chunk_bytes=2_000)
    _same(spark, rows)


def test_very_long_texts_and_many_null_ids(spark):
    """A text longer than a slice; null ids keep all their words wherever they lie."""
    long = " ".join(f"n{k % 50_000}" for k in range(300_000))
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(1, long), (2, passage), (3, f"{passage} {long[:200_000]}"), *[(None, f"{passage} own {k}") for k in range(40)], (None, None)]
    _same(spark, rows)
