from pyspark.sql import functions as F

from tidemark.llm import language_id as li


def test_accuracy_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = li.digest(docs)
    assert got.count() == docs.count()
    right = got.agg(F.avg((F.col("language") == F.col("declared")).cast("int")), F.avg(F.col("accepted").cast("int"))).first()
    assert right[0] > 0.95 and right[1] > 0.98


def test_text_outweighs_a_false_declaration_and_rows_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 500")
    odd = F.col("doc_id") % 10 == 3
    told = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(odd, F.lit(None)).otherwise(F.col("lang")))
    got = li.digest(told).join(told.select("doc_id", "truth"), "doc_id").where(F.col("doc_id") % 10 == 3)
    assert got.agg(F.avg((F.col("language") == F.col("truth")).cast("int"))).first()[0] > 0.95


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = li.from_pages(pages)
    assert rows.where("declared is null or host is null or suffix is null").count() == 0
    assert li.identify(rows).where("language = declared").count() > 0.95 * pages.count()


def test_edge_rows(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "the house and the garden", None, "a", 0), (4, "the garden and the house " * 2000, "en", "a", 0), (4, "das haus und der garten", "de", "b", 0), (None, "das haus und der garten", "de", "b", 0), (5, "?", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int")
    got = {(r["doc_id"], r["declared"]): (r["language"], r["accepted"]) for r in li.digest(docs).collect()}
    assert len(got) == 7
    assert got[(1, "en")][1] is False and got[(2, "en")][1] is False and got[(5, None)][1] is False
    assert got[(3, None)] == ("en", True) and got[(None, "de")] == ("de", True)
    assert li.keep_accepted(docs).columns == docs.columns and li.keep_accepted(docs).count() == 4
    assert li.digest(docs.limit(0)).collect() == []


def test_many_declared_languages(spark):
    """100 languages, each with words of its own; a rare one is found as well."""
    import random

    pick, rows = random.Random(1), []
    for k in range(100):
        letters = [chr(97 + (k * 7 + j * (k % 11 + 1)) % 26) + chr(97 + (k // 26 + j * 3) % 26) for j in range(8)]
        own = ["".join(pick.choice(letters) for _ in range(3)) for _ in range(12)]
        rows += [(1000 * k + j, " ".join(pick.choice(own) for _ in range(40)), f"l{k}", "s") for j in range(2 if k % 9 else 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = li.digest(docs).collect()
    assert sum(r["language"] == r["declared"] for r in got) > 0.98 * len(rows)
    assert len({r["language"] for r in got}) >= 98


def test_rows_that_share_an_id_and_undeclared_tables(spark):
    good = "the house and the garden of the old man"
    rows = [(1, good, "en", "a", 1, 2), (1, "?", "en", "a", 1, 2), (1, good, "en", "a", 1, 2), (None, "?", "en", "a", 1, 2), (2, None, None, None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _own_row int, held int")
    kept = li.keep_accepted(docs)
    assert kept.columns == docs.columns and [r["text"] for r in kept.collect()] == [good, good]
    none = docs.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert li.keep_accepted(none).count() == 5 and not any(r["accepted"] for r in li.digest(none).collect())
