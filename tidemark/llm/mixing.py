"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source is a flow with a target of words. Its documents are shuffled (by the
md5 of pass and id, so reruns agree) and queued pass after pass, at most
``MOST_PASSES`` passes; a document's virtual finish time is the source's words up to
its end divided by the source's target. All queues are then merged in the order of
finish time and cut at the total budget, the sum of the targets.

Both running sums (words of a source, words of the merged queue) are taken in two
steps: rows are dealt to ordered buckets of bounded size, bucket totals get running
sums, and each bucket sums its own rows from there. A source with a third of all
rows has a third of the buckets; no window holds more than one bucket's rows, or one
row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, stored

WEIGHTS = (1.0, 2.0, 3.0)
MOST_PASSES = 3
#: Least rows of a bucket, as expected.
BUCKET_ROWS = 2048
#: Parts that each source is dealt into where it meets its target.
SALTS = 16
_DRAW_BITS = 60


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    # without separators in front, each word and the separators after it leave one mark
    bare = F.ltrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(F.regexp_replace(bare, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def _bucket_rows(n: Column) -> Column:
    """Rows of a bucket: beyond some millions of rows, as many as there are buckets."""
    return F.greatest(F.lit(float(BUCKET_ROWS)), F.ceil(F.sqrt(n.cast("double"))).cast("double"))


def _ranged(rows: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """``rows`` with ``_part``, which follows the order, as kept in the shared folder."""
    return cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``source, source_size, docs, target`` from ``source, size``, one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn. The total of all
    sizes is shared by weight; no target exceeds ``most`` times its source's size, and
    the excess is shared anew by weight until none does: sources are filled in the
    order of limit over weight, and those come to their limit whose limit lies below
    their share of what the sources before them leave. Sources may be many: their
    order is taken part by part.
    """
    own = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    many, total = own.agg(F.count("*"), F.sum("source_size")).first()
    parts, by_source = max(1, -(-many // BUCKET_ROWS)), F.col("source").asc_nulls_last()
    ranked = _running(_ranged(own, [by_source], parts).withColumn("_one", F.lit(1)), [], "_part", [by_source], "_one", "_rank")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    own = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size").cast("double") * most).drop("_part", "_one", "_rank")
    order = [(F.col("most") / F.col("weight")).asc(), by_source]
    filled = _ranged(own, order, parts)
    weighs = filled.agg(F.sum("weight")).first()[0] or 0.0
    filled = _running(_running(filled, [], "_part", order, "most", "_filled"), [], "_part", order, "weight", "_weighed")
    left = F.lit(float(total or 0)) - (F.col("_filled") - F.col("most"))
    rest = F.lit(float(weighs)) - F.col("_weighed") + F.col("weight")
    level = filled.withColumn("level", F.greatest(left, F.lit(0.0)) / rest).withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    level = cut(level)
    # the first source that is not full sets the level of all after it
    # (of several with one limit over weight, the first has the highest level)
    first = level.where("not full").agg(F.min(F.struct(F.col("most") / F.col("weight"), (-F.col("level")).alias("less")))).first()[0]
    shared = F.lit(-first["less"] if first else 0.0)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("weight") * shared))
    return level.select("source", "source_size", "docs", target.alias("target"))


def _draw(passed: Column, doc: Column) -> Column:
    """A number below 2^60 from the pass and the id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", passed.cast("string"), F.coalesce(doc.cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("long")


def _running(rows: DataFrame, by: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row, over buckets in order within ``by``."""
    totals = rows.groupBy(*by, bucket).agg(F.sum(value).alias("_total"))
    before = F.coalesce(F.sum("_total").over(W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = totals.withColumn("_start", before).drop("_total")
    inside = rows.withColumn("_own", F.sum(value).over(W.partitionBy(*by, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return inside.join(starts, [*by, bucket]).withColumn(out, F.col("_start") + F.col("_own")).drop("_start", "_own")


def mix_sizes(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``row, doc_id, size, source_size, target, taken`` from ``row, doc_id, source, size``.

    ``taken``: words of the document that the mix takes, repeats counted. Ties in
    finish time go by source, pass, draw, id and row. A source without words takes
    nothing; an empty table gives an empty result.
    """
    sizes = sizes.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    targets = source_targets(sizes, weights, most)
    targets = cut(targets.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).drop("source"))
    # passes that the target can reach; the last of them is cut by the merged queue
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")) + 1)).otherwise(F.lit(1))
    targets = targets.withColumn("passes", passes.cast("int")).withColumn("parts", F.ceil(F.col("docs") / _bucket_rows(F.col("docs"))))
    # a source may have most of the rows: its target goes to all salts, and they are dealt among them
    salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sizes = sizes.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    queued = sizes.join(salted, ["key", "salt"]).drop("salt").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    queued = queued.withColumn("draw", _draw(F.col("pass"), F.col("doc_id")))
    # buckets of a source: by pass, then by draw
    part = F.floor(F.col("draw") / F.lit(float(1 << _DRAW_BITS)) * F.col("parts"))
    queued = queued.withColumn("bucket", F.col("pass") * F.col("parts") + F.least(part, F.col("parts") - 1))
    queued = _running(queued, ["key"], "bucket", [F.col("draw"), F.col("doc_id"), F.col("row")], "size", "so_far")
    queued = queued.withColumn("finish", F.coalesce(F.try_divide(F.col("so_far").cast("double"), F.col("target")), F.lit(0.0)))
    queued = cut(queued.select("row", "doc_id", "key", "size", "pass", "draw", "source_size", "target", "finish"))
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    # the cut lies before the first power of two by which the queue holds the budget, mostly 1 or 2; nothing after it is taken
    ends = [float(1 << k) for k in range(63)]
    held = queued.agg(F.count("*"), F.max("finish"), *[F.sum(F.when(F.col("finish") <= x, F.col("size"))) for x in ends]).first()
    span = next((x for x, words in zip(ends, held[2:]) if (words or 0) >= budget), max(held[1] or 0.0, 1.0))
    parts = F.ceil(F.lit(held[0]) / _bucket_rows(F.lit(held[0])))
    reached = F.when(F.col("finish") <= span, F.least(F.floor(F.col("finish") / F.lit(span) * parts), parts - 1)).cast("long")
    merged = queued.withColumn("slot", reached)
    late = merged.where("slot is null").withColumn("merged", F.lit(None).cast("long"))
    order = [F.col("finish"), F.col("key"), F.col("pass"), F.col("draw"), F.col("doc_id"), F.col("row")]
    merged = _running(merged.where("slot is not null").withColumn("all", F.lit(0)), ["all"], "slot", order, "size", "merged")
    columns = ["row", "doc_id", "size", "source_size", "target", "merged"]
    took = F.sum(F.when(F.col("merged") <= F.lit(budget), F.col("size")).otherwise(F.lit(0))).alias("taken")
    whole = merged.select(*columns).union(late.select(*columns))
    return whole.groupBy("row", "doc_id", "size", "source_size", "target").agg(took)


def _sizes(docs: DataFrame, row: Column, id_col: str, text_col: str, source_col: str) -> DataFrame:
    doc, source = F.col(id_col).cast("long"), F.col(source_col).cast("string")
    # repeated rows stay apart by a number of their own, kept by the checkpoint
    return cut(docs.select(doc.alias("doc_id"), source.alias("source"), word_count(F.col(text_col)).alias("size"), row.alias("row")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, a row for each row of ``docs``."""
    return mix_sizes(_sizes(docs, F.monotonically_increasing_id(), id_col, text_col, source_col), weights).drop("row")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it; a row without words stays once.

    Judged by row, also where rows share an id, a text or all they have; null ids,
    texts and sources are taken like others. Columns stay as they are, whatever their names.
    """
    # what was numbered is written, so that rows keep their numbers
    numbered = stored(docs.select(F.struct("*").alias("held"), F.monotonically_increasing_id().alias("row")))
    flat = numbered.select("row", *[F.col("held").getField(c).alias(f"own_{k}") for k, c in enumerate((id_col, text_col, source_col))])
    found = mix_sizes(_sizes(flat, F.col("row"), "own_0", "own_1", "own_2"), weights)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1)).cast("int")
    found = found.select("row", times.alias("times")).where("times > 0")
    joined = numbered.join(found, "row")
    return joined.select("held", F.explode(F.sequence(F.lit(1), F.col("times")))).select("held.*")
