"""Positions of rows in a global order, without a window over any unbounded group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shuffle_partitions


def running(rows: DataFrame, by: str, order: list[Column], xors: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``pos`` (from 0), ``many`` (rows of the group) and, for each of ``xors`` (longs), the exclusive or up to and with the row.

    ``by`` names a column without nulls. Rows are dealt out by ranges of (``by``, ``order``),
    so a group with most of the rows lies in many parts; parts hand on their counts
    by a table of one row for each group of a part. Rows that are equal in ``by`` and
    ``order`` come in any order, but keep it: what was sorted is checkpointed. Names
    beginning with ``_`` are taken.
    """
    xors = xors or {}
    n = shuffle_partitions(rows.sparkSession)
    taken = rows.select("*", *[v.alias(f"_{k}") for k, v in xors.items()])
    dealt = taken.repartitionByRange(n, F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(by, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"), *[F.bit_xor(f"_{k}").alias(f"_all_{k}") for k in xors])
    earlier, whole = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(by)
    starts = parts.select(
        by, "_part", "_low", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"), F.sum("_rows").over(whole).alias("many"),
        *[F.coalesce(F.bit_xor(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in xors],
    )
    out = placed.join(starts, [by, "_part"]).withColumn("pos", F.col("_start") + F.col("_at") - F.col("_low"))
    # a window holds the rows of one group in one part: what a range holds
    inside = W.partitionBy(by, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    own = [F.col(f"_before_{k}").bitwiseXOR(F.bit_xor(f"_{k}").over(inside)).alias(k) for k in xors]
    return out.select(*rows.columns, "pos", "many", *own)
