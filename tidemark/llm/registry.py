"""Queries of the corpus operators over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, conversation_trie, embedding_dedup, html_extraction, interpolated_lm, language_id, license_scan, line_dedup, merkle, mixing, oracles, simhash, substring_dedup, topk
from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@_query("op10_substring_dedup", oracles.SUBSTRINGS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


@_query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


@_query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op9_mix_sources", oracles.MIX)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@_query("op3_line_dedup", line_dedup.ORACLE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


@_query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


@_query("op1_language_id_pages")
def op1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(language_id.from_pages(table(spark, sf_dir, "pages")))
    return found.selectExpr("id as page_id", "declared", "language", "round(confidence, 6) as confidence", "accepted")


@_query("op6_embedding_near_dedup", oracles.EMBEDDINGS)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@_query("op5_exact_top_k", topk.ORACLE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows.where("vec_id % 50 = 0"), rows, 5)


@_query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@_query("op8_html_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@_query("op11_merkle_manifest", oracles.MERKLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


@_query("op13_conversation_trie", oracles.TRIE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.digest(table(spark, sf_dir, "conversations"))


@_query("op12_interpolated_lm")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_lm.score(table(spark, sf_dir, "documents"))
