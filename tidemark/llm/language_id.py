"""Language ID by Bayesian fusion of evidence.

Four sources of evidence are multiplied as odds:

* the text: naive Bayes over hashed byte trigrams, tempered so that at most
  ``TEXT_WEIGHT`` trigrams' worth of evidence counts (trigrams are not independent);
* the declared markup language and the address suffix: how often each occurs with
  each language, over all rows;
* the host: a prior smoothed from the whole table to the domain and from the domain
  to the host. A row's own share is taken out of its host's counts.

The languages are all that are declared anywhere. The trigram model is fitted on a
bounded sample of their rows (``FIT_ROWS`` expected in all and ``LANGUAGE_ROWS`` more
of each language, chosen by hash); every count and prior comes from a grouped aggregate over all rows, so a host with a third of the rows costs no more
than its map-side sums. Only a small row for each document is kept; texts are not
shuffled.

Nulls and edges: a null or empty text, or one without three bytes between
separators, gives no text evidence and is rejected; a null declaration, suffix or
host gives none of its kind; ties go to the language first by code point; a table
without any declared language has no known language: ``identify`` accepts no row of
it and ``keep_accepted`` leaves it as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordkernel as wk
from tidemark.llm.common import cut

#: Rows that the text model is fitted on, as expected.
FIT_ROWS = 5000
#: Rows of each language, as expected, that the model is fitted on at least (all, if there are fewer).
LANGUAGE_ROWS = 50
#: Trigram cells of a language, and of all languages together: with very many languages each has fewer.
CELLS, ALL_CELLS = 1 << 15, 1 << 24
TEXT_WEIGHT, SMOOTHING, HOST_WEIGHT, DOMAIN_WEIGHT = 100.0, 0.5, 10.0, 50.0
MIN_CONFIDENCE = 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART = {"id": "long", "row": "long", "declared": "string", "suffix": "string", "domain": "string", "host": "string"}


def _cells_of(languages: int) -> int:
    """Cells of each language's model, a power of two."""
    return 1 << max(8, min(CELLS, ALL_CELLS // max(languages, 1)).bit_length() - 1)


def _trigrams(offsets: np.ndarray, data: np.ndarray, low: int, high: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each trigram of documents ``low`` to ``high`` that has no separator amid or two, and the count for each document."""
    base = int(offsets[low])
    x = _LOWER[data[base : int(offsets[high])]].astype(np.uint32)
    bounds = offsets[low : high + 1] - base
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(high - low, np.int64)
    word = wk._IS_WORD[x]
    x = np.where(word, x, 32)
    placed = (((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(33 - cells.bit_length())
    good = word[1:-1] & (word[:-2] | word[2:])
    # a trigram over the end of a document is no one's
    edge = bounds[1:-1]
    for k in (1, 2):
        at = edge - k
        good[at[(at >= 0) & (at < len(good))]] = False
    at = np.flatnonzero(good)
    return placed[at].astype(np.int64), np.diff(np.searchsorted(at, bounds))


def _counts(languages: list[str]):
    places = {v: k for k, v in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many_cells = _cells_of(len(languages))
        total = np.zeros(many_cells * len(languages), np.int64)
        for batch in batches:
            offsets, data = wk.text_buffers(batch.column("text"))
            own = np.array([places.get(v, -1) for v in batch.column("declared").to_pylist()])
            for a, b in wk.slices(offsets):
                cells, many = _trigrams(offsets, data, a, b, many_cells)
                label = np.repeat(own[a:b], many)
                total += np.bincount(cells[label >= 0] * len(languages) + label[label >= 0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["cell", "n"])

    return run


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each trigram cell in each of them, from a sample of ``id, declared, text``."""
    known = rows.where("declared is not null and text is not null")
    # one row for each language
    counts = {r[0]: r[1] for r in known.groupBy("declared").count().collect()}
    languages, n = sorted(counts, key=str.encode), sum(counts.values())
    cells = _cells_of(len(languages))
    table = np.full(cells * max(len(languages), 1), SMOOTHING)
    if languages:
        shares = [(v, int(min(1.0, fit_rows / n + LANGUAGE_ROWS / counts[v]) * (1 << 30))) for v in languages]
        drawn = rows.sparkSession.createDataFrame(shares, "declared string, share long")
        sample = known.join(F.broadcast(drawn), "declared").where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.col("share")).select("declared", "text")
        for cell, k in sample.mapInArrow(_counts(languages), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            table[cell] += k
    table = table.reshape(cells, -1)
    return languages, np.log(table / table.sum(axis=0)).astype(np.float32)


def _scores(table, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = table.value
        for batch in batches:
            offsets, data = wk.text_buffers(batch.column("text"))
            grams, out = [], []
            for a, b in wk.slices(offsets):
                cells, many = _trigrams(offsets, data, a, b, len(logs))
                own = np.zeros((b - a, size))
                some = np.flatnonzero(many)
                if len(some):
                    firsts = np.cumsum(many[some]) - many[some]
                    sums = np.add.reduceat(logs[cells], firsts, axis=0, dtype=np.float64)
                    own[some] = sums / many[some, None] * np.minimum(many[some], TEXT_WEIGHT)[:, None]
                    own[some] -= own[some].max(axis=1, keepdims=True)
                grams.append(many)
                out.append(own)
            if out:
                flat = np.concatenate(out)
                scores = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * size, pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PART), pa.array(np.concatenate(grams), pa.int64()), scores], names=[*_PART, "grams", "scores"])

    return run


def _sums(shares: DataFrame, keys: list[str], name: str, size: int) -> DataFrame:
    """For each key, the sum of the text's posterior shares, as an array by language."""
    sums = shares.groupBy(*keys).agg(*[F.sum(F.col("share")[k]).alias(f"s{k}") for k in range(size)])
    return sums.select(*keys, F.array(*[f"s{k}" for k in range(size)]).alias(name))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _let(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _softmax(a: Column) -> Column:
    shared = lambda e: _let(_total(e), lambda t: F.transform(e, lambda x: x / t))
    return _let(a, lambda v: _let(F.array_max(v), lambda m: _let(F.transform(v, lambda x: F.exp(x - m)), shared)))


def _evidence(shares: DataFrame, key: str, size: int) -> DataFrame:
    """``key, log_<key>``: log probability of each value of ``key`` given each language, smoothed."""
    sums = _sums(shares.where(F.col(key).isNotNull()), [key], "n", size)
    # one row: totals by language and the number of values
    whole = sums.agg(*[F.sum(F.col("n")[k]).alias(f"t{k}") for k in range(size)], F.count("*").alias("values")).first()
    logs = [F.log((F.col("n")[k] + SMOOTHING) / F.lit((whole[k] or 0.0) + SMOOTHING * max(whole["values"], 1))) for k in range(size)]
    return sums.select(F.col(key).alias(f"of_{key}"), F.array(*logs).alias(f"log_{key}"))


def identify(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id, row, declared, language, confidence, accepted`` from ``id, row, text, declared, suffix, domain, host``."""
    languages, logs = fit(rows, fit_rows)
    size = len(languages)
    if not size:
        return rows.select("id", "row", "declared", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    table = rows.sparkSession.sparkContext.broadcast(logs)
    schema = ", ".join(f"{k} {v}" for k, v in _PART.items()) + ", grams long, scores array<double>"
    scored = cut(rows.select(*_PART, "text").mapInArrow(_scores(table, size), schema))
    shares = scored.withColumn("share", F.when(F.col("grams") > 0, _softmax(F.col("scores"))).otherwise(F.array(*[F.lit(1.0 / size)] * size)))
    hosts = cut(_sums(shares, ["domain", "host"], "host_n", size))
    domains = hosts.groupBy("domain").agg(*[F.sum(F.col("host_n")[k]).alias(f"d{k}") for k in range(size)]).select(F.col("domain").alias("any_domain"), F.array(*[f"d{k}" for k in range(size)]).alias("domain_n"))
    whole = hosts.agg(*[F.sum(F.col("host_n")[k]) for k in range(size)]).first()
    everywhere = (np.array([x or 0.0 for x in whole]) + 1.0) / (sum(x or 0.0 for x in whole) + size)
    given = hosts.join(domains, F.col("domain").eqNullSafe(F.col("any_domain"))).select(F.col("domain").alias("of_domain"), F.col("host").alias("of_host"), "host_n", "domain_n")
    out = shares.join(given, F.col("domain").eqNullSafe(F.col("of_domain")) & F.col("host").eqNullSafe(F.col("of_host")))
    for key in ("declared", "suffix"):
        own = _evidence(shares, key, size)
        out = out.join(own, F.col(key) == F.col(f"of_{key}"), "left")
    # without its own share
    base = F.array(*[F.lit(float(x)) for x in everywhere])
    less = lambda n: F.zip_with(n, "share", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    out = out.withColumn("domain_n", less("domain_n")).withColumn("host_n", less("host_n"))
    smooth = lambda n, prior, weight: _let(_total(F.col(n)), lambda t: F.zip_with(n, prior, lambda a, b: (a + b * weight) / (t + weight)))
    out = out.withColumn("prior", smooth("domain_n", base, DOMAIN_WEIGHT))
    out = out.withColumn("prior", F.when(F.col("host").isNull(), base).otherwise(smooth("host_n", F.col("prior"), HOST_WEIGHT)))
    zero = F.array(*[F.lit(0.0)] * size)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = add("scores", F.transform("prior", lambda x: F.log(x)))
    for key in ("declared", "suffix"):
        fused = add(fused, F.coalesce(f"log_{key}", zero))
    out = out.withColumn("fused", fused).withColumn("posterior", _softmax(F.col("fused")))
    best = F.array_max("posterior")
    language = F.element_at(F.array(*[F.lit(v) for v in languages]), F.array_position("posterior", best).cast("int"))
    return out.select("id", "row", "declared", language.alias("language"), best.alias("confidence"), ((F.col("grams") > 0) & (best >= MIN_CONFIDENCE)).alias("accepted"))


def _nothing() -> Column:
    return F.lit(None).cast("string")


def from_documents(docs: DataFrame, *others: str) -> DataFrame:
    """Rows for ``identify``: the declared language is ``lang`` and the host is ``source``; there is no domain over it."""
    source = F.col("source").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("declared"), _nothing().alias("suffix"), _nothing().alias("domain"), source.alias("host"), *others)
    return rows.withColumn("row", F.xxhash64("id", "text", "declared", "host"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Rows for ``identify``: declaration from the markup, suffix, domain and host from the address, text without tags."""
    html, url = F.col("html").cast("string"), F.col("url").cast("string")
    declared = F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>|&[#\w]+;", " ")
    rows = pages.select(F.col("page_id").cast("long").alias("id"), text.alias("text"), F.lower(F.nullif(declared, F.lit(""))).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    return rows.withColumn("row", F.xxhash64("id", "text", "declared", "host"))


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, declared, language, confidence, accepted`` of every document."""
    return identify(from_documents(docs)).select(F.col("id").alias("doc_id"), "declared", "language", F.round("confidence", 6).alias("confidence"), "accepted")


def keep_accepted(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is rejected.

    Judged by row: rows that share an id go each by its own text. If no language is
    declared at all, none is known and nothing goes. Columns stay as they are,
    whatever their names.
    """
    if docs.where("lang is not null").isEmpty():
        return docs
    found = identify(from_documents(docs))
    gone = found.where("not accepted").select("id", "row").distinct()
    own = from_documents(docs.select("doc_id", "text", "lang", "source", F.struct("*").alias("held")), "held")
    same = own["id"].eqNullSafe(gone["id"]) & (own["row"] == gone["row"])
    return own.join(gone, same, "left_anti").select("held.*")
