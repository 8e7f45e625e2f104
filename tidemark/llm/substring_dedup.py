"""Substring dedup by difference-cover anchors.

A window is ``WINDOW`` consecutive words. A word goes if a window over it also
starts in a document with a smaller id. Hashing every window and shuffling it
would move several times the corpus; instead only runs of ``ANCHOR`` words at the
word positions of a difference cover are hashed. Positions ``COVER`` modulo
``PERIOD`` have this property: for any two positions p and q there is a shift
below ``PERIOD`` that moves both onto the cover, so two equal windows always share
an anchor that lies in both. Only windows around shared anchors are hashed whole.

1. anchors: tasks send each anchor once for each chunk of documents; buckets of
   hashes answer which anchors occur in more than one document;
2. extension: in documents with shared anchors, all windows that contain one are
   hashed whole (96 bits) and dealt out the same way; buckets answer which windows
   start in a smaller document;
3. removal: answers meet the texts by document and the covered words go.

A chunk sends an anchor or window once however many of its documents hold it, as
the smallest document stands for the rest, so no bucket grows with a frequent
passage. Texts are dealt out by document once (both rounds read one exchange).

Nulls: a null text has no words; a row with a null id keeps its words and is no
one's smaller document. Rows that share an id are not smaller than each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordkernel as wk
from tidemark.llm.common import shuffle_partitions

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of text whose anchors or windows make one chunk.
CHUNK_BYTES = 6 << 20
#: Bytes of text for each deal of documents.
DEAL_BYTES = 4 << 20
#: Bytes of text for each bucket of hashes.
BUCKET_BYTES = 8 << 20

_PARTS = "bucket int, ids binary, high binary, low binary, flags binary"
_PARTS_ARROW = pa.schema([("bucket", pa.int32()), *((x, pa.binary()) for x in ("ids", "high", "low", "flags"))])
_ANSWERS = "deal int, ids binary, hashes binary"
_ANSWERS_ARROW = pa.schema([("deal", pa.int32()), ("ids", pa.binary()), ("hashes", pa.binary())])
_NO_ID = -(1 << 63)
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchor_hashes(w: wk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word index of each anchor in the slice, and its hash."""
    hashes = wk.window_hashes(wk.word_hashes(w), ANCHOR)
    left = np.repeat(w.counts, w.counts) - w.index
    at = np.flatnonzero((left[: len(hashes)] >= ANCHOR) & _ON_COVER[w.index[: len(hashes)] % PERIOD])
    # anchors only propose windows, so their upper 48 bits do; what is not sent need not be stored
    return at, hashes[at] & ~np.uint64(0xFFFF)


class _Chunk:
    """Entries (id, high, low) of a chunk of documents, sent as one row for each bucket."""

    def __init__(self, buckets: int, width: int) -> None:
        """width: 6 (the lower 16 bits of ``high`` and all of ``low`` are zero) or 8."""
        self.buckets, self.width, self.held, self.size = buckets, width, [], 0

    def add(self, ids: np.ndarray, high: np.ndarray, low: np.ndarray, size: int) -> None:
        self.held.append((ids, high, low))
        self.size += size

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        ids, high, low = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        if not len(ids):
            return
        order = np.lexsort((ids, low, high))
        ids, high, low = ids[order], high[order], low[order]
        first = np.ones(len(ids), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        group = np.cumsum(first) - 1
        least = ids[first]
        # 0: the chunk's smallest document, the only one that needs an answer; 1: the same, and larger ones of the chunk hold it too; 2: a larger one, answered already
        flags = np.where(ids > least[group], 2, 0).astype(np.uint8)
        keep = first.copy()
        keep[1:] |= ids[1:] != ids[:-1]
        many = np.zeros(len(least), bool)
        many[group[flags == 2]] = True
        flags[first & many[group]] = 1
        ids, high, low, flags = ids[keep], high[keep], low[keep], flags[keep]
        spread = np.where(flags == 2, wk.mix(ids.astype(np.uint64)), high)
        bucket = (spread >> np.uint64(48)).astype(np.int64) % self.buckets
        order = np.argsort(bucket, kind="stable")
        ids, high, low, flags, bucket = ids[order], high[order], low[order], flags[order], bucket[order]
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        out = {k: [] for k in ("ids", "high", "low", "flags")}
        for a, b in zip(edges, np.r_[edges[1:], len(bucket)]):
            own, at = np.unique(ids[a:b], return_inverse=True)
            out["ids"].append(np.r_[np.int64(len(own)), own].tobytes() + at.astype(np.uint16 if len(own) < 65536 else np.uint32).tobytes())
            out["high"].append(high[a:b].view(np.uint16).reshape(-1, 4)[:, 4 - self.width // 2 :].tobytes())
            out["low"].append(low[a:b].tobytes() if self.width == 8 else b"")
            out["flags"].append(np.packbits(np.stack([flags[a:b] & 1, flags[a:b] >> 1])).tobytes())
        yield pa.record_batch([pa.array(bucket[edges], pa.int32()), *(pa.array(x, pa.binary()) for x in out.values())], schema=_PARTS_ARROW)


def _unpack(part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = np.frombuffer(part["low"], np.uint32)
    if len(low):
        high = np.frombuffer(part["high"], np.uint64)
    else:
        high = np.pad(np.frombuffer(part["high"], np.uint16).reshape(-1, 3), ((0, 0), (1, 0))).view(np.uint64).ravel()
    own = int(np.frombuffer(part["ids"], np.int64, 1)[0])
    ids = np.frombuffer(part["ids"], np.int64, own, 8)
    at = np.frombuffer(part["ids"], np.uint16 if own < 65536 else np.uint32, len(high), 8 + 8 * own)
    flags = np.unpackbits(np.frombuffer(part["flags"], np.uint8), count=2 * len(high)).reshape(2, -1)
    return ids[at], high, low if len(low) else np.zeros(len(high), np.uint32), flags[0] + 2 * flags[1]


def _answer(parts: pa.Table, earlier_only: bool, deals: int) -> pa.Table:
    """Of a bucket: documents and their hashes that another document has too (``earlier_only``: a smaller one), by deal of documents."""
    ids, high, low, flags = (np.concatenate(x) for x in zip(*map(_unpack, parts.to_pylist())))
    ask = flags < 2
    done_ids, done_high = ids[~ask], high[~ask]
    ids, high, low, flags = ids[ask], high[ask], low[ask], flags[ask]
    order = np.lexsort((ids, low, high))
    ids, high, low, flags = ids[order], high[order], low[order], flags[order]
    if len(ids):
        first = np.ones(len(ids), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        group = np.cumsum(first) - 1
        later = ids > ids[first][group]
        if not earlier_only:
            later |= np.logical_or.reduceat(later | (flags == 1), np.flatnonzero(first))[group]
        ids, high = ids[later], high[later]
    ids, high = np.concatenate([ids, done_ids]), np.concatenate([high, done_high])
    deal = wk.spark_xxhash64(ids) % deals
    order = np.lexsort((ids, deal))
    ids, high, deal = ids[order], high[order], deal[order]
    edges = np.flatnonzero(np.diff(deal, prepend=-1))
    ends = np.r_[edges[1:], len(ids)][: len(edges)]
    cuts = list(zip(edges.tolist(), ends.tolist()))
    return pa.table([pa.array(deal[edges], pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (ids, high))], schema=_ANSWERS_ARROW)


class _Answers:
    """Answers to the documents of a deal."""

    def __init__(self, parts: pa.Table) -> None:
        ids, self.hashes = (np.frombuffer(b"".join(parts.column(c).to_pylist()), t) for c, t in (("ids", np.int64), ("hashes", np.uint64)))
        order = np.argsort(ids, kind="stable")
        self.ids, self.hashes = ids[order], self.hashes[order]

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a run of documents: the index of the document of each answer, and its hash."""
        low, high = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, "right")
        many = high - low
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        return np.repeat(np.arange(len(ids)), many), self.hashes[at]


def _is_told(doc: np.ndarray, hashes: np.ndarray, told_doc: np.ndarray, told: np.ndarray) -> np.ndarray:
    if not len(told):
        return np.zeros(len(hashes), bool)
    # one key of document and hash; a wrong match needs equal 64-bit keys within a slice
    salt = np.uint64(0x9E3779B97F4A7C15)
    return np.isin(hashes + doc.astype(np.uint64) * salt, told + told_doc.astype(np.uint64) * salt)


def _windows(w: wk.Words, which: int) -> np.ndarray:
    return wk.window_hashes(wk.word_hashes(w, which), WINDOW, which)


def _sends_anchors(buckets: int, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _Chunk(buckets, 6)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            offsets, data = wk.text_buffers(batch.column("text"))
            for a, b in wk.slices(offsets):
                w = wk.words(offsets, data, a, b)
                at, hashes = _anchor_hashes(w)
                chunk.add(ids[a:b][w.doc[at]], hashes, np.zeros(len(at), np.uint32), int(offsets[b] - offsets[a]))
                if chunk.size >= chunk_bytes:
                    yield from chunk.rows()
        yield from chunk.rows()

    return run


def _sends_windows(buckets: int):
    def run(docs: pa.Table, parts: pa.Table) -> pa.Table:
        chunk, answers = _Chunk(buckets, 8), _Answers(parts)
        docs = docs.filter(pc.is_in(docs.column("doc_id"), pa.array(np.unique(answers.ids), pa.int64())))
        ids = docs.column("doc_id").to_numpy()
        offsets, data = wk.text_buffers(docs.column("text"))
        for a, b in wk.slices(offsets):
            w = wk.words(offsets, data, a, b)
            high, doc, index = _windows(w, 0), w.doc, w.index
            at, hashes = _anchor_hashes(w)
            shared = np.zeros(len(doc) + 1, np.int64)
            shared[at[_is_told(doc[at], hashes, *answers.of(ids[a:b]))] + 1] = 1
            np.cumsum(shared, out=shared)
            n = len(high)
            inside = (np.repeat(w.counts, w.counts) - index)[:n] >= WINDOW
            take = np.flatnonzero(inside & (shared[PERIOD : PERIOD + n] > shared[:n]))
            chunk.add(ids[a:b][doc[take]], high[take], (_windows(w, 1)[take] >> np.uint64(32)).astype(np.uint32), int(offsets[b] - offsets[a]))
        return pa.Table.from_batches(list(chunk.rows()), schema=_PARTS_ARROW)

    return run


def removed_words(w: wk.Words, told_doc: np.ndarray, told: np.ndarray) -> np.ndarray:
    """Which words of the slice lie in a window whose hash was told of its document."""
    gone = np.zeros(len(w.starts) + 1, np.int64)
    if len(told):
        high = _windows(w, 0)
        n, doc = len(high), w.doc
        inside = (np.repeat(w.counts, w.counts) - w.index)[:n] >= WINDOW
        hit = np.flatnonzero(inside & _is_told(doc[:n], high, told_doc, told))
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + WINDOW, -1)
    return np.cumsum(gone)[:-1] > 0


_KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _keeps(docs: pa.Table, parts: pa.Table) -> pa.Table:
    answers, out = _Answers(parts), []
    # a null id is no one's: no answer has the least long, which it stands for
    ids = docs.column("doc_id").combine_chunks()
    asked = ids.fill_null(_NO_ID).to_numpy()
    offsets, data = wk.text_buffers(docs.column("text"))
    for a, b in wk.slices(offsets):
        w = wk.words(offsets, data, a, b)
        gone = removed_words(w, *answers.of(asked[a:b]))
        bytes_, kept = w.data.tobytes(), []
        for first, count in zip(w.firsts.tolist(), w.counts.tolist()):
            stay = ~gone[first : first + count]
            kept.append(b" ".join([bytes_[x:y] for x, y in zip(w.starts[first : first + count][stay].tolist(), w.ends[first : first + count][stay].tolist())]).decode())
        sums = np.r_[0, np.cumsum(gone)]
        out.append(pa.record_batch([ids.slice(a, b - a), pa.array(w.counts, pa.int64()), pa.array(sums[w.firsts + w.counts] - sums[w.firsts], pa.int64()), pa.array(kept, pa.string())], schema=_KEPT_ARROW))
    return pa.Table.from_batches(out, schema=_KEPT_ARROW)


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text`` for every row of ``docs``.

    ``kept_text`` is the words that stay, joined by one space. Other columns of
    ``docs`` are not read, so their names do not matter.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = shuffle_partitions(spark)
    buckets = max(n, -(-int(size) // BUCKET_BYTES))
    deals = max(n, -(-int(size) // DEAL_BYTES))
    known = docs.where("doc_id is not null")

    def answers(sent: DataFrame, earlier_only: bool) -> DataFrame:
        told = sent.groupBy("bucket").applyInArrow(lambda parts: _answer(parts, earlier_only, deals), _ANSWERS)
        return told.groupBy("deal")

    # both rounds read one exchange of the texts
    # rows with a null id ask for nothing and may lie anywhere
    dealt = docs.withColumn("deal", F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("text")), F.lit(deals)).cast("int")).groupBy("deal")
    anchors = answers(known.mapInArrow(_sends_anchors(buckets, chunk_bytes), _PARTS), earlier_only=False)
    windows = answers(dealt.cogroup(anchors).applyInArrow(_sends_windows(buckets), _PARTS), earlier_only=True)
    return dealt.cogroup(windows).applyInArrow(_keeps, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every document."""
    return drop_repeated_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """The same from the definition, for tests on small tables."""
    import re

    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, w in cut:
        for p in range(len(w) - WINDOW + 1):
            if i is not None:
                key = tuple(w[p : p + WINDOW])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for p in range(len(w) - WINDOW + 1):
            if i is not None and least[tuple(w[p : p + WINDOW])] < i:
                gone.update(range(p, p + WINDOW))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
