"""Byte-level BPE encoding and decoding over a fixed vocabulary of ranks.

Two tiers: a minimal perfect hash over the vocabulary resolves each pre-token that
is itself a token; the rest is merged by a heap over linked bytes. The hash has one
slot a token: keys fall into buckets, and each bucket gets the first displacement
that puts all its keys on free slots, large buckets first. A looked-up slot holds
the token's bytes, which are compared, so a foreign pre-token is never mistaken.

The vocabulary file's path is a parameter; its tables (some MB, fixed by the
vocabulary and not by the data) are broadcast. What a task remembers of pre-tokens
is bounded. Texts are not shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import wordkernel as wk

#: Pre-tokens whose ids a task remembers.
REMEMBERED = 600_000
_KEYS_PER_BUCKET = 4
_SALT = np.uint64(0xA24BAED4963EE407)


def _hashes(keys: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(keys), np.uint8)
    ends = np.cumsum([len(k) for k in keys], dtype=np.int64)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    return wk.word_hashes(wk.Words(data, 0, starts, ends, np.array([len(keys)]), np.array([0])))


@dataclass
class PerfectHash:
    """Minimal perfect hash of distinct byte strings: ``shift[bucket]`` moves a bucket's keys to their slots."""

    size: int
    shift: np.ndarray

    @classmethod
    def build(cls, keys: list[bytes]) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and the slot of each key."""
        n = len(keys)
        out = cls(n, np.zeros(max(1, n // _KEYS_PER_BUCKET), np.int64))
        h = _hashes(keys)
        if len(np.unique(h)) < n:
            raise ValueError("two keys have one 64-bit hash or are equal")
        bucket = (h % np.uint64(len(out.shift))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(len(out.shift) + 1))
        free = np.ones(n, bool)
        tries = np.arange(64)
        for b in np.argsort(-np.diff(edges), kind="stable"):
            own = h[order[edges[b] : edges[b + 1]]]
            if len(own) < 2:
                break
            d = 0
            while True:
                at = out._place(own[:, None], (d + tries)[None, :])
                good = free[at].all(axis=0)
                good[good] = (np.diff(np.sort(at[:, good], axis=0), axis=0) > 0).all(axis=0)
                if good.any():
                    d += int(good.argmax())
                    break
                d += len(tries)
            free[out._place(own, np.array(d))] = False
            out.shift[b] = d
        # a bucket of one key names its slot
        lone = np.flatnonzero(np.diff(edges) == 1)
        out.shift[lone] = -1 - np.flatnonzero(free)
        return out, out.slots(h)

    def _place(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (wk.mix(h ^ (np.atleast_1d(shift).astype(np.uint64) + np.uint64(1)) * _SALT) % np.uint64(self.size)).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        shift = self.shift[(h % np.uint64(len(self.shift))).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._place(h, shift))


class Vocabulary:
    """Ranks of tokens (id = rank) and the pattern that cuts text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = pattern
        tokens = list(ranks)
        self.hash, at = PerfectHash.build(tokens)
        self.at_slot: list[bytes] = [b""] * len(tokens)
        for token, slot in zip(tokens, at.tolist()):
            self.at_slot[slot] = token
        self.id_at_slot = np.array([ranks[t] for t in self.at_slot], np.int32)
        by_id = sorted(ranks, key=ranks.get)
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[[ranks[t] for t in by_id]] = [len(t) for t in by_id]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.id_of_byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {ranks[t[:k]] << 32 | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self._remembered: dict[str, bytes] = {}
        self._cut = None

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """Of a file with one ``base64-token rank`` a line."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_remembered": {}, "_cut": None}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece by repeated merges of the adjacent pair of least rank, leftmost first."""
        n, pairs = len(piece), self.pairs
        ids = [self.id_of_byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # the rank at which k merges with what follows it; an entry of the heap that differs from it is stale
        live = [pairs.get(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]
        live.append(-1)
        heap = [r << 32 | k for k, r in enumerate(live) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            k, r = top & 0xFFFFFFFF, top >> 32
            if live[k] != r:
                continue
            j = after[k]
            after[k] = m = after[j]
            ids[k], ids[j], live[j], live[k] = r, -1, -1, -1
            if m < n:
                before[m] = k
                live[k] = x = pairs.get(r << 32 | ids[m], -1)
                if x >= 0:
                    push(heap, x << 32 | k)
            if (i := before[k]) >= 0:
                live[i] = x = pairs.get(ids[i] << 32 | r, -1)
                if x >= 0:
                    push(heap, x << 32 | i)
        return [i for i in ids if i >= 0]

    def _learn(self, new: list[str]) -> None:
        keys = [p.encode() for p in new]
        slots = self.hash.slots(_hashes(keys)).tolist()
        for p, key, slot in zip(new, keys, slots):
            if self.at_slot[slot] == key:
                self._remembered[p] = self.id_at_slot[slot].tobytes()
            else:
                self._remembered[p] = np.array(self.merge(key), np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; no text is read in part, and null is the empty text."""
        if self._cut is None:
            self._cut = regex.compile(self.pattern).findall
        pieces = [self._cut(t) if t else [] for t in texts]
        seen: set[str] = set()
        for p in pieces:
            seen.update(p)
        if len(self._remembered) + len(seen) > REMEMBERED:
            self._remembered.clear()
        new = [p for p in seen if p not in self._remembered]
        if new:
            self._learn(new)
        get = self._remembered.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), np.int32) for p in pieces]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)]


def vocabulary(spark: SparkSession, path: str, pattern: str):
    """The vocabulary of a rank file, broadcast (its size is the file's, whatever the data)."""
    return spark.sparkContext.broadcast(Vocabulary.read(path, pattern))


def encode(df: DataFrame, vocab, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with ``ids_col`` (array of int): the ids of the whole text; null counts as empty.

    A column of that name is replaced; all other columns stay.
    """
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    df = df.drop(ids_col)
    schema = StructType(list(df.schema.fields)).add(ids_col, ArrayType(IntegerType(), False), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in batches:
            offsets, _ = wk.text_buffers(batch.column(text_col))
            for a, b in wk.slices(offsets):
                part = batch.slice(a, b - a)
                got = v.encode(part.column(text_col).to_pylist())
                flat = np.concatenate(got)
                ends = np.cumsum([0, *map(len, got)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, ids_col])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocab, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with ``bytes_col`` (binary) in place of ``ids_col``; null ids give no bytes."""
    from pyspark.sql.types import BinaryType, StructType

    keep = [c for c in df.columns if c not in (ids_col, bytes_col)]
    schema = StructType([df.schema[c] for c in keep]).add(bytes_col, BinaryType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        for batch in batches:
            column = batch.column(ids_col)
            sizes = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            for a, b in wk.slices(np.r_[0, ends] * 4):
                ids = flat[starts[a] : ends[b - 1]]
                cuts = np.r_[0, np.cumsum(v.lengths[ids])][np.r_[starts[a:b], ends[b - 1]] - starts[a]]
                out = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(v.decode(ids))])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), out], names=[*keep, bytes_col])

    return df.select(*keep, ids_col).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text."""
    vocab = vocabulary(docs.sparkSession, path, pattern)
    ids = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), vocab)
    told = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), "ids")
    return decode(told, vocab).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
