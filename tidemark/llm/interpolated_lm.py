"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of three orders,

    P(w | u v) = l3 c(uvw)/c(uv) + l2 c(vw)/c(v) + l1 (c(w) + 0.1)/(N + 0.1 (V + 1)),

with weights for each bucket of the context's frequency. Weights are learned by
expectation-maximisation on a tenth of the training documents whose counts are deleted
from the estimates while it runs; then all training documents count.

1. packing: documents become chunks of word hashes and codes, a few MB of text each;
2. counting: a chunk sends each of its n-grams once, with the times it stands in
   training documents, to the bucket of its hash; buckets add up and answer every
   chunk with the corpus count of each n-gram it asked for. A frequent n-gram is one
   entry for each chunk, so no bucket grows with it;
3. weights: chunks of the deleted tenth meet their answers; every token is a row of
   counts, and the rounds of expectation-maximisation are grouped sums over them;
4. scoring: all chunks meet their answers and sum the logarithms for each document.

Counts cover all documents and nothing is pruned. Words are told apart by 64 bits of
hash, n-grams of two and three words by 56.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordkernel as wk
from tidemark.llm.common import shuffle_partitions, stored

#: Added to every count of a single token, as in the base score.
ADDED = 0.1
#: Documents whose CRC-32 of the id leaves 0 are not learned from; 1: their counts are deleted while weights are learned.
FOLDS, HELD_OUT, DELETED = 10, 0, 1
ORDERS = 3
#: Bytes of text in a chunk, and for each bucket of n-grams.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
#: Rounds of expectation-maximisation at most, and the change of a weight that ends them.
MOST_ROUNDS, LEAST_CHANGE = 20, 1e-3
#: Frequency buckets of contexts: 1 + log2 for those of two words, and from here on for those of one word, where two were not seen.
ONE_WORD, BUCKETS = 48, 96

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_CHUNKS = "chunk long, deleted boolean, docs long, tokens long, ids binary, flags binary, counts binary, words binary, codes binary"
_CHUNKS_ARROW = pa.schema([("chunk", pa.int64()), ("deleted", pa.bool_()), ("docs", pa.int64()), ("tokens", pa.int64()), *((x, pa.binary()) for x in ("ids", "flags", "counts", "words", "codes"))])
_ASKS = "bucket int, chunk long, deleted boolean, size int, keys binary, counts binary"
_ASKS_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("deleted", pa.bool_()), ("size", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWERS = "chunk long, deleted boolean, bucket int, size int, counts binary, rest binary, known long, known_rest long"
_ANSWERS_ARROW = pa.schema([("chunk", pa.int64()), ("deleted", pa.bool_()), ("bucket", pa.int32()), ("size", pa.int32()), ("counts", pa.binary()), ("rest", pa.binary()), ("known", pa.int64()), ("known_rest", pa.int64())])
_COUNTS = "bucket int, c3 long, c2 long, c1 long, context2 long, context1 long"
_COUNTS_ARROW = pa.schema([("bucket", pa.int32()), *((x, pa.int64()) for x in ("c3", "c2", "c1", "context2", "context1"))])
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _pack(x: np.ndarray) -> bytes:
    """An array as compressed byte planes, so that small numbers take little."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()) if len(x) else b""


def _unpack(packed: bytes, kind: type) -> np.ndarray:
    if not packed:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class _Packer:
    """Documents on their way to a chunk: ids, flags, token counts and word hashes."""

    def __init__(self, deleted: bool) -> None:
        self.deleted, self.held, self.size = deleted, [], 0

    def add(self, ids: np.ndarray, flags: np.ndarray, counts: np.ndarray, hashes: np.ndarray, size: int) -> None:
        self.held.append((ids, flags, counts, hashes))
        self.size += size

    def rows(self, chunk: int) -> pa.RecordBatch:
        ids, flags, counts, hashes = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        words, codes, times = np.unique(hashes, return_inverse=True, return_counts=True)
        # frequent words get small codes
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        trains = (flags & 1) > 0
        row = [chunk, self.deleted, int(trains.sum()), int(counts[trains].sum() + trains.sum()), ids.tobytes(), flags.tobytes(), _pack(counts.astype(np.uint32)), words[order].tobytes(), _pack(rank[codes])]
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, _CHUNKS_ARROW.types)], schema=_CHUNKS_ARROW)


def _packs(chunk_bytes: int):
    """Chunks of documents; those of the deleted fold make chunks of their own. Flags: 1 trains, 2 the id is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, packers = TaskContext.get().partitionId() << 32, [_Packer(False), _Packer(True)]
        for batch in batches:
            folds = batch.column("fold").to_numpy()
            ids = batch.column("doc_id")
            flags = (folds != HELD_OUT).astype(np.uint8) + 2 * np.asarray(ids.is_null()).astype(np.uint8)
            ids = ids.fill_null(0).to_numpy()
            for deleted, packer in enumerate(packers):
                rows = np.flatnonzero((folds == DELETED) == bool(deleted))
                offsets, data = wk.text_buffers(batch.column("text").take(pa.array(rows)))
                for a, b in wk.slices(offsets):
                    w = wk.words(offsets, data, a, b)
                    w.data = _LOWER[w.data]
                    packer.add(ids[rows[a:b]], flags[rows[a:b]], w.counts, wk.word_hashes(w), int(offsets[b] - offsets[a]))
                    if packer.size >= chunk_bytes:
                        yield packer.rows(chunk)
                        chunk += 1
        for packer in packers:
            if packer.held:
                yield packer.rows(chunk)
                chunk += 1

    return run


class _Tokens:
    """The tokens of a chunk, an end after each document's words, with the keys of the n-grams that close with them."""

    def __init__(self, row: dict) -> None:
        self.ids, self.flags = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["flags"], np.uint8)
        self.counts = _unpack(row["counts"], np.uint32).astype(np.int64) + 1
        self.ends = np.cumsum(self.counts)
        words = np.frombuffer(row["words"], np.uint64)
        one = np.full(int(self.ends[-1]), _END, np.uint64)
        inside = np.ones(len(one), bool)
        inside[self.ends - 1] = False
        one[inside] = words[_unpack(row["codes"], np.uint32)]
        self.firsts = self.ends - self.counts
        before = np.r_[_START, one[:-1]]
        before[self.firsts] = _START
        two = wk.mix(one * _M2 + wk.mix(before ^ _M3))
        context = np.r_[_START, two[:-1]]
        context[self.firsts] = _START
        three = wk.mix(one * _M3 + wk.mix(context ^ _M2))
        self.keys = [one, two >> np.uint64(8) << np.uint64(8), three >> np.uint64(8) << np.uint64(8)]

    @property
    def trains(self) -> np.ndarray:
        return np.repeat((self.flags & 1) > 0, self.counts)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _asks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = _Tokens(row)
                trains = tokens.trains
                for size, keys in enumerate(tokens.keys, 1):
                    keys, at = np.unique(keys, return_inverse=True)
                    times = np.bincount(at, trains, len(keys)).astype(np.uint32)
                    edges = np.searchsorted(_bucket(keys, buckets), np.arange(buckets + 1))
                    used = np.flatnonzero(np.diff(edges))
                    cuts = list(zip(edges[used].tolist(), edges[used + 1].tolist()))
                    steps = [np.diff(keys[a:b], prepend=np.uint64(0)) for a, b in cuts]
                    if size > 1:
                        steps = [x >> np.uint64(8) for x in steps]
                    packed = [pa.array([_pack(x) for x in part], pa.binary()) for part in (steps, [times[a:b] for a, b in cuts])]
                    n = len(used)
                    yield pa.record_batch([pa.array(used, pa.int32()), pa.array([row["chunk"]] * n, pa.int64()), pa.array([row["deleted"]] * n, pa.bool_()), pa.array([size] * n, pa.int32()), *packed], schema=_ASKS_ARROW)

    return run


def _answers(parts: pa.Table) -> pa.Table:
    """Of a bucket: for each chunk and order the corpus count of every n-gram it asked for, in its order; for deleted chunks also the count without them."""
    out: dict[str, list] = {name: [] for name in _ANSWERS_ARROW.names}
    for size in range(1, ORDERS + 1):
        rows = parts.filter(pc.equal(parts.column("size"), size)).to_pylist()
        if not rows:
            continue
        keys = [np.cumsum(_unpack(r["keys"], np.uint64)) for r in rows]
        times = [_unpack(r["counts"], np.uint32) for r in rows]
        ends = np.cumsum([len(k) for k in keys])
        deleted = np.repeat([r["deleted"] for r in rows], [len(k) for k in keys])
        own = np.concatenate(times).astype(np.int64)
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        whole = np.bincount(at, own, len(found)).astype(np.int64)
        rest = whole - np.bincount(at, own * deleted, len(found)).astype(np.int64)
        for row, a, b in zip(rows, np.r_[0, ends[:-1]].tolist(), ends.tolist()):
            values = (row["chunk"], row["deleted"], row["bucket"], size, _pack(whole[at[a:b]]), _pack(rest[at[a:b]]) if row["deleted"] else b"", 0, 0)
            for column, value in zip(out.values(), values):
                column.append(value)
        if size == 1:
            for column, value in zip(out.values(), (None, None, None, 1, b"", b"", int((whole > 0).sum()), int((rest > 0).sum()))):
                column.append(value)
    return pa.table(out, schema=_ANSWERS_ARROW)


def _counts(tokens: _Tokens, parts: pa.Table, column: str) -> list[np.ndarray]:
    """The corpus count of the n-gram of each order at every token."""
    out, rows = [], parts.sort_by([("size", "ascending"), ("bucket", "ascending")]).to_pylist()
    for size in range(1, ORDERS + 1):
        told = np.concatenate([np.zeros(0, np.int64), *[_unpack(r[column], np.int64) for r in rows if r["size"] == size]])
        # keys are not needed again
        out.append(told[np.unique(tokens.keys.pop(0), return_inverse=True)[1]])
    return out


def _contexts(tokens: _Tokens, counts: list[np.ndarray], docs: int) -> list[np.ndarray]:
    """How often the last word, and the last two, were seen with a token after them; before a text's first word that is the number of texts."""
    out = []
    for c in counts[:2]:
        before = np.r_[np.int64(docs), c[:-1]]
        before[tokens.firsts] = docs
        out.append(before)
    return out


def _frequency(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The frequency bucket of a context."""
    level = np.frexp(np.where(two > 0, two, one).astype(np.float64))[1]
    return np.where(two > 0, level, ONE_WORD + level)


def _token_counts(docs: int):
    def run(chunks: pa.Table, parts: pa.Table) -> pa.Table:
        out = []
        for row in chunks.to_pylist():
            tokens = _Tokens(row)
            c1, c2, c3 = counts = _counts(tokens, parts, "rest")
            one, two = _contexts(tokens, counts, docs)
            out.append(pa.table([pa.array(x, t) for x, t in zip((_frequency(one, two), c3, c2, c1, two, one), _COUNTS_ARROW.types)], schema=_COUNTS_ARROW))
        return pa.concat_tables(out) if out else _COUNTS_ARROW.empty_table()

    return run


def _scores(docs: int, total: int, words: int, weights: np.ndarray):
    def run(chunks: pa.Table, parts: pa.Table) -> pa.Table:
        out = []
        for row in chunks.to_pylist():
            tokens = _Tokens(row)
            c1, c2, c3 = counts = _counts(tokens, parts, "counts")
            one, two = _contexts(tokens, counts, docs)
            base = (c1 + ADDED) / (total + ADDED * (words + 1))
            at = _frequency(one, two)
            mixed = weights[at, 2] * base
            mixed += weights[at, 1] * (c2 / np.maximum(one, 1))
            mixed += weights[at, 0] * (c3 / np.maximum(two, 1))
            sums = [np.add.reduceat(x, tokens.firsts) for x in ((c1 > 0).astype(np.int64), np.log10(base), np.log10(mixed))]
            ids = pa.array(tokens.ids, pa.int64(), mask=(tokens.flags & 2) > 0)
            out.append(pa.table([ids, pa.array((tokens.flags & 1) == 0), pa.array(tokens.counts), *map(pa.array, sums)], schema=_SCORES_ARROW))
        return pa.concat_tables(out) if out else _SCORES_ARROW.empty_table()

    return run


def filled(learned: dict[int, tuple[float, float, float]]) -> np.ndarray:
    """Weights of every frequency bucket; one that held no token takes those of the nearest rarer one, or of the next more frequent.

    A context of one word only has no weight for three, an unseen word none for two.
    """
    out = np.zeros((BUCKETS, 3))
    for kind, plain in ((range(1, ONE_WORD), (0.4, 0.3, 0.3)), (range(ONE_WORD + 1, BUCKETS), (0.0, 0.5, 0.5))):
        at = [b for b in kind if b in learned]
        for b in kind:
            out[b] = learned[max((x for x in at if x <= b), default=at[0])] if at else plain
    out[ONE_WORD] = (0.0, 0.0, 1.0)
    return out


def learn(counts: DataFrame, total: int, words: int) -> dict[int, tuple[float, float, float]]:
    """Weights of each frequency bucket from the tokens of the deleted fold, by expectation-maximisation; every round is one grouped sum."""
    base = F.lit(float(total + ADDED * (words + 1)))
    tokens = counts.select("bucket", (F.col("c3") / F.greatest("context2", F.lit(1))).alias("p3"), (F.col("c2") / F.greatest("context1", F.lit(1))).alias("p2"), ((F.col("c1") + ADDED) / base).alias("p1"))
    weights: dict[int, tuple[float, ...]] = {}
    for _ in range(MOST_ROUNDS):
        at = [weights.get(b, (1 / 3, 1 / 3, 1 / 3)) for b in range(BUCKETS)]
        parts = [F.element_at(F.array(*[F.lit(float(w[k])) for w in at]), F.col("bucket") + 1) * F.col(f"p{3 - k}") for k in range(3)]
        shares = tokens.select("bucket", *[x.alias(f"x{k}") for k, x in enumerate(parts)]).withColumn("all", F.col("x0") + F.col("x1") + F.col("x2"))
        found = shares.groupBy("bucket").agg(*[F.sum(F.col(f"x{k}") / F.col("all")).alias(f"s{k}") for k in range(3)]).collect()
        now = {r["bucket"]: tuple(r[f"s{k}"] / (r["s0"] + r["s1"] + r["s2"]) for k in range(3)) for r in found}
        change = max((abs(x - y) for b, w in now.items() for x, y in zip(w, weights.get(b, (1 / 3, 1 / 3, 1 / 3)))), default=0.0)
        weights = now
        if change < LEAST_CHANGE:
            break
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``; scores are base-10 logarithms.

    Nulls: a null text is empty (one token, the end); a row with a null id is learned from
    and scored. Repeated rows count each time. An empty table has no rows. Where no
    document is learned from, every token is unknown. Other columns are not read, so
    their names do not matter.
    """
    doc = F.col(id_col).cast("long")
    fold = F.coalesce(F.crc32(doc.cast("string").cast("binary")) % FOLDS, F.lit(FOLDS - 1)).cast("int")
    rows = docs.select(doc.alias("doc_id"), fold.alias("fold"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-int(size) // BUCKET_BYTES))
    chunks = stored(rows.mapInArrow(_packs(chunk_bytes), _CHUNKS))
    asked = chunks.mapInArrow(_asks(buckets), _ASKS)
    answers = stored(asked.groupBy("bucket").applyInArrow(_answers, _ANSWERS))
    sums = [F.expr(f"coalesce(sum({x}), 0L)") for x in ("docs", "tokens", "if(deleted, 0L, docs)", "if(deleted, 0L, tokens)")]
    texts, total, rest_texts, rest = chunks.agg(*sums).first()
    known, known_rest = answers.where("chunk is null").agg(F.expr("coalesce(sum(known), 0L)"), F.expr("coalesce(sum(known_rest), 0L)")).first()
    told = answers.where("chunk is not null")

    tokens = chunks.where("deleted").groupBy("chunk").cogroup(told.where("deleted").groupBy("chunk")).applyInArrow(_token_counts(rest_texts), _COUNTS)
    weights = filled(learn(stored(tokens), rest, known_rest))
    scored = chunks.groupBy("chunk").cogroup(told.drop("rest").groupBy("chunk")).applyInArrow(_scores(texts, total, known, weights), _SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same from the definition, for tests on small tables; rows are (doc_id, text)."""
    import re

    def fold(i: int | None) -> int:
        return FOLDS - 1 if i is None else zlib.crc32(str(i).encode()) % FOLDS

    def tokens(text: str | None) -> list:
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), 0]

    class Model:
        def __init__(self, folds: set[int]) -> None:
            self.c, self.docs = [Counter(), Counter(), Counter()], 0
            for i, text in rows:
                if fold(i) in folds:
                    self.docs += 1
                    seen = [1, 1, *tokens(text)]
                    for k in range(2, len(seen)):
                        for n in range(3):
                            self.c[n][tuple(seen[k - n : k + 1])] += 1
            self.total, self.words = sum(self.c[0].values()), len(self.c[0])

        def at(self, seen: list, k: int) -> tuple[int, tuple[float, float, float]]:
            c1, c2, c3 = (self.c[n][tuple(seen[k - n : k + 1])] for n in range(3))
            one = self.docs if k == 2 else self.c[0][(seen[k - 1],)]
            two = self.docs if k == 2 else self.c[1][tuple(seen[k - 2 : k])]
            bucket = two.bit_length() if two else ONE_WORD + one.bit_length()
            return bucket, (c3 / max(two, 1), c2 / max(one, 1), (c1 + ADDED) / (self.total + ADDED * (self.words + 1)))

    part, weights = Model(set(range(2, FOLDS))), {}
    held = [part.at(seen, k) for i, text in rows if fold(i) == DELETED for seen in [[1, 1, *tokens(text)]] for k in range(2, len(seen))]
    for _ in range(MOST_ROUNDS):
        sums: dict[int, list[float]] = {}
        for b, p in held:
            x = [w * q for w, q in zip(weights.get(b, (1 / 3,) * 3), p)]
            own = sums.setdefault(b, [0.0, 0.0, 0.0])
            for n in range(3):
                own[n] += x[n] / sum(x)
        now = {b: tuple(x / sum(s) for x in s) for b, s in sums.items()}
        change = max((abs(x - y) for b, w in now.items() for x, y in zip(w, weights.get(b, (1 / 3,) * 3))), default=0.0)
        weights = now
        if change < LEAST_CHANGE:
            break
    table, model, out = filled(weights), Model(set(range(1, FOLDS))), []
    for i, text in rows:
        seen = [1, 1, *tokens(text)]
        found = [model.at(seen, k) for k in range(2, len(seen))]
        known = sum(model.c[0][(seen[k],)] > 0 for k in range(2, len(seen)))
        mixed = sum(math.log10(sum(float(w) * q for w, q in zip(table[b], p))) for b, p in found)
        out.append((i, fold(i) == HELD_OUT, len(found), known, model.total, sum(math.log10(p[2]) for _, p in found), mixed))
    return out
