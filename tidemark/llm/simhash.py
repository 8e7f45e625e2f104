"""SimHash near-dedup with a generalised pigeonhole index.

Fingerprints of 64 bits are linked at ``RADIUS`` or fewer differing bits. Bits are
grouped into partitions, correlated ones together; partition i gets a threshold
t_i of its own, with sum t_i = RADIUS - m + 1 (t_i = -1: not probed). Then two
fingerprints within the radius agree up to t_i bits in some partition i. Numbers
of candidates are estimated from bit statistics of all fingerprints, and a dynamic
programme picks the thresholds of least cost. Every fingerprint is dealt to the
values within t_i of its own in each partition i, and pairs that meet are verified.

Only distinct fingerprints are dealt, so copies cost nothing. A value shared by
more than ``SMALL`` fingerprints is not paired up: its fingerprints go by the exact
linear way instead: two fingerprints differ in at most two bits if and only if some
64-bit point is within one bit of both, so each is dealt to its 65 points, none of
which more than 65 fingerprints can meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from tidemark.llm import wordkernel as wk
from tidemark.llm.common import cut, shuffle_partitions
from tidemark.llm.components import connected_components

SHINGLE, SEED, RADIUS, BITS = 3, 42, 2, 64
#: Fingerprints of one partition value that are compared pair by pair.
SMALL = 128
#: Rows dealt for each group of partition values that is verified at once.
DEAL_ROWS = 100_000
#: Cost of dealing a fingerprint to one value, in compared pairs.
DEAL_COST = 4.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slice_fingerprints(offsets: np.ndarray, data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Fingerprints of documents ``low`` to ``high``."""
    w = wk.words(offsets, data, low, high)
    n = len(w.counts)
    out = np.zeros(n, np.uint64)
    if not len(w.starts):
        return out
    # words of a document are put one space apart
    inside = wk._IS_WORD[w.data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    at = np.cumsum(keep) - 1
    text = np.where(inside, _LOWER[w.data], np.uint8(32))[keep].tobytes()
    starts, ends = at[w.starts], at[w.ends - 1] + 1
    many = np.maximum(np.minimum(w.counts, 1), w.counts - SHINGLE + 1)
    some = np.flatnonzero(many)
    many = many[some]
    edge = np.cumsum(many) - many
    first = np.repeat(w.firsts[some], many) + np.arange(int(many.sum())) - np.repeat(edge, many)
    last = first + np.repeat(np.minimum(w.counts[some], SHINGLE), many) - 1
    digests = b"".join([xxh64_digest(text[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, BITS)
    ones = np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    out[some] = np.packbits(ones * 2 > many[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = wk.text_buffers(batch.column("text"))
        got = [slice_fingerprints(offsets, data, a, b) for a, b in wk.slices(offsets)]
        if got:
            yield pa.record_batch([batch.column("doc_id"), batch.column("key"), pa.array(np.concatenate(got).view(np.int64))], names=["doc_id", "key", "fp"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, fp``: with a hash of the text, which tells rows of one id apart."""
    text = F.col(text_col).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    return docs.mapInArrow(_fingerprints, "doc_id long, key long, fp long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed) for every row; a text without words (null too) has fingerprint zero."""
    return _keyed(docs, id_col, text_col).drop("key")


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for k in range(0, len(fps), 1 << 16):
            x = np.unpackbits(fps[k : k + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, BITS)[:, ::-1].astype(np.float32)
            total += (x.T @ x).astype(np.int64)
    yield pa.record_batch([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], names=["cell", "n"])


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have both bits i and j, over all of them (64 x 64 figures, whatever the input)."""
    rows = fps.mapInArrow(_gram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for cell, n in rows:
        out[cell] = n
    return out.reshape(BITS, BITS)


def group_bits(together: np.ndarray, total: float, m: int) -> list[list[int]]:
    """``m`` partitions of about equal width; each grows by the bit most correlated with it."""
    p = np.diag(together) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    linked = np.abs((together / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(linked, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        own = [max(sorted(left), key=lambda i: linked[i, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < width:
            best = max(sorted(left), key=lambda i: linked[i, own].sum())
            own.append(best)
            left.discard(best)
        out.append(sorted(own))
    return out


def estimated_cost(differ: np.ndarray, own: list[int], t: int, total: float) -> float:
    """Cost of threshold ``t``: values dealt to, and pairs expected to meet if two fingerprints differ in bit i with chance ``differ[i]``."""
    if t < 0:
        return 0.0
    chance = np.zeros(t + 1)
    chance[0] = 1
    for i in own:
        moved = np.r_[0, chance[:-1]] * differ[i]
        chance = chance * (1 - differ[i]) + moved
    values = sum(comb(len(own), k) for k in range(t + 1))
    return total * values * DEAL_COST + total * total / 2 * chance.sum()


def allocate(together: np.ndarray, total: float, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions and thresholds of least estimated cost, over 1 to 4 partitions."""
    p = np.diag(together) / max(total, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list] = (float("inf"), [])
    for m in range(1, 5):
        parts = group_bits(together, total, m)
        # state: thresholds' sum so far, shifted by one for each partition -> (cost, thresholds)
        state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for own in parts:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, ts) in state.items():
                for t in range(-1, radius + 1):
                    key, now = used + t + 1, cost + estimated_cost(differ, own, t, total)
                    if key <= radius + 1 and (key not in nxt or now < nxt[key][0]):
                        nxt[key] = (now, [*ts, t])
            state = nxt
        cost, ts = state.get(radius + 1, (float("inf"), []))
        if cost < best[0]:
            best = cost, [(own, t) for own, t in zip(parts, ts) if t >= 0]
    return best[1]


def _masks(own: list[int], t: int) -> list[int]:
    """Bit flips of up to ``t`` bits of a partition."""
    from itertools import combinations

    return [sum(1 << i for i in c) for k in range(t + 1) for c in combinations(own, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _deal(plan: list[tuple[list[int], int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [(k, np.uint64(sum(1 << i for i in own)), np.array(_masks(own, t), np.uint64)) for k, (own, t) in enumerate(plan)]
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for k, mask, many in flips:
                step = max(1, (1 << 18) // len(many))
                for at in range(0, len(fps), step):
                    own = fps[at : at + step]
                    values = ((own & mask)[:, None] ^ many[None, :]).ravel()
                    yield pa.record_batch([pa.array(np.full(len(values), k, np.int32)), pa.array(values.view(np.int64)), pa.array(np.repeat(own, len(many)).view(np.int64))], names=["part", "value", "fp"])

    return run


def _verify(groups: pa.Table) -> pa.Table:
    """Links of each fingerprint to the first one before it within the radius, of a few partition values at once."""
    keys = groups.column("key").to_numpy()
    fps = groups.column("fp").to_numpy().view(np.uint64)
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    a, b = [], []
    # the k-th neighbour before it with the same key; there are fewer than SMALL of them for each real value
    live = np.arange(1, len(fps))
    step = 1
    while len(live):
        live = live[(live >= step) & (keys[live] == keys[live - step])]
        near = live[np.bitwise_count(fps[live] ^ fps[live - step]) <= RADIUS]
        a.append(fps[near])
        b.append(fps[near - step])
        step += 1
    a = np.concatenate(a) if a else np.zeros(0, np.uint64)
    b = np.concatenate(b) if b else np.zeros(0, np.uint64)
    return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.array([0, *(1 << i for i in range(BITS))], np.uint64)
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(fps), 4096):
            own = fps[at : at + 4096]
            yield pa.record_batch([pa.array((own[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(own, len(flips)).view(np.int64))], names=["point", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: links between distinct fingerprints ``fp`` that connect all those within the radius."""
    total = fps.count()
    if not total:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    plan = allocate(bit_counts(fps), total)
    dealt = fps.mapInArrow(_deal(plan), "part int, value long, fp long")
    counts = dealt.groupBy("part", "value").count()
    large = counts.where(F.col("count") > SMALL).select("part", "value")
    large = cut(large)
    # what is alone at its value has no candidate
    small = dealt.join(large, ["part", "value"], "left_anti")
    values = sum(len(_masks(own, t)) for own, t in plan)
    deals = max(2 * shuffle_partitions(fps.sparkSession), total * values // DEAL_ROWS)
    met = small.select(F.xxhash64("part", "value").alias("key"), "fp").withColumn("deal", F.pmod("key", F.lit(deals)))
    found = met.groupBy("deal").applyInArrow(_verify, "a long, b long")
    crowd = dealt.join(large, ["part", "value"], "left_semi").select("fp").distinct()
    points = crowd.mapInArrow(_points, "point long, fp long")
    stars = points.groupBy("point").agg(F.collect_set("fp").alias("met")).where(F.size("met") > 1)
    stars = stars.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a <> b")
    return found.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable, itself included. Texts without
    words share fingerprint zero and link like any other; repeated rows and ids
    stay; a row with a null id gets the smallest id of the others it reaches
    (null if there is none). Other columns are not read.
    """
    docs = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    whole = connected_components(links(distinct.select("fp")))
    joined = distinct.join(whole.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    roots = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = joined.join(roots, "component").select("fp", "component_id")
    return docs.join(ids, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``, the fingerprint as 16 lower-case hex digits."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id, and of several texts of this id one.

    Judged by row: rows of one id with different texts stay or go each by its own text;
    rows with the same id and text are one document and stay or go together; rows with
    a null id stay and make no other go. Null and empty texts are a group like any
    other. Columns stay as they are, whatever their names.
    """
    own = cut(_keyed(docs, id_col, text_col).where("doc_id is not null"))
    distinct = cut(own.select("fp").distinct())
    whole = connected_components(links(distinct)).withColumnRenamed("node", "fp")
    rows = cut(own.join(whole, "fp", "left").select("doc_id", "key", F.coalesce("component", "fp").alias("group")).distinct())
    first = rows.groupBy("group").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    gone = rows.join(first, "group").where("doc_id <> first.doc_id or key <> first.key").select("doc_id", "key")
    # a text is in one group, so no row is asked to stay and to go
    held = docs.select(F.struct("*").alias("held"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"))
    return held.join(gone, ["doc_id", "key"], "left_anti").select("held.*")


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, str, int]]:
    """The same from the definition, for tests on small tables."""
    import re

    from xxhash import xxh64_intdigest

    found = []
    for i, t in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        s = [" ".join(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))] if w else []
        h = [xxh64_intdigest(x.encode(), SEED) for x in s]
        found.append((i, sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(BITS))))
    fps = sorted({f for _, f in found})
    root = {f: f for f in fps}

    def top(f: int) -> int:
        while root[f] != f:
            f = root[f]
        return f

    for k, f in enumerate(fps):
        for g in fps[:k]:
            if (f ^ g).bit_count() <= RADIUS:
                root[top(f)] = top(g)
    least: dict[int, int] = {}
    for i, f in found:
        least[top(f)] = min(least.get(top(f), i), i)
    return [(i, f"{f:016x}", least[top(f)]) for i, f in found]
