"""Exact top-k search by a three-phase uniform threshold.

The vectors' dimensions are cut into slices of ``WIDTH``; a slice of a block of rows
is a node. Its local score of a row is the row's share of the inner product with a
query.

1. Each node lists the ``k`` rows of best local score for each query. The whole scores
   of the rows that a block's nodes list are taken; the k-th best of all blocks is a
   lower bound of the k-th best score there is.
2. The bound divided by the query's number of slices is the cutoff, which is sent to
   the nodes with the query: a row whose score reaches the bound has a local score at
   the cutoff or above in some slice. Nodes send just those entries. A row that lacks
   an entry of a slice has less than the cutoff there, and rows whose sum falls short
   of the bound are gone. If the bound is not positive (or fewer than ``k`` rows are
   known), no cutoff is safe and all rows are taken.
3. The other rows' scores are resolved exactly, and the best ``k`` stay.

A task holds a block of queries beside the nodes of one block of rows, so what nodes send
each other is never shuffled: all that is are blocks, each as often as the other side has
blocks, packed in the narrowest integers, and ``k`` rows of each query and block of rows.
Nothing that grows with the data is broadcast. Rows of a block are in order of their
length, and a slice holds those that have it, so long vectors have more slices and make
no other row longer.

Scores are exact integers: components are ``floor(256 x)``. A component or a score that
does not fit into a long raises an error. Nulls and edges: vectors that are null or
hold null or non-finite components, and rows with a null id, take no part; missing
dimensions count as zero, an empty vector is all zero; no row is its query's own
(rows of the query's id are left out); ties go to the smaller id; a query gets all rows
there are if fewer than ``k``. A repeated row is a row of its own, as a query too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Rows of a block; it has ``DIMENSIONS`` times as many components at most, on average of blocks.
WIDTH, QUERY_ROWS, BLOCK_ROWS, DIMENSIONS, FACTOR = 16, 1 << 15, 1 << 15, 64, 256.0
#: Local scores that a task holds at once, and columns of them of which one maximum is taken.
CELLS, SPAN = 1 << 22, 64
_LONG = 1 << 63
_NONE = -_LONG

_PACKED = "kind string, deal int, n binary, id binary, bound binary, sizes binary, wide int, data binary"
_BLOCK = pa.schema([("kind", pa.string()), ("deal", pa.int32()), *((c, pa.binary()) for c in ("n", "id", "bound", "sizes")), ("wide", pa.int32()), ("data", pa.binary())])
_PAIRS = "query long, id long, score long"


def _packed(kind: str):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        values = rows.column("vector").combine_chunks()
        sizes = np.diff(values.offsets.to_numpy()).astype(np.int64)
        order = np.argsort(-sizes, kind="stable")
        data = values.take(pa.array(order)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        least, most = data.min(initial=0), data.max(initial=0)
        narrow = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
        column = lambda name: rows.column(name).to_numpy()[order].astype(np.int64).tobytes()
        row = {"kind": kind, "deal": key[0].as_py(), "n": column("n"), "id": column("id"), "bound": column("bound"), "sizes": sizes[order].tobytes(), "wide": narrow().itemsize, "data": data.astype(narrow).tobytes()}
        return pa.Table.from_pylist([row], schema=_BLOCK)

    return run


class _Block:
    """Rows of a packed block, the longest first; ``m``: their numbers of slices."""

    def __init__(self, row: dict) -> None:
        self.n, self.id, self.bound, self.sizes = (np.frombuffer(row[c], np.int64) for c in ("n", "id", "bound", "sizes"))
        self.data = np.frombuffer(row["data"], f"i{row['wide']}")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.m = np.maximum(-(-self.sizes // WIDTH), 1)
        self.most = max(int(self.data.max(initial=0)), -int(self.data.min(initial=0)))

    def slice(self, k: int, kind: type) -> np.ndarray:
        """Components of slice ``k`` of the rows that have it, which are the first ones; missing ones are zero."""
        many = int(np.searchsorted(-self.sizes, -k * WIDTH))
        if not many:
            return np.zeros((0, WIDTH), kind)
        steps = k * WIDTH + np.arange(WIDTH)
        at = np.minimum(self.starts[:many, None] + steps, len(self.data) - 1)
        return np.where(steps < self.sizes[:many, None], self.data[at], 0).astype(kind)


def _two(group: pa.Table) -> tuple[_Block, _Block] | None:
    """The blocks of queries and of rows of a group, if both are there."""
    rows = {r["kind"]: r for r in group.to_pylist()}
    return (_Block(rows["q"]), _Block(rows["x"])) if len(rows) == 2 else None


def _greatest(q: _Block, x: _Block) -> int:
    """A bound of all absolute scores of ``q`` with ``x``."""
    return int(min(q.sizes.max(initial=0), x.sizes.max(initial=0))) * q.most * x.most


def _kind(most: int) -> type:
    """Numbers in which sums of two scores up to ``most`` are exact: floats, doubles or longs, and whole numbers beyond them."""
    return next((t for t, bits in ((np.float32, 24), (np.float64, 53), (np.int64, 63)) if most << 2 < 1 << bits), object)


class _Scores:
    """Local scores of some queries with a block's rows, slice by slice; ``own``: places of the queries' own rows."""

    def __init__(self, local: list[np.ndarray], at: slice, n: int, own: tuple[np.ndarray, np.ndarray]) -> None:
        self.local, self.at, self.n, self.own = local, at, n, own

    def whole(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Exact scores of pairs, from what all nodes have of them."""
        total = np.zeros(len(i), self.local[0].dtype if self.local else np.int64)
        for local in self.local:
            if local.shape == (self.at.stop - self.at.start, self.n):
                total += local[i, j]
            else:
                some = np.flatnonzero((i < local.shape[0]) & (j < local.shape[1]))
                total[some] += local[i[some], j[some]]
        return _long(total)


def _long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and scores.size and max(abs(int(scores.max())), abs(int(scores.min()))) >= _LONG:
        raise OverflowError("an inner product does not fit into a long")
    return scores if scores.dtype == object else scores.astype(np.int64)


def _tiles(q: _Block, x: _Block) -> Iterator[_Scores]:
    """Local scores of as many queries at once as ``CELLS`` has room for."""
    kind = _kind(_greatest(q, x))
    slices = int(min(q.m.max(), x.m.max()))
    qs, xs = ([b.slice(k, kind) for k in range(slices)] for b in (q, x))
    order = np.argsort(x.id, kind="stable")
    lo, hi = (np.searchsorted(x.id[order], q.id, side) for side in ("left", "right"))
    step = max(1, CELLS // max(1, sum(map(len, xs)), len(x.n)))
    for a in range(0, len(q.n), step):
        at = slice(a, min(a + step, len(q.n)))
        many = hi[at] - lo[at]
        first = np.repeat(lo[at] - np.cumsum(many) + many, many)
        own = np.repeat(np.arange(at.stop - a), many), order[first + np.arange(many.sum())]
        local = [u[at] @ v.T for u, v in zip(qs, xs)]
        if kind is object:
            for part in local:
                has = (own[0] < part.shape[0]) & (own[1] < part.shape[1])
                part[own[0][has], own[1][has]] = 0
                _long(part)
        yield _Scores(local, at, len(x.n), own)


def _best_places(local: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest of each row (of all, if fewer), which are in the ``k`` spans of highest maxima."""
    n = local.shape[1]
    if local.dtype == object or n <= k:
        return np.argsort(-local, axis=1, kind="stable")[:, :k]
    top = lambda v: np.argpartition(v, v.shape[1] - k, axis=1)[:, -k:]
    spans = n // SPAN
    if spans <= 2 * k:
        return top(local)
    most = local[:, : spans * SPAN].reshape(len(local), spans, SPAN).max(axis=2)
    columns = (top(most)[:, :, None] * SPAN + np.arange(SPAN)).reshape(len(local), -1)
    columns = np.concatenate([columns, np.broadcast_to(np.arange(spans * SPAN, n), (len(local), n - spans * SPAN))], axis=1)
    return np.take_along_axis(columns, top(np.take_along_axis(local, columns, axis=1)), axis=1)


def _pairs(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """``_PAIRS`` of ``(query, id, score)``."""
    join = lambda k: np.concatenate([r[k] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    return pa.table({"query": join(0), "id": join(1), "score": join(2)})


def _best(k: int, q: _Block, x: _Block, at: slice, i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best pairs of each query, ties to the smaller id. By descending score: the complement turns longs around without overflow."""
    order = np.lexsort((x.id[j], ~scores.astype(np.int64), i))
    i, j, scores = i[order], j[order], scores[order]
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    place = np.arange(len(i)) - np.repeat(starts, np.diff(starts, append=len(i)))
    some = place < k
    return q.n[at][i[some]], x.id[j[some]], scores[some]


def _lists(k: int):
    """Phase 1, of a block of queries and of rows: whole scores of the rows that a node lists as its ``k`` best."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        two, out = _two(group), []
        if not two:
            return _pairs([])
        q, x = two
        for tile in _tiles(q, x):
            listed = []
            for local in tile.local:
                if local.size:
                    has = (tile.own[0] < local.shape[0]) & (tile.own[1] < local.shape[1])
                    shown = local.copy()
                    shown[tile.own[0][has], tile.own[1][has]] = -np.inf if local.dtype.kind == "f" else _NONE
                    best = _best_places(shown, k)
                    listed.append((np.repeat(np.arange(len(best)), best.shape[1]) * tile.n + best.ravel()))
            if listed:
                # a row is one row, whichever nodes list it
                place = np.unique(np.concatenate(listed))
                place = np.setdiff1d(place, tile.own[0] * tile.n + tile.own[1])
                i, j = place // tile.n, place % tile.n
                out.append(_best(k, q, x, tile.at, i, j, tile.whole(i, j)))
        return _pairs(out)

    return run


def _resolved(k: int):
    """Phases 2 and 3, of a block of queries and of rows: bounds from the entries that nodes send, exact scores of what is left."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        two, out = _two(group), []
        if not two:
            return _pairs([])
        q, x = two
        greatest = _greatest(q, x)
        # the bound shared by a query's slices, rounded up
        cutoffs = -(-q.bound // q.m)
        for tile in _tiles(q, x):
            bound, cutoff, m = q.bound[tile.at], cutoffs[tile.at], q.m[tile.at]
            asked = bound > 0
            live = asked & (bound <= greatest)
            # an entry below the cutoff is not sent and counts as what is just below it; rows of none fall short of the bound
            kind = tile.local[0].dtype if tile.local else np.dtype(np.int64)
            below = np.where(live, cutoff - 1, 0).astype(kind)
            most = np.repeat((below * m.astype(kind))[:, None], tile.n, axis=1)
            for local in tile.local:
                rows, n = local.shape
                sent = local - below[:rows, None]
                np.maximum(sent, 0, out=sent)
                most[:rows, :n] += sent
            left = (most >= np.where(live, bound, 0).astype(kind)[:, None]) & live[:, None] | ~asked[:, None]
            left[tile.own] = False
            place = np.flatnonzero(left)
            i, j = place // tile.n, place % tile.n
            scores = tile.whole(i, j)
            some = np.flatnonzero((scores >= bound[i]) | ~asked[i])
            out.append(_best(k, q, x, tile.at, i[some], j[some], scores[some]))
        return _pairs(out)

    return run


def _components(v: Column) -> Column:
    """``floor(256 x)`` of each component; an error if one does not fit into a long."""
    whole = lambda x: F.floor(x.cast("double") * FACTOR)
    fits = lambda x: F.abs(x.cast("double") * FACTOR) < float(_LONG)
    return F.transform(v, lambda x: F.when(fits(x), whole(x)).otherwise(F.raise_error(F.lit("a component does not fit into a long")).cast("long")))


def _whole(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the rows that take part."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return df.where(F.col("id").isNotNull() & v.isNotNull() & fine)


def _deals(df: DataFrame, per_deal: int) -> int:
    """Blocks for the rows of ``vector`` that there are."""
    n, components = df.agg(F.count("*"), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
    return max(1, -(-n // per_deal), -(-components // (per_deal * DIMENSIONS)))


def _blocks(df: DataFrame, kind: str, many: int) -> DataFrame:
    """``df``'s ``n, id, vector, bound`` packed in ``many`` blocks."""
    rows = df.select("n", "id", "vector", "bound", F.pmod(F.xxhash64("n"), F.lit(many)).cast("int").alias("deal"))
    return cut(rows.groupBy("deal").applyInArrow(_packed(kind), _PACKED))


def search(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows of each query by integer inner product."""
    rows = _whole(rows, id_col, vector_col)
    number, none = F.monotonically_increasing_id().alias("n"), F.lit(_NONE).alias("bound")
    queries = cut(_whole(queries, id_col, vector_col).select(number, "id", _components(F.col("vector")).alias("vector")))
    q_deals, x_deals = _deals(queries, QUERY_ROWS), _deals(rows, BLOCK_ROWS)
    x = _blocks(rows.select(number, "id", _components(F.col("vector")).alias("vector"), none), "x", x_deals)
    rest = ["n", "id", "bound", "sizes", "wide", "data"]

    def met(q: DataFrame) -> DataFrame:
        """Each block of queries beside each block of rows."""
        each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
        asked = q.select("kind", F.col("deal").alias("q_deal"), each(x_deals).alias("x_deal"), *rest)
        return asked.unionByName(x.select("kind", each(q_deals).alias("q_deal"), F.col("deal").alias("x_deal"), *rest)).groupBy("q_deal", "x_deal")

    listed = met(_blocks(queries.select("*", none), "q", q_deals)).applyInArrow(_lists(k), _PAIRS)
    bounds = listed.groupBy("query").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    bounds = bounds.select(F.col("query").alias("n"), F.get("scores", F.lit(k - 1)).alias("bound"))
    told = queries.join(bounds, "n", "left").withColumn("bound", F.coalesce("bound", F.lit(_NONE)))
    last = met(_blocks(told, "q", q_deals)).applyInArrow(_resolved(k), _PAIRS)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    last = last.withColumn("rank", rank).where(F.col("rank") <= k)
    names = queries.select(F.col("n").alias("query"), F.col("id").alias("query_id"))
    return last.join(names, "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")


#: The same in DuckDB's SQL, for every 50th id of ``embeddings`` and the 5 best.
ORACLE_SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::bigint as score
  from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
