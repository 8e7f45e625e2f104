"""Embedding near-dedup by E8 lattice hashing.

Each table projects unit vectors to 8 dimensions by a seeded random orthonormal
map, shifts and scales them, and decodes them to the nearest point of the E8
lattice: the cell. A vector is indexed at its own cell in each table and probes it
and the ``PROBES`` neighbouring lattice points next nearest to it. Vectors of one
label that meet are verified by cosine in double precision.

Equal vectors of a label are one class with a count. Links are never made as pairs:
a cell answers with a number of links and one root for each vector, where a pair
that meets in several tables or cells counts at its first meeting only, which both
vectors' cells tell. A cell with many vectors is cut into blocks that meet two at a
time, and what meets is dealt out by its number of rows, so a group in a task holds
``DEAL_ROWS`` as expected however crowded a cell is. Recall against brute force is
measured in the tests (0.9 is asked; see the README for figures).

Nulls and edges: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label or id, link with nothing and are their own
component (null for a null id). Vectors of different lengths never link. Every row
is a vector of its own: repeated rows count as equal vectors, and rows of one id with
different vectors link each by its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordkernel as wk
from tidemark.llm.common import cut, shuffle_partitions
from tidemark.llm.components import connected_components

COSINE = 0.98
TABLES, PROBES, SCALE, SEED = 6, 8, 0.30, 20240229
#: Vectors of a block of a large cell; cells are cut into up to ``SPREAD`` blocks before blocks grow to that. Groups beyond ``CROWD`` are met by matrices.
BLOCK, SPREAD, CROWD = 2048, 4, 64
#: Rows of each deal of cells, as expected.
DEAL_ROWS = 4096


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


_NEAR = _neighbours()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    out = np.rint(x)
    off = x - out
    odd = out.sum(axis=1).astype(np.int64) % 2 != 0
    rows = np.flatnonzero(odd)
    worst = np.abs(off[rows]).argmax(axis=1)
    out[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return out


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: D8, or D8 moved by a half in every coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def _maps(dims: int, tables: int) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(tables):
        q, _r = np.linalg.qr(rng.standard_normal((max(dims, 8), 8)))
        out.append((q[:dims] * np.sqrt(dims / 8) / SCALE, rng.random(8)))
    return out


def _cell_keys(points: np.ndarray) -> np.ndarray:
    """A 64-bit key of each lattice point (last axis 8)."""
    twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
    key = np.zeros(points.shape[:-1], np.uint64)
    for k in range(8):
        key = wk.mix(key * np.uint64(0x9E3779B97F4A7C15) + twice[..., k] + np.uint64(k + 1))
    return key.view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(x: np.ndarray) -> np.ndarray:
    """Cell keys of unit vectors: by vector, table, and home first, then the probed neighbours."""
    out = np.empty((len(x), TABLES, 1 + PROBES), np.int64)
    for tab, (m, shift) in enumerate(_maps(x.shape[1], TABLES)):
        y = x @ m + shift
        c = nearest_e8(y)
        best = np.argsort(-((y - c) @ _NEAR.T), axis=1, kind="stable")[:, :PROBES]
        out[:, tab] = _cell_keys(np.concatenate([c[:, None, :], c[:, None, :] + _NEAR[best]], axis=1))
    return out


_KEYS = "label string, size int, rep long, tab int, cell long, home boolean"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector at its home and its probed neighbours, in every table."""
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column("vector")])
        for n in np.unique(sizes):
            alike = np.flatnonzero(sizes == n)
            for low in range(0, len(alike), 1024):
                part = batch.take(pa.array(alike[low : low + 1024]))
                x = part.column("vector").flatten().to_numpy().reshape(-1, n)
                keys = _cells(_unit(x))
                rows, (_, tabs, many) = pa.array(np.repeat(np.arange(len(x)), keys[0].size)), keys.shape
                tab, home = np.repeat(np.arange(tabs), many), np.tile(np.arange(many) == 0, tabs)
                columns = [part.column("label").take(rows), pa.array(np.full(len(rows), n, np.int32)), part.column("rep").take(rows), pa.array(np.tile(tab, len(x)), pa.int32()), pa.array(keys.ravel()), pa.array(np.tile(home, len(x)))]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "size", "rep", "tab", "cell", "home"])


def _meets(home: np.ndarray, keys: np.ndarray, tab: np.ndarray) -> np.ndarray:
    at = np.arange(len(home))
    return (keys[at, tab] == home[at, tab][:, None]).any(axis=1)


def _groups(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal numbers."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    return starts, np.diff(np.r_[starts, len(group)])


def _near_pairs(group: np.ndarray, x: np.ndarray, here: np.ndarray, sub: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of one small group (rows are sorted by it) whose unit vectors reach the cosine, one of them ``here`` and, if ``cross``, of two blocks.

    Rows meet the k-th row before them, for all groups at once.
    """
    starts, sizes = _groups(group)
    place = np.arange(len(group)) - np.repeat(starts, sizes)
    live = np.flatnonzero(np.repeat(sizes <= CROWD, sizes))
    step = 1
    while len(live := live[place[live] >= step]):
        some = live[(here[live] | here[live - step]) & (~cross[live] | (sub[live] != sub[live - step]))]
        near = some[np.einsum("ij,ij->i", x[some], x[some - step]) >= COSINE]
        yield near - step, near
        step += 1


def _near_crowds(group: np.ndarray, x: np.ndarray, here: np.ndarray, sub: np.ndarray, cross: np.ndarray, tab: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_near_pairs`` for the large groups, as strips ``(rows, other rows, which link)``; pairs that met before are left out.

    Within a group a cell is a small number and ``probed[table][row, cell]`` tells who comes there.
    """
    starts, sizes = _groups(group)
    for s, n in zip(starts[sizes > CROWD], sizes[sizes > CROWD]):
        rows = np.arange(s, s + n)
        number, probed = [], []
        for k in range(tab[s] + 1):
            cells, own = np.unique(keys[rows, k, 0], return_inverse=True)
            comes = np.zeros((n, len(cells)), bool)
            for key in keys[rows, k].T:
                at = np.minimum(np.searchsorted(cells, key), len(cells) - 1)
                hit = np.flatnonzero(cells[at] == key)
                comes[hit, at[hit]] = True
            number.append(own)
            probed.append(comes)
        first = sub[rows] == sub[s] if cross[s] else np.ones(n, bool)
        one, two = rows[first] - s, (rows[~first] if cross[s] else rows) - s
        lives = here[rows]
        # those that live here meet all, the others of the first block only those of the second that live here
        turns = ((one[lives[one]], two), (one[~lives[one]], two[lives[two]])) if cross[s] else ((one[lives[one]], two),)
        for a, b in turns:
            other, there = x[b + s].T, [np.ascontiguousarray(p[b].T) for p in probed]
            for low in range(0, len(a), 128):
                own = a[low : low + 128]
                near = x[own + s] @ other >= COSINE
                if not near.any():
                    continue
                less = own[:, None] < b
                if not cross[s]:
                    # a pair of two that live here is met twice
                    near &= less | ~lives[b]
                for k, (cell, comes) in enumerate(zip(number, probed)):
                    left, right = there[k][cell[own]], np.take(comes[own], cell[b], axis=1)
                    if k < tab[s]:
                        near &= ~(left | right)
                    else:
                        # in this table the home of the smaller comes first
                        near &= ~np.where(less, left & (lives[b] & ~lives[own][:, None]), right & (~lives[b] & lives[own][:, None]))
                yield own + s, b + s, near


def _join(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Roots (the least of each tree) after u and v are joined pair by pair."""
    while True:
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
        if not len(u):
            return root
        a, b = root[u], root[v]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up


def _links(cells: pa.Table) -> pa.Table:
    """Of many cells (one or two blocks of each): for each vector, links whose first meeting this is, and the smallest vector that it reaches here."""
    column = {c: cells.column(c).to_numpy() for c in ("tab", "cell", "a", "b", "sub", "rep", "copies", "key")}
    order = np.lexsort((column["rep"], column["b"], column["a"], column["key"]))
    tab, cell, a, b, sub, rep, copies, key = (v[order] for v in column.values())
    size = cells.column("size")[0].as_py()
    x = cells.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, size)
    reps, first, own = np.unique(rep, return_index=True, return_inverse=True)
    units = _unit(x[order[first]])
    keys = _cells(units)
    home = keys[:, :, 0]
    new_group = np.ones(len(rep), bool)
    new_group[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    here = home[own, tab] == cell
    group, unit, cross = np.cumsum(new_group) - 1, units[own], a != b
    copies = _copies_of(rep, copies, reps)
    n, root = np.zeros(len(reps), np.int64), np.arange(len(reps))
    for i, j in _near_pairs(group, unit, here, sub, cross):
        t = tab[i]
        # met before: in an earlier table, or in this one at the home of the smaller
        u, v = own[i], own[j]
        new = ~(here[j] & ~here[i] & _meets(home[u], keys[v], t))
        for k in range(TABLES - 1):
            earlier = np.flatnonzero(new & (t > k))
            at = np.full(len(earlier), k)
            new[earlier] = ~(_meets(home[u[earlier]], keys[v[earlier]], at) | _meets(home[v[earlier]], keys[u[earlier]], at))
        u, v = u[new], v[new]
        np.add.at(n, u, copies[v])
        np.add.at(n, v, copies[u])
        root = _join(root, u, v)
    for i, j, near in _near_crowds(group, unit, here, sub, cross, tab, keys[own]):
        u, v = own[i], own[j]
        # a vector stands once on each side of a strip
        n[u] += np.where(near, copies[v], 0).sum(axis=1)
        n[v] += np.where(near, copies[u][:, None], 0).sum(axis=0)
        i, j = np.nonzero(near & (root[u][:, None] != root[v]))
        root = _join(root, u[i], v[j])
    told = np.flatnonzero((n > 0) | (root != np.arange(len(reps))))
    return pa.table([pa.array(reps[told], pa.int64()), pa.array(n[told]), pa.array(reps[root[told]], pa.int64())], names=["rep", "n", "root"])


def _copies_of(rep: np.ndarray, copies: np.ndarray, reps: np.ndarray) -> np.ndarray:
    out = np.zeros(len(reps), np.int64)
    out[np.searchsorted(reps, rep)] = copies
    return out


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``df``."""
    vector = F.when(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(_usable(F.col(vector_col)), F.lit(False)), F.col(vector_col))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    # a class has a number of its own, as an id may name several vectors
    classes = rows.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
    cell = ["label", "size", "tab", "cell"]
    dealt = cut(classes.select("label", "vector", "rep").mapInArrow(_deal, _KEYS))
    busy = dealt.groupBy(*cell).agg(F.count("*").alias("met"), F.bool_or("home").alias("lived")).where("lived and met > 1")
    # more blocks copy more rows, fewer leave more in a task
    blocks = F.greatest(F.ceil(F.col("met") / BLOCK), F.least(F.ceil(F.col("met") * SPREAD / BLOCK), F.lit(SPREAD)))
    busy = cut(busy.select(*cell, "met", blocks.cast("int").alias("blocks")))
    deals = max(2 * shuffle_partitions(df.sparkSession), int(busy.agg(F.sum(F.col("met") * F.col("blocks"))).first()[0] or 0) // DEAL_ROWS)
    met = dealt.join(busy.drop("met"), cell).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(*cell, F.least("sub", "k").alias("a"), F.greatest("sub", "k").alias("b"), "sub", "rep")
    met = met.join(classes.select("rep", "copies", "vector"), "rep")
    # many small cells are taken at once; a cell's two blocks stay together
    met = met.withColumn("key", F.xxhash64(*cell)).withColumn("deal", F.pmod(F.xxhash64("key", "a", "b"), F.lit(deals)))
    found = cut(met.groupBy("deal", "size").applyInArrow(_links, "rep long, n long, root long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    whole = connected_components(found, "rep", "root").withColumnRenamed("node", "rep")
    told = classes.select("rep", "least", "copies").join(counts, "rep", "left").join(whole, "rep", "left")
    told = cut(told.select("rep", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("root")))
    smallest = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(smallest, "root").select("rep", "n_links", "component_id")
    named = classes.select("label", "vector", "rep").join(told, "rep").drop("rep")
    out = rows.join(named, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def brute_force(rows: list[tuple], cosine: float = COSINE) -> dict[int, tuple[int, int]]:
    """``{id: (n_links, component)}`` from the definition, for tests on small tables."""
    ids = [r[0] for r in rows]
    top = {i: i for i in ids}
    n = dict.fromkeys(ids, 0)
    labels: dict = {}
    for i, v, label in rows:
        if v is not None and label is not None and None not in v:
            x = np.asarray(v, np.float64)
            if len(x) and np.isfinite(x).all() and x.any():
                labels.setdefault((label, len(x)), []).append((i, x / np.sqrt((x * x).sum())))

    def root(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for own in labels.values():
        x = np.stack([v for _, v in own])
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1))):
            a, b = own[i][0], own[j][0]
            n[a] += 1
            n[b] += 1
            a, b = root(a), root(b)
            top[max(a, b)] = min(a, b)
    return {i: (n[i], root(i)) for i in ids}
