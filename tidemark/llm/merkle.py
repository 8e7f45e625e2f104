"""Merkle manifest of a table, with a proof for every row, by a butterfly exchange.

Rows are leaves of a tree for each source, and the sources' roots are the leaves of
one more tree. Every ``FANOUT`` consecutive nodes have one parent, so a node's place
tells which leaves lie below it, and trees can be cut into aligned blocks.

1. blocks: leaves are numbered by a range sort (no window over a source) and
   gathered in blocks of ``FANOUT ** BLOCK_LEVELS`` leaves, each hashed to its block root;
2. butterfly: in round r, blocks whose numbers differ in digit r only (to the base of
   the fanout) swap the roots they hold; each hashes the common ancestor again for
   itself and keeps the others as the siblings of its next level. After the last
   round every block has the root and its whole upper proof, and nothing has to be
   sent down the tree. Where the last run of a level is short, the last block stands
   in for the blocks that are not there;
3. folding: every row takes its lower siblings from its block, its upper ones from
   the block's proof, and folds the leaf of the row as it is received.

Only digests move; texts stay where they are read. Rounds grow with the logarithm of
the largest source, and a source with most of the rows has most of the blocks.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.ordering import running

FANOUT = 3
#: Levels of a tree inside one block: 729 leaves.
BLOCK_LEVELS = 6
#: Rounds of the butterfly between two checkpoints.
ROUNDS = 4
#: Parts that a source's blocks are dealt into where they meet its upper proof.
SALTS = 16

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_SIBLINGS = "array<struct<left: string, right: string>>"


def _h(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def _field(x: Column) -> Column:
    x = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    """Digest of a row: each field as its length in bytes, a colon and its value, ``-`` for null."""
    return _h(F.concat(*map(_field, values)))


def _with_levels(blocks: DataFrame, levels: int) -> DataFrame:
    """``blocks`` with the nodes of each level, ``level_0`` up to ``level_k``; a block that is a whole tree stops at one node."""
    blocks = blocks.selectExpr("*", "members.leaf as level_0")
    for k in range(levels):
        below = f"level_{k}"
        run = f"array_join(slice({below}, i * {FANOUT} + 1, {FANOUT}), '')"
        up = f"transform(sequence(0, (size({below}) - 1) div {FANOUT}), i -> sha2(cast({run} as binary), 256))"
        blocks = blocks.selectExpr("*", f"if(blocks = 1 and size({below}) = 1, {below}, {up}) as level_{k + 1}")
    return blocks


def _swap(blocks: DataFrame, stride: int) -> DataFrame:
    """One round of the butterfly over blocks of trees that are not done: ``tree, block, blocks, root, above``."""
    node = F.floor(F.col("block") / F.lit(stride)).cast("long")
    digit, low = (node % FANOUT).cast("int"), F.col("block") % F.lit(stride)
    # the last block also answers in the places that its short subtree has no block for
    stands_in = (F.col("block") == F.col("blocks") - 1) & (digit > 0)
    slots = F.when(stands_in, F.sequence(low, F.lit(stride - 1).cast("long"))).otherwise(F.array(low))
    sent = blocks.select("tree", F.floor(node / F.lit(FANOUT)).cast("long").alias("group"), low.alias("low"), digit.alias("digit"), "root", "block", "blocks", "above", F.explode(slots).alias("slot"))
    own = F.when(F.col("slot") == F.col("low"), F.struct("digit", "block", "blocks", "above"))
    met = sent.groupBy("tree", "group", "slot").agg(F.sort_array(F.collect_list(F.struct("digit", "root"))).alias("swapped"), F.collect_list(own).alias("own"))
    # a group of the exchange has at most FANOUT rows
    each = met.select("tree", "swapped", F.explode("own").alias("own")).select("tree", "swapped", "own.*")

    def side(keep) -> Column:
        return F.array_join(F.transform(F.filter("swapped", keep), lambda x: x["root"]), "")

    siblings = F.struct(side(lambda x: x["digit"] < F.col("digit")).alias("left"), side(lambda x: x["digit"] > F.col("digit")).alias("right"))
    return each.select("tree", "block", "blocks", _h(F.array_join("swapped.root", "")).alias("root"), F.concat("above", F.array(siblings)).alias("above"))


def _butterfly(blocks: DataFrame) -> DataFrame:
    """``tree, block, root, above``: the root of each block's tree and the siblings above the block, from ``tree, block, blocks, root``."""
    state = blocks.withColumn("above", F.array().cast(_SIBLINGS))
    most, stride, turn = blocks.agg(F.max("blocks")).first()[0] or 0, 1, 0
    done = state.where(F.col("blocks") <= 1)
    state = state.where(F.col("blocks") > 1)
    while most > stride:
        state = _swap(state, stride)
        stride, turn = stride * FANOUT, turn + 1
        if turn % ROUNDS == 0:
            state = cut(state)
        done = done.union(state.where(F.col("blocks") <= stride))
        state = state.where(F.col("blocks") > stride)
    return done.select("tree", "block", "root", "above")


def _trees(leaves: DataFrame, order: list[Column], levels: int) -> tuple[DataFrame, DataFrame]:
    """Blocks of every tree with their members in order, and what the butterfly tells each block.

    ``leaves``: ``tree, leaf, held``, where ``held`` is what goes with a leaf.
    """
    width = FANOUT**levels
    placed = running(leaves, "tree", order)
    placed = placed.withColumn("block", F.floor(F.col("pos") / F.lit(width)).cast("long")).withColumn("blocks", F.ceil(F.col("many") / F.lit(width)).cast("long"))
    blocks = placed.groupBy("tree", "block", "blocks").agg(F.array_sort(F.collect_list(F.struct("pos", "leaf", "held"))).alias("members"))
    blocks = cut(blocks)
    roots = _with_levels(blocks, levels).select("tree", "block", "blocks", F.col(f"level_{levels}")[0].alias("root"))
    return blocks, cut(_butterfly(cut(roots)))


def _siblings(level: int) -> str:
    """The siblings of a member of a block at a level inside the block; null beyond the root of a block that is a whole tree."""
    nodes, at = f"level_{level}", f"cast(place div {FANOUT**level} as int)"
    left = f"array_join(slice({nodes}, {at} - {at} % {FANOUT} + 1, {at} % {FANOUT}), '')"
    right = f"array_join(slice({nodes}, {at} + 2, {FANOUT - 1} - {at} % {FANOUT}), '')"
    return f"if(blocks = 1 and size({nodes}) = 1, null, struct({left} as left, {right} as right))"


def _proofs(blocks: DataFrame, told: DataFrame, levels: int) -> DataFrame:
    """``tree, root, leaf, held, path``: every leaf with its siblings up to the root of its tree."""
    met = _with_levels(blocks.join(told, ["tree", "block"]), levels)
    each = met.selectExpr("tree", "blocks", "root", "above", *[f"level_{k}" for k in range(levels)], "posexplode(members) as (place, member)")
    own = f"filter(array({', '.join(_siblings(k) for k in range(levels))}), x -> x is not null)"
    return each.selectExpr("tree", "root", "member.leaf as leaf", "member.held as held", f"concat({own}, above) as path")


def _fold(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda so_far, x: _h(F.concat(x["left"], so_far, x["right"])))


def manifest(docs: DataFrame, received: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", levels: int = BLOCK_LEVELS) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, path, received_leaf, folded_root, verified`` for every row of ``docs``.

    ``path``: siblings from the leaf up to the root, as ``left`` and ``right``.
    ``received``: the leaf digest of a row as it came over, by default the row's own;
    ``folded_root`` is what it folds to, ``verified`` whether that is the root.

    Nulls: a null field is hashed as ``-``; rows with a null source are a tree of their
    own, before all others; null ids come first in their tree. Rows that share an id come in
    the order of their digests; equal rows are interchangeable. An empty table has no
    rows. Other columns are not read, so their names do not matter.
    """
    leaf = leaf_of([F.col(c) for c in fields])
    source = F.col(source_col).cast("string")
    # "n" and "s" keep null before all strings, and strings in the order of their bytes
    tree = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))
    rows = docs.select(tree.alias("tree"), leaf.alias("leaf"), F.struct(F.col(id_col).cast("long").alias("doc_id"), (leaf if received is None else received).alias("received")).alias("held"))
    # the last order tells equal rows apart, so that ranges can cut between them
    order = [F.col("held.doc_id").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    blocks, told = _trees(cut(rows.withColumn("tie", F.monotonically_increasing_id())), order, levels)
    tops = told.where("block = 0").select(F.lit("all").alias("tree"), F.col("root").alias("leaf"), F.col("tree").alias("held"))
    upper_blocks, upper_told = _trees(tops, [F.col("held")], levels)
    upper = _proofs(upper_blocks, upper_told, levels).select(F.col("held").alias("tree"), F.col("root").alias("top"), F.col("path").alias("upper"))
    # a source may have most of the blocks: its proof goes to all salts
    upper = cut(upper).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    told = told.withColumn("salt", (F.col("block") % SALTS).cast("int")).join(upper, ["tree", "salt"]).drop("salt")
    told = told.select("tree", "block", F.struct(F.col("root").alias("subroot"), F.col("top").alias("root")).alias("root"), F.concat("above", "upper").alias("above"))
    found = _proofs(blocks, told, levels)
    named = F.when(F.col("tree") != "n", F.substring("tree", 2, 1 << 30)).alias("source")
    found = found.select(F.col("held.doc_id").alias("doc_id"), named, "leaf", "root.subroot", "root.root", "path", F.col("held.received").alias("received_leaf"))
    folded = found.withColumn("folded_root", _fold(F.col("received_leaf"), F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_feeds(id_col: str = "doc_id") -> Column:
    """The leaf of a row as received where CRC-32 of the id is even and the text has lost its line feeds; others arrive as sent."""
    torn = F.col("text").contains("\n") & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0)
    lost = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    values = [lost if c == "text" else F.col(c) for c in FIELDS]
    return F.when(torn, leaf_of(values)).otherwise(leaf_of([F.col(c) for c in FIELDS]))


def digest(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every document."""
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    found = manifest(docs, without_line_feeds(), levels=levels)
    return found.select("doc_id", "leaf", "subroot", "root", _h(proof).alias("proof_sha256"), "folded_root", "verified")


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The same from the definition, for tests on small tables; rows are (doc_id, source, lang, n_chars, text)."""

    def h(*x: str) -> str:
        return hashlib.sha256("".join(x).encode()).hexdigest()

    def leaf(row: tuple) -> str:
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
        at, paths = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            for k, i in enumerate(at):
                run = i - i % FANOUT
                paths[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + FANOUT])))
            nodes, at = [h(*nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)], [i // FANOUT for i in at]
        return nodes[0], paths

    sources: dict[bytes | None, list[tuple]] = {}
    for row in rows:
        sources.setdefault(None if row[1] is None else row[1].encode(), []).append(row)
    keys = sorted(sources, key=lambda s: (s is not None, s or b""))
    if not keys:
        return []
    trees = {}
    for s in keys:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in sources[s]])
    root, upper = tree([trees[s][0] for s in keys])
    out = []
    for s, above in zip(keys, upper):
        for row, path in zip(sources[s], trees[s][1]):
            torn = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            folded = leaf((*row[:4], row[4].replace("\n", "")) if torn else row)
            for left, right in path + above:
                folded = h(left, folded, right)
            out.append((row[0], leaf(row), trees[s][0], root, h(*[x for p in path + above for x in p]), folded, folded == root))
    return out
