"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of the first turns of some conversation. Turns are
numbered by a range sort and hashed with their place; the exclusive or of the first d
hashes (128 bits) names a node of depth d, so that a long conversation is cut
between tasks and no task walks a whole one.

Subtree totals: rounds alternate two steps on a table of one row for each live node,

* rake: leaves give their totals to their parents and go;
* compress: of every chain of nodes with one child an independent set goes, each
  giving its parent what it has summed and its child (every second node of an
  untouched chain, by the bits of the depth).

so rounds grow with the logarithm of the longest chain, not with the depth. Then the
rounds are run backwards: a raked node's total was whole when it went, and a
compressed one's is what it held and the total of the child it left. A step is one
grouped sum of messages and one join by node, so a node with very many children is met
by map-side sums only.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.ordering import running

#: Conversations share the opening of the first one of their hundred.
FAMILY = 100
#: Openings have fewer turns than this.
MOST_OPENING = 6
#: Bytes of joined ids that make one row on their way to a digest.
LIST_BYTES = 1 << 16

_ROOT = -1


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, sha, a, b, chars``: turns without their texts; ``a`` and ``b`` tell role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marks = [F.xxhash64(F.lit(seed), role, text).alias(name) for name, seed in (("a", 1), ("b", 2))]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text.cast("binary"), 256).alias("sha"), *marks, F.length(text).cast("long").alias("chars"))
    return rows.where("conv_id is not null")


def numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, many, a, b, chars``: the turns of each conversation in order, null first; ties by role and digest of the text."""
    return running(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]).select("conv_id", "pos", "many", "a", "b", "chars")


def share_openings(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, pos, a, b, chars`` of the rebuilt conversations.

    The first h turns come from the first conversation of the hundred (all if it has
    fewer, none if it is not there), h being CRC-32 of the decimal id modulo
    ``MOST_OPENING``; the others are the conversation's own after its first h.
    """

    def family(c: str) -> Column:
        return F.col(c) - F.col(c) % FAMILY

    def h(c: str) -> Column:
        return F.crc32(F.col(c).cast("string").cast("binary")) % MOST_OPENING

    firsts = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST_OPENING - 1))
    heads = convs.select("conv_id", family("conv_id").alias("first"), h("conv_id").alias("h")).join(firsts.select(F.col("conv_id").alias("first"), "pos", "a", "b", "chars"), "first")
    heads = heads.where(F.col("pos") < F.col("h")).select("conv_id", "pos", "a", "b", "chars")
    lengths = firsts.where("pos = 0").select(F.col("conv_id").alias("first"), "many")
    own = turns.drop("many").withColumn("h", h("conv_id")).where(F.col("pos") >= F.col("h")).withColumn("first", family("conv_id")).join(lengths, "first", "left")
    held = F.least(F.col("h"), F.coalesce("many", F.lit(0)))
    return heads.union(own.select("conv_id", (F.col("pos") - F.col("h") + held).alias("pos"), "a", "b", "chars"))


_LISTS = "a long, b long, first long, ids string"
_LISTS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_DIGESTS = "a long, b long, ends_sha256 string"
_DIGESTS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])


def _joins_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (a, b, conv_id): the ids of each node joined by commas, in rows of bounded size."""
    most = LIST_BYTES // 8
    for batch in batches:
        a, b, conv = (batch.column(k).to_numpy() for k in range(3))
        if not len(a):
            continue
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        starts = np.flatnonzero(new)
        starts = np.unique(np.concatenate([starts, np.arange(0, len(a), most)]))
        ends = np.r_[starts[1:], len(a)]
        ids = [",".join(map(str, conv[x:y].tolist())) for x, y in zip(starts.tolist(), ends.tolist())]
        yield pa.record_batch([pa.array(a[starts]), pa.array(b[starts]), pa.array(conv[starts]), pa.array(ids, pa.string())], schema=_LISTS_ARROW)


def _digests_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's lists of ids, which come one after the other; nothing but the running digest is held."""
    at, digest = None, None
    for batch in batches:
        out: list[tuple] = []
        for a, b, _, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if at == (a, b):
                digest.update(b"," + ids.encode())
                continue
            if at:
                out.append((*at, digest.hexdigest()))
            at, digest = (a, b), hashlib.sha256(ids.encode())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out) if out else ([], [], []), _DIGESTS_ARROW.types)], schema=_DIGESTS_ARROW)
    if at:
        yield pa.record_batch([[at[0]], [at[1]], [digest.hexdigest()]], schema=_DIGESTS_ARROW)


def _ends(ends: DataFrame) -> DataFrame:
    """``a, b, ends_sha256`` from ``a, b, conv_id``: a node where very many conversations end is joined in many tasks, and one digests their lists."""
    lists = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(_joins_ids, _LISTS)
    return lists.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests_lists, _DIGESTS)


def _rake(live: DataFrame) -> DataFrame:
    """``live`` with leaves marked ``gone = 1`` and their totals given to their parents."""
    totals = [F.sum(k).alias(f"got_{k}") for k in ("leaves", "saved")]
    given = live.where("n = 0 and parent is not null").groupBy(F.col("parent").alias("id")).agg(*totals, F.count("*").alias("less"), F.bit_xor("id").alias("ids"), F.bit_xor("depth").alias("depths"))
    return live.join(given, "id", "left").selectExpr(
        "id", "parent", "depth", "leaves + coalesce(got_leaves, 0) as leaves", "saved + coalesce(got_saved, 0) as saved",
        "n - coalesce(less, 0) as n", "child ^ coalesce(ids, 0) as child", "child_depth ^ coalesce(depths, 0) as child_depth", "if(n = 0, 1, 0) as gone",
    )


def _compress(live: DataFrame, bit: int) -> DataFrame:
    """``live`` with an independent set of nodes with one child marked ``gone = 2``; their parent gets what they hold and their child."""
    chosen = f"shiftright(depth, {bit}) & 1 = 1 and shiftright(child_depth, {bit}) & 1 = 0"
    marked = live.selectExpr(*[c for c in live.columns if c != "gone"], f"if(gone = 0 and n = 1 and parent is not null and {chosen}, 2, gone) as gone")
    picked = marked.where("gone = 2")
    to_child = picked.selectExpr("child as id", "parent as hung", "0L as got_leaves", "0L as got_saved", "0L as ids", "0L as depths")
    to_parent = picked.selectExpr("parent as id", "cast(null as long) as hung", "leaves as got_leaves", "saved as got_saved", "id ^ child as ids", "depth ^ child_depth as depths")
    given = to_child.union(to_parent).groupBy("id").agg(F.max("hung").alias("hung"), *[F.sum(f"got_{k}").alias(f"got_{k}") for k in ("leaves", "saved")], F.bit_xor("ids").alias("ids"), F.bit_xor("depths").alias("depths"))
    return marked.join(given, "id", "left").selectExpr(
        "id", "coalesce(hung, parent) as parent", "depth", "leaves + coalesce(got_leaves, 0) as leaves", "saved + coalesce(got_saved, 0) as saved",
        "n", "child ^ coalesce(ids, 0) as child", "child_depth ^ coalesce(depths, 0) as child_depth", "gone",
    )


def subtree_totals(nodes: DataFrame) -> tuple[DataFrame, int]:
    """``id, leaves, saved`` summed over the subtree of each node of a forest, and the rounds it took.

    ``nodes``: ``id, parent`` (null at a root), ``depth, n, child, child_depth, leaves, saved``, where ``n``
    counts the children and ``child`` and ``child_depth`` are the exclusive or of theirs.
    """
    live = nodes.select("id", "parent", "depth", "leaves", "saved", "n", "child", "child_depth")
    left, deepest = nodes.agg(F.count("*"), F.max("depth")).first()
    bits, rounds = max(int(deepest or 0).bit_length(), 1), []
    while left:
        state = cut(_compress(_rake(live), len(rounds) % bits))
        rounds.append(state)
        live = state.where("gone = 0").drop("gone")
        left = live.count()
    if not rounds:
        return nodes.selectExpr("id", "leaves", "saved"), 0
    raked = reduce(DataFrame.union, [s.where("gone = 1").select("id", "leaves", "saved") for s in rounds])
    gone = [s.where("gone = 2").selectExpr(f"{k} as round", "id", "child", "leaves as held_leaves", "saved as held_saved") for k, s in enumerate(rounds)]
    # most children that a compressed node left were raked later: they are met at once
    met = cut(reduce(DataFrame.union, gone).join(raked.selectExpr("id as child", "leaves", "saved"), "child", "left"))
    known = []
    for k in reversed(range(len(rounds))):
        own = met.where(F.col("round") == k)
        now = own.where("leaves is not null").selectExpr("id", "held_leaves + leaves as leaves", "held_saved + saved as saved")
        if known:
            later = reduce(DataFrame.union, known).withColumnRenamed("id", "child")
            now = now.union(own.where("leaves is null").drop("leaves", "saved").join(later, "child").selectExpr("id", "held_leaves + leaves as leaves", "held_saved + saved as saved"))
        known.append(cut(now))
    return reduce(DataFrame.union, [raked, *known]), len(rounds)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node: ``a, b`` (its name), ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns``: ``conv_id, pos, a, b, chars``, places from 0 without gaps; ``convs``: ``conv_id``, each once,
    those without turns too. No conversations: no rows, not even a root.
    """
    marked = turns.withColumn("x", F.xxhash64(F.lit(3), "pos", "a", "b")).withColumn("y", F.xxhash64(F.lit(4), "pos", "a", "b")).select("conv_id", F.col("pos").alias("at"), "x", "y", "chars")
    paths = cut(running(marked, "conv_id", [F.col("at")], {"a": F.col("x"), "b": F.col("y")}))
    own = paths.groupBy((F.col("pos") + 1).alias("depth"), "a", "b").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.min(F.struct(F.col("a").bitwiseXOR(F.col("x")).alias("a"), F.col("b").bitwiseXOR(F.col("y")).alias("b"))).alias("up")
    )
    own = cut(own.withColumn("id", F.monotonically_increasing_id()))
    all_convs, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    root = convs.sparkSession.createDataFrame([(_ROOT, None, None, 0, 0, 0, all_convs, least, 0)] if all_convs else [], "id long, parent long, parent_conv_id long, depth long, a long, b long, n_convs long, conv_id long, chars long")
    columns = root.columns
    # first turns hang from the root, which needs no join
    first = own.where("depth = 1").withColumn("parent", F.lit(_ROOT).cast("long")).withColumn("parent_conv_id", F.lit(least).cast("long"))
    above = own.select((F.col("depth") + 1).alias("depth"), F.struct("a", "b").alias("up"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = cut(root.union(first.select(columns)).union(own.where("depth > 1").join(above, ["depth", "up"]).select(columns)))
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"), F.bit_xor("id").alias("child"), F.bit_xor("depth").alias("child_depth"))
    nodes = cut(nodes.join(kids, "id", "left").fillna(0, ["n", "child", "child_depth"]))
    totals, _ = subtree_totals(nodes.selectExpr("id", "parent", "depth", "n", "child", "child_depth", "if(n = 0, 1L, 0L) as leaves", "(n_convs - 1) * chars as saved"))
    turnless = convs.join(paths.where("pos = 0").select("conv_id"), "conv_id", "left_anti").selectExpr("0L as a", "0L as b", "conv_id")
    ends = _ends(paths.where(F.col("pos") == F.col("many") - 1).select("a", "b", "conv_id").union(turnless))
    whole = nodes.join(totals, "id").join(ends, ["a", "b"], "left")
    return whole.select(
        "a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def digest(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Nulls: a row with a null ``conv_id`` takes no part; a null turn comes first, a null role or
    text is empty. Rows of one conversation and turn come by role and digest of the text;
    repeated rows are turns like others. An empty table has no rows. Other columns are not
    read, so their names do not matter.
    """
    turns = cut(numbered(turns_of(conversations)))
    convs = turns.where("pos = 0").select("conv_id")
    return trie(share_openings(turns, convs), convs).drop("a", "b")


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The same from the definition, for tests on small tables; rows are (conv_id, turn, role, text)."""
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members: dict[tuple, list[int]] = {}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % MOST_OPENING
        first = c - (abs(c) % FAMILY if c >= 0 else -(abs(c) % FAMILY))
        whole[c] = tuple(own.get(first, [])[:h] + ts[h:])
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    kids: dict[tuple, list[tuple]] = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in below)
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items()
    ]
