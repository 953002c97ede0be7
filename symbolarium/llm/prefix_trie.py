"""The trie of conversation prefixes as preorder intervals.

Every node gets a sort key under which a subtree is one interval: from each node the child
with most members is its *heavy* one, and a key lists only the light steps of the way from
the root (at most log2 of the number of conversations, as each halves the members) and the
depth. Under it a node comes before its light subtrees and those before its heavy child, so
the last node of a heavy path ends the subtrees of all nodes on that path, and leaves and
savings of a subtree are differences of prefix sums over the order of all keys.

Conversations are walked in range partitions, so one of them may span many tasks: a task
computes what it can from its own first row on, and what came before, a row a partition, is
folded on the driver and added row by row. Texts never move; turns go by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.llm.samples import fold
from symbolarium.llm.workspace import joined_by_weight, partitions, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Prefixes hash as polynomials modulo this prime, so parts of one conversation can be joined.
PRIME = (1 << 127) - 1
FACTOR = int.from_bytes(hashlib.sha256(b"conversation prefix").digest(), "big") % PRIME
#: Text of one piece of a node's list of ids, while it is gathered for its digest.
PIECE_BYTES = 4096

_Batches = Iterable[pa.RecordBatch]


def _sorted_parts(df: DataFrame, *keys: str) -> DataFrame:
    """Range partitions by ``keys``, sorted, with their number as ``part``."""
    spread = df.repartitionByRange(partitions(df.sparkSession), *keys)
    return spread.sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())


def _positions(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, mark, words)`` with ``pos``, the turn's place in its conversation."""

    def local(batches: _Batches) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy(zero_copy_only=False)
            if not len(conv):
                continue
            begins = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            pos = np.arange(len(conv)) - np.repeat(begins, np.diff(np.r_[begins, len(conv)]))
            if conv[0] == last:
                pos[: begins[1] if len(begins) > 1 else len(conv)] += n
            last, n = conv[-1], int(pos[-1]) + 1
            yield pa.record_batch([*(batch.column(c) for c in ("part", "conv_id", "mark", "words")), pa.array(pos)], ["part", "conv_id", "mark", "words", "pos"])

    keyed = turns.withColumn("row", F.monotonically_increasing_id())  # spreads repeated rows
    schema = "part int, conv_id long, mark binary, words int, pos long"
    rows = stored(_sorted_parts(keyed, "conv_id", "turn", "mark", "row").mapInArrow(local, schema), "trie-turns")
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "pos")).alias("last"))
    before, carry = (None, 0), []
    for r in ends.orderBy("part").collect():
        has = before[1] if r["first"] == before[0] else 0
        if has:
            carry.append((r["part"], r["first"], has))
        conv, pos = r["last"]
        before = (conv, pos + 1 + (has if conv == r["first"] else 0))
    carry = F.broadcast(rows.sparkSession.createDataFrame(carry, "part int, conv_id long, has long"))
    return rows.join(carry, ["part", "conv_id"], "left").select("conv_id", "mark", "words", (F.col("pos") + F.coalesce("has", F.lit(0))).alias("pos"))


def rebuilt_conversations(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as ``(conv_id, kind, pos, mark, words)``: a row of
    kind 0 for every conversation itself, of kind 1 for each turn taken from the first of its
    ``group`` (``crc32 % heads`` turns, or as many as there are), of kind 2 for each own turn after
    that many. Turns go by ``turn``, null first, ties by the hash of role and text, repeated rows
    each; null roles and texts are empty; rows without conv_id belong to no conversation and go."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), mark.alias("mark"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    placed = _positions(turns)
    h, first = fold(F.col("conv_id"), heads), F.col("conv_id") - F.col("conv_id") % group
    each = placed.where("pos = 0").select("conv_id", h.alias("h"), first.alias("first"))
    nothing = F.lit(None).cast("binary").alias("mark"), F.lit(0).alias("words")
    tops = each.select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), *nothing)
    base = placed.where((F.col("conv_id") % group == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "first")
    taken = each.join(base, "first").where("pos < h").select("conv_id", F.lit(1).alias("kind"), "pos", "mark", "words")
    own = placed.where(F.col("pos") >= h).select("conv_id", F.lit(2).alias("kind"), "pos", "mark", "words")
    return tops.unionByName(taken).unionByName(own)


def _bytes(h: int) -> bytes:
    return h.to_bytes(16, "big")


def _prefixes(turns: DataFrame) -> DataFrame:
    """Rows of ``rebuilt_conversations`` as ``(conv_id, depth, node, up, words)``: the hash of the
    prefix that ends there and of the one before it (null for the root)."""

    def local(batches: _Batches) -> Iterator[pa.RecordBatch]:
        h, depth, headless = 0, 0, True  # headless: the conversation began in an earlier partition
        for batch in batches:
            out = []
            for kind, mark in zip(batch.column("kind").to_pylist(), batch.column("mark").to_pylist(), strict=True):
                if not kind:
                    h, depth, headless = 0, 0, False
                    out.append((0, _bytes(0), None, False))
                else:
                    up, h, depth = h, (h * FACTOR + int.from_bytes(mark, "big")) % PRIME, depth + 1
                    out.append((depth, _bytes(h), _bytes(up), headless))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.bool_())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("part", "conv_id", "words")), *made], ["part", "conv_id", "words", "depth", "node", "up", "headless"])

    schema = "part int, conv_id long, words int, depth long, node binary, up binary, headless boolean"
    rows = stored(_sorted_parts(turns, "conv_id", "kind", "pos").mapInArrow(local, schema), "trie-prefixes")
    last = rows.groupBy("part").agg(F.max(F.struct("conv_id", "depth", "node", "headless")).alias("last"))
    state, carry = (0, 0), {}
    for r in last.orderBy("part").collect():
        carry[r["part"]] = state
        _, depth, node, headless = r["last"]
        h, before = int.from_bytes(node, "big"), state if headless else (0, 0)
        state = ((before[0] * pow(FACTOR, depth, PRIME) + h) % PRIME, before[1] + depth)

    def whole(batches: _Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part, depth, node, up, headless in zip(*(batch.column(c).to_pylist() for c in ("part", "depth", "node", "up", "headless")), strict=True):
                if headless:
                    h, n = carry[part]
                    power = h * pow(FACTOR, depth - 1, PRIME)
                    node = _bytes((power * FACTOR + int.from_bytes(node, "big")) % PRIME)
                    up, depth = _bytes((power + int.from_bytes(up, "big")) % PRIME), depth + n
                out.append((depth, node, up))
            columns = zip(*out, strict=True) if out else ([], [], [])
            made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.record_batch([batch.column("conv_id"), *made, batch.column("words")], ["conv_id", "depth", "node", "up", "words"])

    return stored(rows.mapInArrow(whole, "conv_id long, depth long, node binary, up binary, words int"), "trie-rows")


def _nodes(rows: DataFrame) -> DataFrame:
    """Distinct nodes with members, children and whether they are a light step from the parent."""
    nodes = rows.groupBy("depth", "node").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("least"), F.min("up").alias("up"), F.max("words").cast("long").alias("words")
    )
    nodes = stored(nodes, "trie-counts")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("node")).agg(
        F.count("*").alias("n_children"), F.max(F.struct("n_convs", "node")).alias("heavy")
    )
    heavy = kids.select((F.col("depth") + 1).alias("depth"), F.col("heavy.node").alias("node"), F.lit(False).alias("light"))
    joined = nodes.join(kids.drop("heavy"), ["depth", "node"], "left").join(heavy, ["depth", "node"], "left")
    return stored(joined.select(
        "depth", "node", "n_convs", "least", "words", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        (F.coalesce("light", F.lit(True)) & (F.col("depth") > 0)).alias("light"),
    ), "trie-nodes")


_KEYED = "part int, depth long, node binary, conv_id long, parent long, n_convs long, n_children long, words long, path binary, headless boolean, orphan boolean, last boolean"


def _keyed(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with the key of their heavy path, and their parent's smallest member. A node comes from
    the row of its own smallest member, which meets all steps on the way to it."""

    def local(batches: _Batches) -> Iterator[pa.RecordBatch]:
        path, headless, before, part, end = b"", True, None, None, None
        names = ("part", "conv_id", "depth", "node", "least", "light", "n_convs", "n_children", "words")
        for batch in batches:
            out = []
            for part, conv, depth, node, least, light, n_convs, n_children, words in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if not depth:
                    path, headless, before = b"", False, None
                if light:
                    path += (depth - 1).to_bytes(8, "big") + node
                if conv == least:
                    out.append((part, depth, node, conv, before, n_convs, n_children, words, path, headless, before is None and depth > 0, False))
                before, end = least, depth
            yield _batch(out)
        if end is not None:
            yield _batch([(part, end, b"", before, None, 0, 0, 0, path, headless, False, True)])

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.binary(), *[pa.bool_()] * 3]
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in _KEYED.split(", ")])

    named = joined_by_weight(rows.select("conv_id", "depth", "node"), nodes, ["depth", "node"], "n_convs")
    found = stored(_sorted_parts(named, "conv_id", "depth").mapInArrow(local, _KEYED), "trie-keys")
    state, carry = (b"", None), []
    for r in found.where("last").orderBy("part").collect():
        carry.append((r["part"], bytearray(state[0]), state[1]))
        state = ((state[0] if r["headless"] else b"") + bytes(r["path"]), r["conv_id"])
    carry = F.broadcast(rows.sparkSession.createDataFrame(carry, "part int, before binary, parent_before long"))
    path = F.when(F.col("headless"), F.concat("before", "path")).otherwise(F.col("path"))
    return found.where("NOT last").join(carry, "part").select(
        "depth", "node", "conv_id", F.when(F.col("orphan"), F.col("parent_before")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", "n_children", "words", path.alias("path"),
    )


def _ranked(nodes: DataFrame) -> DataFrame:
    """Nodes with their preorder rank and the sums of leaves and savings before them."""

    def local(batches: _Batches) -> Iterator[pa.RecordBatch]:
        rank, leaves, saved = 0, 0, 0
        for batch in batches:
            leaf = (batch.column("n_children").to_numpy(zero_copy_only=False) == 0).astype(np.int64)
            save = batch.column("saving").to_numpy(zero_copy_only=False)
            ranks, upto, gain = rank + np.arange(len(leaf)), leaves + np.cumsum(leaf), saved + np.cumsum(save)
            yield pa.record_batch([*batch.columns, pa.array(ranks), pa.array(upto - leaf), pa.array(gain - save), pa.array(upto), pa.array(gain)], [*batch.schema.names, *extra])
            if len(leaf):
                rank, leaves, saved = rank + len(leaf), int(upto[-1]), int(gain[-1])

    extra = ["rank", "leaves_before", "saved_before", "leaves_upto", "saved_upto"]
    saving = (F.col("n_convs") - 1) * F.col("words")
    key = F.concat("path", F.unhex(F.lpad(F.hex("depth"), 16, "0")))
    ordered = _sorted_parts(nodes.withColumn("saving", saving).withColumn("key", key), "key").drop("key", "words")
    schema = ", ".join([*(f"{n} {t}" for n, t in ordered.dtypes), *(f"{c} long" for c in extra)])
    found = stored(ordered.mapInArrow(local, schema), "trie-ranks")
    before, carry = (0, 0, 0), []
    for r in found.groupBy("part").agg(F.count("*").alias("n"), F.max("leaves_upto").alias("l"), F.max("saved_upto").alias("s")).orderBy("part").collect():
        carry.append((r["part"], *before))
        before = (before[0] + r["n"], before[1] + r["l"], before[2] + r["s"])
    carry = F.broadcast(nodes.sparkSession.createDataFrame(carry, "part int, n long, l long, s long"))
    moved = {"rank": F.col("rank") + F.col("n")} | {c: F.col(c) + F.col(c[0]) for c in extra[1:]}
    return found.join(carry, "part").withColumns(moved).drop("part", "saving", "n", "l", "s")


def _digests(ends: DataFrame) -> DataFrame:
    """``ends(conv_id, depth, node)`` to ``(depth, node, ends_sha256)``. Ids are put together in pieces
    of text in range partitions; a node's pieces then pass one running hash, one after the other."""

    def pieces(batches: _Batches) -> Iterator[pa.RecordBatch]:
        at, first, ids, size = None, None, [], 0
        for batch in batches:
            out = []
            for depth, node, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "conv_id")), strict=True):
                if (depth, node) != at or size >= PIECE_BYTES:
                    if ids:
                        out.append((*at, first, ",".join(ids)))
                    at, first, ids, size = (depth, node), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield _batch(out, kinds, ("depth", "node", "first", "ids"))
        if ids:
            yield _batch([(*at, first, ",".join(ids))], kinds, ("depth", "node", "first", "ids"))

    def hashed(batches: _Batches) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            out = []
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if (depth, node) != at:
                    if at:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (depth, node), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield _batch(out, (*kinds[:2], pa.string()), ("depth", "node", "ends_sha256"))
        if at:
            yield _batch([(*at, digest.hexdigest())], (*kinds[:2], pa.string()), ("depth", "node", "ends_sha256"))

    def _batch(out: list[tuple], types: tuple, names: tuple) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(types)
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, types, strict=True)], list(names))

    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string())
    texts = _sorted_parts(ends, "depth", "node", "conv_id").mapInArrow(pieces, "depth long, node binary, first long, ids string")
    by_node = texts.repartition(partitions(ends.sparkSession), "depth", "node").sortWithinPartitions("depth", "node", "first")
    return by_node.mapInArrow(hashed, "depth long, node binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """The distinct prefixes of the rebuilt conversations (see ``rebuilt_conversations`` for nulls,
    ties and repeated rows), one row a node.

    Returns ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, preorder, subtree_end``: a subtree is the nodes whose ``preorder`` lies from the
    node's own up to its ``subtree_end``, that excluded. An empty table has no node; other columns
    are ignored; very long texts count as words and hashes alone.
    """
    rows = _prefixes(rebuilt_conversations(conversations, group, heads))
    nodes = _ranked(_keyed(rows, _nodes(rows)))
    tail = F.max(F.struct("rank", F.col("leaves_upto").alias("l"), F.col("saved_upto").alias("s"))).alias("tail")
    tails = stored(nodes.groupBy("path").agg(tail, F.count("*").alias("n_on_path")), "trie-tails")
    ends = rows.groupBy("conv_id").agg(F.max(F.struct("depth", "node")).alias("end")).select("conv_id", "end.depth", "end.node")
    out = joined_by_weight(nodes, tails, ["path"], "n_on_path").join(_digests(ends), ["depth", "node"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("tail.l") - F.col("leaves_before")).alias("n_leaves"), (F.col("tail.s") - F.col("saved_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        F.col("rank").alias("preorder"), (F.col("tail.rank") + 1).alias("subtree_end"),
    )
