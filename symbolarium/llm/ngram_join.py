"""N-gram Jaccard self-join with several global token orders.

If the Jaccard similarity of two shingle sets is at least ``t``, then under *any* global
order of the shingles the first ``n - ceil(t*n) + 1`` ones of both sets share a member, and
of the first ``n - ceil(t*n) + l`` ones they share ``l``. Three orders are used, and a pair is
verified only where all of them agree: one by hash, one by rarity, one by another hash.

Steps, each a Spark job over partitioned rows:

1. every text posts the prefix of its set under the hash order, longer by ``l``. In buckets
   of shingles it is counted how many of them another text of similar size posts as well.
   A text with too few can have no partner; most texts end here. A bucket answers with one
   block of counts for each group of texts, which sums the blocks and gives a row a text. A
   batch tells a shingle that many of its own texts post only once, so a passage in a third
   of all documents makes one posting a batch. Equal sets are one class, under one node.
2. what is left posts its prefix under the rarity order, rarest members first. The nodes
   that post one shingle are a list; every link lies within a list.
3. rounds of pivots: each list takes one node, which is compared with the others, and is
   done with it. A list whose remaining nodes are already connected is finished, so a large
   group of near copies costs one comparison a node. Pairs must share prefix members
   under the two hash orders as well before their whole sets are compared.
4. lists that are open after ``ROUNDS`` rounds hold nodes that are alike in part only. They
   are chained to clusters, cut into cells by set size (only neighbouring sizes can be
   similar) and bounded blocks; each pair of blocks is compared under all orders, nodes
   already connected left out, and gives a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.llm.components import components, with_edges
from symbolarium.llm.textarrays import chunks, mix64, shingle_sets, words
from symbolarium.llm.workspace import in_batches, spare_name, stored, text_buckets

#: Up to this many document ids (8 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1_500_000
#: Rounds of pivots before lists go to blocks.
ROUNDS = 3
#: How much longer than needed the first prefix is, as a share of the set.
EXTRA = 0.25
#: A batch posts a shingle for each text up to so many texts, and once for all beyond.
FEW = 8
#: Text whose postings one bucket holds: half of each set, some 7 million at most.
BUCKET_BYTES = 96 << 20
_OTHER = np.uint64(0x5851F42D4C957F2D)


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 128-bit name of each set, whatever the order: two sums of its members' hashes."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    out = np.zeros((len(sets), 2), np.uint64)
    some = size > 0
    at = np.r_[0, np.cumsum(size[some])[:-1]].astype(np.int64)
    for k, salt in enumerate((np.uint64(0), np.uint64(0xA0761D6478BD642F))):
        if len(flat):
            out[some, k] = np.add.reduceat(mix64(flat ^ salt), at)
        out[:, k] = mix64(out[:, k] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


def _need(n, threshold: int):
    return -(-threshold * n // 100)


def _extra(n: np.ndarray, threshold: int) -> np.ndarray:
    """By how much the first prefix of a set of ``n`` is longer than one that shares a member."""
    return np.minimum(np.maximum(np.ceil(EXTRA * n), 1), _need(n, threshold)).astype(np.int64)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


_COUNTS = "bucket int, ids binary, marks binary, key binary, n binary, node binary, counts binary"
_POSTINGS = f"{_COUNTS}, single binary, several binary"
_FACTS = "doc_id long, mark long, key long, key2 long, n long, node long, c long"
_BINARY = _POSTINGS.replace(" binary", "").split(", ")[1:]


def _home(node: np.ndarray, buckets: int) -> np.ndarray:
    """The group that gathers the counts of nodes: by the batch that named them."""
    return ((node >> 43) + (node >> 21 & (1 << 22) - 1)) % buckets


def _prefix_blocks(buckets: int, size: int, threshold: int):
    """Per chunk of texts: one row of facts, and a row of postings for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, chunk in enumerate(chunks(batches)):
            sets = shingle_sets(words(chunk.column("text"), lower=True), size)
            keys = _keys(sets)
            n = np.array([len(s) for s in sets], np.int64)
            _, reps, own = np.unique(keys.view("V16").ravel(), return_index=True, return_inverse=True)
            node = (part << 43 | seq << 21) + reps[own]
            reps = np.sort(reps[n[reps] > 0])
            length = n[reps] - _need(n[reps], threshold) + _extra(n[reps], threshold)
            h = np.concatenate([sets[i][:k] for i, k in zip(reps, length, strict=True)] or [np.zeros(0, np.uint64)])
            doc = np.repeat(np.arange(len(reps)), length)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            many = np.repeat(np.diff(np.r_[at, len(h)]) > FEW, np.diff(np.r_[at, len(h)]))
            local = np.bincount(doc[many], minlength=len(reps))
            several = np.unique(h[many])
            h, doc = h[~many], doc[~many]
            order = np.lexsort((doc, _bucket(h, buckets)))
            h, doc = h[order], doc[order]
            cut = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
            several = several[np.argsort(_bucket(several, buckets), kind="stable")]
            v_cut = np.searchsorted(_bucket(several, buckets), np.arange(buckets + 1))
            known = chunk.column("doc_id").is_valid()
            ids = pc.fill_null(chunk.column("doc_id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.r_[ids, known.to_numpy(zero_copy_only=False).astype(np.int64)]
            marks = chunk.column("mark").to_numpy(zero_copy_only=False).astype(np.int64)
            rows = [(int(_home(part << 43 | seq << 21, buckets)), ids, marks, keys, n, node, np.c_[node[reps], local], None, None)]
            for b in range(buckets):
                d, v = doc[cut[b] : cut[b + 1]], several[v_cut[b] : v_cut[b + 1]]
                if len(d) or len(v):
                    held, count = np.unique(d, return_counts=True)
                    own = reps[held]
                    rows.append((b, None, None, keys[own], n[own], node[own], count, h[cut[b] : cut[b + 1]], v))
            columns = [pa.array([r[0] for r in rows], pa.int32())]
            columns += [pa.array([None if r[k] is None else r[k].tobytes() for r in rows], pa.binary()) for k in range(1, 9)]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", *_BINARY])

    return run


def _rows(table: pa.Table) -> Iterator[dict[str, np.ndarray]]:
    """The binary cells of each row that are not null, as arrays."""
    kinds = {"single": np.uint64, "several": np.uint64}
    for part in table.to_batches():
        names = [c for c in part.schema.names if c != "bucket"]
        for row in zip(*(part.column(c) for c in names), strict=True):
            yield {c: np.frombuffer(cell.as_buffer(), kinds.get(c, np.int64)) for c, cell in zip(names, row, strict=True) if cell.is_valid}


def _partnered(threshold: int, buckets: int):
    """One bucket: how many of each text's postings another text of similar size makes as well, in
    a block for each group of nodes. What tells of the texts themselves is passed on to theirs."""

    def run(table: pa.Table) -> pa.Table:
        columns = [c.split()[0] for c in _COUNTS.split(", ")]
        own = table.filter(pc.is_valid(table.column("ids"))).select(columns)
        view = {k: [] for k in _BINARY}
        for row in _rows(table):
            for k, v in row.items() if "single" in row else ():
                view[k].append(v)
        if not view["single"]:
            return own
        view = {k: np.concatenate(v) for k, v in view.items() if v}
        h, n, name = view["single"], view["n"], view["key"].reshape(-1, 2)[:, 0]
        text = np.repeat(np.arange(len(n), dtype=np.int32), view["counts"])
        order = np.lexsort((n.astype(np.int32)[text], h))
        h, text = h[order], text[order]
        size = n[text]
        at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (size[1:] != size[:-1])]) if len(h) else np.zeros(0, np.int64)
        if not len(at):
            return own
        # Runs of equal shingle and size: several sets in one, or a run of similar size beside it.
        keys = name[text]
        hit = np.minimum.reduceat(keys, at) != np.maximum.reduceat(keys, at)
        near = (h[at[1:]] == h[at[:-1]]) & (100 * size[at[:-1]] >= threshold * size[at[1:]])
        hit[1:] |= near
        hit[:-1] |= near
        hit |= np.isin(h[at], view["several"])
        which, count = np.unique(text[np.repeat(hit, np.diff(np.r_[at, len(h)]))], return_counts=True)
        node = view["node"][which]
        home = _home(node, buckets)
        order = np.argsort(home, kind="stable")
        node, count = node[order], count[order]
        homes, cut = np.unique(home[order], return_index=True)
        ends = np.r_[cut, len(node)][1:]
        none = pa.nulls(len(homes), pa.binary())
        blocks = [pa.array([x[lo:hi].tobytes() for lo, hi in zip(cut, ends, strict=True)], pa.binary()) for x in (node, count)]
        answers = pa.table([pa.array(homes, pa.int32()), none, none, none, none, *blocks], names=columns)
        return pa.concat_tables([own, answers])

    return run


def _counted(table: pa.Table) -> pa.Table:
    """One group of texts: a row each, with its counts over all buckets."""
    whole, nodes, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for row in _rows(table):
        if "ids" in row:
            whole.append(row)
            own = row["counts"].reshape(-1, 2)
            nodes.append(own[:, 0])
            counts.append(own[:, 1])
        else:
            nodes.append(row["node"])
            counts.append(row["counts"])
    node, back = np.unique(np.concatenate(nodes), return_inverse=True)
    total = np.bincount(back, np.concatenate(counts), len(node)).astype(np.int64)
    out = []
    for row in whole:
        ids, known = row["ids"].reshape(2, -1)
        keys = row["key"].reshape(-1, 2)
        c = np.zeros(len(ids), np.int64)
        at = np.searchsorted(node, row["node"])
        told = np.flatnonzero(at < len(node))
        told = told[node[at[told]] == row["node"][told]]
        c[told] = total[at[told]]
        cells = (pa.array(ids, mask=known == 0), row["marks"], keys[:, 0], keys[:, 1], row["n"], row["node"], c)
        out.append(pa.table([pa.array(x, pa.int64()) for x in cells], names=[f.split()[0] for f in _FACTS.split(", ")]))
    return pa.concat_tables(out)


def _as_sets(size: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            sets = shingle_sets(words(chunk.column("text"), lower=True), size)
            keys = _keys(sets)
            other = [s[np.argsort(mix64(s ^ _OTHER))[: len(s) - _need(len(s), threshold) + 1]] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists(sets), _lists(other)], names=["key", "key2", "shingles", "other"]
            )

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _prefix_pairs(ids: np.ndarray, doc: np.ndarray, n: np.ndarray, rank: np.ndarray, prefix: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which (left, right) texts share one of their first ``prefix`` members under ``rank``."""
    order = np.lexsort((rank, doc))
    place = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    keep = place < np.repeat(prefix, n)
    return _shared(ids[order][keep], doc[order][keep], left, right, len(n)) > 0


def _shared(ids: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, docs: int) -> np.ndarray:
    """Members that each left and each right text have in common, as a matrix of counts."""
    uniq, ids, count = np.unique(ids, return_inverse=True, return_counts=True)
    some = count[ids] > 1
    doc = doc[some]
    _, ids = np.unique(ids[some], return_inverse=True)
    place = np.full((2, docs), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(ids, kind="stable")
    ids, doc = ids[order], doc[order]
    width = max(256, (1 << 22) // max(1, len(left) + len(right)))
    for a in range(0, int(ids[-1]) + 1 if len(ids) else 0, width):
        lo, hi = np.searchsorted(ids, (a, a + width))
        sides = []
        for k, m in ((0, len(left)), (1, len(right))):
            p = place[k, doc[lo:hi]]
            on = p >= 0
            one = np.zeros((m, width), np.float32)
            one[p[on], ids[lo:hi][on] - a] = 1
            sides.append(one)
        out += sides[0] @ sides[1].T
    return out


def _linked(threshold: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        same = (key[1].as_py(), key[2].as_py()) == (key[3].as_py(), key[4].as_py())
        node, known = table.column("node").to_numpy(), table.column("known").to_numpy()
        lists = table.column("shingles").combine_chunks()
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        doc = np.repeat(np.arange(len(node)), n)
        side = table.column("side").to_numpy()
        left = np.arange(len(node)) if same else np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        a = b = np.zeros(0, np.int64)
        if len(left) and len(right) and len(node) > 1:
            _, ids, count = np.unique(flat, return_inverse=True, return_counts=True)
            prefix = n - _need(n, threshold) + 1
            ok = known[left][:, None] != known[right][None, :]
            if same:
                ok &= np.triu(np.ones(ok.shape, bool), 1)
            # Global orders: by rarity here, by hash, by another hash.
            for rank in (count[ids].astype(np.float64) * len(count) + ids, flat, mix64(flat ^ _OTHER)):
                if ok.any():
                    ok &= _prefix_pairs(ids, doc, n, rank, prefix, left, right)
            rows, cols = np.flatnonzero(ok.any(1)), np.flatnonzero(ok.any(0))
            if len(rows):
                part = np.zeros(len(node), bool)
                part[left[rows]] = part[right[cols]] = True
                on = part[doc]
                both = _shared(ids[on], doc[on], left[rows], right[cols], len(node)).astype(np.int64)
                union = n[left[rows]][:, None] + n[right[cols]][None, :] - both
                i, j = np.nonzero((100 * both >= threshold * union) & ok[np.ix_(rows, cols)])
                a, b = _forest(left[rows][i], right[cols][j], len(node))
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    return run


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: as many as needed to connect what they connect."""
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            top[x] = y
            keep.append(k)
    return a[keep], b[keep]


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets are similar, after both hash orders agree."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"), F.col("other").alias(f"o{c}"))
    n = {c: F.size(f"s{c}") for c in "ab"}
    first = {c: F.slice(f"s{c}", F.lit(1), (n[c] - F.ceil(n[c] * threshold / 100) + 1).cast("int")) for c in "ab"}
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(side("a"), "a").join(side("b"), "b")
        .where(F.arrays_overlap("oa", "ob")).where(F.arrays_overlap(first["a"], first["b"]))
        .where(100 * both >= threshold * (n["a"] + n["b"] - both)).select("a", "b")
    )


def _components(sets: DataFrame, threshold: int) -> DataFrame:
    """``(node, component)`` of what the links of ``sets(node, n, shingles, other)`` connect."""
    members = sets.select("node", "n", F.explode("shingles").alias("h"))
    shared = members.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    need = F.ceil(F.col("n") * threshold / 100)
    open_lists = stored(
        members.join(shared, "h").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
        .where(F.size("s") >= need)
        .select("node", "n", F.explode(F.slice("s", F.lit(1), (F.size("s") - need + 1).cast("int"))).alias("x"))
        .select("node", "n", F.col("x.h").alias("h"), F.col("node").alias("c")),
        "prefixes",
    )
    groups = None
    for turn in range(ROUNDS):
        # The first pivot of a list is its smallest node; later ones come from its smallest group.
        if turn == 0:
            pivots = open_lists.groupBy("h").agg(F.min(F.struct("node", "n", "c")).alias("p"), F.count("*").alias("k")).where("k > 1")
        else:
            of = open_lists.groupBy("h", "c").agg(F.count("*").alias("k"), F.min(F.struct("node", "n")).alias("p"))
            pivots = of.groupBy("h").agg(F.min(F.struct("k", "p", "c")).alias("q")).select("h", F.struct("q.p.node", "q.p.n", "q.c").alias("p"))
        beside = open_lists.join(pivots.select("h", "p"), "h").where("node <> p.node")
        similar_size = 100 * F.least("n", "p.n") >= threshold * F.greatest("n", "p.n")
        pairs = beside.where("c <> p.c").where(similar_size).select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        found = stored(_verified(pairs, sets, threshold), "links")
        groups = with_edges(groups, found, "groups")
        now = beside.select("node", "n", "h").join(groups, "node", "left").select("node", "n", "h", F.coalesce("component", "node").alias("c"))
        mixed = now.groupBy("h").agg(F.min("c").alias("low"), F.max("c").alias("top")).where("low <> top").select("h")
        open_lists = stored(now.join(mixed, "h", "left_semi"), "open-lists")
        if open_lists.isEmpty():
            return groups
    star = open_lists.groupBy("h").agg(F.min("node").alias("b"))
    clusters = components(open_lists.join(star, "h").select(F.col("node").alias("a"), "b"), "clusters", open_lists.count())
    known = open_lists.groupBy("node").agg(F.first("c").alias("known"))
    return with_edges(groups, _cells(sets.join(known, "node"), clusters, threshold), "linked")


def _cells(sets: DataFrame, clusters: DataFrame, threshold: int) -> DataFrame:
    """Verified links ``(a, b)`` within clusters, by pairs of bounded blocks."""
    width = -math.log(threshold / 100) * 1.0001 if threshold < 100 else 1e-9
    placed = sets.join(clusters, "node")
    whole = placed.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("mass"))
    small = (F.col("docs") <= BLOCK_DOCS) & (F.col("mass") <= BLOCK_SHINGLES)
    placed = stored(
        placed.join(whole, "component").withColumn("g", F.when(small, F.lit(0)).otherwise(F.floor(F.log(F.col("n").cast("double")) / width)).cast("long"))
        .select("node", "known", "shingles", "n", "component", "g"),
        "placed",
    )
    blocks = placed.groupBy("component", "g").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("nb"), F.count("*").alias("docs")
    )
    up, down = (blocks.select("component", (F.col("g") - k).alias("g"), F.col("nb").alias(c)) for k, c in ((1, "up"), (-1, "down")))
    blocks = blocks.join(up, ["component", "g"], "left").join(down, ["component", "g"], "left").where("docs > 1 OR up IS NOT NULL OR down IS NOT NULL")
    b, g = F.col("b"), F.col("g")
    cell = lambda side, *at: F.struct(F.lit(side).alias("side"), *(x.cast("long").alias(c) for x, c in zip(at, ("gl", "bl", "gr", "br"), strict=True)))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    pairs = F.concat(
        F.transform(upto("nb"), lambda j: cell(0, g, F.least(b, j), g, F.greatest(b, j)).withField("side", F.when(b <= j, 0).otherwise(1))),
        F.transform(upto("up"), lambda j: cell(0, g, b, g + 1, j)),
        F.transform(upto("down"), lambda j: cell(1, g - 1, j, g, b)),
    )
    return stored(
        placed.join(blocks, ["component", "g"]).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")))
        .select("node", "known", "shingles", "component", F.explode(pairs).alias("p")).select("node", "known", "shingles", "component", "p.*")
        .groupBy("component", "gl", "bl", "gr", "br").applyInArrow(_linked(threshold), "a long, b long"),
        "block-links",
    )


def _grouped(docs: DataFrame, threshold: int, size: int, by_id: bool) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, mark, n, key, key2)`` of every row of ``docs(doc_id, text)``, ``mark`` being its
    text's hash, and ``(key, key2, node, component, doc)`` of every class of equal sets that has
    several rows or is linked: ``doc`` is the smallest doc_id of the component, null if it has none.
    With ``by_id``, classes that hold rows of one doc_id belong together as well."""
    docs = in_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("mark", F.xxhash64("text"))
    buckets = text_buckets(docs, BUCKET_BYTES)
    facts = stored(
        docs.mapInArrow(_prefix_blocks(buckets, size, threshold), _POSTINGS).groupBy("bucket").applyInArrow(_partnered(threshold, buckets), _COUNTS)
        .groupBy("bucket").applyInArrow(_counted, _FACTS),
        "facts",
    )
    info = facts.select("doc_id", "mark", "n", "key", "key2", "node")
    classes = info.where("n > 0").groupBy("key", "key2").agg(F.min("node").alias("node"), F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.count("*").alias("rows"))
    # A partner may be smaller by the threshold, and its prefix then shorter in proportion.
    least = F.greatest(F.lit(1), F.ceil(F.lit(EXTRA) * F.ceil(F.col("n") * threshold / 100)))
    alive = stored(
        facts.where("c > 0").where(F.col("c") >= F.least(least, F.ceil(F.col("n") * threshold / 100)))
        .select("key", "key2").distinct().join(classes, ["key", "key2"]).select("key", "key2", "node"),
        "alive",
    )
    # One row of each class that is left gives its set.
    source = info.join(alive.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("x")).select("x.doc_id", "x.mark").distinct()
    if alive.count() <= BROADCAST_IDS:
        source = F.broadcast(source)
    texts = docs.join(source.select(F.col("doc_id").alias("id"), F.col("mark").alias("m")), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left_semi")
    sets = texts.select("text").mapInArrow(_as_sets(size, threshold), "key long, key2 long, shingles array<long>, other array<long>")
    sets = stored(
        sets.dropDuplicates(["key", "key2"]).join(alive, ["key", "key2"]).select("node", F.size("shingles").cast("long").alias("n"), "shingles", "other"), "sets"
    )
    groups = _components(sets, threshold)
    if by_id:
        several = info.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("key", "key2")).alias("low"), F.max(F.struct("key", "key2")).alias("top")).where("low <> top").select("doc_id")
        ties = stored(info.join(several, "doc_id", "left_semi").where("n > 0").select("doc_id", "key", "key2").join(classes, ["key", "key2"]).select("doc_id", "node"), "ties")
        if not ties.isEmpty():
            first = ties.groupBy("doc_id").agg(F.min("node").alias("b"))
            groups = with_edges(groups, ties.join(first, "doc_id").select(F.col("node").alias("a"), "b"), "linked")
    grouped = classes.join(groups, "node", "left").where("rows > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "node"))
    least_doc = grouped.groupBy("component").agg(F.min("doc").alias("least"))
    return info, stored(grouped.join(least_doc, "component").select("key", "key2", "node", "component", F.col("least").alias("doc")), "classes")


def _placed_rows(info: DataFrame, grouped: DataFrame) -> DataFrame:
    """Every row with its class's component, null where it is alone."""
    if grouped.count() <= BROADCAST_IDS:
        grouped = F.broadcast(grouped)
    return info.drop("node").join(grouped, ["key", "key2"], "left")


def ngram_jaccard_components(docs: DataFrame, threshold: int = 75, size: int = 5) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, n_shingles, component_id)``, a row per document.

    Two documents link when ``100 * |A & B| >= threshold * |A | B|`` over their sets of
    ``size``-word shingles (A-Z lower-cased); the component is the smallest doc_id reachable.
    Null or wordless text: an empty set, linked with nothing, its own component. A text
    shorter than a shingle has one, its whole word sequence. Repeated rows of one doc_id
    are one node and give a row each. A row with a null doc_id links like any other and names
    no component: its own is the smallest doc_id it reaches, null where it reaches none. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    rows = _placed_rows(*_grouped(docs, threshold, size, by_id=True))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("doc")).alias("component_id"))


def ngram_jaccard_distinct(docs: DataFrame, threshold: int = 75, size: int = 5) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)``, all columns, one of each near-duplicate group.

    Rows are linked by their texts alone, as in ``ngram_jaccard_components``; of a group the
    row with the smallest doc_id stays (null last; of several texts with it, that of the smallest
    hash; of repeated rows, one). Rows without a word are linked with nothing and all stay.
    """
    info, grouped = _grouped(docs.select("doc_id", "text"), threshold, size, by_id=False)
    rows = _placed_rows(info, grouped).where("component IS NOT NULL")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("x"))
    first = first.select(F.col("x.doc_id").alias("id"), F.col("x.mark").alias("m"), F.lit(True).alias("stays"))
    grouped = rows.select("doc_id", "mark").distinct().join(first, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left")
    mark, stays = spare_name(docs, "_mark"), spare_name(docs, "_stays")
    grouped = stored(grouped.select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), F.coalesce("stays", F.lit(False)).alias(stays)), "grouped")
    if grouped.count() <= BROADCAST_IDS:
        grouped = F.broadcast(grouped)
    marked = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    key = F.struct(F.col("id").alias("i"), F.col("m").alias("m")), F.struct(marked["doc_id"].cast("long").alias("i"), marked[mark].alias("m"))
    marked = marked.join(grouped.select(key[0].alias("_key"), stays), F.col("_key") == key[1], "left")
    alone, winners = marked.where(F.col(stays).isNull()), marked.where(F.col(stays))
    return alone.select(*docs.columns).unionByName(winners.dropDuplicates(["doc_id", mark]).select(*docs.columns))
