"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, memory-mapped to score.

The order is a parameter, 3 unless told otherwise; it interpolates at every level down to
single words. The model is a folder of shards of bounded size, three files each:

* ``words-k``: sorted word hashes and their counts; a word's id is its place in all shards
  put together, as shards are ranges of hashes.
* ``grams-k``: for each level n from 2 the n-grams counted once and those counted more often,
  as sorted hashes, the latter with their counts.
* ``follows-k``: for each word how many different ones it follows and what follows it, and for
  each n-gram of all levels but the highest what follows it: nothing, one n-gram counted once,
  or so many counted once, twice, more often.

A context is an n-gram of the level below, so what follows it lies beside that n-gram, by its
place, and contexts have no keys of their own. A hash is kept as the bucket that its first bits
name and 32 bits more, some 50 bits for the largest shards.

On the highest level an n-gram counts as often as it occurs; below, as often as different
words stand before it; an n-gram at a text's start, which nothing can precede, as often as it
occurs. N-grams live in the shard of their last two words. So a shard sees all that stands
before its n-grams and counts every level by itself, and a frequent word is spread over all
shards. What follows a context is then summed over shards, in the shard of the context.
"""

from __future__ import annotations

import contextlib
import json
import os
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.llm.samples import fold
from symbolarium.llm.textarrays import chunks, mix64, words
from symbolarium.llm.workspace import fresh_path, mapped_files, text_buckets, write_shared

END = np.uint64(0x0E0D0E0D0E0D0E0D)
ORDER = 3
#: Distinct entries a task gathers before it sends them on.
FLUSH = 1_800_000
#: Text that is scored at a time: each shard is asked once for all of it.
STEP_BYTES = 3 << 20
#: Files that a task holds open at a time; others are opened again when they are needed.
OPEN_FILES = 192
#: How many bits of a byte are set.
_SET_BITS = np.array([bin(k).count("1") for k in range(256)], np.uint8)
_SCHEMA = pa.schema([("bucket", pa.int32()), ("level", pa.int32()), ("ones", pa.binary()), ("many", pa.binary()), ("times", pa.binary())])
_BLOCKS = "bucket int, level int, ones binary, many binary, times binary"
_FACTS = "kind int, place int, value long"


@dataclass
class NgramModel:
    root: str
    shards: int
    order: int = ORDER
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # first id of each shard
    tokens: int = 0
    discounts: np.ndarray = field(default_factory=lambda: np.zeros((ORDER + 1, 4)))  # by level and count
    kinds: int = 0  # different pairs of neighbours
    low_rest: float = 1.0  # what the counts of single words leave to the uniform distribution

    @property
    def vocabulary(self) -> int:
        return int(self.offsets[-1])

    @property
    def start(self) -> int:
        """The id of a text's start, as a context; ``vocabulary`` is that of unknown words."""
        return self.vocabulary + 1

    @property
    def nothing(self) -> int:
        """What fills the left of n-grams that a text's start makes shorter."""
        return self.vocabulary + 2

    def path(self, kind: str, shard: int) -> str:
        return f"{self.root}/{kind}-{shard:06d}"

    def home(self, heads: list[np.ndarray]) -> np.ndarray:
        """The shard of contexts, given by the columns of their words: of a word its own, else that
        of the last two words. A text's start is with the last words."""
        if len(heads) == 1:
            return np.minimum(np.searchsorted(self.offsets, heads[0], side="right") - 1, self.shards - 1)
        return _hash_shard(_hashes(heads[-2:])[-1], self.shards)


def _hash_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


def _hashes(ids: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the first, the first two, ... of the words in each row of columns ``ids``."""
    out: list[np.ndarray] = []
    for column in ids:
        own = mix64(column.astype(np.uint64) + np.uint64(1))
        out.append(mix64(out[-1] * np.uint64(0xD6E8FEB86659FD93) + own) if out else own)
    return out


def _planes(a: np.ndarray) -> bytes:
    """Bytes by significance: of sorted numbers the high ones repeat, and compress."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where in it each different one begins."""
    order = np.argsort(keys)
    ranked = keys[order]
    return order, np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]][: len(ranked)])


def _summed(counts: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(counts[order], at, axis=0) if len(at) else counts[:0]


def _smallest(numbers: np.ndarray) -> np.ndarray:
    """The numbers in the least unsigned type that holds them all."""
    return numbers.astype(np.min_scalar_type(numbers.max(initial=0))).reshape(-1)


def _tokens(chunk: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, each text closed by the end token, and the texts' bounds."""
    w = words(chunk.column("text"), lower=True)
    bounds = w.first + np.arange(len(w.first))
    out = np.full(bounds[-1], END, np.uint64)
    last = np.zeros(len(out), bool)
    last[bounds[1:] - 1] = True
    out[~last] = w.hashes
    return out, bounds


def _ngrams(model: NgramModel, ids: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each token a row of ``order`` columns: it and what stands before it in its text."""
    place = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
    columns = []
    for back in range(model.order - 1, 0, -1):
        column = np.r_[np.full(min(back, len(ids)), model.nothing, ids.dtype), ids[: max(0, len(ids) - back)]]
        column[place < back] = model.nothing
        column[place == back - 1] = model.start
        columns.append(column)
    return [*columns, ids]


def _ranked(shard: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """An order by shard, then by words, the last one first, as far as 64 bits reach: ids that
    repeat compress."""
    key, used = shard.astype(np.uint64), int(shard.max(initial=0)).bit_length()
    for column in reversed(columns):
        bits = int(column.max(initial=0)).bit_length()
        if used + bits > 64:
            if used == int(shard.max(initial=0)).bit_length():  # word hashes: their first bits name the shard
                return np.argsort(column)
            break
        key, used = key << np.uint64(bits) | column.astype(np.uint64), used + bits
    return np.argsort(key)


def _pressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _blocks(level: int, shard: np.ndarray, lone: np.ndarray, columns: list[np.ndarray], counts: np.ndarray) -> Iterator[dict]:
    """Rows sorted by shard, to one block a shard: ``lone`` ones without their counts."""
    found, at = np.unique(shard, return_index=True)
    for b, lo, hi in zip(found.tolist(), at, np.r_[at, len(shard)][1:], strict=True):
        one = lone[lo:hi]
        parts = [c[lo:hi] for c in columns]
        yield {
            "bucket": b, "level": level,
            "ones": _pressed(b"".join(_planes(c[one]) for c in parts)), "many": _pressed(b"".join(_planes(c[~one]) for c in parts)),
            "times": _pressed(_planes(counts[lo:hi][~one].reshape(-1))),
        }


def _unblocked(rows: list[dict], width: int, kind, numbers: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns and counts (1 and, of ``numbers`` a row, zeros behind it) of many blocks."""
    columns = [[np.zeros(0, kind)] for _ in range(width)]
    counts = [np.zeros((0, numbers), np.int64)]
    for row in rows:
        for part in map(zstandard.decompress, (row["ones"], row["many"])):
            step = len(part) // width
            for c in range(width):
                columns[c].append(_from_planes(part[c * step : (c + 1) * step], kind))
        lone = np.zeros((len(columns[0][-2]), numbers), np.int64)
        lone[:, 0] = 1
        counts += [lone, _from_planes(zstandard.decompress(row["times"]), np.int64).reshape(-1, numbers)]
    return [np.concatenate(c) for c in columns], np.concatenate(counts)


def _in_steps(pieces: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Pieces joined to ones of at least a third of what a task gathers."""
    waiting: list[list[np.ndarray]] = []
    for piece in pieces:
        waiting.append(piece)
        if 3 * sum(len(p[0]) for p in waiting) >= FLUSH:
            yield [np.concatenate(c) for c in zip(*waiting, strict=True)]
            waiting = []
    if waiting:
        yield [np.concatenate(c) for c in zip(*waiting, strict=True)]


def _gathered(pieces: Iterator[list[np.ndarray]], hashed, shard_key, shards: int) -> Iterator[pa.RecordBatch]:
    """Counts of rows of columns over many pieces, sent on whenever enough different ones came."""
    held: list[np.ndarray] = []
    counts = np.zeros(0, np.int64)

    def sent() -> pa.RecordBatch:
        shard = _hash_shard(shard_key(held), shards)
        order = _ranked(shard, held)
        own = counts[order]
        return pa.RecordBatch.from_pylist(list(_blocks(0, shard[order], own == 1, [c[order] for c in held], own)), schema=_SCHEMA)

    for piece in _in_steps(pieces):
        if held:
            piece = [np.concatenate([a, b]) for a, b in zip(held, piece, strict=True)]
        counts = np.r_[counts, np.ones(len(piece[0]) - len(counts), np.int64)]
        order, at = _grouped(hashed(piece))
        held, counts = [c[order[at]] for c in piece], _summed(counts, order, at)
        if len(counts) >= FLUSH:
            yield sent()
            held, counts = [], counts[:0]
    if len(counts):
        yield sent()


def _file(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one file: the length of its head, the head (names, types, places), the arrays."""
    head, parts, at = [], [], 0
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        head.append((name, np.asarray(a).dtype.str, len(a), at))
        parts.append(data + bytes(-len(data) % 8))
        at += len(parts[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return b"".join([len(text).to_bytes(8, "little"), text, *parts])


def _arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped; none if it was never written."""
    if not os.path.exists(path):
        return {}
    data = np.memmap(path, np.uint8, "r").view(np.ndarray)
    start = 8 + int(data[:8].view(np.int64)[0])
    out = {}
    for name, kind, n, at in json.loads(data[8:start].tobytes()):
        out[name] = data[start + at : start + at + n * np.dtype(kind).itemsize].view(kind)
    return out


def _key_set(name: str, hashes: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Arrays of a set of hashes, and the order in which they are kept: by bucket, which the first
    bits name (some eight hashes each), then by the 32 bits after these."""
    mixed = mix64(hashes)
    order = np.argsort(mixed)
    mixed = mixed[order]
    bits = max(1, len(mixed).bit_length() - 4)
    ends = np.searchsorted(mixed >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    low = ((mixed << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    return {f"{name}.low": low, f"{name}.ends": ends.astype(np.uint32)}, order


def _places(held: dict[str, np.ndarray], name: str, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in a set; -1 for those that are not there."""
    out = np.full(len(hashes), -1, np.int64)
    low, ends = held.get(f"{name}.low"), held.get(f"{name}.ends")
    if low is None or not len(low) or not len(hashes):
        return out
    mixed, bits = mix64(hashes), (len(ends) - 1).bit_length() - 1
    bucket = (mixed >> np.uint64(64 - bits)).astype(np.int64)
    want = ((mixed << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    first, stop = ends[bucket].astype(np.int64), ends[bucket + 1].astype(np.int64)
    some = np.flatnonzero(first < stop)
    first, stop, want = first[some], stop[some], want[some]
    # The 32 bits are spread evenly: they tell about where in the bucket to begin, then it is a few steps.
    at = first + (want.astype(np.uint64) * (stop - first).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    have = low[at]
    out[some[have == want]] = at[have == want]
    for step, live in ((1, np.flatnonzero(have < want)), (-1, np.flatnonzero(have > want))):
        while len(live):
            at[live] += step
            live = live[at[live] < stop[live] if step > 0 else at[live] >= first[live]]
            have, own = low[at[live]], want[live]
            hit = live[have == own]
            out[some[hit]] = at[hit]
            live = live[have < own if step > 0 else have > own]
    return out


def _gram_places(held: dict[str, np.ndarray], level: int, hashes: np.ndarray) -> np.ndarray:
    """The place of each n-gram among those of its level: counted once, then the others."""
    out = _places(held, f"ones-{level}", hashes)
    rest = np.flatnonzero(out < 0)
    more = _places(held, f"many-{level}", hashes[rest])
    out[rest[more >= 0]] = more[more >= 0] + len(held.get(f"ones-{level}.low", ()))
    return out


def _follow_table(level: int, size: int, places: np.ndarray, follows: np.ndarray) -> dict[str, np.ndarray]:
    """What follows the contexts at ``places`` of ``size``: a bit for those that one n-gram counted
    once follows, a bit and four numbers for others, nothing for those that end all texts."""
    sort, at = _grouped(places)
    places, follows = places[sort[at]], _summed(follows, sort, at)
    alone = follows[:, 3] == 1
    lone, wide = np.zeros(size, bool), np.zeros(size, bool)
    lone[places[alone]], wide[places[~alone]] = True, True
    flags, stats = np.packbits(wide, bitorder="little"), follows[~alone]
    rank = np.r_[0, np.cumsum(_SET_BITS[flags], dtype=np.int64)][: len(flags)].astype(np.uint32)
    named = {"lone": np.packbits(lone, bitorder="little"), "wide": flags, "rank": rank} | {f"n{k}": _smallest(stats[:, k]) for k in range(4)}
    return {f"{k}-{level}": a for k, a in named.items()}


def _follow_rows(held: dict[str, np.ndarray], level: int, places: np.ndarray) -> np.ndarray:
    """The four numbers of the contexts at ``places``; zeros where nothing follows, or for -1."""
    out = np.zeros((len(places), 4), np.int64)
    some = np.flatnonzero(places >= 0)
    if not len(some) or f"wide-{level}" not in held:
        return out
    byte, bit = places[some] >> 3, (places[some] & 7).astype(np.uint8)
    flags = held[f"wide-{level}"][byte]
    wide, lone = (flags >> bit) & 1 > 0, (held[f"lone-{level}"][byte] >> bit) & 1 > 0
    out[some[lone]] = (1, 0, 0, 1)
    below = _SET_BITS[flags[wide] & ((np.uint8(1) << bit[wide]) - np.uint8(1))]
    rank = held[f"rank-{level}"][byte[wide]].astype(np.int64) + below
    for k in range(4):
        out[some[wide], k] = held[f"n{k}-{level}"][rank]
    return out


def _facts(rows: list[tuple[int, int, int]]) -> pa.Table:
    kinds, places, values = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"kind": pa.array(kinds, pa.int32()), "place": pa.array(places, pa.int32()), "value": pa.array(values, pa.int64())})


def _spectrum(level: int, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """How many counts are 1, 2, 3, 4, then above 2, then their sum."""
    found = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    return [(level, k, n) for k, n in enumerate([*found, int((counts > 2).sum()), int(counts.sum())])]


def _discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and above, from counts of counts."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in (1, 2, 3):
            if n[k - 1] and n[k]:
                out[k] = k - (k + 1) * y * n[k] / n[k - 1]
    return np.clip(out, [0, 0.01, 0.01, 0.01], [0, 0.99, 1.99, 2.99])


def train_ngram_model(docs: DataFrame, order: int = ORDER) -> NgramModel:
    """Count ``docs(text, ...)`` and write the model to a folder under the shared one.

    ``order`` (2 or more) is the number of words of the longest n-grams. Null texts count as
    empty: their only token is the end. No documents: a model without words, for which all is
    unknown.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string"))
    shards = text_buckets(texts)
    model = NgramModel(fresh_path(spark, "ngrams"), shards, order, discounts=np.zeros((order + 1, 4)))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(([_tokens(c)[0]] for c in chunks(batches)), lambda c: c[0], lambda c: c[0], shards)

    def store_words(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        (hashes,), counts = _unblocked(rows, 1, np.uint64, 1)
        order, at = _grouped(hashes)
        hashes, counts, shard = hashes[order[at]], _summed(counts[:, 0], order, at), rows[0]["bucket"]
        write_shared(model.path("words", shard), _file({"hashes": hashes, "counts": _smallest(counts)}))
        return _facts([(0, shard, len(hashes)), (1, shard, int(counts.sum()))])

    told = texts.mapInArrow(count_words, _BLOCKS).groupBy("bucket").applyInArrow(store_words, _FACTS).collect()
    sizes = np.zeros(shards, np.int64)
    for kind, shard, value in told:
        if kind == 0:
            sizes[shard] = value
        else:
            model.tokens += value
    model.offsets = np.r_[0, np.cumsum(sizes)]
    if not model.vocabulary:
        return model
    if model.nothing >= 1 << 32:
        raise ValueError("word ids take 32 bits: vocabularies under 2**32 words")

    def count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Reader.opened(model, ("words",)) as reader:
            def pieces() -> Iterator[list[np.ndarray]]:
                for chunk in chunks(batches):
                    hashes, bounds = _tokens(chunk)
                    ids, back = reader.ids(hashes)
                    yield _ngrams(model, ids.astype(np.uint32)[back], bounds)

            yield from _gathered(pieces(), lambda c: _hashes(c)[-1], lambda c: _hashes(c[-2:])[-1], shards)

    def store_ngrams(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        shard = rows[0]["bucket"]
        columns, counts = _unblocked(rows, order, np.uint32, 1)
        sort, at = _grouped(_hashes(columns)[-1])
        columns, counts = [c[sort[at]] for c in columns], _summed(counts[:, 0], sort, at)
        out: list[dict] = []
        whole = columns[0] != model.nothing
        grams, times = [c[whole] for c in columns], counts[whole]
        arrays: dict[str, np.ndarray] = {}
        for level in range(order, 1, -1):
            if level < order:
                # Those that a text's start made this short count as they are; the rest, as
                # often as there are different grams of one word more.
                short = (columns[order - level - 1] == model.nothing) & (columns[order - level] == model.start)
                grams = [np.concatenate([g, c[short]]) for g, c in zip(grams[1:], columns[order - level :], strict=True)]
                times = np.r_[np.ones(len(times), np.int64), counts[short]]
                sort, at = _grouped(_hashes(grams)[-1])
                grams, times = [g[sort[at]] for g in grams], _summed(times, sort, at)
            *_, context, key = _hashes(grams)
            ones, _ = _key_set(f"ones-{level}", key[times == 1])
            many, rank = _key_set(f"many-{level}", key[times > 1])
            arrays |= ones | many | {f"times-{level}": _smallest(times[times > 1][rank])}
            follows = np.stack([times == 1, times == 2, times > 2, times], axis=1).astype(np.int64)
            sort, at = _grouped(context)
            heads, follows = [g[sort[at]] for g in grams[:-1]], _summed(follows, sort, at)
            where = model.home(heads)
            rank = _ranked(where, heads)
            out += _blocks(level, where[rank], follows[rank, 3] == 1, [h[rank] for h in heads], follows[rank])
            out.append({"bucket": shard, "level": -level, "ones": None, "many": None, "times": _planes(np.array([f[2] for f in _spectrum(level, times)], np.int64))})
        write_shared(model.path("grams", shard), _file(arrays))
        ids, before = np.unique(grams[-1], return_counts=True)
        out += _blocks(1, np.searchsorted(model.offsets, ids, side="right") - 1, before == 1, [ids], before.astype(np.int64))
        return pa.Table.from_pylist(out, schema=_SCHEMA)

    def store_contexts(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        shard = rows[0]["bucket"]
        told = []
        for row in rows:
            if row["level"] < 0:
                told += [(-row["level"], k, n) for k, n in enumerate(_from_planes(row["times"], np.int64).tolist())]
        first, size = int(model.offsets[shard]), int(model.offsets[shard + 1] - model.offsets[shard])
        (ids,), counts = _unblocked([r for r in rows if r["level"] == 1], 1, np.uint32, 1)
        before = np.zeros(size, np.int64)
        np.add.at(before, ids.astype(np.int64) - first, counts[:, 0])
        arrays = {"before": _smallest(before)}
        with mapped_files([model.path("grams", shard)]) as paths:
            grams = _arrays(paths[0])
            for level in range(2, order + 1):
                heads, follows = _unblocked([r for r in rows if r["level"] == level], level - 1, np.uint32, 4)
                # A lone one in a shard is one gram counted once, of a sum of 1.
                follows[follows[:, 3] == 0, 3] = 1
                if level == 2:  # words by their ids, and a text's start behind the last of them
                    places, n = heads[0].astype(np.int64) - first, size + 2
                else:
                    places = _gram_places(grams, level - 1, _hashes(heads)[-1])
                    n = len(grams.get(f"ones-{level - 1}.low", ())) + len(grams.get(f"many-{level - 1}.low", ()))
                arrays |= _follow_table(level, n, places, follows)
        write_shared(model.path("follows", shard), _file(arrays))
        return _facts(told + _spectrum(1, before[before > 0]))

    told = (
        texts.mapInArrow(count_ngrams, _BLOCKS).groupBy("bucket").applyInArrow(store_ngrams, _BLOCKS)
        .groupBy("bucket").applyInArrow(store_contexts, _FACTS).groupBy("kind", "place").agg(F.sum("value")).collect()
    )
    spectra = np.zeros((order + 1, 6), np.int64)
    for level, place, value in told:
        spectra[level, place] = value
    for level in range(1, order + 1):
        model.discounts[level] = _discounts(spectra[level, :4].tolist())
    model.kinds = int(spectra[1, 5])
    model.low_rest = float(model.discounts[1, 1:] @ spectra[1, [0, 1, 4]] / max(1, model.kinds))
    return model


class _Reader:
    """The model's files, memory-mapped as they are needed and ``OPEN_FILES`` at a time; lookups go
    shard by shard."""

    KINDS = ("words", "grams", "follows")

    def __init__(self, model: NgramModel, paths: dict[tuple[str, int], str]) -> None:
        self.model, self.paths = model, paths
        self._open: OrderedDict[tuple[str, int], dict[str, np.ndarray]] = OrderedDict()

    @classmethod
    @contextlib.contextmanager
    def opened(cls, model: NgramModel, kinds: tuple[str, ...] = KINDS):
        live = [(kind, k) for kind in kinds for k in range(model.shards)] if model.vocabulary else []
        with mapped_files([model.path(kind, k) for kind, k in live]) as paths:
            yield cls(model, dict(zip(live, paths, strict=True)))

    def file(self, kind: str, shard: int) -> dict[str, np.ndarray]:
        held = self._open.pop((kind, shard), None)
        if held is None:
            while len(self._open) >= OPEN_FILES:
                self._open.popitem(last=False)
            held = _arrays(self.paths[kind, shard])
        self._open[kind, shard] = held
        return held

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard that is asked, and which rows ask it."""
        order = np.argsort(shard.astype(np.min_scalar_type(self.model.shards)), kind="stable")
        cut = np.r_[0, np.cumsum(np.bincount(shard, minlength=self.model.shards))]
        for k in np.flatnonzero(np.diff(cut)).tolist():
            yield k, order[cut[k] : cut[k + 1]]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id of each different hash, ``vocabulary`` for unknown ones, and which of them each is."""
        uniq, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(uniq), self.model.vocabulary, np.int64)
        for k, rows in self._by_shard(_hash_shard(uniq, self.model.shards)):
            held = self.file("words", k).get("hashes", ())
            if len(held):
                at = np.searchsorted(held, uniq[rows])
                hit = held[np.minimum(at, len(held) - 1)] == uniq[rows]
                out[rows[hit]] = self.model.offsets[k] + at[hit]
        return out, back

    def dense(self, kind: str, name: str, ids: np.ndarray) -> np.ndarray:
        """The number that each of known ids has in an array of a kind of file."""
        out = np.zeros(len(ids), np.int64)
        for k, rows in self._by_shard(self.model.home([ids])):
            held = self.file(kind, k).get(name, ())
            if len(held):
                out[rows] = held[ids[rows] - self.model.offsets[k]]
        return out

    def _left(self, level: int, shard: int, places: np.ndarray) -> np.ndarray:
        """Of contexts of a level: what is left to shorter ones, and the sum of what follows."""
        one, two, more, total = _follow_rows(self.file("follows", shard), level, places).T
        d = self.model.discounts[level]
        return np.stack([one * d[1] + two * d[2] + more * d[3], total], axis=1)

    def word_left(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), 2))
        for k, rows in self._by_shard(self.model.home([ids])):
            out[rows] = self._left(2, k, ids[rows] - self.model.offsets[k])
        return out

    def grams(self, columns: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By level, how often the n-grams that end at each token count, and what they leave as
        contexts of the level above: two arrays, and which of their rows is a token's. All n-grams
        of a token are in one shard; pairs that repeat are looked up once, and longer ones only
        behind a pair that is there."""
        model, size = self.model, len(columns[-1])
        pair = _hashes(columns[-2:])[-1]
        order, at = _grouped(pair)
        ends = np.r_[at, size][1:]
        pairs = pair[order[at]]
        row = np.empty(size, np.int64)
        row[order] = np.repeat(np.arange(len(at)), ends - at)
        # Shards are ranges of the pairs' hashes.
        shard = _hash_shard(pairs, model.shards)
        own = lambda n, level: (np.zeros(n, np.int64), np.zeros((n if level < model.order else 0, 2)))
        out = {level: (*own(len(at) if level == 2 else size, level), row if level == 2 else np.arange(size)) for level in range(2, model.order + 1)}
        keys = {level: _hashes(columns[-level:])[-1] for level in range(3, model.order + 1)}
        found, first = np.unique(shard, return_index=True)
        for k, lo, hi in zip(found.tolist(), first.tolist(), np.r_[first, len(shard)][1:].tolist(), strict=True):
            held, rows, asked = self.file("grams", k), np.arange(lo, hi), pairs[lo:hi]
            for level in range(2, model.order + 1):
                counts, left, _ = out[level]
                places = _gram_places(held, level, asked)
                there = places >= 0
                rows, places = rows[there], places[there]
                ones = len(held.get(f"ones-{level}.low", ()))
                counts[rows] = 1
                more = places >= ones
                if more.any():
                    counts[rows[more]] = held[f"times-{level}"][places[more] - ones]
                if level == model.order or not len(rows):
                    break
                left[rows] = self._left(level + 1, k, places)
                if level == 2:
                    live = np.zeros(hi - lo, bool)
                    live[rows - lo] = True
                    rows = order[at[lo] : ends[hi - 1]][np.repeat(live, (ends - at)[lo:hi])]
                rows = rows[columns[model.order - level - 1][rows] != model.nothing]
                asked = keys[level + 1][rows]
        return out


def _scores(model: NgramModel, reader: _Reader, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its training count, its base log10 probability, and the model's."""
    v = model.vocabulary
    uniq, back = reader.ids(hashes) if v else (np.zeros(1, np.int64), np.zeros(len(hashes), np.int64))
    known = np.flatnonzero(uniq < v)
    counts, low = np.zeros(len(uniq)), np.full(len(uniq), model.low_rest / (v + 1))
    if len(known):
        counts[known] = reader.dense("words", "counts", uniq[known])
        before = reader.dense("follows", "before", uniq[known])
        low[known] += np.maximum(before - model.discounts[1, np.minimum(before, 3)], 0) / max(1, model.kinds)
    p = low[back]
    if v:
        columns = _ngrams(model, uniq[back], bounds)
        # A word's context is the token before it, or a text's start, which has the last row.
        context = np.r_[0, back[:-1]]
        context[bounds[:-1]] = len(uniq)
        left = reader.word_left(np.r_[uniq, model.start])
        grams = reader.grams(columns)
        for level in range(2, model.order + 1):
            number, above, row = grams[level]
            mass, total = left[context].T
            at = np.flatnonzero((total > 0) & (columns[model.order - level] != model.nothing))
            count = number[row[at]]
            high = np.maximum(count - model.discounts[level, np.minimum(count, 3)], 0)
            p[at] = (high + mass[at] * p[at]) / total[at]
            left, context = above, np.r_[0, row[:-1]]
    base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (v + 1)))
    return counts[back], base[back], np.log10(p)


def score_texts(docs: DataFrame, model: NgramModel) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, n_tokens, n_known, base_score, score)``.

    ``score`` is the model's log10 probability of the whole text and its end;
    ``perplexity`` is ``10 ** (-score / n_tokens)``. Null or empty text: the end alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        with _Reader.opened(model) as reader:
            for chunk in chunks(batches, limit=STEP_BYTES):
                hashes, bounds = _tokens(chunk)
                counts, base, own = _scores(model, reader, hashes, bounds)
                sums = [np.add.reduceat(x, bounds[:-1]) for x in ((counts > 0).astype(np.int64), base, own)]
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(np.diff(bounds)), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def ngram_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Train on nine tenths of ``docs(doc_id, text, ...)`` and score all of them.

    Repeated rows count and are scored each; a null doc_id is in no fold (``held_out`` false),
    scored and not learned from. Null or empty texts are their end alone; other columns are
    ignored; an empty table gives an empty result.
    """
    remainder = fold(F.col("doc_id"), 10)
    model = train_ngram_model(docs.where(remainder != 0), order)
    return score_texts(docs, model).select(
        "doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
