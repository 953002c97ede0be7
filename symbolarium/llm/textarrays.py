"""Whole Arrow batches of text as NumPy arrays: words, word hashes, shingle sets.

Words are ``[^\\x20\\x09-\\x0D]+``. The separators are ASCII bytes that never occur
inside a multi-byte UTF-8 character, so the work is done on bytes. A word's hash is a
polynomial over its bytes modulo 2**64, finalised; it comes from one running sum over
the batch, with no Python per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHAR = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_CHAR_LOWER = _CHAR.copy()
_CHAR_LOWER[65:91] = _CHAR[97:123]
CHUNK_BYTES = 1 << 20



def letters_only() -> np.ndarray:
    """Separators that leave ASCII letters and all non-ASCII bytes."""
    out = np.ones(256, bool)
    out[65:91] = out[97:123] = out[128:] = False
    return out


def lowered() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together stay near ``limit`` bytes (one row may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < len(size):
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and each text's bounds; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text, the index of its first word; one more at the end
    hashes: np.ndarray


def words(texts: pa.Array, lower: bool = False, separators: np.ndarray = _SPACE) -> Words:
    data, bounds = text_bytes(texts)
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    space = separators[data]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = True, space[:-1]
        after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    power, inverse = _grown(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((_CHAR_LOWER if lower else _CHAR)[data] * power[:n], out=run[1:])
    hashes = mix64((run[ends] - run[starts]) * inverse[starts])
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds), hashes)


def shingle_sets(w: Words, size: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``size``-word shingles; a shorter text
    with a word has its whole word sequence as the only one; no word, no shingle."""
    m = len(w.hashes)
    windows = np.zeros(max(0, m - size + 1), np.uint64)
    for k in range(size):
        windows += mix64(w.hashes[k : k + len(windows)] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
    windows = mix64(windows)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        elif b > a:
            h = b - a
            for x in w.hashes[a:b].tolist():
                h = int(mix64(np.array([(h * 0xD6E8FEB86659FD93 + x) % (1 << 64)], np.uint64))[0])
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@dataclass
class Lines:
    owner: np.ndarray  # text of each line with a word, in order
    place: np.ndarray  # its number among all lines of its text
    size: np.ndarray  # words
    words: np.ndarray  # hash of its words, whatever stands between them
    exact: np.ndarray  # hash of its bytes


def line_hashes(w: Words) -> Lines:
    """The newline-split lines that hold a word; ``exact`` follows the bytes as given."""
    n = len(w.data)
    breaks = np.flatnonzero(w.data == 10)
    # A line starts at a text's start and after each newline inside the text.
    starts = np.unique(np.r_[w.bounds[:-1], breaks + 1])
    starts = starts[starts < n]
    ends = np.r_[starts[1:], n]
    closed = np.zeros(n + 1, bool)
    closed[breaks + 1] = True
    ends = ends - closed[ends]  # without the newline itself
    owner = np.searchsorted(w.bounds, starts, side="right") - 1
    first, last = np.searchsorted(w.starts, starts), np.searchsorted(w.starts, ends)
    some = last > first
    count = np.r_[0, np.cumsum(w.data == 10)]
    place = count[starts] - count[w.bounds[owner]]
    power, inverse = _grown(max(n, len(w.hashes)) + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(_CHAR[w.data] * power[:n], out=run[1:])
    exact = (run[ends] - run[starts]) * inverse[np.minimum(starts, n)]
    run = np.zeros(len(w.hashes) + 1, np.uint64)
    np.cumsum(w.hashes * power[: len(w.hashes)], out=run[1:])
    own = (run[last] - run[first]) * inverse[first]
    size = last - first
    return Lines(owner[some], place[some], size[some], mix64(own + size.astype(np.uint64))[some], mix64(exact + (ends - starts).astype(np.uint64))[some])
