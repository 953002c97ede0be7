"""Lempel-Ziv phrase fingerprints: documents compared by the phrases a compressor would learn.

A text is parsed into LZ78 phrases: each is the shortest run of characters, from where the
last one ended, that is not yet in the dictionary. The distinct phrases are hashed, and the
``SIZE`` smallest hashes are the signature; likeness is the Jaccard similarity of two phrase
sets as the signatures estimate it (exact for sets of at most ``SIZE`` phrases).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.llm.textarrays import chunks, mix64
from symbolarium.llm.workspace import partitions

SIZE = 128
_BASE = 0x9E3779B97F4A7C15
_SLICES = 4


def phrase_ends(text: str, known: set[str], at: int = 0) -> list[int]:
    """Ends of the phrases of ``text[at:]``; ``known`` grows by them.

    The dictionary holds every prefix of its phrases, so the length of the longest known
    run can be sought up or down from the last phrase's length. A known run at the very
    end is a last phrase that adds nothing.
    """
    ends, n, guess = [], len(text), 1
    while at < n:
        size = guess
        if text[at : at + size] in known:
            size += 1
            while at + size <= n and text[at : at + size] in known:
                size += 1
        else:
            while size > 1 and text[at : at + size - 1] not in known:
                size -= 1
        at += size
        if at > n:
            ends.append(n)
            break
        known.add(text[at - size : at])
        ends.append(at)
        guess = size
    return ends


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class _Hasher:
    """Hashes of many slices of one text from one running sum."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def signature(self, text: str, ends: list[int]) -> np.ndarray:
        if not ends:
            return np.zeros(0, np.uint32)
        if len(text) > len(self.up):
            n = max(2 * len(text), 1 << 16)
            self.up, self.down = _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        run = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(chars * self.up[: len(chars)], out=run[1:])
        ends = np.array(ends)
        starts = np.r_[0, ends[:-1]]
        h = (mix64((run[ends] - run[starts]) * self.down[starts]) >> np.uint64(32)).astype(np.uint32)
        return np.unique(h)[:SIZE]


def fingerprint_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two phrase sets; two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    fresh = np.ones(len(both), bool)
    fresh[1:] = both[1:] != both[:-1]
    union = both[fresh][:SIZE]
    return float((twice <= union[-1]).sum()) / len(union)


def edited(text: str, following: str) -> str:
    tail = len(text) // 3
    return text[: len(text) - tail] + following[:tail]


_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come slice by slice in order; each row waits for the one after it."""
    hasher, last = _Hasher(), None
    for chunk in chunks(batches):
        out = []
        for row in chunk.to_pylist():
            text = row["text"] or ""
            if last is None and row["ahead"]:
                continue
            known: set[str] = set()
            ends = phrase_ends(text, known)
            own = hasher.signature(text, ends)
            if last is not None:
                out.append(_row(*last, text, own, hasher))
            last = None if row["ahead"] else (row["doc_id"], text, ends, own)
        yield pa.RecordBatch.from_pylist(out, schema=_OUT)


def _row(doc_id, text: str, ends: list[int], own: np.ndarray, following: str, its: np.ndarray, hasher: _Hasher) -> dict:
    other = edited(text, following)
    cut = len(text) - len(text) // 3
    # Phrases that end before the edit are the same in both texts.
    same = int(np.searchsorted(ends, cut, side="right"))
    if ends and len(ends) == same and ends[-1] == len(text):
        same -= 1  # the last one may be a known run that more text would lengthen
    bounds = [0, *ends[:same]]
    known = {text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)}
    changed = hasher.signature(other, ends[:same] + phrase_ends(other, known, bounds[-1]))
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": fingerprint_text(own), "edited_fingerprint": fingerprint_text(changed),
        "near_edited": likeness(own, changed), "near_next": likeness(own, its),
    }


def lz_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` to one row per document with its fingerprint, and its
    likeness to its own text with the last third replaced by the start of the next document
    (descending doc_id; after the last, the first) and to that document.

    Null or empty text: empty fingerprint, likeness 1 to an empty one and 0 to any other.
    Rows of one doc_id follow one another by text; a null doc_id comes last. A single row is
    its own next. An empty table gives an empty result; other columns are ignored.

    The order is cut into slices at quantiles of doc_id, so no task sorts more than a few
    slices; the first rows of each slice also go to the slice before it.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))))
    slices = _SLICES * parts
    cuts = sorted(set(rows.agg(F.percentile_approx("at", [k / slices for k in range(1, slices)], 20 * slices)).first()[0] or []))
    slice_of = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < F.col("at"))) if cuts else F.lit(0)
    rows = rows.withColumn("slice", slice_of)
    heads = sorted(rows.groupBy("slice").agg(F.max("at").alias("head")).collect(), reverse=True)  # one row a slice
    pairs = [x for here, after in zip(heads, heads[1:] + heads[:1], strict=True) for x in (F.lit(after["head"]).cast("long"), F.lit(here["slice"]))]
    ahead = F.try_element_at(F.create_map(*pairs), F.col("at")) if pairs else F.lit(None).cast("int")
    placed = rows.withColumn("to", F.explode(F.filter(F.array(F.struct(F.col("slice").alias("slice"), F.lit(False).alias("ahead")), F.struct(ahead.alias("slice"), F.lit(True).alias("ahead"))), lambda x: x["slice"].isNotNull())))
    return (
        placed.select("to.slice", "to.ahead", "at", "doc_id", "text").repartition(parts, "slice")
        .sortWithinPartitions("slice", "ahead", F.desc("at"), "text")
        .select("slice", "ahead", "doc_id", "text")
        .mapInArrow(_compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )
