"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are tokenised and cut at the sequence length; only the histogram of piece
lengths goes to the driver (as many numbers as the sequence has tokens). There lengths are
placed longest first, each into the packs with most room left, many equal packs at a time:
what is updated are counts of packing patterns, never single pieces. Patterns then say how
many pieces of each length, by rank, go where, and pieces find their sequence by their rank
among the pieces of equal length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symbolarium.llm.textarrays import chunks
from symbolarium.llm.workspace import in_batches, partitions, stored

#: One text to its ids, as unsigned 32-bit integers.
Encoder = Callable[[str], np.ndarray]
_encoders: dict[str, Encoder] = {}
_PLACE = pa.struct([(name, pa.int64()) for name in ("rank", "first", "offset")])


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def _ranked_bytes(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """The vocabulary as bytes to id, and its added tokens, if it is plain byte-level BPE whose
    ids follow its merges."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and before.get("type") == "ByteLevel"
        and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        and not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and not any(token.get(k) for token in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))
    )
    if not plain:
        return None
    added = {token["content"]: token["id"] for token in spec.get("added_tokens", [])}
    if any(a != b and a in b for a in added for b in added):
        return None
    byte_of = _byte_of_character()
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    tokens = [*byte_of, *merged]
    ids = [model["vocab"].get(token) for token in tokens]
    if None in ids or len(set(tokens)) < len(tokens) or (np.diff(ids[256:]) <= 0).any() or max(ids[:256]) > min(ids[256:], default=256):
        return None
    return {bytes(byte_of[c] for c in token): i for token, i in zip(tokens, ids, strict=True)}, added


def _encoder(path: str) -> Encoder:
    """The tokenizer at ``path``, once a worker process; as in its own library, an added token
    that stands in a text is that token.

    Of a byte-level vocabulary the ids follow from its ranks alone, so that tiktoken finds
    the same ones in a fifth of the time; any other vocabulary is left to its own library.
    """
    if path not in _encoders:
        with open(path, encoding="utf-8") as file:
            found = _ranked_bytes(json.load(file))
        if found is not None:
            fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=found[0], special_tokens=found[1])
            _encoders[path] = lambda text: fast.encode_to_numpy(text, allowed_special="all")
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
            own = Tokenizer.from_file(path)
            _encoders[path] = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)
    return _encoders[path]


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` to pieces of at most ``capacity`` ids.

    A document is its text's ids and ``end_id``; a null or empty text is ``end_id`` alone.
    ``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``, a row for each piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for chunk in chunks(batches):
            rows = []
            for doc_id, text in zip(chunk.column("doc_id").to_pylist(), chunk.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                for at in range(0, len(ids), capacity):
                    own = ids[at : at + capacity]
                    rows.append((doc_id, at, len(own), zlib.crc32(own), len(ids), *([own.tolist()] if keep_ids else [])))
            kinds = [*[pa.int64()] * 5, *([pa.list_(pa.int32())] if keep_ids else [])]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(kinds)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return in_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def packing_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)`` of each pattern; its lengths never sum to more than ``capacity``."""
    room: dict[int, list[list]] = defaultdict(list)  # room left: open [count, lengths]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max((r for r, packs in room.items() if packs and r >= length), default=None)
            if most is None:
                room[capacity - length].append([left, (length,)])
                break
            pack = room[most][-1]
            took = min(left, pack[0])
            left -= took
            pack[0] -= took
            if not pack[0]:
                room[most].pop()
            room[most - length].append([took, (*pack[1], length)])
    return [(count, lengths) for packs in room.values() for count, lengths in packs]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset`` there.

    Sequences are gapless from offset 0 and hold at most ``capacity`` ids. Repeated rows are
    documents of their own; a null doc_id stays null; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = stored(tokenised_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces")
    # Ranks within a length come from counts by bucket, so that a length which most pieces
    # have (the full one) is spread over many groups.
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(16 * partitions(spark))))
    counts = stored(pieces.groupBy("length", "bucket").agg(F.count("*").alias("pieces")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("pieces").alias("n")).collect()}

    places: dict[int, list[tuple[int, int, int]]] = {n: [] for n in histogram}
    ranked: dict[int, int] = defaultdict(int)
    first = 0
    for count, lengths in packing_patterns(histogram, capacity):
        offset = 0
        for n in lengths:
            places[n].append((ranked[n], first, offset))
            ranked[n] += count
            offset += n
        first += count
    # As an Arrow table: from Python rows, executors would start workers to unpickle them.
    lists = [[dict(zip(_PLACE.names, at, strict=True)) for at in own] for own in places.values()]
    table = spark.createDataFrame(pa.table({"length": pa.array(list(places), pa.int64()), "places": pa.array(lists, pa.list_(_PLACE))}))

    before = F.sum("pieces").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    place = F.array_max(F.filter("places", lambda p: p["rank"] <= F.col("rank")))
    return (
        pieces.withColumn("within", within).join(base, ["length", "bucket"])
        .join(F.broadcast(table), "length")  # a row for each length, at most ``capacity``
        .withColumn("rank", F.col("base") + F.col("within") - 1).withColumn("place", place)
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (F.col("place.first") + F.col("rank") - F.col("place.rank")).alias("sequence_id"), F.col("place.offset").alias("offset"),
            *(["ids"] if keep_ids else []),
        )
    )
