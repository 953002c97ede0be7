"""Byte-level BPE by longest matches, encoding and decoding.

Merging rank by rank is not needed to get what the merges would give: a token sequence is
the merges' result exactly when every token is its own bytes' encoding and every two
neighbours are compatible, that is, encode to themselves when put together. So tokens are
chosen longest first from matches of an Aho-Corasick automaton over all tokens, with
bytes mapped to Latin-1 characters; where no token fits its neighbour, the choice before
is taken back, and a position found to be a dead end is never entered again. Whether two
tokens are compatible is decided once by undoing their last merges and then remembered.
"""

from __future__ import annotations

import base64
import hashlib
import operator
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.llm.pieces import PieceCache
from symbolarium.llm.textarrays import chunks


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BacktrackingBpe:
    """Encodes one pre-token at a time; ``ranks`` maps each token's bytes to its id."""

    #: Remembered neighbour pairs before this memory starts anew.
    MEMORY = 400_000

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.last_merge: dict[int, tuple[int, int]] = {}
        self.compatible_pairs: dict[tuple[int, int], bool] = {}
        self.tokens = ahocorasick.Automaton()
        self.size = {rank: len(token) for token, rank in ranks.items()}
        for token, rank in ranks.items():  # in rank order, so parts come before wholes
            if len(token) == 1 or self._split(token, rank):
                self.tokens.add_word(token.decode("latin-1"), rank)
        #: The longest token that each token begins with, itself left out.
        self.shorter = {rank: self._prefix(token) for token, rank in ranks.items()}
        self.tokens.make_automaton()

    def _prefix(self, token: bytes) -> int | None:
        parts = (token[:end].decode("latin-1") for end in range(len(token) - 1, 0, -1))
        return next((self.tokens.get(part) for part in parts if part in self.tokens), None)

    def _split(self, token: bytes, rank: int) -> bool:
        """Find the merge that makes ``token``; False if merges never give it as a whole.

        It is a pair of earlier tokens that stay apart until this merge: compatible, but
        for the merge itself.
        """
        for at in range(1, len(token)):
            left, right = self.ranks.get(token[:at]), self.ranks.get(token[at:])
            if left is None or right is None or left >= rank or right >= rank:
                continue
            if (at > 1 and left not in self.last_merge) or (len(token) - at > 1 and right not in self.last_merge):
                continue
            if self._apart(left, right, rank):
                self.last_merge[rank] = (left, right)
                return True
        return False

    def _apart(self, left: int, right: int, bound: int) -> bool:
        """Whether no merge of rank under ``bound`` joins bytes across the two tokens.

        Going back in time, the later of the two last merges is undone, again and again.
        While both halves of a state exist, a merge across would have won if its rank is
        below that of the merge undone last; of equal ranks the left one comes first.
        """
        limit = bound
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < limit:
                return False
            undo_left, undo_right = self.last_merge.get(left), self.last_merge.get(right)
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or (undo_left is not None and left > right):
                limit, left = left, undo_left[1]
            else:
                limit, right = right + 1, undo_right[0]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.compatible_pairs.get(key)
        if found is None:
            if len(self.compatible_pairs) >= self.MEMORY:
                self.compatible_pairs.clear()
            found = self.compatible_pairs[key] = self._apart(left, right, 1 << 62)
        return found

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(word)
        if whole is not None:
            return (whole,)
        text, known = word.decode("latin-1"), self.compatible_pairs.get
        longest = {end + 1 - self.size[rank]: rank for end, rank in self.tokens.iter_long(text)}
        ids: list[int] = []
        at, token, dead = 0, longest[0], bytearray(len(word) + 1)
        while at < len(word):
            end = at + self.size[token]
            if not dead[end] and (not ids or known((ids[-1], token)) or self.compatible(ids[-1], token)):
                ids.append(token)
                at = end
                if at < len(word):
                    token = longest.get(at)
                    if token is None:
                        token = longest[at] = next(self.tokens.iter_long(text, at))[1]
                continue
            token = self.shorter[token]
            while token is None:  # nothing fits: this position is closed, and the last token is taken back
                dead[at] = 1
                token = ids.pop()
                at -= self.size[token]
                token = self.shorter[token]
        return tuple(ids)

    def encode(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self.encode_word(word.encode("utf-8")) for word in self.find(text)))

    def said(self, ids: tuple[int, ...]) -> tuple[bytes, bytes]:
        """The ids as decimal numbers, and the bytes decoded from them."""
        return ",".join(map(str, ids)).encode(), self.decode(ids)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], BacktrackingBpe] = {}
_caches: dict[tuple, PieceCache] = {}


def codec(path: str, pattern: str) -> BacktrackingBpe:
    """One codec a process, built from the vocabulary file at ``path``."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = BacktrackingBpe(load_ranks(path), pattern)
    return _codecs[path, pattern]


def _cache(path: str, pattern: str, make: Callable, join: Callable) -> PieceCache:
    """One cache of pieces a process and kind of value; it serves all tasks of the process."""
    if (path, pattern, join) not in _caches:
        _caches[path, pattern, join] = PieceCache(lambda piece: make(codec(path, pattern).encode(piece)), join)
    return _caches[path, pattern, join]


def _joined(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> tuple[bytes, bytes]:
    return a[0] + b"," + b[0], a[1] + b[1]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` to ``(doc_id, ids array<int>)``; null or empty text: no ids.

    ``path`` is a vocabulary file of base64 tokens and ranks that every machine has.
    Repeated rows are encoded alike, a null doc_id stays null; other columns are ignored; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = _cache(path, pattern, tuple, operator.add)
        for chunk in chunks(batches):
            ids = [list(chain.from_iterable(pieces_of(t or ""))) for t in chunk.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``rows(doc_id, ids)`` to ``(doc_id, data binary)``, the bytes that the ids stand for; null
    ids stand for none. An id outside the vocabulary is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            data = [bpe.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return rows.mapInArrow(run, "doc_id long, data binary")


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, then decode: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per document.

    The same codec as ``encode_texts`` and ``decode_ids``, in one pass, so that neither
    the ids nor the bytes leave the task; the cache holds of each piece its ids as decimal
    numbers and the bytes decoded from them. A null text counts as empty (no ids, digests of
    nothing), a null doc_id stays null, repeated rows give a row each; other columns are ignored;
    an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        pieces_of = _cache(path, pattern, bpe.said, _joined)
        for chunk in chunks(batches):
            rows = []
            for text in chunk.column("text").to_pylist():
                pieces = pieces_of(text) if text else ()
                said, data = (b",".join([p[0] for p in pieces]), b"".join([p[1] for p in pieces]))
                rows.append((said.count(b",") + bool(said), hashlib.sha256(said).hexdigest(), hashlib.sha256(data).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
