"""Keys and numbers of any amount as sorted arrays in the shared folder, mapped by workers."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from symbolarium.llm.workspace import fresh_path, stored, write_shared

#: Keys of one file; a worker maps one file at a time.
FILE_KEYS = 8 << 20


@dataclass
class SortedKeys:
    paths: list[str]
    sizes: list[int]

    def lookup(self, local: list[str], asked: np.ndarray) -> np.ndarray:
        """The numbers of the keys ``asked`` (in any order, repeated or not); 0 for those that are
        not there. ``local`` are the files' places on this machine (``workspace.mapped_files``)."""
        distinct, each = np.unique(asked, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        for path, n in zip(local, self.sizes, strict=True):
            keys = np.memmap(path, np.int64, "r", shape=(n,))
            a, b = np.searchsorted(distinct, [keys[0], keys[-1]])
            part = distinct[a : b + 1]
            at = np.minimum(np.searchsorted(keys, part), n - 1)
            hit = keys[at] == part
            numbers = np.memmap(path, np.int64, "r", offset=8 * n, shape=(n,))
            out[a : b + 1][hit] = numbers[at[hit]]
        return out[each]


def sorted_keys(table: DataFrame) -> SortedKeys:
    """``table(key long, number)``, a key once, as ``SortedKeys``; the driver sees the files' names."""
    folder = fresh_path(table.sparkSession, "keys")
    table = stored(table.select("key", "number"), "key-table")
    files = -(-table.count() // FILE_KEYS)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(b.column("key").to_numpy(), b.column("number").to_numpy()) for b in batches if b.num_rows]
        if kept:
            keys, numbers = (np.concatenate(c).astype(np.int64) for c in zip(*kept, strict=True))
            path = f"{folder}/{uuid.uuid4().hex}"
            write_shared(path, np.concatenate([keys, numbers]).view(np.uint8))
            yield pa.record_batch([pa.array([path]), pa.array([len(keys)], pa.int64())], ["path", "n"])

    if not files:
        return SortedKeys([], [])
    rows = table.repartitionByRange(files, "key").sortWithinPartitions("key").mapInArrow(write, "path string, n long").collect()
    return SortedKeys([r["path"] for r in rows], [r["n"] for r in rows])
