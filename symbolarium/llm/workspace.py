"""Intermediate tables and model files in the folder all executors share."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows that go to a Python worker at a time: both sides hold a batch whole, the worker two.
BATCH_BYTES = 4 << 20
#: Text whose words or n-grams one Python worker holds at a time: some 3 million entries.
BUCKET_BYTES = 16 << 20
#: A key with more than one of so many rows is joined by broadcast: there are fewer than so many.
HOT_SHARE = 1000


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a fresh local one only where none is set and all runs in one
    process (tests). On a cluster a local folder would lose rows, so a missing one is an error."""
    root = spark.conf.get(_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} names no shared folder")
        root = tempfile.mkdtemp(prefix="symbolarium-")
        spark.conf.set(_KEY, root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/symbolarium/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    This cuts lineage like ``checkpoint()`` does, but columnar and compressed; a
    lost executor costs nothing, as the rows live in the shared folder.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, after its session was told to hand rows to Python in Arrow batches of ``BATCH_BYTES``
    (one row may exceed it), where the caller has set no limit. Spark's own is 64 MB a batch."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, None) is None:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buckets(texts: DataFrame, bucket_bytes: int | None = None) -> int:
    """How many buckets the words of ``texts(text)`` are dealt over: as many as keep each near
    ``bucket_bytes`` of text (``BUCKET_BYTES``), and at least one for each shuffle partition."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(texts.sparkSession), -(-int(total) // (bucket_bytes or BUCKET_BYTES)))


def joined_by_weight(rows: DataFrame, side: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``rows`` with the columns of ``side``, one row a key, whose ``weight`` is how many rows have
    that key. Keys with more than one in ``HOT_SHARE`` of the rows are broadcast: fewer than
    ``HOT_SHARE`` can be; no key of the shuffle has more."""
    total = side.agg(F.sum(weight)).first()[0] or 0
    limit = total // HOT_SHARE
    hot = F.broadcast(side.where(F.col(weight) > limit).withColumn("hot", F.lit(True)))
    cold = side.where(F.col(weight) <= limit)
    named = rows.join(hot, keys, "left")
    back = named.where("hot IS NULL").select(rows.columns)
    return named.where("hot").drop("hot").unionByName(back.join(cold, keys))


def write_shared(path: str, payload) -> None:
    """Write one model file; safe under task retries, as it appears only when whole."""
    fs, inner = _filesystem(path)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(memoryview(payload).cast("B"))
    fs.move(part, inner)


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path else "file:///" + path.removeprefix("file:").lstrip("/"))


@contextlib.contextmanager
def mapped_files(paths: list[str]) -> Iterator[list[str]]:
    """Local paths of shared files for memory-mapping: the files themselves where the
    shared folder is mounted, else copies in a task-local folder that goes with the task.
    A file that was never written has a path at which there is none."""
    fs, _ = _filesystem(paths[0]) if paths else (pafs.LocalFileSystem(), "")
    if isinstance(fs, pafs.LocalFileSystem):
        yield [_filesystem(p)[1] for p in paths]
        return
    folder = tempfile.mkdtemp(prefix="symbolarium-")
    try:
        local = []
        for i, p in enumerate(paths):
            local.append(f"{folder}/{i}")
            if fs.get_file_info(_filesystem(p)[1]).type == pafs.FileType.NotFound:
                continue
            with fs.open_input_stream(_filesystem(p)[1]) as src, open(local[-1], "wb") as out:
                shutil.copyfileobj(src, out)
        yield local
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def spare_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
