"""Sharding by size-tiered compaction, with versioned manifests.

A shard store is a folder of immutable Parquet shards and manifests. An append writes its
rows as small shards. Compaction groups shards into tiers by size (each tier ``FANOUT``
times the one below); a tier with enough shards is a run of similar ones and is merged into
files near the target size, and again while merged shards make a run of a higher tier. As all of a run's shards are alike, dealing out equal numbers
of them makes equal files without a shuffle. Each change writes the next manifest, the
complete list of live shards, into a hidden folder and publishes it by one atomic rename
that never replaces: of two writers of one version the second fails and may retry. Readers
follow the newest manifest and never see a half-made change.

Everything on the data path is Spark's own readers, writers and functions.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.llm.workspace import fresh_path

MIB = 1 << 20
FANOUT = 4
_MANIFEST = "path string, bytes long, rows long, tier int, added int"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 * MIB, least_bytes: int = 1 * MIB, min_run: int = 4) -> None:
        self.spark, self.root, self.target, self.least, self.min_run = spark, root.rstrip("/"), target_bytes, least_bytes, min_run
        jvm = spark.sparkContext._jvm
        self._paths = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._paths.Path(self.root).getFileSystem(self._conf)

    # -- manifests -------------------------------------------------------------------

    def version(self) -> int:
        """The newest published version; 0 before the first."""
        folder = self._paths.Path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder)), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifests/{version:010d}")

    def _commit(self, live: DataFrame, version: int) -> int:
        hidden = f"{self.root}/pending/{uuid.uuid4().hex}"
        live.coalesce(1).write.parquet(hidden)  # a row a shard: small beside the data
        self._fs.mkdirs(self._paths.Path(f"{self.root}/manifests"))
        options = self.spark.sparkContext._gateway.new_array(self._paths.Options.Rename, 0)
        self._paths.FileContext.getFileContext(self._paths.Path(self.root).toUri(), self._conf).rename(
            self._paths.Path(hidden), self._paths.Path(f"{self.root}/manifests/{version:010d}"), options
        )
        return version

    def _listed(self, folder: str, version: int) -> DataFrame:
        """Manifest rows of the shards just written to ``folder``, from the files themselves."""
        at = F.col("_metadata.file_path"), F.col("_metadata.file_size")
        files = self.spark.read.parquet(folder).select(at[0].alias("path"), at[1].alias("bytes")).groupBy("path", "bytes").agg(F.count("*").alias("rows"))
        tier = F.greatest(F.lit(0), F.ceil(F.log(F.col("bytes") / self.least) / math.log(FANOUT))).cast("int")
        return files.select("path", "bytes", "rows", tier.alias("tier"), F.lit(version).alias("added"))

    # -- changes ---------------------------------------------------------------------

    def append(self, rows: DataFrame) -> int:
        """Write ``rows`` as new shards and publish a version with them. No rows: a version with
        nothing added."""
        version = self.version() + 1
        folder = f"{self.root}/shards/{version:010d}-{uuid.uuid4().hex[:8]}"
        rows.write.option("compression", "zstd").parquet(folder)
        live = self.manifest(version - 1)
        has_files = any(True for _ in self._data_files(folder))
        return self._commit(live.unionByName(self._listed(folder, version)) if has_files else live, version)

    def _data_files(self, folder: str):
        files = self._fs.listFiles(self._paths.Path(folder), True)
        while files.hasNext():
            path = files.next().getPath()
            if path.getName().endswith(".parquet"):
                yield path.toString()

    def compact(self) -> int:
        """Merge every tier that is a run; returns the version, the same if none is.

        Shards at or above half the target stay. A tier's paths go to the driver: a run is
        what gathered since the last compaction, not the corpus.
        """
        base = self.version()
        live = self.manifest(base)
        small = live.where(F.col("bytes") * 2 < self.target)
        runs = small.groupBy("tier").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("shards")).where(F.col("shards") >= self.min_run).collect()
        if not runs:
            return base
        made = []
        for run in sorted(runs, key=lambda r: r["tier"]):
            paths = [r["path"] for r in small.where(F.col("tier") == run["tier"]).orderBy("added", "path").select("path").collect()]
            folder = f"{self.root}/shards/{base + 1:010d}-t{run['tier']}-{uuid.uuid4().hex[:8]}"
            self.spark.read.parquet(*paths).coalesce(max(1, round(run["bytes"] / self.target))).write.option("compression", "zstd").parquet(folder)
            made.append(self._listed(folder, base + 1))
        left = live.join(F.broadcast(self.spark.createDataFrame([(r["tier"],) for r in runs], "tier int")), "tier", "left_semi").where(F.col("bytes") * 2 < self.target)
        kept = live.join(left.select("path"), "path", "left_anti")
        for part in made:
            kept = kept.unionByName(part)
        return self._commit(kept, base + 1)

    def settle(self) -> int:
        """Compact until no tier is a run: merged shards may complete a run of a higher tier.
        Each pass leaves fewer small shards, so this ends."""
        while (version := self.version()) != self.compact():
            pass
        return version

    def vacuum(self, min_age_seconds: int = 86_400) -> int:
        """Delete what failed changes left: files under ``shards`` that no manifest lists, and
        unpublished manifests, if older than the longest change may take."""
        old = F.col("modificationTime") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(min_age_seconds))
        listed = self.manifest(0)
        for v in range(1, self.version() + 1):
            if self._fs.exists(self._paths.Path(f"{self.root}/manifests/{v:010d}")):
                listed = listed.unionByName(self.manifest(v))
        name = F.element_at(F.split("path", "/"), -1)
        gone = 0
        for part, known in (("shards", listed.select(name.alias("name"))), ("pending", None)):
            if self._fs.exists(self._paths.Path(f"{self.root}/{part}")):
                files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{self.root}/{part}")
                files = files.where(old & name.endswith(".parquet")).select("path", name.alias("name"))
                for row in (files if known is None else files.join(known, "name", "left_anti")).toLocalIterator():
                    gone += self._fs.delete(self._paths.Path(row["path"]), False)
        return gone

    def expire(self, keep_versions: int = 1) -> int:
        """Delete shards that none of the newest ``keep_versions`` manifests lists."""
        newest = self.version()
        kept = None
        for v in range(max(1, newest - keep_versions + 1), newest + 1):
            kept = self.manifest(v) if kept is None else kept.unionByName(self.manifest(v))
        old = None
        for v in range(1, newest - keep_versions + 1):
            if self._fs.exists(self._paths.Path(f"{self.root}/manifests/{v:010d}")):
                old = self.manifest(v) if old is None else old.unionByName(self.manifest(v))
        if kept is None or old is None:
            return 0
        gone = [r["path"] for r in old.select("path").distinct().join(kept.select("path").distinct(), "path", "left_anti").toLocalIterator()]
        for path in gone:
            self._fs.delete(self._paths.Path(path), False)
        for v in range(1, newest - keep_versions + 1):
            self._fs.delete(self._paths.Path(f"{self.root}/manifests/{v:010d}"), True)
        return len(gone)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version by their ``schema``, with ``shard``, the name of the file each is in."""
        paths = [r["path"] for r in self.manifest(version).select("path").toLocalIterator()]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("shard", F.lit(""))
        return self.spark.read.schema(schema).parquet(*paths).withColumn("shard", F.col("_metadata.file_name"))


def compacted_documents(docs: DataFrame, arrivals: int = 8, target_bytes: int = 32 * MIB) -> DataFrame:
    """Append ``docs`` in ``arrivals`` uneven arrivals, one after the other, settle after each,
    and read the last version back.

    ``(doc_id, text_sha256, n_chars, arrival, shard, shard_rows, shard_bytes, tier, added,
    version)``, a row for each row of ``docs(doc_id, text, ...)``; arrival ``k`` is about twice as
    large as ``k + 1``, ``added`` is the version that made the shard. Null texts stay null; a null
    doc_id, repeated rows and rows with one doc_id are kept as they are, in no fixed order. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, fresh_path(spark, "shards"), target_bytes)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << arrivals))
    arrival = F.least(F.lit(arrivals - 1), F.lit(arrivals - 1) - F.floor(F.log2(F.greatest(spread, F.lit(1)))).cast("int"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("arrival", arrival.cast("int"))
    for k in range(arrivals):
        store.append(rows.where(F.col("arrival") == k))
        store.settle()
        store.expire(keep_versions=2)
    version = store.version()
    names = store.manifest().select(F.element_at(F.split("path", "/"), -1).alias("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "tier", "added")
    return store.read(rows.schema).join(names, "shard").select(
        "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"), "arrival",
        "shard", "shard_rows", "shard_bytes", "tier", "added", F.lit(version).alias("version"),
    )
