"""The stored index as versions: a write, what it replaces and what it prunes appear as one commit.

``data/commit=X`` holds the rows of one write and never changes. A version is a table of live
entries, each with the commit that holds its rows; it is written aside and published by one rename
that never replaces, so a reader sees a whole version and a writer that lost a race sees that it
did. What a failed write leaves behind is in no version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.operators.store import ENTRY, GENERATION, newest_configurations

_MANIFEST = "pkg string, version string, unit_id string, indexed_at long, n long, commit string, written long, generation int"


class IndexStore:
    """A Parquet index of rows with the columns of ``ENTRY``. ``keep`` configurations of a package
    version stay, the newest by time of indexing, then by order of writing."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 3) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    # -- versions ----------------------------------------------------------------------

    def latest(self) -> int:
        """The newest published version; 0 before the first."""
        folder = self._hadoop.Path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(folder)), default=0)

    def manifest(self, at: int | None = None) -> DataFrame:
        """Live entries of a version (by default the newest); none of another generation's."""
        at = self.latest() if at is None else at
        if not at:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/versions/{at:010d}").where(F.col("generation") == GENERATION)

    def _publish(self, manifest: DataFrame, version: int) -> bool:
        """Make ``manifest`` the version; false if another writer has published that one."""
        hidden = f"{self.path}/pending/{uuid.uuid4().hex}"
        manifest.write.parquet(hidden)
        self._fs.mkdirs(self._hadoop.Path(f"{self.path}/versions"))
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        context = self._hadoop.FileContext.getFileContext(self._hadoop.Path(self.path).toUri(), self._conf)
        try:
            context.rename(self._hadoop.Path(hidden), self._hadoop.Path(f"{self.path}/versions/{version:010d}"), options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            self._fs.delete(self._hadoop.Path(hidden), True)
            return False
        return True

    # -- writing -----------------------------------------------------------------------

    def replace(self, rows: DataFrame, meta: DataFrame) -> int:
        """Replace the entries of ``meta(pkg, version, unit_id, indexed_at)`` by their ``rows``, which
        may be none, and prune the package versions that were touched, as one new version, which is
        returned. Rows of entries that ``meta`` lacks are not read. A writer that finds its version
        taken goes on from the one that took it; entries of both stay."""
        commit = uuid.uuid4().hex
        folder = f"{self.path}/data/commit={commit}"
        entries = meta.select(*(F.col(c).cast("string").alias(c) for c in ENTRY), F.col("indexed_at").cast("long").alias("indexed_at"))
        entries = entries.groupBy(*ENTRY).agg(F.max("indexed_at").alias("indexed_at"))
        texts = rows.withColumns({c: F.col(c).cast("string") for c in ENTRY})
        texts.sortWithinPartitions(*ENTRY).write.parquet(folder)
        counts = self.spark.read.schema(texts.schema).parquet(folder).groupBy(*ENTRY).agg(F.count("*").alias("n"))
        made = entries.join(counts, ENTRY, "left").select(*ENTRY, "indexed_at", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.lit(commit).alias("commit"))
        while True:
            base = self.latest()
            new = made.select("*", F.lit(base + 1).cast("long").alias("written"), F.lit(GENERATION).alias("generation"))
            live = self.manifest(base).join(entries.select(*ENTRY), ENTRY, "left_anti").unionByName(new)
            touched = entries.select("pkg", "version").distinct()
            mine = newest_configurations(live.join(touched, ["pkg", "version"], "left_semi"), self.keep, ("indexed_at", "written", "unit_id")).drop("rank")
            if self._publish(live.join(touched, ["pkg", "version"], "left_anti").unionByName(mine), base + 1):
                return base + 1

    # -- reading -----------------------------------------------------------------------

    def entries(self, at: int | None = None) -> DataFrame:
        return self.manifest(at).select(*ENTRY, "indexed_at", "n")

    def rows(self, at: int | None = None) -> DataFrame:
        """Rows of the live entries of one version, whatever is published meanwhile. Columns that
        came later are null in older rows."""
        return self._of(self.manifest(at), "data")

    def _of(self, manifest: DataFrame, part: str) -> DataFrame:
        held = manifest.where("n > 0")
        commits = [r["commit"] for r in held.select("commit").distinct().collect()]  # a text a live commit
        if not commits:
            return self.spark.createDataFrame([], ", ".join(f"{c} string" for c in ENTRY))
        read = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/{part}")
        rows = read.parquet(*(f"{self.path}/{part}/commit={c}" for c in commits))
        return rows.join(held.select("commit", *ENTRY), ["commit", *ENTRY], "left_semi").drop("commit")

    def vacuum(self, versions: int = 1) -> int:
        """Drop all but the newest ``versions`` versions, and commits and unpublished versions that
        none of these needs; returns how many folders went. For quiet times: the commit of a write
        still going on is in no version yet."""
        newest, gone = self.latest(), 0
        kept = range(max(1, newest - versions + 1), newest + 1)
        needed = {r["commit"] for v in kept for r in self.manifest(v).select("commit").distinct().collect()}
        for part, stays in (("versions", {f"{v:010d}" for v in kept}), ("data", {f"commit={c}" for c in needed}), ("views", {f"commit={c}" for c in needed}), ("pending", set())):
            folder = self._hadoop.Path(f"{self.path}/{part}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if status.getPath().getName() not in stays:
                    gone += bool(self._fs.delete(status.getPath(), True))
        return gone


class LiveView:
    """A temporary view of a store's rows in the form ``build`` gives them, pinned to a version.

    ``build`` must take rows one by one or entry by entry, as it runs once for each commit; what it
    made is kept in the store's folder. A view is swapped when all is written, so whoever reads sees
    one version, and who has read goes on with the old one."""

    def __init__(self, store: IndexStore, name: str, build: Callable[[DataFrame], DataFrame]) -> None:
        self.store, self.name, self.build, self.version = store, name, build, 0

    def publish(self, at: int | None = None) -> DataFrame:
        """Bring the view to a version, by default the newest, and return its rows."""
        store = self.store
        at = store.latest() if at is None else at
        manifest = store.manifest(at)
        for row in manifest.where("n > 0").select("commit").distinct().collect():
            folder = f"{store.path}/views/commit={row['commit']}"
            if not store._fs.exists(store._hadoop.Path(f"{folder}/_SUCCESS")):
                rows = store.spark.read.parquet(f"{store.path}/data/commit={row['commit']}")
                self.build(rows).write.mode("overwrite").parquet(folder)
        shown = store._of(manifest, "views")
        shown.createOrReplaceTempView(self.name)
        self.version = at
        return shown
