"""Exact lookup by a sorted copy of the rows: of many files the few that can hold the name are read,
and of these the row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symbolarium.operators.lookup import by_name
from symbolarium.plans.lineage import shared_path

#: Rows of one file.
FILE_ROWS = 2_000_000


class NameIndex:
    """Rows ``(pkg, mod, name, version, ...)`` in files sorted by name; a frequent name may span
    several. The driver holds two names a file."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = spark.read.parquet(f"{path}/files").orderBy("first", "last", "file").collect()
        self.files = [(r["first"], r["last"], r["file"]) for r in rows]
        self.schema: StructType = spark.read.parquet(f"{path}/rows").schema

    @classmethod
    def build(cls, rows: DataFrame, path: str | None = None, file_rows: int | None = None) -> NameIndex:
        """Write the index of ``rows`` to ``path``, by default in the shared folder. Rows without a name
        answer no lookup and are left out; repeated rows stay."""
        spark, path = rows.sparkSession, path or shared_path(rows.sparkSession, "names")
        rows = rows.where("name IS NOT NULL")
        keys = ["name", *(c for c in ("pkg", "mod", "version", "unit_id") if c in rows.columns)]
        n = max(1, -(-rows.count() // (file_rows or FILE_ROWS)))
        rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.option("parquet.block.size", 8 << 20).parquet(f"{path}/rows")
        held = spark.read.schema(rows.schema).parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file"))
        held.agg(F.min("name").alias("first"), F.max("name").alias("last")).write.parquet(f"{path}/files")
        return cls(spark, path)

    def find(self, name: str, module: str | None = None) -> DataFrame:
        """The rows of a name, of one module if given; the same as ``by_name`` of all rows."""
        held = [f for first, last, f in self.files if first <= name <= last]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return by_name(self.spark.read.schema(self.schema).parquet(*held), name, module)
