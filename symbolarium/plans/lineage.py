"""Cutting the lineage of iterative plans at a reliable copy."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's checkpoint folder, which all executors share. A local folder is
    set only where the session names none; on a cluster that would be wrong, so it is refused
    there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        root = tempfile.mkdtemp(prefix="symbolarium-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/symbolarium/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a columnar table in the session's checkpoint folder and read back:
    later reads take the columns they need, and a lost executor does not lose it."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast. Spark guesses sizes from compressed files and
    does not see that a list is exploded, so it would send the driver far more than it thinks."""
    return df.hint("merge")


class Gathered:
    """Rows that rounds add to, as one DataFrame; every so many rounds the parts become one table, so
    that neither the plan nor the number of tables that it reads grows with the rounds."""

    def __init__(self, first: DataFrame, parts: int = 8) -> None:
        self.rows, self._parts, self._most = first, 1, parts

    def add(self, more: DataFrame) -> None:
        self.rows, self._parts = self.rows.unionByName(more), self._parts + 1
        if self._parts == self._most:
            self.rows, self._parts = cut(self.rows), 1
