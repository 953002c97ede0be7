"""Bounded, repeatable training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """``crc32`` of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % n


def sampled(labelled: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``labelled(doc_id, text, label)``, the first by a hash of doc_id,
    whatever the partitioning; repeated rows once. Only keys are sorted, and of the texts only the
    chosen ones move. Null ids are values like others; an empty table gives an empty sample."""
    keys = ["doc_id", "label", "mark"]
    marked = labelled.select("doc_id", "text", "label", F.xxhash64("text").alias("mark"))
    first = marked.select(*keys).orderBy(F.xxhash64("doc_id", F.lit(7)), *keys).limit(limit).distinct()
    chosen = F.broadcast(first.select(*(F.col(k).alias(f"_{k}") for k in keys)))  # at most ``limit`` rows
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("label").eqNullSafe(F.col("_label")) & (F.col("mark") == F.col("_mark"))
    return marked.join(chosen, same, "left_semi").dropDuplicates(keys).drop("mark")

