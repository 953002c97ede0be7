"""Changes to the stored index, as rewrites: ``DataFrame -> DataFrame``; ``index_store`` commits them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTRY = ["pkg", "version", "unit_id"]
GENERATION = 7


def replaced_entry(rows: DataFrame, entry: dict[str, str], new: DataFrame) -> DataFrame:
    """All rows but the entry's, and the new ones; no new rows just clears the entry."""
    mine = F.lit(True)
    for column, value in entry.items():
        mine = mine & F.col(column).eqNullSafe(F.lit(value))
    return rows.where(~mine).unionByName(new)


def upserted(rows: DataFrame, new: DataFrame, keys: list[str], column: str, **absent) -> DataFrame:
    """``column`` from ``new`` where it has the key; new keys get ``absent`` elsewhere."""
    fresh = new.select(*keys, F.col(column).alias("_new"))
    out = rows.join(fresh, keys, "full_outer")
    fill = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in absent.items()}
    return out.withColumns({**fill, column: F.coalesce("_new", column)}).select(*rows.columns)


def last_values(kv: DataFrame) -> DataFrame:
    """Last writer wins: ``(k, v, seq)`` to the value of the highest seq."""
    return kv.groupBy("k").agg(F.max_by("v", "seq").alias("v"))


def newest_configurations(meta: DataFrame, keep: int = 3, by: tuple[str, ...] = ("indexed_at", "unit_id")) -> DataFrame:
    """The newest of each package version by the columns ``by``, which should tell all apart."""
    order = Window.partitionBy("pkg", "version").orderBy(*(F.desc(c) for c in by))
    return meta.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def pruned(rows: DataFrame, meta: DataFrame, keep: int = 3) -> DataFrame:
    return rows.join(newest_configurations(meta, keep).select(*ENTRY), ENTRY, "left_semi")


def with_column_if_missing(rows: DataFrame, column: str, kind: str) -> DataFrame:
    return rows if column in rows.columns else rows.withColumn(column, F.lit(None).cast(kind))


def decoded(rows: DataFrame) -> DataFrame:
    """Stored rows with an ``anomaly``: unknown visibility reads as internal, an empty
    definition component as the row's own. Split on the column; nothing is dropped."""
    bad_visibility = ~F.coalesce(F.col("visibility").isin("exposed", "internal"), F.lit(False))
    empty_home = F.coalesce(F.col("def_component"), F.lit("")) == ""
    return rows.withColumn("anomaly", F.when(bad_visibility, "unknown_visibility").when(empty_home, "empty_definition")).withColumns(
        {"visibility": F.when(bad_visibility, "internal").otherwise(F.col("visibility")), "def_component": F.when(empty_home, F.col("component")).otherwise(F.col("def_component"))}
    )


def all_fresh(units: DataFrame, stored: DataFrame) -> DataFrame:
    """Per unit, whether the stored fingerprint of every component equals its current one; a
    null fingerprint is never fresh, a component not stored is stale."""
    have = stored.select("component", F.col("fingerprint").alias("had")).groupBy("component").agg(F.max("had").alias("had"))
    fresh = F.coalesce(F.col("fingerprint") == F.col("had"), F.lit(False))
    return units.join(have, "component", "left").groupBy("unit").agg(F.bool_and(fresh).alias("fresh"), F.count("*").alias("components"))
