"""Catalogue relations derived from the star-schema tables, by deterministic arithmetic.

They stand in for a scanned code catalogue: symbols with definitions and visibility, a
dependency plan, pins, module interfaces and an index of configurations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def _named(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    internal = F.col("p_size") % 5 == 0
    words = F.split("p_name", " ")
    return part.select(
        F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")).alias("component"),
        F.concat(F.lit("Cat."), _capital(F.col("p_type")), F.when(internal, ".Internal").otherwise("")).alias("module"),
        F.concat(F.get(words, F.lit(0)), _capital(F.get(words, F.lit(1)))).alias("name"),
        "p_type", "p_size", F.when(internal, "internal").otherwise("exposed").alias("visibility"), *more,
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(component, module, name, signature, def_component, def_module, visibility)``."""
    return _symbols(_named(spark, sf_dir))


def _symbols(rows: DataFrame) -> DataFrame:
    home = rows.groupBy("name", "p_type").agg(F.min("component").alias("def_component"), F.min("module").alias("def_module"))
    return rows.join(home, ["name", "p_type"]).select(
        "component", "module", "name", F.concat("name", F.lit(" :: "), "p_type").alias("signature"), "def_component", "def_module", "visibility"
    ).distinct()


def stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Project and global store, overlapping: sizes up to 25, and from 10."""
    rows = _named(spark, sf_dir)
    return _symbols(rows.where("p_size <= 25")), _symbols(rows.where("p_size >= 10"))


def versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored symbol rows: ``(pkg, mod, name, version, unit_id)``, several versions a package."""
    part = table(spark, sf_dir, "part")
    version = F.concat((F.col("p_size") % 3 + 1).cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string"))
    words = F.split("p_name", " ")
    internal = F.col("p_size") % 5 == 0
    component = F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))
    return part.select(
        component.alias("pkg"), F.concat(F.lit("Cat."), _capital(F.col("p_type")), F.when(internal, ".Internal").otherwise("")).alias("mod"),
        F.concat(F.get(words, F.lit(0)), _capital(F.get(words, F.lit(1)))).alias("name"), version.alias("version"),
        F.concat(component, F.lit("-"), version).alias("unit_id"),
    ).distinct()


def unit_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part k depends on k div 2 and k div 3: ``(pkg, pos, dep_pkg)`` of longs."""
    part = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("pkg"))
    two, three = F.expr("pkg div 2"), F.expr("pkg div 3")
    return part.select("pkg", F.posexplode(F.array_distinct(F.array(two, three))).alias("pos", "dep_pkg")).where("dep_pkg <> pkg")


def index_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed configurations: ``(pkg, version, unit_id, indexed_at)``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("pkg"), (F.col("user_id") % 10).cast("string").alias("version"), F.col("event_id").alias("unit_id"), F.unix_timestamp("ts").alias("indexed_at")
    )


NAMES = 7


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module k declares name n (of ``NAMES``) where (k + n) mod 3 is 0: ``(module, name)``."""
    modules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("module"))
    return modules.select("module", F.explode(F.sequence(F.lit(0), F.lit(NAMES - 1))).alias("name")).where((F.col("module") + F.col("name")) % 3 == 0)


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every module with k mod 4 < 3 exports all names; others what they declare."""
    modules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("module"))
    wide = modules.where("module % 4 < 3").select("module", F.explode(F.sequence(F.lit(0), F.lit(NAMES - 1))).alias("name"))
    return wide.unionByName(declarations(spark, sf_dir).where("module % 4 = 3"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viable imports by name: ``(module, name, target, explicit)``. Module k imports k div 2
    whole, and from k div 3 the even names explicitly."""
    k = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("module"))
    names = k.select("module", F.explode(F.sequence(F.lit(0), F.lit(NAMES - 1))).alias("name"))
    whole = names.select("module", "name", F.expr("module div 2").alias("target"), F.lit(False).alias("explicit"))
    some = names.where("name % 2 = 0").select("module", "name", F.expr("module div 3").alias("target"), F.lit(True).alias("explicit"))
    return whole.unionByName(some).where("target <> module")
