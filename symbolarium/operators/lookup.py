"""Exact lookup over a project and a global store, scoped to a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.functions.ident import package_of


def by_name(rows: DataFrame, name: str, module: str | None = None) -> DataFrame:
    """Rows of a name, of one module if given, in no order (``newest_first``). The filters
    reach the scan."""
    out = rows.where(F.col("name") == name)
    return out if module is None else out.where(F.col("mod") == module)


def newest_first(rows: DataFrame) -> DataFrame:
    """By package and module, versions newest first as text."""
    return rows.orderBy("pkg", "mod", F.desc("version"))


def in_module(rows: DataFrame, pkg: str, module: str) -> DataFrame:
    return rows.where((F.col("pkg") == pkg) & (F.col("mod") == module)).orderBy(F.desc("version"), "name")


def module_in_stores(asks: DataFrame, project: DataFrame | None, whole: DataFrame, pins: DataFrame | None) -> DataFrame:
    """All rows of the modules ``asks(pkg, mod)`` that the pins allow: the project's, and global ones
    whose (pkg, mod, name) the project does not have. Without a project store the global rows."""
    key = ["pkg", "mod"]
    held = lambda rows: in_scope(rows.join(asks.select(*key).distinct(), key, "left_semi"), pins)
    return held(whole) if project is None else shadowed_rows(held(project), held(whole), (*key, "name"))


def configuration(rows: DataFrame, pkg: str, version: str, unit_id: str) -> DataFrame:
    return rows.where((F.col("pkg") == pkg) & (F.col("version") == version) & (F.col("unit_id") == unit_id))


def in_scope(rows: DataFrame, pins: DataFrame | None) -> DataFrame:
    """Rows of pinned packages with the pinned unit or version; no pins: every row."""
    if pins is None:
        return rows
    p = pins.select(F.col("pkg").alias("pin_pkg"), "pin_unit", "pin_version")
    hit = (F.col("pin_unit") == F.col("unit_id")) | (F.col("pin_version") == F.col("version"))
    return rows.join(p, (package_of(F.col("pkg")) == F.col("pin_pkg")) & hit, "left_semi")


def scope_with_overrides(pins: DataFrame, overrides: DataFrame) -> DataFrame:
    """A plan's pins, those of overridden packages replaced by the version asked for."""
    asked = overrides.select("pkg", F.lit(None).cast("string").alias("pin_unit"), F.col("version").alias("pin_version"))
    return pins.join(asked, "pkg", "left_anti").unionByName(asked)


def first_overrides(overrides: DataFrame) -> DataFrame:
    """Of several overrides of one package the first by ``pos``."""
    return overrides.groupBy("pkg").agg(F.min_by("version", "pos").alias("version"))


def apply_overrides(units: DataFrame, overrides: DataFrame) -> DataFrame:
    """Units with overridden versions; an override of no unit adds a synthetic one."""
    asked = overrides.select("pkg", F.col("version").alias("asked"))
    synthetic = F.concat(F.lit("unpinned:"), "pkg", F.lit("-"), "asked")
    return units.join(asked, "pkg", "full_outer").select("pkg", F.coalesce("asked", "version").alias("version"), F.coalesce("unit_id", synthetic).alias("unit_id"))


def shadowed_rows(project: DataFrame, whole: DataFrame, keys: tuple[str, ...] = ("component", "module", "name")) -> DataFrame:
    """All project rows, and global ones whose key the project does not have."""
    return project.unionByName(whole.join(project.select(*keys).distinct(), list(keys), "left_anti"))


def shadowed_entries(project: DataFrame, whole: DataFrame, entry: tuple[str, ...] = ("pkg", "version", "unit_id")) -> DataFrame:
    """Entry by entry: the project's rows if it has any, else the global ones."""
    return shadowed_rows(project, whole, entry)


def first_tier(*tiers: DataFrame) -> DataFrame:
    """Rows of the first tier that has any, with its number; later tiers do not run."""
    for n, rows in enumerate(tiers[:-1], 1):
        if not rows.isEmpty():
            return rows.withColumn("tier", F.lit(n))
    return tiers[-1].withColumn("tier", F.lit(len(tiers)))


def all_tiers(*tiers: DataFrame) -> DataFrame:
    """The same as one lazy query: a union, kept where the tier is the least that has rows."""
    union = None
    for n, rows in enumerate(tiers, 1):
        one = rows.withColumn("tier", F.lit(n))
        union = one if union is None else union.unionByName(one)
    least = union.agg(F.min("tier").alias("tier"))
    return union.join(F.broadcast(least), "tier", "left_semi")  # one row


def coalesced(base: DataFrame, key: str, value: str, *sources: tuple[str, DataFrame]) -> DataFrame:
    """Each key's value from the first source that has it, with the source's name; a cascade
    of left joins (package, directory and documentation lookup)."""
    out = base
    for n, (_, rows) in enumerate(sources):
        out = out.join(rows.groupBy(key).agg(F.min(value).alias(f"_v{n}")), key, "left")
    names = F.coalesce(*(F.when(F.col(f"_v{n}").isNotNull(), label) for n, (label, _) in enumerate(sources)))
    return out.select(*base.columns, F.coalesce(*(F.col(f"_v{n}") for n in range(len(sources)))).alias(value), names.alias("found_in"))
