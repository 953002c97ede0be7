"""Build plans, package descriptions and result shapes as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolarium.functions.ident import origin_entries, origin_name

_SOURCE = "struct<type:string,path:string,`source-repo`:struct<type:string,location:string,tag:string,subdir:string>,uri:string,repo:struct<type:string,uri:string>>"
PLAN_SCHEMA = (
    "`compiler-id` string, os string, arch string, `install-plan` array<struct<type:string,id:string,`pkg-name`:string,`pkg-version`:string,style:string,"
    f"`dist-dir`:string,`pkg-src`:{_SOURCE},depends:array<string>,`component-name`:string,components:map<string,struct<depends:array<string>>>>>"
)

#: What pins need: neither sources nor folders nor dependencies are decoded.
PINS_SCHEMA = "`install-plan` array<struct<id:string,`pkg-name`:string,`pkg-version`:string,`component-name`:string,components:map<string,string>>>"


def _has_library(u: Column) -> Column:
    return F.array_contains(F.coalesce(F.map_keys(u["components"]), F.array(F.coalesce(u["component-name"], F.lit("lib")))), "lib")


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Units of a plan file: ``(pkg, version, unit_id, pos, is_local, has_lib, origin, dist_dir, depends)``."""
    u = F.col("u")
    plan = spark.read.schema(PLAN_SCHEMA).json(path, multiLine=True)
    rows = plan.select(F.posexplode(F.col("`install-plan`")).alias("pos", "u"))
    depends = F.flatten(F.array(F.coalesce(u["depends"], F.array().cast("array<string>")), F.flatten(F.coalesce(F.transform(F.map_values(u["components"]), lambda c: c["depends"]), F.array().cast("array<array<string>>")))))
    return rows.select(
        u["pkg-name"].alias("pkg"), u["pkg-version"].alias("version"), u["id"].alias("unit_id"), "pos", F.coalesce(u["style"] == "local", F.lit(False)).alias("is_local"),
        _has_library(u).alias("has_lib"), origin(u).alias("origin"), u["dist-dir"].alias("dist_dir"), F.array_distinct(depends).alias("depends"),
    )


def read_pins(spark: SparkSession, path: str) -> DataFrame:
    """Package to version and unit, library unit last; only what these need is read and shuffled."""
    u = F.col("u")
    rows = spark.read.schema(PINS_SCHEMA).json(path, multiLine=True).select(F.posexplode(F.col("`install-plan`")).alias("pos", "u"))
    units = rows.select(u["pkg-name"].alias("pkg"), u["pkg-version"].alias("version"), u["id"].alias("unit_id"), "pos", _has_library(u).alias("has_lib"))
    return library_last(units, "version", "unit_id")


def origin(u: Column) -> Column:
    """Where a unit comes from, by its source block."""
    kind = u["pkg-src"]["type"]
    return F.when(kind.isNull(), "distribution").when(kind == "repo-tar", "hackage").when(kind == "local", "local").when(kind == "local-tar", "local-tarball").when(kind == "remote-tar", "remote-tarball").when(kind == "source-repo", "source-repository-package").otherwise("distribution")


def library_last(units: DataFrame, *columns: str) -> DataFrame:
    """One unit a package: with a library if any has, the last in the plan. ``columns`` are those to
    keep, all by default; no other is read or shuffled."""
    columns = columns or tuple(c for c in units.columns if c != "pkg")
    best = units.groupBy("pkg").agg(F.max_by(F.struct(*columns), F.struct("has_lib", "pos")).alias("x"))
    return best.select("pkg", "x.*")


def dependency_edges(units: DataFrame) -> DataFrame:
    """``(pkg, pos, dep_pkg, dep_version)``; ids that are no unit of the plan are dropped."""
    ids = units.select(F.col("unit_id").alias("dep"), F.col("pkg").alias("dep_pkg"), F.col("version").alias("dep_version"))
    return library_last(units, "depends").select("pkg", F.posexplode("depends").alias("pos", "dep")).join(ids, "dep").select("pkg", "pos", "dep_pkg", "dep_version")


def planned(asks: DataFrame, units: DataFrame) -> DataFrame:
    """``asks(pkg)`` with the ``version`` and ``unit_id`` that the plan has for each, null for packages
    it lacks; of a package's units the library's, the last in the plan."""
    return asks.select("pkg").distinct().join(library_last(units, "version", "unit_id"), "pkg", "left")


def live_branches(stanzas: DataFrame) -> DataFrame:
    """``then`` rows unless the condition is known false, ``else`` rows unless known true;
    what cannot be decided keeps both."""
    return stanzas.where(F.when(F.col("branch") == "then", F.coalesce("cond", F.lit(True))).otherwise(F.coalesce(~F.col("cond"), F.lit(True))))


def composed_environments(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The union of two environments' packages, the primary's location (and compiler, if the
    environments carry one) first."""
    carried = [c for c in primary.columns if c != "pkg"]
    one, two = (rows.select("pkg", *(F.col(c).alias(f"_{k}{c}") for c in carried)) for k, rows in enumerate((primary, secondary)))
    return one.join(two, "pkg", "full_outer").select("pkg", *(F.coalesce(f"_0{c}", f"_1{c}").alias(c) for c in carried))


def module_files(files: DataFrame, dirs: DataFrame, modules: DataFrame) -> DataFrame:
    """``modules(component, module)`` to their file: the first source directory, by ``pos``,
    that holds it; modules without a file are dropped."""
    wanted = modules.join(dirs, "component").withColumn("path", F.concat("dir", F.lit("/"), F.replace("module", F.lit("."), F.lit("/")), F.lit(".hs")))
    return wanted.join(files.select("path"), "path", "left_semi").groupBy("component", "module").agg(F.min_by("path", "pos").alias("path"))


#: Directories, beside hidden ones, that a source walk does not enter.
SKIPPED = ("dist", "dist-newstyle", "test", "tests", "bench", "benchmarks", "Setup")


def source_files(spark: SparkSession, root: str, depth: int = 4, skipped: tuple[str, ...] = SKIPPED, suffix: str = ".hs") -> DataFrame:
    """Sources under ``root`` down to ``depth`` directories: ``(path, relative, size, mtime, content)``;
    bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    relative = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    parts = F.split(relative, "/")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    closed = F.exists(above, lambda d: d.startswith(".") | d.isin(*skipped))
    return files.where((F.size(parts) <= depth + 1) & ~closed).select(
        "path", relative.alias("relative"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    )


def sections(lines: DataFrame, key: str, is_header: Column) -> DataFrame:
    """Number the sections of each ``key``'s lines: a header begins one; before the first, 0."""
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.sum(F.when(is_header, 1).otherwise(0)).over(run))


def dump_exports(lines: DataFrame) -> DataFrame:
    """Interface dumps ``lines(file, pos, text)`` to ``(module, name, pos, origin_module)``: the
    indented words under ``exports:``, those in braces too, bare ones from the module itself, the
    first of equals; parents that a bar marks as not exported are left out."""
    header = ~F.col("text").rlike(r"^\s")
    numbered = sections(lines, "file", header)
    modules = numbered.where(F.col("text").rlike(r"^interface ")).groupBy("file").agg(F.min(F.regexp_extract("text", r"^interface\s+(?:\S+:)?([A-Z][\w.']*)", 1)).alias("module"))
    listed = numbered.where(F.col("text") == "exports:").select("file", "section")
    entries = numbered.where(~header).join(listed, ["file", "section"]).select("file", "pos", F.explode(origin_entries(F.col("text"))).alias("entry"))
    named = entries.join(modules, "file").withColumn("o", origin_name(F.col("entry"))).where("o IS NOT NULL")
    return named.groupBy("module", F.col("o.name").alias("name"), F.coalesce("o.module", "module").alias("origin_module")).agg(F.min("pos").alias("pos"))


def selected_fields(rows: DataFrame, key: str, asked: list[str], keep: list[str] | None = None) -> DataFrame:
    """Results cut to a field set ``keep`` (the compact or the full one; None: all), then to the
    fields asked for (none: all of them), and those asked for that no result has."""
    have = [c for c in rows.columns if c != key and (keep is None or c in keep)]
    shown = [c for c in have if not asked or c in asked]
    unmatched = F.lit(",".join(f for f in asked if f not in have))
    return rows.select(key, (F.to_json(F.struct(*shown)) if shown else F.lit("{}")).alias("result"), unmatched.alias("unmatched"))


#: Short forms of field names.
ALIASES = {"sig": "signature", "haddock": "haddock_raw"}


def parsed_fields(text: str) -> list[str]:
    return [ALIASES.get(f, f) for f in (p.strip() for p in text.split(",")) if f]


def envelope(result: Column, outside_plan: Column, overrides: Column | None = None, actions: Column | None = None) -> Column:
    """A success as JSON; what is empty or false is left out."""
    parts = [result.alias("result"), F.when(outside_plan, F.lit(True)).alias("outside_plan")]
    if overrides is not None:
        parts.append(F.when(F.size(overrides) > 0, overrides).alias("overrides"))
    if actions is not None:
        parts.append(F.when(F.size(actions) > 0, actions).alias("actions"))
    return F.to_json(F.struct(*parts))


def error_envelope(code: Column, message: Column, exit_code: Column, actions: Column) -> Column:
    error = F.struct(code.alias("code"), message.alias("message"), exit_code.alias("exit_code"))
    return F.to_json(F.struct(error.alias("error"), F.when(F.size(actions) > 0, actions).alias("actions")))


def action_hints(actions: Column, most: int = 5) -> Column:
    """The first ``most`` of an ordered ``array<struct<label, command>>`` as a map."""
    return F.map_from_entries(F.slice(actions, 1, most))


def component_listing(units: DataFrame, components: DataFrame) -> DataFrame:
    """``(pkg, component, origin)`` of all components; a unit without any lists its library."""
    listed = units.select("pkg", "origin").join(components.select("pkg", "component"), "pkg", "left")
    return listed.select("pkg", F.coalesce("component", "pkg").alias("component"), "origin")


def source_directories(components: DataFrame, planned: DataFrame, guessed: DataFrame) -> DataFrame:
    """Source directories of ``components(component, kind)``: the plan's, else for a main library
    what the conventional layout suggests, else null."""
    plan, guess = planned.withColumnRenamed("dirs", "_plan"), guessed.withColumnRenamed("dirs", "_guess")
    return components.join(plan, "component", "left").join(guess, "component", "left").select("component", F.coalesce("_plan", F.when(F.col("kind") == "lib", F.col("_guess"))).alias("dirs"))


def plan_counts(units: DataFrame) -> DataFrame:
    """One row: local units, dependencies, all."""
    return units.agg(F.count_if("is_local").alias("project"), F.count_if(~F.col("is_local")).alias("dependencies"), F.count("*").alias("total"))


def generation_guarded(rows: DataFrame, generation: int) -> DataFrame:
    """Rows of the current index format only; any other is as if never written."""
    return rows.where(F.coalesce(F.col("generation") == generation, F.lit(False)))
