"""Package descriptions, environments and caches, read into relations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolarium.functions.ident import package_ref, version_macro, version_numbers
from symbolarium.plans.lineage import Gathered, cut, shuffled

COMPONENT_TYPE = "path string, package string, kind string, name string, branch string, cond string, list string, value string, pos int, error string"
_STANZA = re.compile(r"^(library|executable|common|test-suite|benchmark|foreign-library|flag|source-repository)\b\s*(\S*)", re.IGNORECASE)
_FIELD = re.compile(r"^([A-Za-z-]+)\s*:\s*(.*)$")
_LISTS = {"exposed-modules", "other-modules", "hs-source-dirs", "default-extensions", "default-language"}


def description_fields(text: str | None) -> list[tuple]:
    """The list fields of a package description, each value with its component, all conditions
    it stands under, put together, and its place in the text: ``(package, kind, name, branch,
    cond, list, value, pos, error)``.

    Indentation says what belongs to what. A text without a package name has one row, its error.
    """
    package, out = None, []
    kind = name = field = None
    field_indent, conditions = 0, []
    for raw in (text or "").splitlines():
        line = raw.split("--", 1)[0].rstrip()
        if not line.strip():
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        conditions = [c for c in conditions if c[0] < indent or (body == "else" and c[0] == indent and c[1] == "then")]
        stanza = _STANZA.match(body) if indent == 0 else None
        if stanza:
            kind, name = stanza[1].lower(), stanza[2] or None
            kind = {"library": "sublib" if name else "lib", "executable": "exe"}.get(kind, kind)
            field, conditions = None, []
        elif body.startswith("if "):
            conditions.append((indent, "then", body[3:].strip()))
            field = None
        elif body == "else":
            conditions[-1:] = [(indent, "else", conditions[-1][2])] if conditions else []
            field = None
        elif (match := _FIELD.match(body)) and not (field and indent > field_indent):
            field, field_indent = match[1].lower(), indent
            if kind is None and field == "name":
                package = match[2].strip()
            body = match[2]
        if field in _LISTS and kind in ("lib", "sublib", "exe") and not stanza:
            holds = [f"({c})" if branch == "then" else f"!({c})" for _, branch, c in conditions]
            for value in filter(None, re.split(r"[,\s]+", body)):
                out.append((package, kind, name, "then" if holds else None, " && ".join(holds) or None, field, value, len(out), None))
    return out if package else [(*[None] * 8, "no package name")]


def component_fields(files: DataFrame) -> DataFrame:
    """Fields of the descriptions ``files(path, value)``, a row for each value (see
    ``COMPONENT_TYPE``); one that cannot be read has one row, with its ``error``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COMPONENT_TYPE.split(", ")]
        for batch in batches:
            rows = [(p, *f) for p, t in zip(batch["path"], batch["value"], strict=True) for f in description_fields(t)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "value").mapInPandas(parse, COMPONENT_TYPE)


def read_components(spark: SparkSession, path: str) -> DataFrame:
    """``component_fields`` of all descriptions under ``path``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.cabal")
    return component_fields(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def condition_value(cond: Column, os: str, arch: str) -> Column:
    """Whether a condition holds, as three-valued logic: ``os`` and ``arch`` are known, flags and
    compilers are not (null). ``!``, ``&&``, ``||`` and parentheses, ``&&`` binding closer.

    Tests become letters; then what can be worked out is, once for each character at most."""
    out = F.lower(cond)
    for test, value in (("os", os), ("arch", arch)):
        known = "".join(f"[{c}]" if c.isalnum() else "\\" + c for c in value.lower())
        out = F.regexp_replace(F.regexp_replace(out, rf"\b{test}\s*\(\s*{known}\s*\)", " T "), rf"\b{test}\s*\([^)]*\)", " F ")
    out = F.regexp_replace(out, r"\b(flag|impl)\s*\([^)]*\)", " U ")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\btrue\b", "T"), r"\bfalse\b", "F"), r"\s+", "")
    rules = [
        ("!T", "f"), ("!F", "T"), ("f", "F"), ("!U", "U"), (r"\(([TFU])\)", "$1"),
        (r"(?<!!)(?:T&&([TFU])|([FU])&&T)", "$1$2"), (r"(?<!!)(?:F&&[FU]|U&&F)", "F"), (r"(?<!!)U&&U", "U"),
        (r"(?<![!&])(?:F\|\|([TFU])|([TU])\|\|F)(?!&&)", "$1$2"), (r"(?<![!&])(?:T\|\|[TU]|U\|\|T)(?!&&)", "T"), (r"(?<![!&])U\|\|U(?!&&)", "U"),
    ]

    def step(state: Column, _: Column) -> Column:
        for pattern, result in rules:
            state = F.regexp_replace(state, pattern, result)
        return state

    done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(out))), out, step)
    return F.when(done == "T", True).when(done == "F", False)


def live_fields(fields: DataFrame, os: str, arch: str) -> DataFrame:
    """Fields of branches that hold or cannot be decided; rows of errors are left out."""
    fields = fields.where("error IS NULL") if "error" in fields.columns else fields
    # Few conditions differ: each is worked out once.
    told = fields.where("cond IS NOT NULL").select("cond").distinct().withColumn("_holds", condition_value(F.col("cond"), os, arch))
    rows, holds = fields.join(told, "cond", "left"), F.col("_holds")
    live = F.when(F.col("branch") == "else", F.coalesce(~holds, F.lit(True))).otherwise(F.coalesce(holds, F.lit(True)))
    return rows.where(live).select(fields.columns)


def exposed_modules(fields: DataFrame) -> DataFrame:
    """The exposed modules of each package, stanza after stanza as they are written, each once."""
    first = fields.where("list = 'exposed-modules'").groupBy("package", "value").agg(F.min("pos").alias("pos"))
    return first.groupBy("package").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("modules"))


def component_report(fields: DataFrame, os: str, arch: str) -> dict[str, DataFrame]:
    """What a set of descriptions holds: ``modules`` of components and ``dirs`` of their sources,
    both of live branches, the ``exposed`` modules of packages, and the ``errors`` by path."""
    live = live_fields(fields, os, arch)
    dirs = live.where("list = 'hs-source-dirs'").select("package", "kind", "name", F.col("value").alias("dir"), "pos")
    return {"modules": component_modules(live), "dirs": dirs, "exposed": exposed_modules(live), "errors": fields.where("error IS NOT NULL").select("path", "error")}


def component_modules(fields: DataFrame) -> DataFrame:
    """``(component, module, visibility)`` of every component."""
    component = F.when(F.col("kind") == "lib", F.col("package")).when(F.col("kind") == "exe", F.concat("package", F.lit(":exe:"), "name")).otherwise(F.concat_ws(":", "package", "name"))
    return fields.where("list IN ('exposed-modules', 'other-modules')").select(
        component.alias("component"), F.col("value").alias("module"), F.when(F.col("list") == "exposed-modules", "exposed").otherwise("internal").alias("visibility")
    ).distinct()


def with_walked(stanzas: DataFrame, walked: DataFrame) -> DataFrame:
    """Stanza modules, and for components without any, those found by walking, all exposed."""
    rest = walked.join(stanzas.select("component").distinct(), "component", "left_anti").select("component", "module", F.lit("exposed").alias("visibility"))
    return stanzas.select("component", "module", "visibility").unionByName(rest)


#: Conventional source directories.
SOURCE_DIRS = ["src", "lib", "library", "source", "app", "Source"]


def source_roots(files: DataFrame) -> DataFrame:
    """``files(package, relative)``: those under conventional directories if the package has
    any, else all; never both, so nothing counts twice."""
    conventional = F.substring_index("relative", "/", 1).isin(SOURCE_DIRS) & F.col("relative").contains("/")
    has = files.groupBy("package").agg(F.bool_or(conventional).alias("has"))
    return files.withColumn("conventional", conventional).join(has, "package").where("conventional OR NOT has").drop("conventional", "has")


#: Where a module's file is looked for first, in order, and folders, beside hidden
#: ones, that the search after that does not enter.
MODULE_DIRS = ["src", "library", "lib", "Library", "source", "Source"]
CLOSED_DIRS = ["dist", "dist-newstyle", "build", "test", "tests", "bench", "benchmarks"]


def module_file(files: DataFrame, asks: DataFrame, depth: int = 4) -> DataFrame:
    """``asks(package, module)`` to one file of ``files(package, relative)``: at the root, else in a
    conventional directory in order, else in some folder at most ``depth`` deep: of a folder's own
    subfolders before any deeper one, and of those all below the first by name before the next.
    Hidden folders and ``CLOSED_DIRS`` are not entered by that last search."""
    wanted = asks.withColumn("tail", F.concat(F.replace("module", F.lit("."), F.lit("/")), F.lit(".hs")))
    hits = files.join(wanted, "package").where((F.col("relative") == F.col("tail")) | F.col("relative").endswith(F.concat(F.lit("/"), F.col("tail"))))
    above = F.expr("substring(relative, 1, length(relative) - length(tail) - 1)")
    hits = hits.withColumn("above", F.when(F.col("relative") == F.col("tail"), F.array().cast("array<string>")).otherwise(F.split(above, "/")))
    levels, first = F.size("above"), F.array_position(F.lit(MODULE_DIRS), F.get("above", F.lit(0)))
    closed = F.exists("above", lambda d: d.startswith(".") | d.isin(*CLOSED_DIRS))
    place = F.when(levels == 0, 0).when((levels == 1) & (first > 0), first.cast("int")).when((levels <= depth) & ~closed, len(MODULE_DIRS) + 1)
    steps = F.transform("above", lambda d, i: F.struct((i + 1 < levels).alias("deeper"), d.alias("folder")))
    order = F.struct(place.alias("place"), steps.alias("steps"), F.col("relative").alias("relative"))
    return hits.where(place.isNotNull()).groupBy("package", "module").agg(F.min(order)["relative"].alias("relative"))


def document_places(asks: DataFrame, cache: DataFrame, built: DataFrame, environment: DataFrame) -> DataFrame:
    """Where the rendered documents of ``asks(pkg)`` are: ``(pkg, path, found_in, state)``.

    A folder in ``cache(pkg, index)`` settles it: with an index it is found, without one (null) it is
    ``empty`` and no other place is asked. Else the build folder's index ``built(pkg, index)``, if
    there is one, else the environment's ``environment(pkg, index)``; else ``absent``."""
    one = lambda rows, c: rows.groupBy("pkg").agg(F.min("index").alias(c), F.lit(True).alias(f"{c}_there"))
    rows = asks.select("pkg").distinct().join(one(cache, "c"), "pkg", "left").join(one(built, "b"), "pkg", "left").join(one(environment, "e"), "pkg", "left")
    path = F.when(F.col("c_there"), F.col("c")).otherwise(F.coalesce("b", "e"))
    found_in = F.when(F.col("c_there"), "cache").when(F.col("b").isNotNull(), "build").when(F.col("e").isNotNull(), "environment")
    state = F.when(path.isNotNull(), "found").when(F.col("c_there"), "empty").otherwise("absent")
    return rows.select("pkg", path.alias("path"), F.when(path.isNotNull() | F.col("c_there"), found_in).alias("found_in"), state.alias("state"))


def collection_places(units: DataFrame, store: DataFrame, distribution: DataFrame, generated: DataFrame) -> DataFrame:
    """The text collection of ``units(pkg, is_local)``: ``store(pkg, path)``, else ``distribution(pkg,
    path)``, else for local units what ``generated(pkg, path, error)`` came to.
    ``(pkg, path, found_in, error)``; a unit that is not local and in neither place has the error
    ``no_store_entry``, a local one that nobody generated ``not_generated``."""
    one = lambda rows, c: rows.where("path IS NOT NULL").groupBy("pkg").agg(F.min("path").alias(c))
    made = generated.groupBy("pkg").agg(F.min(F.struct("error", "path")).alias("g"))
    rows = units.groupBy("pkg").agg(F.bool_or("is_local").alias("is_local")).join(one(store, "s"), "pkg", "left").join(one(distribution, "d"), "pkg", "left").join(made, "pkg", "left")
    own = F.when(F.col("is_local"), F.col("g.path"))
    path = F.coalesce("s", "d", own)
    found_in = F.when(F.col("s").isNotNull(), "store").when(F.col("d").isNotNull(), "distribution").when(own.isNotNull(), "generated")
    error = F.when(path.isNotNull(), None).when(~F.col("is_local"), "no_store_entry").otherwise(F.coalesce("g.error", F.lit("not_generated")))
    return rows.select("pkg", path.alias("path"), found_in.alias("found_in"), error.alias("error"))


def installed_packages(entries: DataFrame) -> DataFrame:
    """``entries(entry)``, names in a package store, to distinct packages; only entries that
    end in a hash of eight or more hex digits are packages."""
    real = entries.where(F.col("entry").rlike(r"-[0-9A-Fa-f]{8,}$"))
    return real.select(package_ref(F.col("entry")).alias("r")).where("r.version IS NOT NULL").select("r.name", "r.version").distinct()


def profile_packages(files: DataFrame) -> DataFrame:
    """``files(path, value)`` of package registrations to ``(name, version)``."""
    field = lambda n: F.trim(F.regexp_extract("value", rf"(?m)^{n}:\s*(\S+)", 1))
    return files.select(field("name").alias("name"), field("version").alias("version")).where("name <> '' AND version <> ''").distinct()


def pinned_overrides(overrides: DataFrame) -> DataFrame:
    """``overrides(text)`` of the form ``PKG=VER`` to ``(text, pkg, version, error)``; white space
    around either goes. The three errors: no ``=``, an empty package, an empty version."""
    at = F.instr("text", "=")
    pkg = F.regexp_replace(F.substring_index("text", "=", 1), r"(?U)^\s+|\s+$", "")
    version = F.regexp_replace(F.substring(F.col("text"), at + 1, F.length("text")), r"(?U)^\s+|\s+$", "")
    error = F.when(at == 0, "missing_equals").when(pkg == "", "empty_package").when(version == "", "empty_version")
    return overrides.select("text", F.when(error.isNull(), pkg).alias("pkg"), F.when(error.isNull(), version).alias("version"), error.alias("error"))


def latest_version(bodies: DataFrame) -> DataFrame:
    """``bodies(pkg, body)`` of package descriptions to their ``version`` field; null where the body
    is no object or the field no string."""
    field = F.from_json("body", "version string")["version"]
    return bodies.select("pkg", F.when(F.get_json_object("body", "$.version").isNotNull() & F.col("body").rlike(r'"version"\s*:\s*"'), field).alias("version"))


def known_versions(bodies: DataFrame) -> DataFrame:
    """``bodies(pkg, body)`` with flat objects of version to status, to ``(pkg, version, place)``, the
    newest first."""
    keys = F.map_keys(F.from_json("body", "map<string,string>"))
    rows = bodies.select("pkg", F.explode(F.array_distinct(keys)).alias("version"))
    order = Window.partitionBy("pkg").orderBy(F.desc(version_numbers(F.col("version"))), F.desc("version"))
    return rows.withColumn("place", F.row_number().over(order))


def synthetic_plan(installed: DataFrame) -> DataFrame:
    """Units for installed packages where there is no plan, under a key that no plan has."""
    unit = F.concat(F.lit("unpinned:"), "name", F.lit("-"), "version")
    return installed.select(F.col("name").alias("pkg"), "version", unit.alias("unit_id"), F.lit(False).alias("is_local"), F.lit("distribution").alias("origin"))


def store_prefix(entries: DataFrame, packages: DataFrame) -> DataFrame:
    """Store entries of a package version, by name prefix up to the hash."""
    p = packages.select("name", "version", F.concat("name", F.lit("-"), "version").alias("stem"))
    stem = F.regexp_replace("entry", r"-[0-9A-Fa-f]{8,}$", "")
    return entries.withColumn("stem", stem).join(p, "stem").select("name", "version", "entry")


def picked_checkouts(candidates: DataFrame) -> DataFrame:
    """``candidates(package, path, head, wanted, mtime)``: at the wanted commit first, then the
    newest."""
    order = Window.partitionBy("package").orderBy(F.desc(F.coalesce(F.col("head") == F.col("wanted"), F.lit(False))), F.desc("mtime"), "path")
    return candidates.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def head_commits(repos: DataFrame, loose: DataFrame, packed: DataFrame) -> DataFrame:
    """``repos(path, head)`` to commits: a symbolic head by its loose reference, else by the
    packed ones; a plain head is the commit."""
    ref = F.regexp_extract("head", r"^ref:\s*(\S+)", 1)
    rows = repos.withColumn("ref", ref)
    found = rows.join(loose.withColumnRenamed("commit", "_loose"), ["path", "ref"], "left").join(packed.withColumnRenamed("commit", "_packed"), ["path", "ref"], "left")
    return found.select("path", F.when(F.col("ref") == "", F.regexp_replace("head", r"\s+", "")).otherwise(F.coalesce("_loose", "_packed")).alias("commit"))


def known_platform(value: Column, known: list[str], fallback: str) -> Column:
    return F.when(F.lower(value).isin(known), F.lower(value)).otherwise(fallback)


def found_tarballs(files: DataFrame) -> DataFrame:
    """``files(repo_pos, path)`` named ``.../name/version/name-version.tar.gz``: of each package
    version the first repository's."""
    name, version = F.regexp_extract("path", r"/([^/]+)/([^/]+)/\1-\2\.tar\.gz$", 1), F.regexp_extract("path", r"/([^/]+)/([^/]+)/\1-\2\.tar\.gz$", 2)
    hits = files.select(name.alias("name"), version.alias("version"), "repo_pos", "path").where("name <> ''")
    return hits.groupBy("name", "version").agg(F.min_by("path", F.struct("repo_pos", "path")).alias("path"))


def module_owners(asks: DataFrame, owners: DataFrame) -> DataFrame:
    """``asks(module)`` to every ``owners(module, pkg, version)`` that exposes it."""
    return asks.select("module").distinct().join(owners, "module")


def latest_responses(cache: DataFrame) -> DataFrame:
    """Of an append-only response cache the last stored entry of each key."""
    return cache.groupBy("key").agg(F.max_by(F.struct(*(c for c in cache.columns if c != "key")), "stored_at").alias("x")).select("key", "x.*")


def offline_answers(asks: DataFrame, cache: DataFrame) -> DataFrame:
    """``asks(key)`` answered from the cache alone; a miss is an error row."""
    return asks.join(latest_responses(cache), "key", "left").withColumn("error", F.when(F.col("stored_at").isNull(), "OFFLINE"))


def decoded_hits(bodies: DataFrame) -> DataFrame:
    """Remote search results ``bodies(key, body)`` as rows; what a hit lacks is empty. A body
    that is no such JSON is kept as an error row."""
    hits = F.from_json("body", "array<struct<package:struct<name:string>,module:struct<name:string>,item:string,docs:string>>")
    rows = bodies.withColumn("hits", hits)
    text = lambda c: F.coalesce(c, F.lit(""))
    good = rows.where("hits IS NOT NULL").select("key", F.posexplode("hits").alias("pos", "h"))
    bad = rows.where("hits IS NULL").select("key", F.lit(None).cast("int").alias("pos"), *(F.lit("").alias(c) for c in ("pkg", "mod", "item", "docs")), F.lit("CORRUPT").alias("error"))
    return good.select("key", "pos", text(F.col("h.package.name")).alias("pkg"), text(F.col("h.module.name")).alias("mod"), text(F.col("h.item")).alias("item"), text(F.col("h.docs")).alias("docs"), F.lit(None).cast("string").alias("error")).unionByName(bad)


def macro_headers(deps: DataFrame, compiler: str | None = None) -> DataFrame:
    """Version macros of a component's dependencies, one text: ``deps(component, name, version)``,
    after the compiler's own where its version is known. Parts of a version that are no numbers
    are skipped; macros take three, missing ones being 0."""
    numbers = F.filter(F.transform(F.split("version", r"\."), lambda s: s.try_cast("long")), lambda n: n.isNotNull())
    part = lambda k: F.coalesce(F.get(numbers, F.lit(k)), F.lit(0)).cast("string")
    macro = F.replace("name", F.lit("-"), F.lit("_"))
    block = F.concat(
        F.lit("/* package "), "name", F.lit("-"), "version", F.lit(" */\n#define VERSION_"), macro, F.lit(' "'), "version", F.lit('"\n#define MIN_VERSION_'), macro,
        F.lit("(major1,major2,minor) (\\\n  (major1) <  "), part(0), F.lit(" || \\\n  (major1) == "), part(0), F.lit(" && (major2) <  "), part(1),
        F.lit(" || \\\n  (major1) == "), part(0), F.lit(" && (major2) == "), part(1), F.lit(" && (minor) <= "), part(2), F.lit(")\n"),
    )
    v = version_macro(F.lit(compiler))
    own = F.coalesce(F.concat(F.lit("#define __GLASGOW_HASKELL__ "), v["major_minor"].cast("string"), F.lit("\n#define __GLASGOW_HASKELL_PATCHLEVEL1__ "), v["patch"].cast("string"), F.lit("\n")), F.lit(""))
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", block.alias("block")))), lambda x: x["block"]), "")
    return deps.groupBy("component").agg(F.concat(F.lit("/* synthesised from the build plan */\n"), own, blocks).alias("header"))


def implied_flags(implications: DataFrame, turned_on: DataFrame) -> DataFrame:
    """Extensions on after all implications: ``turned_on(flag)``, ``implications(flag, implied,
    state)``. What is asked for outright stays on; of what is only implied, off wins. Each round
    settles flags that no earlier one did, so it ends when a round brings none."""
    state = cut(turned_on.select("flag", F.lit(True).alias("on")).distinct())
    fresh = state
    while True:
        more = fresh.where("on").join(implications, "flag").select(F.col("implied").alias("flag"), F.col("state").alias("on")).distinct().join(state, "flag", "left_anti")
        fresh = cut(more.groupBy("flag").agg(F.bool_and("on").alias("on")))
        if fresh.isEmpty():
            return state
        state = cut(state.unionByName(fresh))


def applied_extensions(settings: DataFrame, implications: DataFrame) -> DataFrame:
    """The extensions a module has on in the end: ``settings(module, pos, flag, state)`` are applied
    in order (a language's own, the package's defaults, then pragmas). Turning one on turns on or
    off all that it implies, however far; turning one off leaves what it implied. So the last
    setting that names or implies a flag decides. ``(module, flag)`` of those left on."""
    link = lambda state: implications.where(F.col("state") == state).select(F.col("flag").alias("via"), F.col("implied").alias("to"))
    on = cut(link(True))
    # What decides is the last setting alone, so a round passes on the last place at which a module turns a flag on.
    fresh = cut(settings.where("state").groupBy("module", F.col("flag").alias("to")).agg(F.max("pos").alias("pos")))
    known = Gathered(fresh)
    while not fresh.isEmpty():
        step = fresh.select("module", F.col("to").alias("via"), "pos").join(shuffled(on), "via").groupBy("module", "to").agg(F.max("pos").alias("pos"))
        before = known.rows.groupBy("module", "to").agg(F.max("pos").alias("before"))
        later = F.col("before").isNull() | (F.col("before") < F.col("pos"))
        fresh = cut(step.join(shuffled(before), ["module", "to"], "left").where(later).select("module", "to", "pos"))
        known.add(fresh)
    last_on = cut(known.rows.groupBy("module", "to").agg(F.max("pos").alias("pos")))
    off = last_on.select("module", F.col("to").alias("via"), "pos").join(shuffled(link(False)), "via").select("module", "to", "pos")
    off = off.unionByName(settings.where("NOT state").select("module", F.col("flag").alias("to"), "pos"))
    last_off = off.groupBy("module", "to").agg(F.max("pos").alias("off"))
    left = last_on.join(shuffled(last_off), ["module", "to"], "left").where("off IS NULL OR pos > off")  # of one setting, off wins
    return left.select("module", F.col("to").alias("flag"))


def flag_kind(flag: Column, languages: list[str], extensions: list[str], ignorable: list[str]) -> Column:
    """What a flag name is: language, extension, negated extension, ignorable or unknown."""
    return F.when(flag.isin(languages), "language").when(flag.isin(extensions), "extension").when(flag.startswith("No") & F.substring(flag, F.lit(3), F.length(flag)).isin(extensions), "negated").when(flag.isin(ignorable), "ignorable").otherwise("unknown")
