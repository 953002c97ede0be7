"""Identifiers and versions of the catalogue, all ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def package_ref(text: Column) -> Column:
    """``name[-version][-hash]`` to ``struct<name, version>``. A last part of eight or more hex
    digits is a hash and goes first; then a last part of digits and dots alone (``1.2.`` too) is
    the version, null without one. Nothing is an error; the name may be empty."""
    bare = F.regexp_replace(text, r"(?s)^(.*)-[0-9A-Fa-f]{8,}\z", "$1")
    shape = r"(?s)^(.*)-([0-9.]+)\z"
    versioned = bare.rlike(shape)
    return F.struct(
        F.when(versioned, F.regexp_extract(bare, shape, 1)).otherwise(bare).alias("name"), F.when(versioned, F.regexp_extract(bare, shape, 2)).alias("version")
    )


def is_module_path(text: Column) -> Column:
    """Every dotted segment starts with A-Z."""
    return F.forall(F.split(text, r"\."), lambda s: s.rlike("^[A-Z]"))


def symbol_path(text: Column) -> Column:
    """``pkg[-ver][/Mod[/symbol]]`` to ``struct<error, package, version, module, symbol>``; the
    error is null for a good path, all else is null for a bad one. Parts after the third are
    ignored. Of several bad segments of a module the last one is told."""
    parts = F.split(text, "/")
    ref = package_ref(F.get(parts, F.lit(0)))
    module, symbol = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    bad = F.get(F.reverse(F.filter(F.split(module, r"\."), lambda s: ~s.rlike("^[A-Z]"))), F.lit(0))
    error = (
        F.when(text == "", "empty_input").when(ref["name"] == "", "empty_package").when(ref["name"].contains("@"), "invalid_package")
        .when((module == "") & symbol.isNotNull(), "symbol_without_module").when((module == "") | (bad == ""), "invalid_module")
        .when(bad.isNotNull(), "module_not_uppercase").when(symbol == "", "invalid_symbol")
    )
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(error.alias("error"), good(ref["name"]).alias("package"), good(ref["version"]).alias("version"), good(module).alias("module"), good(symbol).alias("symbol"))


def symbol_path_text(p: Column) -> Column:
    """The path again: the inverse of ``symbol_path`` where it has no error."""
    head = F.concat(p["package"], F.coalesce(F.concat(F.lit("-"), p["version"]), F.lit("")))
    return F.concat_ws("/", head, p["module"], p["symbol"])


def component_key(text: Column) -> Column:
    """``pkg``, ``pkg:sub`` or ``pkg:exe:name`` to ``struct<package, kind, name>``. What follows the
    first colon is a sublibrary's name, whatever it holds, unless it begins with ``exe:``; empty
    names (``pkg:``, ``pkg:exe:``) are the main library."""
    rest = F.substring(text, F.length(package_of(text)) + 2, F.length(text))
    exe = rest.startswith("exe:")
    name = F.when(exe, F.substring(rest, F.lit(5), F.length(rest))).otherwise(rest)
    kind = F.when(name == "", "lib").when(exe, "exe").otherwise("sublib")
    return F.struct(package_of(text).alias("package"), kind.alias("kind"), F.when(name != "", name).alias("name"))


def component_text(c: Column) -> Column:
    return F.when(c["kind"] == "exe", F.concat(c["package"], F.lit(":exe:"), c["name"])).otherwise(F.concat_ws(":", c["package"], c["name"]))


def package_of(component: Column) -> Column:
    return F.substring_index(component, ":", 1)


def qualified_name(text: Column) -> Column:
    """``Data.Map.lookup`` to ``struct<module, name>`` at the last dot; no dot: null module.
    A trailing dot leaves an empty name."""
    at = F.length(text) - F.length(F.substring_index(text, ".", -1))
    return F.struct(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).alias("module"), F.substring_index(text, ".", -1).alias("name"))


def origin_name(text: Column) -> Column:
    """``A.B.op`` to ``struct<module, name>`` by capitalised segments, at least one left for the
    name; an operator keeps its dots. A name with a bar behind it (``IsString|``) is a parent that
    is not exported itself: it, like an empty text, is null. Operators may end in a bar."""
    shape = r"(?s)^((?:[A-Z][A-Za-z0-9_']*\.)+)(.*)\z"
    rest = F.regexp_extract(text, shape, 2)
    # Capitalised segments alone: the last one is the name.
    module = F.when(text.rlike(shape) & (rest != ""), F.regexp_replace(F.regexp_extract(text, shape, 1), r"\.$", ""))
    barred = text.rlike(r"^[A-Z][A-Za-z0-9_'.]*\|\z")
    hollow = text.rlike(shape) & (rest == "")
    return F.when((text != "") & ~barred & ~hollow, F.struct(module.alias("module"), F.when(module.isNotNull(), rest).otherwise(text).alias("name")))


def origin_entries(text: Column) -> Column:
    """The entries of one listed export line: braces part a parent from what stands under it."""
    return F.filter(F.split(F.translate(text, "{}", "  "), r"\s+"), lambda e: e != "")


def version_numbers(version: Column) -> Column:
    """Numbers by which versions sort, of up to 38 digits; a segment that is none counts as 0.
    Arrays compare element by element and a shorter prefix is smaller, which is the wanted order."""
    return F.transform(F.split(version, r"\."), lambda s: F.coalesce(F.when(s.rlike(r"^[0-9]+\z"), s.try_cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")))


def version_macro(version: Column) -> Column:
    """``9.10.3`` to ``struct<major_minor 910, patch 3>``, a missing patch being 0. Null for what has
    no two parts or a part that is no number: an undefined macro is safer than a wrong one."""
    v = F.transform(F.split(version, r"\."), lambda s: s.cast("long"))
    known = version.rlike(r"^[0-9]+(\.[0-9]+)+\z")
    return F.when(known, F.struct((v[0] * 100 + v[1]).alias("major_minor"), F.coalesce(F.get(v, F.lit(2)), F.lit(0)).alias("patch")))


def shared_leading(a: Column, b: Column) -> Column:
    """How many dotted segments two paths share from the left."""
    pairs = F.arrays_zip(F.split(a, r"\.").alias("x"), F.split(b, r"\.").alias("y"))
    state = F.aggregate(
        pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, p: F.struct((s["n"] + F.when(s["on"] & p["x"].eqNullSafe(p["y"]), 1).otherwise(0)).alias("n"), (s["on"] & p["x"].eqNullSafe(p["y"])).alias("on")),
    )
    return state["n"]


def shared_trailing(a: Column, b: Column) -> Column:
    """How many ``/`` segments two paths share from the right."""
    turn = lambda c: F.array_join(F.transform(F.reverse(F.split(c, "/")), lambda s: F.replace(s, F.lit("."), F.lit("\0"))), ".")
    return shared_leading(turn(a), turn(b))


def trailing_parts(path: Column) -> Column:
    """What a path ends in, from nothing to all of it: an array of ``struct<n, text>`` with its last ``n``
    of ``/`` segments. Two paths share ``n`` segments from the right if these are equal for ``n``."""
    parts = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/").alias("text")))
    return F.coalesce(F.when(path.isNotNull(), tails), F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("text"))))


def module_of_path(path: Column) -> Column:
    """``A/B/C.hs`` to ``A.B.C``."""
    return F.replace(F.regexp_replace(path, r"\.l?hs$", ""), F.lit("/"), F.lit("."))
