"""Searching by type: an index over the parts of signatures, and the tier of a lookup that uses it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions.signature import is_signature, signature_keys, signature_parts

_SYMBOL = ["component", "module", "name"]


def signature_index(rows: DataFrame) -> DataFrame:
    """``rows(component, module, name, signature)`` with ``parts`` and ``keys``; rows without a
    signature are left out. Worth writing once, as every search reads it."""
    parsed = rows.select(*_SYMBOL, "signature").distinct().withColumn("parts", signature_parts(F.col("signature")))
    return parsed.where(F.size("parts") > 0).withColumn("keys", signature_keys(F.col("parts")))


def signature_matches(asks: DataFrame, index: DataFrame | None, limit: int | None = 20) -> DataFrame:
    """The symbols of ``index`` that fit each signature of ``asks(query)``: the same result and at
    least the arguments asked for, in any order, up to the names of variables.

    Symbols with the same parts fit the same queries, so what is matched are the different lists of
    parts, found through the asked part that the fewest lists have and then checked for the others;
    each list brings its first ``limit`` symbols by name. ``extra`` counts arguments that were not asked for, ``moved`` says that the order
    differs; the first ``limit`` by these, then by name, are kept (a search result's length), null:
    all. Without an index, and for parts that no symbol has, there is no match.
    ``(query, component, module, name, signature, extra, moved, rank)``."""
    schema = "query string, component string, module string, name string, signature string, extra int, moved boolean, rank int"
    if index is None:
        return asks.sparkSession.createDataFrame([], schema)
    asked = asks.select("query").distinct().withColumn("want", signature_parts(F.col("query"))).withColumn("wanted", signature_keys(F.col("want")))
    shapes = index.select("parts", "keys").distinct()
    postings = shapes.select("parts", "keys", F.explode("keys").alias("key"))
    each = asked.select("query", F.explode("wanted").alias("key"))
    sizes = postings.join(each.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    rarest = each.join(sizes, "key", "left").groupBy("query").agg(F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key"))
    found = postings.join(rarest.join(asked, "query"), "key").where(F.size(F.array_except("wanted", "keys")) == 0)
    extra = F.size("parts") - F.size("want")
    fitting = found.select("query", "parts", extra.alias("extra"), ((extra == 0) & (F.col("parts") != F.col("want"))).alias("moved"))
    held = index.select(*_SYMBOL, "signature", "parts")
    if limit is not None:
        held = held.withColumn("nth", F.row_number().over(Window.partitionBy("parts").orderBy(*_SYMBOL, "signature"))).where(F.col("nth") <= limit).drop("nth")
    fits = fitting.join(held, "parts").select("query", *_SYMBOL, "signature", "extra", "moved")
    order = Window.partitionBy("query").orderBy("extra", "moved", *_SYMBOL, "signature")
    ranked = fits.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def local_tier(asks: DataFrame, index: DataFrame | None, named: DataFrame, limit: int = 20) -> DataFrame:
    """The second tier of a lookup, ``(query, pkg, mod, name)``: what ``named`` (the same columns) has
    for queries by name, and matches by type for the others. No index, nothing by type."""
    typed = asks.where(is_signature(F.col("query")))
    matches = signature_matches(typed, index, limit).select("query", F.col("component").alias("pkg"), F.col("module").alias("mod"), "name").distinct()
    return named.join(typed.select("query").distinct(), "query", "left_anti").select("query", "pkg", "mod", "name").unionByName(matches)
