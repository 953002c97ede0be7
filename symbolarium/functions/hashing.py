"""Fingerprints, cache keys and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256_parts(parts: Column) -> Column:
    """SHA-256 of the strings of an array, each closed by NUL, so that parts cannot run together."""
    return F.sha2(F.concat(F.array_join(parts, "\0"), F.when(F.size(parts) > 0, "\0").otherwise("")), 256)


def plan_hash(units: DataFrame) -> DataFrame:
    """One row: SHA-256 of the sorted ``name-version`` lines of a plan, each closed by a newline.
    A plan's units are one project's, some hundreds; they are put together in one row."""
    lines = F.array_sort(F.collect_list(F.concat("pkg", F.lit("-"), "version", F.lit("\n"))))
    return units.agg(F.sha2(F.array_join(lines, ""), 256).alias("plan_hash"))


def tree_fingerprints(files: DataFrame, by: str | None = "component") -> DataFrame:
    """Per component (or of all, ``by`` None: the local units' files), SHA-256 over its files sorted
    by path, each as ``path NUL mtime NUL size newline``; a component's files are bounded by what
    one package holds. No file: no row per component, the empty text's hash of all."""
    mtime, size = F.col("mtime").cast("string"), F.col("size").cast("string")
    whole = F.array_sort(F.collect_list(F.struct("path", mtime.alias("mtime"), "size", F.concat("path", F.lit("\0"), mtime, F.lit("\0"), size, F.lit("\n")).alias("line"))))
    print_ = F.sha2(F.array_join(F.transform(whole, lambda x: x["line"]), ""), 256).alias("fingerprint")
    return files.agg(print_) if by is None else files.groupBy(by).agg(print_)


def inputs_fingerprint(*parts: Column) -> Column:
    """What an index was made from, as one hash; an absent part is an empty one; lists go in by ``list_part``."""
    return sha256_parts(F.array(F.lit("v2"), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def list_part(values: Column) -> Column:
    """An array of strings as one part of ``inputs_fingerprint``, whatever its order."""
    return F.array_join(F.transform(F.array_sort(values), lambda v: F.concat(v, F.lit(","))), "")


def query_key(query: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.sha2(query, 256))


def is_fresh(kind: Column, stored_at: Column, now: Column, ttl_s: Column) -> Column:
    """Immutable entries always; others strictly younger than their time to live."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(stored_at.cast("timestamp"))) / 1_000_000
    return (kind == "immutable") | F.coalesce(age < ttl_s, F.lit(False))


def http_date(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def from_http_date(text: Column) -> Column:
    return F.try_to_timestamp(F.substring(text, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))
