"""A cache of remote answers as an append-only log: inserts, touches and tombstones.

``log(key, seq, op, etag, body, kind, ttl, stored_at)``; ``op`` is ``insert``, ``touch`` (the answer
was still valid: only its time changes) or ``drop``. ``seq`` orders the changes of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = "key string, seq long, op string, etag string, body string, kind string, ttl long, stored_at long"
_HELD = ["etag", "body", "kind", "ttl"]


def cache_state(log: DataFrame) -> DataFrame:
    """What each key holds after all its changes: the last insert, unless dropped since, with the
    time of the last touch after it. Touches and drops of nothing do nothing. Of changes with one
    ``seq`` a drop counts before an insert and a touch after it."""
    of = lambda op, *more: F.max(F.when(F.col("op") == op, F.struct("seq", *more)))
    last = log.groupBy("key").agg(of("insert", "stored_at", *_HELD).alias("i"), of("touch", "stored_at").alias("t"), of("drop").alias("d"))
    live = last.where("i IS NOT NULL AND (d IS NULL OR d.seq <= i.seq)")
    touched = F.when(F.col("t.seq") >= F.col("i.seq"), F.greatest("t.stored_at", "i.stored_at"))
    return live.select("key", *(F.col(f"i.{c}").alias(c) for c in _HELD), F.coalesce(touched, "i.stored_at").alias("stored_at"), F.greatest("i.seq", "t.seq").alias("seq"))


def compacted(log: DataFrame) -> DataFrame:
    """The shortest log of the same state: one insert a key."""
    return cache_state(log).select("key", "seq", F.lit("insert").alias("op"), *_HELD, "stored_at")


def readable(body: Column) -> Column:
    """Whether a body is the JSON list of hits that it should be."""
    return F.from_json(body, "array<struct<item:string>>").isNotNull()


def dropped_corrupt(log: DataFrame) -> DataFrame:
    """Log rows that drop the keys whose body cannot be read, so that they are misses."""
    bad = cache_state(log).where(~readable(F.col("body")))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("etag", "string"), ("body", "string"), ("kind", "string"), ("ttl", "long"))]
    return bad.select("key", (F.col("seq") + 1).alias("seq"), F.lit("drop").alias("op"), *nothing, "stored_at")


def remote_answers(asks: DataFrame, log: DataFrame, network: DataFrame, now: int, offline: bool = False) -> tuple[DataFrame, DataFrame]:
    """``asks(key)`` answered, and the log rows that this adds.

    A cached body answers even offline. Offline, one that cannot be read is ``CORRUPTION`` and a
    miss ``OFFLINE``. Online both go to ``network(key, etag, body, error)``: a readable body answers
    and is inserted, over what was corrupt; an unreadable one is ``CORRUPTION``; its error is kept,
    and a key that it lacks is ``NETWORK_ERROR``; these change nothing in the cache.
    ``(key, body, resolved_from, error)``; repeated asks are one."""
    held = cache_state(log).select("key", F.col("body").alias("kept"), F.lit(True).alias("was"))
    last = log.groupBy("key").agg(F.max("seq").alias("last"))  # of dropped keys as well
    rows = asks.select("key").distinct().join(held, "key", "left").join(last, "key", "left").withColumn("good", F.coalesce(readable(F.col("kept")), F.lit(False)))
    hit = F.col("good")
    if offline:
        error = F.when(hit, None).when(F.col("was").isNotNull(), "CORRUPTION").otherwise("OFFLINE")
        answers = rows.select("key", F.when(hit, F.col("kept")).alias("body"), F.when(hit, "cache").alias("resolved_from"), error.alias("error"))
        return answers, log.limit(0)
    far = network.groupBy("key").agg(F.min(F.struct("error", "body", "etag")).alias("n"))
    rows = rows.join(far, "key", "left")
    fetched = ~hit & F.col("n.error").isNull() & readable(F.col("n.body"))
    fetched = F.coalesce(fetched, F.lit(False))
    error = F.when(hit | fetched, None).when(F.col("n").isNull(), "NETWORK_ERROR").otherwise(F.coalesce("n.error", F.lit("CORRUPTION")))
    answers = rows.select("key", F.when(hit, F.col("kept")).when(fetched, F.col("n.body")).alias("body"), F.when(hit, "cache").when(fetched, "network").alias("resolved_from"), error.alias("error"))
    added = rows.where(fetched).select(
        "key", (F.coalesce("last", F.lit(0)) + 1).alias("seq"), F.lit("insert").alias("op"), F.col("n.etag").alias("etag"), F.col("n.body").alias("body"),
        F.lit("mutable").alias("kind"), F.lit(900).cast("long").alias("ttl"), F.lit(now).cast("long").alias("stored_at"),
    )
    return answers, added


def revalidated(asks: DataFrame, log: DataFrame, replies: DataFrame, now: int) -> DataFrame:
    """Log rows of asking again for what is no longer fresh at ``now``: ``replies(key, status, etag,
    body)`` of status 304 touch the entry, of 200 replace it, others change nothing. Immutable
    entries and those within their ``ttl`` are not asked for."""
    state = cache_state(log).join(asks.select("key").distinct(), "key", "left_semi")
    old = state.where((F.col("kind") != "immutable") & (F.col("stored_at") + F.col("ttl") <= now))
    met = old.select("key", "seq", F.col("kind"), "ttl").join(replies.where(F.col("status").isin(200, 304)).groupBy("key").agg(F.min(F.struct("status", "etag", "body")).alias("r")), "key")
    new = F.col("r.status") == 200
    return met.select(
        "key", (F.col("seq") + 1).alias("seq"), F.when(new, "insert").otherwise("touch").alias("op"), F.when(new, F.col("r.etag")).alias("etag"), F.when(new, F.col("r.body")).alias("body"),
        F.when(new, F.col("kind")).alias("kind"), F.when(new, F.col("ttl")).alias("ttl"), F.lit(now).cast("long").alias("stored_at"),
    )
