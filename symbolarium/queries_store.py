"""Queries over what the engine itself stores: versions of the index, its live view, cached answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.operators import responses
from symbolarium.operators.index_store import IndexStore, LiveView
from symbolarium.operators.store import ENTRY
from symbolarium.plans.lineage import shared_path
from symbolarium.queries import query
from symbolarium.sources import catalog

# -- versions -------------------------------------------------------------------------------

# Three writes of a third of the entries each, then one that indexes every tenth of the first again.
# Every fourth entry has no rows. What is pruned early would not be among the newest later either.
_COMMITS = """WITH e AS (SELECT event_type AS pkg, CAST(user_id % 10 AS VARCHAR) AS version, CAST(event_id AS VARCHAR) AS unit_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS t, props FROM events),
writes AS (SELECT *, event_id % 3 + 1 AS written, t AS indexed_at, props AS name FROM e UNION ALL SELECT *, 4, t + 86400, 'again' FROM e WHERE event_id % 30 = 0),
latest AS (SELECT * FROM writes WHERE written <= {last} QUALIFY row_number() OVER (PARTITION BY pkg, version, unit_id ORDER BY written DESC) = 1),
live AS (SELECT * FROM latest QUALIFY row_number() OVER (PARTITION BY pkg, version ORDER BY indexed_at DESC, written DESC, unit_id DESC) <= 3)"""


def _committed(spark: SparkSession, sf_dir: str) -> IndexStore:
    store = IndexStore(spark, shared_path(spark, "index"))
    events = catalog.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("pkg"), (F.col("user_id") % 10).cast("string").alias("version"), F.col("event_id").cast("string").alias("unit_id"), "event_id", F.unix_timestamp("ts").alias("indexed_at"), F.col("props").alias("name")
    )
    again = events.where("event_id % 30 = 0").withColumns({"indexed_at": F.col("indexed_at") + 86400, "name": F.lit("again")})
    for part in [*(events.where(F.col("event_id") % 3 == k) for k in range(3)), again]:
        store.replace(part.where("event_id % 4 > 0").select(*ENTRY, "name"), part.select(*ENTRY, "indexed_at"))
    return store


@query("index_versions", f"{_COMMITS.format(last=4)} SELECT pkg, version, unit_id, indexed_at, CAST(event_id % 4 > 0 AS BIGINT) AS n FROM live")
def index_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _committed(spark, sf_dir).entries()


@query("index_rows_of_a_version", f"{_COMMITS.format(last=2)} SELECT pkg, version, unit_id, name FROM live WHERE event_id % 4 > 0")
def index_rows_of_a_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of the second version still sees after the fourth."""
    return _committed(spark, sf_dir).rows(2)


_VIEW = "SELECT '{when}' AS shown, pkg, version, unit_id, upper(name) AS shouted FROM ({sql} SELECT * FROM live WHERE event_id % 4 > 0)"


@query("live_view", " UNION ALL ".join(_VIEW.format(when=when, sql=_COMMITS.format(last=last)) for when, last in (("before", 2), ("after", 4))))
def live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader from before the swap, and the view after it."""
    store = _committed(spark, sf_dir)
    view = LiveView(store, "symbolarium_live", lambda rows: rows.select(*ENTRY, F.upper("name").alias("shouted")))
    view.publish(2)
    before = spark.table("symbolarium_live").withColumn("shown", F.lit("before"))
    view.publish()
    return before.unionByName(spark.table("symbolarium_live").withColumn("shown", F.lit("after")))


# -- cached answers -------------------------------------------------------------------------

_GOOD = '[{"item":"x"}]'
_RESPONSES = f"""WITH log AS (SELECT 'k' || user_id AS key, user_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'insert' WHEN 'view' THEN 'insert' WHEN 'error' THEN 'drop' ELSE 'touch' END AS op,
  'e' || event_id AS etag, CASE WHEN event_id % 7 = 0 THEN 'oops' ELSE '{_GOOD}' END AS body, CASE WHEN user_id % 5 = 0 THEN 'immutable' ELSE 'mutable' END AS kind, event_id * 10 AS stored_at FROM events WHERE event_id % 5 <> user_id % 5 OR event_type <> 'error'),
i AS (SELECT key, max(seq) AS seq, arg_max(etag, seq) AS etag, arg_max(body, seq) AS body, arg_max(kind, seq) AS kind, arg_max(stored_at, seq) AS stored_at FROM log WHERE op = 'insert' GROUP BY key),
t AS (SELECT key, max(seq) AS seq, arg_max(stored_at, seq) AS stored_at FROM log WHERE op = 'touch' GROUP BY key), d AS (SELECT key, max(seq) AS seq FROM log WHERE op = 'drop' GROUP BY key),
held AS (SELECT i.key, i.etag, i.body, i.kind, 900 AS ttl, CASE WHEN t.seq > i.seq THEN t.stored_at ELSE i.stored_at END AS stored_at, greatest(i.seq, t.seq) AS seq
  FROM i LEFT JOIN t USING (key) LEFT JOIN d USING (key) WHERE d.seq IS NULL OR d.seq < i.seq),
asks AS (SELECT DISTINCT 'k' || user_id AS key, user_id AS k FROM events UNION SELECT 'k' || c_custkey || 'x', c_custkey FROM customer),
seen AS (SELECT a.key, k, h.body, h.seq, h.body = '{_GOOD}' AS good FROM asks a LEFT JOIN held h USING (key)),
online AS (SELECT key, CASE WHEN good THEN body WHEN k % 3 = 0 THEN '{_GOOD}' END AS body, CASE WHEN good THEN 'cache' WHEN k % 3 = 0 THEN 'network' END AS resolved_from,
  CASE WHEN good OR k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'CORRUPTION' WHEN k % 6 = 2 THEN 'RATE_LIMITED' ELSE 'NETWORK_ERROR' END AS error, seq FROM seen)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog.table(spark, sf_dir, "events").where("event_id % 5 <> user_id % 5 OR event_type <> 'error'")
    op = F.when(F.col("event_type").isin("purchase", "view"), "insert").when(F.col("event_type") == "error", "drop").otherwise("touch")
    return e.select(
        F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("etag"),
        F.when(F.col("event_id") % 7 == 0, "oops").otherwise(_GOOD).alias("body"), F.when(F.col("user_id") % 5 == 0, "immutable").otherwise("mutable").alias("kind"), F.lit(900).cast("long").alias("ttl"), (F.col("event_id") * 10).alias("stored_at"),
    )


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys of all users and of customers that no answer was ever kept for; a third of the answers
    from the network is good, a third cannot be read, of the rest half is an error and half lost."""
    users = catalog.table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("key"), F.col("user_id").alias("k"))
    others = catalog.table(spark, sf_dir, "customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string"), F.lit("x")).alias("key"), F.col("c_custkey").alias("k"))
    asks = users.unionByName(others).distinct()
    body = F.when(F.col("k") % 3 == 0, _GOOD).when(F.col("k") % 3 == 1, "[")
    network = asks.where("k % 6 <> 5").select("key", F.lit("new").alias("etag"), body.alias("body"), F.when(F.col("k") % 6 == 2, "RATE_LIMITED").alias("error"))
    return asks, network


@query("response_cache_state", f"{_RESPONSES} SELECT key, etag, body, kind, CAST(ttl AS BIGINT) AS ttl, stored_at, seq FROM held")
def response_cache_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.cache_state(responses.compacted(_log(spark, sf_dir)))


@query("response_cache_answers", f"{_RESPONSES} SELECT 'online' AS mode, key, body, resolved_from, error FROM online UNION ALL SELECT 'offline', key, CASE WHEN good THEN body END, CASE WHEN good THEN 'cache' END, CASE WHEN good THEN NULL WHEN seq IS NOT NULL THEN 'CORRUPTION' ELSE 'OFFLINE' END FROM seen")
def response_cache_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, (asks, network) = _log(spark, sf_dir), _asked(spark, sf_dir)
    online, _ = responses.remote_answers(asks, log, network, 0)
    offline, _ = responses.remote_answers(asks, log, network, 0, offline=True)
    return online.withColumn("mode", F.lit("online")).unionByName(offline.withColumn("mode", F.lit("offline")))


@query("response_cache_healed", f"""{_RESPONSES}, added AS (SELECT key, body, coalesce(seq, 0) + 1 AS seq FROM online WHERE resolved_from = 'network')
SELECT coalesce(a.key, h.key) AS key, coalesce(a.body, h.body) AS body, CASE WHEN a.key IS NULL THEN h.etag ELSE 'new' END AS etag, CASE WHEN a.key IS NULL THEN h.stored_at ELSE 77 END AS stored_at
FROM held h FULL JOIN added a USING (key) WHERE a.key IS NOT NULL OR h.body <> 'oops'""")
def response_cache_healed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after all were asked online and what still cannot be read was dropped."""
    log, (asks, network) = _log(spark, sf_dir), _asked(spark, sf_dir)
    _, added = responses.remote_answers(asks, log, network, 77)
    log = log.unionByName(added.select(log.columns))
    log = log.unionByName(responses.dropped_corrupt(log).select(log.columns))
    return responses.cache_state(log).select("key", "body", "etag", "stored_at")


@query("response_cache_revalidated", f"""{_RESPONSES}, late AS (SELECT max(event_id) * 10 AS now FROM events), old AS (SELECT h.*, CAST(substr(key, 2) AS BIGINT) AS k FROM held h, late WHERE kind = 'mutable' AND stored_at + 900 <= now)
SELECT h.key, CASE WHEN o.k % 3 = 1 THEN 'fresh' ELSE h.body END AS body, CASE WHEN o.k % 3 = 1 THEN 'new' ELSE h.etag END AS etag, CASE WHEN o.k % 3 < 2 THEN now ELSE h.stored_at END AS stored_at FROM held h CROSS JOIN late LEFT JOIN old o USING (key)""")
def response_cache_revalidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the keys is still valid, a third has a new answer, the rest cannot be reached."""
    log, (asks, _) = _log(spark, sf_dir), _asked(spark, sf_dir)
    now = (catalog.table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0) * 10
    k = F.col("k") % 3
    replies = asks.select("key", F.when(k == 0, 304).when(k == 1, 200).otherwise(503).alias("status"), F.lit("new").alias("etag"), F.lit("fresh").alias("body"))
    added = responses.revalidated(asks, log, replies, now)
    return responses.cache_state(log.unionByName(added.select(log.columns))).select("key", "body", "etag", "stored_at")
