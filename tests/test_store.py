"""Versions of the index, its live view and the log of cached answers: failures, races, edges."""

import threading

import pytest
from pyspark.sql import functions as F

from symbolarium.operators import responses
from symbolarium.operators.index_store import IndexStore, LiveView

ROW = "name string, pkg string, version string, unit_id string"
META = "pkg string, version string, unit_id string, indexed_at long"


def write(store, t, *rows, empty=()):
    """Index entries (pkg, version, unit) at time ``t``; rows are (name, pkg, version, unit)."""
    spark = store.spark
    entries = {r[1:] for r in rows} | set(empty)
    return store.replace(spark.createDataFrame(list(rows), ROW), spark.createDataFrame([(*e, t) for e in entries], META))


def names(store, at=None):
    return sorted(r["name"] for r in store.rows(at).select("name").collect()) if store.manifest(at).where("n > 0").count() else []


@pytest.fixture
def at(spark, tmp_path):
    return IndexStore(spark, f"file://{tmp_path}/index")


def test_a_write_replaces_and_prunes_in_one_version(at):
    assert at.latest() == 0 and at.entries().collect() == []
    for k in range(5):
        assert write(at, 10, (f"n{k}", "p", "1.10", f"u{k}"), ("o", "q", "1", "v")) == k + 1
    assert names(at) == ["n2", "n3", "n4", "o"]  # equal times: the last written stay
    assert {r["version"] for r in at.entries().where("pkg = 'p'").collect()} == {"1.10"}
    write(at, 99, ("again", "p", "1.10", "u2"))
    write(at, 5, ("old", "p", "1.10", "late"))
    assert names(at) == ["again", "n3", "n4", "o"] and names(at, 1) == ["n0", "o"]
    write(at, 100, empty=[("p", "1.10", "u2")])
    assert names(at) == ["n3", "n4", "o"] and at.entries().where("n = 0").count() == 1
    write(at, 1, ("stray", "x", "1", "u"))
    at.replace(at.spark.createDataFrame([("unasked", "y", "1", "u")], ROW), at.spark.createDataFrame([], META))
    assert "unasked" not in names(at)


def test_columns_may_come_later(at):
    write(at, 1, ("a", "p", "1", "u"))
    spark = at.spark
    at.replace(spark.createDataFrame([("b", "p", "2", "u", 7)], f"{ROW}, extra long"), spark.createDataFrame([("p", "2", "u", 2)], META))
    assert sorted((r["name"], r["extra"]) for r in at.rows().collect()) == [("a", None), ("b", 7)]


@pytest.mark.parametrize("step", ["rows", "manifest", "rename"])
def test_a_failed_write_leaves_the_old_version(at, monkeypatch, step):
    write(at, 1, ("a", "p", "1", "u"))
    spark = at.spark
    bad = spark.createDataFrame([("b", "p", "1", "u")], ROW).withColumn("name", F.raise_error(F.lit("lost")))
    with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
        if step != "rows":
            def fail(manifest, version):
                if step == "rename":
                    manifest.write.parquet(f"{at.path}/pending/half")
                raise RuntimeError("lost")

            m.setattr(at, "_publish", fail)
        at.replace(bad if step == "rows" else spark.createDataFrame([("b", "p", "1", "u")], ROW), spark.createDataFrame([("p", "1", "u", 2)], META))
    assert at.latest() == 1 and names(at) == ["a"]
    assert write(at, 3, ("c", "p", "1", "u")) == 2 and names(at) == ["c"]
    at.vacuum()
    assert names(at) == ["c"] and not at._fs.exists(at._hadoop.Path(f"{at.path}/pending/half"))


def test_writers_that_meet_keep_both(spark, at):
    write(at, 1, ("a", "p", "1", "u"))
    second, plain = IndexStore(spark, at.path), at._publish

    def late(manifest, version):  # another writer is faster, once
        at._publish = plain
        write(second, 2, ("b", "q", "1", "u"), ("b2", "p", "1", "w"))
        return plain(manifest, version)

    at._publish = late
    assert write(at, 3, ("c", "p", "1", "u")) == 3 and names(at) == ["b", "b2", "c"]
    failed = []

    def run(k):
        try:
            write(IndexStore(spark, at.path), 10 + k, (f"t{k}", f"r{k}", "1", "u"))
        except Exception as e:  # a thread's failure is the test's
            failed.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and at.latest() == 7 and names(at) == ["b", "b2", "c", "t0", "t1", "t2", "t3"]


def test_readers_keep_their_version(spark, at):
    write(at, 1, ("a", "p", "1", "u"))
    held, built = at.rows(), []

    def build(rows):
        built.append(1)
        return rows.withColumn("name_l", F.upper("name"))

    view = LiveView(at, "live_test", build)
    view.publish()
    reader = spark.table("live_test")
    write(at, 2, ("b", "p", "1", "u"), ("c", "q", "1", "u"))
    assert [r["name"] for r in spark.table("live_test").collect()] == ["a"]  # until it is published
    view.publish()
    assert sorted(r["name_l"] for r in spark.table("live_test").collect()) == ["B", "C"] and view.version == 2
    assert [r["name_l"] for r in reader.collect()] == ["A"] and [r["name"] for r in held.collect()] == ["a"]
    write(at, 3, ("d", "z", "1", "u"))
    view.publish()
    assert len(built) == 3  # each commit once
    assert at.vacuum(1) > 0 and sorted(r["name"] for r in view.publish().collect()) == ["b", "c", "d"]


# -- cached answers --------------------------------------------------------------------------


def log(spark, *rows):
    """Rows (key, seq, op, body, stored_at, kind)."""
    return spark.createDataFrame([(k, s, op, f"e{s}", body, (kind or ["mutable"])[0], 900, t) for k, s, op, body, t, *kind in rows], responses.LOG)


def state(rows):
    return {r["key"]: (r["body"], r["stored_at"]) for r in responses.cache_state(rows).collect()}


def test_the_log_folds_to_its_last_state(spark):
    rows = log(
        spark, ("a", 1, "insert", "[]", 10), ("a", 2, "touch", None, 20), ("b", 1, "insert", "[]", 10), ("b", 2, "drop", None, 0), ("b", 3, "touch", None, 30), ("c", 1, "drop", None, 0), ("c", 2, "insert", "[1]", 5), ("d", 1, "touch", None, 9),
        ("e", 1, "insert", "[1]", 1), ("e", 2, "touch", None, 50), ("e", 3, "insert", "[2]", 40), ("f", 5, "insert", "[5]", 5), ("f", 5, "touch", None, 6), ("f", 5, "drop", None, 0), (None, 1, "insert", "[]", 1),
    )
    want = {"a": ("[]", 20), "c": ("[1]", 5), "e": ("[2]", 40), "f": ("[5]", 6), None: ("[]", 1)}
    assert state(rows) == want and state(responses.compacted(rows)) == want and responses.compacted(rows).count() == 5
    assert state(log(spark)) == {}


def test_corrupt_bodies_are_misses_and_heal(spark):
    rows = log(spark, ("bad", 4, "insert", "oops", 1), ("ok", 1, "insert", '[{"item":"x"}]', 1), ("gone", 9, "drop", None, 1))
    asks = spark.createDataFrame([("bad",), ("ok",), ("gone",), ("gone",), ("none",), ("lost",), ("err",)], "key string")
    network = spark.createDataFrame([("bad", "n", "[]", None), ("ok", "n", "[]", None), ("gone", "n", "[]", None), ("none", "n", "<html>", None), ("err", None, None, "TIMEOUT")], "key string, etag string, body string, error string")
    answers, added = responses.remote_answers(asks, rows, network, 50)
    assert {r["key"]: (r["body"], r["resolved_from"], r["error"]) for r in answers.collect()} == {
        "bad": ("[]", "network", None), "ok": ('[{"item":"x"}]', "cache", None), "gone": ("[]", "network", None), "none": (None, None, "CORRUPTION"), "lost": (None, None, "NETWORK_ERROR"), "err": (None, None, "TIMEOUT"),
    }
    healed = rows.unionByName(added.select(rows.columns))
    assert state(healed) == {"bad": ("[]", 50), "ok": ('[{"item":"x"}]', 1), "gone": ("[]", 50)}
    offline, nothing = responses.remote_answers(asks, rows, network, 50, offline=True)
    assert nothing.collect() == [] and {r["key"]: r["error"] for r in offline.collect()} == {"bad": "CORRUPTION", "ok": None, "gone": "OFFLINE", "none": "OFFLINE", "lost": "OFFLINE", "err": "OFFLINE"}
    dropped = rows.unionByName(responses.dropped_corrupt(rows).select(rows.columns))
    assert set(state(dropped)) == {"ok"}


def test_only_stale_entries_are_asked_again(spark):
    rows = log(spark, ("new", 1, "insert", "[]", 900), ("old", 1, "insert", "[]", 0), ("same", 1, "insert", "[]", 0), ("fixed", 1, "insert", "[]", 0, "immutable"), ("down", 1, "insert", "[]", 0))
    replies = spark.createDataFrame([("new", 200), ("old", 200), ("same", 304), ("fixed", 200), ("down", 503), ("unknown", 200)], "key string, status int").select("key", "status", F.lit("n").alias("etag"), F.lit("[9]").alias("body"))
    added = responses.revalidated(replies.select("key"), rows, replies, 1000)
    assert state(rows.unionByName(added.select(rows.columns))) == {"new": ("[]", 900), "old": ("[9]", 1000), "same": ("[]", 1000), "fixed": ("[]", 0), "down": ("[]", 0)}
