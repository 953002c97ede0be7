"""Each operator against brute force, an exact round trip, SQL or held-out accuracy, and
on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from symbolarium.llm import bpe, kneser_ney, language_id, lz_fingerprint, ngram_join, packing, quality, queries, sharding, toxicity, url_cascade, workspace
from symbolarium.llm.components import components
from symbolarium.llm.samples import sampled
from symbolarium.llm.pieces import PieceCache, cut
from symbolarium.llm.textarrays import chunks, shingle_sets, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, rep string, score double, _mark string, _lang_pred string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, columns with clashing names."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "Delta,", "é"]) + str(rng.randrange(50)) for _ in range(40_000))
    same = " ".join(f"w{k}" for k in range(80))
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, same), (6, same), (7, same + " end"), (8, same.upper()), (None, same), (9, "x" * 5000), (10, "123 456"), (11, "ÀÉ ñ\u3000ß 日本"), (12, "one")]
    rows = [(i, t, None if i == 4 else "en", None if i in (5, 7) else "s", None, 3, "r", 0.5, "m", "z") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_words_and_shingles_follow_the_definition():
    texts = ["A b\tC  d\x0be", None, "", "x", "a b c d", "a b c d e f", "\xa0 é\u3000f g"]
    w = words(pa.array(texts), lower=True)
    assert np.diff(w.first).tolist() == [len(split(t)) for t in texts]
    assert [len(s) for s in shingle_sets(w)] == [1, 0, 0, 1, 1, 2, 1]
    again = words(pa.array(["q " + t if t else t for t in texts]), lower=True)
    assert w.hashes[0] == again.hashes[1]  # position does not matter


# -- 1: language ID ------------------------------------------------------------------------


def test_language_id_learns_and_rejects(spark, docs):
    got = {r["doc_id"]: r for r in language_id.language_id(docs).collect()}
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in langs)
    assert np.mean([got[i]["lang_pred"] == langs[i] for i in held]) > 0.9
    assert np.mean([r["rejected"] for r in got.values()]) < 0.05


def test_language_id_odd_rows(odd, none):
    rows = language_id.language_id(odd).collect()
    assert len(rows) == odd.count()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, 10} and all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.language_id(none).count() == 0
    model = language_id.train_language_model(none)
    assert language_id.identify(odd, model).where("NOT __lang_pred = 'und'").count() == 0  # docs has _lang_pred


def subwords_by_loop(text):
    out, kept = [], []
    for b in text.encode():
        c = b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32
        if not (c == 32 and kept and kept[-1] == 32):
            kept.append(c)
    for at in range(len(kept)):
        for order in language_id.ORDERS:
            h = order * 0x9E3779B1 % (1 << 32)
            for c in kept[at : at + order]:
                h = (h ^ c) * 0x01000193 % (1 << 32)
            h = (h ^ h >> 15) * 0x85EBCA77 % (1 << 32)
            out.append((h ^ h >> 13) % language_id.BUCKETS if at + order <= len(kept) else 0)
    return out


def test_language_model_by_plain_loops():
    rng = random.Random(8)
    words = {"a": ["tion", "the", "and", "Hé"], "b": ["ung", "der", "ß", "einen"], "c": ["os", "que", "el", "ñ"]}
    langs = [rng.choice("abc") for _ in range(40)]
    texts = [" ".join(rng.choice(words[x]) for _ in range(rng.randrange(3, 9))) + "!  x" for x in langs]
    ids, bounds = language_id.subwords(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [subwords_by_loop(t) for t in texts]
    model = language_id.fit_language_model(pa.array(texts), langs, epochs=2)

    labels = sorted(set(langs))
    draw = np.random.default_rng(3)
    train = draw.permutation(40)
    start = draw.standard_normal((language_id.BUCKETS, language_id.DIM)) / language_id.DIM
    emb = collections.defaultdict(list)
    out, bias, step = [[0.0] * len(labels) for _ in range(language_id.DIM)], [0.0] * len(labels), 0
    for _ in range(2):
        for k in draw.permutation(train):
            grams = collections.Counter(subwords_by_loop(texts[k]))
            share = {g: n / sum(grams.values()) for g, n in grams.items()}
            lr = 1.5 * (1 - step / 80)
            step += 1
            for g in share:
                if g not in emb:
                    emb[g] = start[g].tolist()
            mean = [sum(share[g] * emb[g][d] for g in share) for d in range(language_id.DIM)]
            p = [math.exp(bias[c] + sum(mean[d] * out[d][c] for d in range(language_id.DIM))) for c in range(len(labels))]
            p = [x / sum(p) - (labels[c] == langs[k]) for c, x in enumerate(p)]
            back = [sum(out[d][c] * p[c] for c in range(len(labels))) for d in range(language_id.DIM)]
            for c in range(len(labels)):
                bias[c] -= 0.1 * lr * p[c]
                for d in range(language_id.DIM):
                    out[d][c] -= lr * mean[d] * p[c]
            for g in share:
                emb[g] = [emb[g][d] - lr * math.sqrt(share[g]) * back[d] for d in range(language_id.DIM)]
    for g in emb:
        want = [sum(emb[g][d] * out[d][c] for d in range(language_id.DIM)) for c in range(len(labels))]
        assert np.allclose(model.logits[g], want, atol=2e-4)
    assert np.allclose(model.bias, bias, atol=2e-4)


def test_samples_are_bounded_and_repeatable(spark):
    rows = [(k % 50, f"t{k % 100}", "x") for k in range(400)] + [(None, "n", "y"), (7, "t7", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    all_rows = sampled(docs, 1000).collect()
    assert len(all_rows) == len(set(all_rows)) == 102
    few = [sorted(map(tuple, sampled(docs.repartition(n), 30).collect()), key=str) for n in (1, 7)]
    assert few[0] == few[1] and 0 < len(few[0]) <= 30


# -- 2: packing ----------------------------------------------------------------------------


def check_packing(rows, ids_of, capacity=1024):
    by_doc = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    return sequences


def test_packing_keeps_every_id_once(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    ids = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = packing.pack(docs, path).collect()
    sequences = check_packing(rows, ids)
    assert sum(map(len, ids.values())) / (1024 * len(sequences)) > 0.95


def test_packing_encoder_gives_the_ids_of_the_tokenizer(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["\n".join(f"a{c}a 1{c}1 .{c}. {c}{c} {c}" for c in characters[k : k + 100]) for k in range(0, len(characters), 100)]
    texts += ["", "<|endoftext|>", "a <|endoftext|> x", "x<|endoftext|><|endoftext|>\n<|endoftext|", "a" * 20_000, " " * 20_000 + "b", "\n \t" * 5_000, "it's  we'LL\u00a0x"]
    texts += [r.text or "" for r in docs.collect()]
    encode = packing._encoder(path)
    assert 50256 in encode("a <|endoftext|>").tolist()
    for text, own in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == own.ids, text[:50]


def test_packing_leaves_other_vocabularies_to_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    text = "Word ends, lower case."
    assert packing._encoder(path)(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_odd_rows(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(odd, path, keep_ids=True).collect()
    check_packing(rows, {1: [0], 2: [0]})
    assert sum(r["length"] == r["doc_tokens"] and r["doc_id"] == 6 for r in rows) == 2
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    assert packing.pack(none, path).count() == 0


def test_patterns_use_the_histogram_up():
    rng = random.Random(2)
    histogram = {n: rng.randrange(1, 900) for n in rng.sample(range(1, 65), 40)}
    used = collections.Counter()
    for count, lengths in packing.packing_patterns(histogram, 64):
        assert sum(lengths) <= 64 and count > 0
        for n in lengths:
            used[n] += count
    assert used == histogram


# -- 3: quality rules -----------------------------------------------------------------------


def test_line_frequency_by_sql(spark, docs):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = duck.execute(queries.ORACLE_SQL["op3_line_frequency"])
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    got = queries.op3_line_frequency(spark, SF).select(*names).collect()
    assert sorted(tuple(r) for r in got) == want


def test_boilerplate_goes_and_copies_stay(spark):
    footer = "All rights reserved by the house of words"
    body = [(k, f"opening words of number {k} " + " ".join(f"a{k}b{j}" for j in range(60)) + f"\n{footer}\nclosing {k}", "h") for k in range(40)]
    copies = [(100 + k, "\n".join(" ".join(f"c{j}d{i}" for i in range(12)) for j in range(8)), "h") for k in range(40)]
    mostly = [(200 + k, "\n".join([footer] * 9 + [f"short tail {k}"]), "h") for k in range(3)]
    docs = spark.createDataFrame(body + copies + mostly, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    limits = quality.LineLimits(least=10)
    out = {r["doc_id"]: r for r in quality.without_boilerplate(docs, limits=limits).collect()}
    assert set(out) == {*range(40), *range(100, 140)}
    assert out[3]["text"] == "\n".join(x for x in body[3][1].split("\n") if x != footer) and out[3]["n_chars"] == len(out[3]["text"])
    assert out[101]["text"] == copies[1][1]


def test_shared_longest_lines_count_every_document(spark):
    rng = random.Random(7)
    passage, footer = " ".join(f"p{k}" for k in range(60)), "kept by the house of shared words"
    own = [(k, "\n".join([" ".join(f"a{k}b{j}" for j in range(40)), passage, footer, " ".join(f"c{k}d{j}" for j in range(45))]), "h") for k in range(100)]
    base = [f"v{j}" for j in range(240)]
    copies = []
    for k in range(100, 200):
        w = list(base)
        w[rng.randrange(240)] = f"e{k}"
        copies.append((k, "\n".join(" ".join(w[j : j + 30]) for j in range(0, 240, 30)), "h"))
    docs = spark.createDataFrame(own + copies, "doc_id long, text string, host string")
    out = {r["doc_id"]: r for r in quality.quality_verdicts(docs).collect()}
    assert all(out[k]["n_removed_words"] == 67 and out[k]["kept"] for k in range(100))
    assert all(out[k]["n_removed_words"] == 0 and out[k]["kept"] for k in range(100, 200))


def line_corpus():
    """Hosts of texts that share a passage beside words of their own, at several shares; light copies,
    copies of many texts with a footer, exact copies, passages alone."""
    rng = random.Random(9)
    passage = [" ".join(f"p{j}q{i}" for i in range(40)) for j in range(5)]
    own = lambda k, n: " ".join(f"o{k}w{j}" for j in range(n))
    rows = []
    for host, (number, words_) in enumerate([(100, 60), (500, 60), (200, 25), (200, 15), (1000, 15), (60, 200), (60, 50), (60, 22), (60, 11)]):
        rows += [(f"share{host}", "\n".join([*passage, own(f"{host}x{k}", words_)]) if k % 2 else "\n".join([own(f"{host}x{k}", words_), " ".join(passage)])) for k in range(2 * number)]
    base = [f"v{j}" for j in range(240)]
    for k in range(100):
        w = list(base)
        w[rng.randrange(240)] = f"e{k}"
        rows.append(("light", "\n".join(" ".join(w[j : j + 30]) for j in range(0, 240, 30))))
    rows += [("light", own(f"l{k}", 60)) for k in range(40)]
    for a in range(30):
        article = [" ".join(f"a{a}l{i}w{j}" for j in range(12)) for i in range(6)]
        for k in range(25):
            lines = list(article)
            if k % 5 == 0:
                lines[k // 5] = lines[k // 5].replace("w3", f"edit{k}")
            rows.append(("articles", "\n".join([*lines, "kept by the house of shared words"])))
    rows += [("exact", "\n".join(passage[:2] + ["the end of it"]))] * 80 + [("alone", " ".join(passage[0].split()[: 20 + k // 30])) for k in range(60)]
    return rows + [(None, None), (None, ""), (None, "\n \n")] + [(None, passage[1] + "\n" + own(f"n{k}", 3) + f"\nword{k}") for k in range(30)]


def test_line_frequency_counts_what_documents_have_of_their_own(spark, tmp_path):
    rows = line_corpus()
    docs = spark.createDataFrame([(k, t, h) for k, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = duck.execute(queries.ORACLE_SQL["op3_line_frequency"])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    got = queries.op3_line_frequency(spark, str(tmp_path)).select(*names).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    kept, removed = collections.defaultdict(set), collections.defaultdict(set)
    for r in got:
        kept[rows[r["doc_id"]][0]].add(r["kept"])
        removed[rows[r["doc_id"]][0]].add(r["n_removed_words"])
    # The shared passage goes from all, whatever little else there is; with half of the words or more left, a text stays.
    assert {h: kept[h] for h in kept if h and h.startswith("share")} == {f"share{k}": {k in (5,)} for k in range(9)}
    assert all(removed[f"share{k}"] == {200} for k in range(9))
    assert kept["light"] == {True} and removed["light"] == {0}
    assert kept["articles"] == {True} and removed["articles"] == {7}  # the footer of thirty texts, and none of their lines
    assert removed["exact"] == {0} and removed["alone"] == {0} and removed[None] == {0, 40}


def test_widely_repeated_lines_go_from_a_large_host(spark):
    words = F.concat_ws(" ", *(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"w{j}"))) for j in range(4)))
    line = F.when(F.col("id") < 1001, "a passage in few of many").when(F.col("id") < 2001, "a passage in fewer of many")
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", words, line).alias("text"), F.lit("h").alias("host"))
    out = quality.quality_verdicts(docs).where("n_removed_words > 0").agg(F.count("*"), F.max("doc_id"), F.max("n_removed_words")).first()
    assert tuple(out) == (1001, 1000, 6)


def test_quality_odd_rows(odd, none):
    rows = quality.quality_verdicts(odd.withColumn("host", F.col("source"))).collect()
    assert len(rows) == odd.count()
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert quality.without_boilerplate(odd).columns == odd.columns
    assert {r["doc_id"] for r in quality.without_boilerplate(odd).collect()} == {None, 5, 6, 7, 8}
    assert quality.quality_verdicts(none.withColumn("host", F.col("source"))).count() == 0


# -- 4: byte-level BPE ----------------------------------------------------------------------

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_piece_caches_are_bounded_by_size(spark):
    """Long pieces are encoded and not kept, and one text of very many pieces keeps no more either."""
    encoded = []
    pieces_of = PieceCache(lambda p: (encoded.append(len(p)), p)[1], lambda a, b: a + b, limit=1000)
    for k in range(300):
        assert "".join(pieces_of(f"{k:0100000d} {'z' * 100_000} end{k}!")) == f"{k:0100000d} {'z' * 100_000} end{k}!"
    assert sum(len(p) for d in (pieces_of.plain, pieces_of.spaced) for p in d) < 40_000 and len(encoded) > 600
    many = " ".join(f"w{k}" for k in range(50_000))
    assert "".join(pieces_of(many)) == many and len(pieces_of.spaced) <= 1000
    wide = " ".join(f"{k:0150d}" for k in range(5_000))
    assert "".join(pieces_of(wide)) == wide and sum(map(len, pieces_of.spaced)) <= 16_150


def test_bpe_matches_merges_and_round_trips():
    codec = bpe.codec(PATH, PATTERN)
    exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(3)
    pieces_of = PieceCache(codec.encode, lambda a, b: a + b, limit=500)
    alphabets = ["ab", "aA \n", " \t\n.", "abcdefgh ", "éèßü日本語 ", "0123456789,.", "\x1c\x85\u3000 a", "😀👍🏽\u200d"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(60)))
        ids = [i for piece in pieces_of(text) for i in piece]
        assert " ".join(cut(text)) == text and ids == exact.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_on_tables(odd, none):
    exact = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in odd.collect())
    want = [(i, len(ids := exact.encode_ordinary(t)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts]
    got = [(r[0] or 0, *r[1:]) for r in bpe.bpe_digests(odd, PATH, PATTERN).collect()]
    assert sorted(got) == sorted(want)
    back = bpe.decode_ids(bpe.encode_texts(odd, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["data"]).decode()) for r in back) == texts
    assert bpe.bpe_digests(none, PATH, PATTERN).count() == 0


# -- 5: sharding ----------------------------------------------------------------------------


def test_shards_merge_and_versions_stay(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=400_000, least_bytes=1000, min_run=4)
    rows = spark.range(9000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
    for k in range(6):
        store.append(rows.where(f"id % 6 = {k}").coalesce(1))
    before = store.manifest().count()
    assert store.version() == 6 and before == 6
    assert store.compact() == 7 and 0 < store.manifest().count()
    assert store.read(rows.schema).select("id", "x").exceptAll(rows).count() == 0 and store.read(rows.schema).count() == 9000
    assert store.read(rows.schema, 3).count() == 4500  # an older version still reads
    with pytest.raises(Exception):
        store._commit(store.manifest(), 7)  # a version is published once
    assert store.expire() == 6 and store.read(rows.schema).count() == 9000


def test_tiers_settle_over_arrivals(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/tiers", target_bytes=60_000, least_bytes=2_500, min_run=4)
    rows = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
    highest = 0
    for k in range(40):
        store.append(rows.where(f"id % 40 = {k}").coalesce(1))
        store.settle()
        shards = store.manifest().collect()
        small = collections.Counter(r["tier"] for r in shards if r["bytes"] * 2 < store.target)
        assert all(n < store.min_run for n in small.values())
        highest = max(highest, *(r["tier"] for r in shards))
        assert sum(r["rows"] for r in shards) == 100 * (k + 1)
    shards = store.manifest().collect()
    assert highest >= 2 and len(shards) < 12 and max(r["bytes"] for r in shards) < 2 * store.target
    assert len({r["added"] for r in shards}) > 1 and store.version() > 50
    assert store.read(rows.schema, 5).count() in (300, 400, 500)
    (tmp_path / "tiers" / "shards" / "lost").mkdir()
    rows.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/tiers/shards/lost")
    assert store.vacuum(3600) == 0 and store.vacuum(0) == 1
    assert store.read(rows.schema).select("id", "x").exceptAll(rows).count() == 0 and store.read(rows.schema).count() == 4000


def test_arrivals_leave_their_versions(docs):
    rows = sharding.compacted_documents(docs, target_bytes=100_000).collect()
    assert len(rows) == docs.count() and {r["version"] for r in rows} == {max(r["version"] for r in rows)}
    assert rows[0]["version"] > 8 and len({r["added"] for r in rows}) > 1 and {r["arrival"] for r in rows} >= set(range(6))
    size = collections.Counter(r["shard"] for r in rows)
    assert all(r["shard_rows"] == size[r["shard"]] for r in rows)


def test_sharding_odd_rows(odd, none):
    rows = sharding.compacted_documents(odd).collect()
    want = sorted((r["doc_id"] or 0, hashlib.sha256((r["text"] or "").encode()).hexdigest(), None if r["text"] is None else len(r["text"])) for r in odd.collect())
    assert sorted((r["doc_id"] or 0, r["text_sha256"], r["n_chars"]) for r in rows) == want
    assert sharding.compacted_documents(none).count() == 0


# -- 6: language model ----------------------------------------------------------------------


def kneser_ney_by_dicts(train, order):
    counts = [collections.Counter() for _ in range(order + 1)]  # of n-grams, by length
    for t in train:
        line = ["<s>", *split(t.translate(LOWER)), None]
        for end in range(1, len(line)):
            gram = tuple(line[max(0, end - order + 1) : end + 1])
            counts[len(gram)][gram] += 1  # whole ones, and those cut short by the start
    for n in range(order - 1, 0, -1):
        for gram in counts[n + 1]:
            counts[n][gram[1:]] += 1
    spectrum = lambda xs: [sum(x == k for x in xs) for k in (1, 2, 3, 4)]
    cuts = [kneser_ney._discounts(spectrum(c.values())) for c in counts]
    total, rest = collections.Counter(), collections.Counter()  # of contexts, of any length
    for n in range(1, order + 1):
        for gram, c in counts[n].items():
            total[gram[:-1]] += c
            rest[gram[:-1]] += cuts[n][min(c, 3)]

    def p(context, w):
        n = len(context) + 1
        lower = p(context[1:], w) if n > 1 else 1 / (len(counts[1]) + 1)
        if not total[context]:
            return lower
        c = counts[n][(*context, w)]
        return (max(c - cuts[n][min(c, 3)], 0) + rest[context] * lower) / total[context]

    return p, [w for (w,) in counts[1]]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_by_brute_force(docs, order):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    p, vocabulary = kneser_ney_by_dicts([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10], order)
    seen = next(t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 and len(split(t)) > order)
    for context in [("<s>",), ("the",), tuple(split(seen.translate(LOWER))[: order - 1])]:
        assert abs(sum(p(context, w) for w in vocabulary) + p(context, "never seen") - 1) < 1e-9
    rows = {r["doc_id"]: r for r in (kneser_ney.ngram_scores(docs, order) if order != 3 else kneser_ney.ngram_scores(docs)).collect()}
    for i, t in list(texts.items())[:60]:
        line = ["<s>", *split(t.translate(LOWER)), None]
        want = sum(math.log10(p(tuple(line[max(0, k - order + 1) : k]), line[k])) for k in range(1, len(line)))
        assert math.isclose(rows[i]["score"], want, rel_tol=1e-9) and rows[i]["n_tokens"] == len(split(t)) + 1
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_kneser_ney_of_few_words(spark):
    """Empty texts and ones shorter than the order, every one met in training, score as by dicts."""
    texts = ["", "a", "a b", "a b a b a b", "b", "a", None, "A\tB c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for order in (2, 3, 5):
        p, _ = kneser_ney_by_dicts([t or "" for t in texts], order)
        got = {r["doc_id"]: r["score"] for r in kneser_ney.score_texts(rows, kneser_ney.train_ngram_model(rows, order)).collect()}
        for i, t in enumerate(texts):
            line = ["<s>", *split((t or "").translate(LOWER)), None]
            want = sum(math.log10(p(tuple(line[max(0, k - order + 1) : k]), line[k])) for k in range(1, len(line)))
            assert math.isclose(got[i], want, rel_tol=1e-9)
    with pytest.raises(ValueError):
        kneser_ney.train_ngram_model(rows, 1)


def test_kneser_ney_keeps_few_files_open(spark, docs, monkeypatch):
    """Three hundred shards and a limit of forty files: all is found, and forty are open at most."""
    monkeypatch.setattr(kneser_ney, "text_buckets", lambda texts: 300)
    monkeypatch.setattr(kneser_ney, "OPEN_FILES", 40)
    few = docs.where("doc_id < 60").select("doc_id", "text").coalesce(2)
    model = kneser_ney.train_ngram_model(few)
    texts = {r["doc_id"]: r["text"] for r in few.collect()}
    p, _ = kneser_ney_by_dicts([t for t in texts.values()], 3)
    hashes, bounds = kneser_ney._tokens(pa.record_batch([pa.array(list(texts.values()))], ["text"]))
    before = len(os.listdir("/proc/self/fd"))
    with kneser_ney._Reader.opened(model) as reader:
        _, _, own = kneser_ney._scores(model, reader, hashes, bounds)
        assert len(reader.paths) == 900 and len(reader._open) <= 40 and len(os.listdir("/proc/self/fd")) - before <= 41
    for total, t in zip(np.add.reduceat(own, bounds[:-1]), texts.values(), strict=True):
        line = ["<s>", *split((t or "").translate(LOWER)), None]
        assert math.isclose(total, sum(math.log10(p(tuple(line[max(0, k - 2) : k]), line[k])) for k in range(1, len(line))), rel_tol=1e-9)


def test_kneser_ney_looks_a_repeated_pair_up_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c " * 1000), (2, "b c d")], "doc_id long, text string")
    model = kneser_ney.train_ngram_model(docs)
    asked, places = [], kneser_ney._places
    monkeypatch.setattr(kneser_ney, "_places", lambda held, name, hashes: asked.append(len(hashes)) or places(held, name, hashes))
    hashes, bounds = kneser_ney._tokens(pa.RecordBatch.from_pydict({"text": ["a b c " * 1000]}))
    with kneser_ney._Reader.opened(model) as reader:
        counts, _, own = kneser_ney._scores(model, reader, hashes, bounds)
    assert counts[:2].tolist() == [1000, 1001] and np.isfinite(own).all()
    assert sum(asked) <= 2 * len(hashes) + 20  # three-word n-grams, among those counted once and the others


def test_sets_of_hashes_and_what_follows(monkeypatch):
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 7, 500, 40_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) << np.uint64(1)
        if n == 500:
            keys = keys >> np.uint64(50)  # all in a corner, some equal
            keys = np.unique(keys)
        held, order = kneser_ney._key_set("ones-2", keys)
        asked = np.r_[keys, keys + np.uint64(1), keys[: n // 2]]
        places = kneser_ney._places(held, "ones-2", asked)
        assert (keys[order][places[: len(keys)]] == keys).all() if len(keys) else len(places) == 0
        if n != 500:
            assert (places[len(keys) : 2 * len(keys)] == -1).all()
        follows = rng.integers(0, 3, (len(keys), 4))
        follows[:, 3] = follows[:, 0] + 5 * follows[:, 1] + 300 * follows[:, 2] + 2
        follows[::3] = (1, 0, 0, 1)
        some = rng.permutation(len(keys))[: len(keys) // 2]
        table = kneser_ney._follow_table(3, len(keys), some, follows[some])
        want = np.zeros((len(keys), 4), np.int64)
        want[some] = follows[some]
        assert (kneser_ney._follow_rows(table, 3, np.arange(len(keys))) == want).all()
        assert (kneser_ney._follow_rows(table, 3, np.full(4, -1)) == 0).all()


def test_kneser_ney_odd_rows(odd, none):
    rows = kneser_ney.ngram_scores(odd).collect()
    assert len(rows) == odd.count() and all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(math.isfinite(r["score"]) for r in rows) and kneser_ney.ngram_scores(none).count() == 0
    nothing = kneser_ney.train_ngram_model(none)
    assert {r["score"] for r in kneser_ney.score_texts(odd, nothing).where("doc_id = 1").collect()} == {0.0}


# -- 7: URL filters -------------------------------------------------------------------------


def url_by_loop(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit)[1:] if fit else (None, "allow"))


def test_urls_by_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Www.Example.COM/en/7?x", "http://com/en/", "http://a.com/en", "http://xcom/en/1", "https://example.net/de/81", "https://b.example.net/de/9#x", "x://org/es/?/en/", "http://example.org?q=/es/", "http://a.b.org/es/%20", "http://..com/en/", "http://com/en/"]
    pages = spark.createDataFrame([(k, u, "t") for k, u in enumerate(urls)], "page_id long, url string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_cascade.judge_urls(pages, queries.URL_RULES).collect()}
    assert got == {k: url_by_loop(u, queries.URL_RULES) for k, u in enumerate(urls)}
    assert url_cascade.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_rules_of_one_length_and_very_long_urls(spark):
    rules = [("allow", "a.com", "/x"), ("block", "a.com", "/x"), ("block", "b.com", "/"), ("allow", "m.b.com", ""), ("block", "long.org", "/p")]
    urls = ["http://a.com/x", "http://m.b.com/q", "http://long.org/p" + "y" * 300_000, "http://" + "s." * 400 + "long.org/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for order in (rules, rules[::-1]):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_cascade.judge_urls(pages, order).collect()}
        assert got == {0: ("a.com/x", "allow"), 1: ("m.b.com", "allow"), 2: ("long.org/p", "block"), 3: ("long.org/p", "block")}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("key % 37 = 0")
    cascade = url_cascade.build_cascade(universe, listed)
    wrong = universe.where(cascade.lists(F.col("key")) != (F.col("key") % 37 == 0))
    assert len(cascade.levels) >= 1 and wrong.count() == 0
    tight = url_cascade.Cascade([url_cascade.bloom_filter(listed, 10, 8)])  # far too small a level is full of errors
    assert universe.where(tight.lists(F.col("key")) & (F.col("key") % 37 != 0)).count() > 0


def test_levels_end_over_many_hosts(spark, monkeypatch):
    pages = spark.range(20_000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://h"), "id", F.lit(".example.com/"), F.when(F.col("id") % 3 == 0, "de").otherwise("en"), F.lit("/"), F.col("id") % 10).alias("url")
    )
    made, built = [], url_cascade.bloom_filter

    def bounded(*args):
        made.append(args)
        assert len(made) < 40, "levels let the same keys through again and again"
        return built(*args)

    monkeypatch.setattr(url_cascade, "bloom_filter", bounded)
    got = [tuple(r) for r in url_cascade.judge_urls(pages, queries.URL_RULES).collect()]
    assert len(made) > 2  # some level was wrong about a key
    assert sorted(got) == [(r["page_id"], *url_by_loop(r["url"], queries.URL_RULES)) for r in pages.orderBy("page_id").collect()]


# -- 8: toxicity ----------------------------------------------------------------------------


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(1)
    vocabulary = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(vocabulary) for _ in range(80)]
        bad = i % 6 == 0
        if bad:
            text[rng.randrange(80)] = rng.choice(["Vile,", "rotten"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in out if out[i]["held_out"]]
    assert {i for i in held} == {i for i in out if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([out[i]["predicted"] == (i % 6 == 0) for i in held]) > 0.97


def test_ftrl_by_plain_loops():
    rng = random.Random(6)
    rows = [sorted(rng.sample(range(60), rng.randrange(1, 9))) for _ in range(120)]
    labels = [float(3 in r or (5 in r and rng.random() < 0.8)) for r in rows]
    alpha, beta, l1, l2 = 0.6, 1.0, 1.0, 1.0
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    rate = sum(labels) / len(labels)
    bias, bias_n, order = math.log(rate / (1 - rate)), 1.0, np.random.default_rng(1)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(3):
        for k in order.permutation(len(rows)):
            w = {i: weight(i) for i in rows[k]}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - labels[k]
            for i in rows[k]:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= alpha / math.sqrt(bias_n) * g
    at, weights, own = toxicity.fit_ftrl([np.array(r) for r in rows], np.array(labels), epochs=3)
    want = {i: weight(i) for i in z if weight(i)}
    assert set(at.tolist()) == set(want) and 3 in want and 0 < len(want) < 60
    assert all(math.isclose(x, want[i], rel_tol=1e-9) for i, x in zip(at.tolist(), weights, strict=True)) and math.isclose(own, bias, rel_tol=1e-9)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(6, 1, 1), (6, 1, 0), (None, 0, 1), (4, 0, None), (7, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}


# -- 9: fingerprints ------------------------------------------------------------------------


def plain_phrases(text):
    known, ends, at = set(), [], 0
    for end in range(1, len(text) + 1):
        if text[at:end] not in known:
            known.add(text[at:end])
            ends.append(end)
            at = end
    return ends + [len(text)] * (at < len(text))


def check_fingerprints(rows, docs):
    hasher = lz_fingerprint._Hasher()
    sign = lambda t: hasher.signature(t, plain_phrases(t))
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    want = []
    for k, (doc_id, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        changed = lz_fingerprint.edited(text, following)
        want.append((doc_id or 0, len(text), hashlib.sha256(changed.encode()).hexdigest(), lz_fingerprint.fingerprint_text(sign(text)), lz_fingerprint.fingerprint_text(sign(changed)), lz_fingerprint.likeness(sign(text), sign(changed)), lz_fingerprint.likeness(sign(text), sign(following))))
    assert sorted((r[0] or 0, *r[1:]) for r in rows) == sorted(want)


def test_fingerprints_by_brute_force(docs):
    rows = lz_fingerprint.lz_fingerprints(docs).collect()
    check_fingerprints(rows, [(r["doc_id"], r["text"] or "") for r in docs.collect()])
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.95


def test_fingerprints_odd_rows(odd, none):
    check_fingerprints(lz_fingerprint.lz_fingerprints(odd).collect(), [(r["doc_id"], r["text"] or "") for r in odd.collect()])
    one = odd.where("doc_id = 4")
    check_fingerprints(lz_fingerprint.lz_fingerprints(one).collect(), [(4, "one")])
    assert lz_fingerprint.lz_fingerprints(none).count() == 0


# -- 10: n-gram Jaccard join ----------------------------------------------------------------


def components_by_loop(rows):
    sets = {}
    for i, t in rows:
        w = split((t or "").translate(LOWER))
        sets.setdefault(i, []).append(frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])))
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    nodes = [(i, s) for i, own in sets.items() for s in own]
    for n, (i, a) in enumerate(nodes):
        for j, b in nodes[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in nodes)


def near_copies(spark, n=70):
    rng = random.Random(4)
    base = [f"v{rng.randrange(400)}" for _ in range(150)]
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            w[rng.randrange(150)] = f"e{rng.randrange(1000)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join([f"u{i}x{k}" for k in range(rng.choice([5, 15, 40]))] + passage)) for i in range(30)]
    for i in range(40):  # alike in part: a run of a long text, each a little further on
        rows.append((3000 + i, " ".join(f"r{k}" for k in range(7 * i, 7 * i + rng.randrange(40, 60)))))
    rows += [(4000 + i, " ".join(f"s{k}" for k in range(i % 7 + 1))) for i in range(14)]
    return rows


@pytest.mark.parametrize(("block", "rounds"), [(512, 3), (7, 1), (512, 0)])
def test_components_by_brute_force(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 1000 if block > 7 else 0)
    rows = near_copies(spark)
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == components_by_loop(rows)


def test_buckets_follow_the_size_of_the_text(spark, docs, monkeypatch):
    whole = {r["doc_id"]: r["score"] for r in kneser_ney.ngram_scores(docs).collect()}
    size = sum(len((r["text"] or "").encode()) for r in docs.collect())
    monkeypatch.setattr(workspace, "BUCKET_BYTES", 20_000)
    model = kneser_ney.train_ngram_model(docs)
    assert model.shards == -(-size // 20_000) > 4
    parts = {r["doc_id"]: r["score"] for r in kneser_ney.ngram_scores(docs).collect()}
    assert parts.keys() == whole.keys() and all(math.isclose(parts[k], whole[k], rel_tol=1e-9) for k in whole)
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", 2_000)
    rows = near_copies(spark)
    got = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(tuple(r) for r in got) == components_by_loop(rows)


def test_buckets_answer_with_a_row_a_text(spark, monkeypatch):
    stored, rows_of = ngram_join.stored, {}

    def counted(df, name):
        out = stored(df, name)
        rows_of[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    rows = near_copies(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size in (96 << 20, 1_000):
        monkeypatch.setattr(ngram_join, "BUCKET_BYTES", size)
        got = ngram_join.ngram_jaccard_components(docs).collect()
        assert sorted(tuple(r) for r in got) == components_by_loop(rows)
        assert rows_of["facts"] == len(rows)


def test_join_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None]
    got = [tuple(r) for r in ngram_join.ngram_jaccard_components(odd).collect()]
    # The row without doc_id copies document 6: it links, and names no component.
    assert sorted(r for r in got if r[0] is not None) == components_by_loop(rows)
    assert [r for r in got if r[0] is None] == [(None, 76, 6)]
    assert ngram_join.ngram_jaccard_components(none).count() == 0


def test_distinct_keeps_one_row_of_each_group(spark, odd, none):
    rng = random.Random(9)
    text = {k: " ".join(f"t{k}w{j}" for j in range(60)) for k in range(6)}
    rows = [(7, text[0]), (7, text[1]), (7, text[1]), (3, text[1] + " more"), (None, text[2]), (None, text[2]), (9, text[3]), (None, text[3]), (4, None), (4, ""), (5, text[4])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "m", True) for r in rows], "doc_id long, text string, _mark string, stays boolean")
    out = ngram_join.ngram_jaccard_distinct(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == collections.Counter([(7, text[0]), (3, text[1] + " more"), (None, text[2]), (9, text[3]), (4, None), (4, ""), (5, text[4])])
    kept = collections.Counter(r["doc_id"] for r in ngram_join.ngram_jaccard_distinct(odd).collect())
    assert kept == collections.Counter([1, 2, 3, 4, 5, 6, 9, 10, 11])
    assert ngram_join.ngram_jaccard_distinct(none).count() == 0


def test_star_contraction(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 7)] + [(200 + k, 200) for k in range(30)] + [(5, 5), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys([*range(1, 41), 100], 1), **dict.fromkeys(range(200, 230), 200)}


def test_star_contraction_in_few_tasks(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(40, 39), (200, 100)], "a long, b long")
    want = {**dict.fromkeys(range(1, 41), 1), 100: 100, 200: 100}
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("stars", "")
        assert dict(tuple(r) for r in components(edges).collect()) == want
        tracker = context.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("stars") for s in tracker.getJobInfo(job).stageIds}
        tasks = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks < 64 * 12, tasks  # 419; 3,036 before rounds were written by few tasks and ended by their nodes


def test_components_take_more_edges(spark, monkeypatch):
    from symbolarium.llm import components as module

    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    seen, whole = [], module.components
    monkeypatch.setattr(module, "components", lambda edges, *rest: seen.append(sorted(tuple(r) for r in edges.where("a <> b").collect())) or whole(edges, *rest))
    groups = module.with_edges(None, table([(1, 2), (2, 3), (10, 11), (20, 21)]))
    same = module.with_edges(groups, table([(1, 3), (11, 10), (5, 5), (None, 1)]))
    more = module.with_edges(groups, table([(3, 11), (21, 0), (30, 31), (3, 1)]))
    assert sorted(tuple(r) for r in same.collect()) == [(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (20, 20), (21, 20)]
    assert sorted(tuple(r) for r in more.collect()) == [(0, 0), (1, 1), (2, 1), (3, 1), (10, 1), (11, 1), (20, 0), (21, 0), (30, 30), (31, 30)]
    assert seen[1:] == [[], [(1, 10), (20, 0), (30, 31)]]
    rng = random.Random(5)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)]
    got = module.with_edges(module.with_edges(None, table(rows[:120])), table(rows[120:]))
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in whole(table(rows)).collect())


# -- pipeline -------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, docs):
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF).cache()
        assert out.columns == docs.columns
        if name == "ngram_jaccard_join":
            have = [(r["doc_id"], r["text"]) for r in rows.collect()]
            assert {r["doc_id"] for r in out.collect()} == {i for i, _, c in components_by_loop(have) if i == c}
        rows = out
    final = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
    assert {r["doc_id"] for r in final.select("doc_id").distinct().collect()} == {r["doc_id"] for r in rows.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == final.count()


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    language, quality_rules, distinct, packed = (stage for _, stage in corpus_pipeline.STAGES)
    ids = lambda rows: sorted((r["doc_id"] for r in rows.collect()), key=str)
    for stage in (language, quality_rules, distinct):
        assert stage(spark, none, SF).collect() == [] and stage(spark, none, SF).columns == odd.columns
    assert packed(spark, none, SF).collect() == []
    kept = language(spark, odd, SF)
    assert kept.columns == odd.columns and not {1, 2, 3, 10} & set(ids(kept)) and {5, 6, 7, 8} <= set(ids(kept))
    assert ids(language(spark, odd.withColumn("lang", F.lit(None).cast("string")), SF)) == []
    assert ids(quality_rules(spark, odd, SF)) == [5, 6, 6, 7, 8, None]
    assert ids(distinct(spark, odd, SF)) == [1, 10, 11, 2, 3, 4, 5, 6, 9]
    twice = odd.where("doc_id = 6").unionByName(odd.where("doc_id = 5").withColumn("doc_id", F.lit(6).cast("long")))
    assert sorted(len(r["text"]) for r in distinct(spark, twice, SF).collect()) == sorted({len(r["text"]) for r in twice.collect()})
    pieces = packed(spark, odd, SF).collect()
    assert collections.Counter(r["doc_id"] for r in pieces if r["start"] == 0) == collections.Counter(r["doc_id"] for r in odd.collect())
    assert all(sum(r["length"] for r in pieces if r["doc_id"] == i) == next(r["doc_tokens"] for r in pieces if r["doc_id"] == i) for i in (1, 2, 5, 11))


@pytest.mark.parametrize("stage", range(4))
def test_pipeline_hands_texts_to_python_in_small_batches(spark, monkeypatch, stage):
    key, most = workspace._BATCH_KEY, 2 * workspace.BATCH_BYTES

    def small(batches):
        for batch in batches:
            assert batch.nbytes < most, batch.nbytes
            yield from chunks([batch])

    for module in (language_id, quality, ngram_join, packing):
        monkeypatch.setattr(module, "chunks", small)
    text = F.concat(F.lit("w"), F.repeat(F.concat(F.lit(" ab"), F.col("id")), 1500))
    rows = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    path = workspace.fresh_path(spark, "texts")
    rows.write.parquet(path)
    spark.conf.unset(key)
    corpus_pipeline.STAGES[stage][1](spark, spark.read.parquet(path), SF).collect()
    spark.conf.set(key, "1m")
    workspace.in_batches(rows)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)


def test_packing_starts_no_workers_for_its_table_of_places(spark, docs):
    plan = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan
