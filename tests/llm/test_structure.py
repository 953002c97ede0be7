"""Centroid clustering, conversation trie and personal data against brute force and SQL, and on
nulls, empty and long values, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from symbolarium.llm import delta_lloyd, disclosure, prefix_trie, queries, sorted_keys, workspace

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name, tables):
    """The query's rows at the smallest scale are those of its SQL twin."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns)
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want.fetchall())


# -- 11: centroid clustering -----------------------------------------------------------------


def lloyd(rows, k, rounds, scale=256):
    """The definition, in Python integers: {vec_id: [(cluster, distance), ...]}, centroids."""
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if e is not None and len(e) == 4 and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        for j, vs in own.items():
            centroids[j] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], centroids


def test_delta_lloyd_is_its_sql(spark):
    same_as_sql(spark, "op11_delta_lloyd", ["embeddings"])


@pytest.mark.parametrize("rounds", [0, 1, 5, 40])
def test_delta_lloyd_against_the_definition_on_odd_rows(spark, rounds):
    rng = random.Random(rounds)
    near = [[rng.gauss(c % 3, 0.3) for c in range(j, j + 4)] for j in range(4) for _ in range(20)]
    rows = list(enumerate(near)) + [(None, near[0]), (None, near[5]), (7, near[7]), (7, near[7]), (8, near[3]), (900, None), (901, []), (902, near[0][:3]), (903, near[0] * 2)]
    rows += [(904, [0.0, None, 0.0, 0.0]), (905, [0.0, math.nan, 0.0, 0.0]), (906, [0.0, math.inf, 0.0, 0.0]), (907, [-0.001, 0.0, 1e-30, -0.0]), (908, [9e3, -9e3, 1.0, 1.0])]
    df = spark.createDataFrame([(i, e, 3, 1, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, V int, inertia string").repartition(5)
    got = delta_lloyd.centroid_clusters(df, k=9, rounds=rounds, dims=4).collect()
    want, centroids = lloyd(rows, 9, rounds)
    assert collections.Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == collections.Counter(want)
    for r in got:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["inertia"] == sum(d for *_, d in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_delta_lloyd_repeats_no_comparison_in_vain():
    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (500, 8))
    centroids = v[:20].copy()
    cluster, distance, computed = delta_lloyd.reassigned(v, np.full(500, -1), np.zeros(500, np.int64), centroids, np.ones(20, bool))
    assert computed == 500 * 20
    for _ in range(20):
        changed = rng.random(20) < 0.2
        centroids = centroids + changed[:, None] * rng.integers(-40, 40, (20, 8))
        d = ((v[:, None] - centroids[None]) ** 2).sum(axis=2)
        farther = int((changed[cluster] & (d[np.arange(500), cluster] > distance)).sum())
        own = int(changed[cluster].sum())
        cluster, distance, computed = delta_lloyd.reassigned(v, cluster, distance, centroids, changed)
        assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
        assert computed == own + farther * 20 + (500 - farther) * int(changed.sum())
    assert delta_lloyd.reassigned(v, cluster, distance, centroids, np.zeros(20, bool))[2] == 0


def test_delta_lloyd_few_none_and_too_large(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64), (3, [2.0] * 64)], schema)
    assert {(r["vec_id"], r["distance"]) for r in delta_lloyd.centroid_clusters(few).collect()} == {(1, 0), (2, 0), (3, 0)}
    empty = delta_lloyd.centroid_clusters(spark.createDataFrame([], schema))
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="beyond"):
        delta_lloyd.centroid_clusters(spark.createDataFrame([(1, [3e38] * 64)], schema)).collect()
    big = np.array([[delta_lloyd.LARGEST - 1] * 64, [1 - delta_lloyd.LARGEST] * 64])
    assert delta_lloyd.squared_distances(big, big)[0, 1] == 64 * (2 * (delta_lloyd.LARGEST - 1)) ** 2


# -- 12: conversation prefix trie ------------------------------------------------------------


def trie(rows, group=20, heads=4):
    """The definition by loops: {path: (...)} over the rows (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(own.get(c - int(math.fmod(c, group)), [])[:h] + ts[h:])
    members = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    out = {}
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        words = lambda q: len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
        ends = ",".join(str(c) for c in sorted(cs) if built[c] == p)
        out[p] = (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], sum(not kids[q] for q in below), sum((len(members[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest())
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_trie_is_its_sql(spark):
    same_as_sql(spark, "op12_prefix_trie", ["conversations"])


def test_trie_has_the_columns_of_its_sql(spark):
    assert queries.QUERIES["op12_prefix_trie"](spark, SF).columns == COLUMNS


def odd_conversations(seed):
    """Shared beginnings of many depths, copies, one very long conversation, nulls, ties, repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(-45, 120):
        n = rng.choice([1, 1, 2, 3, 4, 5, 9])
        rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b b", "c c c", None, ""])) for t in range(n)]
    copied = [(t, "user", f"turn {t % 7}") for t in range(8)]
    rows += [(c, *t) for c in range(200, 260) for t in copied]
    rows += [(300, t, "user", f"w{t % 5} x") for t in range(700)] + [(301, t, "user", f"w{t % 5} x") for t in range(350)]
    rows += [(400, None, "z", "null first"), (400, 1, "a", "one"), (400, 1, "b", "tie"), (400, 1, "b", "tie"), (400, None, "y", "other null")]
    rows += [(None, 1, "user", "nobody's"), (2**62, 0, "user", "far"), (-(2**62), 0, "1", ":2"), (-(2**62) + 1, 0, "1:", "2"), (410, 0, "user", "word " * 100_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("spread", [1, 4, 23])
def test_trie_against_the_definition_on_odd_rows(spark, spread, monkeypatch):
    rows = odd_conversations(spread)
    spark.conf.set("spark.sql.shuffle.partitions", str(spread))
    if spread == 23:
        monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 20)
        monkeypatch.setattr(workspace, "HOT_SHARE", 20)
    try:
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, Node string").repartition(spread)
        got = prefix_trie.conversation_trie(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = trie(rows)
    assert collections.Counter(tuple(r[c] for c in COLUMNS) for r in got) == collections.Counter(want.values())
    at = sorted(got, key=lambda r: r["preorder"])
    assert [r["preorder"] for r in at] == list(range(len(at)))
    for r in at:  # the interval is the subtree: deeper nodes, and then none
        inside, after = at[r["preorder"] + 1 : r["subtree_end"]], at[r["subtree_end"] : r["subtree_end"] + 1]
        assert all(x["depth"] > r["depth"] for x in inside) and all(x["depth"] <= r["depth"] for x in after)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.conversation_trie(spark.createDataFrame([], schema)).collect() == []
    c = next(i for i in range(20, 999) if i % 20 and zlib.crc32(str(i).encode()) % 4 == 3)
    only = prefix_trie.conversation_trie(spark.createDataFrame([(c, 5, "user", "gone"), (c, 6, "user", "too")], schema)).collect()
    assert [tuple(r[x] for x in COLUMNS) for r in only] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


# -- 13: personal data -----------------------------------------------------------------------

PATTERNS = {  # as stated, without regard to time
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_patterns(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
            fits = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")[:4]) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if fits:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_spans_are_those_of_the_plain_patterns():
    rng = random.Random(4)
    parts = ["a@b.c", "x.y+z@", "@", "a@b", ".", "..", "é", " ", "-", "+", "+1 (555) 010-9999", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "256.1.1.1", "001.2.3.0", "9", "10.0.0.1.", "(", ")", "\n", "日本", "12345678901234567890", "0" * 14, "A_b%c@d-e.f.g", "@h.i", "\u0663"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert disclosure.personal_spans(text) == base_by_patterns(text), text
    assert disclosure.personal_spans("") == []
    long = ["x" * 300_000, "x" * 200_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "1 " * 150_000, "a@" * 100_000, "0" * 9000 + ".1.2.3"]
    assert [[(k, a, b) for a, k, b in disclosure.personal_spans(t)] for t in long] == [[], [], [], [(1, 8 * i, 8 * i + 7) for i in range(37_500)], [], [], [], [(1, 0, 9006)]]


def lower(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def disclosing_by_loops(texts, window=10, support=3, share=0.8):
    word = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
    n_entity, n_both, contexts, n_term = (collections.Counter(), collections.Counter(), collections.defaultdict(set), collections.Counter())
    for text in texts:
        text = text or ""
        base = base_by_patterns(text)
        n_term.update({lower(m[0]) for m in word.finditer(text)})
        free = [m for m in word.finditer(text) if not any(m.start() < e and s < m.end() for s, _, e in base)]
        around = collections.defaultdict(set)
        for s, k, e in base:
            value = text[s:e].lower() if k < 2 else re.sub("[^0-9]", "", text[s:e])
            before = [lower(m[0]) for m in free if m.start() < s][-window:]
            around[k, value] |= {*before, *[lower(m[0]) for m in free if m.start() >= e][:window]}
        for entity, near in around.items():
            n_entity[entity] += 1
            for t in near:
                n_both[entity, t] += 1
                contexts[entity, t].add(frozenset(near))
    out = {}
    for (entity, t), n in n_both.items():
        pmi, ic = math.log2(n * len(texts) / (n_entity[entity] * n_term[t])), math.log2(len(texts) / n_entity[entity])
        if len(contexts[entity, t]) >= support and 2 * n >= n_term[t] and 2 * n_entity[entity] <= len(texts) and pmi >= share * ic:
            out[t] = max(out.get(t, 0), 2 if 10 * n >= 9 * n_term[t] else 1)
    return out


def spans_by_loops(text, terms):
    base = base_by_patterns(text)
    word = re.compile("[A-Za-z0-9\u0080-\U0010ffff]+")
    hits = [(m.start(), 4, m.end()) for m in word.finditer(text or "") if terms.get(lower(m[0])) and not any(m.start() < e and s < m.end() for s, _, e in base)]
    return ",".join(f"{disclosure.KINDS[k]}:{s}:{e}" for s, k, e in sorted(base + hits))


def corpus_with_secrets():
    """Names that go with one address in varied passages, some also alone; copies; clean texts."""
    rng = random.Random(12)
    prose = lambda n: [rng.choice(["the", "of", "ré", "house"] + [f"w{rng.randrange(60)}" for _ in range(9)]) for _ in range(n)]
    texts = [" ".join(prose(40)) for _ in range(60)]
    for who, name in enumerate(["Zorblax", "Éowyn", "quintus7", "halfway"]):
        for _ in range(5):
            texts.append(" ".join([*prose(20), name, *prose(3), f"person{who}@mail.example.com", "+1 (555) 010-000" + str(who), *prose(20)]))
        texts += [" ".join([*prose(10), name + ",", *prose(10)]) for _ in range([0, 1, 2, 4][who])]
    texts += ["a copied passage with contact desk77 admin@corp.example.org whose neighbours are rare"] * 9
    return texts + [None, "", "10.0.0.1 " + "word " * 50_000 + "zorblax", " ".join(f"10.0.0.1 rareword{i % 3} {' '.join(prose(12))}" for i in range(8))]


def test_disclosing_terms_against_loops(spark):
    texts = corpus_with_secrets()
    df = spark.createDataFrame([(i // 2 if i % 9 else None, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, term int, Spans string").repartition(5)
    want = disclosing_by_loops(texts)
    assert want["zorblax"] == 1 and want["quintus7"] == 1 and want["Éowyn"] == 1 and "halfway" in want
    assert not {"the", "desk77", "neighbours"} & set(want)
    found = disclosure.personal_data(df).collect()
    got = collections.Counter((r["doc_id"], ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["spans"])) for r in found)
    assert got == collections.Counter((i // 2 if i % 9 else None, spans_by_loops(t, want)) for i, t in enumerate(texts))
    for r in found:
        assert "@" not in (r["sanitised"] or "") and "zorblax" not in (r["sanitised"] or "").lower()
    assert sum(r["sanitised"] is None for r in found) == 1


def test_disclosing_terms_generalised_removed_and_rewritten(spark):
    texts = [f"filler{i} only Alice4 writes as a@x.org about topic{i}" for i in range(12)] + ["nothing here"] * 900
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = disclosure.disclosing_terms(df)
    assert {r["number"] for r in terms.collect()} == {2}
    assert disclosure.personal_data(df, terms).where("doc_id = 3").first()["sanitised"] == "filler3     [EMAIL]  topic3"
    more = df.unionByName(spark.createDataFrame([(90 + i, "Alice4 and only she writes") for i in range(6)], df.schema))
    assert disclosure.personal_data(more).where("doc_id = 3").first()["sanitised"] == "filler3 [word] [code] [word]  [EMAIL]  topic3"
    assert disclosure.personal_data(df, terms.limit(0)).where("doc_id = 3").first()["sanitised"] == "filler3 only Alice4 writes as [EMAIL] about topic3"


def test_personal_data_of_nothing_and_query_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert disclosure.personal_data(none).collect() == [] and disclosure.personal_data_digests(none).collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = disclosing_by_loops([r["text"] for r in docs])
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_disclosure"](spark, SF).collect()}
    for r in docs:
        base, mine = base_by_patterns(r["text"]), got[r["doc_id"]]
        assert [mine[f"n_{k}"] for k in disclosure.KINDS[:4]] == [sum(x[1] == k for x in base) for k in range(4)]
        assert mine["base_sha256"] == hashlib.sha256(",".join(f"{disclosure.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert mine["spans"] == spans_by_loops(r["text"], want)


def test_sorted_keys_over_several_files(spark, monkeypatch):
    monkeypatch.setattr(sorted_keys, "FILE_KEYS", 7)
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 60))
    stored_keys = sorted_keys.sorted_keys(spark.createDataFrame([(int(k), i % 2 + 1) for i, k in enumerate(keys)], "key long, number int"))
    with workspace.mapped_files(stored_keys.paths) as local:
        assert len(local) > 4
        asked = rng.permutation(np.r_[keys[::3], keys[::5], rng.integers(-(2**63), 2**63 - 1, 40)])
        want = [dict(zip(keys.tolist(), [i % 2 + 1 for i in range(len(keys))], strict=True)).get(a, 0) for a in asked.tolist()]
        assert stored_keys.lookup(local, asked).tolist() == want
        assert stored_keys.lookup(local, asked[:0]).tolist() == []
