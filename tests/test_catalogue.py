"""The catalogue engine against DuckDB, and by cases: search, lookup, store, graph, resolution."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from symbolarium import queries
from symbolarium.engine import Catalogue, Engine, EngineError, Options
from symbolarium.functions import hashing, ident, markup, text
from symbolarium.operators import graph, index_store, lookup, name_index, resolve, search, store
from symbolarium.plans import build_plan, index_build
from symbolarium.streaming.refresh import refresh_stream, stale

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    rows, names = got.collect(), sorted(got.columns)
    cur = duck.execute(queries.ORACLE_SQL[name])
    at = {d[0]: k for k, d in enumerate(cur.description)}
    assert sorted(at) == names
    assert sorted(str([r[c] for c in names]) for r in rows) == sorted(str([r[at[c]] for c in names]) for r in cur.fetchall())


def test_chains_and_sections_are_followed_everywhere(spark):
    asked = queries.catalog.exported(spark, SF).select("module").distinct().count()
    assert queries.QUERIES["bounded_chain_all"](spark, SF).select("module").distinct().count() == asked
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").where("text IS NOT NULL").collect()]
    assert queries.QUERIES["section_lines_all"](spark, SF).agg(F.sum("n")).first()[0] == sum(t.count("\n") + 1 for t in texts)


SYMBOLS = "component string, module string, name string, signature string, def_component string, def_module string, visibility string"


def symbols(spark, *rows):
    return spark.createDataFrame([r if len(r) == 7 else (*r, r[0], r[1], "exposed") for r in rows], SYMBOLS)


def find(entities, asked, **more):
    return search.search(entities, search.parse_query(asked, **more)).collect()


def test_wrapper_beats_internal_definition(spark):
    rows = symbols(
        spark, ("c", "D.Map.Internal", "ins", "s", "c", "D.Map.Internal", "exposed"), ("c", "D.Map", "ins", "s", "c", "D.Map.Internal", "exposed"),
        ("d", "E.Map.Long", "ins", "s", "c", "D.Map.Internal", "exposed"), ("c", "D.Lazy", "ins", "s", "c", "D.Lazy", "exposed"),
    )
    got = find(search.searchable(rows), "ins")
    assert [(r["component"], r["module"], len(r["alternates"])) for r in got] == [("c", "D.Lazy", 0), ("c", "D.Map", 2)]
    assert [a["module"] for a in got[1]["alternates"]] == ["E.Map.Long", "D.Map.Internal"]
    scoped = find(search.searchable(rows), "ins pkg:d")  # a scope keeps what another component also presents
    assert [(r["component"], r["module"]) for r in scoped] == [("d", "E.Map.Long")]


def test_exact_package_outranks_its_symbols(spark):
    rows = symbols(spark, *[("text", "Data.Text", f"text{k}", "s") for k in range(30)])
    packages = spark.createDataFrame([("text", "1.0")], "pkg string, version string")
    assert find(search.searchable(rows, packages), "text")[0]["kind"] == "package"
    assert find(search.searchable(rows, packages), "data.text")[0]["kind"] == "module"
    assert find(search.searchable(rows, packages), " ") == []


def test_query_language():
    q = search.parse_query("foo pkg:text bar pkg:text")
    assert (q.text, q.scope, q.tokens) == ("foo bar", "text", ["foo", "bar"])
    assert search.parse_query("x", toggle="").scope is None and search.parse_query("x pkg:A", toggle="b").scope == "A"
    for bad, code in (("x pkg:", "empty_scope"), ("pkg:a pkg:b", "conflicting_scopes"), ("x pkg:zz", "unknown_component")):
        with pytest.raises(search.QueryError) as e:
            search.parse_query(bad, known=["a", "b"])
        assert e.value.code == code


def test_patterns_are_literals(spark):
    rows = symbols(spark, ("c", "M", "a%b", "s"), ("c", "M", "axb", "s"), ("c", "M", "<$>", "s"))
    assert [r["name"] for r in find(search.searchable(rows), "a%")] == ["a%b"]
    assert [r["name"] for r in find(search.searchable(rows), "<$>")] == ["<$>"]


def test_collapse_loses_no_definition(spark):
    rows = queries.catalog.symbols(spark, SF)
    entities = search.searchable(rows).where("kind = 'symbol'").withColumn("score", F.lit(0))
    assert search.collapse(entities).count() == rows.select("def_component", "def_module", "name").distinct().count()


def test_two_shadowings(spark):
    project = spark.createDataFrame([("p", "1", "u", "a")], "pkg string, version string, unit_id string, name string")
    whole = spark.createDataFrame([("p", "1", "u", "a"), ("p", "1", "u", "b"), ("q", "1", "v", "c")], project.schema)
    assert sorted(r["name"] for r in lookup.shadowed_entries(project, whole).collect()) == ["a", "c"]
    assert sorted(r["name"] for r in lookup.shadowed_rows(project, whole, ("pkg", "name")).collect()) == ["a", "b", "c"]


def test_index_store_replaces_entries(spark, tmp_path):
    at = index_store.IndexStore(spark, f"file://{tmp_path}/index")
    kind = "name string, pkg string, version string, unit_id string"
    meta = lambda t, *e: spark.createDataFrame([(*x, t) for x in e], "pkg string, version string, unit_id string, indexed_at long")
    at.replace(spark.createDataFrame([("a", "p", "1", "u"), ("b", "q", "1", "v")], kind), meta(1, ("p", "1", "u"), ("q", "1", "v")))
    at.replace(spark.createDataFrame([("c", "p", "1", "u")], kind), meta(2, ("p", "1", "u")))
    assert sorted(r["name"] for r in at.rows().collect()) == ["b", "c"]
    at.replace(spark.createDataFrame([], kind), meta(3, ("q", "1", "v")))  # indexed, without rows
    assert sorted(r["name"] for r in at.rows().collect()) == ["c"] and at.entries().count() == 2


def test_refresh_stream_is_replayable(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", "1", "u"), ("b", "q", "1", "v")], "name string, pkg string, version string, unit_id string")
    rows.write.parquet(f"{tmp_path}/in/1")
    at = index_store.IndexStore(spark, f"file://{tmp_path}/index")
    kind = "name string, pkg string, version string, unit_id string"
    for n in (1, 2):
        refresh_stream(spark, f"{tmp_path}/in/*", kind, at, f"{tmp_path}/progress{n}").awaitTermination()
    assert sorted(r["name"] for r in at.rows().collect()) == ["a", "b"]
    prints = lambda *x: spark.createDataFrame(list(x), "pkg string, fingerprint string")
    assert sorted(r["pkg"] for r in stale(prints(("p", "1"), ("q", "2"), ("r", None)), prints(("p", "1"), ("q", "1"), ("r", None)), ["pkg"]).collect()) == ["q", "r"]


def test_an_index_reads_only_the_files_of_a_name(spark):
    kind = "pkg string, mod string, name string, version string"
    rows = spark.createDataFrame([(f"p{k}", "M", f"n{k % 40:02d}" if k % 3 else "common", "1") for k in range(300)] + [("q", "M", None, "1"), ("q", "N", "n07", "2"), ("q", "N", "n07", "2")], kind)
    index = name_index.NameIndex.build(rows, file_rows=30)
    assert len(index.files) >= 8 and sum(first <= "common" <= last for first, last, _ in index.files) > 1
    for name in ("common", "n07", "n39", "zz", "", "n0"):
        found = index.find(name)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, lookup.by_name(rows, name).collect()))
        assert len(found.inputFiles()) <= (5 if name == "common" else 2)
    assert index.find("n07", "N").count() == 2 and name_index.NameIndex(spark, index.path).find("n07", "N").count() == 2
    empty = name_index.NameIndex.build(rows.limit(0))
    assert empty.find("x").columns == rows.columns and empty.find("x").collect() == []


def engine_of(spark, **more):
    rows = symbols(spark, ("p", "M", "f", "f :: Int", "p", "M.Internal", "exposed"), ("p", "M", "g", "g :: Int", "p", "M", "exposed"))
    stored = spark.createDataFrame([("p", "M", "f", f"1.{k}", "u1") for k in range(3)] + [(f"q{k}", "N", "f", "1", "u") for k in range(6)], "pkg string, mod string, name string, version string, unit_id string")
    units = spark.createDataFrame([("p", "1.9", "u1", "local")], "pkg string, version string, unit_id string, origin string")
    decls = spark.createDataFrame([("p", "M.Internal", "f", "value", "f :: Int", "doc")], "component string, module string, name string, kind string, signature string, doc string")
    deps = spark.createDataFrame([("p", 0, "z"), ("p", 1, "a"), ("b", 0, "p"), ("a", 0, "p")], "pkg string, pos int, dep_pkg string")
    available = spark.createDataFrame([("p", "1.10"), ("p", "1.9")], "pkg string, version string")
    return Engine(Catalogue(rows, stored, units, deps, available, decls=decls), Options(**more))


def shown(df):
    r = df.collect()
    assert len(r) == 1
    return json.loads(r[0]["result"]), r[0]["unmatched"], json.loads(r[0]["envelope"])


def test_results_have_the_fields_that_were_asked_for(spark):
    engine = engine_of(spark)
    body, unmatched, whole = shown(engine.result("symbol", "p/M/f"))
    assert body == {"name": "f", "kind": "value", "package": "p", "version": "1.9", "module": "M", "signature": "f :: Int", "haddock_raw": "doc", "defined_in": {"package": "p", "module": "M.Internal"}}
    assert unmatched == "" and whole == {"result": body}
    assert shown(engine_of(spark, select=("sig", "haddock", "nope")).result("symbol", "p/M/f"))[:2] == ({"signature": "f :: Int", "haddock_raw": "doc"}, "nope")
    body, _, whole = shown(engine.result("lookup", "f"))
    assert set(body) == {"query", "providers"} and len(body["providers"]) == 9 and len(whole["actions"]) == 3  # five rows of three symbols
    assert whole["actions"]["p/M/f"] == "symbol p/M/f" and engine.result("lookup", "lost").collect() == []
    assert shown(engine_of(spark, full=True).result("lookup", "f"))[0]["tiers_consulted"] == ["cache"]
    assert shown(engine_of(spark, select=("tiers_consulted",)).result("lookup", "f"))[:2] == ({}, "tiers_consulted")
    body, _, whole = shown(engine_of(spark, overrides=("p=9",)).result("package", "p-3"))
    assert body == {"name": "p", "version": "3", "is_local": False, "exposed_modules": ["M"], "origin": "hackage"} and whole["outside_plan"] is True and whole["overrides"] == ["p=9"]
    assert shown(engine.result("module", "p", "M"))[0] == {"package": "p", "module": "M", "exports": ["f", "g"]}
    assert shown(engine.result("versions", "p"))[0] == {"package": "p", "pinned_version": "1.9", "available_versions": ["1.10", "1.9"]}
    assert shown(engine.result("deps", "p"))[0] == {"package": "p", "direction": "forward", "deps": ["z", "a"]}
    assert shown(engine.result("deps", "p", reverse=True, limit=1))[0] == {"package": "p", "direction": "reverse", "depth": 1, "deps": ["a"]}


def test_packages_offline_answer_from_what_is_cached(spark):
    remote = spark.createDataFrame([("kept", "1", None, True), ("far", "2", None, False), ("odd", "3", None, None), ("bad", None, "CORRUPTION", True)], "pkg string, version string, error string, cached boolean")
    for offline, want in ((False, {"kept": "1", "far": "2", "odd": "3", "bad": "CORRUPTION"}), (True, {"kept": "1", "far": "NOT_FOUND", "odd": "NOT_FOUND", "bad": "CORRUPTION"})):
        engine = engine_of(spark, offline=offline)
        engine.at.remote_packages = remote
        assert {r["ref"]: r["version"] or r["error"] for r in engine.package("kept", "far", "odd", "bad").collect()} == want
    engine.at.remote_packages = remote.drop("cached")
    assert engine.package("kept").first()["error"] == "NOT_FOUND"


def test_the_latest_pass_decides_between_modules_of_a_component(spark):
    kind = "component string, module string, name string, signature string, def_component string, def_module string"
    once = spark.createDataFrame([("a", "M", "f", "s", "d", "Aaa")], kind)
    later = spark.createDataFrame([("b", "M", "f", "s", "d", "Zzz"), ("b", "M", "f", "s", "e", "Zzz")], kind)
    asks = spark.createDataFrame([("me", "M", "f")], "asker string, module string, name string")
    deps = spark.createDataFrame([("me", "a"), ("me", "b")], "pkg string, dep_pkg string")
    env = resolve.extended_exports(resolve.extended_exports(None, once, 0), later, 1)
    got = resolve.probe_exports(asks, env, deps).first()
    assert got["chosen"]["def_module"] == "Zzz" and [(x["def_component"], x["def_module"]) for x in got["rejected"]] == [("d", "Aaa"), ("e", "Zzz")]
    assert resolve.probe_exports(asks, env.drop("generation"), deps).first()["chosen"]["def_module"] == "Aaa"
    again = resolve.extended_exports(resolve.extended_exports(None, later, 0), once, 1)
    assert resolve.probe_exports(asks, again, deps).first()["chosen"]["def_module"] == "Aaa"


def test_building_no_component_gives_the_columns(spark):
    deps, parts = spark.createDataFrame([], "pkg string, pos int, dep_pkg string"), spark.createDataFrame([], "pkg string")
    made = index_build.build_levels(deps, parts, lambda level, below: level.withColumn("made", F.lit(1)))
    assert made.columns == ["pkg", "made"] and made.collect() == []


def test_graph_cycles_end(spark):
    deps = spark.createDataFrame([("a", 0, "b"), ("b", 0, "c"), ("c", 0, "a"), ("c", 1, "d"), ("e", 0, "d")], "pkg string, pos int, dep_pkg string")
    roots = spark.createDataFrame([("a",)], "pkg string")
    assert sorted(tuple(r) for r in graph.closure(deps, roots).collect()) == [("b", 1), ("c", 2), ("d", 3)]
    assert sorted(tuple(r) for r in graph.closure(deps, roots, 1).collect()) == [("b", 1)]
    long = spark.range(1, 60).selectExpr("id AS pkg", "explode(array(id - 1, greatest(id - 3, 0), (id * 7) % 60)) AS dep_pkg")
    edges = {}
    for r in long.collect():
        edges.setdefault(r["pkg"], set()).add(r["dep_pkg"])
    want, ring, level = {}, {59}, 0
    while ring:
        level += 1
        ring = {d for p in ring for d in edges.get(p, ())} - {59, *want}
        want |= dict.fromkeys(ring, level)
    start = spark.createDataFrame([(59,)], "pkg long")
    assert {r["pkg"]: r["level"] for r in graph.closure(long, start).collect()} == want
    assert {r["pkg"]: r["level"] for r in graph.closure(long, start, 6).collect()} == {p: n for p, n in want.items() if n <= 6}
    order = dict(tuple(r) for r in graph.levels(deps, spark.createDataFrame([(x,) for x in "abcde"], "pkg string")).collect())
    assert order["d"] == 0 and order["e"] == 1 and order["a"] == order["b"] == order["c"] > 1


def test_exports_expand(spark):
    exports = spark.createDataFrame([("M", 0, "symbol", "f"), ("M", 1, "all", "T"), ("M", 2, "module", "N"), ("M", 3, "module", "Out"), ("N", 0, "symbol", "g"), ("N", 1, "symbol", "f")], "module string, pos int, form string, item string")
    decls = spark.createDataFrame([("M", "T", None), ("M", "C1", "T"), ("N", "g", None), ("P", "x", None)], "module string, name string, parent string")
    got = sorted((r["module"], r["name"]) for r in resolve.expanded_exports(exports, decls).collect())
    assert got == [("M", "C1"), ("M", "T"), ("M", "f"), ("M", "g"), ("N", "f"), ("N", "g"), ("P", "x")]
    modules = spark.createDataFrame([("M",), ("N",), ("P",)], "module string")
    assert [tuple(r) for r in resolve.outside_modules(exports, modules).collect()] == [("M", "Out")]


def test_resolution_follows_to_the_definer(spark):
    exported = spark.createDataFrame([("A", "f"), ("B", "f"), ("C", "f"), ("A", "lost")], "module string, name string")
    decls = spark.createDataFrame([("C", "f")], "module string, name string")
    imports = spark.createDataFrame([("A", "f", "B", False), ("B", "f", "C", True), ("B", "f", "A", False), ("A", "lost", "B", False)], "module string, name string, target string, explicit boolean")
    got = {(r["module"], r["name"]): (r["definer"], r["round"]) for r in resolve.resolve_exports(exported, decls, imports).collect()}
    assert got == {("A", "f"): ("C", 2), ("B", "f"): ("C", 1), ("C", "f"): ("C", 0), ("A", "lost"): (None, None)}
    asks = spark.createDataFrame([("A", "f"), ("A", "lost")], "module string, name string")
    chain = {r["name"]: (r["definer"], r["hop"], r["verdict"]) for r in resolve.followed_chain(asks, decls, exported, imports).collect()}
    assert chain == {"f": ("C", 2, "found"), "lost": (None, None, "exhausted")}
    short = resolve.followed_chain(asks, decls, exported, imports, hops=1).where("name = 'f'").first()
    assert short["verdict"] == "stopped_at_bound"


def test_long_reexport_chains_are_followed(spark):
    exported = spark.range(21).select(F.concat(F.lit("M"), F.col("id")).alias("module"), F.lit("f").alias("name"))
    imports = spark.range(20).select(F.concat(F.lit("M"), F.col("id")).alias("module"), F.lit("f").alias("name"), F.concat(F.lit("M"), F.col("id") + 1).alias("target"), F.lit(True).alias("explicit"))
    decls = spark.createDataFrame([("M20", "f")], "module string, name string")
    got = {r["module"]: (r["definer"], r["round"]) for r in resolve.resolve_exports(exported.coalesce(1), decls, imports.coalesce(1)).collect()}
    assert got["M0"] == ("M20", 20) and len(got) == 21 and {d for d, _ in got.values()} == {"M20"}


def test_recursion_keeps_a_package_once_a_step(spark):
    before = spark.conf.get("spark.sql.cteRecursionLevelLimit")
    deps = spark.range(1, 40).selectExpr("id AS pkg", "explode(array(id - 1, greatest(id - 2, 0))) AS dep_pkg").coalesce(1)
    got = {r["pkg"]: r["level"] for r in graph.recursive_levels(deps, spark.createDataFrame([(39,)], "pkg long")).collect()}
    assert len(got) == 39 and max(got.values()) == 20
    assert spark.conf.get("spark.sql.cteRecursionLevelLimit") == before


def test_stream_shows_over_an_empty_batch_write(spark, tmp_path):
    kind = "name string, pkg string, version string, unit_id string"
    at = index_store.IndexStore(spark, f"file://{tmp_path}/index")
    now = spark.range(1).select(F.lit("p").alias("pkg"), F.lit("1").alias("version"), F.lit("u").alias("unit_id"), F.unix_timestamp(F.current_timestamp()).alias("indexed_at"))
    at.replace(spark.createDataFrame([("z", "q", "1", "v")], kind), now.withColumn("pkg", F.lit("q")).withColumn("unit_id", F.lit("v")))
    at.replace(spark.createDataFrame([], kind), now)
    spark.createDataFrame([("a", "p", "1", "u")], kind).write.parquet(f"{tmp_path}/in/1")
    refresh_stream(spark, f"{tmp_path}/in/*", kind, at, f"{tmp_path}/progress").awaitTermination()
    assert sorted(r["name"] for r in at.rows().collect()) == ["a", "z"]


def test_probe_ties_break_by_definition(spark):
    asks = spark.createDataFrame([("me", "M", "f", ["N", "M"])], "asker string, module string, name string, candidates array<string>")
    exports = spark.createDataFrame([("M", "f", "p2", "z", "D"), ("M", "f", "p1", "a", "D"), ("M", "f", "hidden", "A", "D")], "module string, name string, presenter string, def_component string, def_module string")
    deps = spark.createDataFrame([("me", "p1"), ("me", "p2")], "pkg string, dep_pkg string")
    got = resolve.probe_candidates(asks, exports, deps).first()
    assert got["target"] == "M" and got["chosen"]["def_component"] == "a" and [x["def_component"] for x in got["rejected"]] == ["z"]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("text", (None, "text", None, None, None)), ("text-1.2.3/Data.Text/pack", (None, "text", "1.2.3", "Data.Text", "pack")), ("base/Data.Function/.", (None, "base", None, "Data.Function", ".")),
        ("base/map", ("module_not_uppercase",)), ("a//b", ("symbol_without_module",)), ("a/", ("invalid_module",)), ("a/B..C", ("invalid_module",)), ("a/B.c./x", ("invalid_module",)), ("a/low.Case/x", ("module_not_uppercase",)),
        ("a/B/", ("invalid_symbol",)), ("", ("empty_input",)), ("/B", ("empty_package",)), ("-1.0/B", ("empty_package",)), ("a@1/B", ("invalid_package",)),
    ],
)
def test_symbol_paths(spark, path, want):
    got = one(spark, ident.symbol_path(F.lit(path)))
    assert tuple(got) == (*want, *[None] * (5 - len(want)))
    if got["error"] is None:
        assert one(spark, ident.symbol_path_text(ident.symbol_path(F.lit(path)))) == path


def test_scalar_cases(spark):
    assert tuple(one(spark, ident.package_ref(F.lit("foo-bar-1.2-0123456789ab")))) == ("foo-bar", "1.2")
    assert tuple(one(spark, ident.package_ref(F.lit("foo-bar")))) == ("foo-bar", None)
    assert tuple(one(spark, ident.component_key(F.lit("p:exe:n")))) == ("p", "exe", "n") and tuple(one(spark, ident.component_key(F.lit("p::n")))) == ("p", "sublib", ":n")
    assert [one(spark, ident.component_key(F.lit(x)))["kind"] for x in ("p:", "p:exe:", "p:exe", "p:a:b")] == ["lib", "lib", "sublib", "sublib"]
    assert [tuple(one(spark, ident.package_ref(F.lit(x)))) for x in ("foo-1.2.", "-1.2", "foo-", "a-deadbeef")] == [("foo", "1.2."), ("", "1.2"), ("foo-", None), ("a", None)]
    assert tuple(one(spark, ident.qualified_name(F.lit("Data.Map.")))) == ("Data.Map", "")
    assert tuple(one(spark, ident.origin_name(F.lit("A.B.."))))  == ("A.B", ".") and one(spark, ident.origin_name(F.lit("IsString|"))) is None
    assert [tuple(one(spark, ident.origin_name(F.lit(x)))) for x in ("GHC.Classes.||", "Data.Sequence.<|", "A.B.B", "f")] == [("GHC.Classes", "||"), ("Data.Sequence", "<|"), ("A.B", "B"), (None, "f")]
    assert one(spark, ident.origin_entries(F.lit("  A.T|{A.x B.y}"))) == ["A.T|", "A.x", "B.y"]
    assert one(spark, ident.version_numbers(F.lit("20240101120000.1"))) == [20240101120000, 1] and one(spark, ident.version_macro(F.lit("9"))) is None and one(spark, ident.version_macro(F.lit("9.x"))) is None
    assert one(spark, ident.version_numbers(F.lit("1.x.10"))) == [1, 0, 10] and tuple(one(spark, ident.version_macro(F.lit("9.10.3")))) == (910, 3)
    assert one(spark, ident.shared_leading(F.lit("A.B.C"), F.lit("A.B.D.E"))) == 2 and one(spark, ident.shared_trailing(F.lit("x/A/B.hs"), F.lit("y/A/B.hs"))) == 2
    assert one(spark, ident.module_of_path(F.lit("Data/Map.hs"))) == "Data.Map"
    assert one(spark, text.strip_tags(F.lit("a<b>c</b>d<e"))) == "acd" and one(spark, text.decode_entities(F.lit("&amp;lt;"))) == "&lt;"
    assert one(spark, text.clamped_slice(F.lit(["a", "b", "c"]), F.lit(-4), F.lit(2))) == ["a", "b"]
    assert one(spark, text.lines(F.lit("a\nb\n"))) == ["a", "b"] and one(spark, text.percent_encoded(F.lit("a b:/~"))) == "a%20b:%2F~"
    assert [tuple(s) for s in one(spark, text.highlight_spans(F.lit("insertWith"), ["with", "insert", "sert"]))] == [(0, 6), (6, 4)]
    assert one(spark, text.shell_quoted(F.lit("it's"))) == "'it'\\''s'" and one(spark, text.mime_type(F.lit("a/b.CSS"))) == "text/css; charset=utf-8"
    assert one(spark, text.shell_quoted(F.lit("a=b+c"))) == "'a=b+c'" and one(spark, text.shell_quoted(F.lit(""))) == "''" and one(spark, text.shell_quoted(F.lit("a/b:c@d_e.f-g"))) == "a/b:c@d_e.f-g"
    assert one(spark, text.percent_encoded(F.lit("a@&=+$,*"))) == "a@&=+$,%2A" and one(spark, text.safe_segments(F.lit("pkg/.hidden/x"))) is False and one(spark, text.safe_segments(F.lit("pkg/x.y"))) is True
    assert one(spark, text.safe_segments(F.lit("a/../b"))) is False and one(spark, text.needs_preprocessor(F.lit("{-# LANGUAGE CPP #-}"))) is True
    assert one(spark, hashing.from_http_date(hashing.http_date(F.lit("2024-02-29 10:11:12").cast("timestamp")))).isoformat() == "2024-02-29T10:11:12"
    link = F.lit('<a class="k" href="A-B.html#x"><a href="../q-2.0/C.html">')
    assert one(spark, text.rewrite_links(text.rewrite_links(link, "p", "p-1.0"), "p", "p-1.0")) == '<a class="k" href="/pkg/p/A.B#x"><a href="/haddock/q-2.0/C.html">'


def test_markup_parsers(spark):
    page = '<div class="x"><div id="a">1<div>2</div>3</div>4</div>'
    assert markup.div_slice_text(page, "a") == "1<div>2</div>3" and markup.div_slice_text(page, "b") is None
    head = "Module : M\nLicense : BSD\nSPDX-License-Identifier : MIT\nX-Note : one\n   two\n\nProse: here."
    rows = spark.createDataFrame([(head,), (None,)], "t string").select(markup.header_fields(F.col("t")).alias("h")).collect()
    h = rows[0]["h"]
    assert (h["license_form"], h["license"], h["prose"]) == ("spdx", "MIT", "Prose: here.") and [tuple(e) for e in h["extra"]] == [("X-Note", "one\ntwo")]
    assert rows[1]["h"]["prose"] is None


def test_markup_parsers_get_few_rows_at_a_time(spark):
    rows = spark.range(10).select(markup.div_slice(F.lit('<div id="a">1</div>'), "a"), markup.header_fields(F.lit("Module : M")))
    plan = rows._jdf.queryExecution().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert rows.first()[0] == "1"


def test_plan_files(spark, tmp_path):
    plan = {
        "compiler-id": "c-1", "os": "linux", "arch": "x86_64",
        "install-plan": [
            {"type": "pre-existing", "id": "base-4", "pkg-name": "base", "pkg-version": "4.0", "depends": []},
            {"type": "configured", "id": "my-lib", "pkg-name": "my", "pkg-version": "1.0", "style": "local", "pkg-src": {"type": "local", "path": "."}, "components": {"lib": {"depends": ["base-4", "gone-1"]}}},
            {"type": "configured", "id": "my-exe", "pkg-name": "my", "pkg-version": "1.0", "style": "local", "pkg-src": {"type": "local", "path": "."}, "components": {"exe:my": {"depends": ["my-lib", "base-4"]}}},
        ],
    }
    (tmp_path / "plan.json").write_text(json.dumps(plan))
    units = build_plan.read_units(spark, f"{tmp_path}/plan.json")
    read = build_plan.read_pins(spark, f"{tmp_path}/plan.json")._jdf.queryExecution().executedPlan().toString()
    schema = read[read.index("ReadSchema") :]
    assert "pkg-version" in schema and not any(c in schema for c in ("pkg-src", "depends", "dist-dir", "style"))
    assert sorted(tuple(r) for r in build_plan.read_pins(spark, f"{tmp_path}/plan.json").collect()) == [("base", "4.0", "base-4"), ("my", "1.0", "my-lib")]
    assert [tuple(r) for r in build_plan.dependency_edges(units).collect()] == [("my", 0, "base", "4.0")]
    assert {r["origin"] for r in units.collect()} == {"distribution", "local"}


def test_interface_dumps(spark):
    dump = ["interface pkg:A.B 9", "exports:", "  f", "  C.D.g", "  f", "  S.IsString|{S.from}", "  Q.<|", "orphans: x", "  not.this"]
    rows = spark.createDataFrame([("a", k, t) for k, t in enumerate(dump)], "file string, pos int, text string")
    got = sorted(tuple(r) for r in build_plan.dump_exports(rows).select("module", "name", "origin_module", "pos").collect())
    assert got == [("A.B", "<|", "Q", 6), ("A.B", "f", "A.B", 2), ("A.B", "from", "S", 5), ("A.B", "g", "C.D", 3)]


def test_engine_verbs(spark):
    rows = symbols(spark, ("p", "M", "f", "f :: Int", "p", "M.Internal", "exposed"), ("p", "M.Internal", "f", "f :: Int", "p", "M.Internal", "internal"))
    kind = "pkg string, mod string, name string, version string, unit_id string"
    stored = spark.createDataFrame([("p", "M", "f", "1.9", "u1"), ("p", "M", "f", "1.10", "u2")], kind)
    units = spark.createDataFrame([("p", "1.9", "u1", "local")], "pkg string, version string, unit_id string, origin string")
    decls = spark.createDataFrame([("p", "M.Internal", "f", "value", 2, 3, "f :: Int", "doc")], "component string, module string, name string, kind string, first_line int, last_line int, signature string, doc string")
    engine = Engine(Catalogue(
        rows, stored, units, spark.createDataFrame([("p", 0, "q"), ("q", 0, "r")], "pkg string, pos int, dep_pkg string"),
        spark.createDataFrame([("p", "1.9"), ("p", "1.10")], "pkg string, version string"), spark.createDataFrame([("p", "M.Internal", "l1\nl2\nl3\nl4")], "component string, module string, content string"),
        decls, spark.createDataFrame([("p", "u1", None)], "pkg string, pin_unit string, pin_version string"),
    ))
    assert engine.search("f").first()["module"] == "M"
    with pytest.raises(EngineError) as e:
        engine.search("f pkg:nope")
    assert (e.value.code, e.value.exit_code) == ("USER_ERROR", 2)
    assert [(r["version"], r["tier"], r["tiers_consulted"]) for r in engine.lookup("M.f").collect()] == [("1.9", 1, "cache")]
    hits = "query string, pkg string, mod string, name string"
    engine.at.local_hits = spark.createDataFrame([("g", "x", "Y", "g")], hits)
    engine.at.remote_hits = spark.createDataFrame([("h", "w", "W", "h", "network", None)], f"{hits}, resolved_from string, error string")
    assert {r["query"]: (r["tier"], r["error"]) for r in engine.lookup("g", "h", "z").collect()} == {"g": (2, None), "h": (3, None), "z": (None, "NOT_FOUND")}
    offline = Engine(engine.at, Options(offline=True, overrides=("p=1.10", "q = 2")))
    failed = offline.lookup_failures(offline.lookup("g", "h")).collect()
    assert [(r["query"], r["exit_code"], r["actions"]["retry_online"]) for r in failed] == [("h", 4, "lookup h")]
    assert [r["version"] for r in offline.lookup("f").collect()] == ["1.10"]
    with pytest.raises(EngineError) as e:
        Engine(engine.at, Options(overrides=("nonsense",))).pins()
    assert "missing_equals" in str(e.value)
    engine.at.installed = spark.createDataFrame([("s", "0.1")], "name string, version string")
    assert {r["ref"]: (r["version"], r["found_in"], r["outside_plan"], r["error"]) for r in engine.package("p", "p-1.9", "s", "none").collect()} == {
        "p": ("1.9", "plan", False, None), "p-1.9": ("1.9", "asked", True, None), "s": ("0.1", "store", True, None), "none": (None, None, None, "NOT_FOUND")}
    assert engine.package_info("p").first()["modules"] == ["M", "M.Internal"]
    assert (engine.page("p", "M").first()["view"], engine.page("p", "M").first()["names"]) == ("source", ["f"])
    assert tuple(engine.page("p", "None").first())[2:] == ("exports_only", None, [], "package source could not be resolved")
    assert [(r["version"], r["pinned"]) for r in engine.versions("p").collect()] == [("1.10", False), ("1.9", True)]
    assert engine.symbol("p/M/f").first()["doc"] == "doc" and engine.module("p", "M").first()["elsewhere"] is False
    assert [(r["span"], r["lines"]) for r in engine.source("p/M/f").collect()] == [("declaration", ["l2", "l3"])]
    assert [r["dep_pkg"] for r in engine.deps("p").collect()] == ["q"] and [r["pkg"] for r in engine.deps("r", reverse=True).collect()] == ["q"]
    assert {r["pkg"] for r in engine.closure("p").collect()} == {"q", "r"}
    checks = {r["relation"]: r["ok"] for r in engine.doctor().collect()}
    assert all(checks.values()) and "all_pass" in checks
    engine.at.units = None
    assert engine.doctor().where("relation = 'all_pass'").first()["ok"] is False
