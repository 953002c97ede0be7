"""Searches by signature, lazy probing, chains with their failures: by cases; their queries are held
against SQL in test_catalogue."""

import json

from pyspark.sql import functions as F

from symbolarium.functions.signature import is_signature, signature_keys, signature_parts
from symbolarium.operators import cascade, reach, signatures

# -- signatures ------------------------------------------------------------------------------


def test_signatures_are_split_at_their_outer_arrows(spark):
    cases = {
        "map :: (a -> b) -> [a] -> [b]": ["( v1 -> v2 )", "[ v1 ]", "[ v2 ]"], "sort :: Ord k => [k]->[k]": ["[ v1 ]", "[ v1 ]"], "Int": ["Int"], "": [], None: [],
        "f :: (Eq a, Show b) => M.Map a b -> (b, a)": ["M.Map v1 v2", "( v2 , v1 )"], "(a->b) -> ((b->c) -> a)": ["( v1 -> v2 )", "( ( v2 -> v3 ) -> v1 )"], "x' -> _y": ["v1", "v2"],
        "g ::": [], "(::) -> a": ["( : : )", "v1"], " \n ": [], "(a -> b": ["( v1 -> v2"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").withColumn("p", signature_parts(F.col("s")))
    assert {r["s"]: r["p"] for r in df.collect()} == cases
    keys = spark.sql("SELECT array('v1', 'Int', 'v1', 'Bool') AS p").union(spark.sql("SELECT CAST(array() AS array<string>)")).select(signature_keys(F.col("p")).alias("k"))
    assert [r["k"] for r in keys.collect()] == [["takes v1 #1", "takes Int #1", "takes v1 #2", "gives Bool"], []]
    assert [r[0] for r in spark.createDataFrame([("a -> b",), ("f :: A",), ("Data.Map.lookup",)], "q string").select(is_signature(F.col("q"))).collect()] == [True, True, False]


def index(spark, *signed):
    rows = [("c", "M", s.split(" ::")[0] if s else f"none{i}", s) for i, s in enumerate(signed)]
    return signatures.signature_index(spark.createDataFrame(rows, "component string, module string, name string, signature string")).cache()


def matches(spark, idx, *queries, **more):
    out = signatures.signature_matches(spark.createDataFrame([(q,) for q in queries], "query string"), idx, **more)
    return sorted((r["query"], r["rank"], r["name"], r["extra"], r["moved"]) for r in out.collect())


def test_signatures_match_by_their_multiset_of_arguments(spark):
    idx = index(spark, "twice :: Int -> Int -> Bool", "once :: Int -> Bool", "swap :: k -> Int -> Int -> Bool", "other :: Int -> Int", None, "")
    asked = ("Int -> Int -> Bool", "Int -> z -> Int -> Bool", "Int -> Bool", "Int -> Char", "", "Nothing -> Bool", "Int -> Bool")
    assert matches(spark, idx, *asked, limit=None) == [
        ("Int -> Bool", 1, "once", 0, False), ("Int -> Bool", 2, "twice", 1, False), ("Int -> Bool", 3, "swap", 2, False),
        ("Int -> Int -> Bool", 1, "twice", 0, False), ("Int -> Int -> Bool", 2, "swap", 1, False), ("Int -> z -> Int -> Bool", 1, "swap", 0, True),
    ]
    assert [m[2] for m in matches(spark, idx, "Int -> Bool", limit=1)] == ["once"]


def test_a_missing_index_is_an_empty_tier(spark):
    asks = spark.createDataFrame([("Int -> Bool",), ("sort",)], "query string")
    assert signatures.signature_matches(asks, None).collect() == []
    named = spark.createDataFrame([("sort", "base", "Data.List", "sort"), ("Int -> Bool", "base", "X", "by name")], "query string, pkg string, mod string, name string")
    assert [tuple(r) for r in signatures.local_tier(asks, None, named).collect()] == [("sort", "base", "Data.List", "sort")]
    found = signatures.local_tier(asks, index(spark, "once :: Int -> Bool"), named).collect()
    assert sorted(r["name"] for r in found) == ["once", "sort"]


# -- probing ---------------------------------------------------------------------------------

EDGES = "pkg string, pos int, dep_pkg string"


def test_dependencies_come_nearest_first_and_end_on_cycles(spark):
    deps = spark.createDataFrame([("r", 0, "b"), ("r", 1, "a"), ("b", 0, "d"), ("a", 0, "c"), ("a", 1, "d"), ("d", 0, "r"), ("d", 1, "b"), ("c", 0, "e")], EDGES)
    got = {(r["root"], r["pkg"]): r["place"] for r in reach.dependency_order(deps, spark.createDataFrame([("r",), ("c",), ("lone",)], "pkg string")).collect()}
    assert got == {("r", "b"): 1, ("r", "a"): 2, ("r", "d"): 3, ("r", "c"): 4, ("r", "e"): 5, ("c", "e"): 1}


def probe(spark, asks, order, modules, local, owners, plan, fetchable):
    calls = []
    held = spark.createDataFrame(modules, "pkg string, module string")

    def index_of(pkgs):
        calls.append(sorted(r["pkg"] for r in pkgs.collect()))
        return held.join(pkgs, "pkg", "left_semi")

    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    answers, gaps = reach.probed_modules(
        frame(asks, "root string, module string"), frame(order, "root string, pkg string, place int"), index_of, frame(local, "pkg string, has_list boolean"),
        frame(owners, "module string, pkg string, pos int"), frame([(p,) for p in plan], "pkg string"), frame([(p,) for p in fetchable], "pkg string"),
    )
    return {(r["root"], r["module"]): (r["pkg"], r["place"], r["how"], r["touched"]) for r in answers.collect()}, sorted((tuple(r) for r in gaps.collect()), key=str), calls


def test_each_dependency_is_indexed_once_and_no_sooner_than_needed(spark):
    order = [("r", f"p{i}", i) for i in range(1, 10)] + [("s", "p2", 1), ("s", "p1", 2)]
    modules = [("p1", "A"), ("p2", "A"), ("p3", "B"), ("p9", "Far")]
    local = [(f"p{i}", True) for i in range(1, 10)]
    answers, gaps, calls = probe(spark, [("r", "A"), ("r", "B"), ("s", "A")], order, modules, local, [], ["r", "s"], [])
    assert answers == {("r", "A"): ("p1", 1, "dependency", 1), ("r", "B"): ("p3", 3, "dependency", 3), ("s", "A"): ("p2", 1, "dependency", 1)}
    assert gaps == [] and sorted(sum(calls, [])) == ["p1", "p2", "p3"]  # p4 to p9 were never asked
    answers, _, calls = probe(spark, [("r", "Far"), ("r", "None")], order, modules, local, [], ["r"], [])
    assert answers == {("r", "Far"): ("p9", 9, "dependency", 9), ("r", "None"): (None, None, None, 9)}
    assert sorted(sum(calls, [])) == [f"p{i}" for i in range(1, 10)]


def test_owners_are_asked_last_and_gaps_say_what_was_missing(spark):
    order = [("r", "p1", 1), ("r", "gone", 2), ("r", "bare", 3)]
    modules = [("p1", "A"), ("own", "O"), ("own", "Also"), ("late", "L")]
    owners = [("O", "other", 0), ("O", "own", 1), ("L", "late", 0), ("A", "own", 0), ("X", "other", 0)]
    answers, gaps, calls = probe(spark, [("r", m) for m in ("A", "O", "Also", "L", "X", "Q")] + [("new", "A")], order, modules, [("p1", True), ("bare", False)], owners, ["r", "p1", "own", "late"], ["own", "p1"])
    assert answers["r", "A"] == ("p1", 1, "dependency", 1)
    assert answers["r", "O"] == ("own", None, "owner", 3) and answers["r", "Also"] == ("own", None, "owner", 3)
    assert [answers["r", m] for m in ("L", "X", "Q")] == [(None, None, None, 3)] * 3 and answers["new", "A"] == (None, None, None, 0)
    assert gaps == sorted([
        ("r", "no_local_source", "gone", None), ("r", "no_module_list", "bare", None), ("new", "unit_not_in_plan", "new", None), ("r", "owner_unfetchable", "late", "L"),
        ("r", "owner_unaskable", None, "Also"), ("r", "owner_unaskable", None, "Q"),
    ], key=str)
    assert calls[-1] == ["own"] and "gone" not in sum(calls, [])
    empty = probe(spark, [], [], [], [], [], [], [])
    assert empty[0] == {} and empty[1] == []


# -- chains ----------------------------------------------------------------------------------


def chains(spark, *cases, hops=3, budget=64):
    """Of each case a symbol ``x`` of M0, followed over (imports, declaring modules, what else is
    special) with imports of (module, target, explicit)."""
    three = "component string, module string, name string"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    full = [(str(i), imports, decls, (more or [{}])[0]) for i, (imports, decls, *more) in enumerate(cases)]
    modules = [(c, m, more) for c, imports, decls, more in full for m in {m for a, b, _ in imports for m in (a, b)} | set(decls)]
    but = lambda kind: [(c, m) for c, m, more in modules if m not in more.get(kind, ())]
    asks = frame([(c, "M0", "x") for c, *_ in full], three)
    edges = frame([(c, a, "x", b, e) for c, imports, *_ in full for a, b, e in imports], f"{three}, target string, explicit boolean")
    starts = cascade.outside_candidates(asks, edges, keys=("component", "module", "name"))
    out = reach.chained_searches(
        asks, starts, frame([(c, m, c) for c, m in but("unreachable")], "component string, target string, home string"), frame(but("unreadable"), "component string, module string"),
        frame([(c, m, "x") for c, _, decls, _ in full for m in decls], three), frame([(c, m, "x") for c, m in but("private")], three), edges, hops, budget,
    ).collect()
    assert len(out) == len(cases)
    return [tuple(r[c] for c in ("definer", "hop", "failure", "candidates", "frontier")) for r in sorted(out, key=lambda r: int(r["component"]))]


LINE = [("M0", "A", False), ("A", "B", False), ("B", "C", False), ("C", "D", False)]
WIDE = [("M0", f"W{i}", False) for i in range(6)] + [("W5", "End", False)]


def test_chains_find_the_nearest_definition_in_order(spark):
    tree = [("M0", "B", False), ("M0", "A", False), ("M0", "E", True), ("E", "E1", False), ("A", "A1", True), ("B", "B1", True), ("A1", "End", False)]
    assert chains(
        spark,
        (tree, ["A", "B"]),  # open ones by name
        (tree, ["A", "E"]),  # explicit ones first
        (tree, ["B1", "E1"]),  # an explicit child of the last parent before an open one of the first
        (tree, ["A1", "B1"]),  # parents in their order
        (tree, ["A", "A1"], {"private": ["A"]}),  # declared and not exported is no answer
        ([("M0", "A", False), ("A", "M0", False), ("A", "A", False)], []),  # M0 is a candidate of A, once
        (LINE, ["D"]), (LINE[:3], []),  # the second ends just at the limit
        (LINE, ["D"], {"unreachable": ["B"]}),
    ) == [
        ("A", 1, None, None, None), ("E", 1, None, None, None), ("B1", 2, None, None, None), ("A1", 2, None, None, None), ("A1", 2, None, None, None), (None, 2, "no_supplier", ["A"], None),
        (None, 3, "hop_limit", None, ["D"]), (None, 3, "no_supplier", ["A"], None), (None, 2, "no_supplier", ["A"], None),
    ]


def test_chains_say_what_stopped_them(spark):
    assert chains(spark, (LINE, ["D"]), hops=4)[0][:2] == ("D", 4)
    assert chains(spark, ([("M0", "A", False)], ["A"]), hops=0)[0][2:] == ("hop_limit", None, ["A"])
    cheap = chains(
        spark, (LINE, ["D"]), (WIDE, ["W2"]), (WIDE, ["W3"]),
        (WIDE, ["W3"], {"unreachable": ["W0"]}),  # what cannot be reached costs nothing
        (WIDE, ["W3"], {"unreadable": ["W0"]}),  # what cannot be parsed does
        hops=9, budget=3,
    )
    assert [(c[0], c[2]) for c in cheap] == [(None, "parse_budget"), ("W2", None), (None, "parse_budget"), ("W3", None), (None, "parse_budget")]


def test_every_failure_has_its_verdict_and_actions(spark):
    three = "component string, module string, name string"
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    asks = [("c", "Here", "x"), ("c", "Here", "no"), ("c", "Stale", "x"), ("c", "Broken", "x"), ("c", "Lost", "x"), ("c", "Typo", "x"), ("d", "Any", "x"), ("d", "Any", "y"), ("c", "Out", "x"), ("c", "Out", "x"), ("e", "Out", "x")]
    sites = [("c", "Here", "x", "Here"), ("c", "Stale", "x", "Here2"), ("c", "Broken", "x", "Here"), ("c", "Lost", "x", "Gone"), ("c", "Out", "x", None), ("e", "Out", "x", None)]
    modules = [("c", m) for m in ("Here", "Here2", "Stale", "Lost", "Out")] + [("d", "Deep.Any"), ("e", "Out")]
    out = reach.searched_symbols(
        frame(asks, three), frame([("c", "/c", True), ("d", "/d", False), ("e", "/e", True)], "component string, directory string, readable boolean"),
        frame([(c, m) for c, m, _ in asks if m != "Typo" and c != "d"], "component string, module string"), frame(modules, "component string, module string"), frame(modules, "component string, module string"),
        frame(sites, f"{three}, definer string"), frame([("c", "Here", "x"), ("d", "Deep.Any", "x")], three), frame([("c", "Here", "x")], three),
        frame([("c", "Out", "x", "Far", True), ("e", "Out", "x", "Far", True)], f"{three}, target string, explicit boolean"), frame([("c", "Far", "f")], "component string, target string, home string"),
        frame([("e", "p-1 has no source"), ("e", "a gap")], "component string, gap string"),
    )
    got = {(r["component"], r["module"], r["name"]): r for r in out.withColumn("actions", F.to_json(reach.search_actions())).collect()}
    said = {k: (r["definer"], r["failure"], r["resolved_to"], r["verdict"]) for k, r in got.items()}
    assert said == {
        ("c", "Here", "x"): ("Here", None, None, "found"), ("c", "Here", "no"): (None, "not_exported", None, "exhausted"), ("c", "Stale", "x"): (None, "not_declared", "Here2", "exhausted"),
        ("c", "Broken", "x"): (None, "module_unparsed", "Broken", "exhausted"), ("c", "Lost", "x"): (None, "module_unparsed", "Gone", "exhausted"), ("c", "Typo", "x"): (None, "module_absent", None, "module_absent"),
        ("d", "Any", "x"): ("Deep.Any", None, None, "found"), ("d", "Any", "y"): (None, "swept_package", None, "exhausted"), ("c", "Out", "x"): (None, "no_supplier", None, "exhausted"), ("e", "Out", "x"): (None, "no_supplier", None, "blocked"),
    }
    assert json.loads(got["e", "Out", "x"]["actions"]) == {"package": "e", "module": "Out", "symbol": "x", "search": "blocked", "candidates_considered": "Far", "unreadable_dependencies": "a gap; p-1 has no source"}
    assert json.loads(got["d", "Any", "y"]["actions"])["scanned"] == "/d" and got["c", "Here", "x"]["actions"] == "{}"
