"""Package sources, declarations and index building, by cases."""

from pyspark.sql import functions as F

from symbolarium.operators import declarations as D
from symbolarium.plans import build_plan, index_build
from symbolarium.sources import packages as P

DESCRIPTION = """
name:          demo
version:       1.0
library
  hs-source-dirs: src
  exposed-modules: Demo
                   Demo.Extra
  if os(linux)
    other-modules: Demo.Linux
  else
    other-modules: Demo.Other
  if impl(ghc > 9)
    other-modules: Demo.New
  else
    other-modules: Demo.Old
  -- exposed-modules: Not.This
library extra
  exposed-modules: Sub
executable run
  hs-source-dirs: app, shared
  other-modules: Main.Util
"""


def test_descriptions(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "demo.cabal").write_text(DESCRIPTION)
    (tmp_path / "broken.cabal").write_text("library\n  exposed-modules: X\n")
    every = P.read_components(spark, str(tmp_path))
    fields = P.live_fields(every, "linux", "x86_64")
    assert [(r["path"].rsplit("/", 1)[1], r["error"]) for r in P.component_report(every, "linux", "x86_64")["errors"].collect()] == [("broken.cabal", "no package name")]
    nested = P.description_fields("name: n\nlibrary\n  if os(linux)\n    if flag(x)\n      other-modules: A\n    else\n      other-modules: B\n")
    assert [(f[4], f[6]) for f in nested] == [("(os(linux)) && (flag(x))", "A"), ("(os(linux)) && !(flag(x))", "B")]
    got = {(r["component"], r["module"], r["visibility"]) for r in P.component_modules(fields).collect()}
    assert got == {
        ("demo", "Demo", "exposed"), ("demo", "Demo.Extra", "exposed"), ("demo", "Demo.Linux", "internal"), ("demo", "Demo.New", "internal"),
        ("demo", "Demo.Old", "internal"), ("demo:extra", "Sub", "exposed"), ("demo:exe:run", "Main.Util", "internal"),
    }
    assert {r["value"] for r in fields.where("list = 'hs-source-dirs' AND kind = 'exe'").collect()} == {"app", "shared"}
    assert P.exposed_modules(fields).first()["modules"] == ["Demo", "Demo.Extra", "Sub"]


def test_conditions_are_three_valued(spark):
    cases = {"os(linux)": True, "!os(linux)": False, "flag(x)": None, "os(linux) && flag(x)": None, "os(osx) && flag(x)": False, "os(linux) || flag(x)": True, "arch(X86_64)": True, "false": False}
    rows = spark.createDataFrame([(c,) for c in cases], "cond string")
    assert {r["cond"]: r["v"] for r in rows.withColumn("v", P.condition_value(F.col("cond"), "linux", "x86_64")).collect()} == cases


def test_source_files(spark, tmp_path):
    for name in ("src/A/B.hs", "src/dist/C.hs", "src/tests/T.hs", "src/.hid/H.hs", "Setup/S.hs", "src/L.lhs", "d1/d2/d3/d4/d5/Deep.hs", "note.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"module X \xff where")
    got = build_plan.source_files(spark, str(tmp_path)).collect()
    assert [r["relative"] for r in got] == ["src/A/B.hs"] and got[0]["content"] == "module X � where"


def test_files_of_modules(spark):
    files = spark.createDataFrame([("p", "A/B.hs"), ("p", "lib/A/B.hs"), ("p", "src/C.hs"), ("p", "x/y/C.hs"), ("q", "deep/er/D.hs"), ("q", "deep/D.hs")], "package string, relative string")
    asks = spark.createDataFrame([("p", "A.B"), ("p", "C"), ("q", "D"), ("q", "None")], "package string, module string")
    assert {(r["module"], r["relative"]) for r in P.module_file(files, asks).collect()} == {("A.B", "A/B.hs"), ("C", "src/C.hs"), ("D", "deep/D.hs")}
    assert {r["relative"] for r in P.source_roots(files).collect()} == {"lib/A/B.hs", "src/C.hs", "deep/er/D.hs", "deep/D.hs"}
    stanzas = spark.createDataFrame([("c", "M", "internal")], "component string, module string, visibility string")
    walked = spark.createDataFrame([("c", "N"), ("d", "O")], "component string, module string")
    assert sorted(tuple(r) for r in P.with_walked(stanzas, walked).collect()) == [("c", "M", "internal"), ("d", "O", "exposed")]


def test_environments(spark):
    entries = spark.createDataFrame([("foo-1.2-0123456789abcdef",), ("foo-1.2-aaaaaaaaaa",), ("bar-baz-0.1",), ("package.db",)], "entry string")
    assert [tuple(r) for r in P.installed_packages(entries).collect()] == [("foo", "1.2")]
    files = spark.createDataFrame([("a.conf", "name: x\nversion: 1.0\n"), ("b.conf", "junk")], "path string, value string")
    profile = P.profile_packages(files)
    assert [tuple(r) for r in profile.collect()] == [("x", "1.0")] and P.synthetic_plan(profile).first()["unit_id"] == "unpinned:x-1.0"
    assert P.store_prefix(entries, spark.createDataFrame([("foo", "1.2")], "name string, version string")).count() == 2
    checkouts = spark.createDataFrame([("p", "a", "h1", "h2", 9), ("p", "b", "h2", "h2", 1), ("q", "c", None, "h", 1), ("q", "d", None, "h", 2)], "package string, path string, head string, wanted string, mtime int")
    assert {r["path"] for r in P.picked_checkouts(checkouts).collect()} == {"b", "d"}
    repos = spark.createDataFrame([("r1", "ref: refs/heads/m"), ("r2", "ref: refs/heads/p"), ("r3", "abc\n")], "path string, head string")
    ref = "path string, ref string, commit string"
    got = P.head_commits(repos, spark.createDataFrame([("r1", "refs/heads/m", "1")], ref), spark.createDataFrame([("r1", "refs/heads/m", "0"), ("r2", "refs/heads/p", "2")], ref))
    assert {r["path"]: r["commit"] for r in got.collect()} == {"r1": "1", "r2": "2", "r3": "abc"}
    tars = spark.createDataFrame([(1, "/r1/a/1.0/a-1.0.tar.gz"), (0, "/r0/a/1.0/a-1.0.tar.gz"), (0, "/r0/a/1.0/b-1.0.tar.gz")], "repo_pos int, path string")
    assert [tuple(r) for r in P.found_tarballs(tars).collect()] == [("a", "1.0", "/r0/a/1.0/a-1.0.tar.gz")]


def test_response_cache(spark):
    cache = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, stored_at int, body string")
    asks = spark.createDataFrame([("k",), ("z",)], "key string")
    assert {r["key"]: (r["body"], r["error"]) for r in P.offline_answers(asks, cache).collect()} == {"k": ("new", None), "z": (None, "OFFLINE")}
    bodies = spark.createDataFrame([("a", '[{"package":{"name":"p"},"item":"f"}]'), ("b", "{oops")], "key string, body string")
    got = {r["key"]: (r["pkg"], r["mod"], r["item"], r["error"]) for r in P.decoded_hits(bodies).collect()}
    assert got == {"a": ("p", "", "f", None), "b": ("", "", "", "CORRUPT")}


def test_macros_and_flags(spark):
    deps = spark.createDataFrame([("c", "my-dep", "1.2"), ("c", "base", "4.19.0.1")], "component string, name string, version string")
    header = P.macro_headers(deps).first()["header"].split("\n")
    assert header[1:3] == ["/* package base-4.19.0.1 */", '#define VERSION_base "4.19.0.1"'] and header[-2] == "  (major1) == 1 && (major2) == 2 && (minor) <= 0)"
    implied = spark.createDataFrame([("A", "B", True), ("B", "C", True), ("C", "A", True), ("B", "D", False)], "flag string, implied string, state boolean")
    assert {r["flag"]: r["on"] for r in P.implied_flags(implied, spark.createDataFrame([("A",)], "flag string")).collect()} == {"A": True, "B": True, "C": True, "D": False}
    settings = [("m", 0, "A", True), ("m", 1, "C", False), ("n", 0, "D", True), ("n", 1, "B", True), ("o", 0, "B", True), ("o", 1, "D", True)]
    on = P.applied_extensions(spark.createDataFrame(settings, "module string, pos int, flag string, state boolean"), implied)
    assert sorted(tuple(r) for r in on.collect()) == [("m", "A"), ("m", "B"), ("n", "A"), ("n", "B"), ("n", "C"), ("o", "A"), ("o", "B"), ("o", "C"), ("o", "D")]
    kinds = spark.createDataFrame([("L",), ("X",), ("NoX",), ("Safe",), ("Q",)], "f string").select("f", P.flag_kind(F.col("f"), ["L"], ["X"], ["Safe"]).alias("k"))
    assert {r["f"]: r["k"] for r in kinds.collect()} == {"L": "language", "X": "extension", "NoX": "negated", "Safe": "ignorable", "Q": "unknown"}


def test_comments_attach(spark):
    rows = [("M", 0, "doc_next", "a", True), ("M", 1, "doc_next", "b", True), ("M", 2, "decl", "f", True), ("M", 3, "decl", "inner", False), ("M", 4, "doc_prev", "c", True), ("M", 5, "decl", "g", True), ("M", 6, "doc_next", "lost", True)]
    items = spark.createDataFrame(rows, "module string, pos int, kind string, text string, top boolean")
    assert {r["name"]: r["doc"] for r in D.documented(items).collect()} == {"f": "a\nb\nc", "inner": None, "g": None}


DECL = "component string, module string, name string, parent string, kind string, signature string, doc string, pos int, sig_line int, sig_end int, def_line int, def_end int, doc_line int, doc_end int"


def test_pieces_merge(spark):
    rows = [("c", "M", "f", None, "type_signature", "f :: Int", "doc", 0, 3, 3, None, None, 1, 2), ("c", "M", "f", None, "value", None, None, 1, None, None, 4, 6, None, None), ("c", "M", "T", None, "data", None, None, 2, None, None, 9, 9, None, None), ("c", "M", "T", "T", "constructor", None, None, 3, None, None, 9, 9, None, None)]
    got = {(r["name"], r["parent"]): r for r in D.merged(spark.createDataFrame(rows, DECL)).collect()}
    f = got["f", None]
    assert (f["kind"], f["signature"], f["doc"], f["first_line"], f["last_line"]) == ("type_signature", "f :: Int", "doc", 1, 6) and len(got) == 3
    assert [tuple(r) for r in D.members(spark.createDataFrame(rows, DECL)).collect()] == [("M", "T", ["T"])]


def test_candidates_and_sweeps(spark):
    asks = spark.createDataFrame([("A.B.C", "f", [("Z", "open"), ("A.B.X", "open"), ("A.Q", "explicit"), ("A.B.X", "explicit"), ("Z", "open")])], "module string, name string, candidates array<struct<target:string,how:string>>")
    assert D.ranked_candidates(asks).first()["targets"] == ["A.B.X", "A.Q", "Z"]
    decls = spark.createDataFrame([("p", "x/A/B.hs", "f", 3), ("p", "x/Other.hs", "f", 1), ("p", "x/A/B.hs", "g", 9)], "package string, path string, name string, line int")
    assert D.swept(spark.createDataFrame([("p", "f", "src/A/B.hs")], "package string, name string, wanted string"), decls).first()["path"] == "x/A/B.hs"
    interfaces = spark.createDataFrame([("M", None, ["a", "b"]), ("N", [], ["c"])], "module string, exports array<string>, declared array<string>")
    assert sorted(tuple(r) for r in D.exported_names(interfaces).collect()) == [("M", "a"), ("M", "b")]
    imports = spark.createDataFrame([(None, None), (["f"], False), (["g"], False), (["g"], True), (["f"], True)], "names array<string>, hiding boolean")
    assert [r[0] for r in imports.select(D.could_import(F.col("names"), F.col("hiding"), F.lit("f"))).collect()] == ["open", "explicit", None, "open", None]
    names = spark.createDataFrame([("M", x) for x in "abc"], "module string, name string")
    one = lambda n: spark.createDataFrame([("M", n, f"{n} :: T")], "module string, name string, signature string")
    assert {r["name"]: r["origin"] for r in D.entries(names, one("a"), one("b")).collect()} == {"a": "index", "b": "import", "c": "placeholder"}


def test_facades_resolve_across_packages(spark):
    exported = spark.createDataFrame([("dep", "D.Facade", "x", "exposed"), ("dep", "D.Internal", "x", "internal"), ("top", "T", "x", "exposed"), ("top", "T", "lost", "exposed")], "component string, module string, name string, visibility string")
    decls = spark.createDataFrame([("dep", "D.Internal", "x", [], 1, "value", "x :: Int")], "component string, module string, name string, siblings array<string>, pos int, kind string, signature string")
    imports = spark.createDataFrame([("dep", "D.Facade", "x", "D.Internal", False), ("top", "T", "x", "D.Facade", False), ("top", "T", "lost", "D.Facade", False)], "component string, module string, name string, target string, explicit boolean")
    deps = spark.createDataFrame([("top", 0, "dep")], "pkg string, pos int, dep_pkg string")
    left = []

    def build(level, below):
        own = lambda rows: rows.join(level.withColumnRenamed("pkg", "component"), "component", "left_semi")
        known = below if below is not None else spark.createDataFrame([], "component string, module string, name string, signature string, def_component string, def_module string, visibility string")
        rows, unresolved = index_build.component_index(own(exported), own(decls), own(imports), known.select("module", "name", F.col("component").alias("presenter"), "def_component", "def_module"), deps)
        left.extend(tuple(r) for r in unresolved.collect())
        return rows

    rows = index_build.build_levels(deps, spark.createDataFrame([("dep",), ("top",)], "pkg string"), build)
    got = {(r["component"], r["module"], r["name"]): (r["def_component"], r["def_module"], r["signature"]) for r in rows.collect()}
    assert got == {("dep", "D.Facade", "x"): ("dep", "D.Internal", "x :: Int"), ("dep", "D.Internal", "x"): ("dep", "D.Internal", "x :: Int"), ("top", "T", "x"): ("dep", "D.Internal", "")}
    assert left == [("top", "T", "lost")]
    project, whole = index_build.routed(rows.withColumnRenamed("component", "pkg"), spark.createDataFrame([("top", True), ("dep", False)], "pkg string, is_local boolean"), True)
    assert project.count() == 1 and whole.count() == 2


def test_plan_shapes(spark):
    units = spark.createDataFrame([("p", "local", True), ("q", "hackage", False), ("r", "hackage", False)], "pkg string, origin string, is_local boolean")
    assert tuple(build_plan.plan_counts(units).first()) == (1, 2, 3)
    listing = build_plan.component_listing(units, spark.createDataFrame([("p", "p"), ("p", "p:exe:x")], "pkg string, component string"))
    assert sorted((r["pkg"], r["component"]) for r in listing.collect()) == [("p", "p"), ("p", "p:exe:x"), ("q", "q"), ("r", "r")]
    parts = spark.createDataFrame([("a", "lib"), ("b", "lib"), ("c", "exe")], "component string, kind string")
    dirs = "component string, dirs array<string>"
    got = build_plan.source_directories(parts, spark.createDataFrame([("a", ["x"])], dirs), spark.createDataFrame([("a", ["src"]), ("b", ["src"]), ("c", ["src"])], dirs))
    assert {r["component"]: r["dirs"] for r in got.collect()} == {"a": ["x"], "b": ["src"], "c": None}
    hints = spark.range(1).select(build_plan.action_hints(F.array(*(F.struct(F.lit(x).alias("label"), F.lit(x).alias("command")) for x in "abcdefg"))).alias("m")).first()["m"]
    assert list(hints) == list("abcde")
    old = spark.createDataFrame([("x", 7), ("y", 6), ("z", None)], "n string, generation int")
    assert [r["n"] for r in build_plan.generation_guarded(old, 7).collect()] == ["x"]


def test_module_files_near_and_open_folders_first(spark):
    files = {
        "a": ["x/M.hs", "M.hs"], "b": ["lib/M.hs", "library/M.hs", "zz/M.hs"], "c": ["a/b/M.hs", "z/M.hs"], "d": ["a/b/c/M.hs", "b/c/M.hs"], "e": ["1/2/3/4/M.hs"], "f": ["1/2/3/4/5/M.hs"],
        "g": ["test/M.hs", "x/build/M.hs", ".git/M.hs", "dist/src/M.hs"], "h": ["src/deep/M.hs", "tests/M.hs"], "i": ["xM.hs", "M/M.hs/x"], "j": ["b/x/M.hs", "b/a/M.hs"],
    }
    rows = spark.createDataFrame([(p, f) for p, fs in files.items() for f in fs], "package string, relative string")
    got = P.module_file(rows, spark.createDataFrame([(p, "M") for p in files], "package string, module string")).collect()
    assert {r["package"]: r["relative"] for r in got} == {"a": "M.hs", "b": "library/M.hs", "c": "z/M.hs", "d": "a/b/c/M.hs", "e": "1/2/3/4/M.hs", "h": "src/deep/M.hs", "j": "b/a/M.hs"}
    deep = spark.createDataFrame([("p", "src/A/B.hs"), ("p", "x/A/B.hs")], "package string, relative string")
    assert P.module_file(deep, spark.createDataFrame([("p", "A.B"), ("p", "B")], "package string, module string")).collect()[0]["relative"] == "src/A/B.hs"


def test_an_empty_folder_ends_the_search_for_documents(spark):
    at = lambda *rows: spark.createDataFrame(list(rows), "pkg string, index string")
    asks = spark.createDataFrame([(p,) for p in "abcde"], "pkg string")
    got = P.document_places(asks, at(("a", "ca"), ("b", None)), at(("b", "bb"), ("c", "bc"), ("d", None)), at(("b", "eb"), ("d", "ed")))
    assert {r["pkg"]: tuple(r)[1:] for r in got.collect()} == {"a": ("ca", "cache", "found"), "b": (None, "cache", "empty"), "c": ("bc", "build", "found"), "d": ("ed", "environment", "found"), "e": (None, None, "absent")}
    units = spark.createDataFrame([("s", False), ("d", False), ("l", True), ("m", True), ("n", True), ("x", False)], "pkg string, is_local boolean")
    path = lambda *rows: spark.createDataFrame(list(rows), "pkg string, path string")
    made = spark.createDataFrame([("l", "gl", None), ("m", None, "tool failed"), ("x", "gx", None)], "pkg string, path string, error string")
    got = P.collection_places(units, path(("s", "ss")), path(("s", "ds"), ("d", "dd")), made)
    assert {r["pkg"]: tuple(r)[1:] for r in got.collect()} == {
        "s": ("ss", "store", None), "d": ("dd", "distribution", None), "l": ("gl", "generated", None), "m": (None, None, "tool failed"), "n": (None, None, "not_generated"), "x": (None, None, "no_store_entry")}
