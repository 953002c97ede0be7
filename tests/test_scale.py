"""What keeps plans from growing faster than their input: no side is sent to the driver, no join meets
pairs one by one, rounds are few."""

import re

import pytest
from pyspark.sql import functions as F

from symbolarium.functions import ident
from symbolarium.operators import declarations, graph, reach, resolve, signatures
from symbolarium.sources import packages


@pytest.fixture
def plans(monkeypatch):
    """Optimized and physical plans of all that an operator cuts."""
    seen = []
    for module in (reach, resolve):
        real = module.cut

        def noted(df, real=real):
            seen.append((optimized(df), physical(df)))
            return real(df)

        monkeypatch.setattr(module, "cut", noted)
    return seen


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def interfaces(spark):
    exported = spark.createDataFrame([(m, "f") for m in "ABC"], "module string, name string")
    decls = spark.createDataFrame([("C", "f")], "module string, name string")
    imports = spark.createDataFrame([("A", "f", "B", False), ("B", "f", "C", True)], "module string, name string, target string, explicit boolean")
    return exported, decls, imports


def test_chains_broadcast_nothing(spark, plans):
    exported, decls, imports = interfaces(spark)
    out = resolve.followed_chain(exported, decls, exported, imports)
    assert {r["module"]: (r["definer"], r["hop"]) for r in out.collect()} == {"A": ("C", 2), "B": ("C", 1), "C": ("C", 0)}
    assert not any("Broadcast" in p for _, p in plans) and "Broadcast" not in physical(out)


def test_exports_are_one_an_item_before_they_are_joined(spark):
    exports = spark.createDataFrame([("M", i, "module", "N") for i in range(9)] + [("N", i, "symbol", "g") for i in range(9)] + [("M", 20, "all", "T"), ("M", 19, "all", "T")], "module string, pos int, form string, item string")
    decls = spark.createDataFrame([("M", "C1", "T"), ("M", "C1", "T")], "module string, name string, parent string")
    out = resolve.expanded_exports(exports, decls)
    assert sorted(map(tuple, out.collect())) == [("M", "C1", 19), ("M", "T", 19), ("M", "g", 0), ("N", "g", 0)]
    joins = [d for d in re.split(r"Join Inner", optimized(out))[1:]]
    assert len(joins) == 2 and all("Aggregate" in j for j in joins)


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_files_are_those_that_share_most(spark, seed):
    spots = ["A.hs", "x/A.hs", "y/A.hs", "y/x/A.hs", "B.hs", "x/B.hs", "", "/A.hs"][seed % 2 :]
    asks = spark.createDataFrame([("p", "f", w) for w in spots], "package string, name string, wanted string")
    files = spark.createDataFrame([("p", "f", w, i) for i, w in enumerate(spots[::2] * 2)], "package string, name string, path string, line int")
    each = asks.join(files, ["package", "name"]).withColumn("far", -ident.shared_trailing(F.col("path"), F.col("wanted")))
    want = each.groupBy("wanted").agg(F.min(F.struct("far", "path", "line")).alias("x")).select("wanted", "x.path", "x.line")
    out = declarations.swept(asks, files)
    assert sorted(map(tuple, out.select("wanted", "path", "line").collect())) == sorted(map(tuple, want.collect()))
    assert all("tail" in c for c in re.findall(r"Join Inner, (.*)", optimized(out)))


def test_probes_meet_packages_before_modules(spark, plans):
    row = lambda rows, schema: spark.createDataFrame(rows, schema)
    asks = row([("a", "M"), ("b", "M"), ("b", "N")], "root string, module string")
    order = row([("a", "p", 1), ("b", "q", 1), ("b", "p", 2)], "root string, pkg string, place int")
    has = row([("p", "M"), ("q", "M"), ("q", "O")], "pkg string, module string")
    local = row([("p", True), ("q", True)], "pkg string, has_list boolean")
    owners = row([("N", "z", 0)], "module string, pkg string, pos int")
    pkgs = row([("z",), ("a",), ("b",)], "pkg string")
    found, _ = reach.probed_modules(asks, order, lambda p: has.join(p, "pkg", "left_semi"), local, owners, pkgs, pkgs)
    assert {(r["root"], r["module"]): (r["pkg"], r["place"]) for r in found.collect()} == {("a", "M"): ("p", 1), ("b", "M"): ("q", 1), ("b", "N"): (None, None)}
    assert all("root" in c or "pkg" in c or "owner" in c for p, _ in plans for c in re.findall(r"Join Inner, (.*)", p))


def test_long_chains_take_few_rounds(spark, plans):
    deps = spark.createDataFrame([(i, 0, i + 1) for i in range(70)] + [(70, 0, 0)], "pkg int, pos int, dep_pkg int")
    out = reach.dependency_order(deps, spark.createDataFrame([(3,)], "pkg int"))
    assert [r["pkg"] for r in out.orderBy("place").collect()] == [*range(4, 71), 0, 1, 2]
    assert len(plans) <= 9


def test_signatures_are_matched_by_their_lists_of_parts(spark):
    rows = spark.createDataFrame([("c", "M", f"f{i:02}", f"f{i:02} :: Int -> Bool") for i in range(30)], "component string, module string, name string, signature string")
    out = signatures.signature_matches(spark.createDataFrame([("Int -> Bool",)], "query string"), signatures.signature_index(rows), limit=3)
    assert sorted((r["rank"], r["name"]) for r in out.collect()) == [(1, "f00"), (2, "f01"), (3, "f02")]
    assert len(re.findall(r"Window \[row_number\(\) windowspecdefinition\(parts", optimized(out))) == 1


def test_extensions_keep_one_row_a_module_and_flag(spark, monkeypatch):
    real, sizes = packages.cut, []

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(packages, "cut", counted)
    settings = spark.createDataFrame([("M", i, f"e{i:02}", True) for i in range(12)] + [("M", 12, "e05", False), ("M", 13, "e12", False)], "module string, pos int, flag string, state boolean")
    implied = spark.createDataFrame([(f"e{i:02}", f"e{i + 1:02}", True) for i in range(11)] + [("e11", "e12", True), ("e11", "e03", False), ("e04", "e00", True)], "flag string, implied string, state boolean")
    out = packages.applied_extensions(settings, implied)
    assert sorted(r["flag"] for r in out.collect()) == ["e00", "e01", "e02", "e04", "e06", "e07", "e08", "e09", "e10", "e11"]
    assert max(sizes) <= 30  # pairs of a setting and what it reaches are 100


def test_levels_broadcast_nothing(spark, monkeypatch):
    real, seen = graph.cut, []
    monkeypatch.setattr(graph, "cut", lambda df: (seen.append(physical(df)), real(df))[1])
    deps = spark.createDataFrame([("a", "b"), ("b", "c")], "pkg string, dep_pkg string")
    out = graph.levels(deps, spark.createDataFrame([("a",), ("b",), ("c",)], "pkg string"))
    assert {r["pkg"]: r["level"] for r in out.collect()} == {"c": 0, "b": 1, "a": 2}
    assert not any("Broadcast" in p for p in seen)
