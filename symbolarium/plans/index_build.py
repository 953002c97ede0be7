"""Building the index: levels of components, dependencies first, each level one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.operators import graph, resolve
from symbolarium.operators.declarations import found_declarations
from symbolarium.plans.lineage import cut


def component_index(exported: DataFrame, decls: DataFrame, imports: DataFrame, exports: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows of components, and the names left over.

    ``exported(component, module, name, visibility)`` resolve within their component first;
    what no module of it supplies is probed in ``exports`` of the packages it depends on,
    candidates in the order of its imports; if ``exports`` has signatures, rows take theirs, and if
    it has generations (``resolve.extended_exports``), the latest decides between modules of one
    component. Modules of different components never mix.
    """
    key = lambda c, m: F.concat(F.col(c), F.lit("\0"), F.col(m))
    sites = resolve.resolve_exports(
        exported.select(key("component", "module").alias("module"), "name"), decls.select(key("component", "module").alias("module"), "name"),
        imports.select(key("component", "module").alias("module"), "name", key("component", "target").alias("target"), "explicit"),
    )
    sites = sites.select(F.split("module", "\0").alias("at"), "name", F.split("definer", "\0").alias("home"))
    sites = cut(sites.select(F.col("at")[0].alias("component"), F.col("at")[1].alias("module"), "name", F.col("home")[1].alias("def_module")))
    seen = exported.select("component", "module", "name", "visibility")
    inside = sites.where("def_module IS NOT NULL").withColumn("def_component", F.col("component"))
    homes = inside.select(F.col("def_component").alias("component"), F.col("def_module").alias("module"), "name").distinct()
    signed = found_declarations(homes, decls).select(F.col("component").alias("def_component"), F.col("module").alias("def_module"), "name", "signature")
    rows = inside.join(signed, ["def_component", "def_module", "name"], "left")

    wanted = sites.where("def_module IS NULL").select("component", "module", "name")
    order = F.struct((~F.col("explicit")).alias("open"), F.col("target").alias("target"))
    options = wanted.join(imports, ["component", "module", "name"]).groupBy("component", "module", "name").agg(F.transform(F.array_sort(F.collect_set(order)), lambda x: x["target"]).alias("candidates"))
    found = resolve.probe_candidates(options.select(F.col("component").alias("asker"), "module", "name", "candidates"), exports, deps)
    outside = found.select(F.col("asker").alias("component"), "module", "name", F.col("chosen.def_component").alias("def_component"), F.col("chosen.def_module").alias("def_module"))
    signs = exports.groupBy("def_component", "def_module", "name").agg(F.min("signature").alias("signature")) if "signature" in exports.columns else None
    outside = outside.withColumn("signature", F.lit("")) if signs is None else outside.join(signs, ["def_component", "def_module", "name"], "left")
    unresolved = wanted.join(outside.select("component", "module", "name"), ["component", "module", "name"], "left_anti")
    columns = ["component", "module", "name", "signature", "def_component", "def_module"]
    out = rows.select(*columns).unionByName(outside.select(*columns)).join(seen, ["component", "module", "name"])
    return out.select(*columns, "visibility"), unresolved


def build_levels(deps: DataFrame, components: DataFrame, build: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """Run ``build(components of a level, rows of lower levels)`` level by level.

    All components of a level are built by one plan in parallel; the next sees their rows. Without
    any component, ``build`` runs once for none and so gives the columns.
    """
    order = cut(graph.levels(deps, components))
    rows: DataFrame | None = None
    for level in range((order.agg(F.max("level")).first()[0] or 0) + 1):
        made = cut(build(order.where(F.col("level") == level).select("pkg"), rows))
        rows = made if rows is None else rows.unionByName(made)
    return rows


def routed(rows: DataFrame, units: DataFrame, has_project: bool) -> tuple[DataFrame, DataFrame]:
    """Rows for the project store (local units, if there is one) and for the global store."""
    local = units.where(F.col("is_local") & F.lit(has_project)).select("pkg")
    return rows.join(local, "pkg", "left_semi"), rows.join(local, "pkg", "left_anti")
