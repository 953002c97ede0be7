"""Cascades: questions answered by the first source that can, for many questions at once.

Each function takes all questions as a DataFrame and keeps one answer (or one failure) for
each, so a thousand lookups are one plan of joins and not a thousand jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions.ident import package_ref, qualified_name, shared_leading
from symbolarium.functions.text import shell_quoted
from symbolarium.operators.lookup import in_scope
from symbolarium.plans.lineage import shuffled

#: Exit code of each error code.
EXIT_CODES = {
    "USER_ERROR": 2, "NOT_FOUND": 3, "NETWORK_ERROR": 4, "HOOGLE_OFFLINE": 4, "CORRUPTION": 5, "HOOGLE_REMOTE_ERROR": 5,
    "ENV_ERROR": 7, "TOOL_MISSING": 8, "INTERNAL_ERROR": 9,
}
#: Wire names of the lookup tiers, in their order.
TIERS = ["cache", "hoogle-local", "hoogle-remote"]


def exit_code(code: Column) -> Column:
    """An error code's exit code; 0 for none, that of an internal error for an unknown one."""
    known = F.create_map(*(F.lit(x) for pair in EXIT_CODES.items() for x in pair))
    return F.when(code.isNull(), 0).otherwise(F.coalesce(F.try_element_at(known, code), F.lit(EXIT_CODES["INTERNAL_ERROR"])))


def resolved_packages(asks: DataFrame, units: DataFrame, installed: DataFrame, remote: DataFrame) -> DataFrame:
    """``asks(ref)``, each ``name`` or ``name-version``, to ``(ref, pkg, version, origin, is_local,
    outside_plan, found_in, error)``.

    A bare name is looked for in the plan ``units(pkg, version, origin, is_local)``, then among
    ``installed(name, version)`` packages (the smallest version as text), then in ``remote(pkg,
    version, error)``, whose null version without an error is a field missing. A reference with a
    version bypasses all and is outside the plan, even where the plan pins the same.
    """
    asked = asks.select("ref").distinct().withColumn("p", package_ref(F.col("ref"))).select("ref", F.col("p.name").alias("pkg"), F.col("p.version").alias("asked"))
    plan = units.groupBy("pkg").agg(F.min(F.struct("version", "origin", "is_local")).alias("plan"))
    store = installed.groupBy(F.col("name").alias("pkg")).agg(F.min("version").alias("stored"))
    far = remote.groupBy("pkg").agg(F.min(F.struct("version", "error")).alias("far"))
    rows = asked.join(plan, "pkg", "left").join(store, "pkg", "left").join(far, "pkg", "left")
    found_in = (
        F.when(F.col("asked").isNotNull(), "asked").when(F.col("plan").isNotNull(), "plan").when(F.col("stored").isNotNull(), "store").when(F.col("far.version").isNotNull(), "remote")
    )
    error = F.when(found_in.isNull(), F.when(F.col("far").isNull(), "NOT_FOUND").otherwise(F.coalesce("far.error", F.lit("CORRUPTION"))))
    planned = found_in == "plan"
    return rows.select(
        "ref", "pkg", F.coalesce("asked", "plan.version", "stored", "far.version").alias("version"),
        F.when(planned, F.col("plan.origin")).when(found_in.isNotNull(), "hackage").alias("origin"), F.when(found_in.isNotNull(), F.coalesce(planned & F.col("plan.is_local"), F.lit(False))).alias("is_local"),
        F.when(found_in.isNotNull(), ~planned).alias("outside_plan"), found_in.alias("found_in"), error.alias("error"),
    )


def resolved_lookups(asks: DataFrame, project: DataFrame, whole: DataFrame, pins: DataFrame | None, local: DataFrame, remote: DataFrame, offline: bool = False) -> DataFrame:
    """``asks(query)`` to providers ``(query, pkg, mod, name, version, tier, resolved_from,
    tiers_consulted, error)``; a query that no tier answers has one row, its error.

    Tier 1 is the index ``(pkg, mod, name, version, unit_id)`` within the plan's pins: project rows,
    and global ones whose (pkg, mod, name) the project lacks. Tier 2 is ``local(query, pkg, mod,
    name)``, tier 3 ``remote(query, pkg, mod, name, resolved_from, error)``: cached answers count
    even offline, others (``resolved_from`` other than ``cache``) then not; a row with an ``error``
    is a failed call. A query ``Data.Map.lookup`` asks for the name of one module.
    """
    wanted = asks.select("query").distinct().withColumn("q", qualified_name(F.col("query"))).select("query", F.col("q.module").alias("in_module"), F.col("q.name").alias("name"))
    key = ["pkg", "mod", "name"]
    columns = ["query", *key, "version", F.lit(1).alias("tier"), F.lit(None).cast("string").alias("resolved_from"), F.lit(None).cast("string").alias("failed")]

    def indexed(rows: DataFrame) -> DataFrame:
        hit = in_scope(rows.select(*key, "version", "unit_id"), pins).join(wanted, "name")
        return hit.where("in_module IS NULL OR in_module = mod")

    own, others = indexed(project), indexed(whole)
    first = own.unionByName(others.join(own.select("query", *key).distinct(), ["query", *key], "left_anti")).select(*columns)
    far = lambda tier, source, failed: ["query", *key, F.lit(None).cast("string").alias("version"), F.lit(tier).alias("tier"), source.alias("resolved_from"), failed.alias("failed")]
    nothing = F.lit(None).cast("string")
    second = local.select(*far(2, nothing, nothing))
    third = remote.where(F.col("resolved_from") == "cache") if offline else remote
    third = third.select(*far(3, F.col("resolved_from"), F.col("error")))
    every = first.unionByName(second).unionByName(third)
    best = every.groupBy("query").agg(F.min(F.when(F.col("failed").isNull(), F.col("tier"))).alias("best"), F.min("failed").alias("why"))
    none = F.coalesce("why", F.lit("HOOGLE_OFFLINE" if offline else "NOT_FOUND"))
    told = asks.select("query").distinct().join(best, "query", "left")
    told = told.withColumn("error", F.when(F.col("best").isNull(), none))
    consulted = F.coalesce("best", F.when(F.col("error") == "HOOGLE_OFFLINE", 2).otherwise(3))
    return (
        told.join(every.where("failed IS NULL").withColumnRenamed("tier", "best"), ["query", "best"], "left")
        .select("query", *key, "version", F.col("best").alias("tier"), "resolved_from", F.array_join(F.slice(F.lit(TIERS), F.lit(1), consulted), ",").alias("tiers_consulted"), "error")
    )


def lookup_actions(query: Column, error: Column, tiers: Column) -> Column:
    """What to try after a failed lookup, label to command; empty for no error."""
    command = lambda q, flags="": F.concat(F.lit("lookup "), shell_quoted(q), F.lit(flags and f" {flags}"))
    rest = (F.lit("query"), query, F.lit("tiers_consulted"), tiers)
    return (
        F.when(error == "HOOGLE_OFFLINE", F.create_map(F.lit("retry_online"), command(query), *rest))
        .when(error == "NOT_FOUND", F.create_map(F.lit("retry_with_prefix"), command(F.concat(query, F.lit("*"))), *rest))
        .when(error == "HOOGLE_REMOTE_ERROR", F.create_map(F.lit("retry_offline"), command(query, "--offline"), F.lit("raise_timeout"), command(query, "--hoogle-timeout 30"), *rest))
        .otherwise(F.create_map().cast("map<string,string>"))
    )


def lookup_hints(found: DataFrame, most: int = 5) -> DataFrame:
    """What to try after a successful lookup, ``(query, actions)``: of a query's first ``most``
    providers, by package, module and name, each symbol's path to the command that shows it."""
    order = Window.partitionBy("query").orderBy("pkg", "mod", "name", F.desc("version"))
    first = found.where("error IS NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    path = F.concat_ws("/", "pkg", "mod", "name")
    each = first.groupBy("query").agg(F.array_sort(F.collect_set(F.struct(path.alias("key"), F.concat(F.lit("symbol "), path).alias("value")))).alias("x"))
    return each.select("query", F.map_from_entries("x").alias("actions"))


def search_outcome(failure: Column, has_gaps: Column) -> Column:
    """Whether a failed symbol search settled the question: what stopped at a bound did not, nor
    did one that hit unreadable dependencies (``blocked``)."""
    return (
        F.when(failure.isin("hop_limit", "parse_budget"), "stopped_at_bound").when(failure.isin("not_exported", "not_declared"), "exhausted")
        .when(failure == "module_absent", "module_absent").when(has_gaps, "blocked").otherwise("exhausted")
    )


def outside_candidates(unresolved: DataFrame, imports: DataFrame, keys: Sequence[str] = ("module", "name")) -> DataFrame:
    """For ``unresolved(module, name)`` the modules that may supply each name, in the order to try
    them: explicit imports before open ones, of each those nearest to the module first.
    ``imports(module, name, target, explicit)``; names without any import have an empty list.
    ``keys`` names further columns, such as the component, that tell asks apart."""
    rank = F.struct((~F.col("explicit")).alias("open"), (-shared_leading(F.col("module"), F.col("target"))).alias("far"), "target")
    best = imports.groupBy(*keys, "target").agg(F.max("explicit").alias("explicit"))
    ranked = best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["target"]).alias("candidates"))
    return unresolved.join(shuffled(ranked), list(keys), "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def located(asks: DataFrame, sites: DataFrame, decls: DataFrame, chained: DataFrame) -> DataFrame:
    """``asks(module, name)``: the index's site ``sites(module, name, definer)`` if its module still
    declares the name, else what following the chain gave, ``chained(module, name, definer,
    verdict)``. ``(module, name, definer, how, verdict)``."""
    declared = decls.select(F.col("module").alias("site"), "name").distinct()
    short = asks.join(shuffled(sites.withColumnRenamed("definer", "site")), ["module", "name"]).join(shuffled(declared), ["site", "name"], "left_semi").groupBy("module", "name").agg(F.min("site").alias("site"))
    rows = asks.join(shuffled(short), ["module", "name"], "left").join(shuffled(chained), ["module", "name"], "left")
    how = F.when(F.col("site").isNotNull(), "index").when(F.col("definer").isNotNull(), "chain")
    return rows.select("module", "name", F.coalesce("site", "definer").alias("definer"), how.alias("how"), F.when(how.isNotNull(), "found").otherwise(F.coalesce("verdict", F.lit("exhausted"))).alias("verdict"))


def imported_definitions(asks: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The definitions of another component that the pages ``asks(component, module)`` need, each
    once a page, with the module's source or why there is none.

    ``rows`` are index rows, ``sources(component, module, content)`` what could be read; a null
    content is a package whose source is there and the module's file is not."""
    needed = rows.join(asks, ["component", "module"], "left_semi").where(F.col("def_component") != F.col("component")).select("component", "module", "def_component", "def_module").distinct()
    packages = sources.select(F.col("component").alias("def_component")).distinct().withColumn("known", F.lit(True))
    held = sources.groupBy(F.col("component").alias("def_component"), F.col("module").alias("def_module")).agg(F.min("content").alias("content"))
    joined = needed.join(held, ["def_component", "def_module"], "left").join(packages, "def_component", "left")
    gap = F.when(F.col("content").isNull(), F.when(F.col("known").isNull(), "package not resolved").otherwise("no source file"))
    return joined.select("component", "module", "def_component", "def_module", "content", gap.alias("gap"))


def module_pages(asks: DataFrame, prebuilt: DataFrame, entries: DataFrame, exports: DataFrame) -> DataFrame:
    """The best view of each page ``asks(component, module)``: ``prebuilt(component, module, html)``,
    else entries from source ``entries(component, module, name, signature)``, else the bare names of
    ``exports(component, module, name)``; the last is degraded and says why.
    ``(component, module, view, html, names, reason)``."""
    page = ["component", "module"]
    html = prebuilt.where("html IS NOT NULL").groupBy(*page).agg(F.min("html").alias("html"))
    names = lambda rows, c: rows.groupBy(*page).agg(F.array_sort(F.collect_set("name")).alias(c))
    rows = asks.select(*page).distinct().join(html, page, "left").join(names(entries, "resolved"), page, "left").join(names(exports, "listed"), page, "left")
    view = F.when(F.col("html").isNotNull(), "prebuilt").when(F.col("resolved").isNotNull(), "source").otherwise("exports_only")
    reason = F.when(view == "exports_only", F.when(F.col("listed").isNull(), "package source could not be resolved").otherwise("module docs could not be resolved"))
    shown = F.when(view == "source", F.col("resolved")).when(view == "exports_only", F.coalesce("listed", F.array().cast("array<string>")))
    return rows.select(*page, view.alias("view"), "html", shown.alias("names"), reason.alias("reason"))


def fresh_in_stores(current: DataFrame, project: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each entry's stored fingerprint is the current one: in the project store, else in
    the global one; a null never matches. ``(keys, fresh_in)``, null for stale entries."""
    held = lambda rows, c: rows.where("fingerprint IS NOT NULL").select(*keys, "fingerprint").distinct().withColumn(c, F.lit(True))
    joined = current.join(held(project, "p"), [*keys, "fingerprint"], "left").join(held(whole, "w"), [*keys, "fingerprint"], "left")
    return joined.select(*keys, F.when(F.col("p"), "project").when(F.col("w"), "global").alias("fresh_in"))


def progress(units: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: how many of ``units(pkg)`` are ``indexed(pkg)``, and of how many."""
    done = units.join(indexed.select("pkg").distinct().withColumn("done", F.lit(True)), "pkg", "left")
    return done.agg(F.count_if("done").alias("done"), F.count("*").alias("total"))


def all_pass(checks: DataFrame) -> DataFrame:
    """``checks(name, ok)`` and one more row, ``all_pass``: whether all are."""
    rolled = checks.agg(F.coalesce(F.bool_and(F.coalesce("ok", F.lit(False))), F.lit(True)).alias("ok"))
    return checks.select("name", "ok").unionByName(rolled.select(F.lit("all_pass").alias("name"), "ok"))
