"""The query verbs: one object over a catalogue's relations, each verb a DataFrame.

The relations are injected, so any tier (a signature search, a remote service's landed
results) is just another DataFrame of providers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.functions import ident, text
from symbolarium.operators import cascade, graph, lookup, search
from symbolarium.plans import build_plan
from symbolarium.sources import packages


class EngineError(Exception):
    """A failed query; ``code`` names the kind and ``exit_code`` its class."""

    def __init__(self, code: str, message: str, actions: dict[str, str] | None = None) -> None:
        super().__init__(message)
        self.code, self.exit_code, self.actions = code, cascade.EXIT_CODES.get(code, cascade.EXIT_CODES["INTERNAL_ERROR"]), actions or {}


@dataclass(frozen=True)
class Options:
    """What holds for every verb: ``offline`` keeps to cached remote answers; ``full`` shows all
    fields of a ``result`` and not the compact ones, and ``select`` names those to show;
    ``overrides`` are ``PKG=VER`` texts, ``scope`` is a component, ``limit`` the longest result."""

    offline: bool = False
    full: bool = False
    select: tuple[str, ...] = ()
    overrides: tuple[str, ...] = ()
    scope: str | None = None
    limit: int = search.LIMIT


#: Of each verb's result the compact fields, and those that only the full one has.
FIELDS = {
    "lookup": (["query", "providers", "resolved_from"], ["tiers_consulted"]), "package": (["name", "version", "is_local", "exposed_modules", "origin"], []), "module": (["package", "module", "exports"], []),
    "symbol": (["name", "kind", "package", "version", "module", "signature", "haddock_raw", "defined_in"], ["source"]), "versions": (["package", "pinned_version", "available_versions"], []),
    "deps": (["package", "direction", "depth", "deps"], []),
}


@dataclass
class Catalogue:
    """``symbols`` and ``stored`` (rows with pkg, mod, name, version, unit_id); the others as needed."""

    symbols: DataFrame
    stored: DataFrame
    units: DataFrame | None = None  # pkg, version, unit_id, origin
    deps: DataFrame | None = None  # pkg, pos, dep_pkg
    available: DataFrame | None = None  # pkg, version
    sources: DataFrame | None = None  # component, module, content
    decls: DataFrame | None = None  # component, module, name, kind, first_line, last_line, signature, doc
    pins: DataFrame | None = None  # pkg, pin_unit, pin_version
    project: DataFrame | None = None  # rows like ``stored`` that shadow them
    installed: DataFrame | None = None  # name, version
    remote_packages: DataFrame | None = None  # pkg, version, error; cached: whether the answer is kept here
    local_hits: DataFrame | None = None  # query, pkg, mod, name
    remote_hits: DataFrame | None = None  # query, pkg, mod, name, resolved_from, error
    prebuilt: DataFrame | None = None  # component, module, html
    components: DataFrame | None = None  # pkg, component


class Engine:
    def __init__(self, catalogue: Catalogue, options: Options = Options()) -> None:
        self.at, self.options = catalogue, options
        packages = None if catalogue.units is None else catalogue.units.select("pkg", "version")
        self._entities = search.searchable(catalogue.symbols, packages)

    def persist(self) -> Engine:
        """Keep the search relation in memory (it spills to disk); returns itself."""
        self._entities = self._entities.persist()
        return self

    def search(self, query: str, scope: str | None = None, limit: int | None = None) -> DataFrame:
        try:
            asked = search.parse_query(query, scope or self.options.scope)
        except search.QueryError as e:
            raise EngineError("USER_ERROR", str(e)) from e
        if asked.scope is not None and self._entities.where(F.col("component") == asked.scope).isEmpty():
            raise EngineError("USER_ERROR", f"unknown component {asked.scope}")
        return search.search(self._entities, asked, self.options.limit if limit is None else limit)

    def pins(self) -> DataFrame | None:
        """The plan's pins after the options' overrides; of several for one package the first."""
        if not self.options.overrides or self.at.pins is None:
            return self.at.pins
        given = self._spark.createDataFrame([(k, o) for k, o in enumerate(self.options.overrides)], "pos int, text string")
        parsed = given.join(packages.pinned_overrides(given), "text")
        if bad := parsed.where("error IS NOT NULL").select("error", "text").first():
            raise EngineError("USER_ERROR", f"{bad['error']}: {bad['text']}")
        return lookup.scope_with_overrides(self.at.pins, lookup.first_overrides(parsed))

    def lookup(self, *queries: str) -> DataFrame:
        """Providers of each query from the first tier that has any, as in ``resolved_lookups``."""
        asks = self._spark.createDataFrame([(q,) for q in queries], "query string")
        hits = "query string, pkg string, mod string, name string"
        local, remote = (self._or_empty(rows, kind) for rows, kind in ((self.at.local_hits, hits), (self.at.remote_hits, f"{hits}, resolved_from string, error string")))
        project = self.at.stored.limit(0) if self.at.project is None else self.at.project
        return cascade.resolved_lookups(asks, project, self.at.stored, self.pins(), local, remote, self.options.offline)

    def lookup_failures(self, found: DataFrame) -> DataFrame:
        """The failed queries of a ``lookup``, with exit code and what to try next."""
        actions = cascade.lookup_actions(F.col("query"), F.col("error"), F.col("tiers_consulted"))
        return found.where("error IS NOT NULL").select("query", "error", cascade.exit_code(F.col("error")).alias("exit_code"), actions.alias("actions"))

    def package(self, *refs: str) -> DataFrame:
        """Each reference resolved by plan, package store and remote, as in ``resolved_packages``."""
        asks = self._spark.createDataFrame([(r,) for r in refs], "ref string")
        units = self._or_empty(self.at.units, "pkg string, version string, origin string, is_local boolean")
        units = units if "is_local" in units.columns else units.withColumn("is_local", F.col("origin") == "local")
        remote = self._or_empty(self.at.remote_packages, "pkg string, version string, error string, cached boolean")
        if self.options.offline:  # what is cached still answers; the rest is not found
            remote = remote.where(F.col("cached") if "cached" in remote.columns else F.lit(False))
        return cascade.resolved_packages(asks, units.select("pkg", "version", "origin", "is_local"), self._or_empty(self.at.installed, "name string, version string"), remote)

    def package_info(self, *refs: str) -> DataFrame:
        """The same with the modules that each package's components present."""
        listed = self.at.symbols.select(ident.package_of(F.col("component")).alias("pkg"), "module").distinct().groupBy("pkg").agg(F.array_sort(F.collect_list("module")).alias("modules"))
        return self.package(*refs).join(listed, "pkg", "left")

    def page(self, component: str, module: str) -> DataFrame:
        """The module's page: prebuilt, from source, or its bare exports and why no more."""
        asks = self._spark.createDataFrame([(component, module)], "component string, module string")
        prebuilt = self._or_empty(self.at.prebuilt, "component string, module string, html string")
        entries = self._or_empty(self.at.decls, "component string, module string, name string, signature string")
        home = self.at.symbols.select("component", "module", "name", F.col("def_component").alias("c"), F.col("def_module").alias("m"))
        known = entries.select(F.col("component").alias("c"), F.col("module").alias("m"), "name", "signature")
        return cascade.module_pages(asks, prebuilt, home.join(known, ["c", "m", "name"]), self.at.symbols)

    def module(self, component: str, module: str) -> DataFrame:
        """The exports of a module, where each is defined, and whether that is elsewhere."""
        rows = self.at.symbols.where((F.col("component") == component) & (F.col("module") == module))
        return rows.select("name", "signature", "def_component", "def_module", (F.col("def_component") != component).alias("elsewhere")).orderBy("name", "signature")

    def symbol(self, path: str) -> DataFrame:
        """The card of ``pkg/Module/name``: signature, definition and documentation."""
        p = self._path(path)
        rows = self.at.symbols.where((F.col("component") == p["package"]) & (F.col("name") == p["symbol"]))
        if p["module"] is not None:
            rows = rows.where(F.col("module") == p["module"])
        if self.at.decls is None:
            return rows
        decls = self.at.decls.select(F.col("component").alias("def_component"), F.col("module").alias("def_module"), "name", "kind", "doc")
        return rows.join(decls, ["def_component", "def_module", "name"], "left")

    def source(self, path: str, reach: int = 15) -> DataFrame:
        """The lines that declare a symbol; of a module, its head. ``span`` says which."""
        p = self._path(path)
        if p["symbol"] is None:
            rows = self.at.sources.where((F.col("component") == p["package"]) & (F.col("module") == p["module"]))
            return rows.select("component", "module", F.lit("module_header").alias("span"), text.limited_lines(text.lines(F.col("content"))).alias("lines"))
        home = self.symbol(path).select(F.col("def_component").alias("component"), F.col("def_module").alias("module"), "name").distinct()
        placed = home.join(self.at.decls, ["component", "module", "name"]).join(self.at.sources, ["component", "module"])
        rows = text.lines(F.col("content"))
        exact = F.col("last_line").isNotNull()
        cut = F.when(exact, text.clamped_slice(rows, F.col("first_line"), F.col("last_line"))).otherwise(text.window_around(rows, F.col("first_line"), reach))
        return placed.select("component", "module", F.when(exact, "declaration").otherwise("window").alias("span"), cut.alias("lines"))

    def versions(self, pkg: str) -> DataFrame:
        """Known versions, newest first, the planned one marked."""
        planned = self.at.units.where(F.col("pkg") == pkg).select("version", F.lit(True).alias("pinned"))
        known = self.at.available.where(F.col("pkg") == pkg).select("version").distinct()
        return known.join(planned, "version", "full_outer").select("version", F.coalesce("pinned", F.lit(False)).alias("pinned")).orderBy(F.desc(ident.version_numbers(F.col("version"))))

    def deps(self, pkg: str, reverse: bool = False, limit: int | None = None) -> DataFrame:
        """Direct dependencies or dependants; ``limit`` cuts the list. For depth, ``closure``."""
        if reverse:
            out = graph.reverse(self.at.deps, pkg)
            return out if limit is None else out.limit(limit)
        return graph.forward(self.at.deps, pkg, limit)

    def closure(self, pkg: str, depth: int | None = None) -> DataFrame:
        root = self.at.deps.sparkSession.createDataFrame([(pkg,)], "pkg string")
        return graph.closure(self.at.deps, root, depth)

    def doctor(self) -> DataFrame:
        """A row for each relation: is it there, how many rows; the last, ``all_pass``, is ok when
        all are and has no count."""
        spark = self._spark
        parts = {n: getattr(self.at, n) for n in ("symbols", "stored", "units", "deps", "available", "sources", "decls", "pins")}
        out = None
        for name, rows in parts.items():
            n = spark.createDataFrame([(None,)], "n long") if rows is None else rows.agg(F.count("*").alias("n"))
            one = n.select(F.lit(name).alias("relation"), "n", F.coalesce(F.col("n") > 0, F.lit(False)).alias("ok"))
            out = one if out is None else out.unionByName(one)
        rolled = cascade.all_pass(out.withColumnRenamed("relation", "name")).where("name = 'all_pass'")
        return out.unionByName(rolled.select(F.col("name").alias("relation"), F.lit(None).cast("long").alias("n"), "ok"))

    def result(self, verb: str, *asked: str, **more) -> DataFrame:
        """A verb's answer as users see it, a row a subject: ``(subject, result, unmatched,
        envelope)``. ``result`` is JSON of the compact (or ``full``) fields, cut to ``select``;
        ``unmatched`` names what ``select`` asks for in vain. Failed lookups and packages have none."""
        rows, outside, actions = getattr(self, f"_{verb}_result")(*asked, **more)
        compact, further = FIELDS[verb]
        wanted = build_plan.parsed_fields(",".join(self.options.select))
        shown = build_plan.selected_fields(rows, "subject", wanted, compact + further * self.options.full)
        body = rows.select("subject", outside.alias("outside"), (F.create_map().cast("map<string,string>") if actions is None else actions).alias("actions"))
        overrides = F.array(*(F.lit(o) for o in self.options.overrides)).cast("array<string>")
        parts = build_plan.envelope(F.parse_json("result"), F.col("outside"), overrides, F.col("actions"))
        return shown.join(body, "subject").select("subject", "result", "unmatched", parts.alias("envelope"))

    def _lookup_result(self, *queries: str):
        found = self.lookup(*queries)
        provider = F.struct("pkg", "mod", "name", F.col("tier"), "version")
        rows = found.where("error IS NULL").groupBy(F.col("query").alias("subject")).agg(
            F.first("query").alias("query"), F.array_sort(F.collect_list(provider)).alias("providers"), F.split(F.first("tiers_consulted"), ",").alias("tiers_consulted"), F.max("resolved_from").alias("resolved_from")
        )
        hints = cascade.lookup_hints(found).select(F.col("query").alias("subject"), "actions")
        return rows.join(hints, "subject"), F.lit(False), F.col("actions")

    def _package_result(self, *refs: str):
        rows = self.package_info(*refs).where("error IS NULL")
        return rows.select(F.col("ref").alias("subject"), F.col("pkg").alias("name"), "version", "is_local", F.coalesce("modules", F.array().cast("array<string>")).alias("exposed_modules"), "origin", "outside_plan"), F.col("outside_plan"), None

    def _module_result(self, component: str, module: str):
        names = self.module(component, module).agg(F.array_sort(F.collect_set("name")).alias("exports"))
        return names.select(F.lit(module).alias("subject"), F.lit(component).alias("package"), F.lit(module).alias("module"), "exports"), F.lit(False), None

    def _symbol_result(self, path: str):
        rows, nothing = self.symbol(path), F.lit(None).cast("string")
        elsewhere = (F.col("def_component") != F.col("component")) | (F.col("def_module") != F.col("module"))
        card = rows.select(
            F.concat_ws("/", "component", "module", "name").alias("subject"), "name", F.col("kind") if "kind" in rows.columns else nothing.alias("kind"), F.col("component").alias("package"), "module", "signature",
            (F.col("doc") if "doc" in rows.columns else nothing).alias("haddock_raw"), F.when(elsewhere, F.struct(F.col("def_component").alias("package"), F.col("def_module").alias("module"))).alias("defined_in"),
        )
        units = self._or_empty(self.at.units, "pkg string, version string").groupBy(F.col("pkg").alias("package")).agg(F.min("version").alias("version"))
        return card.dropDuplicates(["subject"]).join(units, "package", "left"), F.lit(False), None

    def _versions_result(self, pkg: str):
        order = F.struct(ident.version_numbers(F.col("version")).alias("v"), "version", "pinned")
        rows = self.versions(pkg).agg(F.transform(F.sort_array(F.collect_list(order), asc=False), lambda x: x["version"]).alias("available_versions"), F.max(F.when(F.col("pinned"), F.col("version"))).alias("pinned_version"))
        return rows.select(F.lit(pkg).alias("subject"), F.lit(pkg).alias("package"), "pinned_version", "available_versions"), F.lit(False), None

    def _deps_result(self, pkg: str, reverse: bool = False, limit: int | None = None):
        rows, column = self.deps(pkg, reverse, limit), "pkg" if reverse else "dep_pkg"
        order = F.struct(F.lit(0).alias("pos") if reverse else F.col("pos"), F.col(column).alias("dep"))
        listed = rows.agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["dep"]).alias("deps"))
        what = [F.lit(pkg).alias("subject"), F.lit(pkg).alias("package"), F.lit("reverse" if reverse else "forward").alias("direction"), F.lit(limit).cast("int").alias("depth"), "deps"]
        return listed.select(*what), F.lit(False), None

    @property
    def _spark(self):
        return self.at.symbols.sparkSession

    def _or_empty(self, rows: DataFrame | None, kind: str) -> DataFrame:
        return self._spark.createDataFrame([], kind) if rows is None else rows

    def _parsed(self, column):
        return self.at.symbols.sparkSession.range(1).select(column.alias("x")).first()["x"]

    def _path(self, path: str):
        p = self._parsed(ident.symbol_path(F.lit(path)))
        if p["error"] is not None:
            raise EngineError("USER_ERROR", f"{p['error']}: {path}")
        return p
