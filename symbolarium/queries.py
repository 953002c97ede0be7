"""Every query of the catalogue engine, with the SQL that another engine can check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from symbolarium.functions import hashing, ident, markup, text
from symbolarium.operators import declarations, graph, lookup, resolve, search, store
from symbolarium.plans import build_plan
from symbolarium.sources import catalog, packages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_CAP = "upper(substr({0}, 1, 1)) || lower(substr({0}, 2))"
_NAMED = f"""named AS (
  SELECT replace(lower(p_brand), '#', '-') AS component,
         'Cat.' || {_CAP.format('p_type')} || CASE WHEN p_size % 5 = 0 THEN '.Internal' ELSE '' END AS module,
         split_part(p_name, ' ', 1) || {_CAP.format("split_part(p_name, ' ', 2)")} AS name, p_type, p_size, p_partkey,
         CASE WHEN p_size % 5 = 0 THEN 'internal' ELSE 'exposed' END AS visibility
  FROM part
)"""


def _symbols(name: str = "symbols", where: str = "true") -> str:
    return f"""{name} AS (
  SELECT DISTINCT component, module, name, name || ' :: ' || p_type AS signature,
         min(component) OVER (PARTITION BY name, p_type) AS def_component, min(module) OVER (PARTITION BY name, p_type) AS def_module, visibility
  FROM named WHERE {where}
)"""


_VERSIONED = """versioned AS (
  SELECT DISTINCT component AS pkg, module AS mod, name, (p_size % 3 + 1) || '.' || (p_partkey % 12) AS version,
         component || '-' || (p_size % 3 + 1) || '.' || (p_partkey % 12) AS unit_id
  FROM named
)"""
_PINS = """pins AS (
  SELECT pkg, CASE WHEN length(pkg) % 2 = 0 THEN min(unit_id) END AS pin_unit, CASE WHEN length(pkg) % 2 = 1 THEN min(version) END AS pin_version
  FROM versioned GROUP BY pkg
)"""
_DEPS = """deps AS (
  SELECT p_partkey AS pkg, 0 AS pos, p_partkey // 2 AS dep_pkg FROM part WHERE p_partkey > 0
  UNION ALL SELECT p_partkey, 1, p_partkey // 3 FROM part WHERE p_partkey > 0 AND p_partkey // 3 <> p_partkey // 2
)"""
_MODULES = """ns AS (SELECT unnest(range(7)) AS name), decls AS (
  SELECT p_partkey AS module, name FROM part, ns WHERE (p_partkey + name) % 3 = 0
), exported AS (
  SELECT p_partkey AS module, name FROM part, ns WHERE p_partkey % 4 < 3 OR (p_partkey + name) % 3 = 0
), imports AS (
  SELECT p_partkey AS module, name, p_partkey // 2 AS target, 1 AS open FROM part, ns WHERE p_partkey > 0
  UNION ALL SELECT p_partkey, name, p_partkey // 3, 0 FROM part, ns WHERE p_partkey > 0 AND name % 2 = 0
)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# -- search ------------------------------------------------------------------------------


def _subsequence(token: str, column: str) -> str:
    return f"regexp_matches({column}, '{'.*'.join('[' + c + ']' for c in token)}', 's')"


def _score_sql(tokens: list[str]) -> str:
    out = ["greatest(0, 60 - name_len)"]
    for t in tokens:
        out.append(
            f"""CASE WHEN name_l = '{t}' THEN 1000 WHEN starts_with(name_l, '{t}') THEN 700 WHEN contains(name_l, '{t}') THEN 500
            WHEN mod_l = '{t}' THEN 400 WHEN starts_with(mod_l, '{t}') THEN 300 WHEN contains(mod_l, '{t}') THEN 220
            WHEN contains(qual_l, '{t}') THEN 200 WHEN contains(pkg_l, '{t}') THEN 150
            WHEN {_subsequence(t, 'name_l')} THEN 80 WHEN {_subsequence(t, 'qual_l')} THEN 30 END"""
        )
    if len(tokens) == 1:
        out.append(f"CASE WHEN kind = 'package' AND pkg_l = '{tokens[0]}' THEN 100000 WHEN kind = 'module' AND mod_l = '{tokens[0]}' THEN 50000 ELSE 0 END")
    out.append("CASE WHEN kind <> 'package' AND visibility = 'exposed' THEN 20 ELSE 0 END")
    return " + ".join(out)


_ENTITIES = f"""WITH {_NAMED}, {_symbols()}, {_VERSIONED}, plain AS (
  SELECT 'symbol' AS kind, component, module, name, signature, def_component, def_module, visibility FROM symbols
  UNION ALL SELECT DISTINCT 'module', component, module, NULL, NULL, NULL, NULL, visibility FROM symbols
  UNION ALL SELECT DISTINCT 'package', pkg, NULL, NULL, NULL, version, NULL, NULL FROM versioned
), entities AS (
  SELECT kind, component, module, name, signature, CASE WHEN kind <> 'package' THEN def_component END AS def_component, def_module, visibility,
         lower(component) AS pkg_l, lower(coalesce(module, '')) AS mod_l, lower(coalesce(name, '')) AS name_l, length(coalesce(name, '')) AS name_len,
         lower(component) || '.' || lower(coalesce(module, '')) || '.' || lower(coalesce(name, '')) AS qual_l
  FROM plain
)"""
_SHOWN = "kind, component, module, name, signature, def_component, def_module, score"


def _search_sql(tokens: list[str], scope: str | None = None, limit: int = 50) -> str:
    scoped = f" WHERE component = '{scope}'" if scope else ""
    return f"""{_ENTITIES}, scored AS (SELECT *, {_score_sql(tokens)} AS score FROM entities{scoped}),
    hits AS (SELECT * FROM scored WHERE score IS NOT NULL),
    folded AS (
      SELECT kind, component, module, name, signature, def_component, def_module, max(score) OVER g AS score,
             row_number() OVER (PARTITION BY def_component, def_module, name ORDER BY visibility = 'internal', list_contains(string_split(module, '.'), 'Internal'),
                                len(string_split(module, '.')), module, component, signature) AS rn
      FROM hits WHERE kind = 'symbol' WINDOW g AS (PARTITION BY def_component, def_module, name)
    )
    SELECT {_SHOWN} FROM (
      SELECT {_SHOWN} FROM folded WHERE rn = 1 UNION ALL SELECT {_SHOWN} FROM hits WHERE kind <> 'symbol'
    ) ORDER BY score DESC, component NULLS FIRST, module NULLS FIRST, name NULLS FIRST, def_component NULLS FIRST, def_module NULLS FIRST, kind LIMIT {limit}"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.searchable(catalog.symbols(spark, sf_dir), catalog.versioned(spark, sf_dir))


def _searched(text_: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(_entities(spark, sf_dir), search.parse_query(text_)).drop("alternates")

    return run


for _name, _text in {
    "search_single_token": "bolt", "search_multi_token": "small cat.promo", "search_scoped": "ring pkg:brand-2", "search_abbrev": "rdbt",
    "search_exact_package": "brand-7", "search_exact_module": "Cat.Promo", "search_infix": "eel",
}.items():  # fmt: skip
    _q = search.parse_query(_text)
    query(_name, _search_sql(_q.tokens, _q.scope))(_searched(_text))


@query("score_ladder", f"""{_ENTITIES} SELECT kind, component, module, name, signature, {_score_sql(['bolt'])} AS score FROM entities WHERE {_score_sql(['bolt'])} IS NOT NULL""")
def score_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(_entities(spark, sf_dir), search.parse_query("bolt")).select("kind", "component", "module", "name", "signature", "score")


@query("collapse_alternates", f"""WITH {_NAMED}, {_symbols()}, shown AS (
  SELECT *, row_number() OVER (PARTITION BY def_component, def_module, name ORDER BY visibility = 'internal', list_contains(string_split(module, '.'), 'Internal'),
         len(string_split(module, '.')), module, component, signature) AS rn FROM symbols
) SELECT def_component, def_module, name, max(CASE WHEN rn = 1 THEN component || ':' || module END) AS winner,
         count(DISTINCT CASE WHEN rn > 1 THEN component || ':' || module END) AS n_alternates,
         min(CASE WHEN rn = 2 THEN component || ':' || module END) AS best_alternate
FROM shown GROUP BY ALL""")
def collapse_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.searchable(catalog.symbols(spark, sf_dir)).where("kind = 'symbol'").withColumn("score", F.lit(1))
    label = lambda x: F.concat(x["component"], F.lit(":"), x["module"])  # noqa: E731
    return search.collapse(rows).select(
        "def_component", "def_module", "name", F.concat("component", F.lit(":"), "module").alias("winner"),
        F.size("alternates").cast("long").alias("n_alternates"), label(F.get("alternates", F.lit(0))).alias("best_alternate"),
    )  # fmt: skip


@query("module_rows", f"WITH {_NAMED}, {_symbols()} SELECT DISTINCT component, module, visibility FROM symbols")
def module_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).where("kind = 'module'").select("component", "module", "visibility")


@query("package_rows", f"WITH {_NAMED}, {_VERSIONED} SELECT DISTINCT pkg, version FROM versioned")
def package_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).where("kind = 'package'").select(F.col("component").alias("pkg"), "version")


@query("search_highlight", f"""WITH {_NAMED}, {_symbols()} SELECT component, module, name, signature, visibility,
  strpos(lower(name), 'bo') - 1 AS first_start, strpos(lower(name), 'lt') - 1 AS second_start FROM symbols
  WHERE contains(lower(name), 'bolt')""")
def search_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = text.highlight_spans(F.col("name"), ["lt", "bo"])
    rows = catalog.symbols(spark, sf_dir).where(F.lower("name").contains("bolt")).withColumn("spans", spans)
    return rows.select("component", "module", "name", "signature", "visibility", F.get("spans", F.lit(0))["start"].cast("long").alias("first_start"), F.get("spans", F.lit(1))["start"].cast("long").alias("second_start"))


@query("subsequence_match", f"WITH {_NAMED}, {_symbols()} SELECT component, module, name, signature, visibility, {_subsequence('rbt', 'lower(name)')} AS is_match, {_subsequence('rbt', 'lower(name)')} AS is_folded FROM symbols")
def subsequence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    literal, folded = text.is_subsequence_of("rbt", F.lower("name")), text.is_subsequence(F.lit("rbt"), F.lower("name"))
    return catalog.symbols(spark, sf_dir).select("component", "module", "name", "signature", "visibility", literal.alias("is_match"), folded.alias("is_folded"))


# -- lookup and scope ---------------------------------------------------------------------


@query("lookup_by_name", f"WITH {_NAMED}, {_VERSIONED} SELECT * FROM versioned WHERE name = 'redBolt'")
def lookup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.newest_first(lookup.by_name(catalog.versioned(spark, sf_dir), "redBolt"))


@query("lookup_qualified", f"WITH {_NAMED}, {_VERSIONED} SELECT * FROM versioned WHERE name = 'hotGear' AND mod = 'Cat.Economy'")
def lookup_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    module, _, name = "Cat.Economy.hotGear".rpartition(".")
    return lookup.by_name(catalog.versioned(spark, sf_dir), name, module)


@query("lookup_in_module", f"WITH {_NAMED}, {_VERSIONED} SELECT * FROM versioned WHERE pkg = 'brand-3' AND mod = 'Cat.Small'")
def lookup_in_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.in_module(catalog.versioned(spark, sf_dir), "brand-3", "Cat.Small")


@query("read_configuration", f"WITH {_NAMED}, {_VERSIONED} SELECT * FROM versioned WHERE pkg = 'brand-3' AND version = '1.3' AND unit_id = 'brand-3-1.3'")
def read_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.configuration(catalog.versioned(spark, sf_dir), "brand-3", "1.3", "brand-3-1.3")


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.versioned(spark, sf_dir)
    return rows.groupBy("pkg").agg(F.min("unit_id").alias("u"), F.min("version").alias("v")).select(
        "pkg", F.when(F.length("pkg") % 2 == 0, F.col("u")).alias("pin_unit"), F.when(F.length("pkg") % 2 == 1, F.col("v")).alias("pin_version")
    )


@query("plan_scope_filter", f"""WITH {_NAMED}, {_VERSIONED}, {_PINS}
SELECT v.* FROM versioned v JOIN pins p ON p.pkg = v.pkg WHERE p.pin_unit = v.unit_id OR p.pin_version = v.version""")
def plan_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.in_scope(catalog.versioned(spark, sf_dir), _pins(spark, sf_dir))


@query("override_scope", f"""WITH {_NAMED}, {_VERSIONED}, {_PINS}, o(pkg, version) AS (VALUES ('brand-2', '9.9'), ('brand-99', '1.0'))
SELECT * FROM pins WHERE pkg NOT IN (SELECT pkg FROM o) UNION ALL SELECT pkg, NULL, version FROM o""")
def override_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("brand-2", 0, "9.9"), ("brand-2", 1, "3.0"), ("brand-99", 2, "1.0")], "pkg string, pos int, version string")
    return lookup.scope_with_overrides(_pins(spark, sf_dir), lookup.first_overrides(asked))


@query("apply_overrides", f"""WITH {_NAMED}, {_VERSIONED}, units AS (SELECT pkg, min(version) AS version, min(unit_id) AS unit_id FROM versioned GROUP BY pkg),
o(pkg, asked) AS (VALUES ('brand-2', '9.9'), ('brand-99', '1.0'))
SELECT pkg, coalesce(asked, version) AS version, coalesce(unit_id, 'unpinned:' || pkg || '-' || asked) AS unit_id FROM units FULL JOIN o USING (pkg)""")
def apply_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = catalog.versioned(spark, sf_dir).groupBy("pkg").agg(F.min("version").alias("version"), F.min("unit_id").alias("unit_id"))
    return lookup.apply_overrides(units, spark.createDataFrame([("brand-2", "9.9"), ("brand-99", "1.0")], "pkg string, version string"))


_STORES = f"WITH {_NAMED}, {_symbols('project', 'p_size <= 25')}, {_symbols('whole', 'p_size >= 10')}"


@query("shadow_merge_rows", f"{_STORES} SELECT * FROM project UNION ALL SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM project p WHERE (p.component, p.module, p.name) = (w.component, w.module, w.name))")
def shadow_merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.shadowed_rows(*catalog.stores(spark, sf_dir))


_VERSIONED_STORES = f"WITH {_NAMED}, {_VERSIONED}, project AS (SELECT * FROM versioned WHERE unit_id < 'brand-3' AND name < 'm'), whole AS (SELECT * FROM versioned WHERE name > 'c')"


def _versioned_stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = catalog.versioned(spark, sf_dir)
    return rows.where("unit_id < 'brand-3' AND name < 'm'"), rows.where("name > 'c'")


@query("shadow_read_entries", f"{_VERSIONED_STORES} SELECT * FROM project UNION ALL SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM project p WHERE (p.pkg, p.version, p.unit_id) = (w.pkg, w.version, w.unit_id))")
def shadow_read_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.shadowed_entries(*_versioned_stores(spark, sf_dir))


_TIERS = f"""{_STORES}, tiers AS (
  SELECT 1 AS tier, component, module, name FROM project WHERE name = 'hotValve' AND component = 'brand-0'
  UNION ALL SELECT 2, component, module, name FROM whole WHERE name = 'hotGear'
  UNION ALL SELECT 3, component, module, name FROM whole
) SELECT * FROM tiers WHERE tier = (SELECT min(tier) FROM tiers)"""


def _tiers(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    project, whole = (s.select("component", "module", "name") for s in catalog.stores(spark, sf_dir))
    return [project.where("name = 'hotValve' AND component = 'brand-0'"), whole.where("name = 'hotGear'"), whole]


@query("lookup_cascade", _TIERS)
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.all_tiers(*_tiers(spark, sf_dir))


@query("lookup_cascade_eager", _TIERS)
def lookup_cascade_eager(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.first_tier(*_tiers(spark, sf_dir))


@query("source_cascade", f"""WITH {_NAMED}, pk AS (SELECT DISTINCT component AS pkg FROM named),
a AS (SELECT component AS pkg, min(name) AS v FROM named WHERE p_size < 3 GROUP BY 1), b AS (SELECT component AS pkg, min(module) AS v FROM named WHERE p_size = 11 GROUP BY 1)
SELECT pkg, coalesce(a.v, b.v) AS place, CASE WHEN a.v IS NOT NULL THEN 'plan' WHEN b.v IS NOT NULL THEN 'store' END AS found_in FROM pk LEFT JOIN a USING (pkg) LEFT JOIN b USING (pkg)""")
def source_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = catalog._named(spark, sf_dir).withColumnRenamed("component", "pkg")
    plan = part.where("p_size < 3").select("pkg", F.col("name").alias("place"))
    kept = part.where("p_size = 11").select("pkg", F.col("module").alias("place"))
    return lookup.coalesced(part.select("pkg").distinct(), "pkg", "place", ("plan", plan), ("store", kept))


# -- store --------------------------------------------------------------------------------

_META = "meta AS (SELECT event_type AS pkg, CAST(user_id % 10 AS VARCHAR) AS version, event_id AS unit_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS indexed_at FROM events)"


@query("prune_configurations", f"WITH {_META} SELECT *, row_number() OVER (PARTITION BY pkg, version ORDER BY indexed_at DESC, unit_id DESC) AS rank FROM meta QUALIFY rank <= 3")
def prune_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest_configurations(catalog.index_meta(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("replace_partition", f"""WITH {_NAMED}, {_VERSIONED} SELECT * FROM versioned WHERE NOT (pkg = 'brand-3' AND version = '1.3' AND unit_id = 'brand-3-1.3')
UNION ALL SELECT 'brand-3', 'Cat.New', name, '1.3', 'brand-3-1.3' FROM (SELECT DISTINCT name FROM versioned WHERE pkg = 'brand-4')""")
def replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.versioned(spark, sf_dir)
    new = rows.where("pkg = 'brand-4'").select("name").distinct().select(F.lit("brand-3").alias("pkg"), F.lit("Cat.New").alias("mod"), "name", F.lit("1.3").alias("version"), F.lit("brand-3-1.3").alias("unit_id"))
    return store.replaced_entry(rows, {"pkg": "brand-3", "version": "1.3", "unit_id": "brand-3-1.3"}, new)


@query("fingerprint_upsert", f"""WITH {_META}, old AS (SELECT unit_id, indexed_at, 'f' || unit_id AS fingerprint FROM meta WHERE unit_id % 2 = 0),
new AS (SELECT unit_id, 'g' || unit_id AS fp FROM meta WHERE unit_id % 3 = 0)
SELECT unit_id, coalesce(indexed_at, 0) AS indexed_at, coalesce(fp, fingerprint) AS fingerprint FROM old FULL JOIN new USING (unit_id)""")
def fingerprint_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = catalog.index_meta(spark, sf_dir)
    old = meta.where("unit_id % 2 = 0").select("unit_id", "indexed_at", F.concat(F.lit("f"), F.col("unit_id").cast("string")).alias("fingerprint"))
    new = meta.where("unit_id % 3 = 0").select("unit_id", F.concat(F.lit("g"), F.col("unit_id").cast("string")).alias("fingerprint"))
    return store.upserted(old, new, ["unit_id"], "fingerprint", indexed_at=0)


@query("kv_upsert", "SELECT event_type AS k, arg_max(props, event_id) AS v FROM events GROUP BY 1")
def kv_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = catalog.table(spark, sf_dir, "events")
    return store.last_values(events.select(F.col("event_type").alias("k"), F.col("props").alias("v"), F.col("event_id").alias("seq")))


@query("fresh_units", """SELECT user_id AS unit, bool_and(event_id % 7 <> 0 AND event_type <> 'error') AS fresh, count(*) AS components FROM events GROUP BY 1""")
def fresh_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = catalog.table(spark, sf_dir, "events")
    units = events.select(F.col("user_id").alias("unit"), F.col("event_id").alias("component"), F.when(F.col("event_type") != "error", "x").alias("fingerprint"))
    stored = events.where("event_id % 7 <> 0").select(F.col("event_id").alias("component"), F.lit("x").alias("fingerprint"))
    return store.all_fresh(units, stored)


@query("row_anomalies", f"""WITH {_NAMED}, {_symbols()}, raw AS (SELECT component, module, name, signature, CASE WHEN length(name) % 4 = 0 THEN 'odd' ELSE visibility END AS visibility,
  CASE WHEN length(name) % 5 = 0 THEN '' ELSE def_component END AS def_component FROM symbols)
SELECT component, module, name, signature, CASE WHEN visibility IN ('exposed', 'internal') THEN visibility ELSE 'internal' END AS visibility,
  CASE WHEN def_component = '' THEN component ELSE def_component END AS def_component,
  CASE WHEN visibility NOT IN ('exposed', 'internal') THEN 'unknown_visibility' WHEN def_component = '' THEN 'empty_definition' END AS anomaly FROM raw""")
def row_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = catalog.symbols(spark, sf_dir).withColumns({
        "visibility": F.when(F.length("name") % 4 == 0, "odd").otherwise(F.col("visibility")), "def_component": F.when(F.length("name") % 5 == 0, "").otherwise(F.col("def_component")),
    })  # fmt: skip
    return store.decoded(raw.drop("def_module"))


# -- graph --------------------------------------------------------------------------------


@query("forward_deps", f"WITH {_DEPS} SELECT pkg, pos, dep_pkg FROM deps WHERE pkg = 1999")
def forward_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.forward(catalog.unit_deps(spark, sf_dir), 1999)


@query("reverse_deps", f"WITH {_DEPS} SELECT DISTINCT pkg FROM deps WHERE dep_pkg = 100")
def reverse_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse(catalog.unit_deps(spark, sf_dir), 100)


@query("deps_truncated", f"WITH {_DEPS} SELECT pkg, pos, dep_pkg FROM deps WHERE pkg = 1999 ORDER BY pos LIMIT 1")
def deps_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.forward(catalog.unit_deps(spark, sf_dir), 1999, limit=1)


_CLOSURE = f"""WITH RECURSIVE {_DEPS}, walk(pkg, level) AS (
  SELECT CAST(199 AS BIGINT), 0 UNION SELECT d.dep_pkg, w.level + 1 FROM walk w JOIN deps d ON d.pkg = w.pkg
) SELECT pkg, min(level) AS level FROM walk GROUP BY pkg HAVING min(level) > 0"""


@query("dependency_closure", _CLOSURE)
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(catalog.unit_deps(spark, sf_dir), spark.createDataFrame([(199,)], "pkg long"))


@query("dependency_closure_recursive", _CLOSURE)
def dependency_closure_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.recursive_levels(catalog.unit_deps(spark, sf_dir), spark.createDataFrame([(199,)], "pkg long"))


@query("topological_levels", f"""WITH RECURSIVE {_DEPS}, walk(pkg, level) AS (
  SELECT p_partkey, 0 FROM part WHERE p_partkey = 0 UNION SELECT d.pkg, w.level + 1 FROM walk w JOIN deps d ON d.dep_pkg = w.pkg
) SELECT pkg, max(level) AS level FROM walk GROUP BY pkg""")
def topological_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(catalog.unit_deps(spark, sf_dir), catalog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pkg")))


# -- resolution ---------------------------------------------------------------------------


def _fixpoint_sql(rounds: int = 16) -> str:
    """Rounds written out, each resolving what the one before supplies; modules import what is at
    most half their number, so a chain has no more links than the number has binary digits."""
    out = [f"WITH {_MODULES}, wanted AS (SELECT DISTINCT module, name FROM exported), k0 AS MATERIALIZED (SELECT DISTINCT module, name, module AS definer, 0 AS round FROM decls)"]
    for n in range(1, rounds + 1):
        out.append(f"""k{n} AS MATERIALIZED (
          SELECT * FROM k{n - 1} UNION ALL
          SELECT w.module, w.name, arg_min(k.definer, i.open * 1000000000 + i.target), {n}
          FROM wanted w JOIN imports i ON i.module = w.module AND i.name = w.name AND i.target <> i.module JOIN k{n - 1} k ON k.module = i.target AND k.name = w.name
          WHERE NOT EXISTS (SELECT 1 FROM k{n - 1} h WHERE h.module = w.module AND h.name = w.name) GROUP BY w.module, w.name)""")
    return ", ".join(out) + f" SELECT w.module, w.name, k.definer, k.round FROM wanted w LEFT JOIN k{rounds} k ON k.module = w.module AND k.name = w.name"


@query("reexport_fixpoint", _fixpoint_sql())
def reexport_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve_exports(catalog.exported(spark, sf_dir), catalog.declarations(spark, sf_dir), catalog.imports(spark, sf_dir)).withColumn("name", F.col("name").cast("long"))


_PROBE = f"""WITH {_NAMED}, {_symbols()}, asks AS (SELECT DISTINCT component AS asker, 'Cat.Small' AS module, name FROM symbols WHERE module = 'Cat.Promo'),
deps AS (SELECT DISTINCT a.component AS asker, b.component AS presenter FROM symbols a JOIN symbols b ON a.component < b.component AND right(a.component, 1) = right(b.component, 1)
         UNION SELECT DISTINCT component, component FROM symbols),
hits AS (SELECT a.asker, a.module, a.name, s.def_component, s.def_module, s.component AS presenter FROM asks a JOIN symbols s USING (module, name) JOIN deps d ON d.asker = a.asker AND d.presenter = s.component),
probed AS (SELECT asker, module, name, min(def_component) AS chosen, count(DISTINCT (def_component, def_module, presenter)) - 1 AS n_rejected FROM hits GROUP BY ALL)"""


def _probe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = catalog.symbols(spark, sf_dir)
    asks = rows.where("module = 'Cat.Promo'").select(F.col("component").alias("asker"), F.lit("Cat.Small").alias("module"), "name").distinct()
    one = rows.select("component", F.right("component", F.lit(1)).alias("tail")).distinct()
    deps = one.select(F.col("component").alias("pkg"), "tail").join(one.select(F.col("component").alias("dep_pkg"), "tail"), "tail").where("pkg < dep_pkg").select("pkg", "dep_pkg")
    exports = rows.select("module", "name", F.col("component").alias("presenter"), "def_component", "def_module")
    return asks, resolve.probe_exports(asks, exports, deps)


@query("export_probe", f"{_PROBE} SELECT asker, module, name, chosen, CAST(n_rejected AS BIGINT) AS n_rejected FROM probed")
def export_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir)[1].select("asker", "module", "name", F.col("chosen.def_component").alias("chosen"), F.size("rejected").cast("long").alias("n_rejected"))


@query("ambiguous_exports", f"{_PROBE} SELECT asker, module, name, CAST(n_rejected AS BIGINT) AS n_rejected FROM probed WHERE n_rejected > 0")
def ambiguous_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probe(spark, sf_dir)[1].where("size(rejected) > 0").select("asker", "module", "name", F.size("rejected").cast("long").alias("n_rejected"))


@query("unresolved_exports", f"{_PROBE} SELECT asker, module, name FROM asks ANTI JOIN probed USING (asker, module, name)")
def unresolved_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks, found = _probe(spark, sf_dir)
    return asks.join(found, ["asker", "module", "name"], "left_anti")


_CHAIN = f"""WITH {_MODULES}, asks AS (SELECT DISTINCT module, name FROM exported), d AS (SELECT DISTINCT module, name FROM decls),
step AS (SELECT i.module, i.name, i.target, min(i.open) AS open FROM imports i JOIN exported e ON e.module = i.target AND e.name = i.name WHERE i.target <> i.module GROUP BY ALL),
r0 AS (SELECT module, name, module AS at, 0 AS open FROM asks),
r1 AS (SELECT r.module, r.name, s.target AS at, min(s.open) AS open FROM r0 r JOIN step s ON s.module = r.at AND s.name = r.name GROUP BY ALL),
r2 AS (SELECT r.module, r.name, s.target AS at, min(s.open) AS open FROM r1 r JOIN step s ON s.module = r.at AND s.name = r.name GROUP BY ALL),
r3 AS (SELECT r.module, r.name, s.target AS at, min(s.open) AS open FROM r2 r JOIN step s ON s.module = r.at AND s.name = r.name GROUP BY ALL),
rings AS (SELECT 0 AS hop, * FROM r0 UNION ALL SELECT 1, * FROM r1 UNION ALL SELECT 2, * FROM r2 UNION ALL SELECT 3, * FROM r3),
hits AS (SELECT r.module, r.name, r.hop, r.at AS definer, row_number() OVER (PARTITION BY r.module, r.name ORDER BY r.hop, r.open, r.at) AS place FROM rings r JOIN d ON d.module = r.at AND d.name = r.name),
beyond AS (SELECT DISTINCT r.module, r.name FROM r3 r JOIN step s ON s.module = r.at AND s.name = r.name ANTI JOIN rings k ON k.module = r.module AND k.name = r.name AND k.at = s.target)
SELECT a.module, a.name, h.hop, h.definer, CASE WHEN h.hop IS NOT NULL THEN 'found' WHEN b.name IS NOT NULL THEN 'stopped_at_bound' ELSE 'exhausted' END AS verdict
FROM asks a LEFT JOIN hits h ON h.module = a.module AND h.name = a.name AND h.place = 1 LEFT JOIN beyond b ON b.module = a.module AND b.name = a.name"""


@query("bounded_chain", _CHAIN)
def bounded_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    exported = catalog.exported(spark, sf_dir)
    return resolve.followed_chain(exported, catalog.declarations(spark, sf_dir), exported, catalog.imports(spark, sf_dir)).withColumn("name", F.col("name").cast("long"))


@query("bounded_chain_all", f"SELECT module, name, hop FROM ({_CHAIN})")
def bounded_chain_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_chain(spark, sf_dir).select("module", "name", "hop")


@query("oracle_repair", f"""{_PROBE}, missing AS (SELECT asker, module, name FROM asks ANTI JOIN probed USING (asker, module, name)),
origins(pos, origin) AS (VALUES (0, 'Cat.Large'), (1, 'Cat.Medium')),
fixes AS (SELECT m.asker, m.module, m.name, o.origin, o.pos FROM missing m, origins o WHERE EXISTS (
  SELECT 1 FROM symbols s JOIN deps d ON d.presenter = s.component WHERE s.module = o.origin AND s.name = m.name AND d.asker = m.asker))
SELECT asker, module, name, arg_min(origin, pos) AS target FROM fixes GROUP BY ALL""")
def oracle_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.symbols(spark, sf_dir)
    asks, found = _probe(spark, sf_dir)
    missing = asks.join(found, ["asker", "module", "name"], "left_anti")
    origins = missing.select("module", "name").distinct().select("module", "name", F.posexplode(F.array(F.lit("Cat.Large"), F.lit("Cat.Medium"))).alias("pos", "origin_module"))
    one = rows.select("component", F.right("component", F.lit(1)).alias("tail")).distinct()
    deps = one.select(F.col("component").alias("pkg"), "tail").join(one.select(F.col("component").alias("dep_pkg"), "tail"), "tail").where("pkg < dep_pkg")
    exports = rows.select("module", "name", F.col("component").alias("presenter"), "def_component", "def_module")
    return resolve.repaired(missing, origins, exports, deps)[0].select("asker", "module", "name", "target")


# -- scalar functions ---------------------------------------------------------------------


@query("strip_tags", r"SELECT page_id, md5(regexp_replace(html, '<[^>]*(>|$)', '', 'gs')) AS plain FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("plain"))


@query("decode_entities", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) AS decoded FROM pages")
def decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "pages").select("page_id", F.md5(text.decode_entities(F.col("html"))).alias("decoded"))


_LINKED = """<a class="x" href="../cat-1.0/A.html">1</a><a href='src/B.html#l'>2</a><img alt="a>b" src="logo.html"><a href="Data-Map-Strict.html#v:x">3</a><a href="#top">4</a><a href="mailto:a@b">5</a><a href="doc-index.html">6</a><a href="../up/C.html">7</a><link href="src/no">"""
_RELINKED = """<a class="x" href="/haddock/cat-1.0/A.html">1</a><a href='/haddock/cat-2.0/src/B.html#l'>2</a><img alt="a>b" src="/haddock/cat-2.0/logo.html"><a href="/pkg/cat:sub/Data.Map.Strict#v:x">3</a><a href="#top">4</a><a href="mailto:a@b">5</a><a href="/haddock/cat-2.0/doc-index.html">6</a><a href="../up/C.html">7</a><link href="src/no">"""


@query("rewrite_links", f"""SELECT page_id, md5(replace(html, 'href="/', 'href="/haddock/cat-2.0/src/') || '{_RELINKED.replace("'", "''")}') AS linked FROM pages""")
def rewrite_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every root-relative link of a page is made a relative one; then pages get links of each kind.
    page = F.concat(F.replace("html", F.lit('href="/'), F.lit('href="src/')), F.lit(_LINKED))
    return catalog.table(spark, sf_dir, "pages").select("page_id", F.md5(text.rewrite_links(page, "cat:sub", "cat-2.0")).alias("linked"))


_REF = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '-') || '-1.' || p_size ELSE replace(p_name, ' ', '-') END || CASE WHEN p_partkey % 5 = 0 THEN '-1.2.' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '-0123abcdef' ELSE '' END AS ref FROM part"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dashed = F.replace("p_name", F.lit(" "), F.lit("-"))
    ref = F.concat(F.when(F.col("p_partkey") % 3 == 0, F.concat(dashed, F.lit("-1."), F.col("p_size").cast("string"))).otherwise(dashed), F.when(F.col("p_partkey") % 5 == 0, "-1.2.").otherwise(""), F.when(F.col("p_partkey") % 2 == 0, "-0123abcdef").otherwise(""))
    return catalog.table(spark, sf_dir, "part").select("p_partkey", ref.alias("ref"))


@query("identifier_parse", f"""SELECT p_partkey, CASE WHEN regexp_matches(b, '^.+-[0-9.]+$') THEN regexp_extract(b, '^(.+)-([0-9.]+)$', 1) ELSE b END AS name,
  CASE WHEN regexp_matches(b, '^.+-[0-9.]+$') THEN regexp_extract(b, '^(.+)-([0-9.]+)$', 2) END AS version
FROM (SELECT p_partkey, regexp_replace(ref, '^(.+)-[0-9A-Fa-f]{{8,}}$', '\\1') AS b FROM ({_REF}))""")
def identifier_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir).withColumn("r", ident.package_ref(F.col("ref"))).select("p_partkey", "r.name", "r.version")


_PATHS = f"""{_NAMED}, paths AS (SELECT DISTINCT component AS c, module AS m, name AS n, p_size % 9 AS k FROM named), given AS (
  SELECT *, CASE k WHEN 0 THEN c || '-1.2/' || m || '/' || n WHEN 1 THEN c WHEN 2 THEN c || '/' || m WHEN 3 THEN c || '//' || n WHEN 4 THEN c || '/'
    WHEN 5 THEN c || '/' || n WHEN 6 THEN c || '/' || m || '/' WHEN 7 THEN c || '@1/' || m ELSE c || '/' || m || '/' || n || '/more' END AS path FROM paths
)"""


@query("symbol_path_parse", f"""WITH {_PATHS} SELECT DISTINCT path,
  CASE k WHEN 3 THEN 'symbol_without_module' WHEN 4 THEN 'invalid_module' WHEN 5 THEN 'module_not_uppercase' WHEN 6 THEN 'invalid_symbol' WHEN 7 THEN 'invalid_package' END AS error,
  CASE WHEN k IN (0, 1, 2, 8) THEN regexp_extract(c, '^(.*?)(-[0-9]+)?$', 1) END AS package,
  CASE k WHEN 0 THEN '1.2' WHEN 1 THEN regexp_extract(c, '[0-9]+$') WHEN 2 THEN regexp_extract(c, '[0-9]+$') WHEN 8 THEN regexp_extract(c, '[0-9]+$') END AS version,
  CASE WHEN k IN (0, 2, 8) THEN m END AS module, CASE WHEN k IN (0, 8) THEN n END AS symbol FROM given WHERE k > 0
UNION SELECT DISTINCT path, NULL, c, '1.2', m, n FROM given WHERE k = 0 UNION ALL SELECT '', 'empty_input', NULL, NULL, NULL, NULL""")
def symbol_path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m, n, k = F.col("component"), F.col("module"), F.col("name"), F.col("p_size") % 9
    join = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))  # noqa: E731
    path = F.when(k == 0, join(c, "-1.2/", m, "/", n)).when(k == 1, c).when(k == 2, join(c, "/", m)).when(k == 3, join(c, "//", n)).when(k == 4, join(c, "/"))
    path = path.when(k == 5, join(c, "/", n)).when(k == 6, join(c, "/", m, "/")).when(k == 7, join(c, "@1/", m)).otherwise(join(c, "/", m, "/", n, "/more"))
    rows = catalog._named(spark, sf_dir).select(path.alias("path")).distinct().unionByName(spark.createDataFrame([("",)], "path string"))
    return rows.select("path", ident.symbol_path(F.col("path")).alias("p")).select("path", "p.*")


@query("component_parse", """SELECT p_partkey, p_brand AS package, CASE p_partkey % 6 WHEN 1 THEN 'sublib' WHEN 2 THEN 'exe' WHEN 5 THEN 'sublib' ELSE 'lib' END AS kind,
  CASE p_partkey % 6 WHEN 1 THEN lower(p_type) WHEN 2 THEN lower(p_type) WHEN 5 THEN 'a:' || lower(p_type) END AS name,
  CASE p_partkey % 6 WHEN 1 THEN p_brand || ':' || lower(p_type) WHEN 2 THEN p_brand || ':exe:' || lower(p_type) WHEN 5 THEN p_brand || ':a:' || lower(p_type) ELSE p_brand END AS again FROM part""")
def component_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, low = F.col("p_partkey") % 6, F.lower("p_type")
    tail = F.when(k == 0, "").when(k == 1, F.concat(F.lit(":"), low)).when(k == 2, F.concat(F.lit(":exe:"), low)).when(k == 3, ":").when(k == 4, ":exe:").otherwise(F.concat(F.lit(":a:"), low))
    rows = catalog.table(spark, sf_dir, "part").withColumn("c", ident.component_key(F.concat("p_brand", tail)))
    return rows.select("p_partkey", "c.package", "c.kind", "c.name", ident.component_text(F.col("c")).alias("again"))


@query("qualified_split", f"WITH {_NAMED} SELECT DISTINCT module, name, module || '.' || name AS qualified FROM named")
def qualified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog._named(spark, sf_dir).select(F.concat("module", F.lit("."), "name").alias("qualified")).distinct()
    return rows.select(ident.qualified_name(F.col("qualified")).alias("q"), "qualified").select("q.module", "q.name", "qualified")


@query("origin_split", f"""WITH {_NAMED}, e AS (SELECT DISTINCT module AS m, name AS n, p_size % 6 AS k FROM named)
SELECT DISTINCT CASE k WHEN 0 THEN m || '.' || n WHEN 1 THEN m || '.||' WHEN 2 THEN m || '|' WHEN 3 THEN n WHEN 4 THEN m || '..>>.' ELSE m END AS entry,
  CASE k WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 5 THEN regexp_replace(m, '[.][^.]*$', '') ELSE m END AS module,
  CASE k WHEN 0 THEN n WHEN 1 THEN '||' WHEN 2 THEN NULL WHEN 3 THEN n WHEN 4 THEN '.>>.' ELSE regexp_extract(m, '[^.]*$') END AS name FROM e""")
def origin_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n, k = F.col("module"), F.col("name"), F.col("p_size") % 6
    entry = F.when(k == 0, F.concat(m, F.lit("."), n)).when(k == 1, F.concat(m, F.lit(".||"))).when(k == 2, F.concat(m, F.lit("|"))).when(k == 3, n).when(k == 4, F.concat(m, F.lit("..>>."))).otherwise(m)
    rows = catalog._named(spark, sf_dir).select(entry.alias("entry")).distinct()
    return rows.select("entry", ident.origin_name(F.col("entry")).alias("o")).select("entry", "o.module", "o.name")


_ORDERED = "SELECT pkg, version, row_number() OVER (PARTITION BY pkg ORDER BY {order}) AS place FROM (SELECT DISTINCT pkg, version FROM versioned)"


_LONG = "SELECT DISTINCT pkg, CASE WHEN version LIKE '1.%' THEN '2024010112000' || version ELSE version END AS version FROM versioned"


@query("version_numeric_desc", f"WITH {_NAMED}, {_VERSIONED} SELECT pkg, version, row_number() OVER (PARTITION BY pkg ORDER BY list_transform(string_split(version, chr(46)), lambda x: CAST(x AS HUGEINT)) DESC) AS place FROM ({_LONG})")
def version_numeric_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("version").startswith("1."), F.concat(F.lit("2024010112000"), "version")).otherwise(F.col("version"))
    rows = catalog.versioned(spark, sf_dir).select("pkg", version.alias("version")).distinct()
    place = F.row_number().over(Window.partitionBy("pkg").orderBy(F.desc("numbers")))
    return rows.withColumn("numbers", ident.version_numbers(F.col("version"))).select("pkg", "version", place.cast("long").alias("place"))


@query("version_text_desc", f"WITH {_NAMED}, {_VERSIONED} {_ORDERED.format(order='version DESC')}")
def version_text_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.versioned(spark, sf_dir).select("pkg", "version").distinct()
    return rows.select("pkg", "version", F.row_number().over(Window.partitionBy("pkg").orderBy(F.desc("version"))).cast("long").alias("place"))


@query("percent_encode", "SELECT p_partkey, replace(p_name, ' ', '%20') || ':@&=+$,~-_.%2A%2F%3F' || replace(p_brand, '#', '%23') AS encoded FROM part")
def percent_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "part").select("p_partkey", text.percent_encoded(F.concat("p_name", F.lit(":@&=+$,~-_.*/?"), "p_brand")).alias("encoded"))


_WORDS = "CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN 'a=' || replace(p_name, ' ', '+') WHEN 3 THEN 'it' || chr(39) || 's' ELSE '' END"


@query("shell_quote", f"""SELECT p_partkey, CASE WHEN regexp_matches({_WORDS}, '^[A-Za-z0-9_./:@-]+$') THEN {_WORDS} ELSE chr(39) || replace({_WORDS}, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) END AS quoted FROM part""")
def shell_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, k = F.col("p_name"), F.col("p_partkey") % 5
    word = F.when(k == 0, name).when(k == 1, F.replace(name, F.lit(" "), F.lit("_"))).when(k == 2, F.concat(F.lit("a="), F.replace(name, F.lit(" "), F.lit("+")))).when(k == 3, "it's").otherwise("")
    return catalog.table(spark, sf_dir, "part").select("p_partkey", text.shell_quoted(word).alias("quoted"))


@query("proximity_rank", f"""WITH {_NAMED}, {_symbols()}, s AS (SELECT DISTINCT name, module FROM symbols), a AS (SELECT name, min(module) AS asking FROM s GROUP BY name)
SELECT name, asking, module AS candidate, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN module = asking THEN 9 WHEN split_part(module, '.', 2) = split_part(asking, '.', 2) THEN 2 ELSE 1 END DESC, module) AS place FROM s JOIN a USING (name)""")
def proximity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.symbols(spark, sf_dir).groupBy("name").agg(F.min("module").alias("asking"), F.collect_set("module").alias("candidates"))
    near = F.array_sort(F.transform("candidates", lambda c: F.struct((-ident.shared_leading(F.col("asking"), c)).alias("far"), c.alias("candidate"))))
    return rows.select("name", "asking", F.posexplode(near).alias("pos", "x")).select("name", "asking", "x.candidate", (F.col("pos") + 1).cast("long").alias("place"))


@query("numbered_lines", r"""SELECT doc_id, i AS line, md5(l) AS digest FROM (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS i
FROM (SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS s FROM documents))""")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("pos", "l")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line"), F.md5("l").alias("digest"))


_LINES = r"(SELECT doc_id, string_split(regexp_replace(text, '\n\z', ''), chr(10)) AS s FROM documents)"


@query("line_window", f"SELECT doc_id, md5(array_to_string(s[greatest(1, least(5, len(s))):greatest(1, least(35, len(s)))], '|')) AS digest FROM {_LINES}")
def line_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.lines(F.col("text"))
    return catalog.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(text.window_around(rows, F.lit(20)), "|")).alias("digest"))


@query("clamped_slice", f"SELECT doc_id, md5(array_to_string(s[least(3, len(s)):least(7, len(s))], '|')) AS digest, len(s) > 4 AS cut FROM {_LINES}")
def clamped_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.lines(F.col("text"))
    return catalog.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(F.array_join(text.clamped_slice(rows, F.lit(3), F.lit(7)), "|")).alias("digest"), (F.size(text.limited_lines(rows, 4)) == 5).alias("cut")
    )


@query("signature_split", f"WITH {_NAMED}, {_symbols()} SELECT component, module, visibility, split_part(signature, ' :: ', 1) AS name, split_part(signature, ' :: ', 2) AS type FROM symbols")
def signature_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.symbols(spark, sf_dir).withColumn("s", text.split_signature(F.col("signature"))).select("component", "module", "visibility", "s.name", F.col("s.signature").alias("type"))


@query("plan_hash", f"WITH {_NAMED}, {_VERSIONED} SELECT sha256(string_agg(l || chr(10), '' ORDER BY l)) AS plan_hash FROM (SELECT DISTINCT pkg || '-' || version AS l FROM versioned)")
def plan_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.plan_hash(catalog.versioned(spark, sf_dir).select("pkg", "version").distinct())


@query("tree_fingerprint", "SELECT page_id // 64 AS component, sha256(string_agg(url || chr(0) || page_id || chr(0) || length(html) || chr(10), '' ORDER BY url, CAST(page_id AS VARCHAR))) AS fingerprint FROM pages GROUP BY 1")
def tree_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = catalog.table(spark, sf_dir, "pages")
    return hashing.tree_fingerprints(pages.select(F.expr("page_id div 64").alias("component"), F.col("url").alias("path"), F.col("page_id").alias("mtime"), F.length("html").alias("size")))


@query("local_fingerprint", """SELECT unit, sha256(string_agg(url || chr(0) || page_id || chr(0) || length(html) || chr(10), '' ORDER BY url, CAST(page_id AS VARCHAR))) AS fingerprint
FROM (SELECT *, regexp_extract(url, '://([^/?#]*)', 1) AS unit FROM pages) WHERE unit NOT LIKE '%.org' GROUP BY unit""")
def local_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A host is a unit; those under one domain come from elsewhere, the others are local."""
    pages = catalog.table(spark, sf_dir, "pages").withColumn("unit", F.regexp_extract("url", "://([^/?#]*)", 1)).where("NOT endswith(unit, '.org')")
    return hashing.tree_fingerprints(pages.select("unit", F.col("url").alias("path"), F.col("page_id").alias("mtime"), F.length("html").alias("size")), by="unit")


@query("inputs_fingerprint", "SELECT p_partkey, sha256('v2' || chr(0) || p_name || chr(0) || p_brand || chr(0) || chr(0) || array_to_string(list_transform(list_sort(string_split(p_name, ' ')), lambda x: x || ','), '') || chr(0)) AS fingerprint FROM part")
def inputs_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = hashing.list_part(F.split("p_name", " "))
    return catalog.table(spark, sf_dir, "part").select("p_partkey", hashing.inputs_fingerprint(F.col("p_name"), F.col("p_brand"), F.lit(None), deps).alias("fingerprint"))


@query("cache_key", "SELECT page_id, 'remote:v2:' || sha256(url) AS key FROM pages")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "pages").select("page_id", hashing.query_key(F.col("url"), "remote:v2:").alias("key"))


@query("http_freshness", """SELECT event_id, event_type = 'view' OR epoch_us(TIMESTAMP '2024-01-16 00:00:00.5') - epoch_us(ts) < 900000 * 1000000::BIGINT AS fresh FROM events""")
def http_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "immutable").otherwise("mutable")
    fresh = hashing.is_fresh(kind, F.col("ts"), F.lit("2024-01-16 00:00:00.5").cast("timestamp"), F.lit(900000))
    return catalog.table(spark, sf_dir, "events").select("event_id", fresh.alias("fresh"))


@query("http_dates", "SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS said, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS back FROM events")
def http_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = hashing.http_date(F.col("ts"))
    return catalog.table(spark, sf_dir, "events").select("event_id", said.alias("said"), F.unix_timestamp(hashing.from_http_date(said)).alias("back"))


@query("json_decode", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '' AS module FROM events")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.from_json("props", "k int, module struct<name:string>")
    return catalog.table(spark, sf_dir, "events").select("event_id", hit["k"].alias("k"), F.coalesce(hit["module"]["name"], F.lit("")).alias("module"))


@query("json_keys", f"WITH {_NAMED}, {_VERSIONED} SELECT pkg, version, row_number() OVER (PARTITION BY pkg ORDER BY list_transform(string_split(version, chr(46)), lambda x: CAST(x AS INT)) DESC) AS place FROM (SELECT DISTINCT pkg, version FROM versioned)")
def json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.versioned(spark, sf_dir).groupBy("pkg").agg(F.collect_set("version").alias("v"))
    body = F.to_json(F.map_from_arrays("v", F.transform("v", lambda v: F.when(v.startswith("1"), "deprecated").otherwise("normal"))))
    return packages.known_versions(rows.select("pkg", body.alias("body"))).withColumn("place", F.col("place").cast("long"))


@query("select_fields", """SELECT p_partkey, '{"name":"' || p_name || '","size":' || p_size || '}' AS result, 'nope' AS unmatched FROM part""")
def select_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_plan.selected_fields(_fields(spark, sf_dir), "p_partkey", ["name", "size", "nope"])


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_brand").alias("brand"))


@query("field_sets", """SELECT p_partkey, k, CASE k WHEN 'all' THEN '{"name":"' || p_name || '","size":' || p_size || ',"brand":"' || p_brand || '"}' WHEN 'compact' THEN '{"name":"' || p_name || '","brand":"' || p_brand || '"}'
  WHEN 'picked' THEN '{"brand":"' || p_brand || '"}' ELSE '{}' END AS result, CASE k WHEN 'picked' THEN 'size' WHEN 'missed' THEN 'size,sig' ELSE '' END AS unmatched FROM part, (SELECT unnest(['all', 'compact', 'picked', 'missed']) AS k)""")
def field_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = _fields(spark, sf_dir), None
    for name, asked, keep in (("all", [], None), ("compact", [], ["name", "brand"]), ("picked", ["size", "brand"], ["name", "brand"]), ("missed", ["size", "sig"], ["name", "brand"])):
        one = build_plan.selected_fields(rows, "p_partkey", asked, keep).withColumn("k", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("result_envelope", """SELECT p_partkey, CASE WHEN p_size > 25 THEN '{"result":{"name":"' || p_name || '"},"outside_plan":true}' ELSE '{"result":{"name":"' || p_name || '"}}' END AS envelope FROM part""")
def result_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = catalog.table(spark, sf_dir, "part")
    return part.select("p_partkey", build_plan.envelope(F.struct(F.col("p_name").alias("name")), F.col("p_size") > 25).alias("envelope"))


_CONDITIONS = {
    "os(linux)": "true", "OS( windows )": "false", "!os(linux)": "false", "flag(x)": "NULL", "impl(ghc >= 9 && < 10)": "NULL", "os(linux) && flag(x)": "NULL", "os(osx) && flag(x)": "false",
    "flag(x) && os(osx)": "false", "os(linux) || flag(x)": "true", "flag(x) || os(osx)": "NULL", "os(osx) || os(linux) && arch(x86_64)": "true", "(os(osx) || os(linux)) && arch(arm)": "false",
    "!(os(linux) && flag(x))": "NULL", "!(flag(x) && arch(arm)) && true": "true", "!!os(linux)": "true", "false || !flag(x) || arch(X86_64)": "true", "os(linux) && (flag(a) || (flag(b) && false))": "NULL", "mystery": "NULL",
}


@query("kleene_conditions", f"""WITH c(k, cond, v) AS (VALUES {", ".join(f"({k}, '{c}', {v})" for k, (c, v) in enumerate(_CONDITIONS.items()))})
SELECT p_partkey, cond, branch, v AS value FROM part JOIN c ON k = p_partkey % {len(_CONDITIONS)}, (SELECT unnest(['then', 'else']) AS branch)
WHERE CASE branch WHEN 'then' THEN coalesce(v, true) ELSE coalesce(NOT v, true) END""")
def kleene_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cond = F.get(F.lit(list(_CONDITIONS)), (F.col("p_partkey") % len(_CONDITIONS)).cast("int"))
    rows = catalog.table(spark, sf_dir, "part").select("p_partkey", cond.alias("text")).withColumn("cond", packages.condition_value(F.col("text"), "linux", "x86_64"))
    live = build_plan.live_branches(rows.withColumn("branch", F.explode(F.array(F.lit("then"), F.lit("else")))))
    return live.select("p_partkey", F.col("text").alias("cond"), "branch", F.col("cond").alias("value"))


@query("library_last_units", """SELECT p_brand AS pkg, arg_max(p_partkey, (p_size % 2 = 0)::INT * 1000000000 + p_partkey) AS unit_id FROM part GROUP BY 1""")
def library_last_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = catalog.table(spark, sf_dir, "part").select(F.col("p_brand").alias("pkg"), F.col("p_partkey").alias("unit_id"), (F.col("p_size") % 2 == 0).alias("has_lib"), F.col("p_partkey").alias("pos"))
    return build_plan.library_last(units).select("pkg", "unit_id")


@query("environment_compose", """SELECT p_brand AS pkg, coalesce(max(CASE WHEN p_size < 10 THEN p_name END), max(CASE WHEN p_size > 40 THEN p_name END)) AS location,
  CASE WHEN bool_or(p_size < 10) THEN 'c-1' ELSE 'c-2' END AS compiler FROM part WHERE p_size < 10 OR p_size > 40 GROUP BY 1""")
def environment_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = catalog.table(spark, sf_dir, "part")
    side = lambda rows, compiler: rows.groupBy(F.col("p_brand").alias("pkg")).agg(F.max("p_name").alias("location")).withColumn("compiler", F.lit(compiler))  # noqa: E731
    return build_plan.composed_environments(side(part.where("p_size < 10"), "c-1"), side(part.where("p_size > 40"), "c-2"))


@query("section_lines", r"""WITH l AS (SELECT doc_id, i, s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
g AS (SELECT *, sum(CASE WHEN starts_with(s, 'T') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, min(i) - 1 AS first_pos, md5(arg_min(s, i)) AS head FROM g GROUP BY 1, 2""")
def section_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    numbered = build_plan.sections(rows, "doc_id", F.col("line").startswith("T"))
    return numbered.groupBy("doc_id", F.col("section").cast("long").alias("section")).agg(F.min("pos").cast("long").alias("first_pos"), F.md5(F.min_by("line", "pos")).alias("head"))


@query("section_lines_all", r"""WITH l AS (SELECT doc_id, i, s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
g AS (SELECT *, sum(CASE WHEN starts_with(s, 'T') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
SELECT doc_id, CAST(section AS BIGINT) AS section, count(*) AS n FROM g GROUP BY 1, 2""")
def section_lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return build_plan.sections(rows, "doc_id", F.col("line").startswith("T")).groupBy("doc_id", F.col("section").cast("long").alias("section")).agg(F.count("*").alias("n"))


# -- markup, declarations and package sources -----------------------------------------------


@query("div_slice", """SELECT page_id, md5(html) AS inside, regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') AS ad FROM pages""")
def div_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Whole pages, with their own divisions, inside a named one; and the first division of a page.
    page = F.concat(F.lit('<p><div class="x"></div><div id="main">'), "html", F.lit("</div><div>after</div>"))
    named = F.replace("html", F.lit('<div class="ad">'), F.lit('<div class="ad" id="ad">'))
    return catalog.table(spark, sf_dir, "pages").select("page_id", F.md5(markup.div_slice(page, "main")).alias("inside"), F.coalesce(markup.div_slice(named, "ad"), F.lit("")).alias("ad"))


@query("header_fields", r"""SELECT doc_id, source AS maintainer, 'MIT' AS license, 'spdx' AS license_form, lang || chr(10) || 'more' AS note, md5(nullif(trim('Prose.' || chr(10) || coalesce(text, ''), ' 	

'), '')) AS prose FROM documents""".replace(r"' \t\n\r\x0b\x0c'", "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"))
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("Maintainer : "), "source", F.lit("\nLicense : BSD\nSPDX-License-Identifier : MIT\nX-Note : "), "lang", F.lit("\n    more\n\nProse.\n"), F.coalesce("text", F.lit("")))
    rows = catalog.table(spark, sf_dir, "documents").select("doc_id", markup.header_fields(head).alias("h"))
    return rows.select("doc_id", "h.maintainer", "h.license", "h.license_form", F.col("h.extra")[0]["value"].alias("note"), F.md5("h.prose").alias("prose"))


# An answer is a declaration, some of them top-level; a third of the questions points back to the last of these.
@query("comment_association", """WITH c AS (SELECT *, CASE role WHEN 'assistant' THEN 'decl' WHEN 'user' THEN CASE WHEN length(text) % 3 = 0 THEN 'doc_prev' ELSE 'doc_next' END ELSE 'doc_next' END AS kind FROM conversations),
t AS (SELECT *, CASE kind WHEN 'decl' THEN turn
  WHEN 'doc_next' THEN min(CASE WHEN kind = 'decl' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  ELSE max(CASE WHEN kind = 'decl' AND turn % 4 > 1 THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS home FROM c)
SELECT conv_id AS module, home AS pos, md5(max(CASE WHEN kind = 'decl' THEN text END)) AS name, md5(string_agg(CASE WHEN kind <> 'decl' THEN text END, chr(10) ORDER BY turn)) AS doc FROM t WHERE home IS NOT NULL GROUP BY conv_id, home""")
def comment_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = (F.col("role") == "user") & (F.length("text") % 3 == 0)
    kind = F.when(F.col("role") == "assistant", "decl").when(back, "doc_prev").otherwise("doc_next")
    items = catalog.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("module"), F.col("turn").alias("pos"), kind.alias("kind"), "text", (F.col("turn") % 4 > 1).alias("top"))
    return declarations.documented(items).select("module", "pos", F.md5("name").alias("name"), F.md5("doc").alias("doc"))


@query("offline_answers", """WITH latest AS (SELECT user_id AS key, arg_max(props, event_id) AS body, max(event_id) AS stored_at FROM events GROUP BY 1)
SELECT c_custkey AS key, body, stored_at, CASE WHEN stored_at IS NULL THEN 'OFFLINE' END AS error FROM customer LEFT JOIN latest ON key = c_custkey""")
def offline_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = catalog.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("props").alias("body"), F.col("event_id").alias("stored_at"))
    return packages.offline_answers(catalog.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), cache)


@query("remote_hits", """SELECT event_id AS key, CASE WHEN user_id % 5 > 0 THEN 0 END AS pos, CASE WHEN user_id % 5 > 0 THEN event_type ELSE '' END AS pkg, '' AS mod,
CASE WHEN user_id % 5 > 0 THEN 'f' ELSE '' END AS item, '' AS docs, CASE WHEN user_id % 5 = 0 THEN 'CORRUPT' END AS error FROM events""")
def remote_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("user_id") % 5 > 0, F.concat(F.lit('[{"package":{"name":"'), "event_type", F.lit('"},"item":"f"}]'))).otherwise("{oops")
    return packages.decoded_hits(catalog.table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), body.alias("body")))


@query("installed_packages", "SELECT DISTINCT replace(p_name, ' ', '-') AS name, '1.' || p_size AS version FROM part WHERE p_partkey % 2 = 0")
def installed_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-1."), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "-0123456789abcdef").otherwise(""))
    return packages.installed_packages(catalog.table(spark, sf_dir, "part").select(entry.alias("entry")))


_VERSION = "'2.' || n_nationkey || CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.x.7' ELSE '.4.5' END"
_PATCH = "CASE n_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 4 END"


@query("macro_headers", f"""SELECT n_regionkey AS component, '/* synthesised from the build plan */' || chr(10) || '#define __GLASGOW_HASKELL__ 910' || chr(10) || '#define __GLASGOW_HASKELL_PATCHLEVEL1__ 3' || chr(10)
|| string_agg('/* package ' || n_name || '-' || {_VERSION} || ' */' || chr(10) || '#define VERSION_' || n_name || ' "' || {_VERSION} || '"' || chr(10) || '#define MIN_VERSION_' || n_name || '(major1,major2,minor) (' || chr(92) || chr(10)
|| '  (major1) <  2 || ' || chr(92) || chr(10) || '  (major1) == 2 && (major2) <  ' || n_nationkey || ' || ' || chr(92) || chr(10) || '  (major1) == 2 && (major2) == ' || n_nationkey || ' && (minor) <= ' || {_PATCH} || ')' || chr(10), '' ORDER BY n_name) AS header FROM nation GROUP BY 1""")
def macro_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    version = F.concat(F.lit("2."), k.cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, ".x.7").otherwise(".4.5"))
    rows = catalog.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("component"), F.col("n_name").alias("name"), version.alias("version"))
    return packages.macro_headers(rows, "9.10.3")


@query("page_entries", f"""WITH {_NAMED}, n AS (SELECT DISTINCT module, name FROM named), a AS (SELECT module, name, min(p_type) AS s FROM named WHERE p_size < 20 GROUP BY ALL),
b AS (SELECT module, name, min(component) AS s FROM named WHERE p_size > 30 GROUP BY ALL)
SELECT module, name, coalesce(a.s, b.s) AS signature, CASE WHEN a.s IS NOT NULL THEN 'index' WHEN b.s IS NOT NULL THEN 'import' ELSE 'placeholder' END AS origin
FROM n LEFT JOIN a USING (module, name) LEFT JOIN b USING (module, name)""")
def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog._named(spark, sf_dir)
    return declarations.entries(
        rows.select("module", "name").distinct(), rows.where("p_size < 20").select("module", "name", F.col("p_type").alias("signature")), rows.where("p_size > 30").select("module", "name", F.col("component").alias("signature"))
    )


@query("import_plausibility", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'explicit' END WHEN 2 THEN CASE WHEN p_size % 2 = 1 THEN 'open' END END AS how FROM part""")
def import_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    names = F.when(k > 0, F.when(k == 3, F.array().cast("array<string>")).when(F.col("p_size") % 2 == 0, F.array(F.lit("f"))).otherwise(F.array(F.lit("g"))))
    return catalog.table(spark, sf_dir, "part").select("p_partkey", declarations.could_import(names, F.when(k > 0, k == 2), F.lit("f")).alias("how"))


# More queries register themselves here: cascades over several sources, declarations, dumps.
from symbolarium import queries_cascade, queries_reach, queries_rows, queries_store  # noqa: E402, F401
