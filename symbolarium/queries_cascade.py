"""Further queries: cascades, errors, overrides, dumps, files, declarations and index building."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.functions import ident, text
from symbolarium.operators import cascade, declarations, graph, resolve, search
from symbolarium.plans import build_plan, index_build
from symbolarium.plans.lineage import shuffled
from symbolarium.queries import _DEPS, _MODULES, _NAMED, _PINS, _VERSIONED, _pins, _symbols, query
from symbolarium.sources import catalog, packages


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "part")


# -- cascades -----------------------------------------------------------------------------

_REFS = "refs AS (SELECT DISTINCT 'p' || p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '-9.' || p_size ELSE '' END AS ref, 'p' || p_partkey AS pkg, CASE WHEN p_partkey % 7 = 0 THEN '9.' || p_size END AS asked, p_partkey AS k, p_size FROM part)"


@query("package_cascade", f"""WITH {_REFS} SELECT ref, pkg,
  CASE WHEN asked IS NOT NULL THEN asked WHEN k % 4 = 0 THEN '1.' || p_size WHEN k % 4 = 1 THEN '2.0' WHEN k % 8 = 2 THEN '3.' || p_size END AS version,
  CASE WHEN asked IS NOT NULL THEN 'hackage' WHEN k % 4 = 0 THEN 'local' WHEN k % 4 = 1 OR k % 8 = 2 THEN 'hackage' END AS origin,
  CASE WHEN asked IS NOT NULL THEN false WHEN k % 4 = 0 THEN true WHEN k % 4 = 1 OR k % 8 = 2 THEN false END AS is_local,
  CASE WHEN asked IS NOT NULL THEN true WHEN k % 4 = 0 THEN false WHEN k % 4 = 1 OR k % 8 = 2 THEN true END AS outside_plan,
  CASE WHEN asked IS NOT NULL THEN 'asked' WHEN k % 4 = 0 THEN 'plan' WHEN k % 4 = 1 THEN 'store' WHEN k % 8 = 2 THEN 'remote' END AS found_in,
  CASE WHEN asked IS NOT NULL OR k % 4 < 2 OR k % 8 = 2 THEN NULL WHEN k % 8 = 6 THEN 'CORRUPTION' WHEN k % 8 = 3 THEN 'NETWORK_ERROR' ELSE 'NOT_FOUND' END AS error FROM refs""")
def package_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, pkg, size = F.col("p_partkey"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")), F.col("p_size").cast("string")
    part = _part(spark, sf_dir)
    asks = part.select(F.concat(pkg, F.when(k % 7 == 0, F.concat(F.lit("-9."), size)).otherwise("")).alias("ref"))
    units = part.where(k % 4 == 0).select(pkg.alias("pkg"), F.concat(F.lit("1."), size).alias("version"), F.lit("local").alias("origin"), F.lit(True).alias("is_local"))
    installed = part.where(k % 4 < 2).select(pkg.alias("name"), F.explode(F.array(F.lit("2.1"), F.lit("2.0"))).alias("version"))
    remote = part.where((k % 8).isin(2, 3, 6)).select(pkg.alias("pkg"), F.when(k % 8 == 2, F.concat(F.lit("3."), size)).alias("version"), F.when(k % 8 == 3, "NETWORK_ERROR").alias("error"))
    return cascade.resolved_packages(asks, units, installed, remote)


_LOOKUP = f"""WITH {_NAMED}, {_VERSIONED}, {_PINS}, asks AS (SELECT DISTINCT CASE WHEN length(name) % 3 = 0 THEN mod || '.' || name ELSE name END || CASE WHEN length(mod) % 4 = 1 THEN 'X' ELSE '' END AS query,
  CASE WHEN length(name) % 3 = 0 THEN mod END AS in_module, name || CASE WHEN length(mod) % 4 = 1 THEN 'X' ELSE '' END AS name FROM versioned),
scoped AS (SELECT v.* FROM versioned v JOIN pins p ON p.pkg = v.pkg WHERE p.pin_unit = v.unit_id OR p.pin_version = v.version),
own AS (SELECT a.query, s.pkg, s.mod, s.name, s.version FROM asks a JOIN scoped s ON s.name = a.name AND (in_module IS NULL OR in_module = s.mod) WHERE s.pkg < 'brand-2'),
others AS (SELECT a.query, s.pkg, s.mod, s.name, s.version FROM asks a JOIN scoped s ON s.name = a.name AND (in_module IS NULL OR in_module = s.mod) WHERE s.pkg > 'brand-1'),
first AS (SELECT *, 1 AS tier, NULL AS resolved_from FROM (SELECT * FROM own UNION ALL SELECT * FROM others o WHERE NOT EXISTS (SELECT 1 FROM own w WHERE (w.query, w.pkg, w.mod, w.name) = (o.query, o.pkg, o.mod, o.name)))),
second AS (SELECT query, 'far' AS pkg, 'Far' AS mod, name, NULL AS version, 2 AS tier, NULL AS resolved_from FROM asks WHERE length(query) % 5 = 0),
third AS (SELECT query, 'web' AS pkg, 'Web' AS mod, name, NULL AS version, 3 AS tier, CASE WHEN length(query) % 5 = 1 THEN 'cache' ELSE 'network' END AS resolved_from FROM asks WHERE length(query) % 5 IN (1, 2)),
every AS (SELECT * FROM first UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third WHERE {{offline}}),
best AS (SELECT query, min(tier) AS tier FROM every GROUP BY query)
SELECT a.query, e.pkg, e.mod, e.name, e.version, b.tier, e.resolved_from,
  CASE WHEN b.tier = 1 THEN 'cache' WHEN b.tier = 2 THEN 'cache,hoogle-local' WHEN b.tier = 3 THEN 'cache,hoogle-local,hoogle-remote' ELSE '{{short}}' END AS tiers_consulted,
  CASE WHEN b.tier IS NULL THEN {{failed}} END AS error
FROM asks a LEFT JOIN best b USING (query) LEFT JOIN every e ON e.query = b.query AND e.tier = b.tier"""
_ONLINE = _LOOKUP.format(offline="true", short="cache,hoogle-local,hoogle-remote", failed="CASE WHEN length(a.query) % 5 = 3 THEN 'HOOGLE_REMOTE_ERROR' ELSE 'NOT_FOUND' END")
_OFFLINE = _LOOKUP.format(offline="resolved_from = 'cache'", short="cache,hoogle-local", failed="'HOOGLE_OFFLINE'")


def _lookups(spark: SparkSession, sf_dir: str, offline: bool) -> DataFrame:
    rows = catalog.versioned(spark, sf_dir)
    wrong = F.when(F.length("mod") % 4 == 1, "X").otherwise("")
    asks = rows.select(F.concat(F.when(F.length("name") % 3 == 0, F.concat("mod", F.lit("."), "name")).otherwise(F.col("name")), wrong).alias("query")).distinct()
    hit = lambda pkg, mod: ["query", F.lit(pkg).alias("pkg"), F.lit(mod).alias("mod"), F.substring_index("query", ".", -1).alias("name")]
    kind = F.length("query") % 5
    local = asks.where(kind == 0).select(*hit("far", "Far"))
    remote = asks.where(kind.isin(1, 2, 3)).select(*hit("web", "Web"), F.when(kind == 1, "cache").when(kind == 2, "network").alias("resolved_from"), F.when(kind == 3, "HOOGLE_REMOTE_ERROR").alias("error"))
    return cascade.resolved_lookups(asks, rows.where("pkg < 'brand-2'"), rows.where("pkg > 'brand-1'"), _pins(spark, sf_dir), local, remote, offline)


@query("lookup_tiers", _ONLINE)
def lookup_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookups(spark, sf_dir, False)


@query("lookup_tiers_offline", _OFFLINE)
def lookup_tiers_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookups(spark, sf_dir, True)


@query("lookup_failures", f"""SELECT query, error, CASE error WHEN 'NOT_FOUND' THEN 3 WHEN 'HOOGLE_REMOTE_ERROR' THEN 5 ELSE 4 END AS exit_code,
  CASE error WHEN 'NOT_FOUND' THEN '{{"retry_with_prefix":"lookup ''' || query || '*''","query":"' || query || '","tiers_consulted":"' || tiers_consulted || '"}}'
  WHEN 'HOOGLE_REMOTE_ERROR' THEN '{{"retry_offline":"lookup ' || query || ' --offline","raise_timeout":"lookup ' || query || ' --hoogle-timeout 30","query":"' || query || '","tiers_consulted":"' || tiers_consulted || '"}}'
  ELSE '{{"retry_online":"lookup ' || query || '","query":"' || query || '","tiers_consulted":"' || tiers_consulted || '"}}' END AS actions
FROM (SELECT query, error, tiers_consulted FROM ({_ONLINE}) UNION ALL SELECT query, error, tiers_consulted FROM ({_OFFLINE})) WHERE error IS NOT NULL""")
def lookup_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lookups(spark, sf_dir, False).unionByName(_lookups(spark, sf_dir, True)).where("error IS NOT NULL")
    actions = cascade.lookup_actions(F.col("query"), F.col("error"), F.col("tiers_consulted"))
    return rows.select("query", "error", cascade.exit_code(F.col("error")).alias("exit_code"), F.to_json(actions).alias("actions"))


@query("lookup_successes", f"""WITH found AS ({_ONLINE}), ranked AS (SELECT query, pkg || '/' || mod || '/' || name AS path, row_number() OVER (PARTITION BY query ORDER BY pkg, mod, name, version DESC) AS place FROM found WHERE error IS NULL)
SELECT query, string_agg(DISTINCT path || '=symbol ' || path, ';' ORDER BY path || '=symbol ' || path) AS actions FROM ranked WHERE place <= 5 GROUP BY query""")
def lookup_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = cascade.lookup_hints(_lookups(spark, sf_dir, False))
    shown = F.transform(F.map_entries("actions"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return hints.select("query", F.array_join(F.array_sort(shown), ";").alias("actions"))


@query("error_codes", """SELECT p_partkey, code, CASE code WHEN 'USER_ERROR' THEN 2 WHEN 'NOT_FOUND' THEN 3 WHEN 'NETWORK_ERROR' THEN 4 WHEN 'HOOGLE_OFFLINE' THEN 4 WHEN 'CORRUPTION' THEN 5 WHEN 'HOOGLE_REMOTE_ERROR' THEN 5 WHEN 'ENV_ERROR' THEN 7
  WHEN 'TOOL_MISSING' THEN 8 WHEN 'INTERNAL_ERROR' THEN 9 WHEN 'ANYTHING' THEN 9 ELSE 0 END AS exit_code
FROM (SELECT p_partkey, ['USER_ERROR', 'NOT_FOUND', 'NETWORK_ERROR', 'HOOGLE_OFFLINE', 'CORRUPTION', 'HOOGLE_REMOTE_ERROR', 'ENV_ERROR', 'TOOL_MISSING', 'INTERNAL_ERROR', 'ANYTHING'][p_size % 11 + 1] AS code FROM part)""")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every package's lookup ended by one of the errors, an unknown one or none."""
    codes = F.array(*(F.lit(c) for c in [*cascade.EXIT_CODES, "ANYTHING"]))
    rows = _part(spark, sf_dir).select("p_partkey", F.get(codes, F.col("p_size") % 11).alias("code"))
    return rows.withColumn("exit_code", cascade.exit_code(F.col("code")))


@query("search_outcomes", """SELECT p_partkey, f AS failure, g AS has_gaps, CASE WHEN f IN ('hop_limit', 'parse_budget') THEN 'stopped_at_bound' WHEN f IN ('not_exported', 'not_declared') THEN 'exhausted' WHEN f = 'module_absent' THEN 'module_absent' WHEN g THEN 'blocked' ELSE 'exhausted' END AS search
FROM (SELECT p_partkey, ['hop_limit', 'parse_budget', 'not_exported', 'not_declared', 'no_supplier', 'module_unparsed', 'swept_package', 'module_absent'][p_partkey % 8 + 1] AS f, p_size % 2 = 0 AS g FROM part)""")
def search_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["hop_limit", "parse_budget", "not_exported", "not_declared", "no_supplier", "module_unparsed", "swept_package", "module_absent"]
    rows = _part(spark, sf_dir).select("p_partkey", F.get(F.array(*(F.lit(k) for k in kinds)), (F.col("p_partkey") % 8).cast("int")).alias("failure"), (F.col("p_size") % 2 == 0).alias("has_gaps"))
    return rows.withColumn("search", cascade.search_outcome(F.col("failure"), F.col("has_gaps")))


_SITES = f"""{_MODULES}, asks AS (SELECT DISTINCT module, name FROM exported), d AS (SELECT DISTINCT module, name FROM decls),
step AS (SELECT i.module, i.name, i.target, min(i.open) AS open FROM imports i JOIN exported e ON e.module = i.target AND e.name = i.name WHERE i.target <> i.module GROUP BY ALL)"""


@query("index_then_chain", f"""WITH {_SITES}, short AS (SELECT a.module, a.name, a.module // 4 AS site FROM asks a JOIN d ON d.module = a.module // 4 AND d.name = a.name WHERE a.module % 2 = 0),
one AS (SELECT a.module, a.name, s.target AS at, s.open FROM asks a JOIN step s USING (module, name)),
hit AS (SELECT module, name, module AS definer, 0 AS hop, 0 AS open FROM d SEMI JOIN asks USING (module, name) UNION ALL SELECT o.module, o.name, o.at, 1, o.open FROM one o JOIN d ON d.module = o.at AND d.name = o.name),
chain AS (SELECT module, name, arg_min(definer, (hop, open, definer)) AS definer FROM hit GROUP BY ALL),
beyond AS (SELECT DISTINCT o.module, o.name FROM one o JOIN step s ON s.module = o.at AND s.name = o.name WHERE s.target <> o.module AND NOT EXISTS (SELECT 1 FROM one k WHERE k.module = o.module AND k.name = o.name AND k.at = s.target))
SELECT a.module, a.name, coalesce(s.site, c.definer) AS definer, CASE WHEN s.site IS NOT NULL THEN 'index' WHEN c.definer IS NOT NULL THEN 'chain' END AS how,
  CASE WHEN s.site IS NOT NULL OR c.definer IS NOT NULL THEN 'found' WHEN b.name IS NOT NULL THEN 'stopped_at_bound' ELSE 'exhausted' END AS verdict
FROM asks a LEFT JOIN short s USING (module, name) LEFT JOIN chain c USING (module, name) LEFT JOIN beyond b USING (module, name)""")
def index_then_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    exported, decls = catalog.exported(spark, sf_dir), catalog.declarations(spark, sf_dir)
    asks = exported.select("module", "name").distinct()
    sites = asks.where("module % 2 = 0").select("module", "name", F.expr("module div 4").alias("definer"))  # some of them stale
    chained = resolve.followed_chain(asks, decls, exported, catalog.imports(spark, sf_dir), hops=1).select("module", "name", "definer", "verdict")
    return cascade.located(asks, sites, decls, chained).withColumn("name", F.col("name").cast("long"))


@query("outside_candidates", f"""WITH {_NAMED}, s AS (SELECT DISTINCT module, name FROM named), i AS (SELECT a.module, a.name, b.module AS target, bool_or(length(b.module) % 2 = 0) AS explicit FROM s a JOIN s b USING (name) WHERE a.module <> b.module AND b.module LIKE 'Cat.P%' GROUP BY ALL),
r AS (SELECT *, NOT explicit AS open, CASE WHEN split_part(module, '.', 2) = split_part(target, '.', 2) THEN 2 ELSE 1 END AS near FROM i)
SELECT s.module, s.name, coalesce(string_agg(target, ',' ORDER BY open, near DESC, target), '') AS candidates FROM s LEFT JOIN r USING (module, name) GROUP BY ALL""")
def outside_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog._named(spark, sf_dir).select("module", "name").distinct()
    # The modules of one name are the package's few; each is asked against those under one prefix.
    near = rows.where("module LIKE 'Cat.P%'").groupBy("name").agg(F.collect_set("module").alias("targets"))
    imports = rows.join(near, "name").select("module", "name", F.explode("targets").alias("target")).where("module <> target").withColumn("explicit", F.length("target") % 2 == 0)
    return cascade.outside_candidates(rows, imports).select("module", "name", F.array_join("candidates", ",").alias("candidates"))


@query("imported_definitions", f"""WITH {_NAMED}, {_symbols()}, need AS (SELECT DISTINCT component, module, def_component, def_module FROM symbols WHERE def_component <> component),
src AS (SELECT DISTINCT component AS def_component, module AS def_module, CASE WHEN length(module) % 3 > 0 THEN 'text of ' || module END AS content FROM named WHERE component < 'brand-3')
SELECT n.*, s.content, CASE WHEN s.content IS NOT NULL THEN NULL WHEN n.def_component < 'brand-3' THEN 'no source file' ELSE 'package not resolved' END AS gap FROM need n LEFT JOIN src s USING (def_component, def_module)""")
def imported_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.symbols(spark, sf_dir)
    content = F.when(F.length("module") % 3 > 0, F.concat(F.lit("text of "), "module"))
    sources = catalog._named(spark, sf_dir).where("component < 'brand-3'").select("component", "module", content.alias("content")).distinct()
    return cascade.imported_definitions(rows.select("component", "module").distinct(), rows, sources)


@query("module_pages", f"""WITH {_NAMED}, p AS (SELECT DISTINCT component, module FROM named), n AS (SELECT component, module, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM named GROUP BY ALL),
v AS (SELECT component, module, names, CASE length(module) % 4 WHEN 0 THEN 'prebuilt' WHEN 1 THEN 'source' ELSE 'exports_only' END AS view FROM p JOIN n USING (component, module))
SELECT component, module, view, CASE WHEN view = 'prebuilt' THEN '<p>' || module END AS html, CASE WHEN view = 'prebuilt' THEN NULL WHEN length(module) % 4 = 3 THEN '' ELSE names END AS names,
  CASE WHEN length(module) % 4 = 3 THEN 'package source could not be resolved' WHEN view = 'exports_only' THEN 'module docs could not be resolved' END AS reason FROM v""")
def module_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = catalog._named(spark, sf_dir), F.length("module") % 4
    prebuilt = rows.select("component", "module", F.when(k == 0, F.concat(F.lit("<p>"), "module")).alias("html")).distinct()
    entries = rows.where(k < 2).select("component", "module", "name", F.col("p_type").alias("signature"))
    return cascade.module_pages(rows.select("component", "module"), prebuilt, entries, rows.where(k != 3)).withColumn("names", F.array_join("names", ","))


@query("fresh_in_stores", """SELECT event_id AS unit, CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'project' WHEN event_id % 5 = 0 THEN 'global' END AS fresh_in FROM events""")
def fresh_in_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = catalog.table(spark, sf_dir, "events").select(F.col("event_id").alias("unit"), F.when(F.col("event_type") != "error", F.col("user_id").cast("string")).alias("fingerprint"))
    old = units.where("unit % 3 = 1").withColumn("fingerprint", F.concat("fingerprint", F.lit("-old")))
    return cascade.fresh_in_stores(units, units.where("unit % 3 = 0").unionByName(old), units.where("unit % 5 = 0"), ["unit"])


@query("index_progress", "SELECT count(DISTINCT CASE WHEN p_size > 10 THEN p_partkey END) AS done, count(*) AS total FROM part")
def index_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    return cascade.progress(part.select(F.col("p_partkey").alias("pkg")), part.where("p_size > 10").select(F.col("p_partkey").alias("pkg")))


@query("health_rollup", "SELECT n_name AS name, n_nationkey < 24 AS ok FROM nation UNION ALL SELECT 'all_pass', false")
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.all_pass(catalog.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") < 24).alias("ok")))


# -- overrides, versions, plans --------------------------------------------------------------

_GIVEN = "SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN p_name || '=' || p_size WHEN 1 THEN ' ' || p_name || ' = 1.' || p_size || ' ' WHEN 2 THEN p_name WHEN 3 THEN '=' || p_size WHEN 4 THEN p_name || '= ' ELSE p_name || '=1=2' END AS text, p_partkey % 6 AS k, p_name, p_size FROM part"


@query("override_text", f"""SELECT text, CASE WHEN k IN (0, 1, 5) THEN p_name END AS pkg, CASE k WHEN 0 THEN '' || p_size WHEN 1 THEN '1.' || p_size WHEN 5 THEN '1=2' END AS version,
  CASE k WHEN 2 THEN 'missing_equals' WHEN 3 THEN 'empty_package' WHEN 4 THEN 'empty_version' END AS error FROM (SELECT DISTINCT text, k, CASE WHEN k = 3 THEN '' ELSE p_name END AS p_name, CASE WHEN k IN (0, 1) THEN p_size END AS p_size FROM ({_GIVEN}))""")
def override_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, size = F.col("p_partkey") % 6, F.col("p_name"), F.col("p_size").cast("string")
    join = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    given = F.when(k == 0, join(name, "=", size)).when(k == 1, join(" ", name, " = 1.", size, " ")).when(k == 2, name).when(k == 3, join("=", size)).when(k == 4, join(name, "= ")).otherwise(join(name, "=1=2"))
    return packages.pinned_overrides(_part(spark, sf_dir).select(given.alias("text")).distinct())


@query("latest_version", """SELECT p_partkey AS pkg, CASE p_partkey % 4 WHEN 0 THEN '1.' || p_size END AS version FROM part""")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    body = F.when(k == 0, F.concat(F.lit('{"name": "x", "version": "1.'), size, F.lit('"}'))).when(k == 1, '{"name": "x"}').when(k == 2, F.concat(F.lit('{"version": '), size, F.lit("}"))).otherwise("[oops")
    return packages.latest_version(_part(spark, sf_dir).select(F.col("p_partkey").alias("pkg"), body.alias("body")))


@query("version_macros", "SELECT p_partkey, v AS version, CASE WHEN k IN (0, 3) THEN 900 + p_size END AS major_minor, CASE k WHEN 0 THEN 0 WHEN 3 THEN 4 END AS patch FROM (SELECT p_partkey, p_size, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN '9.' || p_size WHEN 1 THEN '9' WHEN 2 THEN '9.x.' || p_size ELSE '9.' || p_size || '.4' END AS v FROM part)")
def version_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    v = F.when(k == 0, F.concat(F.lit("9."), size)).when(k == 1, "9").when(k == 2, F.concat(F.lit("9.x."), size)).otherwise(F.concat(F.lit("9."), size, F.lit(".4")))
    return _part(spark, sf_dir).select("p_partkey", v.alias("version"), ident.version_macro(v).alias("m")).select("p_partkey", "version", "m.major_minor", F.col("m.patch").cast("int").alias("patch"))


@query("plan_edges", """WITH u AS (SELECT p_brand AS pkg, p_partkey AS k, p_partkey % 3 > 0 AS lib FROM part), best AS (SELECT pkg, arg_max(k, (lib, k)) AS k FROM u GROUP BY pkg), d AS (SELECT pkg, unnest([0, 1, 2]) AS pos, unnest([k // 2, k // 3, k + 1000000]) AS dep FROM best)
SELECT d.pkg, pos, u.pkg AS dep_pkg, '1.' || (u.k % 7) AS dep_version FROM d JOIN u ON u.k = d.dep""")
def plan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    units = _part(spark, sf_dir).select(
        F.col("p_brand").alias("pkg"), F.concat(F.lit("1."), (k % 7).cast("string")).alias("version"), k.cast("string").alias("unit_id"), k.alias("pos"), (k % 3 > 0).alias("has_lib"),
        F.array(F.expr("p_partkey div 2"), F.expr("p_partkey div 3"), k + 1_000_000).cast("array<string>").alias("depends"),
    )
    return build_plan.dependency_edges(units)


@query("plan_counts", "SELECT count(*) FILTER (p_size = 1) AS project, count(*) FILTER (p_size <> 1) AS dependencies, count(*) AS total FROM part")
def plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_plan.plan_counts(_part(spark, sf_dir).select((F.col("p_size") == 1).alias("is_local")))


@query("source_directories", """SELECT p_partkey AS component, CASE WHEN p_partkey % 3 = 0 THEN 'plan' WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 0 THEN 'guess' END AS dirs FROM part""")
def source_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = _part(spark, sf_dir), F.col("p_partkey")
    dirs = lambda n, label: part.where(k % n == 0).select(k.alias("component"), F.lit(label).alias("dirs"))
    return build_plan.source_directories(part.select(k.alias("component"), F.when(k % 2 == 0, "lib").otherwise("exe").alias("kind")), dirs(3, "plan"), dirs(5, "guess"))


@query("component_listing", "SELECT CAST(p_partkey AS VARCHAR) AS pkg, coalesce(c, CAST(p_partkey AS VARCHAR)) AS component, p_brand AS origin FROM part LEFT JOIN (SELECT p_partkey AS k, p_partkey || ':' || unnest(['a', 'b']) AS c FROM part WHERE p_size % 2 = 0) ON k = p_partkey")
def component_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir).withColumn("pkg", F.col("p_partkey").cast("string"))
    inside = part.where("p_size % 2 = 0").select("pkg", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("c"))
    return build_plan.component_listing(part.select("pkg", F.col("p_brand").alias("origin")), inside.select("pkg", F.concat("pkg", F.lit(":"), "c").alias("component")))


@query("missing_roots", "SELECT CAST(c_custkey * 30 AS BIGINT) AS pkg FROM customer WHERE c_custkey * 30 NOT IN (SELECT p_partkey FROM part)")
def missing_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = catalog.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 30).cast("long").alias("pkg"))
    return graph.missing_roots(_part(spark, sf_dir).select(F.col("p_partkey").alias("pkg")), roots)


@query("generation_guard", "SELECT event_id FROM events WHERE user_id % 3 = 1")
def generation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 3).alias("generation"))
    return build_plan.generation_guarded(rows, 1).select("event_id")


@query("action_hints", """SELECT p_partkey, '{"a":"x","b":"' || p_size || '"}' AS actions FROM part""")
def action_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = lambda label, command: F.struct(F.lit(label).alias("label"), command.alias("command"))
    actions = F.array(pair("a", F.lit("x")), pair("b", F.col("p_size").cast("string")), pair("c", F.lit("z")))
    return _part(spark, sf_dir).select("p_partkey", F.to_json(build_plan.action_hints(actions, 2)).alias("actions"))


@query("error_envelopes", """SELECT p_partkey, '{"error":{"code":"NOT_FOUND","message":"' || p_name || '","exit_code":3}' || CASE WHEN p_size % 2 = 0 THEN ',"actions":{"query":"' || p_name || '"}' ELSE '' END || '}' AS envelope FROM part""")
def error_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lit("NOT_FOUND")
    actions = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("query"), F.col("p_name"))).otherwise(F.create_map().cast("map<string,string>"))
    return _part(spark, sf_dir).select("p_partkey", build_plan.error_envelope(code, F.col("p_name"), cascade.exit_code(code), actions).alias("envelope"))


# -- sources and dumps -------------------------------------------------------------------------


_FOLDERS = ["", "lib/", "src/", "x/y/", "deep/", "test/", "a/b/c/d/", "a/b/c/d/e/", ".hid/", "x/build/", "a/c/", "a/b/c/", "src/more/"]


@query("module_files", f"""WITH {_NAMED}, f AS (SELECT DISTINCT component, module, {_FOLDERS}[(length(name) * 5 + p_size) % {len(_FOLDERS)} + 1] AS folder FROM named),
placed AS (SELECT *, string_split(rtrim(folder, '/'), '/') AS above, CASE folder WHEN '' THEN 0 WHEN 'src/' THEN 1 WHEN 'lib/' THEN 3 ELSE 7 END AS place FROM f WHERE folder NOT IN ('test/', 'a/b/c/d/e/', '.hid/', 'x/build/'))
SELECT component AS package, module, arg_min(folder, row(place, list_transform(above, lambda d, i: CASE WHEN i < len(above) THEN '1' ELSE '0' END || d))) || replace(module, '.', '/') || '.hs' AS relative FROM placed GROUP BY component, module""")
def module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folders = catalog._named(spark, sf_dir), F.array(*(F.lit(f) for f in _FOLDERS))
    folder = F.get(folders, ((F.length("name") * 5 + F.col("p_size")) % len(_FOLDERS)).cast("int"))
    files = rows.select(F.col("component").alias("package"), F.concat(folder, F.replace("module", F.lit("."), F.lit("/")), F.lit(".hs")).alias("relative")).distinct()
    return packages.module_file(files, rows.select(F.col("component").alias("package"), "module").distinct())


@query("document_places", """SELECT p_partkey AS pkg, CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'cache/' || p_partkey END WHEN p_partkey % 3 = 0 AND p_size % 3 > 0 THEN 'dist/' || p_partkey WHEN p_partkey % 5 = 0 THEN 'env/' || p_partkey END AS path,
  CASE WHEN p_partkey % 4 = 0 THEN 'cache' WHEN p_partkey % 3 = 0 AND p_size % 3 > 0 THEN 'build' WHEN p_partkey % 5 = 0 THEN 'environment' END AS found_in,
  CASE WHEN p_partkey % 4 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'found' ELSE 'empty' END WHEN (p_partkey % 3 = 0 AND p_size % 3 > 0) OR p_partkey % 5 = 0 THEN 'found' ELSE 'absent' END AS state FROM part""")
def document_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir).select(F.col("p_partkey").alias("pkg"), "p_size")
    at = lambda name, where, has: part.where(where).select("pkg", F.when(F.expr(has), F.concat(F.lit(f"{name}/"), F.col("pkg").cast("string"))).alias("index"))
    return packages.document_places(part, at("cache", "pkg % 4 = 0", "p_size % 2 = 0"), at("dist", "pkg % 3 = 0", "p_size % 3 > 0"), at("env", "pkg % 5 = 0", "true"))


@query("collection_places", """SELECT p_partkey AS pkg, CASE WHEN p_partkey % 4 = 0 THEN 's' || p_partkey WHEN p_partkey % 5 = 0 THEN 'd' || p_partkey WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN 'g' || p_partkey END AS path,
  CASE WHEN p_partkey % 4 = 0 THEN 'store' WHEN p_partkey % 5 = 0 THEN 'distribution' WHEN p_size % 2 = 0 AND p_partkey % 3 = 0 THEN 'generated' END AS found_in,
  CASE WHEN p_partkey % 4 = 0 OR p_partkey % 5 = 0 THEN NULL WHEN p_size % 2 = 1 THEN 'no_store_entry' WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'tool failed' ELSE 'not_generated' END AS error FROM part""")
def collection_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir).select(F.col("p_partkey").alias("pkg"), (F.col("p_size") % 2 == 0).alias("is_local"))
    at = lambda letter, where: part.where(where).select("pkg", F.concat(F.lit(letter), F.col("pkg").cast("string")).alias("path"))
    failed = part.where("pkg % 3 = 1").select("pkg", F.lit(None).cast("string").alias("path"), F.lit("tool failed").alias("error"))
    return packages.collection_places(part, at("s", "pkg % 4 = 0"), at("d", "pkg % 5 = 0"), at("g", "pkg % 3 = 0").withColumn("error", F.lit(None).cast("string")).unionByName(failed))


@query("export_generations", f"""WITH {_NAMED}, {_symbols()}, made AS (SELECT DISTINCT n.component, n.module, n.name, left(s.def_component, 7) AS def_component, s.def_module, n.p_size % 3 AS generation FROM named n JOIN symbols s USING (component, module, name)),
asks AS (SELECT DISTINCT component AS asker, module, name FROM named), hits AS (SELECT a.asker, a.module, a.name, m.* EXCLUDE (module, name) FROM asks a JOIN made m USING (module, name) WHERE right(a.asker, 1) = right(m.component, 1))
SELECT asker, module, name, h.def_component, h.def_module, h.component AS presenter FROM hits h QUALIFY row_number() OVER (PARTITION BY asker, module, name ORDER BY h.def_component, generation DESC, h.def_module, h.component) = 1""")
def export_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passes over the modules; names of components cut short, so that many share one and
    only the order of the passes tells their definitions apart."""
    rows = catalog._named(spark, sf_dir)
    made = rows.join(catalog.symbols(spark, sf_dir).drop("visibility"), ["component", "module", "name"]).withColumn("def_component", F.left("def_component", F.lit(7)))
    env = None
    for n in range(3):
        env = resolve.extended_exports(env, made.where(F.col("p_size") % 3 == n).distinct(), n)
    one = rows.select("component", F.right("component", F.lit(1)).alias("tail")).distinct()
    deps = one.select(F.col("component").alias("pkg"), "tail").join(one.select(F.col("component").alias("dep_pkg"), "tail"), "tail").select("pkg", "dep_pkg")
    found = resolve.probe_exports(rows.select(F.col("component").alias("asker"), "module", "name").distinct(), env, deps)
    return found.select("asker", "module", "name", "chosen.def_component", "chosen.def_module", "chosen.presenter")


@query("source_roots", """WITH f AS (SELECT DISTINCT p_brand AS package, CASE p_size % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'app/' ELSE 'other/' END || p_type || '.hs' AS relative FROM part WHERE p_brand < 'Brand#3' OR p_size % 4 > 1)
SELECT package, relative FROM f WHERE regexp_matches(relative, '^(src|lib|library|source|app|Source)/') OR package NOT IN (SELECT package FROM f WHERE regexp_matches(relative, '^(src|lib|library|source|app|Source)/'))""")
def source_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = _part(spark, sf_dir), F.col("p_size") % 4
    folder = F.when(k == 0, "src/").when(k == 1, "app/").otherwise("other/")
    files = part.where((F.col("p_brand") < "Brand#3") | (k > 1)).select(F.col("p_brand").alias("package"), F.concat(folder, "p_type", F.lit(".hs")).alias("relative")).distinct()
    return packages.source_roots(files)


@query("walked_modules", f"""WITH {_NAMED}, s AS (SELECT DISTINCT component, module, visibility FROM named WHERE component < 'brand-3')
SELECT component, module, visibility FROM s UNION ALL SELECT DISTINCT component, module, 'exposed' FROM named WHERE component NOT IN (SELECT component FROM s)""")
def walked_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog._named(spark, sf_dir)
    return packages.with_walked(rows.where("component < 'brand-3'").select("component", "module", "visibility").distinct(), rows.select("component", "module").distinct())


@query("module_owners", f"""WITH {_NAMED} SELECT DISTINCT a.module, n.component AS pkg, '1.0' AS version FROM (SELECT DISTINCT module FROM named WHERE p_size < 5) a JOIN named n USING (module)""")
def module_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog._named(spark, sf_dir)
    return packages.module_owners(rows.where("p_size < 5").select("module"), rows.select("module", F.col("component").alias("pkg"), F.lit("1.0").alias("version")).distinct())


@query("found_tarballs", """WITH f AS (SELECT p_size AS repo_pos, 'n' || (p_partkey % 97) AS n, '1.' || (p_partkey % 3) AS v, p_partkey % 4 AS k FROM part)
SELECT n AS name, v AS version, arg_min('/r' || repo_pos || '/' || n || '/' || v || '/' || n || '-' || v || '.tar.gz', (repo_pos, '/r' || repo_pos)) AS path FROM f WHERE k > 0 GROUP BY ALL""")
def found_tarballs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    n, v = F.concat(F.lit("n"), (k % 97).cast("string")), F.concat(F.lit("1."), (k % 3).cast("string"))
    path = F.concat(F.lit("/r"), F.col("p_size").cast("string"), F.lit("/"), n, F.lit("/"), v, F.lit("/"), n, F.when(k % 4 > 0, "-").otherwise("_"), v, F.lit(".tar.gz"))
    return packages.found_tarballs(_part(spark, sf_dir).select(F.col("p_size").alias("repo_pos"), path.alias("path")))


@query("dump_exports", """WITH m AS (SELECT conv_id, turn, 'A.M' || conv_id AS module FROM conversations), e AS (
  SELECT module, turn * 10 + 2 AS pos, 'Cls' AS name, 'B.C' AS origin_module FROM m WHERE turn % 2 = 0 UNION ALL SELECT module, turn * 10 + 2, 'met', 'B.D' FROM m
  UNION ALL SELECT module, turn * 10 + 3, '||', 'B.Bool' FROM m UNION ALL SELECT module, turn * 10 + 4, 'own' || turn, module FROM m)
SELECT module, name, origin_module, min(pos) AS pos FROM e GROUP BY ALL""")
def dump_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A dump a conversation: its header, then an export section for each turn, each ended by a field.
    turn = F.col("turn")
    bar = F.when(turn % 2 == 0, "  B.C.Cls{B.D.met}").otherwise("  B.C.Cls|{B.D.met}")
    lines = F.array(F.lit("direct modules: x"), F.lit("exports:"), bar, F.lit("  B.Bool.||"), F.concat(F.lit("  own"), turn.cast("string")), F.lit("depends: p:No.This"), F.lit("  Not.here"))
    rows = catalog.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), turn, F.posexplode(lines).alias("k", "text")).select("file", (turn * 10 + F.col("k") + 0).cast("int").alias("pos"), "text")
    head = rows.select("file").distinct().select("file", F.lit(-1).alias("pos"), F.concat(F.lit("interface pkg:A.M"), F.col("file").cast("string"), F.lit(" 9")).alias("text"))
    return build_plan.dump_exports(rows.unionByName(head)).withColumn("pos", F.col("pos").cast("long"))


@query("mime_types", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/css; charset=utf-8' WHEN 2 THEN 'image/svg+xml' WHEN 3 THEN 'text/plain; charset=utf-8' ELSE 'application/octet-stream' END AS mime, p_partkey % 6 <> 4 AND p_partkey % 6 <> 2 AS safe FROM part""")
def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.get(F.lit(["/x/A.HTML", "/x/a.b.css", "/.hidden/x.svg", "/x/t.txt", "/../x.ico", "/x/no-extension"]), (F.col("p_partkey") % 6).cast("int"))
    path = F.concat("p_brand", endings)
    return _part(spark, sf_dir).select("p_partkey", text.mime_type(path).alias("mime"), text.safe_segments(path).alias("safe"))


# -- declarations and the index ------------------------------------------------------------------


@query("merged_declarations", """SELECT CAST(conv_id AS VARCHAR) AS module, role AS name, arg_min(md5(text), turn) FILTER (turn % 2 = 0) AS signature, md5(string_agg(text, chr(10) ORDER BY turn)) AS doc, min(turn) AS first_line, max(turn + 1) AS last_line FROM conversations WHERE text IS NOT NULL GROUP BY ALL""")
def merged_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    line = lambda c, name: c.cast("int").alias(name)
    decls = catalog.table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(
        F.lit("c").alias("component"), F.col("conv_id").cast("string").alias("module"), F.col("role").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit("value").alias("kind"),
        F.when(t % 2 == 0, F.md5("text")).alias("signature"), F.col("text").alias("doc"), t.alias("pos"), line(t, "sig_line"), line(t + 1, "sig_end"), line(t, "def_line"), line(t + 1, "def_end"), line(t, "doc_line"), line(t, "doc_end"),
    )
    return declarations.merged(decls).select("module", "name", "signature", F.md5("doc").alias("doc"), F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"))


@query("container_members", """SELECT p_brand AS module, p_type AS parent, string_agg(p_name, '|' ORDER BY p_partkey) AS members FROM part WHERE p_size > 1 AND (p_brand, p_type) IN (SELECT (p_brand, p_type) FROM part WHERE p_size = 1) GROUP BY ALL""")
def container_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, own = _part(spark, sf_dir), F.col("p_size") == 1
    decls = part.select(F.col("p_brand").alias("module"), F.when(own, F.col("p_type")).otherwise(F.col("p_name")).alias("name"), F.when(~own, F.col("p_type")).alias("parent"), F.when(own, "class").otherwise("method").alias("kind"), F.col("p_partkey").alias("pos"))
    return declarations.members(decls).select("module", "parent", F.array_join("members", "|").alias("members"))


@query("expanded_exports", """WITH e AS (SELECT p_brand AS module, p_partkey AS pos, CASE p_size % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'all' ELSE 'module' END AS form, CASE WHEN p_size % 3 = 2 THEN 'Brand#1' || (p_size % 5 + 1) ELSE p_type END AS item FROM part WHERE p_brand < 'Brand#4'),
d AS (SELECT p_brand AS module, p_name AS name, p_type AS parent FROM part), listed AS (SELECT module AS item, item AS name FROM e WHERE form <> 'module'), x AS (
  SELECT module, item AS name, pos FROM e WHERE form <> 'module' UNION ALL SELECT e.module, d.name, e.pos FROM e JOIN d ON d.module = e.module AND d.parent = e.item WHERE form = 'all'
  UNION ALL SELECT e.module, l.name, e.pos FROM e JOIN (SELECT DISTINCT item, name FROM listed) l USING (item) WHERE form = 'module' UNION ALL SELECT module, name, 0 FROM d WHERE module NOT IN (SELECT module FROM e))
SELECT module, name, min(pos) AS pos FROM x GROUP BY ALL""")
def expanded_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = _part(spark, sf_dir), F.col("p_size") % 3
    item = F.when(k == 2, F.concat(F.lit("Brand#1"), (F.col("p_size") % 5 + 1).cast("string"))).otherwise(F.col("p_type"))
    exports = part.where("p_brand < 'Brand#4'").select(F.col("p_brand").alias("module"), F.col("p_partkey").alias("pos"), F.when(k == 0, "symbol").when(k == 1, "all").otherwise("module").alias("form"), item.alias("item"))
    return resolve.expanded_exports(exports, part.select(F.col("p_brand").alias("module"), F.col("p_name").alias("name"), F.col("p_type").alias("parent")))


@query("outside_modules", """SELECT p_brand AS module, p_type || p_size AS item FROM part WHERE p_size % 2 = 0 AND p_type || p_size NOT IN (SELECT p_type || p_size FROM part WHERE p_brand < 'Brand#2')""")
def outside_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    exports = part.select(F.col("p_brand").alias("module"), F.when(F.col("p_size") % 2 == 0, "module").otherwise("symbol").alias("form"), F.concat("p_type", F.col("p_size").cast("string")).alias("item"))
    return resolve.outside_modules(exports, part.where("p_brand < 'Brand#2'").select(F.concat("p_type", F.col("p_size").cast("string")).alias("module")).distinct())


@query("found_declarations", """WITH d AS (SELECT p_brand AS module, p_partkey AS pos, p_name AS name, p_type AS sibling FROM part), s AS (SELECT DISTINCT p_brand AS module, unnest([p_name, p_type]) AS name FROM part WHERE p_size < 20),
h AS (SELECT s.*, 0 AS how, pos, d.name AS kind FROM s JOIN d USING (module, name) UNION ALL SELECT s.*, 1, pos, d.name FROM s JOIN d ON d.module = s.module AND d.sibling = s.name)
SELECT module, name, arg_min(kind, (how, pos)) AS kind, min(how) AS how FROM h GROUP BY ALL""")
def found_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    decls = part.select(F.lit("c").alias("component"), F.col("p_brand").alias("module"), F.col("p_name").alias("name"), F.array("p_type").alias("siblings"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("kind"), F.lit("").alias("signature"))
    sites = part.where("p_size < 20").select(F.lit("c").alias("component"), F.col("p_brand").alias("module"), F.explode(F.array("p_name", "p_type")).alias("name")).distinct()
    return declarations.found_declarations(sites, decls).select("module", "name", "kind", "how")


@query("routed_rows", """SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 3) THEN 'project' ELSE 'global' END AS store FROM part""")
def routed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    units = part.select(F.col("p_brand").alias("pkg"), (F.col("p_size") == 3).alias("is_local"))
    own, others = index_build.routed(part.select("p_partkey", F.col("p_brand").alias("pkg")), units, True)
    return own.select("p_partkey", F.lit("project").alias("store")).unionByName(others.select("p_partkey", F.lit("global").alias("store")))


@query("index_levels", f"""WITH RECURSIVE {_DEPS}, walk(pkg, level) AS (SELECT 0::BIGINT, 0 UNION SELECT d.pkg, w.level + 1 FROM walk w JOIN deps d ON d.dep_pkg = w.pkg), levels AS (SELECT pkg, max(level) AS level FROM walk GROUP BY pkg)
SELECT level, count(*) AS built, max(pkg) AS last, CAST(0 AS BIGINT) AS missing FROM levels GROUP BY level""")
def index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps, number = catalog.unit_deps(spark, sf_dir), itertools.count()

    def build(level: DataFrame, below: DataFrame | None) -> DataFrame:
        # Every dependency must have been built by then: ``missing`` counts those that were not.
        needs = level.join(shuffled(deps), "pkg").select(F.col("dep_pkg").alias("done"))
        gaps = needs if below is None else needs.join(shuffled(below.select("done")), "done", "left_anti")
        missing = F.broadcast(gaps.agg(F.count("*").alias("missing")))  # one row
        return level.select(F.col("pkg").alias("done"), F.lit(next(number)).alias("level")).crossJoin(missing)

    rows = index_build.build_levels(deps, _part(spark, sf_dir).select(F.col("p_partkey").alias("pkg")), build)
    return rows.groupBy("level").agg(F.count("*").alias("built"), F.max("done").alias("last"), F.max("missing").alias("missing"))


@query("component_index", f"""WITH {_SITES}, short AS (SELECT module % 5 AS c, * FROM exported) SELECT CAST(c AS VARCHAR) AS component, CAST(module AS VARCHAR) AS module, CAST(name AS VARCHAR) AS name,
  CASE WHEN EXISTS (SELECT 1 FROM decls d WHERE d.module = s.module AND d.name = s.name) THEN 's' || name END AS signature, CAST(module AS VARCHAR) AS def_module FROM (SELECT DISTINCT * FROM short) s SEMI JOIN decls USING (module, name)""")
def component_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = (F.col("module") % 5).cast("string").alias("component")
    text_of = lambda rows, *more: rows.select(c, F.col("module").cast("string").alias("module"), F.col("name").cast("string").alias("name"), *more)
    decls = text_of(catalog.declarations(spark, sf_dir), F.lit("value").alias("kind"), F.concat(F.lit("s"), F.col("name").cast("string")).alias("signature"), F.lit(0).alias("pos"), F.array().cast("array<string>").alias("siblings"))
    imports = text_of(catalog.imports(spark, sf_dir).where("false"), F.col("target").cast("string").alias("target"), "explicit")
    exports = spark.createDataFrame([], "module string, name string, presenter string, def_component string, def_module string")
    deps = spark.createDataFrame([], "pkg string, dep_pkg string")
    rows, _ = index_build.component_index(text_of(catalog.exported(spark, sf_dir), F.lit("exposed").alias("visibility")), decls, imports, exports, deps)
    return rows.select("component", "module", "name", "signature", "def_module")


@query("alternate_labels", f"""WITH {_NAMED}, {_symbols()} SELECT component || ':' || module || '.' || name AS label, '/pkg/' || component || '/' || module || '#v:' || name AS href, signature, visibility, component = def_component AND module = def_module AS is_definition FROM symbols""")
def alternate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.symbols(spark, sf_dir)
    return search.labelled(rows).select("label", "href", "signature", "visibility", "is_definition")
