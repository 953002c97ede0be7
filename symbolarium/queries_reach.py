"""Queries beyond one component: lazy probing of dependencies, symbol searches with their failures
and actions, searches by signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.operators import cascade, reach, signatures
from symbolarium.plans.lineage import cut
from symbolarium.queries import _CAP, _DEPS, _MODULES, _NAMED, query
from symbolarium.sources import catalog


def _text(c: Column) -> Column:
    return c.cast("string")


# -- probing --------------------------------------------------------------------------------

# A root's order is by level and, within it, by who brought a package in; SQL walks every path and
# keeps the least one, which is the same order.
_PROBES = f"""WITH RECURSIVE {_DEPS}, walk(root, pkg, path) AS (
  SELECT p_partkey, p_partkey, CAST([] AS BIGINT[]) FROM part
  UNION ALL SELECT w.root, d.dep_pkg, list_append(w.path, d.pos) FROM walk w JOIN deps d ON d.pkg = w.pkg
), nearest AS MATERIALIZED (
  SELECT root, pkg, min(row(len(path), path)) AS way FROM walk WHERE len(path) > 0 GROUP BY ALL
), places AS MATERIALIZED (
  SELECT root, pkg, row_number() OVER (PARTITION BY root ORDER BY way) AS place FROM nearest
), asks AS MATERIALIZED (
  SELECT DISTINCT l_partkey AS root, p_type AS module FROM lineitem JOIN part ON p_partkey = l_suppkey
), has AS MATERIALIZED (SELECT p_partkey AS pkg, p_type AS module, p_size FROM part), hit AS (
  SELECT a.root, a.module, arg_min(p.pkg, p.place) AS pkg, min(p.place) AS place
  FROM asks a JOIN has h USING (module) JOIN places p ON p.root = a.root AND p.pkg = h.pkg WHERE h.p_size % 4 > 0 GROUP BY ALL
), owner AS (
  SELECT module, min(pkg) AS owner FROM has WHERE p_size % 4 = 0 AND pkg % 10 > 0 GROUP BY module
), open AS MATERIALIZED (
  SELECT a.root, a.module, owner FROM asks a ANTI JOIN hit USING (root, module) LEFT JOIN owner USING (module)
), late AS (
  SELECT o.root, o.module, min(f.owner) AS owner FROM open o
  JOIN (SELECT DISTINCT root, owner FROM open WHERE owner IS NOT NULL AND owner % 3 > 0) f ON f.root = o.root JOIN has h ON h.pkg = f.owner AND h.module = o.module GROUP BY ALL
), alldeps AS (SELECT root, max(place) AS n FROM places GROUP BY root)
"""


def _probed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Package k holds the module named by its type. Its source is there unless its size divides by
    four; those that are not there have owners, of which the plan lacks every tenth, and of the
    planned ones every third cannot be fetched."""
    part = catalog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pkg"), F.col("p_type").alias("module"), "p_size")
    lines = catalog.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("root"), F.col("l_suppkey").alias("pkg"))
    asks = lines.join(part, "pkg").select("root", "module").distinct()
    order = reach.dependency_order(catalog.unit_deps(spark, sf_dir), asks.select(F.col("root").alias("pkg")).distinct())
    local = part.where("p_size % 4 > 0").select("pkg", (F.col("p_size") % 5 > 0).alias("has_list"))
    owners = part.where("p_size % 4 = 0").select("module", "pkg", F.col("pkg").alias("pos"))
    plan, fetchable = part.where("pkg % 10 > 0").select("pkg"), part.where("pkg % 3 > 0").select("pkg")
    return reach.probed_modules(asks, order, lambda pkgs: part.join(pkgs, "pkg", "left_semi").select("pkg", "module"), local, owners, plan, fetchable)


@query("dependency_probes", f"""{_PROBES} SELECT a.root, a.module, coalesce(h.pkg, l.owner) AS pkg, h.place, CASE WHEN h.pkg IS NOT NULL THEN 'dependency' WHEN l.owner IS NOT NULL THEN 'owner' END AS how, coalesce(h.place, n, 0) AS touched
FROM asks a LEFT JOIN hit h USING (root, module) LEFT JOIN late l USING (root, module) LEFT JOIN alldeps d ON d.root = a.root""")
def dependency_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probed(spark, sf_dir)[0].withColumns({"place": F.col("place").cast("long"), "touched": F.col("touched").cast("long")})


@query("probe_gaps", f"""{_PROBES}, deepest AS (SELECT a.root, max(coalesce(h.place, n, 0)) AS touched FROM asks a LEFT JOIN hit h USING (root, module) LEFT JOIN alldeps d ON d.root = a.root GROUP BY a.root),
touched AS (SELECT p.root, p.pkg, p_size FROM places p JOIN deepest d ON d.root = p.root AND p.place <= d.touched JOIN has h ON h.pkg = p.pkg)
SELECT root, 'no_local_source' AS kind, pkg, NULL AS module FROM touched WHERE p_size % 4 = 0
UNION ALL SELECT root, 'no_module_list', pkg, NULL FROM touched WHERE p_size % 4 > 0 AND p_size % 5 = 0
UNION ALL SELECT DISTINCT root, 'unit_not_in_plan', root, NULL FROM asks WHERE root % 10 = 0
UNION ALL SELECT root, 'owner_unaskable', NULL, module FROM open WHERE module NOT IN (SELECT module FROM has WHERE p_size % 4 = 0)
UNION ALL SELECT root, 'owner_unfetchable', owner, module FROM open WHERE owner % 3 = 0""")
def probe_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probed(spark, sf_dir)[1].withColumn("pkg", F.col("pkg").cast("long"))


@query("nearest_dependencies", f"{_PROBES} SELECT root, pkg, place FROM places WHERE root IN (SELECT root FROM asks)")
def nearest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = catalog.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pkg")).distinct()
    return reach.dependency_order(catalog.unit_deps(spark, sf_dir), roots).withColumn("place", F.col("place").cast("long"))


# -- symbol searches --------------------------------------------------------------------------

HOPS, BUDGET = 2, 3


def _rings_sql() -> str:
    """Rings written out: who is fresh, what it costs, what it tells."""
    out = [f"""WITH {_MODULES}, m AS MATERIALIZED (SELECT p_partkey AS k, 'M.' || (p_partkey % 3) || '.' || p_partkey AS module, 'c' || (p_partkey % 5) AS component FROM part),
ex AS MATERIALIZED (SELECT DISTINCT module AS k, name AS n FROM exported), de AS MATERIALIZED (SELECT DISTINCT module AS k, name AS n FROM decls),
asks AS MATERIALIZED (
  SELECT m.component, m.module, CAST(n AS VARCHAR) AS name, k, n, false AS z, true AS has_file FROM ex JOIN m USING (k)
  UNION ALL SELECT component, module, '7', k, 7, false, true FROM m
  UNION ALL SELECT component, 'Z.' || k, '0', k, 0, true, k % 12 = 3 FROM m WHERE k % 6 = 3
), state AS MATERIALIZED (
  SELECT a.*, CASE WHEN z AND component <> 'c4' AND NOT has_file THEN 'module_absent' WHEN z OR component = 'c4' THEN 'sweep' WHEN k % 11 = 0 THEN 'module_unparsed' WHEN n = 7 THEN 'not_exported'
    WHEN (k, n) IN (SELECT (de.k, de.n) FROM de) THEN 'found' WHEN k % 13 = 0 THEN 'not_declared' WHEN k % 17 = 0 THEN 'module_unparsed' ELSE 'chain' END AS state FROM asks a
), swept AS (
  SELECT s.component, s.module, s.name, arg_min(m.module, (CASE WHEN m.k = s.k THEN 0 ELSE 1 END, m.module)) AS swept
  FROM state s JOIN m ON m.component = s.component JOIN de ON de.k = m.k AND de.n = s.n WHERE state = 'sweep' GROUP BY ALL
), offers AS MATERIALIZED (
  SELECT i.module AS k, i.name AS n, i.target AS t, min(open) AS open, CASE WHEN i.module % 3 = i.target % 3 THEN -2 ELSE -1 END AS far, 'M.' || (i.target % 3) || '.' || i.target AS target FROM imports i GROUP BY ALL
), chain AS (SELECT component, module, name, k, n FROM state WHERE state = 'chain'),
ring1 AS MATERIALIZED (SELECT c.*, t, target, row_number() OVER (PARTITION BY c.component, c.module, c.name ORDER BY open, far, target) AS place FROM chain c JOIN offers USING (k, n)),
seen0 AS (SELECT component, module, name, t FROM ring1 WHERE false), live0 AS (SELECT * FROM chain), spent0 AS (SELECT component, module, name, 0 AS spent FROM chain)"""]
    key = "component, module, name"
    for r in range(1, HOPS + 1):
        out.append(f"""fresh{r} AS MATERIALIZED (SELECT * FROM ring{r} ANTI JOIN seen{r - 1} USING ({key}, t)),
drained{r} AS (SELECT {key} FROM live{r - 1} ANTI JOIN fresh{r} USING ({key})),
costly{r} AS MATERIALIZED (SELECT f.*, {BUDGET} - spent AS room, row_number() OVER (PARTITION BY {key} ORDER BY place) AS number FROM fresh{r} f JOIN spent{r - 1} USING ({key}) WHERE t % 7 > 0),
told{r} AS MATERIALIZED (SELECT * FROM costly{r} WHERE number <= room AND t % 11 > 0),
hit{r} AS (SELECT {key}, arg_min(t, place) AS t FROM told{r} SEMI JOIN de ON de.k = told{r}.t AND de.n = told{r}.n GROUP BY ALL),
over{r} AS (SELECT DISTINCT {key} FROM costly{r} ANTI JOIN hit{r} USING ({key}) WHERE number > room),
live{r} AS MATERIALIZED (SELECT l.* FROM live{r - 1} l ANTI JOIN drained{r} USING ({key}) ANTI JOIN hit{r} USING ({key}) ANTI JOIN over{r} USING ({key})),
spent{r} AS (SELECT {key}, s.spent + count(c.t) AS spent FROM spent{r - 1} s LEFT JOIN costly{r} c USING ({key}) GROUP BY {key}, s.spent),
seen{r} AS MATERIALIZED (SELECT * FROM seen{r - 1} UNION ALL SELECT {key}, t FROM fresh{r}),
ring{r + 1} AS MATERIALIZED (SELECT {key}, k, n, t, target, row_number() OVER (PARTITION BY {key} ORDER BY best, target) AS place FROM (
  SELECT l.component, l.module, l.name, l.k, l.n, o.t, o.target, min(row(o.open, r.place, o.far)) AS best FROM live{r} l JOIN told{r} r USING ({key}) JOIN offers o ON o.k = r.t AND o.n = l.n GROUP BY ALL))""")
    last = HOPS + 1
    ends = " UNION ALL ".join(
        [f"SELECT {key}, {r} AS hop, t, NULL AS failure, NULL AS frontier FROM hit{r} UNION ALL SELECT {key}, {r}, NULL, 'parse_budget', NULL FROM over{r} UNION ALL SELECT {key}, {r}, NULL, 'no_supplier', NULL FROM drained{r}" for r in range(1, last)]
        + [f"SELECT {key}, {last}, NULL, CASE WHEN frontier IS NULL THEN 'no_supplier' ELSE 'hop_limit' END, frontier FROM live{HOPS} LEFT JOIN beyond USING ({key})"]
    )
    out.append(f"""beyond AS (SELECT {key}, string_agg(target, ', ' ORDER BY place) AS frontier FROM (SELECT * FROM ring{last} ANTI JOIN seen{HOPS} USING ({key}, t)) GROUP BY ALL),
ends AS (SELECT e.*, m.module AS far_module, m.component AS far_component FROM ({ends}) e LEFT JOIN m ON m.k = e.t),
first AS (SELECT {key}, string_agg(target, ', ' ORDER BY place) AS candidates FROM ring1 GROUP BY ALL),
told AS (SELECT s.component, s.module, s.name, state, k, CASE WHEN state = 'found' THEN s.component WHEN swept IS NOT NULL THEN s.component ELSE far_component END AS def_component,
  CASE WHEN state = 'found' THEN s.module WHEN swept IS NOT NULL THEN swept ELSE far_module END AS definer, CASE WHEN far_module IS NOT NULL THEN hop END AS hop,
  CASE WHEN state = 'found' OR swept IS NOT NULL THEN NULL WHEN state = 'sweep' THEN 'swept_package' WHEN state = 'chain' THEN failure ELSE state END AS failure,
  CASE WHEN state = 'not_declared' THEN s.module WHEN state = 'module_unparsed' THEN CASE WHEN k % 11 = 0 THEN s.module ELSE 'Gone' END END AS resolved_to,
  CASE WHEN failure = 'no_supplier' THEN coalesce(candidates, '') END AS candidates, frontier, s.component IN ('c0', 'c2') AS gaps
  FROM state s LEFT JOIN swept USING ({key}) LEFT JOIN ends USING ({key}) LEFT JOIN first USING ({key})),
outcome AS (SELECT component, module, name, def_component, definer, hop, failure, resolved_to, candidates, frontier, CASE WHEN failure = 'swept_package' THEN 'src/' || component END AS directory, gaps,
  CASE WHEN failure IS NULL THEN 'found' WHEN failure IN ('hop_limit', 'parse_budget') THEN 'stopped_at_bound' WHEN failure IN ('not_exported', 'not_declared') THEN 'exhausted'
       WHEN failure = 'module_absent' THEN 'module_absent' WHEN gaps THEN 'blocked' ELSE 'exhausted' END AS verdict FROM told)""")
    return ", ".join(out)


_SEARCHES = _rings_sql()


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module k of component k mod 5 searched for all it exports, for one name that it does not, and
    some modules that no component lists; every kind of failure comes about."""
    module = lambda c: F.concat(F.lit("M."), _text(F.col(c) % 3), F.lit("."), _text(F.col(c)))
    component = lambda c: F.concat(F.lit("c"), _text(F.col(c) % 5))
    k = catalog.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    named = lambda rows: rows.select(component("module").alias("component"), module("module").alias("module"), _text(F.col("name")).alias("name"), F.col("module").alias("k")).distinct()
    exported, decls = named(catalog.exported(spark, sf_dir)), named(catalog.declarations(spark, sf_dir))
    own = k.select(component("k").alias("component"), module("k").alias("module"), "k")
    strange = k.where("k % 6 = 3").select(component("k").alias("component"), F.concat(F.lit("Z."), _text(F.col("k"))).alias("module"), "k")
    asks = exported.drop("k").unionByName(own.select("component", "module", F.lit("7").alias("name"))).unionByName(strange.select("component", "module", F.lit("0").alias("name")))
    said = decls.select("component", "module", "name", F.col("module").alias("site"))
    sites = exported.join(said, ["component", "module", "name"], "left").select(
        "component", "module", "name", F.coalesce("site", F.when(F.col("k") % 13 == 0, F.col("module")).when(F.col("k") % 17 == 0, "Gone")).alias("definer")
    )
    imports = catalog.imports(spark, sf_dir).select(component("module").alias("component"), module("module").alias("module"), _text(F.col("name")).alias("name"), module("target").alias("target"), "explicit")
    parsed = own.where("k % 11 > 0").select("component", "module")
    everyone = F.explode(F.array(*(F.lit(f"c{i}") for i in range(5)))).alias("component")
    reachable = own.where("k % 7 > 0").select(everyone, F.col("module").alias("target"), F.col("component").alias("home"))
    packages = own.select("component").distinct().select("component", F.concat(F.lit("src/"), "component").alias("directory"), (F.col("component") != "c4").alias("readable"))
    gaps = packages.where("component IN ('c0', 'c2')").select("component", F.concat(F.lit("no source of a dependency of "), "component").alias("gap"))
    return reach.searched_symbols(
        asks, packages, own.where("component <> 'c4'"), own.drop("k").unionByName(strange.where("k % 12 = 3").drop("k")), parsed, sites, decls, exported, imports, reachable, gaps, HOPS, BUDGET
    )


@query("symbol_searches", f"{_SEARCHES} SELECT * FROM outcome")
def symbol_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _searched(spark, sf_dir)
    return rows.withColumns({"candidates": F.array_join("candidates", ", "), "frontier": F.array_join("frontier", ", "), "gaps": F.size("gaps") > 0})


@query("search_actions", f"""{_SEARCHES} SELECT component, module, name, '{{"package":"' || component || '","module":"' || module || '","symbol":"' || name || '","search":"' || verdict || '"' ||
  CASE WHEN failure = 'no_supplier' THEN ',"candidates_considered":"' || candidates || '"' WHEN failure = 'hop_limit' THEN ',"hop_limit":"{HOPS}","stopped_at":"' || frontier || '"' WHEN failure = 'parse_budget' THEN ',"parse_budget":"{BUDGET}"' ELSE '' END ||
  coalesce(',"resolved_to":"' || resolved_to || '"', '') || coalesce(',"scanned":"' || directory || '"', '') || CASE WHEN gaps THEN ',"unreadable_dependencies":"no source of a dependency of ' || component || '"' ELSE '' END || '}}' AS actions
FROM outcome WHERE failure IS NOT NULL""")
def search_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = _searched(spark, sf_dir).where("failure IS NOT NULL")
    return failed.select("component", "module", "name", F.to_json(reach.search_actions(HOPS, BUDGET)).alias("actions"))


# -- signatures -------------------------------------------------------------------------------

# A type's first word and the brand are constructors; letters that vary are variables. The SQL puts
# the parts together from the columns, so it does not read any signature.
_TYPED = f"""{_NAMED}, typed AS MATERIALIZED (
  SELECT DISTINCT component, module, name, p_size % 4 AS kind, {_CAP.format("split_part(p_type, ' ', 1)")} AS t, replace(upper(component), '-', '') AS b, substr('pqrst', CAST(p_partkey % 5 + 1 AS INTEGER), 1) AS v FROM named
), signed AS MATERIALIZED (
  SELECT component, module, name, kind, t, b, name || ' :: ' || CASE kind WHEN 0 THEN t || ' -> ' || v || ' -> ' || b WHEN 1 THEN '(' || v || '->' || t || ') -> [' || v || '] -> [' || t || ']'
    WHEN 2 THEN 'Show ' || v || ' => ' || v || ' -> ' || b || ' -> ' || t ELSE v || ' -> Maybe w -> (' || v || ', w) -> ' || b END AS signature FROM typed
)"""


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    type_, name = catalog._capital(F.split_part("p_type", F.lit(" "), F.lit(1))), F.col("name")
    rows = catalog._named(spark, sf_dir, "p_partkey")
    rows = rows.select("component", "module", "name", (F.col("p_size") % 4).alias("kind"), type_.alias("t"), F.replace(F.upper("component"), F.lit("-"), F.lit("")).alias("b"), F.substring(F.lit("pqrst"), (F.col("p_partkey") % 5 + 1).cast("int"), F.lit(1)).alias("v"))
    shape = F.when(F.col("kind") == 0, F.concat("t", F.lit(" -> "), "v", F.lit(" -> "), "b")).when(F.col("kind") == 1, F.format_string("(%s->%s) -> [%s] -> [%s]", "v", "t", "v", "t")).when(
        F.col("kind") == 2, F.format_string("Show %s => %s -> %s -> %s", "v", "v", "b", "t")
    ).otherwise(F.format_string("%s -> Maybe w -> (%s, w) -> %s", "v", "v", "b"))
    return rows.select("component", "module", "name", "t", "b", F.concat(name, F.lit(" :: "), shape).alias("signature")).distinct()


def _asked_signatures(rows: DataFrame) -> DataFrame:
    """Of every pair of constructors: arguments in another order, one argument too few, a function
    among them, a tuple."""
    pair = rows.select("t", "b").distinct()
    shapes = F.array(
        F.format_string("x -> %s -> %s", "t", "b"), F.format_string("%s -> %s", "t", "b"), F.format_string("f :: [k] -> (k -> %s) -> [%s]", "t", "t"), F.format_string("(a, c) -> a -> Maybe c -> %s", "b"), F.format_string("%s -> Nowhere", "t")
    )
    return pair.select(F.explode(shapes).alias("query")).distinct()


@query("signature_search", f"""WITH {_TYPED}, pair AS (SELECT DISTINCT t, b FROM signed), fits AS (
  SELECT DISTINCT 'x -> ' || p.t || ' -> ' || p.b AS query, s.component, s.module, s.name, signature, 0 AS extra, true AS moved FROM pair p JOIN signed s ON kind = 0 AND s.t = p.t AND s.b = p.b
  UNION ALL SELECT DISTINCT p.t || ' -> ' || p.b, s.component, s.module, s.name, signature, 1, false FROM pair p JOIN signed s ON kind = 0 AND s.t = p.t AND s.b = p.b
  UNION ALL SELECT DISTINCT 'f :: [k] -> (k -> ' || p.t || ') -> [' || p.t || ']', s.component, s.module, s.name, signature, 0, true FROM pair p JOIN signed s ON kind = 1 AND s.t = p.t
  UNION ALL SELECT DISTINCT '(a, c) -> a -> Maybe c -> ' || p.b, s.component, s.module, s.name, signature, 0, true FROM pair p JOIN signed s ON kind = 3 AND s.b = p.b
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY extra, moved, component, module, name, signature) AS rank FROM fits)
SELECT query, component, module, name, signature, extra, moved, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20""")
def signature_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(_signed(spark, sf_dir))
    return signatures.signature_matches(_asked_signatures(rows), cut(signatures.signature_index(rows)))


@query("lookup_by_signature", f"""WITH {_TYPED}, pair AS (SELECT DISTINCT t, b FROM signed), asks AS (
  SELECT DISTINCT unnest(['x -> ' || t || ' -> ' || b, t || ' -> Nowhere', lower(t)]) AS query FROM pair
), local AS (
  SELECT 'x -> ' || t || ' -> ' || b AS query, component AS pkg, module AS mod, name, signature FROM signed WHERE kind = 0
  UNION ALL SELECT DISTINCT lower(t), 'far', 'Far', lower(t), '' FROM pair
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pkg, mod, name, signature) AS rank FROM local)
SELECT query, pkg, mod, name, CAST(CASE WHEN pkg IS NOT NULL THEN 2 END AS INTEGER) AS tier, CASE WHEN pkg IS NULL THEN 'cache,hoogle-local,hoogle-remote' ELSE 'cache,hoogle-local' END AS tiers_consulted, CASE WHEN pkg IS NULL THEN 'NOT_FOUND' END AS error
FROM asks LEFT JOIN (SELECT DISTINCT query, pkg, mod, name FROM ranked WHERE rank <= 20) r USING (query)""")
def lookup_by_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(_signed(spark, sf_dir))
    shapes = F.array(F.format_string("x -> %s -> %s", "t", "b"), F.format_string("%s -> Nowhere", "t"), F.lower("t"))
    asks = rows.select("t", "b").distinct().select(F.explode(shapes).alias("query")).distinct()
    named = rows.select(F.lower("t").alias("query"), F.lit("far").alias("pkg"), F.lit("Far").alias("mod"), F.lower("t").alias("name")).distinct()
    local = signatures.local_tier(asks, cut(signatures.signature_index(rows)), named)
    nothing = spark.createDataFrame([], "pkg string, mod string, name string, version string, unit_id string")
    remote = spark.createDataFrame([], "query string, pkg string, mod string, name string, resolved_from string, error string")
    out = cascade.resolved_lookups(asks, nothing, nothing, None, local, remote)
    return out.select("query", "pkg", "mod", "name", "tier", "tiers_consulted", "error")
