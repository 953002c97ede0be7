"""Queries over descriptions, checkouts, extensions and sites, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolarium.functions import ident
from symbolarium.operators import declarations, lookup, search
from symbolarium.operators.name_index import NameIndex
from symbolarium.plans import build_plan
from symbolarium.queries import _NAMED, _PINS, _VERSIONED, _pins, _symbols, query
from symbolarium.sources import catalog, packages


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.table(spark, sf_dir, "part")


# -- descriptions ---------------------------------------------------------------------------

# A package for every brand and size, whose library exposes the types of its parts; what an
# operating system or a flag decides, an executable, and descriptions that lack their name.
_DESCRIBED = """WITH d AS (SELECT lower(replace(p_brand, '#', '-')) || '-s' || p_size AS package, p_size, unnest(list_distinct(list(replace(p_type, ' ', '.')))) AS value FROM part GROUP BY p_brand, p_size)"""


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    package = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("-s"), F.col("p_size").cast("string"))
    held = _part(spark, sf_dir).groupBy(package.alias("package"), "p_size").agg(F.array_join(F.array_sort(F.collect_set(F.replace("p_type", F.lit(" "), F.lit(".")))), ", ").alias("modules"))
    body = F.concat(
        F.lit("version: 1\nlibrary\n  exposed-modules: "), "modules", F.lit("\n  -- a comment\n  hs-source-dirs: src\n  if os(linux) && !flag(slow)\n    other-modules: On.Linux\n  else\n    other-modules: Elsewhere\n"),
        F.lit("  if os(windows)\n    other-modules: On.Windows\n\nexecutable tool\n  other-modules: Main, Options\n"),
    )
    named = F.when(F.col("p_size") % 7 > 0, F.concat(F.lit("name: "), "package", F.lit("\n"))).otherwise("")
    return packages.component_fields(held.select(F.concat(F.lit("/"), "package").alias("path"), F.concat(named, body).alias("value")))


@query("described_modules", f"""{_DESCRIBED}, p AS (SELECT DISTINCT package FROM d WHERE p_size % 7 > 0)
SELECT package AS component, value AS module, 'exposed' AS visibility FROM d WHERE p_size % 7 > 0
UNION ALL SELECT package, unnest(['On.Linux', 'Elsewhere']), 'internal' FROM p UNION ALL SELECT package || ':exe:tool', unnest(['Main', 'Options']), 'internal' FROM p""")
def described_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag cannot be decided, so both branches under it stay; the other system's does not."""
    return packages.component_report(_described(spark, sf_dir), "linux", "x86_64")["modules"]


@query("exposed_modules", f"""{_DESCRIBED} SELECT package, string_agg(value, ',' ORDER BY value) AS modules FROM d WHERE p_size % 7 > 0 GROUP BY package""")
def exposed_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.exposed_modules(_described(spark, sf_dir)).select("package", F.array_join("modules", ",").alias("modules"))


@query("unreadable_descriptions", f"""{_DESCRIBED} SELECT DISTINCT '/' || package AS path, 'no package name' AS error FROM d WHERE p_size % 7 = 0""")
def unreadable_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.component_report(_described(spark, sf_dir), "linux", "x86_64")["errors"]


# -- checkouts and installed packages -------------------------------------------------------


@query("head_commits", """SELECT 'r' || p_partkey AS path, CASE p_partkey % 4 WHEN 0 THEN 'c' || p_size WHEN 1 THEN 'loose' || p_partkey WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'packed' || p_partkey END ELSE 'loose' || p_partkey END AS "commit" FROM part""")
def head_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    part = _part(spark, sf_dir).select(F.concat(F.lit("r"), key).alias("path"), "p_partkey", "p_size")
    repos = part.select("path", F.when(k % 4 == 0, F.concat(F.lit("c"), F.col("p_size").cast("string"), F.lit("\n"))).otherwise(F.concat(F.lit("ref: refs/heads/b"), key)).alias("head"))
    ref = F.concat(F.lit("refs/heads/b"), key).alias("ref")
    loose = part.where(k % 4 != 2).select("path", ref, F.concat(F.lit("loose"), key).alias("commit"))
    packed = part.where((k % 4 > 1) & (F.col("p_size") % 2 == 0)).select("path", ref, F.concat(F.lit("packed"), key).alias("commit"))
    return packages.head_commits(repos, loose, packed)


@query("picked_checkouts", """SELECT p_brand AS package, 'at' || p_partkey AS path FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(p_size = 7, false) DESC, p_partkey % 17 DESC, 'at' || p_partkey) = 1""")
def picked_checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("c"), F.col("p_size").cast("string")))
    rows = _part(spark, sf_dir).select(F.col("p_brand").alias("package"), F.concat(F.lit("at"), F.col("p_partkey").cast("string")).alias("path"), head.alias("head"), F.lit("c7").alias("wanted"), (F.col("p_partkey") % 17).alias("mtime"))
    return packages.picked_checkouts(rows).select("package", "path")


@query("synthetic_plan", "SELECT DISTINCT p_brand AS pkg, '1.' || p_size AS version, 'unpinned:' || p_brand || '-1.' || p_size AS unit_id, false AS is_local, 'distribution' AS origin FROM part")
def synthetic_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.synthetic_plan(_part(spark, sf_dir).select(F.col("p_brand").alias("name"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("version")).distinct())


# -- extensions -----------------------------------------------------------------------------

_EXTENSIONS = """impl AS MATERIALIZED (SELECT p_partkey AS flag, p_partkey // 2 AS implied, true AS state FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey // 3, p_partkey % 2 = 0 FROM part WHERE p_partkey > 3)"""


def _implications(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = _part(spark, sf_dir)
    two = part.where(k > 1).select(k.alias("flag"), F.expr("p_partkey div 2").alias("implied"), F.lit(True).alias("state"))
    return two.unionByName(part.where(k > 3).select(k.alias("flag"), F.expr("p_partkey div 3").alias("implied"), (k % 2 == 0).alias("state")))


def _implied_sql(rounds: int = 24) -> str:
    """Rounds written out: a flag implies ones of half its number at most."""
    out = [f"WITH {_EXTENSIONS}, s0 AS MATERIALIZED (SELECT DISTINCT p_partkey AS flag, true AS on_ FROM part WHERE p_size = 11), f0 AS MATERIALIZED (SELECT * FROM s0)"]
    for n in range(1, rounds + 1):
        out.append(f"""f{n} AS MATERIALIZED (SELECT i.implied AS flag, bool_and(i.state) AS on_ FROM f{n - 1} f JOIN impl i ON i.flag = f.flag WHERE f.on_ AND i.implied NOT IN (SELECT flag FROM s{n - 1}) GROUP BY i.implied),
s{n} AS MATERIALIZED (SELECT * FROM s{n - 1} UNION ALL SELECT * FROM f{n})""")
    return ", ".join(out) + f' SELECT flag, on_ AS "on" FROM s{rounds}'


@query("implied_flags", _implied_sql())
def implied_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.implied_flags(_implications(spark, sf_dir), _part(spark, sf_dir).where("p_size = 11").select(F.col("p_partkey").alias("flag")))


@query("applied_extensions", f"""WITH RECURSIVE {_EXTENSIONS}, settings AS MATERIALIZED (SELECT p_brand AS module, p_partkey AS pos, p_partkey AS flag, p_size % 4 > 0 AS state FROM part),
reach(flag, t) AS (SELECT DISTINCT flag, flag FROM settings WHERE state UNION SELECT r.flag, i.implied FROM reach r JOIN impl i ON i.flag = r.t WHERE i.state),
effects AS (SELECT flag, t, bool_and(on_) AS on_ FROM (SELECT flag, t, true AS on_ FROM reach UNION ALL SELECT r.flag, i.implied, false FROM reach r JOIN impl i ON i.flag = r.t WHERE NOT i.state) GROUP BY flag, t),
applied AS (SELECT module, pos, t, on_ FROM settings s JOIN effects e ON e.flag = s.flag WHERE s.state UNION ALL SELECT module, pos, flag, false FROM settings WHERE NOT state)
SELECT module, t AS flag FROM applied GROUP BY module, t HAVING arg_max(on_, pos)""")
def applied_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = _part(spark, sf_dir).select(F.col("p_brand").alias("module"), F.col("p_partkey").alias("pos"), F.col("p_partkey").alias("flag"), (F.col("p_size") % 4 > 0).alias("state"))
    return packages.applied_extensions(settings, _implications(spark, sf_dir))


# -- sites ------------------------------------------------------------------------------------


@query("package_sweep", """WITH decls AS (SELECT p_brand AS package, replace(p_type, ' ', '/') || '/' || p_size || '.hs' AS path, p_name AS name, p_partkey AS line FROM part),
asks AS (SELECT DISTINCT p_brand AS package, p_name AS name, 'src/' || replace(p_type, ' ', '/') || '/' || (p_size % 9) || '.hs' AS wanted FROM part WHERE p_size > 20),
hits AS (SELECT a.*, path, line, list_reverse(string_split(path, '/')) AS x, list_reverse(string_split(wanted, '/')) AS y FROM asks a JOIN decls d USING (package, name))
SELECT package, name, wanted, r.p AS path, r.l AS line FROM (SELECT package, name, wanted, min({'far': -len(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[1:i] = y[1:i])), 'p': path, 'l': line}) AS r FROM hits GROUP BY ALL)""")
def package_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every package is swept for names whose module no component lists; the file nearest to where
    the module's would be answers."""
    folder = F.replace("p_type", F.lit(" "), F.lit("/"))
    file = lambda n: F.concat(folder, F.lit("/"), n.cast("string"), F.lit(".hs"))
    part = _part(spark, sf_dir)
    decls = part.select(F.col("p_brand").alias("package"), file(F.col("p_size")).alias("path"), F.col("p_name").alias("name"), F.col("p_partkey").alias("line"))
    asks = part.where("p_size > 20").select(F.col("p_brand").alias("package"), F.col("p_name").alias("name"), F.concat(F.lit("src/"), file(F.col("p_size") % 9)).alias("wanted")).distinct()
    return declarations.swept(asks, decls)


@query("symbol_sites", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'resolve' WHEN p_size % 3 = 0 AND p_size % 5 > 0 THEN 'module_absent' ELSE 'sweep' END AS decision,
  CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN p_size > 9 WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS covers,
  CASE WHEN k IN ('class', 'data') THEN 't:' WHEN k IN ('value', 'method') THEN 'v:' ELSE '' END || p_name AS anchor, CASE WHEN p_partkey % 3 > 0 THEN p_partkey ELSE p_size END AS line,
  replace(replace(p_type, ' ', '/'), '/', '.') AS module FROM (SELECT *, ['class', 'value', 'other', 'data', 'method'][p_size % 5 + 1] AS k FROM part)""")
def symbol_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every symbol how it would be looked for, whether the module's exports may cover it, its
    anchor and line on a page, and the module of its file."""
    size, k = F.col("p_size"), F.col("p_partkey")
    item = lambda form, name: F.struct(F.lit(form).alias("form"), F.lit(name).alias("name"))
    own = F.when(size > 9, F.array(F.struct(F.lit("symbol").alias("form"), F.lit("x").alias("name")))).otherwise(F.array(item("symbol", "y")))
    exports = F.when(k % 5 == 1, own).when(k % 5 == 2, F.array(item("symbol", "y"), item("module", "M"))).when(k % 5 == 3, F.array(item("all", "T"))).when(k % 5 == 4, F.array().cast("array<struct<form:string,name:string>>"))
    kinds = F.get(F.array(*(F.lit(x) for x in ("class", "value", "other", "data", "method"))), (size % 5).cast("int"))
    rows = _part(spark, sf_dir).withColumns({"def_line": F.when(k % 3 > 0, k), "sig_line": size})
    return rows.select(
        "p_partkey", declarations.site_decision(size % 2 == 0, size % 3 == 0, size % 5 == 0).alias("decision"), declarations.could_export(exports, F.lit("x")).alias("covers"),
        declarations.entry_anchor(kinds, F.col("p_name")).alias("anchor"), declarations.anchor_line().alias("line"),
        ident.module_of_path(F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), F.lit(".hs"))).alias("module"),
    )


@query("exported_names", """SELECT DISTINCT p_partkey AS module, name FROM (SELECT p_partkey, unnest(CASE WHEN p_size % 3 = 0 THEN [p_type, p_name] WHEN p_size % 3 = 1 THEN [p_brand, p_type, p_brand] ELSE [] END) AS name FROM part)""")
def exported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules without a list, with one, and with an empty one."""
    size = F.col("p_size") % 3
    lists = F.when(size == 1, F.array("p_brand", "p_type", "p_brand")).when(size == 2, F.array().cast("array<string>"))
    return declarations.exported_names(_part(spark, sf_dir).select(F.col("p_partkey").alias("module"), lists.alias("exports"), F.array("p_type", "p_name").alias("declared")))


# -- a sorted index ---------------------------------------------------------------------------


@query("lookup_indexed", f"WITH {_NAMED}, {_VERSIONED} SELECT * FROM versioned WHERE name IN ('redBolt', 'hotGear') OR (name = 'coldPlate' AND mod = 'Cat.Promo')")
def lookup_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups that read only the files where the names stand."""
    index = NameIndex.build(catalog.versioned(spark, sf_dir))
    return index.find("redBolt").unionByName(index.find("hotGear")).unionByName(index.find("coldPlate", "Cat.Promo"))


@query("modules_in_both_stores", f"""WITH {_NAMED}, {_VERSIONED}, {_PINS}, scoped AS (SELECT v.* FROM versioned v JOIN pins p ON p.pkg = v.pkg WHERE p.pin_unit = v.unit_id OR p.pin_version = v.version),
asks AS (SELECT DISTINCT pkg, mod FROM versioned WHERE length(mod) % 2 = 0), own AS (SELECT * FROM scoped SEMI JOIN asks USING (pkg, mod) WHERE name < 'm'), others AS (SELECT * FROM scoped SEMI JOIN asks USING (pkg, mod) WHERE name > 'c')
SELECT * FROM own UNION ALL SELECT * FROM others o WHERE NOT EXISTS (SELECT 1 FROM own w WHERE (w.pkg, w.mod, w.name) = (o.pkg, o.mod, o.name))""")
def modules_in_both_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.versioned(spark, sf_dir)
    asks = rows.where("length(mod) % 2 = 0").select("pkg", "mod").distinct()
    return lookup.module_in_stores(asks, rows.where("name < 'm'"), rows.where("name > 'c'"), _pins(spark, sf_dir))


@query("planned_units", """WITH units AS (SELECT p_brand AS pkg, '1.' || p_size AS version, 'u' || p_partkey AS unit_id, p_partkey AS pos, p_size % 2 = 0 AS has_lib FROM part WHERE p_size < 30),
best AS (SELECT pkg, arg_max({'v': version, 'u': unit_id}, (has_lib, pos)) AS x FROM units GROUP BY pkg), asks AS (SELECT DISTINCT p_brand AS pkg FROM part UNION SELECT DISTINCT p_brand || 'x' FROM part)
SELECT pkg, x.v AS version, x.u AS unit_id FROM asks LEFT JOIN best USING (pkg)""")
def planned_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _part(spark, sf_dir)
    units = part.where("p_size < 30").select(F.col("p_brand").alias("pkg"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("version"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("unit_id"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 2 == 0).alias("has_lib"))
    return build_plan.planned(part.select(F.explode(F.array("p_brand", F.concat("p_brand", F.lit("x")))).alias("pkg")), units)


# -- presentations ----------------------------------------------------------------------------

# Definitions of which a third lies in a module that presents nothing.
_PRESENTED = f"""WITH {_NAMED}, {_symbols()}, moved AS (SELECT *, CASE WHEN length(name) % 3 = 0 THEN 'Hidden.' || def_module ELSE def_module END AS home FROM symbols), shown AS (
  SELECT *, row_number() OVER (PARTITION BY def_component, home, name ORDER BY visibility = 'internal', list_contains(string_split(module, '.'), 'Internal'), len(string_split(module, '.')), module, component, signature) AS rn FROM moved
), first AS (SELECT * FROM shown WHERE rn = 1), rest AS (SELECT s.def_component, s.home, s.name, s.component || ':' || s.module AS label, min(s.rn) AS rn, bool_or(s.component = s.def_component AND s.module = s.home) AS defines FROM shown s WHERE rn > 1 GROUP BY ALL),
listed AS (SELECT * FROM rest UNION ALL SELECT f.def_component, f.home, f.name, f.def_component || ':' || f.home, 1000000, true FROM first f
  WHERE (f.component, f.module) <> (f.def_component, f.home) AND NOT EXISTS (SELECT 1 FROM rest r WHERE (r.def_component, r.home, r.name) = (f.def_component, f.home, f.name) AND r.defines))
SELECT f.component, f.module, f.name, f.home AS def_module, coalesce(string_agg(label || CASE WHEN defines THEN ' (defines it)' ELSE '' END, ', ' ORDER BY l.rn), '') AS others
FROM first f LEFT JOIN listed l ON (l.def_component, l.home, l.name) = (f.def_component, f.home, f.name) GROUP BY f.component, f.module, f.name, f.def_component, f.home"""


@query("tagged_alternates", _PRESENTED)
def tagged_alternates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.searchable(catalog.symbols(spark, sf_dir)).where("kind = 'symbol'").withColumn("score", F.lit(1))
    rows = rows.withColumn("def_module", F.when(F.length("name") % 3 == 0, F.concat(F.lit("Hidden."), "def_module")).otherwise(F.col("def_module")))
    shown = F.transform("others", lambda p: F.concat(p["label"], F.when(p["defines"], " (defines it)").otherwise("")))
    return search.alternate_rows(search.collapse(rows)).select("component", "module", "name", "def_module", F.array_join(shown, ", ").alias("others"))
