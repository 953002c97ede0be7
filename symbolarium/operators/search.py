"""Ranked search: scores as one expression, presentations folded by definition.

All of it is built-in expressions: one scan, one aggregation on the definition, and a
top-k. The scope is applied to rows, below the aggregation, as a definition that several
components present must be found in each of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolarium.functions.text import is_subsequence_of, percent_encoded

LIMIT = 50


class QueryError(ValueError):
    """A query text that cannot be understood; ``code`` says why."""

    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class SearchQuery:
    text: str
    scope: str | None = None

    @property
    def tokens(self) -> list[str]:
        return self.text.lower().split()


def parse_query(text: str, toggle: str | None = None, known: Sequence[str] | None = None) -> SearchQuery:
    """``pkg:<component>`` anywhere sets the scope; the rest is free text.

    The same scope twice is fine, two different ones or an empty one are errors. A typed
    scope beats ``toggle``; an empty toggle is none; with ``known`` an unknown one is an error.
    """
    scopes, rest = [], []
    for word in text.split():
        (scopes if word.startswith("pkg:") else rest).append(word)
    named = list(dict.fromkeys(s.removeprefix("pkg:") for s in scopes))
    if "" in named:
        raise QueryError("empty_scope")
    if len(named) > 1:
        raise QueryError("conflicting_scopes", ", ".join(named))
    scope = named[0] if named else toggle or None
    if scope is not None and known is not None and scope not in known:
        raise QueryError("unknown_component", scope)
    return SearchQuery(" ".join(rest), scope)


def searchable(symbols: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """Entities with lower-cased columns: symbols, the modules they imply, and packages
    ``(pkg, version)``. Persist it once; every search reads only this."""
    none = F.lit(None).cast("string")
    cols = lambda kind, **c: [F.lit(kind).alias("kind"), *(c.get(n, none).alias(n) for n in ("component", "module", "name", "signature", "def_component", "def_module", "visibility", "version"))]
    c = F.col
    rows = symbols.select(*cols("symbol", **{n: c(n) for n in ("component", "module", "name", "signature", "def_component", "def_module", "visibility")}))
    modules = symbols.select("component", "module", "visibility").distinct().select(*cols("module", component=c("component"), module=c("module"), visibility=c("visibility")))
    out = rows.unionByName(modules)
    if packages is not None:
        out = out.unionByName(packages.select("pkg", "version").distinct().select(*cols("package", component=c("pkg"), version=c("version"))))
    low = lambda n: F.lower(F.coalesce(n, F.lit("")))
    return out.withColumns({"pkg_l": low("component"), "mod_l": low("module"), "name_l": low("name"), "name_len": F.length(F.coalesce("name", F.lit("")))}).withColumn(
        "qual_l", F.concat("pkg_l", F.lit("."), "mod_l", F.lit("."), "name_l")
    )


def token_score(token: str) -> Column:
    """What one token is worth on a row, the first rule that fits; null if none does."""
    name, mod, qual, pkg, t = F.col("name_l"), F.col("mod_l"), F.col("qual_l"), F.col("pkg_l"), F.lit(token)
    ladder = [
        (name == t, 1000), (name.startswith(t), 700), (name.contains(t), 500), (mod == t, 400), (mod.startswith(t), 300),
        (mod.contains(t), 220), (qual.contains(t), 200), (pkg.contains(t), 150), (is_subsequence_of(token, name), 80), (is_subsequence_of(token, qual), 30),
    ]
    out = F.lit(None).cast("int")
    for rule, worth in reversed(ladder):
        out = F.when(rule, worth).otherwise(out)
    return out


def row_score(tokens: list[str]) -> Column:
    """Null unless every token fits; else the tokens' worth and the bonuses for short names,
    for an entity named exactly, and for visible rows."""
    total = F.greatest(F.lit(0), 60 - F.col("name_len"))
    for t in tokens:
        total = total + token_score(t)
    kind = F.lit(0)
    if len(tokens) == 1:
        kind = F.when((F.col("kind") == "package") & (F.col("pkg_l") == tokens[0]), 100000).when((F.col("kind") == "module") & (F.col("mod_l") == tokens[0]), 50000).otherwise(0)
    return total + kind + F.when((F.col("kind") != "package") & (F.col("visibility") == "exposed"), 20).otherwise(0)


def ranked(entities: DataFrame, query: SearchQuery) -> DataFrame:
    """Rows of the scope that match all tokens, with ``score``; no token, no rows."""
    if not query.tokens:
        return entities.withColumn("score", F.lit(0)).where(F.lit(False))
    scoped = entities if query.scope is None else entities.where(F.col("component") == query.scope)
    return scoped.withColumn("score", row_score(query.tokens)).where("score IS NOT NULL")


def presentation_rank() -> Column:
    """Exposed, then without an Internal segment, then short, then by module and component."""
    parts = F.split("module", r"\.")
    return F.struct(
        F.when(F.col("visibility") == "exposed", 0).otherwise(1).alias("hidden"), F.array_contains(parts, "Internal").cast("int").alias("internal"),
        F.size(parts).alias("depth"), F.col("module").alias("module"), F.col("component").alias("component"), F.col("signature").alias("signature"),
    )


def labelled(rows: DataFrame) -> DataFrame:
    """Rows with the label they are shown by, ``component:module.name``, the page they link to, and
    whether they present the definition itself."""
    label = F.concat("component", F.lit(":"), "module", F.coalesce(F.concat(F.lit("."), "name"), F.lit("")))
    href = F.concat(F.lit("/pkg/"), percent_encoded(F.col("component")), F.lit("/"), percent_encoded(F.col("module")), F.coalesce(F.concat(F.lit("#v:"), percent_encoded(F.col("name"))), F.lit("")))
    home = F.col("component").eqNullSafe(F.col("def_component")) & F.col("module").eqNullSafe(F.col("def_module"))
    return rows.withColumns({"label": label, "href": href, "is_definition": home})


def collapse(rows: DataFrame) -> DataFrame:
    """One result for each definition and name: placed by its best score, shown by its best
    presentation, the other presentations as ``alternates``, best first. Rows that are no
    symbols pass through."""
    place = lambda x: F.struct(x["component"].alias("component"), x["module"].alias("module"))
    grouped = (
        rows.where("kind = 'symbol'").groupBy("def_component", "def_module", "name")
        .agg(F.max("score").alias("score"), F.array_sort(F.collect_list(presentation_rank())).alias("shown"))
        .select(
            F.lit("symbol").alias("kind"), F.col("shown")[0]["component"].alias("component"), F.col("shown")[0]["module"].alias("module"), "name",
            F.col("shown")[0]["signature"].alias("signature"), "def_component", "def_module", "score",
            F.array_distinct(F.transform(F.slice("shown", F.lit(2), F.size("shown")), place)).alias("alternates"),
        )
    )
    none = F.array().cast("array<struct<component:string,module:string>>")
    others = rows.where("kind <> 'symbol'").select("kind", "component", "module", "name", "signature", "def_component", "def_module", "score", none.alias("alternates"))
    return grouped.unionByName(others)


def alternate_rows(results: DataFrame) -> DataFrame:
    """Results of ``collapse`` with ``others``, an array of ``component, module, label, defines``: the
    places a symbol is presented under beside the one shown, the defining one tagged where it is
    among them and appended where it is neither there nor the one shown."""
    place = lambda component, module: F.struct(component.alias("component"), module.alias("module"))
    defined, landed = place(F.col("def_component"), F.col("def_module")), place(F.col("component"), F.col("module"))
    extra = (F.col("kind") == "symbol") & F.col("def_component").isNotNull() & (defined != landed) & ~F.array_contains("alternates", defined)
    listed = F.concat("alternates", F.when(extra, F.array(defined)).otherwise(F.array().cast("array<struct<component:string,module:string>>")))
    label = lambda p: F.concat(p["component"], F.lit(":"), p["module"])
    tagged = F.transform(listed, lambda p: F.struct(p["component"].alias("component"), p["module"].alias("module"), label(p).alias("label"), (p == defined).alias("defines")))
    return results.withColumn("others", tagged)


def search(entities: DataFrame, query: SearchQuery, limit: int = LIMIT) -> DataFrame:
    """The ``limit`` best results; ties by component, module, name, then definition."""
    order = [F.desc("score"), F.asc_nulls_first("component"), F.asc_nulls_first("module"), F.asc_nulls_first("name"), F.asc_nulls_first("def_component"), F.asc_nulls_first("def_module"), "kind"]
    return collapse(ranked(entities, query)).orderBy(*order).limit(limit)
