"""Declarations: their documentation, merging, lookup by name, and where to look for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions.ident import shared_leading, trailing_parts
from symbolarium.plans.lineage import shuffled

#: Declaration kinds from general to specific.
KINDS = ["value", "type_signature", "pattern", "type", "type_family", "data_family", "data", "newtype", "class", "method", "constructor", "field"]


def documented(items: DataFrame) -> DataFrame:
    """``items(module, pos, kind, text, top)``, kinds ``decl``, ``doc_next`` and ``doc_prev``, to
    declarations with ``doc``: comments before a declaration that point on, and comments after
    it that point back to the last top-level one."""
    by = Window.partitionBy("module").orderBy("pos")
    ahead = by.rowsBetween(0, Window.unboundedFollowing)
    back = by.rowsBetween(Window.unboundedPreceding, 0)
    is_decl = F.col("kind") == "decl"
    target = (
        F.when(is_decl, F.col("pos")).when(F.col("kind") == "doc_next", F.first(F.when(is_decl, F.col("pos")), ignorenulls=True).over(ahead))
        .otherwise(F.last(F.when(is_decl & F.col("top"), F.col("pos")), ignorenulls=True).over(back))
    )
    placed = items.withColumn("at", target).where("at IS NOT NULL")
    docs = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~is_decl, F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    return placed.groupBy("module", F.col("at").alias("pos")).agg(F.max(F.when(is_decl, F.col("text"))).alias("name"), F.nullif(docs, F.lit("")).alias("doc"))


def merged(decls: DataFrame) -> DataFrame:
    """Pieces of one declaration (same module, name and parent) as one: the first signature,
    the most specific kind, documentation put together, and the span of them all."""
    rank = F.array_position(F.lit(KINDS), F.col("kind"))
    docs = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("doc").isNotNull(), F.struct("pos", "doc")))), lambda x: x["doc"]), "\n")
    return decls.groupBy("component", "module", "name", "parent").agg(
        F.max_by("kind", rank).alias("kind"), F.min_by("signature", F.when(F.col("signature").isNotNull(), F.col("pos"))).alias("signature"),
        F.nullif(docs, F.lit("")).alias("doc"), F.min("sig_line").alias("sig_line"), F.min("def_line").alias("def_line"),
        F.min(span_start()).alias("first_line"), F.max(span_end()).alias("last_line"),
    )


def span_start() -> Column:
    return F.least("doc_line", "sig_line", "def_line")


def span_end() -> Column:
    return F.greatest("doc_end", "sig_end", "def_end")


def anchor_line() -> Column:
    """Where a declaration is: its definition, else its signature."""
    return F.coalesce("def_line", "sig_line")


def entry_anchor(kind: Column, name: Column) -> Column:
    """The page anchor of an entry: types under ``t:``, values under ``v:``, others bare."""
    return F.concat(F.when(kind.isin("type", "type_family", "data_family", "data", "newtype", "class"), "t:").when(kind.isin("value", "type_signature", "method", "constructor", "field", "pattern"), "v:").otherwise(""), name)


def found_declarations(sites: DataFrame, decls: DataFrame) -> DataFrame:
    """``sites(component, module, name)`` to their declaration: by its own name, else as one
    of a declaration's ``siblings``; of several the first in the file."""
    direct = decls.select("component", "module", "name", F.lit(0).alias("how"), "pos", "kind", "signature")
    sibling = decls.select("component", "module", F.explode("siblings").alias("name"), F.lit(1).alias("how"), "pos", "kind", "signature")
    hits = sites.join(direct.unionByName(sibling), ["component", "module", "name"])
    best = hits.groupBy("component", "module", "name").agg(F.min_by(F.struct("kind", "signature", "how"), F.struct("how", "pos")).alias("x"))
    return best.select("component", "module", "name", "x.*")


def members(decls: DataFrame) -> DataFrame:
    """Containers that a module declares itself, with their members in order."""
    own = decls.where(F.col("kind").isin("class", "data", "newtype")).select("module", F.col("name").alias("parent")).distinct()
    inside = decls.where("parent IS NOT NULL").join(own, ["module", "parent"], "left_semi")
    listed = inside.groupBy("module", "parent").agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("x"))
    return listed.select("module", "parent", F.transform("x", lambda m: m["name"]).alias("members"))


def exported_names(interfaces: DataFrame) -> DataFrame:
    """Names of ``interfaces(module, exports, declared)``: the list, or without one (null, which
    an empty list is not) all that is declared."""
    return interfaces.select("module", F.explode(F.array_distinct(F.coalesce("exports", "declared"))).alias("name"))


def could_export(exports: Column, name: Column) -> Column:
    """Whether an export list may cover a name: no list, the name, or a form that hides names."""
    return exports.isNull() | F.exists(exports, lambda e: (e["form"] == "module") | (e["name"] == name) | (e["form"] == "all"))


def could_import(names: Column, hiding: Column, name: Column) -> Column:
    """``explicit`` if the list names it, ``open`` for imports without a list or a hiding list
    that omits it, else null."""
    listed = F.array_contains(names, name)
    return F.when(names.isNull(), "open").when(hiding & ~listed, "open").when(~hiding & listed, "explicit")


def ranked_candidates(asks: DataFrame) -> DataFrame:
    """``asks(module, name, candidates array<struct<target, how>>)`` to the targets to try in
    order: explicit before open, siblings before strangers, then by name; each once."""
    def part(how: str) -> Column:
        mine = F.filter("candidates", lambda c: c["how"] == how)
        order = F.transform(mine, lambda c: F.struct((-shared_leading(F.col("module"), c["target"])).alias("far"), c["target"].alias("target")))
        return F.transform(F.array_sort(order), lambda x: x["target"])

    return asks.select("module", "name", F.array_distinct(F.concat(part("explicit"), part("open"))).alias("targets"))


def nearest_files(asks: DataFrame, files: DataFrame, keys: list[str], *told: str) -> DataFrame:
    """For each of ``asks(*keys, wanted)`` the file of ``files(*keys, path, *told)`` whose path shares most
    with the one wanted from the right; of several the first by ``told``, which comes back as ``x``.

    Files stand under everything that their paths end in, the first one for each ending, and an ask
    takes the longest ending that has one. So asks and files that share ``keys`` never meet one by one."""
    ends = files.select(*keys, F.explode(trailing_parts(F.col("path"))).alias("tail"), F.struct(*told).alias("x"))
    first = ends.groupBy(*keys, "tail").agg(F.min("x").alias("x"))
    wanted = asks.select(*keys, "wanted").distinct().select(*keys, "wanted", F.explode(trailing_parts(F.col("wanted"))).alias("tail"))
    found = wanted.join(shuffled(first), [*keys, "tail"])
    return found.groupBy(*keys, "wanted").agg(F.max_by("x", F.col("tail.n")).alias("x"))


def swept(asks: DataFrame, decls: DataFrame) -> DataFrame:
    """Search a whole package: of the files that declare the name, the one whose path shares
    most with the path asked for, then the first by name. ``asks(package, name, wanted)``,
    ``decls(package, path, name, line)``."""
    files = decls.groupBy("package", "name", "path").agg(F.min("line").alias("line"))
    return nearest_files(asks, files, ["package", "name"], "path", "line").select("package", "name", "wanted", "x.path", "x.line")


def site_decision(listed: Column, readable: Column, has_file: Column) -> Column:
    """How to look for a symbol of a module: ``resolve`` where a component lists the module,
    ``module_absent`` if all components could be read and no file is there, else ``sweep``."""
    return F.when(listed, "resolve").when(readable & ~has_file, "module_absent").otherwise("sweep")


def entries(names: DataFrame, indexed: DataFrame, imported: DataFrame) -> DataFrame:
    """A page's entries ``names(module, name)``: from the index, else from an import's
    declarations, else a placeholder; ``origin`` says which."""
    first = indexed.groupBy("module", "name").agg(F.min("signature").alias("_a"))
    second = imported.groupBy("module", "name").agg(F.min("signature").alias("_b"))
    out = names.join(first, ["module", "name"], "left").join(second, ["module", "name"], "left")
    return out.select("module", "name", F.coalesce("_a", "_b").alias("signature"), F.when(F.col("_a").isNotNull(), "index").when(F.col("_b").isNotNull(), "import").otherwise("placeholder").alias("origin"))
