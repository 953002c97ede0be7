"""Re-export resolution: which module really defines each exported name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.plans.lineage import Gathered, cut, shuffled

_KEY = ["module", "name"]


def expanded_exports(exports: DataFrame, decls: DataFrame) -> DataFrame:
    """Export items ``(module, pos, form, item)`` to names ``(module, name, pos)``.

    ``symbol`` is itself, ``all`` also brings the members declared under it by this module,
    ``module`` what that module of the component lists as symbols; each name once, first place.
    A module without any item (no export list) exports all that it declares.
    """
    first = exports.groupBy("module", "form", "item").agg(F.min("pos").alias("pos"))  # repeated items would multiply in the joins
    own = first.where("form IN ('symbol', 'all')").select("module", F.col("item").alias("name"), "pos")
    members = first.where("form = 'all'").join(decls.select("module", F.col("parent").alias("item"), "name").distinct(), ["module", "item"]).select("module", "name", "pos")
    listed = own.select(F.col("module").alias("item"), "name").distinct()
    through = first.where("form = 'module'").join(listed, "item").select("module", "name", "pos")
    whole = decls.join(exports.select("module").distinct(), "module", "left_anti").select("module", "name", F.lit(0).alias("pos"))
    return own.unionByName(members).unionByName(through).unionByName(whole).groupBy(*_KEY).agg(F.min("pos").alias("pos"))


def outside_modules(exports: DataFrame, modules: DataFrame) -> DataFrame:
    """``module M`` forms that name no module of the component."""
    return exports.where("form = 'module'").select("module", "item").join(modules.select(F.col("module").alias("item")), "item", "left_anti").select("module", "item")


def resolve_exports(exported: DataFrame, decls: DataFrame, imports: DataFrame) -> DataFrame:
    """``exported(module, name)`` to ``(module, name, definer, round)``; what no import of the
    component supplies has a null definer.

    Round 0 is what a module declares. Each further round resolves, all at once, the names
    some viable import supplies: explicit imports before open ones, then by ``rank`` if there,
    then by target; the definer is the import's own. It ends when a round adds nothing.
    """
    if "rank" not in imports.columns:
        imports = imports.withColumn("rank", F.lit(0))
    options = cut(imports.select("module", "name", "target", F.struct(F.when(F.col("explicit"), 0).otherwise(1).alias("open"), "rank", "target").alias("order")))
    wanted = cut(exported.select(*_KEY).distinct())
    own = decls.select(*_KEY).distinct().withColumn("definer", F.col("module")).withColumn("round", F.lit(0))
    known, left, n = Gathered(cut(own)), cut(wanted.join(shuffled(own), _KEY, "left_anti")), 0
    while True:
        n += 1
        supply = known.rows.select(F.col("module").alias("target"), "name", "definer")
        found = left.join(shuffled(options), _KEY).join(shuffled(supply), ["target", "name"]).groupBy(*_KEY).agg(F.min_by("definer", "order").alias("definer"))
        told = cut(left.join(shuffled(found), _KEY, "left"))  # one table a round: what was found and what is left
        found = told.where("definer IS NOT NULL").withColumn("round", F.lit(n))
        if found.isEmpty():
            break
        known.add(found)
        left = told.where("definer IS NULL").select(*_KEY)
    nobody = left.select(*_KEY, F.lit(None).cast(dict(decls.dtypes)["module"]).alias("definer"), F.lit(None).cast("int").alias("round"))
    return wanted.join(shuffled(known.rows), _KEY).unionByName(nobody)


def extended_exports(env: DataFrame | None, rows: DataFrame, generation: int) -> DataFrame:
    """The export environment ``(module, name, presenter, def_component, def_module, signature,
    generation)`` with the rows ``(component, module, name, signature, def_component, def_module)`` of
    one more pass. A module and name keep all their presenters; of those that a probe cannot tell
    apart by the definition's component, the pass with the highest ``generation`` comes first."""
    added = rows.select("module", "name", F.col("component").alias("presenter"), "def_component", "def_module", "signature", F.lit(generation).alias("generation"))
    return added if env is None else env.unionByName(added)


def probe_exports(asks: DataFrame, exports: DataFrame, deps: DataFrame) -> DataFrame:
    """``asks(asker, module, name)`` against ``exports(module, name, presenter, def_component,
    ...)`` that the asker depends on (or presents itself): the definition of the first
    component, and the rejected rest. Within a component the latest ``generation`` comes first, if
    the exports have one (``extended_exports``), then the first module."""
    visible = deps.select(F.col("pkg").alias("asker"), F.col("dep_pkg").alias("presenter")).unionByName(asks.select("asker", F.col("asker").alias("presenter"))).distinct()
    hits = asks.join(exports, _KEY).join(visible, ["asker", "presenter"], "left_semi")
    age = -F.col("generation") if "generation" in exports.columns else F.lit(0)
    choice = F.struct("def_component", age.alias("age"), "def_module", "presenter")
    grouped = hits.groupBy("asker", *_KEY).agg(F.array_sort(F.collect_set(choice)).alias("all"))
    plain = F.transform("all", lambda c: F.struct(*(c[f].alias(f) for f in ("def_component", "def_module", "presenter"))))
    grouped = grouped.select("asker", *_KEY, plain.alias("all"))
    return grouped.select("asker", *_KEY, F.col("all")[0].alias("chosen"), F.slice("all", F.lit(2), F.size("all")).alias("rejected"))


def probe_candidates(asks: DataFrame, exports: DataFrame, deps: DataFrame) -> DataFrame:
    """``asks(asker, module, name, candidates)``: the first candidate module, in order, that a
    probe finds the name in. No row for names that none has."""
    each = asks.select("asker", F.col("module").alias("at"), "name", F.posexplode("candidates").alias("pos", "module"))
    found = probe_exports(each.select("asker", "module", "name").distinct(), exports, deps)
    joined = each.join(found, ["asker", "module", "name"])
    best = joined.groupBy("asker", "at", "name").agg(F.min_by(F.struct("module", "chosen", "rejected"), "pos").alias("x"))
    return best.select("asker", F.col("at").alias("module"), "name", F.col("x.module").alias("target"), "x.chosen", "x.rejected")


def repaired(unresolved: DataFrame, origins: DataFrame, exports: DataFrame, deps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names that interface dumps place: ``(found, still unresolved)``; origins are tried in
    their order."""
    asks = unresolved.join(origins.groupBy(*_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "origin_module"))), lambda x: x["origin_module"]).alias("candidates")), _KEY)
    found = probe_candidates(asks.select("asker", *_KEY, "candidates"), exports, deps)
    return found, unresolved.join(found.select("asker", *_KEY), ["asker", *_KEY], "left_anti")


def followed_chain(asks: DataFrame, decls: DataFrame, exported: DataFrame, imports: DataFrame, hops: int = 3, budget: int = 64) -> DataFrame:
    """Follow names ``asks(module, name)`` through imports, ring by ring: at most ``hops``
    rings and ``budget`` modules a name. ``(module, name, definer, hop, verdict)``; verdicts
    are found, exhausted (nothing left to follow) or stopped_at_bound."""
    options = imports.select(F.col("module").alias("at"), "name", "target", F.when(F.col("explicit"), 0).otherwise(1).alias("open"))
    options = options.join(shuffled(exported.select(F.col("module").alias("target"), "name")), ["target", "name"], "left_semi")
    declared = decls.select(F.col("module").alias("at"), "name").distinct()
    ring = cut(asks.select(*_KEY, F.col("module").alias("at"), F.lit(0).alias("open")).distinct())
    seen, found, hop = ring, None, 0
    while True:
        hit = ring.join(shuffled(declared), ["at", "name"], "left_semi").groupBy(*_KEY).agg(F.min(F.struct("open", "at")).alias("x")).select(*_KEY, F.col("x.at").alias("definer"), F.lit(hop).alias("hop"))
        found = cut(hit if found is None else found.unionByName(hit))
        live = ring.join(shuffled(found), _KEY, "left_anti")
        step = live.select(*_KEY, "at").join(shuffled(options), ["at", "name"]).groupBy("module", "name", F.col("target").alias("at")).agg(F.min("open").alias("open"))
        ring = cut(step.join(shuffled(seen), ["module", "name", "at"], "left_anti").select(*_KEY, "at", "open"))
        if hop == hops or ring.isEmpty():
            break
        spent = seen.groupBy(*_KEY).agg(F.count("*").alias("spent"))
        place = F.row_number().over(Window.partitionBy(*_KEY).orderBy("open", "at"))
        ring = cut(ring.withColumn("place", place).join(shuffled(spent), _KEY).where(F.col("place") + F.col("spent") <= budget).select(*_KEY, "at", "open"))
        seen, hop = seen.unionByName(ring), hop + 1
    bound = ring.select(*_KEY).distinct().withColumn("more", F.lit(True))
    return (
        asks.select(*_KEY).distinct().join(shuffled(found), _KEY, "left").join(shuffled(bound), _KEY, "left")
        .select(*_KEY, "definer", "hop", F.when(F.col("definer").isNotNull(), "found").when(F.col("more"), "stopped_at_bound").otherwise("exhausted").alias("verdict"))
    )
