"""Looking for definitions beyond one's own component: probing dependencies lazily, following a
re-export chain with bounds, and saying why a search ended without an answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolarium.functions.ident import shared_leading
from symbolarium.operators.cascade import outside_candidates, search_outcome
from symbolarium.operators.declarations import nearest_files
from symbolarium.plans.lineage import cut, shuffled

_ASK = ["component", "module", "name"]


def dependency_order(deps: DataFrame, roots: DataFrame) -> DataFrame:
    """``deps(pkg, pos, dep_pkg)`` to ``(root, pkg, place)``: what each of ``roots(pkg)`` reaches,
    nearest first; within a level by the order of whom brought it in, then its own list's. The root
    is left out; cycles end, as a package once placed does not come again.

    Every package has one row, the levels below it as lists. A round appends to a package's ``h``
    levels those of the packages on its last one, in their order, so levels double and a chain of n
    links takes log2(n) rounds. Lists are made for all packages of ``deps``, roots or not."""
    kind = dict(deps.dtypes)["dep_pkg"]
    each = deps.where("dep_pkg <> pkg").groupBy("pkg", "dep_pkg").agg(F.min("pos").alias("pos"))
    first = F.transform(F.array_sort(F.collect_list(F.struct("pos", "dep_pkg"))), lambda x: x["dep_pkg"])
    lists, h = cut(each.groupBy("pkg").agg(F.array(F.array("pkg"), first).alias("rings"))), 1
    nothing = F.array().cast(f"array<{kind}>")

    def lower(s: Column, j: Column) -> Column:
        fresh = F.array_except(F.flatten(F.transform("others", lambda o: F.coalesce(F.get(o, j), nothing))), s["seen"])
        return F.struct(F.concat(s["seen"], fresh).alias("seen"), F.concat(s["rings"], F.array(fresh)).alias("rings"))

    while True:
        longest = F.size("rings") == h + 1
        asked = lists.where(longest).select("pkg", F.posexplode(F.element_at("rings", h + 1)).alias("i", "via"))
        told = asked.join(shuffled(lists.select(F.col("pkg").alias("via"), "rings")), "via")
        others = F.transform(F.array_sort(F.collect_list(F.struct("i", "rings"))), lambda x: x["rings"])
        joined = lists.join(shuffled(told.groupBy("pkg").agg(others.alias("others"))), "pkg", "left")
        start = F.struct(F.flatten("rings").alias("seen"), F.col("rings").alias("rings"))
        longer = F.filter(F.aggregate(F.sequence(F.lit(1), F.lit(h)), start, lower)["rings"], lambda r: F.size(r) > 0)
        lists, h = cut(joined.select("pkg", F.when(F.col("others").isNull(), F.col("rings")).otherwise(longer).alias("rings"))), 2 * h
        if lists.where(F.size("rings") == h + 1).isEmpty():
            break
    own = roots.select("pkg").distinct()
    below = F.flatten(F.slice("rings", F.lit(2), F.size("rings")))
    placed = lists.join(shuffled(own), "pkg", "left_semi").select(F.col("pkg").alias("root"), F.posexplode(below).alias("place", "pkg"))
    return placed.select("root", "pkg", (F.col("place") + 1).alias("place"))


def probed_modules(
    asks: DataFrame, order: DataFrame, index: Callable[[DataFrame], DataFrame], local: DataFrame, owners: DataFrame, plan: DataFrame, fetchable: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Where ``asks(root, module)`` find their module among the dependencies ``order(root, pkg,
    place)`` of the root, and what could not be read.

    Dependencies are asked nearest first, in waves of 1, 2, 4, ... places: an ask goes on only while
    all before failed. ``index(pkgs)`` gives ``(pkg, module)`` and is called for packages that no
    wave has indexed yet, so each is indexed once for all asks; only those of ``local(pkg,
    has_list)``, whose source is there, are. An ask that all have failed goes to its owner: of
    ``owners(module, pkg, pos)`` the first that ``plan(pkg)`` has is fetched, if ``fetchable(pkg)``,
    and answers every open ask of its root.

    Returns ``(root, module, pkg, place, how, touched)`` with ``how`` ``dependency``, ``owner`` or
    null and how many dependencies the ask touched; and ``(root, kind, pkg, module)``: gaps of the
    kinds ``unit_not_in_plan``, ``no_local_source``, ``no_module_list`` (of touched dependencies),
    ``owner_unaskable`` and ``owner_unfetchable``."""
    asks, order = cut(asks.select("root", "module").distinct()), cut(order)
    most = order.agg(F.max("place")).first()[0] or 0
    spark, open_, found, known, done = asks.sparkSession, asks, None, None, 1
    while done <= most:
        upto = 2 * done
        wave = order.where((F.col("place") >= done) & (F.col("place") < upto)).join(shuffled(open_.select("root").distinct()), "root", "left_semi")
        new = wave.select("pkg").distinct().join(local.select("pkg"), "pkg", "left_semi")
        if known is not None:
            new = new.join(known.select("pkg").distinct(), "pkg", "left_anti")
        # A package without any module is known as well: a row without a module stands for it.
        new = cut(new)
        made = cut(index(new).select("pkg", "module").unionByName(new.select("pkg", F.lit(None).cast("string").alias("module"))))
        known = made if known is None else known.unionByName(made)
        # By package first: a module that many packages have would bring all of them to all its asks.
        held = wave.join(shuffled(known.where("module IS NOT NULL")), "pkg").join(shuffled(open_), ["root", "module"])
        hit = cut(held.groupBy("root", "module").agg(F.min(F.struct("place", "pkg")).alias("x")).select("root", "module", "x.place", "x.pkg"))
        found = hit if found is None else found.unionByName(hit)
        open_ = cut(open_.join(shuffled(hit), ["root", "module"], "left_anti"))
        done = upto
        if open_.isEmpty():
            break
    if found is None:
        found = spark.createDataFrame([], "root string, module string, place int, pkg string")
    first = owners.join(plan.select("pkg").distinct(), "pkg", "left_semi").groupBy("module").agg(F.min_by("pkg", F.struct("pos", "pkg")).alias("owner"))
    owned = cut(open_.join(first, "module", "left").join(owners.select("module").distinct().withColumn("askable", F.lit(True)), "module", "left"))
    can = fetchable.select(F.col("pkg").alias("owner"), F.lit(True).alias("can")).distinct()
    fetched = cut(owned.where("owner IS NOT NULL").select("root", "owner").distinct().join(can, "owner", "left"))
    there = fetched.where("can").select("root", "owner")
    brought = cut(index(there.select(F.col("owner").alias("pkg")).distinct()).select(F.col("pkg").alias("owner"), "module"))
    late = there.join(shuffled(brought), "owner").join(shuffled(open_), ["root", "module"]).groupBy("root", "module").agg(F.min("owner").alias("owner"))
    count = order.groupBy("root").agg(F.max("place").alias("all"))
    answers = asks.join(shuffled(found), ["root", "module"], "left").join(shuffled(late), ["root", "module"], "left").join(shuffled(count), "root", "left").select(
        "root", "module", F.coalesce("pkg", "owner").alias("pkg"), "place",
        F.when(F.col("pkg").isNotNull(), "dependency").when(F.col("owner").isNotNull(), "owner").alias("how"),
        F.coalesce("place", "all", F.lit(0)).alias("touched"),
    )
    answers = cut(answers)
    nothing = F.lit(None).cast("string")
    deepest = answers.groupBy("root").agg(F.max("touched").alias("touched"))
    touched = order.join(shuffled(deepest), "root").where("place <= touched").select("root", "pkg").join(local.groupBy("pkg").agg(F.max("has_list").alias("has_list")), "pkg", "left")
    gaps = touched.where("has_list IS NULL").select("root", F.lit("no_local_source").alias("kind"), "pkg", nothing.alias("module"))
    gaps = gaps.unionByName(touched.where("NOT has_list").select("root", F.lit("no_module_list").alias("kind"), "pkg", nothing.alias("module")))
    unknown = asks.select("root").distinct().join(plan.select(F.col("pkg").alias("root")), "root", "left_anti")
    gaps = gaps.unionByName(unknown.select("root", F.lit("unit_not_in_plan").alias("kind"), F.col("root").alias("pkg"), nothing.alias("module")))
    gaps = gaps.unionByName(owned.where("askable IS NULL").select("root", F.lit("owner_unaskable").alias("kind"), nothing.alias("pkg"), "module"))
    failed = owned.join(fetched.where("can IS NULL"), ["root", "owner"]).select("root", F.lit("owner_unfetchable").alias("kind"), F.col("owner").alias("pkg"), "module")
    return answers, gaps.unionByName(failed)


def chained_searches(
    asks: DataFrame, starts: DataFrame, reach: DataFrame, parsed: DataFrame, decls: DataFrame, exported: DataFrame, imports: DataFrame, hops: int = 3, budget: int = 64
) -> DataFrame:
    """Follow ``asks(component, module, name)`` from their candidates ``starts(.., candidates)`` ring
    by ring.

    Of a ring, in order, every candidate that ``reach(component, target, home)`` has costs one of
    ``budget`` parses; those of ``parsed(component, module)`` tell something. The first that both
    declares and exports the name is the definition. Else the next ring is what the read ones
    import: explicit imports of all parents before open ones, in the parents' order, nearest first,
    none that was asked before. A candidate that several parents offer is asked once.

    ``(component, module, name, def_component, definer, hop, failure, candidates, frontier)``:
    failures are ``no_supplier`` (``candidates`` has the first ring), ``hop_limit`` (``frontier``
    has what was not asked any more) and ``parse_budget``."""
    homes = cut(reach.groupBy("component", "target").agg(F.min("home").alias("home")))
    good = parsed.select(F.col("component").alias("home"), F.col("module").alias("target")).distinct().withColumn("good", F.lit(True))
    both = decls.select("component", "module", "name").distinct().join(shuffled(exported.select("component", "module", "name").distinct()), ["component", "module", "name"])
    declares = cut(both.select(F.col("component").alias("home"), F.col("module").alias("target"), "name"))
    offers = cut(imports.groupBy(F.col("component").alias("home"), F.col("module").alias("at"), "name", "target").agg(F.max("explicit").alias("explicit")))
    ring = cut(asks.select(*_ASK).distinct().join(shuffled(starts), _ASK).select(*_ASK, F.posexplode("candidates").alias("place", "target")))
    out, seen, spent, hop = [], None, None, 0
    live = cut(asks.select(*_ASK).distinct())
    while True:
        hop += 1
        fresh = ring if seen is None else ring.join(shuffled(seen), [*_ASK, "target"], "left_anti")
        fresh = cut(fresh)
        drained = live.join(shuffled(fresh.select(*_ASK).distinct()), _ASK, "left_anti")
        out.append(_ended(drained, hop - 1, "no_supplier"))
        live = cut(live.join(shuffled(fresh.select(*_ASK).distinct()), _ASK, "left_semi"))
        if live.isEmpty():
            break
        if hop > hops:
            listed = fresh.groupBy(*_ASK).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "target"))), lambda x: x["target"]).alias("frontier"))
            out.append(_ended(live, hop - 1, "hop_limit").drop("frontier").join(shuffled(listed), _ASK))
            break
        costly = fresh.join(shuffled(homes), ["component", "target"])
        number = F.row_number().over(Window.partitionBy(*_ASK).orderBy("place"))
        costly = costly.withColumn("number", number)
        costly = costly.withColumn("left", F.lit(budget)) if spent is None else costly.join(shuffled(spent), _ASK, "left").withColumn("left", budget - F.coalesce("spent", F.lit(0))).drop("spent")
        costly = cut(costly.join(shuffled(good), ["home", "target"], "left"))
        read = costly.where("number <= left AND good")
        hit = read.join(shuffled(declares), ["home", "target", "name"], "left_semi").groupBy(*_ASK).agg(F.min(F.struct("place", "home", "target")).alias("x"))
        hit = cut(hit.select(*_ASK, F.col("x.home").alias("def_component"), F.col("x.target").alias("definer")))
        out.append(_ended(hit, hop, None))
        live = live.join(shuffled(hit), _ASK, "left_anti")
        over = costly.where("number > left").select(*_ASK).distinct()
        out.append(_ended(live.join(shuffled(over), _ASK, "left_semi"), hop, "parse_budget"))
        live = cut(live.join(shuffled(over), _ASK, "left_anti"))
        used = costly.groupBy(*_ASK).agg(F.count("*").alias("used"))
        spent = used.withColumnRenamed("used", "spent") if spent is None else spent.join(shuffled(used), _ASK, "full_outer").select(*_ASK, (F.coalesce("spent", F.lit(0)) + F.coalesce("used", F.lit(0))).alias("spent"))
        spent = cut(spent)
        seen = fresh.select(*_ASK, "target") if seen is None else cut(seen.unionByName(fresh.select(*_ASK, "target")))
        step = read.join(shuffled(live), _ASK, "left_semi").select(*_ASK, "home", F.col("target").alias("at"), F.col("place").alias("parent")).join(shuffled(offers), ["home", "at", "name"])
        rank = F.struct((~F.col("explicit")).alias("open"), "parent", (-shared_leading(F.col("at"), F.col("target"))).alias("far"))
        best = step.groupBy(*_ASK, "target").agg(F.min(rank).alias("rank"))
        ring = best.select(*_ASK, "target", F.row_number().over(Window.partitionBy(*_ASK).orderBy("rank", "target")).alias("place"))
    ended = out[0]
    for more in out[1:]:
        ended = ended.unionByName(more)
    first = starts.select(*_ASK, "candidates")
    ended = ended.join(shuffled(first), _ASK, "left")
    return ended.withColumn("candidates", F.when(F.col("failure") == "no_supplier", F.col("candidates")))


def _ended(rows: DataFrame, hop: int, failure: str | None) -> DataFrame:
    """``rows`` in the columns of an outcome, whatever of them they lack null."""
    have = rows.columns
    nothing = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind).alias(c)
    return rows.select(*_ASK, nothing("def_component"), nothing("definer"), F.lit(hop).alias("hop"), F.lit(failure).cast("string").alias("failure"), nothing("frontier", "array<string>"))


def searched_symbols(
    asks: DataFrame, packages: DataFrame, listed: DataFrame, files: DataFrame, parsed: DataFrame, sites: DataFrame,
    decls: DataFrame, exported: DataFrame, imports: DataFrame, reach: DataFrame, gaps: DataFrame, hops: int = 3, budget: int = 64,
) -> DataFrame:
    """The definition of every ``asks(component, module, name)``, or why there is none.

    ``packages(component, directory, readable)`` says whether the component's stanzas could be read,
    ``listed(component, module)`` what they list, ``files(component, module)`` which modules have a
    file, ``parsed(component, module)`` which could be parsed, ``sites(component, module, name,
    definer)`` what resolution within the component gave (null: it comes from outside). The rest is
    as in ``chained_searches``; ``gaps(component, gap)`` are the texts of what could not be read.

    A module that no stanza lists is ``module_absent`` if the stanzas were readable and it has no
    file; else the package's declarations are swept, those in the file whose path shares most with
    the module's first, and nothing there is ``swept_package``. A listed module fails as
    ``module_unparsed``, ``not_exported`` or ``not_declared`` by itself, or as the chain does. Columns: ``component, module, name,
    def_component, definer, hop, failure, resolved_to, candidates, frontier, directory, gaps,
    verdict``. Repeated asks are one."""
    asks = cut(asks.select(*_ASK).distinct())
    mark = lambda rows, c: rows.select("component", "module").distinct().withColumn(c, F.lit(True))
    held = packages.groupBy("component").agg(F.min("directory").alias("directory"), F.bool_or("readable").alias("readable"))
    seen = asks.join(shuffled(mark(listed, "is_listed")), ["component", "module"], "left").join(shuffled(mark(files, "has_file")), ["component", "module"], "left")
    seen = seen.join(shuffled(mark(parsed, "is_parsed")), ["component", "module"], "left").join(held, "component", "left")
    site = sites.select(*_ASK, "definer").groupBy(*_ASK).agg(F.min("definer").alias("site"), F.lit(True).alias("has_site"))
    at = parsed.select("component", F.col("module").alias("site")).distinct().withColumn("site_parsed", F.lit(True))
    said = decls.select("component", F.col("module").alias("site"), "name").distinct().withColumn("said", F.lit(True))
    seen = cut(seen.join(shuffled(site), _ASK, "left").join(shuffled(at), ["component", "site"], "left").join(shuffled(said), ["component", "site", "name"], "left"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    absent = ~yes("is_listed") & yes("readable") & ~yes("has_file")
    state = (
        F.when(absent, "module_absent").when(~yes("is_listed"), "sweep").when(~yes("is_parsed"), "module_unparsed").when(~yes("has_site"), "not_exported")
        .when(F.col("site").isNull(), "chain").when(~yes("site_parsed"), "module_unparsed").when(~yes("said"), "not_declared").otherwise("found")
    )
    seen = seen.withColumn("state", state)
    sweep = seen.where("state = 'sweep'").select(*_ASK)
    path = lambda c: F.concat(F.replace(F.col(c), F.lit("."), F.lit("/")), F.lit(".hs"))
    there = decls.select("component", "name", F.col("module").alias("at"), path("module").alias("path")).distinct()
    swept = nearest_files(sweep.withColumn("wanted", path("module")), there, ["component", "name"], "at")
    swept = sweep.withColumn("wanted", path("module")).join(shuffled(swept), ["component", "name", "wanted"]).select(*_ASK, F.col("x.at").alias("swept"))
    chain = seen.where("state = 'chain'").select(*_ASK)
    starts = outside_candidates(chain.select("module", "name", "component"), imports.select("module", "name", "target", "explicit", "component"), keys=_ASK)
    followed = chained_searches(chain, starts, reach, parsed, decls, exported, imports, hops, budget)
    followed = followed.select(*_ASK, F.col("def_component").alias("far_component"), F.col("definer").alias("far_definer"), "hop", F.col("failure").alias("far_failure"), "candidates", "frontier")
    texts = gaps.groupBy("component").agg(F.array_sort(F.collect_set("gap")).alias("gaps"))
    rows = seen.join(shuffled(swept), _ASK, "left").join(shuffled(followed), _ASK, "left").join(texts, "component", "left")
    definer = F.when(F.col("state") == "found", F.col("site")).when(F.col("state") == "sweep", F.col("swept")).otherwise(F.col("far_definer"))
    failure = F.when(definer.isNotNull(), None).when(F.col("state") == "sweep", "swept_package").when(F.col("state") == "chain", F.col("far_failure")).otherwise(F.col("state"))
    resolved = F.when(F.col("state") == "not_declared", F.col("site")).when(F.col("state") == "module_unparsed", F.when(yes("is_parsed"), F.col("site")).otherwise(F.col("module")))
    own = F.when(definer.isNotNull(), F.coalesce("far_component", "component"))
    every = F.coalesce("gaps", F.array().cast("array<string>"))
    return rows.select(
        *_ASK, own.alias("def_component"), definer.alias("definer"), F.when(definer.isNotNull(), F.col("hop")).alias("hop"), failure.alias("failure"), resolved.alias("resolved_to"), "candidates", "frontier",
        F.when(failure == "swept_package", F.col("directory")).alias("directory"), every.alias("gaps"),
        F.when(failure.isNull(), "found").otherwise(search_outcome(failure, F.size(every) > 0)).alias("verdict"),
    )


def search_actions(hops: int = 3, budget: int = 64) -> Column:
    """What a caller can go on with after a failed search of ``searched_symbols``, as a map: what was
    asked, how the search ended and on what, and what could not be read; empty for a found one."""
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    listed = lambda c: F.array_join(F.col(c), ", ")
    only = lambda kind, value: F.when(F.col("failure") == kind, value)
    entries = F.array(
        pair("package", F.col("component")), pair("module", F.col("module")), pair("symbol", F.col("name")), pair("search", F.col("verdict")),
        pair("candidates_considered", only("no_supplier", listed("candidates"))), pair("hop_limit", only("hop_limit", F.lit(str(hops)))), pair("stopped_at", only("hop_limit", listed("frontier"))),
        pair("parse_budget", only("parse_budget", F.lit(str(budget)))), pair("resolved_to", F.col("resolved_to")), pair("scanned", F.col("directory")),
        pair("unreadable_dependencies", F.when(F.size("gaps") > 0, F.array_join("gaps", "; "))),
    )
    told = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return F.when(F.col("failure").isNotNull(), told).otherwise(F.create_map().cast("map<string,string>"))
