"""Dependency graphs: direct edges, closures, levels; rounds of joins over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.plans.lineage import Gathered, cut, shuffled


def forward(deps: DataFrame, pkg, limit: int | None = None) -> DataFrame:
    """Direct dependencies in plan order; ``limit`` cuts the list (it is no depth)."""
    out = deps.where(F.col("pkg") == pkg).orderBy("pos").select("pkg", "pos", "dep_pkg")
    return out if limit is None else out.limit(limit)


def reverse(deps: DataFrame, pkg) -> DataFrame:
    return deps.where(F.col("dep_pkg") == pkg).select("pkg").distinct().orderBy("pkg")


def closure(deps: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """Everything reachable from ``roots(pkg)``, roots left out, with its nearest level.

    A frontier is joined with the edges until it brings nothing new; a visited package
    never returns, so cycles end. ``most`` bounds the level. Roots without any edge reach
    nothing; ``missing_roots`` tells those that the plan does not have.
    """
    edges = deps.select(F.col("pkg").alias("from"), F.col("dep_pkg").alias("pkg")).distinct()
    frontier, level = cut(roots.select("pkg", F.lit(0).alias("level")).distinct()), 0
    visited = Gathered(frontier)
    while most is None or level < most:
        level += 1
        step = frontier.select(F.col("pkg").alias("from")).join(edges, "from").select("pkg").distinct()
        frontier = cut(step.join(visited.rows, "pkg", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        visited.add(frontier)
    return visited.rows.where("level > 0")


def missing_roots(units: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``roots(pkg)`` that are no package of ``units(pkg)``."""
    return roots.select("pkg").distinct().join(units.select("pkg"), "pkg", "left_anti")


def levels(deps: DataFrame, subset: DataFrame) -> DataFrame:
    """Dependencies-first levels of ``subset(pkg)``: a package is one above its highest
    dependency in the subset. What a cycle keeps from ever being ready comes last, together.
    """
    own = subset.select("pkg").distinct()
    edges = deps.select("pkg", "dep_pkg").distinct().where("pkg <> dep_pkg").join(shuffled(own), "pkg", "left_semi").join(shuffled(own.withColumnRenamed("pkg", "dep_pkg")), "dep_pkg", "left_semi")
    edges, left = cut(edges), cut(own)
    out, level = None, 0
    while True:
        ready = cut(left.join(shuffled(edges), "pkg", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            rest = left.withColumn("level", F.lit(level))
            return rest if out is None else out.unionByName(rest)
        out = ready if out is None else out.unionByName(ready)
        left = cut(left.join(shuffled(ready), "pkg", "left_anti"))
        edges = cut(edges.join(shuffled(ready.select(F.col("pkg").alias("dep_pkg"))), "dep_pkg", "left_anti"))
        level += 1


def recursive_levels(deps: DataFrame, roots: DataFrame) -> DataFrame:
    """Nearest levels of an acyclic graph by one recursive query; for cyclic ones, and where Spark's
    own limit of rows for recursive queries is too low, see ``closure``.

    Each step keeps its packages once, so shared dependencies are not walked once a path; it goes
    on until a step is empty, for a million steps at most."""
    spark = deps.sparkSession
    deps.createOrReplaceTempView("symbolarium_deps")
    roots.createOrReplaceTempView("symbolarium_roots")
    return spark.sql("""
        WITH RECURSIVE walk(pkg, level) MAX RECURSION LEVEL 1000000 AS (
          SELECT pkg, 0 FROM symbolarium_roots
          UNION ALL
          SELECT DISTINCT d.dep_pkg, w.level + 1 FROM walk w JOIN symbolarium_deps d ON d.pkg = w.pkg
        )
        SELECT pkg, min(level) AS level FROM walk GROUP BY pkg HAVING min(level) > 0
    """)
