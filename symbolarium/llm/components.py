"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolarium.llm.workspace import partitions, stored

#: Rows of a round's tables that one task writes, where there are fewer of them than partitions hold.
TASK_ROWS = 50_000


def _written(df: DataFrame, name: str, most: int) -> DataFrame:
    """``df`` of at most ``most`` rows, stored by as many tasks as they need, not by one a partition."""
    return stored(df.coalesce(max(1, min(partitions(df.sparkSession), -(-most // TASK_ROWS)))), name)


def components(edges: DataFrame, name: str = "components", most: int | None = None) -> DataFrame:
    """``edges(a, b)`` of longs to ``(node, component)``: the smallest node reachable.

    Every round lets each node hand its larger neighbours to its smallest one, then its
    smaller ones; both steps keep connectivity and aggregate with map-side minima, so a
    node with very many neighbours is no bottleneck. Rounds grow with the logarithm of a
    component's size; they stop when every node has larger neighbours only or a single
    smaller one, as then each hangs by its component's smallest. Self-loops, nulls and
    repeated edges are ignored; an empty table has no components. ``most``: how many edges
    there are at most, if it is known. No round makes more of them.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, name) if most is None else _written(now, name, most)
    rows = now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nodes = both.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("top"))
        nodes = _written(nodes.select("a", F.least("low", "a").alias("m"), (F.expr("low < a AND low < top")).alias("open")), f"{name}-nodes", 2 * rows)
        if not nodes.agg(F.bool_or("open")).first()[0]:
            return nodes.select(F.col("a").alias("node"), F.col("m").alias("component"))
        large = both.join(nodes.select("a", "m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = _written(small.unionByName(least.select("a", F.col("m").alias("b"))), name, rows)


def with_edges(groups: DataFrame | None, edges: DataFrame, name: str = "components") -> DataFrame:
    """The components ``groups(node, component)`` after ``edges(a, b)`` were added, which are read twice;
    edges within one are not looked at again, so rounds go over those between components alone."""
    most = edges.count()
    if groups is None:
        return components(edges, name, most)
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(*(F.coalesce(f"of_{c}", c).alias(c) for c in "ab"))
    moved = components(between, name, most)
    more = moved.count()
    if more == 0:
        return groups
    rest = groups.join(moved.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    new = moved.join(groups.select("node"), "node", "left_anti")
    return _written(rest.select("node", F.coalesce("top", "component").alias("component")).unionByName(new), name, groups.count() + more)
