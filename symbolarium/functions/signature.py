"""Type signatures as columns: split at their arrows, variables renamed by first use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = r"->|=>|[\[\](),]|[\w'.#]+|[^\s\w]"


def signature_parts(signature: Column) -> Column:
    """The parts of a signature between its outermost arrows, the result last: tokens set apart by
    one space, variables ``v1``, ``v2``, ... in the order they come up. A name before ``::`` and a
    context before ``=>`` are left out; empty and null signatures have no parts."""
    body = F.regexp_replace(F.coalesce(signature, F.lit("")), r"(?s)^[^(\[]*?::", "")
    tokens = F.regexp_extract_all(body, F.lit(_TOKEN), F.lit(0))
    nothing, none = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    start = F.struct(F.lit(0).alias("depth"), nothing.alias("part"), none.alias("parts"))

    def step(state: Column, token: Column) -> Column:
        outer = state["depth"] == 0
        depth = state["depth"] + F.when(token.isin("(", "["), 1).when(token.isin(")", "]"), -1).otherwise(0)
        ends, context = outer & (token == "->"), outer & (token == "=>")
        part = F.when(ends | context, nothing).otherwise(F.concat(state["part"], F.array(token)))
        parts = F.when(context, none).when(ends, F.concat(state["parts"], F.array(state["part"]))).otherwise(state["parts"])
        return F.struct(depth.alias("depth"), part.alias("part"), parts.alias("parts"))

    split = F.aggregate(tokens, start, step, lambda s: F.when(F.size(s["part"]) > 0, F.concat(s["parts"], F.array(s["part"]))).otherwise(s["parts"]))
    is_variable = lambda t: t.rlike("^[a-z_]")
    names = F.array_distinct(F.filter(F.flatten(split), is_variable))
    renamed = lambda t: F.when(is_variable(t), F.concat(F.lit("v"), F.array_position(names, t).cast("string"))).otherwise(t)
    return F.transform(split, lambda p: F.array_join(F.transform(p, renamed), " "))


def signature_keys(parts: Column) -> Column:
    """What a signature must share to match: its result, and each argument with its number among
    equal ones, so that a multiset of arguments is a set of keys."""
    args = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    nth = lambda p, i: F.size(F.filter(F.slice(args, F.lit(1), i + 1), lambda q: q == p))
    keyed = F.transform(args, lambda p, i: F.concat(F.lit("takes "), p, F.lit(" #"), nth(p, i).cast("string")))
    return F.when(F.size(parts) > 0, F.concat(keyed, F.array(F.concat(F.lit("gives "), F.element_at(parts, -1))))).otherwise(keyed)


def is_signature(query: Column) -> Column:
    """Whether a query asks by type and not by name."""
    return query.contains("->") | query.contains("::")
