"""Array expressions that carry a state along, in time that grows with the array and not with its square.

An aggregate that appends to an array copies it at each step. Here the array is cut into blocks: a block's results are appended one by
one, whole blocks once each, so an element is copied a fixed number of times up to millions of elements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], block: int = BLOCK) -> Column:
    """array<kind>: for each item what step(state, item) -> (next state, result) gives, in order. Null for a null array."""

    def inner(acc: Column, x: Column) -> Column:
        new, out = step(acc["s"], x)
        return F.struct(new.alias("s"), F.concat(acc["o"], F.array(out)).alias("o"))

    none = F.expr(f"cast(array() as array<{kind}>)")
    nothing = F.expr(f"cast(array() as array<array<{kind}>>)")

    def outer(acc: Column, at: Column, all_: Column) -> Column:
        done = F.aggregate(F.slice(all_, at, F.lit(block)), F.struct(acc["s"].alias("s"), none.alias("o")), inner)
        return F.aggregate(F.array(done), acc, lambda a, r: F.struct(r["s"].alias("s"), F.concat(a["o"], F.array(r["o"])).alias("o")))

    def blocked(all_: Column) -> Column:
        starts = F.when(F.size(all_) > 0, F.sequence(F.lit(1), F.size(all_), F.lit(block))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.when(all_.isNotNull(), F.aggregate(starts, F.struct(state.alias("s"), nothing.alias("o")), lambda acc, at: outer(acc, at, all_), lambda acc: F.flatten(acc["o"])))

    return let(items, blocked)


def ranks(points: Column, positions: Column) -> Column:
    """array<int>: for each of the points how many positions lie before it. Both are ascending arrays of int; one merge of the two."""
    asked = F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(0).alias("is")))
    there = F.transform(positions, lambda p: F.struct(p.alias("at"), F.lit(1).alias("is")))
    counted = scan(F.array_sort(F.concat(asked, there)), F.lit(0), "struct<asked:boolean,n:int>", lambda n, x: ((n + x["is"]), F.struct((x["is"] == 0).alias("asked"), n.alias("n"))))
    return F.transform(F.filter(counted, lambda c: c["asked"]), lambda c: c["n"])


def runs(items: Column, opens: Column) -> Column:
    """array<array>: items cut before each place (from 0) at which the array opens is true; the first place always opens."""

    def cut(o: Column) -> Column:
        at = F.filter(F.transform(o, lambda x, i: F.when(x | (i == 0), i.cast("int"))), lambda i: i.isNotNull())
        return let(at, lambda a: F.transform(a, lambda i, k: F.slice(items, i + 1, F.coalesce(F.get(a, k + 1), F.size(o)) - i)))

    return let(opens, cut)
