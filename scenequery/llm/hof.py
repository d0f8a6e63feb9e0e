"""Helpers for expressions over arrays inside one row; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def none(kind: str) -> Column:
    """An empty array<kind>."""
    return F.from_json(F.lit("[]"), f"array<{kind}>")


def prefix_sums(v: Column, block: int = 64) -> Column:
    """For each element of array<int>, the sum of those before it; blockwise, so that long arrays don't take quadratic time."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def blocks(v: Column) -> Column:
        n = F.floor((F.size(v) + (block - 1)) / block).cast("int")
        sums = F.transform(F.filter(F.sequence(F.lit(0), n), lambda j: j < n), lambda j: total(F.slice(v, j * block + 1, block)))
        before = lambda c: F.transform(c, lambda _, j: total(F.slice(c, F.lit(1), j)))
        return let(sums, lambda c: let(before(c), lambda b: F.transform(v, lambda _, i: F.get(b, F.floor(i / block).cast("int")) + total(F.slice(v, i - i % block + 1, i % block)))))

    return let(v, blocks)


def prefix_max(v: Column, block: int = 64) -> Column:
    """For each element of array<bigint> of numbers above -1, the greatest of those before it, or -1; blockwise as prefix_sums."""
    top = lambda a: F.coalesce(F.array_max(a), F.lit(-1).cast("long"))

    def blocks(v: Column) -> Column:
        n = F.floor((F.size(v) + (block - 1)) / block).cast("int")
        tops = F.transform(F.filter(F.sequence(F.lit(0), n), lambda j: j < n), lambda j: top(F.slice(v, j * block + 1, block)))
        before = lambda c: F.transform(c, lambda _, j: top(F.slice(c, F.lit(1), j)))
        return let(tops, lambda c: let(before(c), lambda b: F.transform(v, lambda _, i: F.greatest(F.get(b, F.floor(i / block).cast("int")), top(F.slice(v, i - i % block + 1, i % block))))))

    return let(v, blocks)
