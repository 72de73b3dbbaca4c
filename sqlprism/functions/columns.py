"""Column-returning helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category(components: list[str], fmt: str = "counter", of=F.col) -> Column:
    """Q5: category code over count columns named by ``components``; ``of`` gives them by name.

    counter -> '1.1.0...' (counts joined by '.'), binary -> '110...', name -> 'S-F-W'
    (abbreviations of the present components joined by '-').
    """
    if fmt == "counter":
        return F.concat_ws(".", *[of(c).cast("string") for c in components])
    if fmt == "binary":
        return F.concat(*[F.when(of(c) > 0, "1").otherwise("0") for c in components])
    return F.concat_ws("-", *[F.when(of(c) > 0, F.lit(c)) for c in components])


def bround2(c: Column | str) -> Column:
    """Round half to even to 2 places (pandas ``round`` semantics)."""
    return F.bround(c if isinstance(c, Column) else F.col(c), 2)


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is 0 or null."""
    return a / F.nullif(b, F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """M1: |a ∩ b| / |a ∪ b| over arrays treated as sets; both empty -> 1."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(inter / union)


def cases(*branches: tuple, otherwise=None) -> Column:
    """The value of the first (condition, value) that holds, as nested IFs: within a higher-order function Spark looks the branches of a
    CASE up in a linked list, from its head for every one."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = column(otherwise)
    for condition, value in reversed(branches):
        out = F.call_function("if", condition, column(value), out)
    return out


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once. Unlike ``transform``, an aggregate's last step doesn't copy what it returns."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)
