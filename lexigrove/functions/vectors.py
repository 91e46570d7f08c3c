"""Vector functions over array columns, accumulated in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _once(c: Column, f) -> Column:
    """f(c) with c computed once: a lambda holds its value, where a plain expression is written out, and computed, at every use."""
    return F.transform(F.array(c), f)[0]


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero norm."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def normalized(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    unit = lambda w: _once(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w))
    return _once(doubles(v), unit)


def without(v: Column, direction: Column) -> Column:
    """V less its projection on a unit direction."""
    less = lambda w: _once(dot(w, direction), lambda along: F.zip_with(w, direction, lambda x, u: x - along * u))
    return _once(doubles(v), less)
