"""Vectors and unit sequences as arrays: expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_EPSILON = 1e-10


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if either is null."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def l2_normalise(x: Column) -> Column:
    """``x`` divided by its length plus 1e-10, so a zero vector stays zero. The length is bound once a vector: within
    the division it would be computed for every element."""
    length = F.array(F.sqrt(dot(x, x)) + F.lit(NORM_EPSILON))
    return F.get(F.transform(length, lambda n: F.transform(doubles(x), lambda v: v / n)), F.lit(0))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda p, q: p - q)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def collapse(units: Column) -> Column:
    """Consecutive equal units become one: [3, 3, 7, 7, 2] gives [3, 7, 2]; a null is equal to a null. Repeats
    that are not neighbours stay; empty stays empty and null stays null."""
    return F.transform(F.filter(F.transform(units, lambda v, i: F.struct(v.alias("v"), (~((i > 0) & v.eqNullSafe(F.get(units, i - 1)))).alias("keep"))), lambda s: s["keep"]), lambda s: s["v"])


def slice_units(units: Column, start: Column, end: Column) -> Column:
    """Elements from ``start`` (counted from 0) up to but without ``end``; empty where the range is."""
    return F.slice(units, F.greatest(start, F.lit(0)) + 1, F.greatest(end - F.greatest(start, F.lit(0)), F.lit(0)))


def as_text(units: Column) -> Column:
    """A unit sequence as a string of one character a unit, for ``levenshtein``: units 0 to 93 as printable ASCII,
    others up to 20,000 as CJK characters. Null elements are left out; null stays null."""
    char = F.transform(F.filter(units, lambda u: u.isNotNull()), lambda u: F.when((u >= 0) & (u < 94), F.chr((u + 33).cast("bigint"))).otherwise(F.decode(F.unhex(F.lpad(F.hex((u + 19968).cast("bigint")), 4, "0")), "UTF-16BE")))
    return F.concat_ws("", char).cast("string")


def edit_similarity(a: Column, b: Column) -> Column:
    """``1 - distance / longer length`` of two encoded sequences; null where both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.lit(1.0) - F.levenshtein(a, b) / longest.cast("double"))
