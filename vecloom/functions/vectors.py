"""Vector columns: distances, slices, projections, text and half-precision forms.

All arithmetic is in double precision whatever the stored width. The distance to a null or zero vector, or between
vectors of different length, is NaN, which sorts after every number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

NAN = float("nan")


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def literal(vec: Sequence[float]) -> Column:
    """A query vector as a literal array: no join is needed to bring it to the rows."""
    return F.array(*[F.lit(float(x)) for x in vec])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    x, y = as_double(a), as_double(b)
    n = norm(x) * norm(y)
    return F.when((n == 0) | n.isNull() | (F.size(x) != F.size(y)), F.lit(NAN)).otherwise(F.lit(1.0) - dot(x, y) / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine_distance_to(a: Column | str, query: Sequence[float]) -> Column:
    """Distance to a fixed query: its norm is computed once, on the driver, and its elements are literals."""
    x = as_double(a)
    q = [float(v) for v in query]
    qn = sum(v * v for v in q) ** 0.5
    if qn == 0:
        return F.lit(NAN)
    n = norm(x)
    return F.when((n == 0) | n.isNull() | (F.size(x) != len(q)), F.lit(NAN)).otherwise(F.lit(1.0) - dot(x, literal(q)) / (F.when(n == 0, F.lit(1.0)).otherwise(n) * F.lit(qn)))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(as_double(a), as_double(b))


def subvector(v: Column | str, start: int, count: int) -> Column:
    """1-based slice; cosine on slices renormalises by itself."""
    return F.slice(F.col(v) if isinstance(v, str) else v, start, count)


def project(v: Column | str, matrix: Sequence[Sequence[float]]) -> Column:
    """M.v with a small literal matrix, one dot product a row; always the positive projection."""
    x = as_double(v)
    return F.array(*[dot(x, literal(row)) for row in matrix])


def to_text(v: Column | str) -> Column:
    """``[x,y,...]``"""
    return F.to_json(F.col(v) if isinstance(v, str) else v)


def from_text(s: Column | str) -> Column:
    """Doubles from ``[x, y, ...]`` in any number format; null for null and blank, null elements for what isn't a number."""
    c = F.col(s) if isinstance(s, str) else s
    bare = F.regexp_replace(c, r"[\[\]\s]", "")
    return F.when(F.length(bare) > 0, F.transform(F.split(bare, ","), lambda x: x.try_cast("double"))).when(c.isNotNull() & (F.length(F.trim(c)) > 0), F.array().cast("array<double>"))


def usable(v: Column, dims: int) -> Column:
    """dims finite numbers, not all zero; false for null."""
    ok = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(F.coalesce(x, F.lit(NAN))))
    return F.coalesce((F.size(v) == dims) & ~F.isnan(ok) & (ok > 0) & (ok < F.lit(float("inf"))), F.lit(False))


def dims(v: Column | str) -> Column:
    return F.size(F.col(v) if isinstance(v, str) else v)
