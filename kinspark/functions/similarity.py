"""Similarity of sets, multisets and vectors. The variants differ on empty sets on purpose; don't unify them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _arr(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shared(a: str | Column, b: str | Column) -> Column:
    return F.size(F.array_intersect(_arr(a), _arr(b)))


def jaccard_both_empty_one(a: str | Column, b: str | Column) -> Column:
    """Two empty sets are alike (1.0): shingles of a unit."""
    union = F.size(F.array_union(_arr(a), _arr(b)))
    return F.when(union == 0, 1.0).otherwise(shared(a, b) / union)


def jaccard_any_empty_zero(a: str | Column, b: str | Column) -> Column:
    """An empty set is like nothing (0.0): tokens of a segment, declared names."""
    union = F.size(F.array_union(_arr(a), _arr(b)))
    empty = (F.size(_arr(a)) == 0) | (F.size(_arr(b)) == 0)
    return F.when(empty, 0.0).otherwise(shared(a, b) / union)


def containment(a: str | Column, b: str | Column) -> Column:
    """Shared over the smaller set; 0.0 where one is empty."""
    least = F.least(F.size(_arr(a)), F.size(_arr(b)))
    return F.when(least == 0, 0.0).otherwise(shared(a, b) / least)


def overlap_of_larger(a: str | Column, b: str | Column) -> Column:
    """Shared over the larger set; 0.0 where both are empty."""
    most = F.greatest(F.size(_arr(a)), F.size(_arr(b)))
    return F.when(most == 0, 0.0).otherwise(shared(a, b) / most)


def multiset_overlap(inter: str | Column, size_a: str | Column, size_b: str | Column) -> Column:
    """From the sum of the smaller counts and both sizes: inter / (|A| + |B| - inter), 0.0 for two empty ones."""
    i, whole = _arr(inter), _arr(size_a) + _arr(size_b) - _arr(inter)
    return F.when(whole == 0, 0.0).otherwise(i / whole)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_arr(a), _arr(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """0.0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)
