"""Vector and scoring expressions as JVM-side higher-order functions.

These are the SQL-expressible forms (used for small checks and per-row math);
dense block scoring goes through the numpy kernels in ``operators``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(vec: Column | str) -> Column:
    """Cast an ``ARRAY<FLOAT>`` to ``ARRAY<DOUBLE>`` before any arithmetic."""
    return _c(vec).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vec: Column | str) -> Column:
    """Euclidean norm (0 for a zero vector)."""
    return F.sqrt(dot(vec, vec))


def cosine(a: Column | str, b: Column | str) -> Column:
    """``dot/(|a||b|)``; NULL when either norm is zero."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def angular_distance(cos: Column | str) -> Column:
    """``sqrt(2(1-cos))`` clamped at 0; NULL where the cosine is."""
    squared = F.lit(2.0) * (F.lit(1.0) - _c(cos))
    return F.when(squared < 0, F.lit(0.0)).otherwise(F.sqrt(squared))


def relu(x: Column | str) -> Column:
    """C10."""
    return F.greatest(_c(x), F.lit(0.0))


def gain(rel: Column | str) -> Column:
    """C11: ``2^rel - 1``."""
    return F.pow(F.lit(2.0), _c(rel)) - F.lit(1.0)


def discount(rank: Column | str) -> Column:
    """C11: ``1/log2(rank + 1)``."""
    return F.lit(1.0) / F.log2(_c(rank) + F.lit(1))


def target_mask(query_id: Column | str, code_id: Column | str) -> Column:
    """A pair is the target when both sides come from the same row."""
    return _c(query_id) == _c(code_id)


def tanh(x: Column | str) -> Column:
    """C14."""
    return F.tanh(_c(x))
