"""Numeric, hash and array expressions used by sampling, metrics and SMOTE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hash_unit(seed, *parts) -> Column:
    """Deterministic 32-bit unsigned hash of ``seed:part1:part2...``.

    First 8 hex digits of MD5, as a bigint in [0, 2^32). It depends only on
    the key, never on partitioning or row order, and SQL engines with an
    ``md5`` function reproduce it exactly, which makes every seeded sample
    checkable against an oracle.
    """
    pieces = [F.lit(str(seed))]
    for p in parts:
        pieces += [F.lit(":"), _c(p).cast("string")]
    return F.conv(F.substring(F.md5(F.concat(*pieces)), 1, 8), 16, 10).cast("bigint")


def hash_fraction(seed, *parts) -> Column:
    """``hash_unit`` scaled to [0, 1)."""
    return hash_unit(seed, *parts) / F.lit(4294967296.0)


def sigmoid(col) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


def apply_threshold(score, threshold, inclusive: bool = False) -> Column:
    """Hard class from a score: ``score > t`` (strict, the default) as 0/1."""
    s, t = _c(score), threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (s >= t if inclusive else s > t).cast("int")


def safe_div(num, den) -> Column:
    """num / den with 0 when the denominator is 0 (zero-division -> 0)."""
    return F.coalesce(F.try_divide(_c(num).cast("double"), _c(den).cast("double")),
                      F.lit(0.0))


def f1_smoothed(precision, recall, eps: float = 1e-8) -> Column:
    p, r = _c(precision), _c(recall)
    return F.lit(2.0) * p * r / (p + r + F.lit(eps))


def f1_exact(precision, recall) -> Column:
    """F1 with 0 when precision + recall is 0 (classification-report form)."""
    p, r = _c(precision), _c(recall)
    return safe_div(F.lit(2.0) * p * r, p + r)


def to_double_array(col) -> Column:
    return _c(col).cast("array<double>")


def array_sum(col) -> Column:
    """Sum of a numeric array, left to right."""
    return F.aggregate(to_double_array(col), F.lit(0.0), lambda acc, x: acc + x)


def vector_distance(a, b) -> Column:
    """Euclidean distance of two equal-length numeric arrays."""
    sq = F.zip_with(to_double_array(a), to_double_array(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, x: acc + x))


def interpolate_vector(x, nn, u) -> Column:
    """Point on the segment from x toward its neighbour: ``x + u * (nn - x)``."""
    uu = u if isinstance(u, Column) else F.lit(u)
    return F.zip_with(to_double_array(x), to_double_array(nn),
                      lambda a, b: a + uu * (b - a))
