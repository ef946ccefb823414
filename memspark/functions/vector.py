"""Vector functions as Column expressions, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wide(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_wide(v), F.lit(0.0), lambda s, x: s + x * x))


def normalise(v) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(_wide(v), lambda x: (x / n).cast("float"))).otherwise(_wide(v).cast("array<float>"))


def cosine(a, b) -> Column:
    """0 where sizes differ or a vector is zero."""
    size = F.when(F.size(_wide(a)) == F.size(_wide(b)), norm(a) * norm(b)).otherwise(0.0)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
