"""Vector arithmetic as Column expressions, in double precision and array order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.exprs import col

_ZERO = 0.0


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(_ZERO), lambda acc, v: acc + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    gaps = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(_ZERO), lambda acc, v: acc + v * v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, 0 when either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(_ZERO))
