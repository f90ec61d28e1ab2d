"""Distances between array columns, as expressions that stay in the JVM.

All accumulate in double. Arrays of unequal lengths give null; null arrays and null elements too. Those in UNROLLED also take two
lists of as many columns in double, one for each dimension; such an expression has no loop and is compiled as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _size(a) -> Column:
    return F.lit(len(a)) if isinstance(a, list) else F.size(_col(a))


def _fold(values: Column | list[Column], step: Callable[[Column, Column], Column] = lambda acc, x: acc + x) -> Column:
    if not isinstance(values, list):
        return F.aggregate(values, F.lit(0.0), step)
    while len(values) > 1:  # a flat tree
        values = [reduce(step, values[i : i + 4]) for i in range(0, len(values), 4)]
    return values[0] if values else F.lit(0.0)


def _pairs(a, b, term: Callable[[Column, Column], Column]) -> Column | list[Column]:
    if isinstance(a, list):
        return [term(x, y) for x, y in zip(a, b, strict=True)]
    a, b = _col(a), _col(b)
    terms = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.when(F.size(a) == F.size(b), terms)


def dot(a, b) -> Column:
    """The inner product."""
    return _fold(_pairs(a, b, lambda x, y: x * y))


def l2_norm(a) -> Column:
    return F.sqrt(_fold(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def normalized(a) -> Column:
    """a divided by its norm; a zero vector stays as it is."""
    norm = l2_norm(a)
    return F.transform(_col(a), lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))


def cosine(a, b, norm_a=None, norm_b=None) -> Column:
    """1 - a.b / (|a| |b|); 1 if a vector is zero. Norms known already may be given."""
    norms = (l2_norm(a) if norm_a is None else _col(norm_a)) * (l2_norm(b) if norm_b is None else _col(norm_b))
    product = dot(a, b)
    return F.when(product.isNotNull(), F.lit(1.0) - F.coalesce(F.try_divide(product, norms), F.lit(0.0)))


def squared_l2(a, b) -> Column:
    return _fold(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def l2(a, b) -> Column:
    return F.sqrt(squared_l2(a, b))


def l1(a, b) -> Column:
    return _fold(_pairs(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a, b) -> Column:
    return _fold(_pairs(a, b, lambda x, y: F.abs(x - y)), lambda acc, x: F.greatest(acc, x))


def inner_product(a, b) -> Column:
    """The negative inner product, so that the best come first."""
    return -dot(a, b)


def canberra(a, b) -> Column:
    """The sum of |x - y| / (|x| + |y|), where 0 / 0 is 0."""
    return _fold(_pairs(a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))))


def hamming(a, b) -> Column:
    """The share of places whose values differ; 0 for empty arrays."""
    return F.coalesce(F.try_divide(_fold(_pairs(a, b, lambda x, y: (x != y).cast("double"))), _size(a).cast("double")), F.when(_size(a) == 0, F.lit(0.0)))


def correlation(a, b) -> Column:
    """The cosine distance of the vectors less their means."""
    mean = lambda c: F.try_divide(_fold(F.transform(_col(c), lambda x: x.cast("double"))), F.size(_col(c)).cast("double"))
    less = lambda c: F.transform(_col(c), lambda x: x.cast("double") - mean(c))
    return cosine(less(a), less(b))


def bray_curtis(a, b) -> Column:
    """The sum of |x - y| by that of |x + y|, where 0 / 0 is 0."""
    parts = _fold(_pairs(a, b, lambda x, y: F.abs(x - y))), _fold(_pairs(a, b, lambda x, y: F.abs(x + y)))
    return F.when(parts[0] == 0, F.lit(0.0)).otherwise(F.try_divide(*parts))


def jaccard(a, b) -> Column:
    """Of the places where a value isn't 0, the share of those that differ; 0 where there are none."""
    some = _fold(_pairs(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("double")))
    apart = _fold(_pairs(a, b, lambda x, y: (((x != 0) | (y != 0)) & (x != y)).cast("double")))
    return F.when(some == 0, F.lit(0.0)).otherwise(F.try_divide(apart, some))


def minkowski(a, b, p: float = 2.0) -> Column:
    """The p-th root of the sum of |x - y| to the power p."""
    return F.pow(_fold(_pairs(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


METRICS: dict[str, Callable[..., Column]] = {
    "cosine": cosine,
    "euclidean": l2,
    "l2": l2,
    "sqeuclidean": squared_l2,
    "manhattan": l1,
    "l1": l1,
    "chebyshev": chebyshev,
    "ip": inner_product,
    "inner_product": inner_product,
    "canberra": canberra,
    "hamming": hamming,
    "correlation": correlation,
    "braycurtis": bray_curtis,
    "jaccard": jaccard,
    "minkowski": minkowski,
}
#: Those that take lists of columns.
UNROLLED = set(METRICS) - {"correlation"}


def metric(name: str) -> Callable[..., Column]:
    try:
        return METRICS[name.lower()]
    except KeyError:
        raise ValueError(f"metric {name!r}; known are {', '.join(METRICS)}") from None
