"""Vector and mixture functions on ``array<double>`` columns.

Functions that take ``k`` unroll into plain arithmetic, which stays inside
whole-stage code generation; without ``k`` they fall back to array lambdas.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def parts(vec, k: int) -> list[Column]:
    v = _col(vec)
    return [v[i] for i in range(k)]


def dot(a, b, k: int | None = None) -> Column:
    a, b = _col(a), _col(b)
    if k is not None:
        return total([a[i] * b[i] for i in range(k)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vsum(a, k: int | None = None) -> Column:
    a = _col(a)
    if k is not None:
        return total([a[i] for i in range(k)])
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def norm(a, k: int | None = None) -> Column:
    return F.sqrt(dot(a, a, k))


def cosine(a, b, k: int | None = None, eps: float = 1e-12) -> Column:
    """Cosine similarity with a guarded denominator."""
    return dot(a, b, k) / (norm(a, k) * norm(b, k) + F.lit(eps))


def cosine_or_zero(a, b, k: int | None = None, floor: float = 1e-9) -> Column:
    """Cosine similarity, 0 where the product of the norms vanishes."""
    d = norm(a, k) * norm(b, k)
    return F.when(d > floor, dot(a, b, k) / d).otherwise(F.lit(0.0))


def euclidean(a, b, k: int | None = None) -> Column:
    a, b = _col(a), _col(b)
    if k is not None:
        return F.sqrt(total([(a[i] - b[i]) * (a[i] - b[i]) for i in range(k)]))
    return F.sqrt(
        F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    )


def euclidean_similarity(a, b, k: int | None = None) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + euclidean(a, b, k))


def _plog2(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def js_distance(a, b, k: int | None = None) -> Column:
    """Jensen-Shannon distance, base 2, in [0, 1].

    Inputs are scaled to sum 1 first. The radicand is clamped at 0, so equal
    mixtures give exactly 0 instead of a NaN.
    """
    a, b = _col(a), _col(b)
    sa, sb = vsum(a, k), vsum(b, k)
    if k is not None:
        def cell(i: int) -> Column:
            p, q = F.try_divide(a[i], sa), F.try_divide(b[i], sb)
            return _plog2(p) + _plog2(q) - F.lit(2.0) * _plog2((p + q) / 2)

        div = total([cell(i) for i in range(k)])
    else:
        def gap(x: Column, y: Column) -> Column:
            p, q = F.try_divide(x, sa), F.try_divide(y, sb)
            return _plog2(p) + _plog2(q) - F.lit(2.0) * _plog2((p + q) / 2)

        div = F.aggregate(F.zip_with(a, b, gap), F.lit(0.0), lambda s, x: s + x)
    return F.when((sa > 0) & (sb > 0), F.sqrt(F.greatest(F.lit(0.0), div / 2)))


def js_similarity(a, b, k: int | None = None, null_distance: float = 1.0) -> Column:
    """1 - distance; an undefined distance counts as ``null_distance``."""
    return F.lit(1.0) - F.coalesce(js_distance(a, b, k), F.lit(null_distance))


def similarity_weight(distance, power: float = 4.0) -> Column:
    return F.pow(F.lit(1.0) - _col(distance), F.lit(power))


def purity(vec) -> Column:
    return F.array_max(_col(vec))


def entropy_normalized(vec, k: int) -> Column:
    """-sum p log2 p / log2 k, weights clipped at 1e-12."""
    v = _col(vec)
    clipped = [F.greatest(v[i], F.lit(1e-12)) for i in range(k)]
    return -total([c * F.log2(c) for c in clipped]) / F.log2(F.lit(float(k)))


def effective_components(vec, k: int) -> Column:
    """exp of the natural entropy with a 1e-12 guard inside the logarithm."""
    v = _col(vec)
    return F.exp(-total([v[i] * F.log(v[i] + F.lit(1e-12)) for i in range(k)]))


def exp_entropy(vec, k: int) -> Column:
    """exp of the natural entropy with 0 * ln 0 = 0."""
    v = _col(vec)
    return F.exp(-total([F.when(v[i] > 0, v[i] * F.log(v[i])).otherwise(F.lit(0.0)) for i in range(k)]))


def argmax(vec) -> Column:
    """Index of the largest entry; the first index wins ties."""
    v = _col(vec)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def argmin(vec) -> Column:
    v = _col(vec)
    return (F.array_position(v, F.array_min(v)) - 1).cast("int")


def subtract(a, b, k: int) -> Column:
    a, b = _col(a), _col(b)
    return F.array(*[a[i] - b[i] for i in range(k)])


def triangle(k: int, diagonal: bool = True) -> list[tuple[int, int]]:
    """Index pairs i<=j (or i<j) in row order."""
    return [(i, j) for i in range(k) for j in range(i if diagonal else i + 1, k)]


def symmetric_cell(a, b, i: int, j: int) -> Column:
    """One exposure cell: (a_i b_j + b_i a_j) / 2."""
    a, b = _col(a), _col(b)
    return F.lit(0.5) * (a[i] * b[j] + b[i] * a[j])


def top_components(vec, k: int, m: int) -> Column:
    """The m largest (index, share) entries, ties by index."""
    v = _col(vec)
    pairs = F.array(*[F.struct((-v[i]).alias("neg"), F.lit(i).alias("idx")) for i in range(k)])
    return F.transform(F.slice(F.array_sort(pairs), 1, m),
                       lambda s: F.struct(s["idx"].alias("idx"), (-s["neg"]).alias("share")))
