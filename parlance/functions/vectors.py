"""Functions on score / probability arrays (#37, #45-#50).

All are higher-order array expressions evaluated in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once. A plain expression would
    be computed again wherever a lambda names it, once for every entry."""
    return F.get(F.transform(F.array(value), use), 0)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def softmax(x: Column) -> Column:
    """exp(x) / sum(exp(x)), computed after subtracting the maximum (#45).

    The shift does not change the result and avoids the overflow of the
    plain form. Maximum and sum are taken once per vector.
    """
    exps = lambda v, m: F.transform(v, lambda y: F.exp(y - m))
    share = lambda e, s: F.transform(e, lambda y: y / s)
    return bound(x, lambda v: bound(F.array_max(v), lambda m: bound(exps(v, m), lambda e: bound(_sum(e), lambda s: share(e, s)))))


def softmax_contrast(x: Column) -> Column:
    """softmax(x * (max(x) - mean(x))) (#46)."""
    scaled = lambda v, k: F.transform(v, lambda y: y * k)
    return bound(x, lambda v: bound(F.array_max(v) - _sum(v) / F.size(v), lambda k: softmax(scaled(v, k))))


def calib_faq(x: Column) -> Column:
    """sqrt(100 x) / 10 for each entry (#47)."""
    return F.transform(x, lambda v: F.sqrt(v * 100) / 10)


def calib_intent(x: Column) -> Column:
    """x / sum(sqrt(x)); the numerator is not rooted (#48)."""
    root_sum = lambda v: F.aggregate(v, F.lit(0.0), lambda a, y: a + F.sqrt(y))
    return bound(x, lambda v: bound(root_sum(v), lambda t: F.transform(v, lambda y: y / t)))


def round_list(x: Column, r: int = 3) -> Column:
    """round(v, r) for each entry (#49). Spark rounds half up on the decimal value."""
    return F.transform(x, lambda v: F.round(v, r))


def offset(x: Column, b: Column) -> Column:
    """Entry-wise x - b (#50); ``b`` is an array of the same length."""
    return F.zip_with(x, b, lambda u, v: u - v)


def topk(x: Column, k: int) -> Column:
    """First ``k`` (idx, value) pairs by value desc, then index desc (#37).

    Index is 0-based. The tie rule is the stated contract.
    """
    keyed = F.transform(x, lambda v, i: F.struct((-v).alias("nv"), (-i).alias("ni")))
    top = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(top, lambda s: F.struct((-s["ni"]).alias("idx"), (-s["nv"]).alias("p")))


def argmax(x: Column) -> Column:
    """Index of the largest entry (highest index on ties)."""
    return topk(x, 1)[0]["idx"]
