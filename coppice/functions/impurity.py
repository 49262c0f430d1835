"""Criteria as Column expressions.

entropy() and gini() aggregate: they are used in a groupBy with one row per class that holds the
class's share p. share() gives such shares; pig(), semantic() and pig_semantic() turn a gain into a score.
"""

from __future__ import annotations

from pyspark.sql import functions as F

EPSILON = 1e-12


def share(x, total) -> F.Column:
    return F.coalesce(F.try_divide(x.cast("double"), total.cast("double")), F.lit(0.0))


def entropy(p) -> F.Column:
    """Sum over classes of -p log2(p + epsilon)."""
    return F.sum(-p * F.log2(p + EPSILON))


def gini(p) -> F.Column:
    return 1.0 - F.sum(p * p)


def pig(gain, ati, alpha: float = 1.0) -> F.Column:
    """Gain scaled by average taxonomic information: gain * (1 + ln(1 + alpha * ati))."""
    return gain * (1.0 + F.log1p(F.lit(alpha) * ati))


def semantic(gain, similarity, weight: float) -> F.Column:
    return F.lit(1.0 - weight) * gain + F.lit(weight) * similarity * F.greatest(gain, F.lit(0.001))


def pig_semantic(gain, ati, similarity, alpha: float = 1.0, weight: float = 0.3) -> F.Column:
    return semantic(pig(gain, ati, alpha), similarity, weight)
