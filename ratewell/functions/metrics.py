"""Evaluation formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def bce(z: Column, y: Column, pos_weight: Column | float | None = None) -> Column:
    """Cross-entropy of one row from its logit, positives weighted, in a form that cannot overflow."""
    y = y.cast("double")
    softplus = F.log1p(F.exp(-F.abs(z))) + F.greatest(-z, F.lit(0.0))
    if pos_weight is None:
        return (F.lit(1.0) - y) * z + softplus
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return (F.lit(1.0) - y) * z + (F.lit(1.0) + (w - F.lit(1.0)) * y) * softplus


def hit(z: Column, y: Column) -> Column:
    """1.0 where a probability of at least one half agrees with the label, else 0.0."""
    return ((sigmoid(z) >= F.lit(0.5)) == (y == F.lit(1))).cast("double")


def accuracy(z: Column, y: Column) -> Column:
    return F.avg(hit(z, y))


def combined_auc(*aucs: Column) -> Column:
    """Mean of the defined values; null if none is."""
    known = F.filter(F.array(*aucs), lambda a: a.isNotNull() & ~F.isnan(a))
    total = F.aggregate(known, F.lit(0.0), lambda s, a: s + a)
    return F.when(F.size(known) > 0, F.try_divide(total, F.size(known)))


def weighted_total(loss1: Column, loss2: Column, w1: float = 1.0, w2: float = 1.0) -> Column:
    """Total loss of the two tasks."""
    return F.lit(float(w1)) * loss1 + F.lit(float(w2)) * loss2
