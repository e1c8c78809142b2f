"""Reconstruction losses and score transforms as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def squared_errors(x: Column, xhat: Column) -> Column:
    return F.zip_with(x, xhat, lambda a, b: (b - a) * (b - a))


def mse(x: Column, xhat: Column, reduction: str = "mean") -> Column:
    errors = squared_errors(x, xhat)
    return total(errors) if reduction == "sum" else mean(errors)


def bce_with_logits(x: Column, z: Column) -> Column:
    """Mean binary cross-entropy of targets x against logits z."""
    return mean(
        F.zip_with(
            x,
            z,
            lambda a, b: F.greatest(b, F.lit(0.0)) - b * a + F.log1p(F.exp(-F.abs(b))),
        )
    )


def kl_divergence(mu: Column, logvar: Column, reduction: str = "mean") -> Column:
    terms = F.zip_with(mu, logvar, lambda m, lv: 1 + lv - m * m - F.exp(lv))
    return F.lit(-0.5) * (total(terms) if reduction == "sum" else mean(terms))


def gaussian_nll(x: Column, xhat: Column, logvar: Column) -> Column:
    """Per-element squared error scaled by the predicted variance plus the log-variance."""
    return (xhat - x) * (xhat - x) / F.exp(logvar) + logvar


def tail_score(below: Column, n: Column) -> Column:
    """Two-sided tail score of a value with ``below`` of ``n`` baseline values at or under it."""
    u = below / F.greatest(n, F.lit(1))
    p = F.lit(2.0) * F.least(u, 1 - u)
    return -F.log(p + F.lit(1e-12))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f_score(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation, null when a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread != 0, F.covar_pop(x, y) / spread)
