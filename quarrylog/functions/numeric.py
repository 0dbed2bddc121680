"""Numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(ab: Column, aa: Column, bb: Column) -> Column:
    """Cosine from the dot products of a with b, a and b; a small term keeps it defined for zero vectors."""
    return ab / (F.sqrt(aa * bb) + EPSILON)


def unit(v: Column) -> Column:
    """A vector of length 1 in the same direction; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(x.cast("double")))


def one_hot(index: Column, size: int) -> Column:
    """A vector with 1 at an index from 0 on, and 0 elsewhere."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("double"))


def log_scaled(value: Column, shift: Column, mean: Column, deviation: Column) -> Column:
    """A value in log space, in units of the deviation from the mean."""
    return (F.log(value + shift) - mean) / deviation


def log_restored(scaled: Column, shift: Column, mean: Column, deviation: Column) -> Column:
    """The value that ``log_scaled`` was given."""
    return F.exp(scaled * deviation + mean) - shift


def finite_or_zero(x: Column) -> Column:
    return F.when(F.abs(x) == F.lit(float("inf")), 0.0).otherwise(x)


def not_negative(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def log_mean(a: Column, b: Column, shift: Column) -> Column:
    """The mean of two predictions in log space."""
    return F.exp((F.log(a + shift) + F.log(b + shift)) / 2) - shift


def spike(ensemble: Column, kernel: Column) -> Column:
    """The kernel model's prediction where it is large and far from the ensemble's."""
    far = (ensemble == 0) | (F.abs(F.try_divide(ensemble - kernel, ensemble)) > 1.5)
    return F.when((kernel > 1000) & far, kernel).otherwise(ensemble)


def spike_log(ensemble: Column, kernel: Column) -> Column:
    """The same in log space."""
    return F.when((kernel > 7) & (F.abs(kernel - ensemble) > 1), kernel).otherwise(ensemble)


def share_of(prediction: Column, total: Column, cluster_total: Column) -> Column:
    """A template's part of its cluster's prediction."""
    return F.try_divide(prediction * total, cluster_total)
