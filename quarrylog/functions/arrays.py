"""Columns of arrays: products, projections and random features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def kronecker(a: Column, b: Column) -> Column:
    """All products of an entry of a and one of b; b's entries go round first."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def projected(a: Column, matrix: np.ndarray) -> Column:
    """The products of a with each row of a constant matrix."""
    row = lambda r: F.aggregate(F.zip_with(a, F.array(*[F.lit(float(v)) for v in r]), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.array(*[row(r) for r in matrix])


def frequencies(dims: int, features: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(a row of frequencies for each feature, phases) of a Gaussian kernel exp(-width * distance ** 2)."""
    rng = np.random.default_rng(seed)
    return rng.standard_normal((features, dims)) * np.sqrt(2 * width), rng.uniform(0, 2 * np.pi, features)


def fourier(a: Column, omega: np.ndarray, phase: np.ndarray) -> Column:
    """Random Fourier features: sqrt(2 / n) * cos(omega a + phase); their products approach the kernel."""
    scale = float(np.sqrt(2 / len(phase)))
    return F.transform(F.zip_with(projected(a, omega), F.array(*[F.lit(float(p)) for p in phase]), lambda x, p: x + p), lambda v: F.cos(v) * scale)
