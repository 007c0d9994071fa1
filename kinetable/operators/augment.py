"""Seeded perturbation of vectors; the draw depends only on the row key and the position."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from kinetable.functions.hashing import gaussian, uniform


def perturb(c: Column, std: float, seed: int, *keys: Column, noise: Callable[[Column], Column] | None = None) -> Column:
    """Add Gaussian noise, clamped to the vector's own range. A negative std does nothing.

    ``noise`` makes a standard normal draw of a position, by default from a hash of the row's keys and the position.
    """
    if std < 0:
        return c
    lo, hi = F.array_min(c), F.array_max(c)
    normal = noise or (lambda i: gaussian(*keys, i, seed=seed))
    return F.transform(c, lambda x, i: F.least(F.greatest(x + normal(i) * std, lo), hi))


def dropout(c: Column, p: float, seed: int, *keys: Column, draw: Column | None = None) -> Column:
    """Zero the whole vector with probability ``p``. A negative probability does nothing.

    ``draw`` is uniform in [0, 1), by default a hash of the row's keys.
    """
    if p <= 1e-9:
        return c
    u = uniform(*keys, seed=seed) if draw is None else draw
    return F.when(u < p, F.transform(c, lambda x: F.lit(0.0))).otherwise(c)
