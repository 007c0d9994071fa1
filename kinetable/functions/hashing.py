"""Seeded pseudo-random columns that any engine can reproduce.

``lcg`` is one step of a linear congruential generator on an integer id, so the
same draw can be written in plain SQL; ``uniform`` hashes arbitrary keys.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the generator.
LCG_MULTIPLIER = 1103515245
LCG_INCREMENT = 12345
LCG_MODULUS = 1000003


def lcg(id_col: Column | str, seed: int = 0) -> Column:
    """Integer draw in ``[0, 1000003)`` from a non-negative integer id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    base = F.pmod(c.cast("long"), F.lit(LCG_MODULUS)) + F.lit(seed)
    return F.pmod(base * F.lit(LCG_MULTIPLIER) + F.lit(LCG_INCREMENT), F.lit(LCG_MODULUS))


def lcg_uniform(id_col: Column | str, seed: int = 0) -> Column:
    return lcg(id_col, seed) / F.lit(float(LCG_MODULUS))


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """Uniform draw in ``[0, 1)`` from any keys, with 53 random bits."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 11)
    return bits / F.lit(float(1 << 53))


def gaussian(*keys: Column | str, seed: int = 0) -> Column:
    """Standard normal draw (Box-Muller on two hash-uniforms)."""
    u1 = F.greatest(uniform(*keys, seed=seed), F.lit(1e-300))
    u2 = uniform(*keys, seed=seed + 7919)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.pi() * u2)


def lcg_gaussian(id_col: Column | str, seed: int = 0) -> Column:
    """Standard normal draw (Box-Muller) from two steps of the generator, so that SQL can repeat it."""
    u1 = (lcg(id_col, seed) + 1) / F.lit(float(LCG_MODULUS))
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.pi() * lcg_uniform(id_col, seed + 7919))


def pick_by_weight(u: Column, options: list[tuple[Column, Column]]) -> Column:
    """Choose among ``(value, weight)`` columns with draw ``u``; zero weights never win."""
    total = sum((w for _, w in options), F.lit(0.0))
    out, upto = None, F.lit(0.0)
    for value, weight in options:
        upto = upto + weight
        hit = (weight > 0) & (u * total < upto)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out
