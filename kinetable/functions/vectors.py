"""Column builders over ``array<double>`` vectors and ``array<array<double>>`` windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

DOUBLES = "array<double>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a local binding)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    The optimizer moves filters below projections and copies the projected expression
    into them; it does not move them below a generator. Use this for costly text work.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def as_doubles(c: Column | str) -> Column:
    return _col(c).cast(DOUBLES)


def slice_range(c: Column | str, start: int, end: int) -> Column:
    """Elements ``[start, end)`` of a vector."""
    return F.slice(_col(c), start + 1, end - start)


def pad_right(c: Column | str, width: int | Column) -> Column:
    """Zero-pad on the right to ``width``; longer vectors are left alone."""
    c = _col(c)
    width = F.lit(width) if isinstance(width, int) else width
    missing = F.greatest(width - F.size(c), F.lit(0)).cast("int")
    return F.concat(c, F.array_repeat(F.lit(0.0), missing))


def sincos(c: Column | str) -> Column:
    c = _col(c)
    return F.concat(F.transform(c, F.sin), F.transform(c, F.cos))


def scale_by(c: Column | str, factors: Sequence[float]) -> Column:
    """Multiply element ``i`` by ``factors[i]``."""
    return F.zip_with(_col(c), F.array(*[F.lit(float(x)) for x in factors]), lambda x, k: x * k)


def arm_action_scale(gripper: float = 1.0) -> list[float]:
    """Six pose components scaled by 20 and one gripper component."""
    return [20.0] * 6 + [gripper]


def dequantize(c: Column | str, lo: float | Column, hi: float | Column, bins: int) -> Column:
    """Centre value of a bin index: ``idx / (bins - 1) * (hi - lo) + lo``."""
    return _col(c) / F.lit(float(bins - 1)) * (hi - lo) + lo


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def frame_l1(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long numeric arrays."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, total / F.size(a))


def from_bytes_scale(c: Column) -> Column:
    """Pixel values 0..255 to [-1, 1]."""
    return F.transform(c, lambda x: x / 127.5 - 1.0)


def within_tolerance(a: Column, b: Column, rtol: float = 1e-4, atol: float = 1e-5) -> Column:
    """``allclose``: same length and ``|a-b| <= atol + rtol*|b|`` everywhere."""
    close = F.forall(
        F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))),
        lambda ok: ok,
    )
    return (F.size(a) == F.size(b)) & close


# --- normalisation -----------------------------------------------------------

NORMALIZE_MODES = ("q99", "mean_std", "min_max", "scale", "binary")


def normalize_value(x: Column, s: dict[str, Column], mode: str) -> Column:
    """Normalise one value against the scalar statistics columns in ``s``."""
    if mode == "q99":
        span = s["q99"] - s["q01"]
        scaled = F.when(span != 0.0, 2.0 * ((x - s["q01"]) / F.nullif(span, F.lit(0.0))) - 1.0).otherwise(x)
        return F.least(F.greatest(scaled, F.lit(-1.0)), F.lit(1.0))
    if mode == "mean_std":
        return F.when(s["std"] != 0.0, (x - s["mean"]) / F.nullif(s["std"], F.lit(0.0))).otherwise(x)
    if mode == "min_max":
        span = s["max"] - s["min"]
        return F.when(span != 0.0, 2.0 * ((x - s["min"]) / F.nullif(span, F.lit(0.0))) - 1.0).otherwise(0.0)
    if mode == "scale":
        peak = F.greatest(F.abs(s["min"]), F.abs(s["max"]))
        return F.when(peak != 0.0, x / F.nullif(peak, F.lit(0.0))).otherwise(0.0)
    if mode == "binary":
        return (x > 0.5).cast("double")
    raise ValueError(f"unknown normalisation mode {mode!r}; use one of {NORMALIZE_MODES}")


def denormalize_value(x: Column, s: dict[str, Column], mode: str) -> Column:
    """Inverse of :func:`normalize_value`; ``scale`` has none."""
    if mode == "q99":
        return (x + 1.0) / 2.0 * (s["q99"] - s["q01"]) + s["q01"]
    if mode == "mean_std":
        return x * s["std"] + s["mean"]
    if mode == "min_max":
        return (x + 1.0) / 2.0 * (s["max"] - s["min"]) + s["min"]
    if mode == "binary":
        return (x > 0.5).cast("double")
    raise ValueError(f"mode {mode!r} cannot be inverted")


_STAT_NAMES = ("mean", "std", "min", "max", "q01", "q99")


def _vectorised(fn):
    def apply(c: Column | str, stats: Column, mode: str) -> Column:
        """``stats`` is a struct of equally long arrays mean/std/min/max/q01/q99."""

        def one(x: Column, i: Column) -> Column:
            return fn(x, {k: F.get(stats[k], i) for k in _STAT_NAMES}, mode)

        return F.transform(_col(c), one)

    return apply


normalize = _vectorised(normalize_value)
denormalize = _vectorised(denormalize_value)


# --- windows -------------------------------------------------------------------


def sample_and_hold(win: Column, engaged: Column) -> Column:
    """Keep the last value seen while engaged; step 0 always keeps its own value."""
    return F.aggregate(
        F.sequence(F.lit(0), F.size(win) - 1),
        F.slice(win, 1, 0),
        lambda acc, t: F.concat(
            acc,
            F.array(F.when((t == 0) | F.get(engaged, t), F.get(win, t)).otherwise(F.get(acc, t - 1))),
        ),
    )


def zero_when_disengaged(win: Column, engaged: Column) -> Column:
    return F.zip_with(win, engaged, lambda x, on: F.when(on, x).otherwise(F.lit(0.0)))


def pad_tokens(c: Column | str, n: int, all_ones: bool = False) -> Column:
    """Clip or zero-pad a token sequence ``array<array<double>>`` to ``n`` plus its mask."""

    def build(t: Column) -> Column:
        blank = F.array_repeat(F.lit(0.0), F.size(F.get(t, F.lit(0))))
        kept = F.least(F.size(t), F.lit(n))
        fill = (F.lit(n) - kept).cast("int")
        ones = F.array_repeat(F.lit(1), F.lit(n)) if all_ones else F.concat(
            F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), fill)
        )
        return F.struct(F.concat(F.slice(t, 1, n), F.array_repeat(blank, fill)).alias("tokens"), ones.alias("mask"))

    return let(_col(c), build)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
