"""Modality slices, key concatenation and relative-action conversion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kinetable.functions.rotations import hybrid_relative, hybrid_relative_step, rotation_of, valid_quat
from kinetable.functions.vectors import let, slice_range, subtract

REPRESENTATIONS = ("rel_xyz_rot6d", "relative", "delta", "absolute")
# Widths a pose may have after conversion: axis-angle, 6-D rotation, offset + 6-D rotation.
CONVERTED_POSE_WIDTHS = (3, 6, 9)


@dataclass(frozen=True)
class Slice:
    """A named part ``[start, end)`` of a vector column."""

    modality: str
    key: str
    start: int
    end: int
    original_key: str | None = None
    absolute: bool = True

    @property
    def column(self) -> str:
        return f"{self.modality}_{self.key}"

    @property
    def width(self) -> int:
        return self.end - self.start

    def source(self, fallback: str) -> str:
        """Loaders fall back to the key name, the statistics job to the modality's vector."""
        if self.original_key:
            return self.original_key
        return self.key if fallback == "key" else {"state": "observation.state"}.get(self.modality, self.modality)


@dataclass(frozen=True)
class ActionKey:
    """How one action key is turned into its training representation."""

    key: str
    rep: str = "absolute"
    state_key: str | None = None
    in_fmt: str = "quat"
    ref_fmt: str = "quat"
    in_order: str = "xyzw"
    ref_order: str = "xyzw"

    def __post_init__(self):
        if self.rep not in REPRESENTATIONS:
            raise ValueError(f"unknown action representation {self.rep!r} for key {self.key!r}")
        if self.rep in ("rel_xyz_rot6d", "relative") and not self.state_key:
            raise ValueError(f"state_key is required for {self.rep} key {self.key!r}")


def slice_modality(frames: DataFrame, slices: Sequence[Slice], fallback: str = "modality") -> DataFrame:
    """Add one column per slice, e.g. ``state_arm``."""
    return frames.withColumns({s.column: slice_range(F.col(f"`{s.source(fallback)}`"), s.start, s.end) for s in slices})


def concat_keys(
    df: DataFrame, order: Sequence[str], dims: dict[str, int], out: str, present: Sequence[str] | None = None,
) -> DataFrame:
    """Concatenate key columns in order after checking keys and widths.

    ``present`` is the full key set for actions, which must equal the order list.
    """
    missing = [k for k in order if k not in df.columns]
    if missing:
        raise ValueError(f"keys named in the concat order are absent: {missing}")
    if present is not None and set(present) != set(order):
        raise ValueError(f"action keys {sorted(present)} differ from the concat order {sorted(order)}")
    parts = []
    for k in order:
        allowed = {dims[k]}
        if k.startswith("state"):
            allowed.add(2 * dims[k])  # sin/cos expansion
        if "pose" in k or "rotation" in k:
            allowed |= set(CONVERTED_POSE_WIDTHS) | {dims[k] + 2}
        ok = F.size(k).isin(sorted(allowed))
        parts.append(F.when(ok, F.col(k)).otherwise(F.raise_error(F.lit(f"unexpected width of {k}")).cast("array<double>")))
    return df.withColumn(out, F.concat(*parts))


def split_keys(df: DataFrame, vector: str, dims: dict[str, int]) -> DataFrame:
    """Inverse of :func:`concat_keys`."""
    cols, at = {}, 0
    for k, d in dims.items():
        cols[k] = slice_range(vector, at, at + d)
        at += d
    return df.withColumns(cols)


def convert_window(actions: Column, ref: Column, cfg: ActionKey) -> Column:
    """A window of one key, ``array<array<double>>``, to its configured representation."""
    if cfg.rep == "rel_xyz_rot6d":
        return hybrid_relative(actions, ref, cfg.in_fmt, cfg.ref_fmt, cfg.in_order, cfg.ref_order)
    if cfg.rep == "relative":
        return F.transform(actions, lambda a: subtract(a, ref))
    return actions


def convert_step(action: Column, ref: Column | None, cfg: ActionKey) -> Column:
    """One step of one key, ``array<double>``, for long tables."""
    if cfg.rep == "rel_xyz_rot6d":
        return let(
            rotation_of(ref, cfg.ref_fmt, cfg.ref_order),
            lambda rr: hybrid_relative_step(action, ref, rr, cfg.in_fmt, cfg.in_order),
        )
    return subtract(action, ref) if cfg.rep == "relative" else action


def convert_actions(
    df: DataFrame, configs: Sequence[ActionKey], suffix: str = "_win", out_suffix: str = "_rel"
) -> DataFrame:
    """Apply each key's conversion to its window column; references are at the base frame."""
    return df.withColumns(
        {
            c.key + out_suffix: convert_window(F.col(c.key + suffix), F.col(c.state_key) if c.state_key else None, c)
            for c in configs
        }
    )


def usable_sample(configs: Sequence[ActionKey], suffix: str = "_win") -> Column:
    """Statistics-mode guard: every quaternion of the sample (window and reference) is non-zero.

    Training mode instead substitutes "no motion"; that is what the converters do.
    """
    ok = F.lit(True)
    for c in configs:
        if c.rep != "rel_xyz_rot6d":
            continue
        if c.in_fmt == "quat":
            ok = ok & F.forall(F.col(c.key + suffix), lambda a: valid_quat(F.slice(a, 4, 4)))
        if c.ref_fmt == "quat":
            ok = ok & valid_quat(F.slice(F.col(c.state_key), 4, 4))
    return ok


def attach_task(steps: DataFrame, frames: DataFrame, tasks: DataFrame, delta: int = 0,
                by: Sequence[str] = ("dataset_id", "episode_index")) -> DataFrame:
    """Task text at ``base + delta`` clamped into the episode (``length`` column).

    Every step stays; where its frame or its task is absent, ``drop_reason`` says which.
    """
    at = F.least(F.greatest(F.col("base_index") + delta, F.lit(0)), F.col("length") - 1)
    located = steps.withColumn("_at", at.cast("long"))
    index = frames.select(*by, F.col("frame_index").alias("_at"), "task_index")
    joined = located.join(index.withColumn("_frame", F.lit(True)), [*by, "_at"], "left").join(
        tasks.withColumn("_task", F.lit(True)), ["dataset_id", "task_index"], "left")
    reason = F.when(F.col("_frame").isNull(), "frame missing").when(F.col("_task").isNull(), "task missing")
    return joined.withColumn("drop_reason", reason).drop("_at", "_frame", "_task")


def attach_reference(steps: DataFrame, frames: DataFrame, state_keys: Sequence[str],
                     by: Sequence[str] = ("dataset_id", "episode_index")) -> DataFrame:
    """State columns of the base frame, by equi-join."""
    ref = frames.select(*by, F.col("frame_index").alias("base_index"), *state_keys)
    return steps.join(ref, [*by, "base_index"], "inner")
