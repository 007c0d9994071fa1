"""Delta-index windows over episode frames, step enumeration and chunk chains."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

EPISODE = ("dataset_id", "episode_index")


def delta_grid(num_frames: int, stride: int) -> dict[str, list[int]]:
    """Frame offsets read around a base frame for each modality."""
    return {
        "video": list(range(0, num_frames * stride, stride)),
        "action": list(range(0, (num_frames - 1) * stride, stride)),
        "state": [0],
    }


def explode_range(df: DataFrame, start: Column, end: Column, out: str, block: int = 1 << 16) -> DataFrame:
    """One row per integer of ``[start, end]``, in two levels.

    A row with a huge range first becomes one row per block, the blocks are spread
    over the cluster, and only then are they expanded, so no task builds a long array.
    """
    b = F.lit(block)
    lo = df.withColumn("_lo", start.cast("long")).withColumn("_hi", end.cast("long")).where("_hi >= _lo")
    blocks = lo.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / b), F.floor(F.col("_hi") / b))))
    # An explicit count: adaptive execution would merge these few small rows into one task.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = blocks.repartition(tasks, F.col("_lo"), F.col("_hi"), F.col("_b"), *[F.col(c) for c in _hashable(df)])
    first = F.greatest(F.col("_lo"), F.col("_b") * b)
    last = F.least(F.col("_hi"), F.col("_b") * b + b - 1)
    return spread.withColumn(out, F.explode(F.sequence(first, last))).drop("_lo", "_hi", "_b")


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "string")]


def enumerate_steps(
    episodes: DataFrame, single: bool = False, length: str = "length", out: str = "base_index"
) -> DataFrame:
    """Every ``(episode, base_index)``, or only base 0."""
    if single:
        return episodes.where(F.col(length) > 0).withColumn(out, F.lit(0).cast("long")).drop(length)
    return explode_range(episodes, F.lit(0), F.col(length) - 1, out).drop(length)


def gather_window(
    frames: DataFrame,
    keys: Sequence[str],
    deltas: Sequence[int],
    pad: Mapping[str, str] | str = "edge",
    full_only: bool = False,
    by: Sequence[str] = EPISODE,
    order: str = "frame_index",
    suffix: str = "_win",
    block: int = 2048,
) -> DataFrame:
    """Values of ``keys`` at ``base + delta`` for every base frame, as arrays.

    Out-of-range offsets repeat the first/last frame (``edge``) or give zeros
    (``zero``); ``full_only`` keeps just the bases whose whole window exists.
    ``frame_index`` must run 0..T-1 inside an episode.

    An episode may be arbitrarily long: it is cut into blocks of ``block`` bases,
    frames near a border are copied to the neighbour that needs them (a halo of
    ``max(delta)`` rows), and one sort per block serves all offsets. Since padding
    only ever uses the episode's end frames, the halo always holds them. A block with
    its halo fits the in-memory row buffer of Spark's window operator.
    """
    ahead, behind = max(0, *deltas), max(0, *[-d for d in deltas])
    size = max(block, ahead + behind + 1)
    pos = F.col(order)
    copies = F.sequence(
        F.floor(F.greatest(pos - ahead, F.lit(0)) / size), F.floor((pos + behind) / size)
    )
    spread = frames.withColumn("_vals", F.struct(*keys)).withColumn("_blk", F.explode(copies))
    # A hash leads the sort: comparing it settles nearly all comparisons of two blocks.
    spread = spread.withColumn("_part", F.xxhash64(*by, "_blk"))
    w = Window.partitionBy("_part", *by, "_blk").orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    names = {d: f"_at{i}" for i, d in enumerate(dict.fromkeys(deltas))}
    cols = {n: (F.lead("_vals", d) if d > 0 else F.lag("_vals", -d)).over(w) if d else F.col("_vals")
            for d, n in names.items()}
    modes = {k: (pad if isinstance(pad, str) else pad.get(k, "edge")) for k in keys}
    edge = not full_only and "edge" in modes.values()
    if edge and ahead:
        cols["_last"] = F.last("_vals").over(whole)
    if edge and behind:
        cols["_first"] = F.first("_vals").over(whole)
    wide = spread.withColumns(cols).where(F.col("_blk") == F.floor(pos / size))
    if full_only:
        for d in {max(deltas), min(deltas)}:
            wide = wide.where(F.col(names[d]).isNotNull())
    out = {}
    for k in keys:
        zero = _zero_like(frames, k)
        picks = []
        for d in deltas:
            v = F.col(names[d])[k]
            if d and not full_only:
                fill = zero if modes[k] == "zero" else F.col("_last" if d > 0 else "_first")[k]
                v = F.when(F.col(names[d]).isNotNull(), v).otherwise(fill)
            picks.append(v)
        out[k + suffix] = F.array(*picks)
    return wide.withColumns(out).drop("_vals", "_blk", "_part", "_last", "_first", *names.values())


def _zero_like(frames: DataFrame, key: str) -> Column:
    kind = frames.schema[key].dataType
    if kind.typeName() == "array":
        return F.transform(F.col(key), lambda x: F.lit(0).cast(kind.elementType))
    return F.lit(0).cast(kind)


def full_windows(frames: DataFrame, deltas: Sequence[int], length: str = "length", order: str = "frame_index") -> DataFrame:
    """Base frames whose whole window lies inside the episode (needs its length)."""
    return frames.where(F.col(order) < F.col(length) - max(0, *deltas))


def episode_lengths(frames: DataFrame, by: Sequence[str] = EPISODE) -> DataFrame:
    return frames.groupBy(*by).agg(F.count(F.lit(1)).alias("length"))


def long_window(
    frames: DataFrame,
    action: str,
    state: str,
    deltas: Sequence[int],
    by: Sequence[str] = EPISODE,
    order: str = "frame_index",
) -> DataFrame:
    """Full windows as one row per (base, step): ``action`` vector, ``state`` at the base.

    The long shape keeps later arithmetic in plain generated code.
    """
    wide = gather_window(frames, [action], deltas, full_only=True, by=by, order=order)
    return wide.select(
        *by,
        F.col(order).alias("base_index"),
        F.col(state).alias("ref_state"),
        F.posexplode(F.col(action + "_win")).alias("step", action),
    )


def strided_sequences(
    episodes: DataFrame, length_needed: int, ratios: Sequence[int], start_every: int = 1, length: str = "length"
) -> DataFrame:
    """Complete sequences ``i, i+r, ...`` of ``length_needed`` frames, for each ratio."""
    span = episodes.withColumn("ratio", F.explode(F.array(*[F.lit(int(r)) for r in ratios])))
    last_start = F.col(length) - 1 - F.lit(length_needed - 1) * F.col("ratio")
    slots = F.when(last_start >= 0, F.floor(last_start / start_every)).otherwise(-1)
    starts = explode_range(span.withColumn("_slots", slots), F.lit(0), F.col("_slots"), "_slot")
    return (
        starts.withColumn("start_frame", F.col("_slot") * start_every)
        .withColumn("end_frame", F.col("start_frame") + F.lit(length_needed - 1) * F.col("ratio"))
        .drop("_slot", "_slots")
    )


def sequence_frames(length_needed: int) -> Column:
    """Frame ids of a row produced by :func:`strided_sequences`."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(length_needed - 1)), lambda i: F.col("start_frame") + i * F.col("ratio")
    )


def chunk_chain(
    steps: DataFrame,
    size: int = 12,
    interval: int = 1,
    max_chunks: int = 6,
    by: Sequence[str] = EPISODE,
    base: str = "base_index",
    index: str = "sample_index",
) -> DataFrame:
    """Sample indices of bases 0, s, 2s, ... (``s = size * interval``) up to the first gap.

    Only ``max_chunks`` candidate rows per episode survive the filter, and they meet
    in a combinable aggregate of fixed width.
    """
    stride = size * interval
    cand = steps.where((F.col(base) % stride == 0) & (F.col(base) < stride * max_chunks))
    slot = F.floor(F.col(base) / stride)
    found = cand.groupBy(*by).agg(
        *[F.min(F.when(slot == j, F.col(index))).alias(f"_c{j}") for j in range(max_chunks)]
    )
    run = F.lit(max_chunks)
    for j in reversed(range(max_chunks)):
        run = F.when(F.col(f"_c{j}").isNull(), F.lit(j)).otherwise(run)
    picks = F.slice(F.array(*[F.col(f"_c{j}") for j in range(max_chunks)]), F.lit(1), run)
    return found.select(*by, F.posexplode(picks).alias("chunk", index)).withColumn(
        base, (F.col("chunk") * stride).cast("long")
    )


def index_map(steps: DataFrame, by: Sequence[str] = EPISODE, base: str = "base_index") -> DataFrame:
    """Position of every sample within its episode, ordered by base index (row form).

    Sampled ranges of the whole order are even for dense and sparse base ids alike, and few.
    """
    from kinetable.operators.ranking import in_ranges, position

    return position(in_ranges(steps, [*by, base]), by, [base], F.col("_range"), "episode_pos").drop("_range")


def drop_arm_swap(windows: DataFrame, link_windows: Sequence[str]) -> DataFrame:
    """Drop windows in which an arm-link value changes inside the horizon."""
    for c in link_windows:
        windows = windows.where(F.size(F.array_distinct(c)) == 1)
    return windows


def drop_disengaged(windows: DataFrame, left: str, right: str) -> DataFrame:
    """Drop windows with both sides disengaged over the whole horizon."""
    return windows.where(F.exists(left, lambda x: x) | F.exists(right, lambda x: x))


def successive_relative(
    frames: DataFrame,
    pose: str,
    gripper: str,
    accumulate: bool = False,
    length: int | None = None,
    rebase: int = 4,
    by: Sequence[str] = EPISODE,
    order: str = "frame_index",
) -> DataFrame:
    """Motion of each frame in the frame before it, ``[xyz, euler, gripper]``.

    With ``accumulate`` the base pose moves only every ``rebase`` frames. ``length``
    limits the frames considered, as a sequence of that length would. The base
    frame is known by number, so this is an equi-join rather than a window.
    """
    from kinetable.functions.rotations import pose_step

    cur = frames.where(F.col(order) < length) if length else frames
    k = F.col(order)
    base_at = (F.floor((k - 1) / rebase) * rebase if accumulate else k - 1).cast("long")
    left = cur.where(k > 0).withColumn("_base", base_at)
    right = cur.select(*by, F.col(order).alias("_base"), F.col(pose).alias("_base_pose"))
    joined = left.join(right, [*by, "_base"], "inner")
    return joined.withColumn(
        "rel_action", F.concat(pose_step(F.col("_base_pose"), F.col(pose)), F.array(F.col(gripper)))
    ).drop("_base", "_base_pose")
