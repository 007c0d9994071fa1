"""Split ranges, exclusion, hold-out and shuffle splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinetable.operators.ranking import episode_blocks, int_block, ordered_position, position, running_sum
from kinetable.operators.windows import explode_range

RANGE_BUCKET = 1024


def expand_split_ranges(info: DataFrame, spec: str = "spec", inclusive: bool = True) -> DataFrame:
    """Parse ``"0:499"``, ``"0-499"``, ``"42"`` and lists of them to ``range_start/range_end``.

    Readers of this format treat both ends as inclusive; writers emit half-open
    ranges, so pass ``inclusive=False`` to read those as meant.
    """
    part = F.explode(F.filter(F.split(spec, r"[,\s]+"), lambda p: p != ""))
    parsed = info.withColumn("_part", part)
    start = F.regexp_extract("_part", r"^(\d+)", 1).cast("long")
    tail = F.regexp_extract("_part", r"[:\-](\d+)$", 1)
    end = F.when(tail == "", start).otherwise(F.nullif(tail, F.lit("")).cast("long"))
    if not inclusive:
        end = F.when(tail == "", start).otherwise(end - 1)
    checked = F.when(
        (tail != "") & (F.nullif(tail, F.lit("")).cast("long") < start),
        F.raise_error(F.concat(F.lit("invalid split range: "), F.col("_part"))).cast("long"),
    ).otherwise(end)
    return parsed.withColumn("range_start", start).withColumn("range_end", checked).drop("_part", spec)


def split_indices(ranges: DataFrame, out: str = "episode_index") -> DataFrame:
    """One row per index of parsed ranges, duplicates within a split removed."""
    rows = explode_range(ranges, F.col("range_start"), F.col("range_end"), out)
    return rows.drop("range_start", "range_end").distinct()


def exclude_splits(
    episodes: DataFrame,
    ranges: DataFrame,
    names: Sequence[str],
    dataset: str = "dataset_id",
    episode: str = "episode_index",
) -> DataFrame:
    """Drop episodes inside any range of the named splits (names ignore case).

    Ranges are cut at bucket borders, so the anti-join is an equi-join on
    (dataset, bucket) with a range condition and never compares all pairs.
    """
    wanted = ranges.where(F.lower("split").isin([n.lower() for n in names]))
    cut = wanted.withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(F.col("range_start") / RANGE_BUCKET), F.floor(F.col("range_end") / RANGE_BUCKET))),
    ).select(F.col(dataset).alias("_ds"), "_bucket", "range_start", "range_end")
    eps = episodes.withColumn("_ebucket", F.floor(F.col(episode) / RANGE_BUCKET))
    on = (
        (F.col(dataset) == F.col("_ds"))
        & (F.col("_ebucket") == F.col("_bucket"))
        & F.col(episode).between(F.col("range_start"), F.col("range_end"))
    )
    return eps.join(cut, on, "left_anti").drop("_ebucket")


def unknown_splits(info: DataFrame, names: Sequence[str], dataset: str = "dataset_id") -> DataFrame:
    """Requested split names a dataset does not have (a warning list)."""
    asked = F.array(*[F.lit(n.lower()) for n in names])
    have = info.groupBy(dataset).agg(
        *[F.max((F.lower("split") == n.lower()).cast("int")).alias(f"_h{i}") for i, n in enumerate(names)]
    )
    flags = F.array(*[F.col(f"_h{i}") for i in range(len(names))])
    missing = F.filter(asked, lambda n, i: F.get(flags, i) == 0)
    return have.select(dataset, F.explode(missing).alias("split"))


def union_ids(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of index sets."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def holdout_size(n: Column, ratio: float | Column) -> Column:
    ratio = F.lit(ratio) if not isinstance(ratio, Column) else ratio
    return F.greatest(F.lit(1), F.floor(n * ratio)).cast("long")


def trailing_split(
    steps: DataFrame,
    ratio: float | Column = 0.05,
    mode: str | Column = "train",
    by: Sequence[str] = ("dataset_id",),
    order: Sequence[str] = ("episode_index", "base_index"),
    blocks: Sequence[Column] | None = None,
) -> DataFrame:
    """Last ``max(1, int(n * ratio))`` steps of a dataset are its test part.

    Steps (not episodes) are counted, so one episode may straddle the border.
    ``ratio`` and ``mode`` may be columns, for per-dataset overrides. Positions come
    from block totals, so a dataset holding most rows is still spread out.
    """
    if isinstance(ratio, float) and not 0.0 < ratio < 1.0:
        raise ValueError(f"ratio must lie in (0, 1), got {ratio}")
    if isinstance(mode, str) and mode == "full":
        return steps
    blocks = episode_blocks(*order) if blocks is None else blocks
    placed = position(steps, by, order, blocks, "_pos", "_n")
    is_test = F.col("_pos") >= F.col("_n") - holdout_size(F.col("_n"), ratio)
    mode = F.lit(mode) if isinstance(mode, str) else mode
    keep = F.when(mode == "full", True).when(mode == "test", is_test).otherwise(~is_test)
    return placed.where(keep).drop("_pos", "_n")


def trailing_ranges(
    episodes: DataFrame,
    ratio: float | Column = 0.05,
    mode: str | Column = "train",
    by: Sequence[str] = ("dataset_id",),
    episode: str = "episode_index",
    length: str = "length",
) -> DataFrame:
    """The trailing split as frame ranges per episode: ``first_base`` and ``last_base``.

    When every frame is a step, the split follows from episode lengths alone, so only
    the episode table is ordered and only kept steps ever need to be enumerated.
    """
    n, start = F.col("_n"), F.col("_start")
    placed = running_sum(episodes.where(F.col(length) > 0), F.col(length), by, [episode], int_block(episode), "_start", "_n")
    cut = n - holdout_size(n, ratio) - start
    mode = F.lit(mode) if isinstance(mode, str) else mode
    first = F.when(mode == "test", F.greatest(cut, F.lit(0))).otherwise(0)
    last = F.when(mode == "train", F.least(cut, F.col(length))).otherwise(F.col(length)) - 1
    ranged = placed.withColumn("first_base", first.cast("long")).withColumn("last_base", last.cast("long"))
    return ranged.where("last_base >= first_base").drop("_start", "_n")


def range_steps(ranges: DataFrame, out: str = "base_index") -> DataFrame:
    """Steps of :func:`trailing_ranges`."""
    return explode_range(ranges, F.col("first_base"), F.col("last_base"), out).drop("first_base", "last_base")


def shuffle_split(df: DataFrame, p: float, draw: Column, tie: Sequence[str]) -> DataFrame:
    """Seeded shuffle split: the first ``int(n * p)`` rows in draw order are validation.

    ``draw`` is a uniform column in [0, 1) made from stable keys.
    """
    drawn = df.withColumn("_u", draw)
    placed = ordered_position(drawn, ["_u", *tie], "_pos", "_n")
    val = F.col("_pos") < F.floor(F.col("_n") * p)
    return placed.withColumn("split", F.when(val, "val").otherwise("train")).drop("_u", "_pos", "_n")


def episode_split_ranges(episodes: DataFrame, by: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Half-open 80/10/10 episode ranges for datasets with at least three episodes."""
    n = F.col("n")
    counted = episodes.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    train = F.greatest(F.lit(1), F.floor(n * 0.8)).cast("long")
    val = F.greatest(F.lit(1), F.floor(n * 0.1)).cast("long")
    parts = F.array(
        F.struct(F.lit("train").alias("split"), F.lit(0).cast("long").alias("lo"), train.alias("hi")),
        F.struct(F.lit("val").alias("split"), train.alias("lo"), (train + val).alias("hi")),
        F.struct(F.lit("test").alias("split"), (train + val).alias("lo"), n.alias("hi")),
    )
    return counted.select(*by, F.inline(parts)).withColumn("spec", F.concat_ws(":", "lo", "hi"))


def test_split_listing(steps: DataFrame, by: str = "dataset_id", episode: str = "episode_index") -> DataFrame:
    """Steps and distinct episodes per dataset with a grand-total row (null dataset)."""
    per_episode = steps.groupBy(by, episode).agg(F.count(F.lit(1)).alias("_n"))
    return per_episode.rollup(by).agg(
        F.sum("_n").alias("steps"),
        F.count(F.lit(1)).alias("episodes"),
        F.min(episode).alias("first_episode"),
        F.max(episode).alias("last_episode"),
    )


def test_split_episodes(steps: DataFrame, by: str = "dataset_id", episode: str = "episode_index") -> DataFrame:
    """The held-out episodes themselves, one row each with their step count."""
    return steps.groupBy(by, episode).agg(F.count(F.lit(1)).alias("steps"))
