"""Shard export, rank ranges, index sampling and replay-style duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetable.operators.ranking import first_rows, in_ranges, ordered_position, position


def shard_export(
    shards: DataFrame,
    order: str,
    world: int,
    workers: int,
    repeat: bool = True,
    resume: int = 0,
    chunk_size: int = 1,
) -> DataFrame:
    """Assign shards to (rank, worker, slot).

    With ``repeat`` the list is cycled up to a multiple of ``world * workers``; a resume
    position skips the slots every worker has already read.
    """
    group = world * workers
    placed = ordered_position(shards, [order], "_i", "_n")
    if repeat:
        size = F.ceil(F.col("_n") / group) * group
        copies = F.ceil((size - F.col("_i")) / F.col("_n")).cast("long")
        placed = placed.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
        at = F.col("_i") + F.col("_j") * F.col("_n")
    else:
        placed = placed.withColumn("_j", F.lit(0).cast("long"))
        at = F.col("_i")
    turn = F.floor(at / world)
    skip = resume // chunk_size // workers
    return (
        placed.withColumn("rank", (at % world).cast("long"))
        .withColumn("worker", (turn % workers).cast("long"))
        .withColumn("slot", F.floor(turn / workers).cast("long"))
        .drop("_i", "_n", "_j")
        .where(F.col("slot") >= skip)
    )


def rank_ranges(df: DataFrame, world: int) -> DataFrame:
    """Contiguous ``[start, end)`` per rank; the remainder goes to the first ranks."""
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    ranks = counted.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(world - 1))))
    each, rest = F.floor(F.col("n") / world), F.col("n") % world
    start = F.col("rank") * each + F.least(F.col("rank"), rest)
    end = start + each + F.when(F.col("rank") < rest, 1).otherwise(0)
    over = start >= F.col("n")
    return ranks.select(
        F.col("rank").cast("long").alias("rank"),
        F.when(over, 0).otherwise(start).cast("long").alias("range_start"),
        F.when(over, 1).otherwise(end).cast("long").alias("range_end"),
        over.alias("is_overflow"),
    )


def round_robin(df: DataFrame, n: int, order: str, out: str = "shard") -> DataFrame:
    placed = ordered_position(df, [order], "_i")
    return placed.withColumn(out, (F.col("_i") % n).cast("long")).drop("_i")


def pick_indices(df: DataFrame, n: int, mode: str, order: str, draw: Column | None = None) -> DataFrame:
    """``n`` rows at random (those of the least draws), evenly spaced, or the first ones."""
    if mode == "random":
        return first_rows(df.withColumn("_u", draw), n, ["_u", order]).drop("_u")
    placed = ordered_position(df, [order], "_i", "_n")
    if mode == "sequential":
        return placed.where(F.col("_i") < n).drop("_i", "_n")
    if mode != "uniform":
        raise ValueError(f"unknown mode {mode!r}")
    # Row i is chosen iff it is floor(j * step) for some j; test the two nearest j.
    m = F.least(F.lit(n), F.col("_n"))
    step = (F.col("_n") - 1) / F.greatest(m - 1, F.lit(1))
    j = F.ceil(F.col("_i") / F.nullif(step, F.lit(0.0)))
    hits = [
        (k >= 0) & (k < m) & (F.when(k == m - 1, F.col("_n") - 1).otherwise(F.floor(k * step)) == F.col("_i"))
        for k in (j - 1, j, j + 1)
    ]
    keep = F.when(m == 1, F.col("_i") == 0).otherwise(F.coalesce(hits[0] | hits[1] | hits[2], F.lit(True)))
    return placed.where(keep).drop("_i", "_n")


def pick_episodes(df: DataFrame, k: int, draw: Column, by: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """``k`` rows per group, those of the least draws.

    Up to the session's limit for ranks, Spark trims each group map-side first. Beyond it, whole groups would be ordered
    in one task; there the rows are put in order in sampled ranges.
    """
    drawn = df.withColumn("_u", draw)
    if k >= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        order = ["_u", *tie]
        placed = position(in_ranges(drawn, [*by, *order]), by, order, F.col("_range"), "_rn")
        return placed.where(F.col("_rn") < k).drop("_u", "_rn", "_range")
    w = Window.partitionBy(*by).orderBy("_u", *tie)
    return drawn.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_u", "_rn")


def duplicate_fractional(df: DataFrame, n: float, u: Column) -> DataFrame:
    """``floor(n)`` or ``ceil(n)`` copies with expectation ``n``; exact for integers."""
    whole = int(n // 1)
    frac = n - whole
    copies = F.lit(whole) + F.when(u <= frac, 1).otherwise(0) if frac else F.lit(whole)
    return df.withColumn("_k", copies.cast("int")).withColumn(
        "copy", F.explode(F.transform(F.array_repeat(F.lit(0), F.col("_k")), lambda x, i: i))
    ).drop("_k")


def concat_batches(
    df: DataFrame, n: int, index: str, lists: Sequence[str] = (), firsts: Sequence[str] = ()
) -> DataFrame:
    """Merge ``n * m`` batches into ``m``: output ``i`` takes batches ``i, m+i, 2m+i, ...``.

    List columns are concatenated in batch order, scalars keep the first batch's value.
    A group holds exactly ``n`` batches.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    m = F.floor(total / n)
    checked = F.when(total % n == 0, F.pmod(F.col(index), m)).otherwise(
        F.raise_error(F.lit(f"number of batches must be divisible by {n}")).cast("long")
    )
    grouped = df.withColumn("batch", checked).groupBy("batch")
    aggs = []
    for c in lists:
        ordered = F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(c).alias("v"))))
        aggs.append(F.flatten(F.transform(ordered, lambda s: s["v"])).alias(c))
    aggs += [F.min_by(c, index).alias(c) for c in firsts]
    return grouped.agg(*aggs)
