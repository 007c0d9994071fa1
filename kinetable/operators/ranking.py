"""Positions and running sums that stay parallel when one group is huge.

A plain ``Window.partitionBy(group)`` sends a whole group to one task. Here every
group is cut into blocks along its order: block totals are aggregated first (with
map-side combine), a small window turns them into block offsets, and the detailed
window runs inside ``(group, block)`` only. A task never sees more than one block.
Several block columns, coarse to fine, keep the block tables themselves bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetable.session import staged

DEFAULT_BLOCK = 1 << 16


def int_block(order: Column | str, size: int = DEFAULT_BLOCK) -> Column:
    """Block number along an integer order column."""
    c = F.col(order) if isinstance(order, str) else order
    return F.floor(c / F.lit(size)).cast("long")


def in_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` with ``_range``: its rows cut into ranges of about equal size along ``order``.

    Spark samples the order to place the cuts, so hashed and sparse ids make even ranges like dense ones, and there
    are as many as shuffle partitions. Written once: the numbers are then the same for whoever reads them.
    """
    return staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id().cast("long")), "ranges")


def ordered_position(df: DataFrame, order: Sequence[str], out: str = "pos", total: str | None = None) -> DataFrame:
    """Zero-based position of each row of the whole table along ``order`` (unique keys)."""
    return position(in_ranges(df, order), [], order, F.col("_range"), out, total).drop("_range")


def running_sum(
    df: DataFrame,
    value: Column,
    by: Sequence[str],
    order: Sequence[str | Column],
    block: Column | Sequence[Column],
    out: str,
    total: str | None = None,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the strictly earlier rows of the group.

    ``block`` is one column, or several from coarse to fine, that never decrease along
    ``order``. ``total`` optionally names a column for the group total, which comes
    free with the block tables.
    """
    by = list(by)
    blocks = [block] if isinstance(block, Column) else list(block)
    if not blocks:
        w = Window.partitionBy(*by)
        before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        res = df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
        return res.withColumn(total, F.sum(value).over(w)) if total else res
    level = len(blocks)
    key, val, base, part = f"_key{level}", f"_val{level}", f"_base{level}", f"_part{level}"
    names = [f"_blk{level}_{i}" for i in range(level)]
    # One struct key: nulls compare equal inside a struct, and the join and the
    # window below share a single hash partitioning on it and its hash. The hash leads the
    # sort, since a struct has no sort prefix: comparing it settles nearly all comparisons of two blocks.
    tagged = df.withColumns({**dict(zip(names, blocks)), val: value})
    hashed = F.xxhash64(*by, *names)
    tagged = tagged.withColumns({key: F.struct(*by, *names), part: hashed})
    sums = tagged.groupBy(key).agg(F.sum(val).alias("_bsum"))
    flat = sums.select(*[F.col(f"{key}.{c}").alias(c) for c in [*by, *names]], key, "_bsum")
    upper = [F.col(n) for n in names[:-1]]
    based = running_sum(flat, F.col("_bsum"), by, [names[-1]], upper, base, total).withColumn(part, hashed)
    # The window goes first: its sort order already is the one a merge join on the key needs.
    inside = Window.partitionBy(part, key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = tagged.withColumn("_in", F.coalesce(F.sum(val).over(inside), F.lit(0)))
    joined = within.join(based.select(part, key, base, *([total] if total else [])), [part, key], "inner")
    return joined.withColumn(out, F.col(base) + F.col("_in")).drop(val, base, "_in", key, part, *names)


def position(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    block: Column | Sequence[Column],
    out: str = "pos",
    total: str | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group along ``order`` (unique keys)."""
    return running_sum(df, F.lit(1).cast("long"), by, order, block, out, total)


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows along ``order`` (unique keys, numeric first column), without a task that orders or holds them all.

    A sketch of the first column drops all rows that are surely behind the ``n``-th; what is left is put in order in sampled
    ranges. Null draws come first, as in a sort.
    """
    lead = F.col(order[0]).cast("double")
    accuracy = 10000
    cuts = F.array(*[F.lit(k / 1000) for k in range(1001)])
    known, rows, edges = df.agg(F.count(lead), F.count(F.lit(1)), F.percentile_approx(lead, cuts, accuracy)).first()
    if n <= 0:
        return df.limit(0)
    if rows <= n:
        return df
    at = int(((n - (rows - known)) / max(1, known) + 2 / accuracy) * 1000) + 1
    if edges and 0 <= at < 1000:
        df = df.where(lead.isNull() | (lead <= edges[max(0, at)]))
    return ordered_position(df, order, "_first").where(F.col("_first") < n).drop("_first")


def episode_blocks(episode: str = "episode_index", base: str = "base_index") -> list[Column]:
    """Blocks for an (episode, frame) order: bunches of episodes, one episode, its parts."""
    return [int_block(episode, 4096), F.col(episode), int_block(base)]
