"""Weighted mixtures of datasets and the virtual index space over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinetable.functions.vectors import pad_right
from kinetable.operators.ranking import int_block, running_sum
from kinetable.operators.windows import explode_range
from kinetable.session import staged


def repeat_factors(
    datasets: DataFrame, length: str = "real_len", ratio: str = "mix_ratio", order: str = "dataset_id"
) -> DataFrame:
    """Integer repeats so that virtual sizes follow the ratios, relative to the least weight.

    Adds ``repeat``, ``virtual_len``, ``virtual_start`` and ``virtual_end`` (exclusive).
    Half-way cases round to the even neighbour. A mixture has one row for each dataset; it is staged here, so that
    its minimum, its order and its result read a file and not the input again.
    """
    datasets = staged(datasets, "mixture-input")
    weight = F.col(ratio) / F.greatest(F.col(length), F.lit(1))
    weighted = datasets.withColumn("_w", weight)
    floor = F.lit(weighted.agg(F.min("_w")).first()[0])
    repeat = F.greatest(F.lit(1), F.bround(F.col("_w") / floor)).cast("long")
    sized = weighted.withColumn("repeat", repeat).withColumn("virtual_len", F.col(length) * F.col("repeat"))
    placed = running_sum(sized.drop("_w"), F.col("virtual_len"), [], [order], int_block(order), "virtual_start", "_all")
    return staged(placed.withColumn("virtual_end", F.col("virtual_start") + F.col("virtual_len")).drop("_all"), "mixture")


def mixture_summary(mixture: DataFrame) -> DataFrame:
    """Share of every dataset in the virtual total."""
    total = F.lit(max(1, mixture.agg(F.sum("virtual_len")).first()[0] or 0))
    return mixture.withColumn("pct_total", 100.0 * F.col("virtual_len") / total)


def interval_bucket(intervals: DataFrame, start: str, end: str) -> int:
    """Mean interval length: cutting there at most doubles the pieces, and an evenly
    drawn index meets about two of them."""
    total, n = intervals.agg(F.sum(F.col(end) - F.col(start)), F.count(F.lit(1))).first()
    return max(1, int(total or 1) // max(1, n))


def locate(
    idx: DataFrame,
    intervals: DataFrame,
    index: str = "idx",
    start: str = "virtual_start",
    end: str = "virtual_end",
    by: Sequence[str] = (),
    bucket: int | None = None,
) -> DataFrame:
    """Range join ``start <= idx < end`` (within ``by``) by bucketed equi-join.

    Intervals are disjoint and staged, then cut at bucket borders; each index meets
    only the pieces in its own bucket. Spark's size check decides about broadcasting.
    """
    intervals = staged(intervals.where(F.col(end) > F.col(start)), "intervals")
    size = interval_bucket(intervals, start, end) if bucket is None else bucket
    first, last = F.floor(F.col(start) / size), F.floor((F.col(end) - 1) / size)
    cut = explode_range(intervals, first, last, "_bucket")
    left = idx.withColumn("_bucket", F.floor(F.col(index) / size))
    joined = left.join(cut, [*by, "_bucket"], "inner")
    return joined.where((F.col(index) >= F.col(start)) & (F.col(index) < F.col(end))).drop("_bucket")


def virtual_to_real(
    idx: DataFrame, mixture: DataFrame, index: str = "idx", length: str = "real_len"
) -> DataFrame:
    """Virtual index to (dataset, real index); indices wrap around the virtual total."""
    total = F.lit(mixture.agg(F.max("virtual_end")).first()[0])
    wrapped = idx.withColumn("_wrapped", F.pmod(F.col(index), total))
    found = locate(wrapped, mixture, "_wrapped")
    local = F.col("_wrapped") - F.col("virtual_start")
    return found.withColumn("real_index", F.pmod(local, F.col(length))).drop("_wrapped")


def materialize(mixture: DataFrame, samples: DataFrame, on: str = "dataset_id") -> DataFrame:
    """Replicate every sample ``repeat`` times, numbering the copies from 0."""
    joined = samples.join(mixture.select(on, "repeat"), on, "inner")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeat") - 1))
    return joined.withColumn("copy", copies).drop("repeat")


def frame_proportional(
    datasets: DataFrame, group: str, share: float = 4.0, frames: str = "frames"
) -> DataFrame:
    """Ratio ``frames / (group total / share)``."""
    totals = datasets.groupBy(group).agg(F.sum(frames).alias("_total"))
    return (
        datasets.join(totals, group, "inner")
        .withColumn("mix_ratio", F.col(frames) / (F.col("_total") / F.lit(share)))
        .drop("_total")
    )


def union_padded(dfs: Sequence[DataFrame], vector: str, width: int) -> DataFrame:
    """Union of datasets whose vectors differ in width, zero-padded to ``width``."""
    out = None
    for df in dfs:
        part = df.withColumn(vector, pad_right(vector, width))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def pad_to_max(df: DataFrame, vector: str) -> DataFrame:
    """Zero-pad to the widest vector found in the data."""
    widest = df.agg(F.max(F.size(vector))).scalar()
    return df.withColumn(vector, pad_right(vector, widest))


def interleave(samples: DataFrame, ratios: dict, source: str = "dataset", pos: str = "pos") -> DataFrame:
    """Global order of a ratio-cycled interleave: ``ratio[i]`` samples of each source per turn.

    ``pos`` is the sample's zero-based position in its own source; its place in the
    mixed stream then follows by arithmetic.
    """
    cycle = sum(ratios.values())
    out, offset = None, 0
    for name, r in ratios.items():
        if r > 0:
            place = F.floor(F.col(pos) / r) * cycle + offset + F.col(pos) % r
            hit = F.col(source) == F.lit(name)
            out = F.when(hit, place) if out is None else out.when(hit, place)
        offset += r
    return samples.withColumn("global_id", out.cast("long")).where(F.col("global_id").isNotNull())


def sample_sources(draws: DataFrame, probs: dict[str, float], u: Column, out: str = "picked_source") -> DataFrame:
    """Pick a source per draw with the given probabilities, which must sum to one."""
    if abs(sum(probs.values()) - 1.0) > 1e-8:
        raise ValueError("source probabilities must sum to 1")
    pick, upto = None, 0.0
    names = list(probs)
    for name in names[:-1]:
        upto += probs[name]
        pick = F.when(u < upto, name) if pick is None else pick.when(u < upto, name)
    pick = F.lit(names[-1]) if pick is None else pick.otherwise(names[-1])
    return draws.withColumn(out, pick)


def dedup_keep_first(specs: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row per key in ``order``; a combinable aggregate, so hot keys are harmless."""
    rest = [c for c in specs.columns if c not in keys]
    first = specs.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return first.select(*keys, "_r.*")


def spec_overrides(specs: DataFrame, split: str = "train", ratio: float = 0.05) -> DataFrame:
    """Effective split mode and hold-out ratio of each mixture entry."""
    return specs.withColumn("data_split", F.coalesce("data_split_override", F.lit(split))).withColumn(
        "test_split_ratio", F.coalesce("test_split_ratio_override", F.lit(ratio))
    )


def lookup_excludes(datasets: DataFrame, specs: DataFrame, key: str = "path") -> DataFrame:
    """Attach the exclude-split list of the first matching spec, or an empty list."""
    first = dedup_keep_first(specs.select(key, "spec_order", "exclude_splits"), [key], "spec_order")
    joined = datasets.join(first.drop("spec_order"), key, "left")
    return joined.withColumn("exclude_splits", F.coalesce("exclude_splits", F.array().cast("array<string>")))


def select_datasets(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), col: str = "dataset") -> DataFrame:
    """An include list wins over an exclude list."""
    if include:
        return df.where(F.col(col).isin(list(include)))
    return df.where(~F.col(col).isin(list(exclude))) if exclude else df
