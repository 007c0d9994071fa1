"""Joins that stay even when a few keys hold much of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

#: Keys that the sketch of heavy keys follows at most, whatever the number of shuffle partitions.
MAX_TRACKED = 1 << 16


def heavy_keys(df: DataFrame, on: Sequence[str], parts: int | None = None) -> dict[int, int]:
    """Hash of each key that holds more rows than a shuffle partition on average, with its share in such partitions.

    Found by a mergeable sketch of frequent items, made on the map side in one pass over the key columns; there are
    never more than ``parts`` such keys. The sketch's counts are upper bounds, so no heavy key is missed.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracked = min(MAX_TRACKED, 1 << max(8, (8 * parts - 1).bit_length()))
    most = min(tracked // 2, 2 * parts)
    found, total = df.select(F.xxhash64(*on).alias("h")).agg(F.expr(f"approx_top_k(h, {most}, {tracked})"), F.count(F.lit(1))).first()
    return {r[0]: -(-r[1] * parts // total) for r in found or [] if r[1] * parts > total}


def frequent_keys(df: DataFrame, by: Sequence[str], rows: int, most: int = 8192) -> list[int]:
    """Hashes of the keys with more than ``rows`` rows, the ``most`` most frequent of them.

    One bounded sketch, merged without a shuffle of rows. It follows ``MAX_TRACKED`` keys, so no key with more than about
    that part of all rows is missed.
    """
    found = df.select(F.xxhash64(*by).alias("h")).agg(F.expr(f"approx_top_k(h, {most}, {MAX_TRACKED})")).first()[0]
    return [r[0] for r in found or [] if r[1] > rows]


def split_join(
    large: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", spread: Column | None = None,
    heavy: dict[int, int] | None = None,
) -> DataFrame:
    """``large`` joined to ``small`` on equal columns ``on`` (nulls are equal), without a hot key in one task.

    Rows of a heavy key are dealt out by a salt, two salts for each average partition that the key would fill, and the
    rows of that key in ``small`` are repeated once a salt; all other keys are joined as they are. ``spread`` is the
    hash the salt is taken from, by default of the whole row (maps aside); it must not depend on where the row is, so that a retried
    task deals it out alike. ``how`` is inner, left, left_semi or left_anti. The heavy keys are found by one pass over the
    key columns of ``large``, so let that be cheap (a staged table, pruned columns), or give ``heavy`` when it is known.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a join that keeps rows of the repeated side cannot be split: {how}")
    if heavy is None:
        heavy = heavy_keys(large, on)
    key = F.struct(*[F.col(c) for c in on]).alias("_key")
    rest = [c for c in small.columns if c not in on]
    keep = large.columns + (rest if how in ("inner", "left") else [])
    if not heavy:
        return large.withColumn("_key", key).join(small.select(key, *rest), "_key", how).select(*keep)
    salts = F.create_map(*[F.lit(v) for h, n in heavy.items() for v in (h, 2 * n)])
    of_key = F.coalesce(F.element_at(salts, F.xxhash64(*on)), F.lit(1))
    if spread is None:
        spread = F.xxhash64(*[f"`{f.name}`" for f in large.schema.fields if not isinstance(f.dataType, MapType)])
    dealt = large.withColumn("_key", key).withColumn("_salt", F.pmod(spread, of_key).cast("int"))
    copies = small.select(key, *rest, F.explode(F.sequence(F.lit(0), of_key - 1)).alias("_salt"))
    return dealt.join(copies, ["_key", "_salt"], how).select(*keep)
