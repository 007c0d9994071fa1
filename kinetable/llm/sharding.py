"""Proportional stratified interleaving: every shard gets each source in its share of the corpus.

Rows of a source are put in a seeded random order; row number r of n gets the fraction (r + 1/2) / n. Ordered by
that fraction, each run of rows holds the sources in proportion, so equal cuts make equal mixtures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinetable.operators.ranking import in_ranges, ordered_position, position

def interleaved(df: DataFrame, shards: int = 24, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = 20) -> DataFrame:
    """Columns ``key``, ``size`` (UTF-8 bytes and 8), ``text_crc32``, ``law`` ('rows'), ``shard``, ``slot`` and ``grown_shard`` (null).

    Counts of shards differ by one at most, and of a source in a shard from its share by one row or two. A null source
    is a source of its own; null and empty texts weigh 8. Rows with equal keys get different slots; among rows equal in
    key and text the order is free, as they cannot be told apart. With fewer rows than shards, some shards are empty.
    An empty table gives an empty result; other columns of ``df`` are not read, so
    their names cannot clash. Only ids, hashes and sizes are shuffled, never texts. Group size plays no part: ranges of the order are even.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = df.select(
        F.col(f"`{key}`").alias("k"), F.coalesce(F.concat(F.lit("s:"), F.col(f"`{source}`").cast("string")), F.lit("null")).alias("s"),
        (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"))
    slim = slim.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("k").cast("string"), F.lit("null")), F.col("crc").cast("string"))))
    total = df.count()
    # Sampled ranges of the whole order are even, whatever the sources are: one may hold most rows, or each a single one.
    one = position(in_ranges(slim, ["s", "h", "k"]), ["s"], ["h", "k"], F.col("_range"), "_r", "_all")
    # The fraction (2 r + 1) / (2 n), equal in Spark and SQL as one division of whole numbers; the hash parts equal ones.
    two = one.select("k", "s", "size", "crc", "h", ((2 * F.col("_r") + 1) / (2 * F.col("_all"))).alias("f"))
    out = ordered_position(two, ["f", "h", "k", "s"], "_r")
    shard = F.expr(f"_r * {shards} div greatest({total}, 1)")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return out.withColumn("shard", shard).select(
        F.col("k").alias(key), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), (F.col("_r") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
