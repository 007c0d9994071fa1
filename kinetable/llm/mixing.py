"""Mixing sources to target weights by pivotal dependent rounding.

A source's target and size give one copy rate for its documents; the whole part of the rate is copied outright, the
fraction is a probability. Two fractional documents meet and words are moved from the probability of one to that of the
other, in a random direction that keeps both expectations, until one of the two is 0 or 1. The expected words of a
block never change, so a block ends with one fractional document at most, and blocks of such residuals meet again in the
next level of a reduction tree. What a source gives thus differs from its target by less than one document.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinetable.llm.common import BLANKS, map_arrow
from kinetable.operators.ranking import ordered_position
from kinetable.operators.skew import split_join
from kinetable.operators.windows import explode_range
from kinetable.session import staged

WEIGHTS, CEILING = (5, 2, 1), 3
#: Items of one block of the first level, on average, and blocks whose residuals meet in one block of the next.
BLOCK_ITEMS, FAN = 4096, 1024
#: A probability this near to 0 or 1 is taken as such.
ROUNDING = 1e-12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(rf"[^{BLANKS}]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: int = CEILING) -> DataFrame:
    """``target`` beside ``source`` and ``source_size`` (one row a source; staged by the caller).

    Sources in order of code points, null last, take the weights in turn and share the sum of all sizes; a target above
    ``ceiling`` times its source's size stops there and the excess goes to the others by weight, until none is above.
    The words for a weight of 1 only ever rise, and each round is one aggregate over the sources.
    """
    placed = ordered_position(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_pos").drop("_last")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_pos") % len(weights)).cast("int"))
    placed = staged(placed.withColumn("_w", weight), "mixing-weights")
    each, capped = 0.0, -1
    while True:
        over = ceiling * F.col("source_size") <= each * F.col("_w")
        total, n, stopped, free = placed.agg(
            F.sum("source_size"), F.count(F.when(over, 1)), F.sum(F.when(over, ceiling * F.col("source_size"))), F.sum(F.when(~over, F.col("_w")))).first()
        if not total or not free or (n == capped and each):
            break
        each, capped = (total - (stopped or 0)) / free, n
    return placed.withColumn("target", F.least(1.0 * ceiling * F.col("source_size"), each * F.col("_w"))).drop("_w", "_pos")


class Rounding:
    """Pivotal rounding of one block: takes (item, size, probability) one by one and gives back decided items."""

    def __init__(self, seed: str):
        self.draw = random.Random(seed).random
        self.open = None

    def add(self, item, size: int, p: float) -> list[tuple[object, float]]:
        if self.open is None:
            self.open = (item, size, p)
            return []
        other, width, q = self.open
        # Words that can move to the item from the other, and the other way round.
        gain, loss = min((1 - p) * size, q * width), min(p * size, (1 - q) * width)
        moved = gain if self.draw() * (gain + loss) < loss else -loss
        p, q = self._near(p + moved / size), self._near(q - moved / width)
        done = [(x, v) for x, v in ((item, p), (other, q)) if v in (0.0, 1.0)]
        self.open = None if len(done) == 2 else (other, width, q) if done[0][0] is item else (item, size, p)
        return done

    def rest(self, final: bool) -> list[tuple[object, float]]:
        if self.open is None:
            return []
        item, _, p = self.open
        return [(item, float(self.draw() < p) if final else p)]

    @staticmethod
    def _near(p: float) -> float:
        return 0.0 if p < ROUNDING else 1.0 if p > 1 - ROUNDING else p


def _level(rows: DataFrame, label: str) -> DataFrame:
    """One level of the tree: ``rows`` of a block, large documents first, so that what stays open is small."""
    dealt = rows.repartition("source", "block").sortWithinPartitions("source", "block", F.desc("size"), "h", "k")
    k_type = pa.field("k", _arrow(rows, "k"))

    def run(batches):
        block, state, final = None, None, False
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            out = []
            for k, source, size, p, b, last in zip(*(cols[c] for c in ("k", "source", "size", "p", "block", "last"))):
                if state is None or (source, b) != block:
                    out += state.rest(final) if state else []
                    block, state, final = (source, b), Rounding(f"{label}|{source!r}|{b}"), last
                out += state.add((k, source, size, b), size, p)
            yield table(out)
        if state:
            yield table(state.rest(final))

    def table(out):
        k, source, size, b = zip(*(x for x, _ in out)) if out else ((),) * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(k, k_type.type), pa.array(source, pa.string()), pa.array(size, pa.int64()), pa.array(b, pa.int64()), pa.array([p for _, p in out], pa.float64())],
            names=["k", "source", "size", "block", "p"])

    kinds = rows.select("k", "source", "size", "block", "p").schema
    return map_arrow(dealt.select("k", "source", "size", "p", "block", "last"), run, kinds)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def mixed(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 13) -> DataFrame:
    """Columns ``key``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``, one row for each row of ``df``.

    ``taken`` is ``copies`` times ``size``; ``copies`` is the source's rate rounded down or up. A null source is a source
    of its own, the last; null and empty texts have size 0 and, where the source's rate says so, copies that weigh
    nothing. Rows equal in key, source and size are counted first and rounded together, which splits the copies as evenly
    as can be; as they cannot be told apart, any of them may have the extra copy. Everything follows from these values
    and the seed, so reruns agree. Sources without words have target 0. An empty table gives an empty result. Other
    columns of ``df`` are not read; only keys, sources and sizes are shuffled, never texts.
    """
    slim = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").cast("string").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    items = staged(slim.groupBy("k", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mixing-items")
    sources = staged(items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n")), "mixing-sources")
    goals = staged(targets(sources).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ITEMS).cast("long")).drop("n"), "mixing-targets")
    hashed = items.withColumn("h", F.xxhash64(F.lit(seed), "k", "size"))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    rated = split_join(hashed, goals, ["source"], spread=F.col("h")).withColumn("whole", F.floor(rate)).withColumn("mass", F.col("m") * (rate - F.floor(rate)))
    rated = staged(rated.withColumn("up", F.floor("mass")).withColumn("p", F.col("mass") - F.floor("mass")).drop("mass"), "mixing-rates")

    open_ = (F.col("p") > ROUNDING) & (F.col("size") > 0)
    rows = rated.where(open_).select("k", "source", "size", "p", "h", F.pmod(F.shiftright("h", 7), F.col("blocks")).alias("block"), "blocks")
    blocks, level, decided = goals.agg(F.max("blocks")).first()[0] or 1, 0, None
    while True:
        done = staged(_level(rows.withColumn("last", F.col("blocks") <= 1), f"{seed}|{level}"), f"mixing-level{level}")
        settled = done.where("p in (0.0, 1.0)").select("k", "source", "size", "p")
        decided = settled if decided is None else decided.union(settled)
        if blocks <= 1:
            break
        # Residuals only: one a block at most. A block's number tells how many blocks its source has left.
        left = split_join(done.where("p not in (0.0, 1.0)"), goals.select("source", "blocks"), ["source"], heavy={})
        shrunk = F.ceil(F.col("blocks") / float(FAN ** (level + 1))).cast("long")
        rows = left.select("k", "source", "size", "p", F.xxhash64(F.lit(seed), "k", "size").alias("h"), F.floor(F.col("block") / FAN).alias("block"), shrunk.alias("blocks"))
        blocks, level = -(-blocks // FAN), level + 1

    same = F.struct("k", "source", "size").alias("_item")
    ups = decided.where("p = 1.0").select(same, F.lit(1).alias("more"))
    final = rated.withColumn("_item", same).join(ups, "_item", "left").withColumn("up", F.col("up") + F.coalesce("more", F.lit(0)))
    columns = ["k", "source", "size", "source_size", "target", "whole", "up"]
    single = final.where("m = 1").select(*columns, F.lit(1).cast("long").alias("i"))
    several = explode_range(final.where("m > 1").select(*columns, "m"), F.lit(1), F.col("m"), "i").select(*columns, "i")
    copies = (F.col("whole") + (F.col("i") <= F.col("up")).cast("long")).alias("copies")
    out = single.union(several).select(F.col("k").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies)
    return out.withColumn("taken", F.col("copies") * F.col("size"))
