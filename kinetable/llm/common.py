"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: White space between words, as a regular-expression class body and as plain characters.
BLANKS = r"\x20\x09-\x0D"
BLANK_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows in one Arrow batch at most, so that a batch of long texts fits a Python worker.
BATCH_ROWS = 256


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct ``row``, out of the way of an operator's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ``BATCH_ROWS`` rows (sets the session's batch limit)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def annotated(df: DataFrame, make: Callable[[], Callable[[list], list[list]]], text: str, fields: str) -> DataFrame:
    """Columns ``row`` (all of ``df``) and ``fields``, which a function of the texts of a batch returns as lists.

    ``make()`` runs once in each Python task and returns that function, so caches and tables live there.
    """
    rows = df.select(packed(df))
    more = StructType.fromDDL(fields)
    schema = StructType([StructField("row", rows.schema["row"].dataType)] + more.fields)
    at = df.columns.index(text)
    arrow = to_arrow_schema(more)

    def run(batches):
        work = make()
        for batch in batches:
            row = batch.column(0)
            texts = row.field(at).to_pylist()
            made = [pa.array(values, type=f.type) for values, f in zip(work(texts), arrow)]
            yield pa.RecordBatch.from_arrays([row, *made], names=["row", *arrow.names])

    return map_arrow(rows, run, schema)


def broadcast_model(spark: SparkSession, model: object) -> Broadcast:
    """A model of bounded size for every executor, with its class; ``pickle.loads(x.value)`` gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What ``make`` returns, made once in each Python worker and kept for its later tasks."""
    held = sys.modules.setdefault("_kinetable_worker_state", types.ModuleType("_kinetable_worker_state")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def fold(key: Column | str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key falls in fold 0."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % folds, F.lit(0))


def unit_hash(key: Column | str, seed: int) -> Column:
    """A number in [0, 1) drawn from the key and the seed."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / float(1 << 52)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def bounded_sample(df: DataFrame, group: str, rows: int, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """About ``rows`` rows of each value of ``group`` (all, where it has fewer), chosen by a hash of ``key``.

    The share kept follows from one count per value, so no row is shuffled for it. Only for groups of few values,
    such as labels or languages: their counts come to the driver.
    """
    share = F.lit(0.0)
    for value, n in df.groupBy(group).count().collect():
        share = F.when(F.col(group).eqNullSafe(F.lit(value)), F.lit(min(1.0, rows / n))).otherwise(share)
    return df.where(unit_hash(key, seed) < share)
