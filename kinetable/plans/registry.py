"""Registry of named queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Source tables of one scale-factor folder and the logical tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        from kinetable.plans.fixtures import DERIVED

        if name in DERIVED:
            return DERIVED[name](self)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL equivalent."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded double, with negative zero folded to zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def rs(expr: str, digits: int = 6) -> str:
    """The SQL twin of :func:`r`."""
    tiny = 0.5 * 10**-digits
    return f"(CASE WHEN abs({expr}) < {tiny} THEN CAST(0 AS DOUBLE) ELSE round(CAST({expr} AS DOUBLE), {digits}) END)"


def load_all() -> None:
    from kinetable.plans import (  # noqa: F401
        captions, clips, evaluation, jobs, mixtures, quality, rotations, safety, sources, statistics, streams, telemetry,
        vectors, windows,
    )
