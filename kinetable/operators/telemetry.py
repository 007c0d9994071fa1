"""Run telemetry: loader latency, loss averages, speed and operation statistics."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from kinetable.operators.stats import exact_quantiles


def latency_per_rank(events: DataFrame, period: Column, rank: str = "worker_rank", value: str = "seconds") -> DataFrame:
    return events.groupBy(period.alias("period"), F.col(rank).alias("rank")).agg(
        F.avg(value).alias("mean_seconds"), F.max(value).alias("max_seconds")
    )


def loader_latency(events: DataFrame, period: Column, rank: str = "worker_rank", value: str = "seconds") -> DataFrame:
    """Slowest rank of every period by mean latency (lowest rank on ties)."""
    per = latency_per_rank(events, period, rank, value)
    return per.groupBy("period").agg(
        F.count(F.lit(1)).alias("ranks"),
        F.max_by("rank", F.struct(F.col("mean_seconds"), -F.col("rank"))).alias("slowest_rank"),
        F.max("mean_seconds").alias("slowest_mean"),
        F.max("max_seconds").alias("worst_seconds"),
    )


def loss_average(events: DataFrame, period: Column, rank: str = "worker_rank", value: str = "seconds") -> DataFrame:
    """Mean of the rank means per period."""
    per = events.groupBy(period.alias("period"), F.col(rank)).agg(F.avg(value).alias("_m"))
    return per.groupBy("period").agg(F.avg("_m").alias("loss"), F.count(F.lit(1)).alias("ranks"))


def iteration_speed(
    events: DataFrame, every_n: int, step: int = 1, iteration: str = "iteration", seconds: str = "at_seconds",
    by: Sequence[str] = (),
) -> DataFrame:
    """Seconds per iteration between consecutive boundaries ``every_n * step`` apart.

    The previous boundary is known by number, so this joins instead of sorting a run.
    """
    stride = every_n * step
    marks = events.where(F.col(iteration) % stride == 0).select(*by, iteration, seconds)
    prev = marks.select(*by, (F.col(iteration) + stride).alias(iteration), F.col(seconds).alias("_before"))
    joined = marks.join(prev, [*by, iteration], "inner")
    return joined.withColumn("iter_speed", (F.col(seconds) - F.col("_before")) / every_n / step).drop("_before")


def operation_stats(events: DataFrame, op: str = "op", value: str = "seconds", order: Sequence[str] = ("ts",)) -> DataFrame:
    return events.groupBy(op).agg(
        F.count(value).alias("count"), F.sum(value).alias("total_time"), F.max(value).alias("max_time"),
        F.max_by(value, F.struct(*order)).alias("last_time"), F.avg(value).alias("avg_time"),
    )


def loss_summary(df: DataFrame, by: Sequence[str], loss: str = "loss", sigma: str | None = None) -> DataFrame:
    """Mean, sample std, extremes, lower median and quartiles per group."""
    aggs = [
        F.avg(loss).alias("loss_mean"), F.stddev_samp(loss).alias("loss_std"),
        F.min(loss).alias("loss_min"), F.max(loss).alias("loss_max"),
    ]
    if sigma:
        aggs += [F.avg(F.log(sigma)).alias("sigma_log_mean"), F.stddev_samp(F.log(sigma)).alias("sigma_log_std")]
    return exact_quantiles(
        df, by, loss, {"loss_median": 0.5, "loss_q1": 0.25, "loss_q3": 0.75}, aggs, lower=("loss_median",)
    )


def lognormal_edges(bins: int = 10) -> list[float]:
    """Edges of ``exp(N(0, 1))`` quantile bins; the open ends are extrapolated."""
    inner = [exp(NormalDist().inv_cdf(i / bins)) for i in range(1, bins)]
    return [inner[0] ** 2 / inner[1], *inner, inner[-1] ** 2 / inner[-2]]


def bin_by_edges(df: DataFrame, value: str, edges: Sequence[float], out: str = "bin") -> DataFrame:
    """Index of the half-open bin ``[edge[i], edge[i+1])``; outside values are null."""
    pick = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        hit = (F.col(value) >= lo) & (F.col(value) < hi)
        pick = F.when(hit, F.lit(i)) if pick is None else pick.when(hit, F.lit(i))
    return df.withColumn(out, pick)
