"""Queries over run telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.operators import telemetry as T
from kinetable.plans.fixtures import view
from kinetable.plans.registry import query, r, rs

_PER = view("telemetry") + ", p AS (SELECT event_id // 500 AS period, worker_rank AS rank, avg(seconds) AS m, max(seconds) AS mx FROM telemetry GROUP BY 1, 2)"


def _period():
    return F.floor(F.col("event_id") / 500)


@query("a20_latency_per_rank", _PER + f" SELECT period, rank, {rs('m')} AS mean_seconds, {rs('mx')} AS max_seconds FROM p")
def _(t):
    return T.latency_per_rank(t["telemetry"], _period()).select("period", "rank", r("mean_seconds").alias("mean_seconds"), r("max_seconds").alias("max_seconds"))


@query("a20_loader_latency", _PER + f""", f AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY m DESC, rank) AS rn FROM p)
    SELECT period, count(*) AS ranks, max(rank) FILTER (rn = 1) AS slowest_rank, {rs('max(m)')} AS slowest_mean, {rs('max(mx)')} AS worst_seconds FROM f GROUP BY period""")
def _(t):
    l = T.loader_latency(t["telemetry"], _period())
    return l.select("period", "ranks", "slowest_rank", r("slowest_mean").alias("slowest_mean"), r("worst_seconds").alias("worst_seconds"))


@query("a21_loss_average", _PER + f" SELECT period, {rs('avg(m)')} AS loss, count(*) AS ranks FROM p GROUP BY period")
def _(t):
    return T.loss_average(t["telemetry"], _period()).withColumn("loss", r("loss"))


@query("a22_iteration_speed", view("telemetry") + f""", m AS (SELECT event_id AS iteration, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS s FROM telemetry WHERE event_id % 20 = 0)
    SELECT a.iteration, {rs('(a.s - b.s) / 10 / 2', 5)} AS iter_speed FROM m a JOIN m b ON b.iteration = a.iteration - 20""")
def _(t):
    e = t["telemetry"].select(F.col("event_id").alias("iteration"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at_seconds"))
    return T.iteration_speed(e, 10, 2).select("iteration", r("iter_speed", 5).alias("iter_speed"))


@query("a23_operation_stats", view("telemetry") + f""" SELECT op, count(seconds) AS count, {rs('sum(seconds)', 4)} AS total_time, {rs('max(seconds)')} AS max_time, {rs('arg_max(seconds, event_id)')} AS last_time, {rs('avg(seconds)')} AS avg_time FROM telemetry GROUP BY op""")
def _(t):
    s = T.operation_stats(t["telemetry"], order=("event_id",))
    return s.select("op", "count", r("total_time", 4).alias("total_time"), *[r(c).alias(c) for c in ("max_time", "last_time", "avg_time")])


@query("a24_loss_summary", view("telemetry") + f""" SELECT op, {rs('avg(seconds)')} AS loss_mean, {rs('stddev_samp(seconds)')} AS loss_std, {rs('min(seconds)')} AS loss_min, {rs('max(seconds)')} AS loss_max,
    {rs('avg(ln(1 + seconds))')} AS sigma_log_mean, {rs('stddev_samp(ln(1 + seconds))')} AS sigma_log_std,
    {rs("list_sort(list(seconds))[1 + (count(seconds) - 1) // 2]")} AS loss_median, {rs('quantile_cont(seconds, 0.25)')} AS loss_q1, {rs('quantile_cont(seconds, 0.75)')} AS loss_q3 FROM telemetry GROUP BY op""")
def _(t):
    e = t["telemetry"].withColumn("sigma", 1 + F.col("seconds"))
    s = T.loss_summary(e, ["op"], "seconds", "sigma")
    return s.select("op", *[r(c).alias(c) for c in s.columns if c != "op"])


_EDGES = T.lognormal_edges()
_BIN = "CASE " + " ".join(f"WHEN seconds / 20 >= {lo!r}::DOUBLE AND seconds / 20 < {hi!r}::DOUBLE THEN {i}" for i, (lo, hi) in enumerate(zip(_EDGES, _EDGES[1:]))) + " ELSE -1 END"


@query("a25_bin_by_edges", view("telemetry") + f" SELECT {_BIN} AS bin, count(*) AS n, {rs('avg(seconds)')} AS mean_seconds FROM telemetry GROUP BY 1")
def _(t):
    b = T.bin_by_edges(t["telemetry"].withColumn("sigma", F.col("seconds") / 20), "sigma", _EDGES)
    return b.groupBy(F.coalesce("bin", F.lit(-1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("seconds")).alias("mean_seconds"))
