"""Queries that run a streaming job over the test tables and read its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions.text import norm_text, to_ascii
from kinetable.operators import safety, stats as S
from kinetable.plans.fixtures import view
from kinetable.plans.registry import ORACLES, query, r, rs
from kinetable.plans.safety import ALLOW, LONG_TERMS, TERMS, many_terms
from kinetable.session import scratch_path
from kinetable.streaming import jobs as J


def _stream(t, name):
    """The table, one file or a folder of files, as a file stream.

    Named by a pattern: a stream takes a plain path for a folder, and a filter on file names misses those in a folder.
    """
    schema = t.spark.read.parquet(f"{t.sf_dir}/{name}.parquet").schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{{{name}}}.parquet")


_WINDOWS = view("telemetry") + f""" SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, worker_rank, count(*) AS count, {rs('avg(seconds)')} AS mean_seconds, {rs('max(seconds)')} AS max_seconds FROM telemetry GROUP BY 1, 2"""


def _shape(df):
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return df.select(start, "worker_rank", "count", r("mean_seconds").alias("mean_seconds"), r("max_seconds").alias("max_seconds"))


@query("t1_telemetry_windows", _WINDOWS)
def _(t):
    return _shape(J.telemetry_stream(t["telemetry"]))


@query("t1_telemetry_stream", _WINDOWS)
def _(t):
    out, ckpt = scratch_path(t.spark, "telemetry"), scratch_path(t.spark, "telemetry-ckpt")
    e = _stream(t, "events").select(F.col("user_id").alias("worker_rank"), "ts", F.col("value").alias("seconds"))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    J.run_batches(J.telemetry_stream(e), write, ckpt, mode="update")
    return _shape(J.latest_per_key(t.spark.read.parquet(out), ["window_start", "worker_rank"]))


@query("t2_ingest_results", view("eval_frames") + f" SELECT checkpoint, episode_index, {rs('avg(l1)')} AS mean_l1 FROM eval_frames GROUP BY ALL")
def _(t):
    inbox, out, ckpt = (scratch_path(t.spark, x) for x in ("inbox", "ingested", "ingest-ckpt"))
    res = t["eval_frames"].groupBy("checkpoint", "episode_index").agg(F.avg("l1").alias("mean_l1"))
    schema = "checkpoint string, episode_index long, mean_l1 double"
    half = F.col("episode_index") % 2
    res.where(half == 0).write.mode("append").json(inbox)
    J.ingest_results(t.spark, inbox, schema, ckpt, out)
    res.where(half == 1).write.mode("append").json(inbox)
    J.ingest_results(t.spark, inbox, schema, ckpt, out)  # takes only the new files
    return t.spark.read.parquet(out).select("checkpoint", "episode_index", r("mean_l1").alias("mean_l1"))


@query("t3_refresh_partials_stream", view("telemetry") + f" SELECT op, count(seconds) AS n, {rs('avg(seconds)')} AS mean, {rs('stddev_pop(seconds)')} AS std, {rs('min(seconds)')} AS min, {rs('max(seconds)')} AS max FROM telemetry GROUP BY op")
def _(t):
    out, ckpt = scratch_path(t.spark, "partials"), scratch_path(t.spark, "partials-ckpt")
    e = _stream(t, "events").select(F.col("event_type").alias("op"), "value")
    J.refresh_partials(e, ["op"], out, ckpt)
    m = S.merge_partials(t.spark.read.parquet(out), ["op"])
    return m.select("op", "n", *[r(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("t4_screen_stream", """SELECT doc_id, NOT regexp_matches(lower(text), 'ment') AS is_safe, CASE WHEN regexp_matches(lower(text), 'ment') THEN 'PATTERN: listed word part' ELSE 'Prompt is safe' END AS message FROM documents""")
def _(t):
    out, ckpt = scratch_path(t.spark, "screened"), scratch_path(t.spark, "screened-ckpt")
    rule = ("pattern", F.when(norm_text(to_ascii("text")).contains("ment"), F.lit("listed word part")))
    J.run_to_table(J.screen_stream(_stream(t, "documents").select("doc_id", "text"), [rule]), out, ckpt)
    return t.spark.read.parquet(out).select("doc_id", "is_safe", "message")


_PROMPTS = ("x22_screen", "x22_screen_many_terms")


@query("t4_screen_lists_stream", ORACLES[_PROMPTS[0]])
def _(t):
    """Short lists: a projection of the stream itself."""
    out, ckpt = scratch_path(t.spark, "screened"), scratch_path(t.spark, "screened-ckpt")
    prompts = _stream(t, "documents").select("doc_id", "text")
    J.run_to_table(safety.blocklist_screen(prompts, "doc_id", TERMS, ALLOW, LONG_TERMS).select("doc_id", "is_safe", "message"), out, ckpt)
    return t.spark.read.parquet(out)


@query("t4_screen_many_terms_stream", ORACLES[_PROMPTS[1]])
def _(t):
    """A list in a table: each micro-batch is screened like a table."""
    out, ckpt = scratch_path(t.spark, "screened"), scratch_path(t.spark, "screened-ckpt")
    J.screen_batches(_stream(t, "documents").select("doc_id", "text"), "doc_id", [], out, ckpt, exact_terms=many_terms(t))
    return t.spark.read.parquet(out).select("doc_id", "message")
