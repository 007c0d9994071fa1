"""Structured Streaming jobs: telemetry, result ingest, statistics refresh, screening."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def telemetry_stream(
    events: DataFrame, window: str = "1 hour", watermark: str = "10 minutes", rank: str = "worker_rank",
    ts: str = "ts", value: str = "seconds",
) -> DataFrame:
    """Tumbling-window latency per worker. Works on a stream and, unchanged, on a batch."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    g = timed.groupBy(F.window("_ts", window).alias("w"), F.col(rank)).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean_seconds"),
        F.max(value).alias("max_seconds"), F.sum(value).alias("total_seconds"),
    )
    return g.select(F.col("w.start").alias("window_start"), rank, "count", "mean_seconds", "max_seconds", "total_seconds")


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available now into a parquet table and stop."""
    q = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q


def ingest_results(
    spark: SparkSession, inbox: str, schema: str, checkpoint: str, out: str, fmt: str = "json",
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Append each new result file to the history exactly once.

    A batch is written below its own id and replaces itself when it is retried.
    """
    stream = spark.readStream.schema(schema).format(fmt).load(inbox)
    shaped = transform(stream) if transform else stream

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    return run_batches(shaped, write, checkpoint)


def refresh_partials(stream: DataFrame, by: Sequence[str], out: str, checkpoint: str, value: str = "value") -> StreamingQuery:
    """Store mergeable partial moments per micro-batch; retries overwrite their own part."""
    from kinetable.operators.stats import partial_stats

    def write(batch: DataFrame, batch_id: int) -> None:
        partial_stats(batch, by, value).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    return run_batches(stream, write, checkpoint)


def screen_stream(stream: DataFrame, rules: Sequence[tuple[str, Column]], text: str = "text") -> DataFrame:
    """Stateless screening of a stream by column rules."""
    from kinetable.operators.safety import screen

    return screen(stream, rules, text)


def screen_batches(
    stream: DataFrame, key: str, terms: Sequence[str] | DataFrame, out: str, checkpoint: str, allow: Sequence[str] | DataFrame = (),
    exact_terms: Sequence[str] | DataFrame | None = None, text: str = "text", min_chars: int = 6, slack: float = 0.4,
) -> StreamingQuery:
    """The full block-list screen of a stream of prompts, into one folder for each micro-batch below ``out``.

    Lists may be tables of any length; they are read and normalised once, before the stream starts. A micro-batch is
    screened like a table, so matches that need a join work too, and a batch that is retried replaces its own folder.
    Lists short enough to travel in the plan can also be given to ``blocklist_screen`` on the stream itself.
    """
    from kinetable.operators.safety import blocklist_screen
    from kinetable.session import staged

    fixed = lambda t, label: staged(t, label) if isinstance(t, DataFrame) else t
    terms, allow, exact_terms = fixed(terms, "stream-terms"), fixed(allow, "stream-allowed"), fixed(exact_terms, "stream-exact")

    def write(batch: DataFrame, batch_id: int) -> None:
        # Read more than once where lists are long: written first, so the source is read once.
        rows = staged(batch, "stream-prompts")
        blocklist_screen(rows, key, terms, allow, exact_terms, text, min_chars, slack).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    return run_batches(stream, write, checkpoint)


def latest_per_key(updates: DataFrame, keys: Sequence[str], version: str = "batch_id") -> DataFrame:
    """Newest row per key of an update-mode table; a combinable aggregate."""
    rest = [c for c in updates.columns if c not in keys and c != version]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r"))
    return newest.select(*keys, "_r.*")
