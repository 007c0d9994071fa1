"""Logical tables over the generic test tables, in Spark and as SQL.

Frames, clips, captions, telemetry and scores are views of whatever tables a folder
holds; each has a Spark builder and an equal SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinetable.operators.ranking import int_block, position


def _frames(t) -> DataFrame:
    ep = F.floor(F.col("vec_id") / 25).cast("long")
    return t["embeddings"].select(
        (ep % 4).alias("dataset_id"), ep.alias("episode_index"), (F.col("vec_id") % 25).alias("frame_index"), "vec_id",
        F.col("embedding").cast("array<double>").alias("emb"),
    )


def _clips(t) -> DataFrame:
    return t["orders"].select(
        F.col("o_orderkey").alias("clip_id"), F.col("o_orderpriority").alias("source"),
        (10 + F.col("o_custkey") % 51).alias("fps"),
        (60 + F.floor("o_totalprice").cast("long") % 1200).alias("n_frames"),
    )


def _captions(t) -> DataFrame:
    return t["documents"].select(F.col("doc_id").alias("clip_id"), "source", F.col("text").alias("caption"), "lang")


def _telemetry(t) -> DataFrame:
    return t["events"].select(
        "event_id", F.col("user_id").alias("worker_rank"), F.col("event_type").alias("op"), "ts", F.col("value").alias("seconds")
    )


def _eval_frames(t) -> DataFrame:
    return t["lineitem"].select(
        F.concat("l_returnflag", "l_linestatus").alias("checkpoint"), (F.col("l_suppkey") % 4).alias("dataset_id"),
        F.col("l_orderkey").alias("episode_index"), (F.col("l_linenumber").cast("long") - 1).alias("frame_index"),
        F.col("l_discount").alias("l1"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_tax") * 10).alias("gatc"),
        F.col("l_quantity").alias("tcd"),
    )


def _shards(t) -> DataFrame:
    return t["part"].select(
        F.col("p_partkey").alias("shard_id"), F.col("p_name").alias("path"), F.col("p_brand").alias("source"),
        F.col("p_size").cast("long").alias("key_count"), (F.col("p_partkey") % 5).alias("bucket"),
    )


def _frame_votes(t) -> DataFrame:
    o = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("video_id"))
    l = t["lineitem"].select("l_orderkey", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("unsafe"))
    return l.join(o, "l_orderkey").select("video_id", "unsafe")


def _frames_wide(t) -> DataFrame:
    """Customer histories as episodes of 4-value frames, numbered without a per-customer sort."""
    o = t["orders"].select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("episode_index"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    rows = t["lineitem"].select(*order, "l_discount", "l_tax").join(o, "l_orderkey")
    numbered = position(rows, ["episode_index"], order, int_block("l_orderkey", 4096), "frame_index")
    vec = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("vec")
    return numbered.select((F.col("episode_index") % 8).alias("dataset_id"), "episode_index", "frame_index", vec)


def _episodes(t) -> DataFrame:
    """Orders as episodes: dataset by customer segment number, length by line count."""
    n = t["lineitem"].groupBy(F.col("l_orderkey").alias("episode_index")).agg(F.count(F.lit(1)).alias("length"))
    return n.select((F.col("episode_index") % 7).alias("dataset_id"), "episode_index", "length")


def _datasets(t) -> DataFrame:
    """Suppliers as datasets of a mixture."""
    n = t["lineitem"].groupBy(F.col("l_suppkey").alias("dataset_id")).agg(F.count(F.lit(1)).alias("real_len"))
    s = t["supplier"].select(F.col("s_suppkey").alias("dataset_id"), (1.0 + F.abs("s_acctbal") / 1000.0).alias("mix_ratio"),
                             (F.col("s_nationkey") % 5).cast("long").alias("family"))
    return s.join(n, "dataset_id")


DERIVED = {
    "frames": _frames, "clips": _clips, "captions": _captions, "telemetry": _telemetry, "eval_frames": _eval_frames,
    "shards": _shards, "frame_votes": _frame_votes, "frames_wide": _frames_wide, "episodes": _episodes,
    "datasets": _datasets,
}

_SQL = {
    "frames": """SELECT CAST(floor(vec_id / 25) AS BIGINT) % 4 AS dataset_id, CAST(floor(vec_id / 25) AS BIGINT) AS episode_index,
        CAST(vec_id % 25 AS BIGINT) AS frame_index, vec_id, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings""",
    "clips": """SELECT o_orderkey AS clip_id, o_orderpriority AS source, 10 + o_custkey % 51 AS fps,
        60 + CAST(floor(o_totalprice) AS BIGINT) % 1200 AS n_frames FROM orders""",
    "captions": "SELECT doc_id AS clip_id, source, text AS caption, lang FROM documents",
    "telemetry": "SELECT event_id, user_id AS worker_rank, event_type AS op, ts, value AS seconds FROM events",
    "eval_frames": """SELECT concat(l_returnflag, l_linestatus) AS checkpoint, l_suppkey % 4 AS dataset_id,
        l_orderkey AS episode_index, CAST(l_linenumber AS BIGINT) - 1 AS frame_index, l_discount AS l1,
        CASE WHEN l_linenumber % 5 <> 0 THEN l_tax * 10 END AS gatc, l_quantity AS tcd FROM lineitem""",
    "shards": """SELECT p_partkey AS shard_id, p_name AS path, p_brand AS source, CAST(p_size AS BIGINT) AS key_count,
        p_partkey % 5 AS bucket FROM part""",
    "frame_votes": """SELECT o_custkey AS video_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS unsafe
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "frames_wide": """SELECT o_custkey % 8 AS dataset_id, o_custkey AS episode_index,
        row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey,
            l_extendedprice, l_quantity, l_shipdate) - 1 AS frame_index,
        [l_quantity, l_extendedprice, l_discount, l_tax] AS vec FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "episodes": """SELECT l_orderkey % 7 AS dataset_id, l_orderkey AS episode_index, count(*) AS length
        FROM lineitem GROUP BY l_orderkey""",
    "datasets": """SELECT s_suppkey AS dataset_id, CAST(1.0 AS DOUBLE) + abs(s_acctbal) / CAST(1000.0 AS DOUBLE) AS mix_ratio,
        CAST(s_nationkey % 5 AS BIGINT) AS family, n.real_len
        FROM supplier JOIN (SELECT l_suppkey, count(*) AS real_len FROM lineitem GROUP BY l_suppkey) n ON l_suppkey = s_suppkey""",
}


def view(*names: str) -> str:
    """``WITH`` clause defining the named logical tables in SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({_SQL[n]})" for n in names)


def lcg_sql(expr: str, seed: int = 0) -> str:
    """The SQL twin of :func:`kinetable.functions.hashing.lcg`."""
    return f"(((CAST({expr} AS BIGINT) % 1000003 + {seed}) * 1103515245 + 12345) % 1000003)"


def u_sql(expr: str, seed: int = 0) -> str:
    return f"({lcg_sql(expr, seed)} / CAST(1000003 AS DOUBLE))"
