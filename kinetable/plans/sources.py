"""Queries that write a lake or sidecar files, read them back and summarise them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions.vectors import slice_range
from kinetable.operators import stats as S
from kinetable.plans.fixtures import view
from kinetable.plans.registry import query, r, rs
from kinetable.session import scratch_path
from kinetable.sources import lake as L, manifests as M


def _lake(t, label):
    """Frames laid out as one dataset folder: ``data/<chunk>/*.parquet``."""
    root = scratch_path(t.spark, label)
    f = t["frames"].select("dataset_id", "episode_index", "frame_index", slice_range("emb", 0, 8).alias("state"))
    f.withColumn("chunk", F.floor(F.col("episode_index") / 1000)).write.partitionBy("chunk").parquet(f"{root}/data")
    return root


@query("s1_read_frames", view("frames") + f" SELECT dataset_id, count(*) AS n, count(DISTINCT episode_index) AS episodes, {rs('sum(emb[1])')} AS total FROM frames GROUP BY dataset_id")
def _(t):
    f = L.read_frames(t.spark, _lake(t, "frames"))
    return f.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("episode_index").alias("episodes"), r(F.sum(F.get("state", F.lit(0)))).alias("total"))


@query("s2_discover", "SELECT DISTINCT concat('ds', CAST(floor(vec_id / 25) AS BIGINT) % 4) AS dataset FROM embeddings")
def _(t):
    root = scratch_path(t.spark, "discover")
    f = t["frames"].select("dataset_id", "episode_index")
    for k in range(4):
        part = f.where(F.col("dataset_id") == k)
        part.withColumn("chunk", F.lit("c0")).write.partitionBy("chunk").parquet(f"{root}/ds{k}/data")
        part.select("episode_index").distinct().write.json(f"{root}/ds{k}/meta/episodes.jsonl")
    f.limit(1).write.parquet(f"{root}/no_meta/data/x")
    found = L.discover(L.list_files(t.spark, root), root)
    return found.select(F.regexp_extract("dataset_path", r"([^/]+)$", 1).alias("dataset"))


@query("s3_read_meta", """SELECT 'episodes' AS kind, count(*) AS n, CAST(sum(o_custkey % 100 + 1) AS BIGINT) AS total FROM orders UNION ALL SELECT 'tasks', count(*), CAST(sum(r_regionkey) AS BIGINT) FROM region
    UNION ALL SELECT 'info', count(*), 3 FROM orders UNION ALL SELECT 'modality', 3, 8 FROM (SELECT count(*) FROM orders)""")
def _(t):
    root = scratch_path(t.spark, "meta")
    o = t["orders"]
    o.select(F.col("o_orderkey").alias("episode_index"), F.array("o_orderpriority").alias("tasks"), (F.col("o_custkey") % 100 + 1).alias("length")).write.json(f"{root}/meta/episodes.jsonl")
    t["region"].select(F.col("r_regionkey").cast("long").alias("task_index"), F.col("r_name").alias("task")).write.json(f"{root}/meta/tasks.jsonl")
    n = o.agg(F.count(F.lit(1)).alias("total_episodes"))
    splits = F.create_map(*[F.lit(x) for x in ("train", "0:79", "val", "80:89", "test", "90:99")])
    n.withColumn("splits", splits).write.json(f"{root}/meta/info.json")
    sl = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"))
    n.select(F.struct(sl(0, 7).alias("arm"), sl(7, 8).alias("grip")).alias("state"), F.struct(sl(8, 15).alias("arm")).alias("action")).write.json(f"{root}/meta/modality.json")
    m = L.read_meta(t.spark, root)
    slices = L.modality_slices(m["modality"])
    out = m["episodes"].select(F.lit("episodes").alias("kind"), F.col("length").alias("v")).unionByName(m["tasks"].select(F.lit("tasks").alias("kind"), F.col("task_index").alias("v")))
    out = out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    info = m["info"].select(F.lit("info").alias("kind"), F.col("total_episodes").alias("n"), F.size("splits").cast("long").alias("total"))
    mods = slices.agg(F.lit("modality").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("modality") == "state", F.col("end") - F.col("start"))).alias("total"))
    return out.unionByName(info).unionByName(mods)


@query("s4_video_features", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 288 ELSE p_size + 100 END AS height, CASE WHEN p_partkey % 4 = 3 THEN 512 ELSE p_size + 200 END AS width, CASE WHEN p_partkey % 4 = 3 THEN 3 WHEN p_partkey % 4 = 2 THEN 4 ELSE 3 END AS channels,
    CAST(CASE WHEN p_partkey % 3 = 0 THEN 25 WHEN p_partkey % 5 = 0 THEN 60 ELSE 30 END AS DOUBLE) AS fps FROM part""")
def _(t):
    k = F.col("p_partkey")
    h, w = (F.col("p_size") + 100).cast("long"), (F.col("p_size") + 200).cast("long")
    shape = F.when(k % 4 == 0, F.array(h, w, F.lit(3).cast("long"))).when(k % 4 == 1, F.array(F.lit(3).cast("long"), h, w)).when(k % 4 == 2, F.array(w, F.lit(4).cast("long"), h)).otherwise(F.array(F.lit(9).cast("long")))
    names = F.when(k % 4 == 0, F.array(F.lit("height"), F.lit("width"), F.lit("channels"))).when(k % 4 == 2, F.array(F.lit("w"), F.lit("c"), F.lit("h")))
    null = F.lit(None).cast("double")
    f = t["part"].select("p_partkey", shape.alias("shape"), names.alias("names"), F.when(k % 3 == 0, 25.0).otherwise(null).alias("video_info_fps"), F.when(k % 5 == 0, 60.0).otherwise(null).alias("info_fps"), null.alias("feature_fps"))
    v = L.video_features(f)
    return v.select("p_partkey", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"), F.col("channels").cast("long").alias("channels"), F.col("resolved_fps").alias("fps"))


def _annotations(t):
    path = scratch_path(t.spark, "annotations")
    k = F.col("o_orderkey")
    n = (k % 5).cast("int")
    state = F.transform(F.sequence(F.lit(0), n), lambda i: F.array(*[(k % 100 + i * 10 + j).cast("double") for j in range(7)]))
    grip = F.transform(F.sequence(F.lit(0), n), lambda i: (i % 2).cast("double"))
    t["orders"].select(state.alias("state"), grip.alias("continuous_gripper_state"), F.struct((k % 3 == 0).alias("is_eval")).alias("episode_metadata")).write.json(path)
    return L.read_annotations(t.spark, path, multi=False)


_ANN = "SELECT frame_index, count(*) AS n, CAST(sum(k % 100 + frame_index * 10) AS DOUBLE) AS x, CAST(sum(k % 100 + frame_index * 10 + 5) AS DOUBLE) AS last, CAST(sum(frame_index % 2) AS DOUBLE) AS grip FROM (SELECT o_orderkey AS k FROM orders) JOIN range(0, 5) AS f(frame_index) ON frame_index <= k % 5 {} GROUP BY frame_index"


def _ann_sum(a):
    return a.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get("arm_state", F.lit(0))).alias("x"), F.sum(F.element_at("arm_state", -1)).alias("last"), F.sum("gripper").alias("grip"))


@query("s5_read_annotations", _ANN.format(""))
def _(t):
    return _ann_sum(_annotations(t))


@query("f12_filter_rollout", _ANN.format("WHERE k % 3 = 0"))
def _(t):
    return _ann_sum(L.filter_rollout(_annotations(t), True))


@query("s6_expand_manifest", """SELECT p_partkey, concat('path/', p_brand) AS root, concat('part_', i, '.tar') AS path, CASE WHEN p_size % 2 = 0 THEN 'video' ELSE 'video,metas' END AS keys FROM part, range(0, 10) AS g(i) WHERE i < p_size % 4""")
def _(t):
    k = F.col("p_size")
    files = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i < k % 4, F.concat(F.lit("part_"), i, F.lit(".tar")))), lambda x: x.isNotNull())
    m = t["part"].select("p_partkey", F.concat(F.lit("s3://bucket/path/"), "p_brand").alias("root"), files.alias("data_list"), F.when(k % 2 == 0, F.array(F.lit("video"))).alias("own_keys"))
    return M.expand_manifest(m, ["video", "metas"], "own_keys").select("p_partkey", "root", "path", F.concat_ws(",", "keys").alias("keys"))


@query("s6_mixed_chunk_sizes", "SELECT p_brand AS dset_id, arg_min(100 + p_size % 3, p_partkey) AS chunk_size, CAST(sum(p_size) AS BIGINT) AS total_key_count, count(DISTINCT p_size % 3) > 1 AS mixed FROM part GROUP BY p_brand")
def _(t):
    p = t["part"].select(F.col("p_brand").alias("dset_id"), F.col("p_partkey").alias("manifest"), (100 + F.col("p_size") % 3).alias("chunk_size"), F.col("p_size").cast("long").alias("total_key_count"))
    return M.mixed_chunk_sizes(p)


@query("s7_load_manifest", "SELECT o_orderkey, concat('sample_', o_orderkey) AS name, o_orderstatus AS model, 7 AS seed FROM orders")
def _(t):
    o = t["orders"].select("o_orderkey", F.concat(F.lit("sample_"), "o_orderkey").alias("name"), F.col("o_orderstatus").alias("model"), F.lit(0).alias("seed"))
    return M.require_unique_names(M.load_manifest(o, {"seed": 7, "model": None})).select("o_orderkey", "name", "model", "seed")


@query("s7_duplicate_names", "SELECT p_name AS name, count(*) AS copies FROM part GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return M.duplicate_names(t["part"].select(F.col("p_name").alias("name")))


@query("s8_prompts_from_lines", """SELECT doc_id, concat('clip_', doc_id, '.mp4') AS clip, md5(concat('The robot arm is performing a task. ', replace(text, chr(10), ' '))) AS digest FROM documents""")
def _(t):
    body = F.replace("text", F.lit("\n"), F.lit(" "))
    quoted = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(body)
    lines = t["documents"].select("doc_id", F.concat(F.lit("videos/clip_"), "doc_id", F.lit(".mp4,"), quoted).alias("value"))
    p = M.prompts_from_lines(lines, "The robot arm is performing a task. ")
    return p.select("doc_id", "clip", F.md5("prompt").alias("digest"))


@query("s9_unpivot_captions", "SELECT o_orderkey, 'o_orderstatus' AS sample_id, o_orderstatus AS caption, 'pinhole_front' AS view FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, 'pinhole_front' FROM orders")
def _(t):
    return M.unpivot_captions(t["orders"].select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"], "pinhole_front").drop("tag")


@query("s10_caption_from_json", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderstatus ELSE '' END AS caption FROM orders")
def _(t):
    k = F.col("o_orderkey") % 4
    both = F.concat(F.lit('{"m": {"short": "'), "o_orderstatus", F.lit('", "long": "'), "o_orderpriority", F.lit('"}}'))
    bare = F.concat(F.lit('"m": {"short": "'), "o_orderstatus", F.lit('"}'))
    only = F.concat(F.lit('{"m": {"tiny": "'), "o_orderstatus", F.lit('"}}'))
    text = F.when(k == 0, both).when(k == 1, bare).when(k == 2, only).otherwise(F.lit("{not json"))
    return t["orders"].select("o_orderkey", M.caption_from_json(text, "long").alias("caption"))


@query("s11_detect_caption_format", "SELECT o_custkey AS clip_set, CASE WHEN count(*) FILTER (o_orderkey % 3 = 0) > 0 THEN 'json' WHEN count(*) FILTER (o_orderkey % 3 = 1) > 0 THEN 'text' ELSE '' END AS caption_format FROM orders GROUP BY 1")
def _(t):
    k = F.col("o_orderkey")
    path = F.when(k % 3 == 0, F.concat(F.lit("/d/captions/"), k, F.lit(".json"))).when(k % 3 == 1, F.concat(F.lit("/d/metas/"), k, F.lit(".txt"))).otherwise(F.concat(F.lit("/d/videos/"), k, F.lit(".mp4")))
    d = M.detect_caption_format(t["orders"].select(F.col("o_custkey").alias("clip_set"), path.alias("path")), ["clip_set"])
    return d.withColumn("caption_format", F.coalesce("caption_format", F.lit("")))


@query("s12_pruned_lengths", view("frames") + " SELECT dataset_id, episode_index, count(*) AS length FROM frames GROUP BY ALL")
def _(t):
    f = L.read_frames(t.spark, _lake(t, "lengths"))
    return f.groupBy("dataset_id", "episode_index").agg(F.count("frame_index").alias("length"))


@query("s13_write_lake", view("frames_wide") + f" SELECT dataset_id, concat('chunk-', lpad(CAST(episode_index // 1000 AS VARCHAR), 3, '0')) AS chunk, count(*) AS n, {rs('sum(vec[1])', 2)} AS total, count(DISTINCT episode_index) AS episodes FROM frames_wide GROUP BY 1, 2")
def _(t):
    path = scratch_path(t.spark, "lake")
    L.write_lake(t["frames_wide"], path)
    roots = [x.dataset_path for x in L.discover(L.list_files(t.spark, path), path).select("dataset_path").collect()]
    back = L.read_frames(t.spark, roots)
    chunk = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+)/", 1)
    same = F.when(F.col("file_episode") == F.col("episode_index"), F.col("file_episode"))
    return back.groupBy(F.element_at(F.split("dataset_path", "/"), -1).cast("long").alias("dataset_id"), chunk.alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(F.get("vec", F.lit(0))), 2).alias("total"), F.count_distinct(same).alias("episodes"))


@query("s14_write_stats", view("frames") + f""" SELECT dataset_id, 3 AS stride, {rs('avg(emb[1])')} AS mean0, {rs('max(emb[8])')} AS max7 FROM frames GROUP BY dataset_id""")
def _(t):
    path = scratch_path(t.spark, "stats")
    f = t["frames"].select("dataset_id", slice_range("emb", 0, 8).alias("state"))
    L.write_stats(S.raw_column_stats(f, ["state"], ["dataset_id"]), path, stride=3)
    body = "struct<mean:array<double>,std:array<double>,min:array<double>,max:array<double>,q01:array<double>,q99:array<double>>"
    back = t.spark.read.schema(f"dataset_id long, stats map<string,{body}>, timestep_interval long").json(path)
    s = F.col("stats")["state"]
    return back.select("dataset_id", F.col("timestep_interval").alias("stride"), r(F.get(s["mean"], F.lit(0))).alias("mean0"), r(F.get(s["max"], F.lit(7))).alias("max7"))


@query("s15_append_history", view("eval_frames") + f""" SELECT checkpoint, {rs('avg(l1)')} AS fds_l1_mean, 18 AS width, isnan(CAST('nan' AS DOUBLE)) AS gatc_missing FROM eval_frames GROUP BY checkpoint""")
def _(t):
    path = scratch_path(t.spark, "history")
    agg = t["eval_frames"].groupBy("checkpoint").agg(F.avg("l1").alias("l1_mean")).withColumn("iteration", F.lit(1000))
    for half in (F.col("checkpoint") < "N", F.col("checkpoint") >= "N"):
        L.append_history(agg.where(half), path, {"fds_l1_mean": "l1_mean", "timestamp": "checkpoint"})
    back = t.spark.read.parquet(path)
    return back.select(F.col("timestamp").alias("checkpoint"), r("fds_l1_mean").alias("fds_l1_mean"), F.lit(len(back.columns)).alias("width"), F.isnan("gatc_median").alias("gatc_missing"))
