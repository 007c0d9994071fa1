"""Queries over dataset checks, schema diffs and re-indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions.hashing import lcg_uniform
from kinetable.operators import quality as Q
from kinetable.plans.fixtures import u_sql, view
from kinetable.plans.registry import query, r, rs


@query("j6_orphans", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'right' ELSE 'left' END AS missing_in
    FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id + 3 AS doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def _(t):
    return Q.orphans(t["documents"], t["labels"].select((F.col("doc_id") + 3).alias("doc_id")), "doc_id")


@query("j8_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return Q.pending(t["documents"].select("doc_id"), t["labels"], "doc_id")


@query("j5_assemble_samples", "SELECT o_orderkey AS key, o_custkey, l.n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT doc_id FROM documents)")
def _(t):
    return Q.assemble_samples(_streams(t)).select("key", "o_custkey", "n")


def _streams(t):
    return {
        "meta": t["orders"].select(F.col("o_orderkey").alias("key"), "o_custkey"),
        "video": t["lineitem"].where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("key")).agg(F.count(F.lit(1)).alias("n")),
        "caption": t["documents"].select(F.col("doc_id").alias("key")),
    }


@query("j5_missing_parts", """WITH m AS (SELECT o_orderkey AS key FROM orders), v AS (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_returnflag = 'R'), c AS (SELECT doc_id AS key FROM documents), a AS (SELECT key FROM m UNION SELECT key FROM v UNION SELECT key FROM c)
    SELECT key, 'meta' AS stream FROM a WHERE key NOT IN (SELECT key FROM m) UNION ALL SELECT key, 'video' FROM a WHERE key NOT IN (SELECT key FROM v) UNION ALL SELECT key, 'caption' FROM a WHERE key NOT IN (SELECT key FROM c)""")
def _(t):
    return Q.missing_parts(_streams(t))


@query("j5_zip_streams", "WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) SELECT pos, o_orderkey, doc_id FROM a JOIN b USING (pos)")
def _(t):
    from kinetable.operators.ranking import int_block, position

    a = position(t["orders"].select("o_orderkey"), [], ["o_orderkey"], int_block("o_orderkey", 4096))
    b = position(t["documents"].select("doc_id"), [], ["doc_id"], int_block("doc_id", 4096))
    return Q.zip_streams({"a": a, "b": b}).select("pos", "o_orderkey", "doc_id")


@query("j7_pair_by_stem", "SELECT p_partkey, concat('prompt ', p_partkey) AS prompt FROM part")
def _(t):
    p = t["part"]
    ext = F.when(F.col("p_partkey") % 2 == 0, ".jpg").otherwise(".png")
    images = p.select("p_partkey", F.concat(F.lit("d/img_"), "p_partkey", ext).alias("path"))
    dots = F.when(F.col("p_partkey") % 5 == 0, "..txt").otherwise(".txt")
    prompts = p.select(F.concat(F.lit("d/img_"), "p_partkey", dots).alias("prompt_path"), F.concat(F.lit("prompt "), "p_partkey").alias("prompt"))
    return Q.pair_by_stem(images, prompts).select("p_partkey", "prompt")


@query("f16_missing_fields", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'tasks' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN ',' ELSE '' END || 'length' ELSE '' END AS missing FROM part")
def _(t):
    have = F.array_compact(F.array(F.lit("episode_index"), F.when(F.col("p_size") % 2 != 0, "tasks"), F.when(F.col("p_size") % 3 != 0, "length")))
    m = Q.missing_fields(t["part"].withColumn("have", have), ["episode_index", "tasks", "length"], F.col("have"))
    return m.select("p_partkey", F.concat_ws(",", "missing").alias("missing"))


_TS = "strftime(o_orderdate, '%Y%m%d') || '-101500-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0')"


@query("f13_whitelist_by_token", f"SELECT o_orderkey, {_TS} AS ts_id FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    ts = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-101500-"), F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"))
    o = t["orders"].withColumn("tok", ts)
    eps = o.select("o_orderkey", F.concat(F.lit("/z/run_"), "tok", F.lit(".zip")).alias("path"))
    notes = o.where("o_orderstatus = 'F'").select(F.concat(F.lit("| kept `"), "tok", F.lit("` | twin |")).alias("text"))
    return Q.whitelist_by_token(eps, notes).select("o_orderkey", "ts_id")


@query("o2_set_diff", "SELECT l_partkey AS k, 'a_only' AS side FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT l_partkey, 'b_only' FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT -l_orderkey, 'a_only' FROM (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def _(t):
    a, b = t["lineitem"].where("l_returnflag = 'R'"), t["lineitem"].where("l_returnflag = 'A'")
    parts = Q.set_diff(a, b, "l_partkey").select(F.col("l_partkey").alias("k"), "side")
    orders = Q.set_diff(a, b, "l_orderkey").where("side = 'a_only'").select((-F.col("l_orderkey")).alias("k"), "side")
    return parts.unionByName(orders)


_LEN = "(SELECT l_orderkey, count(*) AS length FROM lineitem WHERE l_returnflag = '{}' GROUP BY 1)"


@query("o3_multiset_diff", f"SELECT coalesce(a.length, b.length) AS length, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS a_surplus, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS b_surplus FROM (SELECT length, count(*) AS n FROM {_LEN.format('R')} GROUP BY 1) a FULL JOIN (SELECT length, count(*) AS n FROM {_LEN.format('A')} GROUP BY 1) b ON a.length = b.length WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def _(t):
    return Q.multiset_diff(_lengths(t, "R"), _lengths(t, "A"), "length")


def _lengths(t, flag):
    return t["lineitem"].where(F.col("l_returnflag") == flag).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("length"))


@query("o5_stable_order", view("shards") + " SELECT path, source, shard_id FROM shards ORDER BY path, source, shard_id")
def _(t):
    return Q.stable_order(t["shards"].select("path", "source", "shard_id"), ["path", "source", "shard_id"])


@query("o6_top_k", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 5")
def _(t):
    return Q.top_k(t["lineitem"].groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), "n", 5, ["l_suppkey"])


def _streams_len(t):
    k = F.col("o_orderkey")
    n = 20 + F.col("o_custkey") % 40
    img = n + F.when(k % 9 == 0, k % 7).otherwise(0)
    return t["orders"].select((F.col("o_custkey") % 4).alias("dataset_id"), k.alias("episode_index"), n.alias("n_kin_source"), img.alias("n_img_source"), F.least(n, img).alias("num_frames"))


_SL = "WITH s AS (SELECT o_custkey % 4 AS dataset_id, o_orderkey AS episode_index, 20 + o_custkey % 40 AS kin, 20 + o_custkey % 40 + CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey % 7 ELSE 0 END AS img FROM orders)"


@query("a19_length_mismatch", _SL + f" SELECT dataset_id, count(*) AS episodes, count(*) FILTER (kin <> img) AS mismatched, CAST(sum(abs(kin - img)) AS BIGINT) AS dropped, {rs('100.0 * sum(abs(kin - img)) / greatest(1, sum(least(kin, img)) + sum(abs(kin - img)))')} AS dropped_pct FROM s GROUP BY dataset_id")
def _(t):
    return Q.length_mismatch(_streams_len(t), by=["dataset_id"]).withColumn("dropped_pct", r("dropped_pct"))


@query("a19_worst_mismatches", _SL + " SELECT episode_index, abs(kin - img) AS drop_frames FROM s WHERE kin <> img ORDER BY 2 DESC, 1 LIMIT 5")
def _(t):
    return Q.worst_mismatches(_streams_len(t), ties=["episode_index"]).select("episode_index", "drop_frames")


@query("w36_merge_reindex", """WITH s AS (SELECT o_orderkey AS orig_idx, concat(o_orderpriority, '/', o_custkey % 13) AS instruction, 10 + o_custkey % 50 AS length FROM orders),
    f AS (SELECT instruction, row_number() OVER (ORDER BY min(orig_idx)) - 1 AS task_index FROM s GROUP BY instruction)
    SELECT orig_idx, row_number() OVER (ORDER BY orig_idx) - 1 AS episode_index, CAST(sum(length) OVER (ORDER BY orig_idx) - length AS BIGINT) AS frame_offset, task_index FROM s JOIN f USING (instruction)""")
def _(t):
    s = t["orders"].select(F.col("o_orderkey").alias("orig_idx"), F.concat("o_orderpriority", F.lit("/"), F.col("o_custkey") % 13).alias("instruction"), (10 + F.col("o_custkey") % 50).alias("length"))
    return Q.merge_reindex(s).select("orig_idx", "episode_index", "frame_offset", "task_index")


@query("w36_merge_without_instruction", """WITH s AS (SELECT o_orderkey AS orig_idx, CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority END AS instruction FROM orders),
    f AS (SELECT instruction, row_number() OVER (ORDER BY min(orig_idx)) - 1 AS task_index FROM s GROUP BY instruction)
    SELECT orig_idx, task_index FROM s JOIN f ON s.instruction IS NOT DISTINCT FROM f.instruction""")
def _(t):
    s = t["orders"].select(F.col("o_orderkey").alias("orig_idx"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")).alias("instruction"), F.lit(5).alias("length"))
    return Q.merge_reindex(s).select("orig_idx", "task_index")


@query("q1_reconcile", """WITH e AS (SELECT o_custkey % 9 AS dataset_id, count(*) AS le, CAST(sum(o_custkey % 50 + 1) AS BIGINT) AS sf FROM orders GROUP BY 1), f AS (SELECT o_custkey % 9 AS dataset_id, count(*) AS fc FROM orders WHERE NOT (o_custkey % 9 = 4 AND o_orderkey % 50 = 0) GROUP BY 1)
    SELECT dataset_id, le AS total_episodes, le AS listed_episodes, fc AS file_count, sf AS summed_frames, le = fc AS episodes_ok, dataset_id <> 2 AS frames_ok FROM e JOIN f USING (dataset_id)""")
def _(t):
    o = t["orders"].select((F.col("o_custkey") % 9).alias("dataset_id"), "o_orderkey", (F.col("o_custkey") % 50 + 1).alias("length"))
    info = o.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("total_episodes"), (F.sum("length") + F.when(F.col("dataset_id") == 2, 1).otherwise(0)).alias("total_frames"))
    files = o.where(~((F.col("dataset_id") == 4) & (F.col("o_orderkey") % 50 == 0)))
    return Q.reconcile(info, o, files).select("dataset_id", "total_episodes", "listed_episodes", "file_count", "summed_frames", "episodes_ok", "frames_ok")


@query("q2_sample_length_check", f"""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT o_custkey % 4 AS dataset_id, o_orderkey, n AS kin, n + CASE WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN -1 ELSE 0 END AS img FROM orders JOIN c ON l_orderkey = o_orderkey),
    p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY {u_sql('o_orderkey', 8)}, o_orderkey) <= 25) SELECT dataset_id, o_orderkey AS episode_index, least(kin, img) AS expected, kin AS actual, least(kin, img) = kin AS length_ok FROM p""")
def _(t):
    k = F.col("o_orderkey")
    n = t["lineitem"].groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_kin_source"))
    a = t["orders"].join(n, "o_orderkey").select((F.col("o_custkey") % 4).alias("dataset_id"), k.alias("episode_index"), "n_kin_source",
        (F.col("n_kin_source") + F.when(k % 5 == 0, 2).when(k % 7 == 0, -1).otherwise(0)).alias("n_img_source"))
    ds = t["orders"].select(k.alias("episode_index"), (F.col("o_custkey") % 4).alias("dataset_id"))
    frames = t["lineitem"].select(F.col("l_orderkey").alias("episode_index")).join(ds, "episode_index")
    c = Q.sample_length_check(a, frames, 25, lcg_uniform("episode_index", 8), ["dataset_id"], "episode_index")
    return c.select("dataset_id", "episode_index", "expected", "actual", "length_ok")


def _features(t):
    """Two feature tables out of parts: camera names spelled differently, some fields changed."""
    k = F.col("p_partkey")
    name = F.replace("p_name", F.lit(" "), F.lit("."))
    cam = F.when(k % 3 == 0, F.concat(F.lit("action."), "p_name", k)).otherwise(F.concat(F.lit("observation.images."), name, F.lit("."), k))
    cam2 = F.when(k % 3 == 0, F.concat(F.lit("action."), "p_name", k)).otherwise(F.concat(F.lit("observation.images."), F.replace(name, F.lit("."), F.lit("_")), F.lit("_"), k))
    dtype = F.when(k % 3 == 0, "float32").otherwise("video")
    shape = F.concat(F.lit("["), "p_size", F.lit("]"))
    names = F.when(k % 3 == 0, '["x", "y"]').otherwise('["height", "width", "channel"]')
    names2 = F.when(k % 3 == 0, F.when(k % 2 == 0, '[["x", "y"]]').otherwise('["x", "z"]')).otherwise(F.when(k % 2 == 0, '["h", "w", "channels"]').otherwise('["height", "width", "channel"]'))
    p = t["part"]
    ref = p.where(k % 11 != 0).select(cam.alias("key"), dtype.alias("dtype"), shape.alias("shape"), names.alias("names"))
    test = p.where(k % 13 != 0).select(cam2.alias("key"), dtype.alias("dtype"), F.when(k % 17 == 0, "[0]").otherwise(shape).alias("shape"), names2.alias("names"))
    return ref, test


def _diff_sql(strict):
    both = "p_partkey % 11 <> 0 AND p_partkey % 13 <> 0" + (" AND p_partkey % 3 = 0" if strict else "")
    names_sev = "CASE WHEN p_partkey % 3 = 0 THEN " + (
        "'ERROR'" if strict else "CASE WHEN p_partkey % 2 = 0 THEN 'INFO' ELSE 'ERROR' END") + " WHEN p_partkey % 2 = 0 THEN 'INFO' ELSE 'OK' END"
    one = "((p_partkey % 11 = 0) <> (p_partkey % 13 = 0))"
    if strict:
        lone = "SELECT 'key' AS field, 'INFO' AS severity FROM part WHERE p_partkey % 3 = 0 AND " + one + (
            " UNION ALL SELECT 'key', 'INFO' FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 11 <> 0 UNION ALL SELECT 'key', 'INFO' FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 13 <> 0")
    else:
        lone = f"SELECT 'key' AS field, 'INFO' AS severity FROM part WHERE {one} UNION ALL SELECT 'key', 'INFO' FROM part WHERE {both} AND p_partkey % 3 <> 0"
    return f"""WITH d AS ({lone} UNION ALL SELECT 'dtype', 'OK' FROM part WHERE {both} UNION ALL SELECT 'shape', CASE WHEN p_partkey % 17 = 0 THEN 'ERROR' ELSE 'OK' END FROM part WHERE {both}
      UNION ALL SELECT 'names', {names_sev} FROM part WHERE {both}) SELECT field, severity, count(*) AS n FROM d GROUP BY field, severity"""


def _diffed(t, strict):
    return Q.diff_features(*_features(t), strict).groupBy("field", "severity").agg(F.count(F.lit(1)).alias("n"))


query("j9_diff_features", _diff_sql(False))(lambda t: _diffed(t, False))
query("j9_diff_features_strict", _diff_sql(True))(lambda t: _diffed(t, True))


def _field_diffs(t):
    k = F.col("p_partkey")
    at = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    scope = F.when(k % 2 == 0, "info").otherwise("modality")
    field = F.when(k % 2 == 0, at("fps", "robot_type", "codebase_version", "total_frames", "splits", "robot_type")).otherwise(at("start", "dtype", "original_key", "end", "absolute", "rotation_type", "original_key"))
    ref = F.when(k % 5 == 0, None).when(field == "robot_type", "arm").when(field == "original_key", "observation.images.cam.left").otherwise("1")
    test = F.when(k % 7 == 0, ref).when(field == "robot_type", "arm_mono").when(field == "original_key", "observation.images.cam_left").otherwise("2")
    return t["part"].select("p_partkey", scope.alias("scope"), field.alias("field"), ref.alias("ref_value"), test.alias("test_value"))


_FIELD = """WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'info' ELSE 'modality' END AS scope, CASE WHEN p_partkey % 2 = 0 THEN ['fps', 'robot_type', 'codebase_version', 'total_frames', 'splits', 'robot_type'][p_partkey % 6 + 1]
      ELSE ['start', 'dtype', 'original_key', 'end', 'absolute', 'rotation_type', 'original_key'][p_partkey % 7 + 1] END AS field FROM part),
    s AS (SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'OK' WHEN scope = 'info' THEN CASE WHEN field IN ('total_frames', 'splits') THEN 'INFO' WHEN field = 'robot_type' AND p_partkey % 5 <> 0 THEN 'INFO' WHEN field = 'codebase_version' THEN 'WARN' ELSE 'ERROR' END
      ELSE CASE WHEN field IN ('start', 'end') THEN 'ERROR' WHEN p_partkey % 5 = 0 OR field = 'original_key' THEN 'INFO' ELSE 'WARN' END END AS severity FROM f)"""


@query("x27_severity", _FIELD + " SELECT p_partkey, scope, field, severity FROM s")
def _(t):
    return Q.severity(_field_diffs(t), compatible=[("arm", "arm_mono")]).select("p_partkey", "scope", "field", "severity")


@query("q3_schema_report", f"{_FIELD}, j AS ({_diff_sql(False)}) SELECT scope, severity, count(*) AS findings FROM s GROUP BY ALL UNION ALL SELECT 'features', severity, CAST(sum(n) AS BIGINT) FROM j GROUP BY severity")
def _(t):
    return Q.schema_report(Q.diff_features(*_features(t)), _field_diffs(t), compatible=[("arm", "arm_mono")])


def _summary(t, hi):
    k = F.col("dataset_id")
    o = t["orders"].select((F.col("o_custkey") % 12).alias("dataset_id"), (F.col("o_custkey") % 50 + 1).alias("length"))
    g = o.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("f"))
    bump = lambda m: F.when(k % m == 1, 1).otherwise(0) if hi else F.lit(0)
    return g.select("dataset_id", F.col("n").alias("total_episodes"), (F.col("f") + bump(4)).alias("total_frames"), F.lit(30).alias("fps"), (k + bump(5)).alias("total_tasks"),
                    F.lit("288" if not hi else "720").alias("video_shape"), F.lit(4 if not hi else 1).alias("n_cameras"), (F.col("n") * (4 if not hi else 1)).alias("total_videos"), F.lit("arm").alias("robot_type"),
                    (F.col("n") + bump(3)).alias("n_parquet_files"), (F.col("n") * (4 if not hi else 1)).alias("n_video_files"))


@query("q4_compare_versions", """WITH k AS (SELECT DISTINCT o_custkey % 12 AS d FROM orders), f AS (SELECT * FROM k, (VALUES ('total_episodes'), ('total_frames'), ('fps'), ('total_tasks'), ('video_shape'), ('n_cameras'), ('total_videos'), ('robot_type'), ('lo.parquet_files'), ('lo.video_files'), ('hi.parquet_files'), ('hi.video_files')) AS x(field))
    SELECT d AS dataset_id, field, CASE WHEN field IN ('video_shape', 'n_cameras', 'total_videos', 'robot_type') THEN 'INFO' WHEN field = 'total_frames' AND d % 4 = 1 THEN 'ERROR' WHEN field = 'total_tasks' AND d % 5 = 1 THEN 'WARN' WHEN field = 'hi.parquet_files' AND d % 3 = 1 THEN 'ERROR' ELSE 'OK' END AS severity FROM f""")
def _(t):
    return Q.compare_versions(_summary(t, False), _summary(t, True)).select("dataset_id", "field", "severity")


@query("q4_compare_one_sided", """SELECT DISTINCT o_custkey % 12 AS dataset_id, CASE WHEN o_custkey % 12 = 1 THEN 'lo' ELSE 'hi' END AS side, 'ERROR' AS severity FROM orders WHERE o_custkey % 12 IN (1, 2)""")
def _(t):
    c = Q.compare_versions(_summary(t, False).where("dataset_id <> 2"), _summary(t, True).where("dataset_id <> 1")).where("field = 'dataset'")
    return c.select("dataset_id", F.coalesce("lo_value", "hi_value").alias("side"), "severity")


@query("q4_version_lengths", """WITH l AS (SELECT o_custkey % 12 AS d, o_custkey % 50 + 1 AS len FROM orders), h AS (SELECT d, CASE WHEN d = 3 THEN len + 1 ELSE len END AS len FROM l),
    c AS (SELECT d, len, sum(s) AS s FROM (SELECT d, len, 1 AS s FROM l UNION ALL SELECT d, len, -1 FROM h) GROUP BY 1, 2)
    SELECT d AS dataset_id, CAST(sum(greatest(s, 0)) AS BIGINT) AS lo_unmatched, CAST(sum(greatest(-s, 0)) AS BIGINT) AS hi_unmatched, CASE WHEN bool_and(s = 0) THEN 'OK' ELSE 'ERROR' END AS severity FROM c GROUP BY d""")
def _(t):
    lo = t["orders"].select((F.col("o_custkey") % 12).alias("dataset_id"), (F.col("o_custkey") % 50 + 1).alias("length"))
    hi = lo.withColumn("length", F.when(F.col("dataset_id") == 3, F.col("length") + 1).otherwise(F.col("length")))
    return Q.version_lengths(lo, hi)
