"""Queries over clip windows, frame selection and resize plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions.hashing import lcg_uniform
from kinetable.operators import clips as C
from kinetable.plans.fixtures import u_sql, view
from kinetable.plans.registry import query, r, rs

_WIN = view("clips") + """, d AS (SELECT *, n_frames / CAST(fps AS DOUBLE) AS dur FROM clips),
    m AS (SELECT *, greatest(0, CAST(ceil((dur - 5 - 7.5::DOUBLE) / 5) AS BIGINT)) AS std FROM d),
    k AS (SELECT *, std + CASE WHEN dur - std * 5 <= 7.5::DOUBLE THEN 1 ELSE 2 END AS n_windows FROM m),
    t AS (SELECT k.*, w.i AS window_id, w.i * CAST(5 AS DOUBLE) AS st, CASE WHEN w.i = n_windows - 1 THEN dur ELSE w.i * CAST(5 AS DOUBLE) + 5 END AS en FROM k, range(0, 200) AS w(i) WHERE w.i < n_windows),
    win AS (SELECT *, CAST(floor(st * fps) AS BIGINT) AS start_frame, CAST(floor(en * fps) AS BIGINT) - 1 AS end_frame FROM t)"""


def _windows(t):
    return C.clip_windows(t["clips"])


@query("w24_clip_windows", _WIN + " SELECT clip_id, window_id, start_frame, end_frame, n_windows FROM win")
def _(t):
    return _windows(t).select("clip_id", "window_id", "start_frame", "end_frame", "n_windows")


@query("f6_filter_fps", view("clips") + " SELECT clip_id, fps FROM clips WHERE fps BETWEEN 16 AND 30")
def _(t):
    return C.filter_fps(t["clips"], 16, 30).select("clip_id", "fps")


_ELIG = _WIN + ", el AS (SELECT * FROM win WHERE (n_windows = 1 OR window_id < n_windows - 1) AND end_frame - start_frame >= CAST(4.5 AS DOUBLE) * fps)"


@query("f7_eligible_windows", _ELIG + " SELECT clip_id, window_id, start_frame, end_frame FROM el")
def _(t):
    return C.eligible_windows(_windows(t), 4.5).select("clip_id", "window_id", "start_frame", "end_frame")


@query("f7_eligible_nested_windows", view("clips") + """ SELECT clip_id, CAST(w.i AS INTEGER) AS window_id FROM clips, range(0, 3) AS w(i) WHERE w.i < clip_id % 3 + 1 AND (clip_id % 3 = 0 OR w.i < clip_id % 3)
    AND 20 * (w.i + 1) >= CAST(0.75 AS DOUBLE) * fps""")
def _(t):
    wins = F.transform(F.sequence(F.lit(0), (F.col("clip_id") % 3).cast("int")), lambda i: F.struct((i * 100).alias("start_frame"), (i * 100 + 20 * (i + 1)).alias("end_frame")))
    return C.eligible_nested(t["clips"].withColumn("windows", wins), 0.75).select("clip_id", "window_id")


_MULT = _ELIG + """, sh AS (SELECT *, CASE WHEN contains(source, 'LOW') THEN start_frame + 5 ELSE start_frame END AS s2 FROM el),
    mu AS (SELECT *, (end_frame - s2) // 29 AS multiplier FROM sh WHERE end_frame - s2 >= 29)"""


def _mult(t):
    return C.filter_multiplier(C.eligible_windows(_windows(t), 4.5), 29, [2, 3, 5], "LOW")


@query("f8_filter_multiplier", _MULT + " SELECT clip_id, window_id, s2 AS start_frame, multiplier FROM mu WHERE multiplier IN (2, 3, 5)")
def _(t):
    return _mult(t).select("clip_id", "window_id", "start_frame", "multiplier")


@query("w27_centered_span", _MULT + """ SELECT clip_id, window_id, s2 + (end_frame - s2 - 29 * multiplier) // 2 AS first_frame, s2 + (end_frame - s2 - 29 * multiplier) // 2 + 28 * multiplier AS last_frame FROM mu WHERE multiplier IN (2, 3, 5)""")
def _(t):
    return C.centered_span(_mult(t), 29).select("clip_id", "window_id", "first_frame", "last_frame")


@query("w28_interleaved_span", view("clips") + """, f AS (SELECT clip_id, i * 4 + clip_id % 10 AS f FROM clips, range(0, 16) AS g(i) UNION ALL SELECT clip_id, i * 5 + clip_id % 10 FROM clips, range(0, 13) AS g(i)),
    s AS (SELECT clip_id, list(f ORDER BY f) AS l FROM f GROUP BY clip_id) SELECT clip_id, len(l) - 2 AS n, l[2] AS head, l[-2] AS tail, CAST(list_sum(l) - l[1] - l[-1] AS BIGINT) AS total FROM s""")
def _(t):
    f = t["clips"].withColumn("f", C.interleaved_span(F.col("clip_id") % 10, 61))
    return f.select("clip_id", F.size("f").alias("n"), F.get("f", F.lit(0)).alias("head"), F.element_at("f", -1).alias("tail"), F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("f9_clip_status", view("clips") + """ SELECT clip_id, CASE WHEN n_frames - 200 <= 0 THEN 'n_video_frames must be positive' WHEN fps - 12 < 1 THEN 'Video fps lower than 1, skipping'
    WHEN n_frames - 200 < 93 THEN concat('Specified sequence_length 93 exceeds num frames in video ', n_frames - 200, '.') ELSE 'success' END AS status FROM clips""")
def _(t):
    return t["clips"].select("clip_id", C.clip_status(F.col("n_frames") - 200, F.col("fps") - 12, 93, 16, 30).alias("status"))


@query("f10_bound_duration", view("clips") + " SELECT clip_id, CASE WHEN n_frames / CAST(fps AS DOUBLE) > 8 THEN CAST(ceil(8.0 * fps) AS BIGINT) ELSE n_frames END AS frames_needed FROM clips WHERE n_frames / CAST(fps AS DOUBLE) >= 4")
def _(t):
    return C.bound_duration(t["clips"]).select("clip_id", "frames_needed")


@query("w25_sample_chunk", view("clips") + f""", c AS (SELECT *, greatest(n_frames // 256, 1) AS w FROM clips), e AS (SELECT *, w + CASE WHEN n_frames - w * 256 >= 128 AND n_frames - w * 256 > 93 THEN 1 ELSE 0 END AS n_chunks FROM c),
    x AS (SELECT *, least(CAST(floor({u_sql('clip_id', 1)} * n_chunks) AS BIGINT), n_chunks - 1) AS ci FROM e), s AS (SELECT *, CASE WHEN ci = n_chunks - 1 THEN n_frames - ci * 256 ELSE 256 END AS sz FROM x)
    SELECT clip_id, n_chunks, CASE WHEN sz < 93 THEN -1 ELSE ci END AS chunk_index, CASE WHEN sz < 93 THEN 0 ELSE sz END AS frames_in_chunk FROM s""")
def _(t):
    return C.sample_chunk(t["clips"], 93, 256, lcg_uniform("clip_id", 1)).select("clip_id", "n_chunks", "chunk_index", "frames_in_chunk")


@query("w26_choose_stride", view("clips") + f""", v AS (SELECT clip_id, fps, n_frames, s.i AS s FROM clips, range(1, 100) AS s(i) WHERE n_frames - s.i * 60 > 0 AND fps / CAST(s.i AS DOUBLE) BETWEEN 8 AND 24),
    h AS (SELECT clip_id, max(s) AS hi, min(s) AS lo FROM v GROUP BY clip_id), p AS (SELECT *, CASE WHEN hi > lo AND {u_sql('clip_id', 2)} < CAST(0.01 AS DOUBLE) THEN hi - 1 ELSE hi END AS st FROM h)
    SELECT c.clip_id, coalesce(st, -1) AS stride, coalesce(least(CAST(floor({u_sql('c.clip_id', 3)} * (n_frames - 60 * st)) AS BIGINT), n_frames - 60 * st - 1), -1) AS first_frame,
    CASE WHEN st IS NULL THEN 'no valid stride' ELSE 'success' END AS stride_status FROM clips c LEFT JOIN p USING (clip_id)""")
def _(t):
    s = C.choose_stride(t["clips"], 61, 8, 24, lcg_uniform("clip_id", 2), lcg_uniform("clip_id", 3))
    return s.select("clip_id", F.coalesce("stride", F.lit(-1)).alias("stride"), F.coalesce("first_frame", F.lit(-1)).alias("first_frame"), "stride_status")


_RATIO = "CASE p_partkey % 5 WHEN 0 THEN '1,1' WHEN 1 THEN '4,3' WHEN 2 THEN '3,4' WHEN 3 THEN '16,9' ELSE '9,16' END"


def _sized(t):
    p = t["part"]
    asp = F.get(F.array(*[F.lit(a) for a in ("1,1", "4,3", "3,4", "16,9", "9,16")]), (F.col("p_partkey") % 5).cast("int"))
    res = F.when(F.col("p_size") % 2 == 0, "720").otherwise("256")
    d = p.select("p_partkey", res.alias("resolution"), asp.alias("aspect_ratio"), (100 + F.col("p_partkey") * 37 % 2000).alias("width"), (90 + F.col("p_partkey") * 53 % 1500).alias("height"))
    return C.lookup_resolution(d)


_SIZES = """(VALUES ('720', '1,1', 960, 960), ('720', '4,3', 960, 704), ('720', '3,4', 704, 960), ('720', '16,9', 1280, 704), ('720', '9,16', 704, 1280),
    ('256', '1,1', 256, 256), ('256', '4,3', 320, 256), ('256', '3,4', 256, 320), ('256', '16,9', 320, 192), ('256', '9,16', 192, 320)) AS sz(res, asp, tw, th)"""

# Width and height for 1,1 / 4,3 / 16,9; the upright ratios are the flat ones turned.
_SHARED = """('1080', 1024, 1024, 1440, 1056, 1920, 1056), ('720', 960, 960, 960, 704, 1280, 704), ('512', 512, 512, 640, 512, 640, 384),
    ('480', 480, 480, 640, 480, 768, 432), ('480p', 640, 640, 640, 480, 832, 480), ('720robocasa', 720, 720, 960, 720, 1280, 720), ('256', 256, 256, 320, 256, 320, 192)"""
_ALL_SIZES = f"""img AS (SELECT * FROM (VALUES {_SHARED}, ('1024', 1024, 1024, 1168, 880, 1360, 768)) AS v(res, w1, h1, w4, h4, w16, h16)),
    vid AS (SELECT * FROM (VALUES {_SHARED}, ('1024', 1024, 1024, 1280, 1024, 1280, 768), ('720p', 960, 960, 960, 720, 1280, 720)) AS v(res, w1, h1, w4, h4, w16, h16)),
    p AS (SELECT p_partkey, {_RATIO} AS asp, ['1080', '1024', '720', '512', '480', '480p', '720p', '720robocasa', '256', 'none'][p_partkey // 5 % 10 + 1] AS res FROM part)
    SELECT p_partkey, CASE asp WHEN '1,1' THEN w1 WHEN '4,3' THEN w4 WHEN '3,4' THEN h4 WHEN '16,9' THEN w16 ELSE h16 END AS target_w,
    CASE asp WHEN '1,1' THEN h1 WHEN '4,3' THEN h4 WHEN '3,4' THEN w4 WHEN '16,9' THEN h16 ELSE w16 END AS target_h FROM p LEFT JOIN """


def _all_sizes(t, kind):
    asp = F.get(F.array(*[F.lit(a) for a in ("1,1", "4,3", "3,4", "16,9", "9,16")]), (F.col("p_partkey") % 5).cast("int"))
    res = F.get(F.array(*[F.lit(a) for a in ("1080", "1024", "720", "512", "480", "480p", "720p", "720robocasa", "256", "none")]), (F.floor(F.col("p_partkey") / 5) % 10).cast("int"))
    return C.lookup_resolution(t["part"].select("p_partkey", res.alias("resolution"), asp.alias("aspect_ratio")), kind).select("p_partkey", "target_w", "target_h")


query("p9_image_sizes", f"WITH {_ALL_SIZES} img USING (res)")(lambda t: _all_sizes(t, "image"))
query("p9_video_sizes", f"WITH {_ALL_SIZES} vid USING (res)")(lambda t: _all_sizes(t, "video"))


@query("p9_lookup_resolution", f"SELECT p_partkey, tw AS target_w, th AS target_h FROM part JOIN {_SIZES} ON res = CASE WHEN p_size % 2 = 0 THEN '720' ELSE '256' END AND asp = {_RATIO}")
def _(t):
    return _sized(t).select("p_partkey", "target_w", "target_h")


@query("p8_plan_resize", f"""WITH s AS (SELECT p_partkey, 100 + p_partkey * 37 % 2000 AS w, 90 + p_partkey * 53 % 1500 AS h, tw, th FROM part JOIN {_SIZES} ON res = CASE WHEN p_size % 2 = 0 THEN '720' ELSE '256' END AND asp = {_RATIO}),
    q AS (SELECT *, least(tw / CAST(w AS DOUBLE), th / CAST(h AS DOUBLE)) AS k FROM s), n AS (SELECT *, CAST(floor(k * w + 0.5::DOUBLE) AS BIGINT) AS new_w, CAST(floor(k * h + 0.5::DOUBLE) AS BIGINT) AS new_h FROM q),
    z AS (SELECT *, (tw - new_w) // 2 AS l, (th - new_h) // 2 AS tp FROM n)
    SELECT p_partkey, new_w, new_h, l AS pad_left, tp AS pad_top, tw - new_w - l AS pad_right, th - new_h - tp AS pad_bottom,
    CASE WHEN greatest(l, tw - new_w - l) >= new_w OR greatest(tp, th - new_h - tp) >= new_h THEN 'edge' ELSE 'reflect' END AS pad_mode FROM z""")
def _(t):
    return C.plan_resize(_sized(t)).select("p_partkey", "new_w", "new_h", "pad_left", "pad_top", "pad_right", "pad_bottom", "pad_mode")


@query("p10_aspect_from_path", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE concat(p_size, ',', p_partkey % 10) END AS aspect_ratio FROM part")
def _(t):
    path = F.when(F.col("p_size") % 4 == 0, F.lit("x/none/y")).otherwise(F.concat(F.lit("b/aspect_ratio_"), "p_size", F.lit("_"), F.col("p_partkey") % 10, F.lit("/w.json")))
    return t["part"].select("p_partkey", F.coalesce(C.aspect_from_path(path), F.lit("")).alias("aspect_ratio"))


@query("p11_clean_instruction", """SELECT p_partkey, trim(replace(replace(regexp_replace(regexp_replace(concat(p_partkey, '_', replace(p_name, ' ', '_'), CASE WHEN p_size % 3 = 0 THEN '_recovery' ELSE '' END, p_size), '^\\d+_*', ''), '\\d+', '', 'g'), 'recovery', ''), '_', ' ')) AS instruction,
    p_size % 3 = 0 AS is_recovery FROM part""")
def _(t):
    name = F.concat("p_partkey", F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 3 == 0, "_recovery").otherwise(""), "p_size")
    return t["part"].select("p_partkey", C.clean_instruction(name).alias("c")).select("p_partkey", "c.*")


@query("j11_align_views", """SELECT l_orderkey AS sample_id, count(*) AS views, CASE WHEN min(l_suppkey % 2) <> max(l_suppkey % 2) THEN 'frame ids differ' WHEN min(l_linenumber % 2) <> max(l_linenumber % 2) THEN 'fps differs' ELSE 'ok' END AS alignment FROM lineitem GROUP BY l_orderkey""")
def _(t):
    v = t["lineitem"].select(F.col("l_orderkey").alias("sample_id"), (F.col("l_linenumber") % 2 + 24).alias("fps"), F.array((F.col("l_suppkey") % 2), F.lit(7).cast("long")).alias("frame_ids"))
    return C.align_views(v).select("sample_id", "views", "alignment")


@query("p15_unpack_by_position", "SELECT o_orderkey, o_orderstatus AS metas_front, o_orderpriority AS metas_left FROM orders")
def _(t):
    o = t["orders"].select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("metas"))
    return C.unpack_by_position(o, "metas", {0: "front", 1: "left"})


@query("p6_merge_struct", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0")
def _(t):
    o = t["orders"].select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.struct("o_custkey", "o_orderstatus", "o_totalprice")).alias("meta"))
    return C.merge_struct(o, ["meta"], ["o_custkey", "o_orderstatus"])
