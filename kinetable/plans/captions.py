"""Queries over captions: keyword filter, style choice, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions.hashing import lcg_uniform
from kinetable.operators import captions as C
from kinetable.plans.fixtures import u_sql, view
from kinetable.plans.registry import query, r, rs

# Common fragments of the test corpus, so that the filter has something to find.
WORDS = ("the ", "camera pan", "zoom in", "ment ", "eaux", "tion of")


def _found(col="caption"):
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in WORDS) + ")"


_BLANK = "(caption IS NOT NULL AND regexp_matches(caption, '\\S'))"


def _flag_sql(mode):
    hit = _found() if mode == "exclude" else f"NOT {_found()}"
    return view("captions") + f", f AS (SELECT *, NOT contains(source, 'web') AS counted, NOT contains(source, 'web') AND {_BLANK} AND {hit} AS filtered FROM captions)"


@query("f11_caption_filter_exclude", _flag_sql("exclude") + " SELECT clip_id, source FROM f WHERE NOT filtered")
def _(t):
    return C.caption_filter(t["captions"], WORDS, "exclude", ["web"]).select("clip_id", "source")


@query("f11_caption_filter_include", _flag_sql("include") + " SELECT clip_id, source FROM f WHERE NOT filtered")
def _(t):
    return C.caption_filter(t["captions"], WORDS, "include", ["web"]).select("clip_id", "source")


_MOVES = " OR ".join(f"contains(lower(text), '{p}')" for p in C.CAMERA_MOVEMENT_PHRASES)


@query("f11_camera_movement_filter", f"SELECT doc_id FROM documents WHERE NOT ({_MOVES})")
def _(t):
    d = t["documents"].select(F.col("doc_id"), "source", F.col("text").alias("caption"))
    return C.caption_filter(d, C.CAMERA_MOVEMENT_PHRASES).select("doc_id")


@query("a16_filter_stats", _flag_sql("exclude") + f""" SELECT lang, count(*) FILTER (counted) AS total_samples, count(*) FILTER (filtered) AS filtered_samples, count(*) FILTER (counted) - count(*) FILTER (filtered) AS passed_samples,
    {rs('CASE WHEN count(*) FILTER (counted) > 0 THEN count(*) FILTER (filtered) * 100.0 / count(*) FILTER (counted) ELSE 0 END')} AS filter_rate_percent FROM f GROUP BY lang""")
def _(t):
    s = C.filter_stats(C.flag_captions(t["captions"], WORDS, "exclude", ["web"]), ["lang"])
    return s.withColumn("filter_rate_percent", r("filter_rate_percent"))


@query("f15_resolve_caption_window", """SELECT doc_id, CASE WHEN doc_id % 6 <= 3 THEN concat(lang, CAST(CASE WHEN doc_id % 6 = 3 THEN 2 ELSE doc_id % 6 END AS VARCHAR)) ELSE '' END AS picked, CASE WHEN doc_id % 6 > 3 THEN 'caption window missing' ELSE '' END AS reason FROM documents""")
def _(t):
    d = t["documents"].select("doc_id", F.array(*[F.concat("lang", F.lit(str(i))) for i in range(3)]).alias("windows"), (F.col("doc_id") % 6).cast("int").alias("chunk_index"))
    o = C.resolve_caption_window(d)
    return o.select("doc_id", F.coalesce("caption_window", F.lit("")).alias("picked"), F.coalesce("drop_reason", F.lit("")).alias("reason"))


_PICK = view("captions") + f""", w AS (SELECT clip_id, {u_sql('clip_id', 4)} AS u, CASE WHEN clip_id % 2 = 0 THEN 7 ELSE 0 END AS wl, CASE WHEN clip_id % 3 = 0 THEN 2 ELSE 0 END AS wm, CASE WHEN clip_id % 5 = 0 THEN 90 ELSE 0 END AS wu FROM captions),
    s AS (SELECT *, CAST(wl + wm + wu AS DOUBLE) AS tot FROM w),
    p AS (SELECT clip_id, CASE WHEN wl > 0 AND u * tot < wl THEN 'long' WHEN wm > 0 AND u * tot < wl + wm THEN 'medium' WHEN wu > 0 AND u * tot < wl + wm + wu THEN 'user' END AS style FROM s)"""


@query("w30_unsupported_style", view("captions") + """ SELECT clip_id, CASE WHEN clip_id % 4 IN (0, 2) THEN 'long' ELSE '' END AS style,
    CASE clip_id % 4 WHEN 1 THEN 'unsupported caption style' WHEN 3 THEN 'no caption style' ELSE '' END AS reason FROM captions""")
def _(t):
    i = F.col("clip_id") % 4
    some = lambda *ks: F.create_map(*[F.lit(x) for k in ks for x in (k, "text")])
    styles = F.when(i == 0, some("long")).when(i == 1, some("long", "poem")).when(i == 2, some("long", "startframe")).otherwise(some("endframe"))
    p = C.pick_caption(t["captions"].select("clip_id", styles.alias("captions")), lcg_uniform("clip_id", 4))
    return p.select("clip_id", F.coalesce("caption_style", F.lit("")).alias("style"), F.coalesce("drop_reason", F.lit("")).alias("reason"))


@query("w30_pick_caption", _PICK + """ SELECT clip_id, coalesce(style, '') AS style, CASE WHEN style IS NULL THEN 'no caption style' WHEN style = 'medium' AND clip_id % 7 = 0 THEN 'empty caption' ELSE '' END AS reason FROM p""")
def _(t):
    i = F.col("clip_id")
    styles = F.map_from_entries(F.array_compact(F.array(
        F.when(i % 2 == 0, F.struct(F.lit("long").alias("k"), F.col("caption").alias("v"))),
        F.when(i % 3 == 0, F.struct(F.lit("medium").alias("k"), F.when(i % 7 == 0, "").otherwise(F.lit("m")).alias("v"))),
        F.when(i % 5 == 0, F.struct(F.lit("user").alias("k"), F.lit("u").alias("v"))),
    )))
    p = C.pick_caption(t["captions"].select("clip_id", styles.alias("captions")), lcg_uniform("clip_id", 4))
    return p.select("clip_id", F.coalesce("caption_style", F.lit("")).alias("style"), F.coalesce("drop_reason", F.lit("")).alias("reason"))


@query("w31_pick_image_caption", f"SELECT doc_id, CASE CAST(floor({u_sql('doc_id', 6)} * 3) AS INTEGER) WHEN 0 THEN 'long' WHEN 1 THEN 'medium' ELSE 'short' END || ':' || lang AS uniform_pick, CASE WHEN doc_id % 4 = 0 THEN 'k' ELSE 'v' END AS parsed_pick FROM documents")
def _(t):
    sty = [("qwen2p5_7b_long", "long"), ("qwen2p5_7b_medium", "medium"), ("qwen2p5_7b_short", "short")]
    entries = [x for k, v in sty for x in (F.lit(k), F.concat(F.lit(v + ":"), "lang"))] + [F.lit("kosmos_2"), F.lit("k"), F.lit("vfc"), F.lit("v")]
    maps = F.create_map(*entries)
    d = t["documents"].select("doc_id", F.when(F.col("doc_id") % 2 == 0, maps).alias("captions"), F.when(F.col("doc_id") % 2 == 1, maps).alias("caption"), (F.col("doc_id") % 4 == 0).alias("had_parse_issue"))
    a = C.pick_image_caption(d, "uniform", lcg_uniform("doc_id", 6)).withColumnRenamed("picked_caption", "uniform_pick")
    b = C.pick_image_caption(a, "parsed")
    return b.select("doc_id", "uniform_pick", F.col("picked_caption").alias("parsed_pick"))


@query("p14_prefix_captions", """SELECT o_orderkey, concat(CASE o_orderstatus WHEN 'F' THEN 'Front view.' WHEN 'O' THEN 'Left view.' ELSE 'Right view.' END, ' ', CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END) AS caption FROM orders""")
def _(t):
    o = t["orders"].select("o_orderkey", F.col("o_orderstatus").alias("camera"), F.col("o_orderpriority").alias("caption"))
    return C.prefix_captions(o, {"F": "Front view.", "O": "Left view.", "P": "Right view."}, "F").select("o_orderkey", "caption")


@query("a28_captions_by_view", """SELECT o_custkey AS sample_id, o_orderstatus AS view, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN CONCAT('t', o_orderkey % 3) END, 'long') AS style, arg_max(o_orderpriority, o_orderkey) AS caption FROM orders GROUP BY 1, 2, 3""")
def _(t):
    o = t["orders"].select(F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("view"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("t"), F.col("o_orderkey") % 3)).alias("tag"), F.col("o_orderpriority").alias("caption"), "o_orderkey")
    return C.captions_by_view(o, "o_orderkey")


@query("a28_caption_maps", """WITH s AS (SELECT DISTINCT o_custkey, o_orderstatus, o_orderkey % 3 AS g FROM orders) SELECT o_custkey AS sample_id, o_orderstatus AS view, count(*) AS styles, bool_or(g = 0) AS has_long FROM s GROUP BY 1, 2""")
def _(t):
    o = t["orders"].select(F.col("o_custkey").alias("sample_id"), F.col("o_orderstatus").alias("view"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("t"), F.col("o_orderkey") % 3)).alias("tag"), F.col("o_orderpriority").alias("caption"), "o_orderkey")
    m = C.caption_maps(C.captions_by_view(o, "o_orderkey"))
    return m.select("sample_id", "view", F.size("captions").cast("long").alias("styles"), F.map_contains_key("captions", "long").alias("has_long"))


@query("q6_route_captions", """SELECT doc_id AS video_clip, doc_id % 50 AS episode_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id % 50 AND l.quality = 0) THEN 'val' ELSE 'train' END AS split FROM documents d WHERE text <> ''""")
def _(t):
    c = t["documents"].select(F.col("doc_id").alias("video_clip"), (F.col("doc_id") % 50).alias("episode_id"), F.col("text").alias("caption"))
    val = t["labels"].where("quality = 0").select(F.col("doc_id").alias("episode_id"))
    return C.route_captions(c, val).select("video_clip", "episode_id", "split")
