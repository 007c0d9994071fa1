"""Queries over frame windows, step enumeration, splits and sequence construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions.hashing import lcg_uniform
from kinetable.functions.vectors import slice_range
from kinetable.operators import actions as A, splits as P, windows as W
from kinetable.operators.ranking import int_block
from kinetable.plans.fixtures import u_sql, view
from kinetable.plans.registry import query, r, rs

_WIDE_ENDS = "ends AS (SELECT episode_index, max(frame_index) AS last FROM frames_wide GROUP BY episode_index)"


@query("w1_gather_window_edge", view("frames_wide") + f", {_WIDE_ENDS}" + f""" SELECT b.episode_index, b.frame_index,
    {rs('a0.vec[2]', 2)} AS v0, {rs('a1.vec[2]', 2)} AS v1, {rs('a2.vec[2]', 2)} AS v2, {rs('a3.vec[1]', 2)} AS q3
    FROM frames_wide b JOIN ends e USING (episode_index)
    JOIN frames_wide a0 ON a0.episode_index = b.episode_index AND a0.frame_index = greatest(b.frame_index - 2, 0)
    JOIN frames_wide a1 ON a1.episode_index = b.episode_index AND a1.frame_index = b.frame_index
    JOIN frames_wide a2 ON a2.episode_index = b.episode_index AND a2.frame_index = least(b.frame_index + 3, e.last)
    JOIN frames_wide a3 ON a3.episode_index = b.episode_index AND a3.frame_index = least(b.frame_index + 6, e.last)""")
def w1(t):
    w = W.gather_window(t["frames_wide"], ["vec"], [-2, 0, 3, 6])
    at = lambda i, k: F.get(F.get("vec_win", F.lit(i)), F.lit(k))
    return w.select("episode_index", "frame_index", r(at(0, 1), 2).alias("v0"), r(at(1, 1), 2).alias("v1"), r(at(2, 1), 2).alias("v2"), r(at(3, 0), 2).alias("q3"))


# Frames of an episode are numbered without gaps, so an offset in frames is an offset in rows.
@query("w1_gather_window_zero", view("frames_wide") + f""" SELECT episode_index, frame_index,
    {rs('coalesce(lag(vec[2], 2) OVER o, 0)', 2)} AS v0, {rs('coalesce(lead(vec[2], 3) OVER o, 0)', 2)} AS v2
    FROM frames_wide WINDOW o AS (PARTITION BY episode_index ORDER BY frame_index)""")
def _(t):
    w = W.gather_window(t["frames_wide"], ["vec"], [-2, 3], pad="zero")
    at = lambda i, k: F.get(F.get("vec_win", F.lit(i)), F.lit(k))
    return w.select("episode_index", "frame_index", r(at(0, 1), 2).alias("v0"), r(at(1, 1), 2).alias("v2"))


@query("w2_delta_grid", view("frames") + """ SELECT b.dataset_id, b.episode_index, b.frame_index, count(*) AS available
    FROM frames b JOIN range(0, 12) AS g(i) ON true JOIN frames a ON a.episode_index = b.episode_index AND a.frame_index = b.frame_index + g.i * 2
    GROUP BY ALL""")
def _(t):
    grid = W.delta_grid(13, 2)["action"]
    f = t["frames"].select("dataset_id", "episode_index", "frame_index")
    wanted = f.withColumn("at", F.explode(F.transform(F.array(*[F.lit(d) for d in grid]), lambda d: F.col("frame_index") + d)))
    have = f.select("dataset_id", "episode_index", F.col("frame_index").alias("at"))
    return wanted.join(have, ["dataset_id", "episode_index", "at"]).groupBy("dataset_id", "episode_index", "frame_index").agg(F.count(F.lit(1)).alias("available"))


@query("w3_full_windows", view("frames_wide") + """, n AS (SELECT episode_index, count(*) AS length FROM frames_wide GROUP BY episode_index)
    SELECT dataset_id, count(*) AS bases, max(frame_index) AS last_base FROM frames_wide JOIN n USING (episode_index)
    WHERE frame_index < length - 8 GROUP BY dataset_id""")
def _(t):
    f = t["frames_wide"].select("dataset_id", "episode_index", "frame_index")
    full = W.full_windows(f.join(W.episode_lengths(f), list(W.EPISODE)), [0, 4, 8])
    return full.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("bases"), F.max("frame_index").alias("last_base"))


@query("w4_enumerate_steps", view("episodes") + " SELECT dataset_id, episode_index, b.i AS base_index FROM episodes, unnest(range(0, length)) AS b(i)")
def w4(t):
    return W.enumerate_steps(t["episodes"])


@query("w4_enumerate_first_steps", view("episodes") + " SELECT dataset_id, episode_index, CAST(0 AS BIGINT) AS base_index FROM episodes")
def _(t):
    return W.enumerate_steps(t["episodes"], single=True)


@query("w5_strided_sequences", view("episodes") + """ SELECT dataset_id, episode_index, r.ratio, s.i * 2 AS start_frame, s.i * 2 + 2 * r.ratio AS end_frame
    FROM episodes, (VALUES (1), (2)) AS r(ratio), unnest(range(0, length)) AS s(i) WHERE s.i * 2 + 2 * r.ratio < length""")
def _(t):
    s = W.strided_sequences(t["episodes"], 3, [1, 2], 2)
    return s.select("dataset_id", "episode_index", "ratio", "start_frame", "end_frame")


@query("w6_chunk_chain", view("frames_wide") + """, b AS (SELECT DISTINCT dataset_id, episode_index, frame_index, frame_index // 3 AS chunk FROM frames_wide
      WHERE frame_index % 3 = 0 AND frame_index < 18 AND (episode_index + frame_index) % 5 <> 4),
    k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, episode_index ORDER BY chunk) - 1 AS rn FROM b)
    SELECT dataset_id, episode_index, CAST(chunk AS INTEGER) AS chunk, frame_index AS base_index, episode_index * 100000 + frame_index AS sample_index FROM k WHERE rn = chunk""")
def _(t):
    steps = t["frames_wide"].select(
        "dataset_id", "episode_index", F.col("frame_index").alias("base_index"),
        (F.col("episode_index") * 100000 + F.col("frame_index")).alias("sample_index"),
    ).where((F.col("episode_index") + F.col("base_index")) % 5 != 4)
    return W.chunk_chain(steps, 3, 1, 6).select("dataset_id", "episode_index", "chunk", "base_index", "sample_index")


@query("w7_index_map", """SELECT o_custkey % 7 AS dataset_id, o_custkey AS episode_index, o_orderkey AS base_index,
    CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS episode_pos FROM orders""")
def _(t):
    o = t["orders"].select((F.col("o_custkey") % 7).alias("dataset_id"), F.col("o_custkey").alias("episode_index"), F.col("o_orderkey").alias("base_index"))
    return W.index_map(o)


def _split_oracle(keep):
    return view("episodes") + f""", s AS (SELECT dataset_id, episode_index, b.i AS base_index FROM episodes, unnest(range(0, length)) AS b(i)),
    p AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY episode_index, base_index) - 1 AS pos, count(*) OVER (PARTITION BY dataset_id) AS n FROM s)
    SELECT dataset_id, episode_index, base_index FROM p WHERE {keep}"""


@query("w8_trailing_split_test", _split_oracle("pos >= n - greatest(1, CAST(floor(n * CAST(0.05 AS DOUBLE)) AS BIGINT))"))
def _(t):
    return P.trailing_split(W.enumerate_steps(t["episodes"]), 0.05, "test")


@query("w8_trailing_split_train", _split_oracle("pos < n - greatest(1, CAST(floor(n * CAST(0.05 AS DOUBLE)) AS BIGINT))"))
def _(t):
    return P.trailing_split(W.enumerate_steps(t["episodes"]), 0.05, "train")


@query("w8_trailing_split_overrides", _split_oracle("""CASE WHEN dataset_id = 0 THEN true WHEN dataset_id = 1
    THEN pos >= n - greatest(1, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)) ELSE pos < n - greatest(1, CAST(floor(n * CAST(0.05 AS DOUBLE)) AS BIGINT)) END"""))
def _(t):
    ds = F.col("dataset_id")
    ratio = F.when(ds == 1, 0.2).otherwise(0.05)
    mode = F.when(ds == 0, "full").when(ds == 1, "test").otherwise("train")
    return P.trailing_split(W.enumerate_steps(t["episodes"]), ratio, mode)


@query("w8_trailing_split_from_lengths", _split_oracle("pos >= n - greatest(1, CAST(floor(n * CAST(0.05 AS DOUBLE)) AS BIGINT))"))
def _(t):
    return P.range_steps(P.trailing_ranges(t["episodes"], 0.05, "test")).drop("length")


@query("w8_trailing_split_from_lengths_overrides", _split_oracle("""CASE WHEN dataset_id = 0 THEN true WHEN dataset_id = 1
    THEN pos >= n - greatest(1, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)) ELSE pos < n - greatest(1, CAST(floor(n * CAST(0.05 AS DOUBLE)) AS BIGINT)) END"""))
def _(t):
    ds = F.col("dataset_id")
    mode = F.when(ds == 0, "full").when(ds == 1, "test").otherwise("train")
    return P.range_steps(P.trailing_ranges(t["episodes"], F.when(ds == 1, 0.2).otherwise(0.05), mode)).drop("length")


@query("w9_shuffle_split", f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {u_sql('doc_id', 3)}, doc_id) <= floor(count(*) OVER () * CAST(0.1 AS DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM documents""")
def _(t):
    return P.shuffle_split(t["documents"].select("doc_id"), 0.1, lcg_uniform("doc_id", 3), ["doc_id"])


_RANGES = view("episodes") + """, c AS (SELECT dataset_id, count(*) AS n FROM episodes GROUP BY dataset_id HAVING count(*) >= 3),
    q AS (SELECT dataset_id, n, greatest(1, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)) AS a, greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS b FROM c),
    rg AS (SELECT dataset_id, 'train' AS split, 0 AS lo, a AS hi FROM q UNION ALL SELECT dataset_id, 'val', a, a + b FROM q UNION ALL SELECT dataset_id, 'test', a + b, n FROM q)"""


@query("w10_episode_split_ranges", _RANGES + " SELECT dataset_id, split, lo, hi, concat(lo, ':', hi) AS spec FROM rg")
def _(t):
    return P.episode_split_ranges(t["episodes"])


def _info(t):
    return P.episode_split_ranges(t["episodes"]).select("dataset_id", "split", "spec")


@query("f1_expand_split_ranges", _RANGES + " SELECT dataset_id, split, CAST(lo AS BIGINT) AS range_start, CAST(hi AS BIGINT) AS range_end FROM rg")
def _(t):
    return P.expand_split_ranges(_info(t))


@query("f1_split_indices", _RANGES + " SELECT dataset_id, split, i AS episode_index FROM rg, range(0, 1000000) AS g(i) WHERE i BETWEEN lo AND hi - 1")
def _(t):
    return P.split_indices(P.expand_split_ranges(_info(t), inclusive=False))


@query("f2_exclude_splits", _RANGES + """ SELECT e.dataset_id, e.episode_index, e.length FROM episodes e
    WHERE NOT EXISTS (SELECT 1 FROM rg WHERE rg.dataset_id = e.dataset_id AND split IN ('val', 'test') AND e.episode_index BETWEEN lo AND hi)""")
def _(t):
    return P.exclude_splits(t["episodes"], P.expand_split_ranges(_info(t)), ["VAL", "test"])


@query("f2_unknown_splits", "SELECT l_orderkey % 7 AS dataset_id, 'bad_frames' AS split FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) >= 3")
def _(t):
    return P.unknown_splits(_info(t), ["train", "bad_frames"])


_ENG = """w AS (SELECT b.vec_id, b.dataset_id, a.emb[32] > 0 AS l, a.emb[33] > 0 AS rr, a.emb[34] > -0.05 AS link FROM frames b JOIN range(0, 3) AS g(i) ON true
      JOIN frames a ON a.episode_index = b.episode_index AND a.frame_index = least(b.frame_index + g.i * 2, 24))"""


def _engagement(t):
    f = t["frames"].select("dataset_id", "episode_index", "frame_index", "vec_id", *[(F.get("emb", F.lit(i)) > lim).alias(n) for n, i, lim in (("l", 31, 0.0), ("rr", 32, 0.0), ("link", 33, -0.05))])
    return W.gather_window(f, ["l", "rr", "link"], [0, 2, 4])


@query("f3_drop_arm_swap", view("frames") + f", {_ENG} SELECT vec_id FROM w GROUP BY vec_id HAVING count(DISTINCT link) = 1")
def _(t):
    return W.drop_arm_swap(_engagement(t), ["link_win"]).select("vec_id")


@query("f4_drop_disengaged", view("frames") + f", {_ENG} SELECT vec_id FROM w GROUP BY vec_id HAVING bool_or(l) OR bool_or(rr)")
def _(t):
    return W.drop_disengaged(_engagement(t), "l_win", "rr_win").select("vec_id")


@query("o4_union_ids", "SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    a = t["lineitem"].where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return P.union_ids([a, t["orders"].where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))])


_TEST = _split_oracle("pos >= n - greatest(1, CAST(floor(n * CAST(0.05 AS DOUBLE)) AS BIGINT))")


@query("a18_test_split_listing", f"""SELECT coalesce(dataset_id, -1) AS dataset_id, count(*) AS steps, count(DISTINCT episode_index) AS episodes,
    min(episode_index) AS first_episode, max(episode_index) AS last_episode FROM ({_TEST}) GROUP BY ROLLUP (dataset_id)""")
def _(t):
    test = P.trailing_split(W.enumerate_steps(t["episodes"]), 0.05, "test")
    return P.test_split_listing(test).withColumn("dataset_id", F.coalesce("dataset_id", F.lit(-1)))


@query("a18_test_split_episodes", f"SELECT dataset_id, episode_index, count(*) AS steps FROM ({_TEST}) GROUP BY ALL")
def _(t):
    return P.test_split_episodes(P.trailing_split(W.enumerate_steps(t["episodes"]), 0.05, "test"))


@query("j1_attach_task", view("episodes") + """, f AS (SELECT o_custkey % 6 AS dataset_id, o_custkey AS episode_index, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS frame_index,
      CAST(o_orderkey % 5 AS BIGINT) AS task_index FROM orders), n AS (SELECT episode_index, count(*) AS length FROM f GROUP BY 1)
    SELECT f.episode_index, f.frame_index AS base_index, r.r_name AS task FROM f JOIN n USING (episode_index)
    JOIN f g ON g.episode_index = f.episode_index AND g.frame_index = least(f.frame_index + 3, n.length - 1) JOIN region r ON r.r_regionkey = g.task_index""")
def _(t):
    from kinetable.operators.ranking import position

    o = t["orders"].select((F.col("o_custkey") % 6).alias("dataset_id"), F.col("o_custkey").alias("episode_index"), "o_orderkey", (F.col("o_orderkey") % 5).alias("task_index"))
    f = position(o, list(W.EPISODE), ["o_orderkey"], int_block("o_orderkey", 4096), "frame_index")
    steps = f.select(*W.EPISODE, F.col("frame_index").alias("base_index")).join(W.episode_lengths(f), list(W.EPISODE))
    ds = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))
    tasks = t["region"].select(F.col("r_regionkey").cast("long").alias("task_index"), F.col("r_name").alias("task"), ds.alias("dataset_id"))
    return A.attach_task(steps, f, tasks, 3).select("episode_index", "base_index", "task")


@query("j1_missing_task", """SELECT o_orderkey AS episode_index, CASE WHEN o_orderkey % 3 = 0 THEN 'frame missing' WHEN o_orderkey % 5 IN (3, 4) THEN 'task missing' ELSE '' END AS reason,
    CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 < 3 THEN r_name ELSE '' END AS task FROM orders LEFT JOIN region ON r_regionkey = o_orderkey % 5""")
def _(t):
    o = t["orders"].select(F.lit(1).alias("dataset_id"), F.col("o_orderkey").alias("episode_index"), F.lit(0).cast("long").alias("base_index"), F.lit(1).cast("long").alias("length"))
    f = o.where("episode_index % 3 <> 0").select("dataset_id", "episode_index", F.lit(0).cast("long").alias("frame_index"), (F.col("episode_index") % 5).alias("task_index"))
    tasks = t["region"].where("r_regionkey < 3").select(F.lit(1).alias("dataset_id"), F.col("r_regionkey").cast("long").alias("task_index"), F.col("r_name").alias("task"))
    return A.attach_task(o, f, tasks).select("episode_index", F.coalesce("drop_reason", F.lit("")).alias("reason"), F.coalesce("task", F.lit("")).alias("task"))


@query("j2_attach_reference", view("frames") + f""" SELECT episode_index, frame_index AS base_index, {rs('emb[23]')} AS ref0 FROM frames WHERE frame_index % 4 = 0""")
def _(t):
    f = A.slice_modality(t["frames"], [A.Slice("state", "joints", 22, 28, "emb")])
    steps = f.where("frame_index % 4 = 0").select("dataset_id", "episode_index", F.col("frame_index").alias("base_index"))
    return A.attach_reference(steps, f, ["state_joints"]).select("episode_index", "base_index", r(F.get("state_joints", F.lit(0))).alias("ref0"))


@query("w29_stride_frames", view("frames_wide") + " SELECT episode_index, frame_index, frame_index // 4 AS image_index FROM frames_wide WHERE frame_index % 4 = 0")
def _(t):
    return W_stride(t).select("episode_index", "frame_index", "image_index")


def W_stride(t):
    from kinetable.operators.clips import stride_frames

    return stride_frames(t["frames_wide"].select("episode_index", "frame_index"), 4)
