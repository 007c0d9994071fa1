"""Queries over frame vectors: slices, padding, normalisation, window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions import vectors as V
from kinetable.functions.hashing import lcg_gaussian, lcg_uniform
from kinetable.operators import actions as A, mixture as M, quality as Q, stats as S, windows as W
from kinetable.plans.fixtures import u_sql, view
from kinetable.plans.registry import query, r, rs

ARM = A.Slice("state", "arm1_pose", 0, 7, "emb")
GRIP = A.Slice("state", "arm1_gripper", 7, 8, "emb")
ACT_POSE = A.Slice("action", "arm1_pose", 8, 15, "emb")
ACT_GRIP = A.Slice("action", "arm1_gripper", 15, 16, "emb")
JOINTS = A.Slice("action", "joints", 16, 22, "emb")
STATE_JOINTS = A.Slice("state", "joints", 22, 28, "emb")


@query("p1_slice_modality", view("frames") + f""" SELECT vec_id, {rs('emb[1]')} AS pose_x, {rs('emb[7]')} AS pose_qw, {rs('emb[8]')} AS grip,
    7 AS pose_width FROM frames""")
def _(t):
    df = A.slice_modality(t["frames"], [ARM, GRIP])
    return df.select("vec_id", r(F.get("state_arm1_pose", F.lit(0))).alias("pose_x"), r(F.get("state_arm1_pose", F.lit(6))).alias("pose_qw"),
                     r(F.get("state_arm1_gripper", F.lit(0))).alias("grip"), F.size("state_arm1_pose").alias("pose_width"))


@query("p2_concat_keys", view("frames") + f""" SELECT vec_id, 8 AS width, {rs('emb[16]')} AS head, {rs('emb[15]')} AS last FROM frames""")
def _(t):
    df = A.slice_modality(t["frames"], [ACT_POSE, ACT_GRIP])
    order = ["action_arm1_gripper", "action_arm1_pose"]
    out = A.concat_keys(df, order, {"action_arm1_pose": 7, "action_arm1_gripper": 1}, "action", present=order)
    return out.select("vec_id", F.size("action").alias("width"), r(F.get("action", F.lit(0))).alias("head"), r(F.element_at("action", -1)).alias("last"))


@query("p3_split_keys", view("frames") + f""" SELECT vec_id, {rs('emb[9]')} AS pose_x, {rs('emb[16]')} AS grip FROM frames""")
def _(t):
    df = t["frames"].withColumn("action", V.slice_range("emb", 8, 16))
    out = A.split_keys(df, "action", {"pose": 7, "grip": 1})
    return out.select("vec_id", r(F.get("pose", F.lit(0))).alias("pose_x"), r(F.get("grip", F.lit(0))).alias("grip"))


@query("p4_pad_vector", view("frames") + """ SELECT vec_id, 44 AS width, 64 AS long_width, CAST(0 AS DOUBLE) AS filler FROM frames""")
def _(t):
    df = t["frames"].withColumn("a", V.pad_right(V.slice_range("emb", 8, 16), 44)).withColumn("b", V.pad_right("emb", 44))
    return df.select("vec_id", F.size("a").alias("width"), F.size("b").alias("long_width"), F.get("a", F.lit(8)).alias("filler"))


@query("p5_pad_to_max", view("frames") + f""" SELECT vec_id, dataset_id, 17 AS width, {rs('emb[1]')} AS head,
    CASE WHEN dataset_id = 3 THEN {rs('emb[17]')} ELSE 0 END AS tail FROM frames""")
def _(t):
    df = t["frames"].withColumn("state", F.slice("emb", F.lit(1), (F.col("dataset_id") + 14).cast("int")))
    out = M.pad_to_max(df, "state")
    return out.select("vec_id", "dataset_id", F.size("state").alias("width"), r(F.get("state", F.lit(0))).alias("head"), r(F.element_at("state", -1)).alias("tail"))


@query("p7_sincos", view("frames") + f""" SELECT vec_id, 12 AS width, {rs('sin(emb[23])')} AS s0, {rs('cos(emb[28])')} AS c5 FROM frames""")
def _(t):
    df = t["frames"].withColumn("v", V.sincos(V.slice_range("emb", 22, 28)))
    return df.select("vec_id", F.size("v").alias("width"), r(F.get("v", F.lit(0))).alias("s0"), r(F.get("v", F.lit(11))).alias("c5"))


@query("p12_dequantize", f"""SELECT p_partkey, {rs('p_size / CAST(255 AS DOUBLE) * (CAST(0.65 AS DOUBLE) - CAST(-0.75 AS DOUBLE)) + CAST(-0.75 AS DOUBLE)')} AS action_value FROM part""")
def _(t):
    return t["part"].select("p_partkey", r(V.dequantize("p_size", F.lit(-0.75), F.lit(0.65), 256)).alias("action_value"))


@query("p13_scale_vector", view("frames") + f""" SELECT vec_id, {rs('emb[1] * 20')} AS a0, {rs('emb[6] * 20')} AS a5, {rs('emb[7] * 0.5')} AS a6 FROM frames""")
def _(t):
    df = t["frames"].withColumn("a", V.scale_by(V.slice_range("emb", 0, 7), V.arm_action_scale(0.5)))
    return df.select("vec_id", *[r(F.get("a", F.lit(i))).alias(f"a{i}") for i in (0, 5, 6)])


_STATS = """stats AS (SELECT dataset_id, d AS dim, avg(emb[d + 1]) AS mean, stddev_pop(emb[d + 1]) AS std, min(emb[d + 1]) AS mn,
    max(emb[d + 1]) AS mx, quantile_cont(emb[d + 1], 0.01) AS q01, quantile_cont(emb[d + 1], 0.99) AS q99
    FROM frames, range(16, 22) AS g(d) GROUP BY dataset_id, d)"""


def _normalised(t, mode, inverse=False):
    df = A.slice_modality(t["frames"], [JOINTS])
    stats = S.stats_vectors(S.vector_stats(df, "action_joints", ["dataset_id"]), ["dataset_id"])
    joined = df.join(stats, "dataset_id")
    n = V.normalize(F.col("action_joints"), F.col("stats"), mode)
    if inverse:
        n = V.denormalize(n, F.col("stats"), mode)
    return joined.select("vec_id", F.posexplode(n).alias("dim", "v")).select("vec_id", "dim", r("v").alias("v"))


_NORM = {
    "q99": "CASE WHEN q99 = q01 THEN emb[dim + 1] ELSE 2 * ((emb[dim + 1] - q01) / (q99 - q01)) - 1 END",
    "mean_std": "CASE WHEN std = 0 THEN emb[dim + 1] ELSE (emb[dim + 1] - mean) / std END",
    "min_max": "CASE WHEN mn = mx THEN 0 ELSE 2 * ((emb[dim + 1] - mn) / (mx - mn)) - 1 END",
    "scale": "CASE WHEN greatest(abs(mn), abs(mx)) = 0 THEN 0 ELSE emb[dim + 1] / greatest(abs(mn), abs(mx)) END",
    "binary": "CASE WHEN emb[dim + 1] > 0.5 THEN 1 ELSE 0 END",
}
_NORM["q99"] = f"greatest(least({_NORM['q99']}, 1), -1)"

for _mode, _expr in _NORM.items():
    query(f"x11_normalize_{_mode}", view("frames") + f", {_STATS} SELECT vec_id, CAST(dim - 16 AS INTEGER) AS dim, {rs(_expr)} AS v "
          "FROM frames JOIN stats USING (dataset_id)")(lambda t, m=_mode: _normalised(t, m))

for _mode, _expr in {
    "q99": "greatest(least(emb[dim + 1], q99), q01)", "mean_std": "emb[dim + 1]", "min_max": "emb[dim + 1]",
    "binary": "CASE WHEN emb[dim + 1] > 0.5 THEN 1 ELSE 0 END",
}.items():
    query(f"x12_denormalize_{_mode}", view("frames") + f", {_STATS} SELECT vec_id, CAST(dim - 16 AS INTEGER) AS dim, {rs(_expr)} AS v "
          "FROM frames JOIN stats USING (dataset_id)")(lambda t, m=_mode: _normalised(t, m, True))


_DRAW = "vec_id * 64 + i"
_NORMAL = f"sqrt(-2 * ln((1 + 1000003 * {u_sql(_DRAW, 7)}) / 1000003)) * cos(2 * pi() * {u_sql(_DRAW, 7 + 7919)})"
_NOISY = f"list_transform(range(0, 4), lambda i: least(greatest(j[i + 1] + 0.05 * {_NORMAL}, list_min(j)), list_max(j)))"


@query("x13_perturb_dropout", view("frames") + f""", d AS (SELECT vec_id, list_transform(emb[{JOINTS.start + 1}:{JOINTS.end}], lambda x: CAST(x AS DOUBLE)) AS j FROM frames),
    n AS (SELECT vec_id, len(j) AS width, {u_sql('vec_id', 9)} < 0.1 AS dropped, {_NOISY} AS x FROM d)
    SELECT vec_id, width, {", ".join(f"{rs(f'CASE WHEN dropped THEN 0 ELSE x[{k + 1}] END')} AS j{k}" for k in range(4))} FROM n""")
def _(t):
    from kinetable.operators.augment import dropout, perturb

    df = A.slice_modality(t["frames"], [JOINTS])
    noisy = perturb(F.col("action_joints"), 0.05, 7, noise=lambda i: lcg_gaussian(F.col("vec_id") * 64 + i, 7))
    out = df.select("vec_id", F.size(noisy).cast("long").alias("width"), dropout(noisy, 0.1, 7, draw=lcg_uniform("vec_id", 9)).alias("j"))
    return out.select("vec_id", "width", *[r(F.get("j", F.lit(k))).alias(f"j{k}") for k in range(4)])


@query("x14_pad_tokens", """SELECT doc_id, least(len(string_split(text, ' ')), 32) AS kept, 32 AS width,
    len(string_split(text, ' ')[1]) AS first_token, CASE WHEN len(string_split(text, ' ')) >= 32 THEN len(string_split(text, ' ')[32]) ELSE 0 END AS last_token
    FROM documents""")
def _(t):
    words = F.split("text", " ")
    tokens = F.transform(words, lambda w: F.array(F.length(w).cast("double")))
    p = t["documents"].select("doc_id", V.pad_tokens(tokens, 32).alias("p"))
    return p.select("doc_id", F.aggregate("p.mask", F.lit(0), lambda s, x: s + x).cast("long").alias("kept"), F.size("p.tokens").alias("width"),
                    F.get(F.get("p.tokens", F.lit(0)), F.lit(0)).cast("long").alias("first_token"),
                    F.get(F.get("p.tokens", F.lit(31)), F.lit(0)).cast("long").alias("last_token"))


@query("x15_frame_l1", view("frames") + f""" SELECT a.vec_id, {rs('list_sum(list_transform(range(1, 65), lambda i: abs(a.emb[i] - b.emb[i]))) / 64')} AS l1
    FROM frames a JOIN frames b ON a.episode_index = b.episode_index AND b.frame_index = a.frame_index - 1 WHERE a.frame_index > 0""")
def _(t):
    f = t["frames"]
    prev = f.select("episode_index", (F.col("frame_index") + 1).alias("frame_index"), F.col("emb").alias("gen"))
    return f.where("frame_index > 0").join(prev, ["episode_index", "frame_index"]).select("vec_id", r(V.frame_l1(F.col("emb"), F.col("gen"))).alias("l1"))


@query("j3_normalize_with", view("frames") + f""", long AS (SELECT dataset_id, vec_id, k AS key, d - CASE WHEN k = 'joints' THEN 16 ELSE 28 END AS dim, emb[d + 1] AS value
      FROM frames, (VALUES ('joints', 16, 22), ('xyz', 28, 31)) AS s(k, lo, hi), range(16, 31) AS g(d) WHERE d >= lo AND d < hi),
    st AS (SELECT dataset_id, key, dim, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS mn, max(value) AS mx FROM long GROUP BY ALL)
    SELECT vec_id, key, CAST(dim AS INTEGER) AS dim, {rs("CASE WHEN key = 'joints' THEN (value - mean) / std ELSE 2 * ((value - mn) / (mx - mn)) - 1 END")} AS v
    FROM long JOIN st USING (dataset_id, key, dim)""")
def _(t):
    parts = F.inline(F.array(F.struct(F.lit("joints").alias("key"), V.slice_range("emb", 16, 22).alias("vec")),
                             F.struct(F.lit("xyz").alias("key"), V.slice_range("emb", 28, 31).alias("vec"))))
    long = S.explode_dims(t["frames"].select("dataset_id", "vec_id", parts), "vec", ["dataset_id", "vec_id", "key"])
    stats = S.value_stats(long, ["dataset_id", "key", "dim"])
    out = S.normalize_with(long, stats, {"joints": "mean_std", "xyz": "min_max"})
    return out.select("vec_id", "key", "dim", r("normalized").alias("v"))


@query("j3_normalize_pass_through", view("frames") + f""", long AS (SELECT vec_id, k AS key, d - lo AS dim, emb[d + 1] AS value
      FROM frames, (VALUES ('joints', 16, 22), ('xyz', 28, 31)) AS s(k, lo, hi), range(16, 31) AS g(d) WHERE d >= lo AND d < hi)
    SELECT vec_id, key, CAST(dim AS INTEGER) AS dim, {rs("CASE WHEN key = 'joints' THEN (value - 0.25::DOUBLE) / 2 ELSE value END")} AS v FROM long""")
def _(t):
    parts = F.inline(F.array(F.struct(F.lit("joints").alias("key"), V.slice_range("emb", 16, 22).alias("vec")),
                             F.struct(F.lit("xyz").alias("key"), V.slice_range("emb", 28, 31).alias("vec"))))
    long = S.explode_dims(t["frames"].select("dataset_id", "vec_id", parts), "vec", ["dataset_id", "vec_id", "key"])
    stats = long.where("key = 'joints'").select("dataset_id", "key", "dim").distinct().select(
        "*", F.lit(0.25).alias("mean"), F.lit(2.0).alias("std"), *[F.lit(0.0).alias(c) for c in ("min", "max", "q01", "q99")])
    return S.normalize_with(long, stats, {"joints": "mean_std"}).select("vec_id", "key", "dim", r("normalized").alias("v"))


@query("j10_identity_one_sided", view("frames") + """ SELECT vec_id, CASE WHEN vec_id % 5 = 1 THEN 'only cached' WHEN vec_id % 5 = 2 THEN 'only live' ELSE 'ok' END AS result FROM frames""")
def _(t):
    f = t["frames"].select("vec_id", "emb")
    return Q.identity_check(f.where("vec_id % 5 <> 2"), f.where("vec_id % 5 <> 1"), "vec_id", "emb").select("vec_id", "result")


@query("j10_identity_check", view("frames") + """ SELECT a.vec_id, CASE WHEN b.vec_id % 11 = 0 THEN 'shape' WHEN b.vec_id % 7 = 0 THEN 'value' ELSE 'ok' END AS result
    FROM frames a JOIN frames b USING (vec_id)""")
def _(t):
    f = t["frames"].select("vec_id", "emb")
    moved = F.when(F.col("vec_id") % 11 == 0, F.slice("emb", 1, 63)).when(
        F.col("vec_id") % 7 == 0, F.transform("emb", lambda x: x + 0.01)).otherwise(F.transform("emb", lambda x: x + 1e-6))
    return Q.identity_check(f, f.withColumn("emb", moved), "vec_id", "emb").select("vec_id", "result")


@query("o1_union_padded", view("frames", "frames_wide") + f""" SELECT 'a' AS origin, dataset_id, count(*) AS n, 44 AS width, {rs('sum(emb[1])')} AS s FROM frames GROUP BY dataset_id
    UNION ALL SELECT 'b', dataset_id, count(*), 44, {rs('sum(vec[1])', 2)} FROM frames_wide GROUP BY dataset_id""")
def _(t):
    a = t["frames"].select(F.lit("a").alias("origin"), "dataset_id", V.slice_range("emb", 0, 40).alias("v"))
    b = t["frames_wide"].select(F.lit("b").alias("origin"), "dataset_id", F.col("vec").alias("v"))
    u = M.union_padded([a, b], "v", 44)
    return u.groupBy("origin", "dataset_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), r(F.sum(F.get("v", F.lit(0)))).alias("s"))


@query("w34_sample_and_hold", view("frames") + f""", w AS (SELECT b.vec_id, g.i AS step, a.emb[16] AS v, a.emb[32] > 0 AS eng
      FROM frames b JOIN range(0, 6) AS g(i) ON true JOIN frames a ON a.episode_index = b.episode_index AND a.frame_index = least(b.frame_index + g.i * 2, 24)),
    k AS (SELECT *, max(CASE WHEN eng OR step = 0 THEN step END) OVER (PARTITION BY vec_id ORDER BY step) AS src FROM w)
    SELECT k.vec_id, CAST(k.step AS INTEGER) AS step, {rs('w.v')} AS held FROM k JOIN w ON w.vec_id = k.vec_id AND w.step = k.src""")
def _(t):
    f = t["frames"].select("dataset_id", "episode_index", "frame_index", "vec_id", F.get("emb", F.lit(15)).alias("grip"), (F.get("emb", F.lit(31)) > 0).alias("eng"))
    w = W.gather_window(f, ["grip", "eng"], [0, 2, 4, 6, 8, 10])
    return w.select("vec_id", F.posexplode(V.sample_and_hold(F.col("grip_win"), F.col("eng_win"))).alias("step", "held")).withColumn("held", r("held"))


@query("x8_zero_when_disengaged", view("frames") + f""" SELECT b.vec_id, CAST(g.i AS INTEGER) AS step, CASE WHEN a.emb[33] > 0 THEN {rs('a.emb[16]')} ELSE 0 END AS energy
    FROM frames b JOIN range(0, 4) AS g(i) ON true JOIN frames a ON a.episode_index = b.episode_index AND a.frame_index = least(b.frame_index + g.i * 3, 24)""")
def _(t):
    f = t["frames"].select("dataset_id", "episode_index", "frame_index", "vec_id", F.get("emb", F.lit(15)).alias("energy"), (F.get("emb", F.lit(32)) > 0).alias("eng"))
    w = W.gather_window(f, ["energy", "eng"], [0, 3, 6, 9])
    return w.select("vec_id", F.posexplode(V.zero_when_disengaged(F.col("energy_win"), F.col("eng_win"))).alias("step", "energy")).withColumn("energy", r("energy"))
