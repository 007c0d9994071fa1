"""Queries for statistics, health and drift, and the flagship statistics job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinetable.functions.hashing import lcg_uniform
from kinetable.functions.vectors import slice_range
from kinetable.operators import actions as A, quality as Q, stats as S, windows as W
from kinetable.plans.fixtures import u_sql, view
from kinetable.plans.registry import query, r, rs
from kinetable.session import staged

NUMBERS = ("mean", "std", "min", "max", "q01", "q99")


def relative_action_stats(frames: DataFrame, configs, deltas, approx: bool = False, by=("dataset_id",)) -> DataFrame:
    """The statistics job: windows, usable samples only, conversion, per-key per-dim numbers.

    One shuffle brings a block's frames together for all offsets; the rest up to the
    combinable aggregates is per row. Only full windows count, and a sample with a
    zero-norm quaternion anywhere is left out.
    """
    keys = [c.key for c in configs]
    wide = W.gather_window(frames, keys, deltas, full_only=True)
    usable = wide.where(A.usable_sample(configs))
    rel = A.convert_actions(usable, configs)
    rel = rel.select(*by, *[k + "_rel" for k in keys])
    if not approx:
        # Exact quantiles read the values twice: written once, the windows are gathered once.
        rel = staged(rel, "relative-actions")
    tagged = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k + "_rel").alias("_steps")) for k in keys]))
    rows = rel.select(*by, tagged).select(*by, "key", F.explode("_steps").alias("_vec"))
    return S.vector_stats(rows, "_vec", [*by, "key"], approx)


def _rounded(df: DataFrame, *ids: str, digits: int = 6) -> DataFrame:
    return df.select(*ids, "n", *[r(c, digits).alias(c) for c in NUMBERS])


_AGG = "count(v) AS n, " + ", ".join(
    f"{rs(e)} AS {a}" for e, a in (("avg(v)", "mean"), ("stddev_pop(v)", "std"), ("min(v)", "min"), ("max(v)", "max"),
                                   ("quantile_cont(v, 0.01)", "q01"), ("quantile_cont(v, 0.99)", "q99")))


@query("flagship_relative_action_stats", view("frames_wide") + f""", n AS (SELECT episode_index, count(*) AS length FROM frames_wide GROUP BY 1),
    x AS (SELECT b.dataset_id, k.key, k.dim, CASE WHEN k.key = 'rel' THEN a.vec[k.src] - b.vec[k.src] ELSE a.vec[k.src] END AS v
      FROM frames_wide b JOIN n USING (episode_index) JOIN range(0, 4) AS g(i) ON b.frame_index < n.length - 6
      JOIN frames_wide a ON a.episode_index = b.episode_index AND a.frame_index = b.frame_index + g.i * 2,
      (VALUES ('rel', 0, 1), ('rel', 1, 2), ('abs', 0, 3), ('abs', 1, 4)) AS k(key, dim, src))
    SELECT dataset_id, key, dim, {_AGG.replace('6)', '4)').replace('5e-07', '5e-05')} FROM x GROUP BY dataset_id, key, dim""")
def flagship(t):
    f = t["frames_wide"].select(*W.EPISODE, "frame_index", slice_range("vec", 0, 2).alias("rel"), slice_range("vec", 2, 4).alias("abs"))
    f = f.withColumn("ref", F.col("rel"))
    out = relative_action_stats(f, [A.ActionKey("rel", "relative", "ref"), A.ActionKey("abs", "absolute")], W.delta_grid(5, 2)["action"])
    return _rounded(out, "dataset_id", "key", "dim", digits=4)


@query("flagship_relative_action_stats_approx")
def _(t):
    f = t["frames_wide"].select(*W.EPISODE, "frame_index", slice_range("vec", 0, 2).alias("rel"), slice_range("vec", 2, 4).alias("abs"))
    f = f.withColumn("ref", F.col("rel"))
    out = relative_action_stats(f, [A.ActionKey("rel", "relative", "ref"), A.ActionKey("abs", "absolute")], W.delta_grid(5, 2)["action"], approx=True)
    return _rounded(out, "dataset_id", "key", "dim", digits=4)


_DIMS = view("frames") + ", x AS (SELECT dataset_id, episode_index, vec_id, d AS dim, emb[d + 1] AS v FROM frames, range(0, 64) AS g(d))"


@query("a1_vector_stats", _DIMS + f" SELECT dataset_id, CAST(dim AS INTEGER) AS dim, {_AGG} FROM x GROUP BY dataset_id, dim")
def _(t):
    return _rounded(S.vector_stats(t["frames"], "emb", ["dataset_id"]), "dataset_id", "dim")


@query("a2_raw_column_stats", view("frames") + f""", x AS (SELECT dataset_id, k AS key, d AS dim, emb[d + o] AS v FROM frames, (VALUES ('action', 9, 8), ('state', 1, 8)) AS c(k, o, w), range(0, 8) AS g(d))
    SELECT dataset_id, key, CAST(dim AS INTEGER) AS dim, {_AGG} FROM x GROUP BY ALL""")
def _(t):
    f = t["frames"].select("dataset_id", slice_range("emb", 0, 8).alias("state"), slice_range("emb", 8, 16).alias("action"))
    return _rounded(S.raw_column_stats(f, ["state", "action"], ["dataset_id"]), "dataset_id", "key", "dim")


@query("a3_episode_stats", f"""SELECT o_custkey % 7 AS dataset_id, o_custkey AS episode_index, min(o_orderkey) AS index_min, max(o_orderkey) AS index_max,
    {rs('(min(o_orderkey) + max(o_orderkey)) / CAST(2 AS DOUBLE)')} AS index_mean,
    {rs('sqrt((pow(max(o_orderkey) - min(o_orderkey) + 1, 2) - 1) / 12)', 4)} AS index_std, o_custkey % 3 AS task_value FROM orders GROUP BY o_custkey""")
def _(t):
    f = t["orders"].select((F.col("o_custkey") % 7).alias("dataset_id"), F.col("o_custkey").alias("episode_index"), F.col("o_orderkey").alias("index"), (F.col("o_custkey") % 3).alias("task_index"))
    e = S.episode_stats(f)
    return e.select("dataset_id", "episode_index", "index_min", "index_max", r("index_mean").alias("index_mean"), r("index_std", 4).alias("index_std"), "task_value")


@query("a4_describe_vectors", _DIMS + f""" SELECT coalesce(CAST(dim AS INTEGER), -1) AS dim, count(v) AS n, {rs('avg(v)')} AS mean, {rs('stddev_pop(v)')} AS std, {rs('min(v)')} AS min, {rs('max(v)')} AS max,
    {rs('quantile_cont(v, 0.01)')} AS q01, {rs('quantile_cont(v, 0.05)')} AS q05, {rs('quantile_cont(v, 0.5)')} AS q50, {rs('quantile_cont(v, 0.95)')} AS q95, {rs('quantile_cont(v, 0.99)')} AS q99
    FROM x GROUP BY ROLLUP (dim)""")
def _(t):
    d = S.describe_vectors(t["frames"], "emb")
    return d.select("dim", "n", *[r(c).alias(c) for c in ("mean", "std", "min", "max", "q01", "q05", "q50", "q95", "q99")])


_PADDED = view("frames") + ", x AS (SELECT d AS dim, CASE WHEN d < 8 THEN emb[d + 1] * 12 WHEN d < 12 THEN emb[d + 1] * 60 ELSE 0 END AS v FROM frames, range(0, 16) AS g(d))"


def _padded(t):
    return t["frames"].select(F.concat(F.transform(slice_range("emb", 0, 8), lambda x: x * 12), F.transform(slice_range("emb", 8, 12), lambda x: x * 60), F.array_repeat(F.lit(0.0), 4)).alias("v"))


@query("a5_active_dims", _PADDED + " SELECT CAST(dim AS INTEGER) AS dim, CASE WHEN stddev_pop(v) > 1e-6 THEN 'active' ELSE 'padded' END AS status FROM x GROUP BY dim")
def _(t):
    return S.active_dims(S.vector_stats(_padded(t), "v", [], probs={})).select("dim", "status")


@query("a6_dim_health", _PADDED + f""", g AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS s, avg(CASE WHEN abs(v) > 10 THEN 1.0 ELSE 0.0 END) * 100 AS o, min(v) AS mn, max(v) AS mx, quantile_cont(v, 0.01) AS q1, quantile_cont(v, 0.99) AS q9 FROM x GROUP BY dim)
    SELECT CAST(dim AS INTEGER) AS dim, {rs('m')} AS mean, {rs('s')} AS std, {rs('mn')} AS min, {rs('mx')} AS max, {rs('q1')} AS q01, {rs('q9')} AS q99, {rs('CASE WHEN s > 1e-6 THEN o ELSE 0 END')} AS outlier_pct,
    CASE WHEN s <= 1e-6 THEN 'padded' WHEN abs(m) < 1 AND s > 0.1 AND s < 5 AND o <= 0.5 THEN 'OK' ELSE concat('WARN: ', concat_ws('; ',
      CASE WHEN abs(m) >= 1 THEN '|mean|>1.0' END, CASE WHEN s <= 0.1 OR s >= 5 THEN 'std<0.1 or >5.0' END, CASE WHEN o > 0.5 THEN printf('%.1f%% outliers', o) END)) END AS status FROM g""")
def _(t):
    h = S.dim_health(_padded(t), "v")
    return h.select("dim", *[r(c).alias(c) for c in ("mean", "std", "min", "max", "q01", "q99")], r("outlier_pct").alias("outlier_pct"), "status")


@query("a7_subset_share", _DIMS + f""", s AS (SELECT CASE WHEN dataset_id = 3 THEN '<unknown>' ELSE CAST(dataset_id AS VARCHAR) END AS subset, vec_id, v FROM x)
    SELECT subset, count(DISTINCT vec_id) AS samples, {rs('100.0 * count(DISTINCT vec_id) / (SELECT count(*) FROM frames)')} AS pct, {rs('avg(v)')} AS mean, {rs('stddev_pop(v)')} AS std FROM s GROUP BY subset""")
def _(t):
    f = t["frames"].withColumn("subset", F.when(F.col("dataset_id") != 3, F.col("dataset_id")))
    return S.subset_share(f, "subset", "emb").select("subset", "samples", r("pct").alias("pct"), r("mean").alias("mean"), r("std").alias("std"))


@query("a7_subset_share_large_mean", _DIMS + f""", s AS (SELECT dataset_id % 2 AS subset, vec_id, CAST(round(v * 8) AS DOUBLE) AS v FROM x)
    SELECT CAST(subset AS VARCHAR) AS subset, count(DISTINCT vec_id) AS samples, {rs('stddev_pop(v)', 3)} AS std FROM s GROUP BY subset""")
def _(t):
    f = t["frames"].select((F.col("dataset_id") % 2).alias("subset"), F.transform("emb", lambda v: F.round(v.cast("double") * 8) + 1e8).alias("v"))
    return S.subset_share(f, "subset", "v").select("subset", "samples", r("std", 3).alias("std"))


def _drift_sql(limit):
    return view("frames") + f""", x AS (SELECT dataset_id % 2 AS side, d AS dim, emb[d + 1] AS v FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id % 2 ORDER BY vec_id) AS rn FROM frames), range(0, 64) AS g(d) {limit}),
    m AS (SELECT dim, avg(v) FILTER (side = 0) AS ma, avg(v) FILTER (side = 1) AS mb, stddev_pop(v) FILTER (side = 0) AS sa, stddev_pop(v) FILTER (side = 1) AS sb, count(v) FILTER (side = 0) AS na, count(v) FILTER (side = 1) AS nb FROM x GROUP BY dim),
    d AS (SELECT *, abs(ma - mb) AS md, abs(sa - sb) AS sd FROM m)
    SELECT max(na) AS n_a, max(nb) AS n_b, {rs('max(md)')} AS max_mean_diff, CAST(arg_max(dim, md) AS INTEGER) AS max_mean_dim, {rs('max(sd)')} AS max_std_diff, CAST(arg_max(dim, sd) AS INTEGER) AS max_std_dim,
    {rs('avg(md)')} AS avg_mean_diff, {rs('avg(sd)')} AS avg_std_diff, CASE WHEN max(md) < 0.05 AND max(sd) < 0.05 THEN 'OK' ELSE 'WARN' END AS status FROM d"""


def _drift(t, matched):
    f = t["frames"]
    d = S.compare_distributions(f.where("dataset_id % 2 = 0"), f.where("dataset_id % 2 = 1"), "emb", "vec_id", matched)
    return d.select("n_a", "n_b", r("max_mean_diff").alias("max_mean_diff"), "max_mean_dim", r("max_std_diff").alias("max_std_diff"), "max_std_dim",
                    r("avg_mean_diff").alias("avg_mean_diff"), r("avg_std_diff").alias("avg_std_diff"), "status")


query("a8_compare_distributions", _drift_sql(""))(lambda t: _drift(t, False))
query("a8_compare_distributions_matched", _drift_sql("WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM frames GROUP BY dataset_id % 2))"))(lambda t: _drift(t, True))


@query("a8_dim_drift", view("frames") + f""", x AS (SELECT dataset_id % 2 AS side, d AS dim, emb[d + 1] AS v FROM frames, range(0, 64) AS g(d))
    SELECT CAST(dim AS INTEGER) AS dim, {rs('abs(avg(v) FILTER (side = 0) - avg(v) FILTER (side = 1))')} AS mean_diff, {rs('abs(stddev_pop(v) FILTER (side = 0) - stddev_pop(v) FILTER (side = 1))')} AS std_diff FROM x GROUP BY dim""")
def _(t):
    f = t["frames"]
    d = S.dim_drift(f.where("dataset_id % 2 = 0"), f.where("dataset_id % 2 = 1"), "emb")
    return d.select("dim", r("mean_diff").alias("mean_diff"), r("std_diff").alias("std_diff"))


@query("a8_unmatched_dims", view("frames") + """ SELECT 64 - 60 AS unmatched_dims, count(*) FILTER (dataset_id % 2 = 0) AS n_a, 'WARN' AS status FROM frames""")
def _(t):
    f = t["frames"]
    short = f.where("dataset_id % 2 = 1").withColumn("emb", F.slice("emb", 1, 60))
    d = S.compare_distributions(f.where("dataset_id % 2 = 0"), short, "emb", "vec_id", tol=1e9)
    return d.select(F.col("unmatched_dims").cast("int").alias("unmatched_dims"), "n_a", "status")


@query("a9_health_verdict", _DIMS + """, c AS (SELECT dataset_id, dim, stddev_pop(v) > 0.08 AND abs(avg(v)) < 0.05 AS passed FROM x GROUP BY ALL)
    SELECT dataset_id, count(*) AS checks, count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS healthy FROM c GROUP BY dataset_id""")
def _(t):
    s = S.vector_stats(t["frames"], "emb", ["dataset_id"], probs={})
    checks = s.withColumn("passed", (F.col("std") > 0.08) & (F.abs("mean") < 0.05))
    return S.health_verdict(checks, ["dataset_id"])


@query("a27_sampled_action_stats", view("frames") + f""", e AS (SELECT DISTINCT dataset_id, episode_index FROM frames), p AS (SELECT * FROM e ORDER BY {u_sql('episode_index', 5)}, dataset_id, episode_index LIMIT 10)
    SELECT CAST(d AS INTEGER) AS dim, {rs('avg(emb[d + 1])')} AS mean, {rs('greatest(stddev_pop(emb[d + 1]), 1e-6)')} AS std FROM frames SEMI JOIN p USING (dataset_id, episode_index), range(0, 64) AS g(d) WHERE frame_index % 12 = 0 GROUP BY d""")
def _(t):
    f = t["frames"]
    steps = f.where("frame_index % 12 = 0").select("dataset_id", "episode_index", F.col("frame_index").alias("base_index"))
    s = S.sampled_action_stats(steps, f, "emb", 10, lcg_uniform("episode_index", 5), ["dataset_id", "episode_index"])
    return s.select("dim", r("mean").alias("mean"), r("std").alias("std"))


_STEPS, _EIGHT = 3, range(1, 9)
_FAR = " + ".join(f"(p.v[{d}] - c.v[{d}]) * (p.v[{d}] - c.v[{d}])" for d in _EIGHT)


def _lloyd(step: int) -> str:
    """One step in SQL: the nearest centroid of each vector, then the means."""
    means = ", ".join(f"avg(v[{d}])" for d in _EIGHT)
    return f"""a{step} AS (SELECT vec_id, p_v AS v, cluster FROM (SELECT vec_id, p.v AS p_v, c.cluster, row_number() OVER (PARTITION BY vec_id ORDER BY {_FAR}, c.cluster) AS rn
      FROM p CROSS JOIN c{step} c) WHERE rn = 1), c{step + 1} AS (SELECT cluster, [{means}] AS v FROM a{step} GROUP BY cluster)"""


@query("a26_frequent_patterns", view("frames") + f""", p AS (SELECT vec_id, list_transform(emb[9:16], lambda x: CAST(x AS DOUBLE)) AS v, {u_sql('vec_id', 3)} AS u FROM frames),
    f AS (SELECT v, min(u) AS u FROM p GROUP BY v), c0 AS (SELECT row_number() OVER (ORDER BY u, v) - 1 AS cluster, v FROM (SELECT * FROM f ORDER BY u, v LIMIT 10)),
    {", ".join(_lloyd(i) for i in range(_STEPS + 1))}
    SELECT a.cluster, count(*) AS size, {rs('count(*) / (SELECT count(*) FROM p)')} AS share, {", ".join(f"{rs(f'any_value(c.v[{d}])')} AS c{d}" for d in _EIGHT)}
    FROM a{_STEPS} a JOIN c{_STEPS} c ON a.cluster = c.cluster GROUP BY a.cluster ORDER BY size DESC, a.cluster LIMIT 3""")
def _(t):
    vectors = t["frames"].select(slice_range("emb", 8, 16).alias("v"), "vec_id")
    p = S.frequent_patterns(vectors, "v", lcg_uniform("vec_id", 3), iters=_STEPS)
    return p.select(F.col("cluster").cast("long").alias("cluster"), "size", r("share").alias("share"), *[r(F.get("centroid", F.lit(d - 1))).alias(f"c{d}") for d in _EIGHT])


_PER_KEY = "avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.01) AS q01, quantile_cont(v, 0.99) AS q99"


@query("j4_resolve_stats", view("frames") + f""", m AS (SELECT ds AS dataset_id, k AS key, src, lo, hi FROM range(0, 4) AS g(ds), (VALUES ('pose', 'emb', 8, 11), ('joints', 'emb', 16, 19), ('ghost', 'absent', 0, 1)) AS x(k, src, lo, hi)),
    g AS (SELECT dataset_id, d AS dim, avg(emb[d + 1]) AS mean, max(emb[d + 1]) AS max FROM frames, range(0, 64) AS q(d) GROUP BY ALL)
    SELECT m.dataset_id, m.key, CAST(g.dim - m.lo AS INTEGER) AS dim, CASE WHEN m.key = 'pose' AND m.dataset_id % 2 = 0 THEN 'per_key' ELSE 'index_based' END AS origin,
      {rs("CASE WHEN m.key = 'pose' AND m.dataset_id % 2 = 0 THEN mean * 2 ELSE mean END")} AS mean, {rs("CASE WHEN m.key = 'pose' AND m.dataset_id % 2 = 0 THEN max * 2 ELSE max END")} AS max
    FROM m JOIN g ON m.dataset_id = g.dataset_id AND g.dim >= m.lo AND g.dim < m.hi WHERE m.src = 'emb'
    UNION ALL SELECT dataset_id, key, 0, 'skipped', -1, -1 FROM m WHERE src = 'absent'""")
def _(t):
    f = t["frames"]
    keys = F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(s).alias("original_key"), F.lit(a).alias("start"), F.lit(b).alias("end"))
                              for k, s, a, b in (("pose", "emb", 8, 11), ("joints", "emb", 16, 19), ("ghost", "absent", 0, 1))]))
    modality = f.select("dataset_id").distinct().select("dataset_id", keys)
    glob = S.raw_column_stats(f, ["emb"], ["dataset_id"])
    own = f.where("dataset_id % 2 = 0").select("dataset_id", F.transform(slice_range("emb", 8, 11), lambda x: x * 2).alias("pose"))
    per_key = S.raw_column_stats(own, ["pose"], ["dataset_id"])
    out = S.resolve_stats(modality, per_key, glob)
    return out.select("dataset_id", "key", "dim", "origin", F.coalesce(r("mean"), F.lit(-1.0)).alias("mean"), F.coalesce(r("max"), F.lit(-1.0)).alias("max"))


@query("t3_merge_partials", _DIMS + f""" SELECT dataset_id, CAST(dim AS INTEGER) AS dim, count(v) AS n, {rs('avg(v)')} AS mean, {rs('stddev_pop(v)')} AS std, {rs('min(v)')} AS min, {rs('max(v)')} AS max FROM x GROUP BY dataset_id, dim""")
def _(t):
    long = S.explode_dims(t["frames"], "emb", ["dataset_id", "episode_index"])
    parts = S.partial_stats(long, ["dataset_id", "dim", "episode_index"])
    m = S.merge_partials(parts.drop("episode_index"), ["dataset_id", "dim"])
    return m.select("dataset_id", "dim", "n", *[r(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("q5_stats_guard", """SELECT p_partkey, p_type AS embodiment, CASE WHEN p_partkey % 7 = 0 THEN 'warning' WHEN s.stride IS NOT NULL AND p_size % 5 + 1 <> s.stride THEN 'error' ELSE 'ok' END AS guard
    FROM part LEFT JOIN (SELECT p_type AS emb, max(p_size) % 5 + 1 AS stride FROM part WHERE p_type <> 'PROMO' GROUP BY p_type) s ON s.emb = p_type""")
def _(t):
    p = t["part"]
    stats = p.select("p_partkey", F.col("p_type").alias("embodiment"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") % 5 + 1).alias("timestep_interval"))
    registry = p.where("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("embodiment")).agg((F.max("p_size") % 5 + 1).alias("stride"))
    return Q.stats_guard(stats, registry).select("p_partkey", "embodiment", "guard")
