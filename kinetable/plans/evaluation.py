"""Queries over evaluation roll-ups, rankings, QA metrics and centroid distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions.text import iteration_of
from kinetable.operators import evaluation as E
from kinetable.plans.fixtures import view
from kinetable.plans.registry import query, r, rs

EP = ["checkpoint", "episode_index"]
# Test episodes are short, so the phases shrink with them.
SHORT = {"early": (0, 2), "mid": (2, 4), "late": (4, 72)}


def _null(c):
    return F.coalesce(r(c), F.lit(-1.0)).alias(c)


def _nulls(expr):
    return f"coalesce({rs(expr)}, -1)"


@query("a10_frame_decay", view("eval_frames") + f""" SELECT checkpoint, episode_index, count(l1) AS num_frames, {rs('avg(l1)')} AS mean_l1, {rs('stddev_pop(l1)')} AS std_l1,
    CASE WHEN count(DISTINCT frame_index) < 2 THEN -1 ELSE {rs('regr_slope(l1, frame_index)', 8)} END AS l1_slope, {_nulls('avg(l1) FILTER (frame_index < 2)')} AS l1_early,
    {_nulls('avg(l1) FILTER (frame_index >= 2 AND frame_index < 4)')} AS l1_mid, {_nulls('avg(l1) FILTER (frame_index >= 4)')} AS l1_late FROM eval_frames GROUP BY checkpoint, episode_index""")
def _(t):
    d = E.frame_decay(t["eval_frames"], EP, SHORT)
    return d.select(*EP, "num_frames", r("mean_l1").alias("mean_l1"), r("std_l1").alias("std_l1"), F.coalesce(r("l1_slope", 8), F.lit(-1.0)).alias("l1_slope"), *[_null(c) for c in ("l1_early", "l1_mid", "l1_late")])


@query("a11_median_coverage", view("eval_frames") + f""" SELECT checkpoint, episode_index, {_nulls('median(gatc)')} AS gatc_score, {rs('100.0 * count(gatc) / count(*)')} AS gatc_coverage,
    {_nulls('median(gatc) FILTER (frame_index < 2)')} AS gatc_early_median, {_nulls('median(gatc) FILTER (frame_index >= 2 AND frame_index < 4)')} AS gatc_mid_median, {_nulls('median(gatc) FILTER (frame_index >= 4)')} AS gatc_late_median
    FROM eval_frames GROUP BY checkpoint, episode_index""")
def _(t):
    d = E.median_coverage(t["eval_frames"], "gatc", EP, SHORT)
    return d.select(*EP, _null("gatc_score"), r("gatc_coverage").alias("gatc_coverage"), *[_null(f"gatc_{p}_median") for p in SHORT])


_EPS = view("eval_frames") + ", ep AS (SELECT checkpoint, dataset_id, episode_index, avg(l1) AS mean_l1, avg(gatc) AS gatc, avg(tcd) AS tcd FROM eval_frames GROUP BY ALL)"


def _episodes(t):
    return t["eval_frames"].groupBy("checkpoint", "dataset_id", "episode_index").agg(F.avg("l1").alias("mean_l1"), F.avg("gatc").alias("gatc"), F.avg("tcd").alias("tcd"))


def _agg_sql(m, a):
    half = f"CASE WHEN count({m}) < 2 THEN 0 ELSE 1.96::DOUBLE * stddev_samp({m}) / sqrt(count({m})) END"
    return (f"{rs(f'avg({m})')} AS {a}_mean, {rs(f'stddev_pop({m})')} AS {a}_std, {rs(f'avg({m}) - {half}')} AS {a}_ci_lo, {rs(f'avg({m}) + {half}')} AS {a}_ci_hi")


@query("a12_aggregate_checkpoint", _EPS + f""" SELECT checkpoint, count(*) AS num_episodes, {_agg_sql('mean_l1', 'mean_l1')}, {_agg_sql('gatc', 'gatc')}, {_agg_sql('tcd', 'tcd')},
    {rs('median(gatc)')} AS gatc_median, {rs('median(tcd)')} AS tcd_median FROM ep GROUP BY checkpoint""")
def _(t):
    a = E.aggregate_checkpoint(_episodes(t), ["checkpoint"], ["mean_l1"], ["gatc", "tcd"])
    return a.select("checkpoint", "num_episodes", *[r(f"{m}_{s}").alias(f"{m}_{s}") for m in ("mean_l1", "gatc", "tcd") for s in ("mean", "std", "ci_lo", "ci_hi")],
                    r("gatc_median").alias("gatc_median"), r("tcd_median").alias("tcd_median"))


@query("a13_breakdown", _EPS + f""" SELECT checkpoint, coalesce(dataset_id, -1) AS dataset_id, count(*) AS num_episodes, {_agg_sql('mean_l1', 'mean_l1')}, {_agg_sql('tcd', 'tcd')},
    CASE WHEN grouping(dataset_id) = 1 THEN 'checkpoint' ELSE 'dataset' END AS level FROM ep GROUP BY GROUPING SETS ((checkpoint), (checkpoint, dataset_id))""")
def _(t):
    b = E.breakdown(_episodes(t), ["mean_l1", "tcd"])
    return b.select("checkpoint", F.coalesce("dataset_id", F.lit(-1)).alias("dataset_id"), "num_episodes", "level",
                    *[r(f"{m}_{s}").alias(f"{m}_{s}") for m in ("mean_l1", "tcd") for s in ("mean", "std", "ci_lo", "ci_hi")])


@query("a13_breakdown_missing_scores", _EPS + f""", m AS (SELECT * REPLACE (CASE WHEN episode_index % 3 = 0 THEN NULL ELSE tcd END AS tcd) FROM ep) SELECT checkpoint, coalesce(dataset_id, -1) AS dataset_id, count(*) AS num_episodes,
    {_nulls('avg(tcd)')} AS tcd_mean, {_nulls('stddev_pop(tcd)')} AS tcd_std FROM m GROUP BY GROUPING SETS ((checkpoint), (checkpoint, dataset_id))""")
def _(t):
    e = _episodes(t).withColumn("tcd", F.when(F.col("episode_index") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("tcd")))
    b = E.breakdown(e, ["mean_l1", "tcd"])
    return b.select("checkpoint", F.coalesce("dataset_id", F.lit(-1)).alias("dataset_id"), "num_episodes", _null("tcd_mean"), _null("tcd_std"))


@query("w37_rank_checkpoints", _EPS + """, a AS (SELECT checkpoint, avg(mean_l1) AS l1, avg(gatc) AS gatc, avg(tcd) AS tcd FROM ep GROUP BY checkpoint)
    SELECT checkpoint, 'l1' AS metric, row_number() OVER (ORDER BY l1, checkpoint) AS rank FROM a UNION ALL SELECT checkpoint, 'gatc', row_number() OVER (ORDER BY gatc DESC, checkpoint) FROM a
    UNION ALL SELECT checkpoint, 'tcd', row_number() OVER (ORDER BY tcd, checkpoint) FROM a""")
def _(t):
    a = _episodes(t).groupBy("checkpoint").agg(F.avg("mean_l1").alias("l1"), F.avg("gatc").alias("gatc"), F.avg("tcd").alias("tcd"))
    return E.rank_checkpoints(a, {"l1": "asc", "gatc": "desc", "tcd": "asc"}).select("checkpoint", "metric", "rank")


_QA = """WITH c AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    qa AS (SELECT conv_id, turn, text AS question, answer, CASE WHEN conv_id % 4 = 0 THEN '' ELSE 'en' END AS expected, conv_id % 2 AS has_kw, conv_id % 3 = 0 AS must_pass FROM c WHERE role = 'user' AND nr = 'assistant'),
    res AS (SELECT *, contains(lower(answer), 'ment') OR contains(lower(answer), 'eaux') AS kw,
      CASE WHEN expected = '' AND has_kw = 0 THEN true WHEN expected <> '' AND contains(lower(answer), expected) THEN has_kw = 0 OR contains(lower(answer), 'ment') OR contains(lower(answer), 'eaux') ELSE false END AS ok FROM qa)"""


def _answers(t):
    """Each user turn with the assistant turn after it, by equi-join on the next turn number."""
    c = t["conversations"]
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    kw = F.when(F.col("conv_id") % 2 == 1, F.array(F.lit("Ment"), F.lit("eaux"))).otherwise(F.array().cast("array<string>"))
    return user.join(reply, ["conv_id", "turn"]).select(
        "conv_id", "turn", "question", "answer", F.when(F.col("conv_id") % 4 == 0, "").otherwise("EN").alias("expected"), kw.alias("keywords"), (F.col("conv_id") % 3 == 0).alias("must_pass"))


@query("x25_check_answers", _QA + " SELECT conv_id, turn, ok AS validation_passed FROM res")
def _(t):
    return E.check_answers(_answers(t)).select("conv_id", "turn", "validation_passed")


@query("a14_qa_metrics", _QA + f""" SELECT conv_id % 5 AS run, count(*) AS total_checks, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, {rs('100.0 * count(*) FILTER (ok) / count(*)')} AS success_rate,
    count(*) FILTER (must_pass) AS must_pass_total, count(*) FILTER (must_pass AND ok) AS must_pass_passed, count(*) FILTER (must_pass AND NOT ok) AS must_pass_failed,
    100.0 * count(*) FILTER (ok) / count(*) >= 80 AND count(*) FILTER (must_pass AND NOT ok) = 0 AS meets_threshold FROM res GROUP BY 1""")
def _(t):
    m = E.qa_metrics(E.check_answers(_answers(t)).withColumn("run", F.col("conv_id") % 5), by=["run"])
    return m.withColumn("success_rate", r("success_rate"))


@query("a14_failed_must_pass", _QA + " SELECT conv_id, turn, md5(question) AS question FROM res WHERE must_pass AND NOT ok")
def _(t):
    return E.failed_must_pass(E.check_answers(_answers(t))).select("conv_id", "turn", F.md5("question").alias("question"))


@query("a15_batch_status", f"""WITH b AS (SELECT o_custkey % 10 AS grp, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failed' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'skipped' ELSE 'error' END END AS status, o_orderkey % 20 AS total_checks, o_orderkey % 20 // 2 AS passed FROM orders)
    SELECT grp, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (status = 'skipped') AS n_skipped, count(*) FILTER (status = 'error') AS n_error,
    CAST(sum(total_checks) FILTER (status IN ('success', 'failed')) AS BIGINT) AS pooled_checks, CAST(sum(passed) FILTER (status IN ('success', 'failed')) AS BIGINT) AS pooled_passed,
    {rs("100.0 * sum(passed) FILTER (status IN ('success', 'failed')) / sum(total_checks) FILTER (status IN ('success', 'failed'))")} AS pooled_rate, false AS meets_threshold FROM b GROUP BY grp""")
def _(t):
    k = F.col("o_orderkey")
    st = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").when(k % 2 == 0, "skipped").otherwise("error")
    b = t["orders"].select((F.col("o_custkey") % 10).alias("grp"), st.alias("status"), (k % 20).alias("total_checks"), F.floor(k % 20 / 2).alias("passed"))
    return E.batch_status(b, ["grp"]).withColumn("pooled_rate", r("pooled_rate"))


@query("x26_iteration_of", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size * 1000 WHEN p_partkey % 3 = 1 THEN p_size ELSE 0 END AS iteration FROM part")
def _(t):
    k = F.col("p_partkey") % 3
    label = F.when(k == 0, F.concat(F.lit("run-"), "p_size", F.lit("k"))).when(k == 1, F.concat(F.lit("model_"), "p_size", F.lit("_ema"))).otherwise(F.lit("final"))
    return t["part"].select("p_partkey", iteration_of(label).alias("iteration"))


_XY = [("a", 1), ("b", 3), ("c", 5)]


def _d(gi, hi):
    return f"sqrt((emb[{gi}] - emb[{hi}])**2 + (emb[{gi + 1}] - emb[{hi + 1}])**2)"


_G, _H = (1, 3, 5), (33, 35)
_PAIRS = [f"{_d(_G[i], _H[0])} + {_d(_G[j], _H[1])}" for i in range(3) for j in range(3) if i != j]


def _centroids(t):
    def points(starts):
        return F.array(*[F.struct(F.get("emb", F.lit(i - 1)).alias("x"), F.get("emb", F.lit(i)).alias("y")) for i in starts])

    gt = F.when(F.col("vec_id") % 13 == 0, F.slice(points(_G), 1, 0)).otherwise(points(_G))
    gen = F.when(F.col("vec_id") % 11 == 0, F.slice(points(_H), 1, 0)).otherwise(points(_H))
    return t["frames"].select("vec_id", gt.alias("gt"), gen.alias("gen"))


@query("x16_centroid_distance", view("frames") + f" SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 0.5 ELSE {rs('(least(' + ', '.join(_PAIRS) + ') + 0.5) / 3')} END AS tcd FROM frames WHERE vec_id % 13 <> 0")
def _(t):
    return E.centroid_distance(_centroids(t), "gt", "gen", 0.5).where("tcd IS NOT NULL").select("vec_id", r("tcd").alias("tcd"))


@query("j13_centroid_costs", view("frames") + f" SELECT vec_id, {rs(_d(1, 33))} AS c00, {rs(_d(1, 35))} AS c01, {rs(_d(5, 35))} AS c21 FROM frames WHERE vec_id % 13 <> 0 AND vec_id % 11 <> 0")
def _(t):
    c = _centroids(t).where("vec_id % 13 != 0 AND vec_id % 11 != 0").withColumn("c", E.centroid_costs(F.col("gt"), F.col("gen")))
    at = lambda i, j: r(F.get(F.get("c", F.lit(i)), F.lit(j)))
    return c.select("vec_id", at(0, 0).alias("c00"), at(0, 1).alias("c01"), at(2, 1).alias("c21"))
