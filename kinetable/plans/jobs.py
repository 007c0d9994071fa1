"""Whole jobs composed from operators: mixture samples, clip selection, evaluation report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinetable.functions.hashing import lcg
from kinetable.operators import actions as A, captions as K, clips as C, evaluation as E, mixture as M, splits as P, windows as W
from kinetable.operators.ranking import int_block, running_sum
from kinetable.plans.captions import WORDS, _BLANK, _found
from kinetable.plans.clips import _MULT
from kinetable.plans.fixtures import lcg_sql, view
from kinetable.plans.registry import query, r, rs
from kinetable.plans.rotations import _Q, _REL, _STEPS, _poses
from kinetable.plans.statistics import relative_action_stats
from kinetable.session import scratch_path, staged
from kinetable.sources import lake as L


def mixture_samples(
    episodes: DataFrame, ratios: DataFrame, idx: DataFrame, split: str = "train", holdout: float = 0.05, index: str = "idx",
) -> DataFrame:
    """Virtual sample index to ``(dataset_id, episode_index, base_index)``.

    ``episodes(dataset_id, episode_index, length)``, ``ratios(dataset_id, mix_ratio)``.
    A real index is a step number within its dataset's split. Episode offsets turn the
    lookup into a range join, so steps are never enumerated.
    """
    kept = P.trailing_ranges(episodes, holdout, split)
    kept = kept.withColumn("_k", F.col("last_base") - F.col("first_base") + 1)
    placed = running_sum(kept, F.col("_k"), ["dataset_id"], ["episode_index"], int_block("episode_index"), "_from")
    # Episode- and dataset-level tables are used several times below; stage them once.
    placed = staged(placed, "episode-offsets")
    sizes = placed.groupBy("dataset_id").agg(F.sum("_k").alias("real_len"))
    mix = staged(M.repeat_factors(ratios.join(sizes, "dataset_id")), "mixture")
    real = M.virtual_to_real(idx, mix, index).select(index, "dataset_id", "real_index")
    spans = placed.select("dataset_id", "episode_index", "first_base", "_from", (F.col("_from") + F.col("_k")).alias("_to"))
    hit = M.locate(real, spans, "real_index", "_from", "_to", by=["dataset_id"])
    base = F.col("first_base") + F.col("real_index") - F.col("_from")
    return hit.select(index, "dataset_id", "episode_index", base.alias("base_index"))


def clip_selection(
    clips: DataFrame, captions: DataFrame, num_frames: int, draw: Column, keywords: Sequence[str], exempt: Sequence[str] = (),
    fps: tuple[float, float] = (16, 60), min_duration: float = 4.5, multipliers: Sequence[int] = (2, 3, 5),
    shifted_source: str | None = None,
) -> DataFrame:
    """One window per clip with its frames, for clips whose caption passes the filter.

    Clips are filtered and windowed row by row; the caption join and the choice of one
    window per clip share the clip id, and captions are filtered before the join.
    """
    windows = C.eligible_windows(C.clip_windows(C.filter_fps(clips, *fps)), min_duration)
    spans = C.centered_span(C.filter_multiplier(windows, num_frames, multipliers, shifted_source), num_frames)
    best = spans.groupBy("clip_id").agg(
        F.min_by(F.struct("window_id", "multiplier", "first_frame", "last_frame"), F.struct(draw, "window_id")).alias("w")
    )
    kept = K.caption_filter(captions, keywords, "exclude", exempt)
    return best.select("clip_id", "w.*").join(kept, "clip_id", "inner")


def evaluation_report(frames: DataFrame, phases: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Frame scores (l1, ssim, gatc, tcd) to one ranked row per checkpoint, all numbers of its history included."""
    phases = E.PHASES if phases is None else phases
    agg = staged(E.checkpoint_scores(E.episode_scores(frames, ["checkpoint", "episode_index"], phases), phases=tuple(phases)), "checkpoint-scores")
    named = {"mean_l1": "mean_l1", "gatc": "gatc_score", "tcd": "tcd_score"}
    ranks = E.rank_checkpoints(agg, {"mean_l1_mean": "asc", "gatc_score_mean": "desc", "tcd_score_mean": "asc"})
    wide = ranks.groupBy("checkpoint").agg(
        *[F.max(F.when(F.col("metric") == f"{c}_mean", F.col("rank"))).alias(f"{m}_rank") for m, c in named.items()]
    )
    return agg.join(wide, "checkpoint", "left")


@query("job_mixture_samples", view("episodes") + """, s AS (SELECT dataset_id, episode_index, b.i AS base_index FROM episodes, unnest(range(0, length)) AS b(i)),
    p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY dataset_id) AS n FROM s WINDOW w AS (PARTITION BY dataset_id ORDER BY episode_index, base_index)),
    k AS (SELECT * FROM p WHERE pos < n - greatest(1, CAST(floor(n * CAST(0.05 AS DOUBLE)) AS BIGINT))),
    d AS (SELECT dataset_id, count(*) AS real_len, CAST(1 + dataset_id % 3 AS DOUBLE) / count(*) AS wt FROM k GROUP BY dataset_id),
    m AS (SELECT *, CAST(greatest(1, round_even(wt / (SELECT min(wt) FROM d), 0)) AS BIGINT) * real_len AS vl FROM d),
    v AS (SELECT *, CAST(sum(vl) OVER (ORDER BY dataset_id) - vl AS BIGINT) AS vs FROM m),
    i AS (SELECT o_orderkey * 11 AS idx, (o_orderkey * 11) % (SELECT CAST(sum(vl) AS BIGINT) FROM m) AS q FROM orders)
    SELECT idx, v.dataset_id, k.episode_index, k.base_index FROM i JOIN v ON q >= vs AND q < vs + vl JOIN k ON k.dataset_id = v.dataset_id AND k.pos = (q - vs) % real_len""")
def _(t):
    eps = t["episodes"]
    ratios = eps.select("dataset_id").distinct().withColumn("mix_ratio", (1 + F.col("dataset_id") % 3).cast("double"))
    return mixture_samples(eps, ratios, t["orders"].select((F.col("o_orderkey") * 11).alias("idx")))


@query("job_clip_selection", _MULT.replace("FROM orders)", "FROM orders WHERE 10 + o_custkey % 51 BETWEEN 16 AND 60)", 1) + f""", c AS (SELECT doc_id AS clip_id, text AS caption, source FROM documents),
    okc AS (SELECT clip_id FROM c WHERE contains(source, 'web') OR NOT ({_BLANK} AND {_found()})),
    pick AS (SELECT clip_id, window_id, multiplier, s2, end_frame, row_number() OVER (PARTITION BY clip_id ORDER BY {lcg_sql('clip_id * 97 + window_id')}, window_id) AS rn FROM mu WHERE multiplier IN (2, 3, 5))
    SELECT clip_id, window_id, multiplier, s2 + (end_frame - s2 - 29 * multiplier) // 2 AS first_frame FROM pick JOIN okc USING (clip_id) WHERE rn = 1""")
def _(t):
    caps = t["captions"].select("clip_id", "source", "caption")
    s = clip_selection(t["clips"], caps, 29, lcg(F.col("clip_id") * 97 + F.col("window_id")), WORDS, ["web"], shifted_source="LOW")
    return s.select("clip_id", "window_id", "multiplier", "first_frame")


@query("job_evaluation_report", view("eval_frames") + f""", ep AS (SELECT checkpoint, episode_index, avg(l1) AS l1, median(gatc) AS gatc, median(tcd) AS tcd FROM eval_frames GROUP BY ALL),
    a AS (SELECT checkpoint, count(*) AS n, avg(l1) AS l1, avg(gatc) AS gatc, median(gatc) AS gm, avg(tcd) AS tcd FROM ep GROUP BY 1)
    SELECT checkpoint, n AS num_episodes, {rs('l1')} AS mean_l1_mean, {rs('gm')} AS gatc_median, row_number() OVER (ORDER BY l1, checkpoint) AS mean_l1_rank,
    row_number() OVER (ORDER BY gatc DESC, checkpoint) AS gatc_rank, row_number() OVER (ORDER BY tcd, checkpoint) AS tcd_rank FROM a""")
def _(t):
    e = evaluation_report(t["eval_frames"].withColumn("ssim", 1 - F.col("l1")))
    return e.select("checkpoint", "num_episodes", r("mean_l1_mean").alias("mean_l1_mean"), r("gatc_score_median").alias("gatc_median"), "mean_l1_rank", "gatc_rank", "tcd_rank")


_PARTS = {"early": (0, 2), "mid": (2, 4), "late": (4, 100)}


def _history_sql() -> str:
    inside = {p: f"FILTER (frame_index >= {a} AND frame_index < {b})" for p, (a, b) in _PARTS.items()}
    episode = ["avg(l1) AS l1", "avg(1 - l1) AS ssim", "CASE WHEN count(DISTINCT frame_index) > 1 THEN regr_slope(l1, frame_index) END AS slope"]
    rows = ["avg(l1) AS fds_l1_mean", "avg(ssim) AS fds_ssim_mean", "avg(slope) AS fds_l1_slope_mean"]
    episode += [f"avg(l1) {w} AS l1_{p}" for p, w in inside.items()]
    rows += [f"avg(l1_{p}) AS fds_l1_{p}" for p in inside]
    for m, unit in (("gatc", ""), ("tcd", "_px")):
        episode += [f"median({m}) AS {m}", f"100.0 * count({m}) / count(*) AS {m}_cov", *[f"median({m}) {w} AS {m}_{p}" for p, w in inside.items()]]
        rows += [f"median({m}) AS {m}_median{unit}", f"avg({m}_cov) AS {m}_coverage_pct", *[f"median({m}_{p}) AS {m}_{p}_median{unit}" for p in inside]]
    names = [x.rsplit(" AS ", 1)[1] for x in rows]
    return (f", ep AS (SELECT checkpoint, episode_index, {', '.join(episode)} FROM eval_frames GROUP BY ALL), a AS (SELECT checkpoint, {', '.join(rows)} FROM ep GROUP BY 1)"
            f" SELECT checkpoint AS timestamp, CAST(1000 AS BIGINT) AS iteration, {', '.join(f'{rs(n, 5)} AS {n}' for n in names)} FROM a")


@query("job_checkpoint_history", view("eval_frames") + _history_sql())
def _(t):
    scores = evaluation_report(t["eval_frames"].withColumn("ssim", 1 - F.col("l1")), _PARTS)
    history = E.metric_history(scores.withColumn("iteration", F.lit(1000)), {**E.history_mapping(tuple(_PARTS)), "timestamp": "checkpoint"})
    return history.select("timestamp", "iteration", *[r(c, 5).alias(c) for c in history.columns if c not in ("timestamp", "iteration")])


def action_statistics_job(
    spark, root: str, out: str, slices: Sequence[A.Slice], keys: Sequence[A.ActionKey], deltas: Sequence[int],
    ranges: DataFrame | None = None, excluded: Sequence[str] = (), stride: int | None = None,
) -> None:
    """From a lake to its statistics files: scan, episode exclusion, slicing, windows, relative poses, numbers, sink.

    ``ranges(dataset_id, split, range_start, range_end)`` are the parsed splits; episodes of ``excluded`` ones are left out.
    """
    roots = [x.dataset_path for x in L.discover(L.list_files(spark, root), root).select("dataset_path").collect()]
    frames = L.read_frames(spark, roots)
    if ranges is not None:
        frames = P.exclude_splits(frames, ranges, excluded)
    sliced = A.slice_modality(frames, slices)
    L.write_stats(relative_action_stats(sliced, keys, deltas), out, ["dataset_id"], stride)


_MOVES = ", ".join([f"a.emb[{9 + i}] - b.emb[{1 + i}] AS o{i}" for i in range(3)] + [f"{e} AS o{i + 3}" for i, e in enumerate(_REL)])


@query("job_action_statistics", view("frames") + f""", {_Q}, bad AS (SELECT b.vec_id{_STEPS} GROUP BY b.vec_id HAVING bool_or(a.vec_id % 37 = 0)),
    h AS (SELECT b.dataset_id, {_MOVES}{_STEPS} WHERE b.frame_index < 25 - 6 AND b.vec_id NOT IN (SELECT vec_id FROM bad) AND NOT (b.dataset_id = 0 AND b.episode_index <= 5)),
    v AS (SELECT dataset_id, d, [{", ".join(f"o{i}" for i in range(9))}][d + 1] AS v FROM h, range(0, 9) AS g(d))
    SELECT dataset_id, d AS dim, CAST(3 AS BIGINT) AS stride, {rs('avg(v)', 4)} AS mean, {rs('stddev_pop(v)', 4)} AS std, {rs('min(v)', 4)} AS min, {rs('max(v)', 4)} AS max,
    {rs('quantile_cont(v, 0.01)', 4)} AS q01, {rs('quantile_cont(v, 0.99)', 4)} AS q99 FROM v GROUP BY dataset_id, d""")
def _(t):
    root, out = scratch_path(t.spark, "job-lake"), scratch_path(t.spark, "job-stats")
    poses = _poses(t)
    L.write_lake(poses.select(*W.EPISODE, "frame_index", F.concat("state_pose", "action_pose").alias("action"), F.concat("state_pose", F.array(F.lit(1.0))).alias("state")), root)
    info = t.spark.range(1).select(F.lit(0).cast("long").alias("dataset_id"), F.lit("Failed").alias("split"), F.lit("0:5").alias("spec"))
    action_statistics_job(
        t.spark, root, out, [A.Slice("action", "pose", 7, 14, "action"), A.Slice("state", "pose", 0, 7, "state")],
        [A.ActionKey("action_pose", "rel_xyz_rot6d", "state_pose")], [0, 3, 6], P.expand_split_ranges(info), ["failed"], 3)
    body = "struct<mean:array<double>,std:array<double>,min:array<double>,max:array<double>,q01:array<double>,q99:array<double>>"
    back = t.spark.read.schema(f"dataset_id long, stats map<string,{body}>, timestep_interval long").json(out)
    s = F.col("stats")["action_pose"]
    names = ("mean", "std", "min", "max", "q01", "q99")
    dims = back.select("dataset_id", F.col("timestep_interval").alias("stride"), F.posexplode(F.arrays_zip(*[s[n].alias(n) for n in names])).alias("dim", "x"))
    return dims.select("dataset_id", "dim", "stride", *[r(F.col("x")[n], 4).alias(n) for n in names])
