"""Roll-ups from frame scores to episodes, checkpoints and rankings; QA metrics."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetable.functions.python_tasks import match_cost
from kinetable.functions.vectors import let
from kinetable.operators.stats import exact_quantiles, grouped_medians
from kinetable.session import staged

# Fixed frame ranges [start, end) of generated frames: chunk 1, chunks 2-3, chunks 4-6.
PHASES = {"early": (0, 12), "mid": (12, 36), "late": (36, 72)}
Z95 = 1.96

HISTORY_COLUMNS = (
    "iteration", "timestamp",
    "fds_l1_mean", "fds_ssim_mean", "fds_l1_slope_mean", "fds_l1_early", "fds_l1_mid", "fds_l1_late",
    "gatc_median", "gatc_coverage_pct", "gatc_early_median", "gatc_mid_median", "gatc_late_median",
    "tcd_median_px", "tcd_coverage_pct", "tcd_early_median_px", "tcd_mid_median_px", "tcd_late_median_px",
)


def _decay(phases: dict[str, tuple[int, int]] | None, metric: str, order: str, extra: Sequence[str]) -> list[Column]:
    phases = PHASES if phases is None else phases
    cols = [
        F.count(metric).alias("num_frames"), F.avg(metric).alias(f"mean_{metric}"),
        F.stddev_pop(metric).alias(f"std_{metric}"),
        F.regr_slope(F.col(metric), F.col(order).cast("double")).alias(f"{metric}_slope"),
    ]
    for name, (lo, hi) in phases.items():
        inside = (F.col(order) >= lo) & (F.col(order) < hi)
        cols.append(F.avg(F.when(inside, F.col(metric))).alias(f"{metric}_{name}"))
    return [*cols, *[F.avg(m).alias(f"mean_{m}") for m in extra]]


def frame_decay(
    frames: DataFrame, by: Sequence[str], phases: dict[str, tuple[int, int]] | None = None,
    metric: str = "l1", order: str = "frame_index", extra: Sequence[str] = (),
) -> DataFrame:
    """Mean, std and slope over frames plus phase means, and plain means of ``extra``; one combinable aggregate."""
    return frames.groupBy(*by).agg(*_decay(phases, metric, order, extra))


def episode_scores(frames: DataFrame, by: Sequence[str], phases: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """One row per episode: L1 and SSIM decay, and medians with coverage of GATC and TCD; one shuffle serves them all.

    Frames without an episode are left out.
    """
    known = functools.reduce(lambda a, b: a & b, [F.col(b).isNotNull() for b in by], F.lit(True))
    values, aggs = {}, _decay(phases, "l1", "frame_index", ["ssim"])
    for metric in ("gatc", "tcd"):
        more, coverage = _medians(metric, phases, "frame_index")
        values |= more
        aggs.append(coverage)
    return grouped_medians(frames.where(known), by, values, aggs)


def checkpoint_scores(episodes: DataFrame, by: Sequence[str] = ("checkpoint",), phases: Sequence[str] = tuple(PHASES)) -> DataFrame:
    """All numbers of a checkpoint from :func:`episode_scores`: means and intervals, and medians of episode medians."""
    scores = [f"{m}_score" for m in ("gatc", "tcd")]
    parts = [f"{m}_{p}_median" for m in ("gatc", "tcd") for p in phases]
    means = ["l1_slope", *[f"l1_{p}" for p in phases], "gatc_coverage", "tcd_coverage"]
    return aggregate_checkpoint(episodes, by, ["mean_l1", "mean_ssim"], [*scores, *parts], means)


def history_mapping(phases: Sequence[str] = tuple(PHASES)) -> dict[str, str]:
    """History column -> column of :func:`checkpoint_scores`; ``phases`` are the early, middle and late one."""
    out = {"fds_l1_mean": "mean_l1_mean", "fds_ssim_mean": "mean_ssim_mean", "fds_l1_slope_mean": "l1_slope_mean"}
    for part, phase in zip(("early", "mid", "late"), phases):
        out |= {f"fds_l1_{part}": f"l1_{phase}_mean", f"gatc_{part}_median": f"gatc_{phase}_median_median", f"tcd_{part}_median_px": f"tcd_{phase}_median_median"}
    return out | {"gatc_median": "gatc_score_median", "gatc_coverage_pct": "gatc_coverage_mean",
                  "tcd_median_px": "tcd_score_median", "tcd_coverage_pct": "tcd_coverage_mean"}


def _no_nan(c: str) -> Column:
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def median_coverage(
    frames: DataFrame, metric: str, by: Sequence[str], phases: dict[str, tuple[int, int]] | None = None,
    order: str = "frame_index",
) -> DataFrame:
    """Median over valid frames, percentage of valid frames, and phase medians."""
    values, coverage = _medians(metric, phases, order)
    return grouped_medians(frames, by, values, [coverage])


def _medians(metric: str, phases: dict[str, tuple[int, int]] | None, order: str) -> tuple[dict[str, Column], Column]:
    """The columns whose medians are wanted, and the coverage."""
    phases = PHASES if phases is None else phases
    valid = _no_nan(metric)
    values = {f"{metric}_score": valid}
    for name, (lo, hi) in phases.items():
        values[f"{metric}_{name}_median"] = F.when((F.col(order) >= lo) & (F.col(order) < hi), valid)
    return values, (F.avg(valid.isNotNull().cast("double")) * 100.0).alias(f"{metric}_coverage")


def ci95(metric: str) -> list[Column]:
    """``mean ± 1.96 * s / sqrt(n)``; fewer than two values give (mean, mean)."""
    n, mean = F.count(metric), F.avg(metric)
    half = F.when(n < 2, F.lit(0.0)).otherwise(Z95 * F.stddev_samp(metric) / F.sqrt(n))
    return [(mean - half).alias(f"{metric}_ci_lo"), (mean + half).alias(f"{metric}_ci_hi")]


def aggregate_checkpoint(
    episodes: DataFrame, by: Sequence[str] = ("checkpoint",), propagate: Sequence[str] = ("mean_l1",),
    dropping: Sequence[str] = (), means: Sequence[str] = (), medians: bool = True,
) -> DataFrame:
    """Per-checkpoint n, mean, population std and CI95 per metric.

    ``propagate`` metrics let a NaN through; ``dropping`` metrics ignore missing values
    and also report a median; ``means`` are plain averages.
    """
    df = episodes.withColumns({m: F.coalesce(F.col(m).cast("double"), F.lit(float("nan"))) for m in propagate})
    df = df.withColumns({m: _no_nan(m) for m in dropping})
    if medians and dropping:
        # Read three times below; episodes are usually themselves a roll-up of far more frames.
        df = staged(df.select(*by, *dict.fromkeys([*propagate, *dropping, *means])), "episode-scores")
    aggs = [F.count(F.lit(1)).alias("num_episodes")]
    for m in [*propagate, *dropping]:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), *ci95(m)]
    aggs += [F.avg(m).alias(f"{m}_mean") for m in means]
    base = df.groupBy(*by).agg(*aggs)
    if not (medians and dropping):
        return base
    # All medians in one go: metrics become rows, so the data is read twice, not per metric.
    rows = F.inline(F.array(*[F.struct(F.lit(m).alias("_metric"), F.col(m).alias("_value")) for m in dropping]))
    med = exact_quantiles(df.select(*by, rows), [*by, "_metric"], "_value", {"_median": 0.5})
    wide = med.groupBy(*by).agg(
        *[F.max(F.when(F.col("_metric") == m, F.col("_median"))).alias(f"{m}_median") for m in dropping]
    )
    return base.join(wide, list(by), "left")


def breakdown(
    episodes: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("checkpoint",), inner: str = "dataset_id",
    dropping: Sequence[str] = ("gatc", "tcd"),
) -> DataFrame:
    """Checkpoint level and checkpoint-by-dataset level in one pass (grouping sets).

    The checkpoint rows carry a null dataset and ``level = 'checkpoint'``. ``dropping`` metrics ignore NaN.
    """
    episodes = episodes.withColumns({m: _no_nan(m) for m in metrics if m in dropping})
    g = episodes.groupingSets([[F.col(b) for b in by], [F.col(b) for b in [*by, inner]]], *by, inner)
    aggs = [F.grouping(inner).alias("_g"), F.count(F.lit(1)).alias("num_episodes")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"), *ci95(m)]
    out = g.agg(*aggs)
    return out.withColumn("level", F.when(F.col("_g") == 1, "checkpoint").otherwise("dataset")).drop("_g")


def rank_checkpoints(agg: DataFrame, metrics: dict[str, str], label: str = "checkpoint") -> DataFrame:
    """Rank per metric (``asc`` or ``desc``); missing values are not ranked. Long form."""
    rows = F.explode(
        F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("score"),
                     F.lit(1.0 if d == "asc" else -1.0).alias("_dir"))
            for m, d in metrics.items()
        ])
    )
    long = agg.select(label, rows.alias("_r")).select(label, "_r.*").where(F.col("score").isNotNull() & ~F.isnan("score"))
    w = Window.partitionBy("metric").orderBy(F.col("score") * F.col("_dir"), label)
    return long.withColumn("rank", F.row_number().over(w)).drop("_dir")


def metric_history(agg: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Fixed history columns in order; what is missing becomes NaN (null timestamp)."""
    cols = []
    for c in HISTORY_COLUMNS:
        src = mapping.get(c)
        if c == "timestamp":
            cols.append((F.col(src) if src else F.lit(None)).cast("string").alias(c))
        elif c == "iteration":
            cols.append(F.col(src or "iteration").cast("long").alias(c))
        else:
            v = F.col(src).cast("double") if src else F.lit(None).cast("double")
            cols.append(F.coalesce(v, F.lit(float("nan"))).alias(c))
    return agg.select(*cols)


# --- question/answer checks -------------------------------------------------------


def check_answers(
    answers: DataFrame, actual: str = "answer", expected: str = "expected", keywords: str = "keywords"
) -> DataFrame:
    """Pass rule of a QA check.

    Nothing expected passes. Otherwise the expected text must occur, and when keywords
    are given at least one must occur too; keywords alone never pass.
    """
    low = F.lower(actual)
    has_expected = F.coalesce(F.col(expected), F.lit("")) != ""
    has_keywords = F.coalesce(F.size(keywords), F.lit(0)) > 0
    found = F.filter(F.coalesce(F.col(keywords), F.array().cast("array<string>")), lambda k: F.contains(low, F.lower(k)))
    hit = has_expected & F.contains(low, F.lower(F.coalesce(F.col(expected), F.lit(""))))
    passed = (~has_expected & ~has_keywords) | (hit & (~has_keywords | (F.size(found) > 0)))
    reported = F.when(hit, found).otherwise(F.array().cast("array<string>"))
    return answers.withColumn("validation_passed", F.coalesce(passed, F.lit(False))).withColumn("found_keywords", reported)


def qa_metrics(results: DataFrame, threshold: float = 80.0, by: Sequence[str] = (),
               passed: str = "validation_passed", must: str = "must_pass") -> DataFrame:
    """Counts, success rate and verdict. Failed questions come from :func:`failed_must_pass`."""
    total, ok = F.count(F.lit(1)), F.count_if(F.col(passed))
    g = results.groupBy(*by).agg(
        total.alias("total_checks"), ok.alias("passed"), (total - ok).alias("failed"),
        F.when(total > 0, ok / F.nullif(total, F.lit(0)) * 100.0).otherwise(0.0).alias("success_rate"),
        F.count_if(F.col(must)).alias("must_pass_total"),
        F.count_if(F.col(must) & F.col(passed)).alias("must_pass_passed"),
        F.count_if(F.col(must) & ~F.col(passed)).alias("must_pass_failed"),
    )
    return g.withColumn("meets_threshold", (F.col("success_rate") >= threshold) & (F.col("must_pass_failed") == 0))


def failed_must_pass(results: DataFrame, passed: str = "validation_passed", must: str = "must_pass") -> DataFrame:
    return results.where(F.col(must) & ~F.col(passed))


def batch_status(results: DataFrame, by: Sequence[str] = (), threshold: float = 80.0) -> DataFrame:
    """Batches per status and the pooled rate over success and failed ones."""
    ran = F.col("status").isin("success", "failed")
    g = results.groupBy(*by).agg(
        F.count_if(F.col("status") == "success").alias("n_success"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.count_if(F.col("status") == "skipped").alias("n_skipped"),
        F.count_if(F.col("status") == "error").alias("n_error"),
        F.coalesce(F.sum(F.when(ran, F.col("total_checks"))), F.lit(0)).alias("pooled_checks"),
        F.coalesce(F.sum(F.when(ran, F.col("passed"))), F.lit(0)).alias("pooled_passed"),
    )
    rate = F.when(F.col("pooled_checks") > 0, F.col("pooled_passed") / F.nullif(F.col("pooled_checks"), F.lit(0)) * 100.0)
    return g.withColumn("pooled_rate", F.coalesce(rate, F.lit(0.0))).withColumn(
        "meets_threshold", F.coalesce(rate >= threshold, F.lit(False))
    )


# --- tool centroids -----------------------------------------------------------------


def miss_distance(height: float, width: float) -> float:
    """Penalty of an unmatched tool: half the image diagonal."""
    return 0.5 * float(np.hypot(height, width))


def centroid_costs(gt: Column, gen: Column) -> Column:
    """Distance matrix of two centroid arrays ``array<struct<x, y>>`` as nested arrays."""
    return F.transform(gt, lambda a: F.transform(gen, lambda b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])))


#: Up to so many centroids on either side, all matchings are compared by an expression.
FEW_TOOLS = 3


def least_matching(costs: Column, rows: int = FEW_TOOLS) -> Column:
    """Least cost of matching every row of a nested cost array with a column of its own; up to ``FEW_TOOLS`` of either.

    Missing rows cost nothing, and missing columns drop out, as the least of several numbers leaves out nulls.
    """
    at = lambda i, j: F.get(F.get(costs, F.lit(i)), F.lit(j))
    best = [F.least(*[functools.reduce(lambda a, b: a + b, [at(i, j) for i, j in enumerate(p)]) for p in itertools.permutations(range(FEW_TOOLS), n)])
            if n > 1 else F.array_min(F.get(costs, F.lit(0))) for n in range(1, rows + 1)]
    out = F.lit(0.0)
    for n, least in enumerate(best, 1):
        out = F.when(F.size(costs) == n, least).otherwise(out)
    return out


def centroid_distance(df: DataFrame, gt: str, gen: str, penalty: float, out: str = "tcd", most: int | None = None) -> DataFrame:
    """Mean matched centroid distance per frame; unmatched ground truth costs ``penalty``.

    No ground truth gives null, nothing generated gives the penalty. One row is one frame, so its centroids never meet
    another row's. ``most`` bounds the centroids of a side; where it is not given, one aggregate finds it. Up to
    ``FEW_TOOLS`` all matchings are compared in the JVM; only frames beyond go to Python tasks.
    """
    n, m = F.size(gt), F.size(gen)
    if most is None:
        most = df.agg(F.max(F.greatest(n, m))).first()[0] or 0
    few = F.greatest(n, m) <= FEW_TOOLS
    costs = F.when(n <= m, centroid_costs(F.col(gt), F.col(gen))).otherwise(centroid_costs(F.col(gen), F.col(gt)))
    matched = lambda cost: (cost + F.greatest(n - m, F.lit(0)) * penalty) / n
    distance = lambda cost: F.when(n == 0, None).when(m == 0, F.lit(float(penalty))).otherwise(matched(cost))
    small = df.withColumn(out, distance(let(costs, lambda c: least_matching(c))))
    if most <= FEW_TOOLS:
        return small
    small = df.where(F.coalesce(few, F.lit(True))).withColumn(out, distance(let(costs, lambda c: least_matching(c))))
    large = df.where(~few).withColumn("_cost", match_cost(F.col(gt)["x"], F.col(gt)["y"], F.col(gen)["x"], F.col(gen)["y"]))
    return small.unionByName(large.withColumn(out, distance(F.col("_cost"))).drop("_cost"))
