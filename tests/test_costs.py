"""Work that operators must not do, beside the results that must not change."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import evaluation as E, ranking, safety as S, stats, windows
from tests.test_safety import brute_partial


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_episode_scores_take_one_shuffle_and_no_join(spark):
    frames = spark.createDataFrame([("c", 1, 0, 0.1, 0.9, 1.0, 2.0)], "checkpoint string, episode_index long, frame_index long, l1 double, ssim double, gatc double, tcd double")
    plan = _plan(E.episode_scores(frames, ["checkpoint", "episode_index"]))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_episode_scores_equal_plain_loops(spark):
    nan, phases = float("nan"), {"early": (0, 2), "late": (2, 9)}
    gatc = {("a", 1): [1.0, nan, 3.0, 0.1], ("a", 2): [None, nan], ("b", 1): [0.3, 0.1, 0.2], ("b", None): [5.0], (None, 1): [6.0]}
    rows = [(c, e, f, 0.5, 0.5, v, float(f)) for (c, e), values in gatc.items() for f, v in enumerate(values)]
    frames = spark.createDataFrame(rows, "checkpoint string, episode_index long, frame_index long, l1 double, ssim double, gatc double, tcd double")
    got = {(r.checkpoint, r.episode_index): r for r in E.episode_scores(frames, ["checkpoint", "episode_index"], phases).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1)}
    for key, r in got.items():
        valid = [(f, v) for f, v in enumerate(gatc[key]) if v is not None and not math.isnan(v)]
        median = lambda vs: statistics.median(vs) if vs else None
        assert r.gatc_score == median([v for _, v in valid])
        assert r.gatc_early_median == median([v for f, v in valid if f < 2]) and r.gatc_late_median == median([v for f, v in valid if f >= 2])
        assert r.gatc_coverage == pytest.approx(100 * len(valid) / len(gatc[key]))
        assert r.tcd_score == statistics.median(range(len(gatc[key]))) and r.num_frames == len(gatc[key])


def test_word_runs_equal_plain_loops(spark):
    texts = ["", "one", "ab abc ab abc abcd", "a b c d e", "toolongaword ab 😀😀 é x ab"]
    budgets = {(1, 2): 0, (1, 3): 1, (2, 5): 1, (2, 6): 2, (3, 5): 0}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", S.word_ngrams(F.col("t"), budgets).alias("g"))
    assert "regexp_extract_all" in _plan(df)
    for r in df.collect():
        words = texts[r.id].split(" ")
        runs = {(" ".join(words[i : i + n]), n) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        want = {(g, n, budgets[n, len(g)]) for g, n in runs if (n, len(g)) in budgets}
        assert sorted(map(tuple, r.g)) == sorted(want)


def test_few_word_runs_are_varied_and_none_that_passes_is_lost(spark):
    terms = ["poisonous", "a]b-c^d&&e", "\\q[x]y.z", "naïve😀😀😀😀", "dangerous thing"]
    near = [t[:k] + c + t[k + d:] for t in terms for k in range(len(t)) for d in (0, 1) for c in ("", "#", "x😀")]
    far = ["gnihtyna", "wordwords", "elbisreve"]
    df = spark.createDataFrame(list(enumerate([*near, *far])), "id int, text string")
    for slack in (1.0, 2.0):
        got = {r.id: r.partial_term for r in S.partial_block(df, terms, "id", slack=slack).collect()}
        assert got == {i: w for i, t in enumerate([*near, *far]) if (w := brute_partial(t, terms, 6, slack))}
    listed = spark.createDataFrame([("poisonous", 1, 1)], "term string, n_words int, depth int")
    grams = spark.createDataFrame([(g, 1, 1) for g in ["poisonous", "poisnous", "poisoxous", *far]], "gram string, n_words int, depth int")
    assert {r.gram for r in grams.where(S._enough_pairs(listed)).collect()} == {"poisonous", "poisnous", "poisoxous"}


def test_long_lists_of_partial_terms_leave_words_alone(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a badword_x here"), (2, "a badword here"), (3, None)], "id int, text string")
    terms = ["badword", "other thing"]
    want = {r.id: r.partial_term for r in S.partial_block(df, terms, "id", fold=True).collect()}
    monkeypatch.setattr(S, "INLINE_TERMS", 1)
    found = S.partial_block(df, terms, "id", fold=True)
    assert "([a-z0-9_]+)" not in _plan(found)
    assert {r.id: r.partial_term for r in found.collect()} == want == {2: "badword"}


def _rows_of_groups(spark):
    rng = np.random.default_rng(3)
    parts = {"wide": rng.standard_cauchy(6000), "ties": rng.integers(-3, 4, 4000).astype(float), "flat": np.full(500, 0.1), "tiny": rng.random(900) * 1e-300, "one": np.array([7.5])}
    rows = [(g, float(x)) for g, xs in parts.items() for x in xs] + [("wide", None), ("none", None), (None, 1.0), (None, 3.0)]
    return parts, spark.createDataFrame(rows, "g string, value double")


def test_exact_statistics_keep_no_sketch(spark, monkeypatch):
    """Counts by magnitude find the ranks: sketches of whole groups took most of the job's time (F9)."""

    def sketch(*_):
        raise AssertionError("a sketch of all values")

    parts, df = _rows_of_groups(spark)
    monkeypatch.setattr(stats.F, "percentile_approx", sketch)
    got = {x.g: x for x in stats.value_stats(df, ["g"]).collect()}
    for g, xs in parts.items():
        x = got[g]
        assert (x.n, x.min, x.max) == (len(xs), xs.min(), xs.max())
        assert np.allclose([x.mean, x.std, x.q01, x.q99], [xs.mean(), xs.std(), np.quantile(xs, 0.01), np.quantile(xs, 0.99)], rtol=1e-9, atol=0 if g != "flat" else 1e-12)
    assert got["flat"].std == 0.0
    assert tuple(got["none"])[1:] == (0, None, None, None, None, None, None)
    assert (got[None].n, got[None].mean, got[None].q01) == (2, 2.0, 1.02)


def test_odd_numbers_keep_their_order(spark):
    """Infinities and NaN, which sorts last, have cells of their own."""
    xs = [float("-inf"), -1e308, -5e-324, -0.0, 0.0, 5e-324, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    finite = [1, 2, 3, 4, 5, 6, 8]
    names = {f"p{i}": i / 8 for i in finite}
    row = stats.exact_quantiles(df, [], "v", names, lower=tuple(names)).first()
    assert [str(a + 0.0) for a in row] == [str(xs[i] + 0.0) for i in finite]


def test_blocks_are_sorted_by_a_hash_first(spark):
    """A struct has no sort prefix and a data set id hardly one, so each comparison went through the whole key (F9, F10)."""
    df = spark.range(100).select((F.col("id") % 3).alias("dataset_id"), F.lit(1).alias("episode_index"), "id", F.floor(F.col("id") / 3).alias("frame_index"))
    wide = windows.gather_window(df, ["id"], [0, 2], full_only=True)
    placed = ranking.position(df, ["dataset_id"], ["id"], ranking.int_block("id", 16), "pos")
    for got, lead in ((wide, "_part#"), (placed, "_part1#")):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert f", [{lead}" in next(x for x in plan.splitlines() if "Window [" in x)
    assert not {c for c in [*wide.columns, *placed.columns] if c.startswith("_")}
    assert sorted((x.id, list(x.id_win)) for x in wide.collect()) == [(i, [i, i + 6]) for i in range(94)]
    assert all(x.pos == x.id // 3 for x in placed.collect())



def test_approximate_statistics_make_one_sketch(spark):
    """One sketch answers for all quantiles; each had its own (F10)."""
    parts, df = _rows_of_groups(spark)
    out = stats.value_stats(df, ["g"], approx=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("percentile_approx(") == 1
    got = {x.g: x for x in out.collect()}
    for g, xs in parts.items():
        for p, x in ((0.01, got[g].q01), (0.99, got[g].q99)):
            below, upto = (xs < x).mean(), (xs <= x).mean()
            assert x in xs and below <= p + 2e-4 and upto >= p - 2e-4
    assert got["none"].q01 is None and out.columns == ["g", "n", "mean", "std", "min", "max", "q01", "q99"]
