"""Known cases and error paths of the smaller operators."""

from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions import vectors as V
from kinetable.functions.python_tasks import assignment_cost
from kinetable.operators import actions as A, clips as C, evaluation as E, quality as Q, splits as P, telemetry as T
from kinetable.operators.augment import dropout, perturb
from kinetable.sources import manifests as M


@pytest.mark.parametrize("seconds, count, last", [(27, 5, 20), (28, 6, 25), (32, 6, 25)])
def test_clip_window_counts(spark, seconds, count, last):
    clips = spark.createDataFrame([(1, 30, seconds * 30)], "clip_id int, fps int, n_frames int")
    rows = C.clip_windows(clips).orderBy("window_id").collect()
    assert len(rows) == count and rows[-1].start_time == last and rows[-1].end_frame == seconds * 30 - 1


def test_chunk_tail_belongs_to_the_previous_chunk(spark):
    df = spark.createDataFrame([(383, x / 50) for x in range(50)] + [(641, x / 50) for x in range(50)], "n_frames int, u double")
    got = {(r.n_frames, r.frames_in_chunk) for r in C.sample_chunk(df, 4, 256, F.col("u")).collect()}
    assert got == {(383, 383), (641, 256), (641, 129)}


def test_stride_closed_form_equals_enumeration(spark):
    rows = [(n, f) for n in (10, 61, 100, 333) for f in (5, 24, 30, 59, 60)]
    df = spark.createDataFrame(rows, "n_frames int, fps int")
    got = {(r.n_frames, r.fps): r.stride for r in C.choose_stride(df, 10, 8, 30, F.lit(0.5), F.lit(0.5)).collect()}
    for n, f in rows:
        valid = [s for s in range(1, (n - 1) // 9 + 1) if n - s * 9 > 0 and 8 <= f / s <= 30]
        assert got[n, f] == (valid[-1] if valid else None)


@pytest.mark.parametrize("spec, want", [("0:3", [0, 1, 2, 3]), ("2-4", [2, 3, 4]), ("42", [42]), ("0:1, 7:8", [0, 1, 7, 8])])
def test_split_ranges(spark, spec, want):
    info = spark.createDataFrame([(0, "x", spec)], "dataset_id int, split string, spec string")
    assert sorted(r.episode_index for r in P.split_indices(P.expand_split_ranges(info)).collect()) == want


def test_split_range_errors(spark):
    info = spark.createDataFrame([(0, "x", "9:3")], "dataset_id int, split string, spec string")
    with pytest.raises(Exception, match="invalid split range"):
        P.expand_split_ranges(info).collect()


def test_concat_and_split_are_inverse(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0])], "a_pose array<double>, a_grip array<double>")
    dims = {"a_pose": 2, "a_grip": 1}
    both = A.concat_keys(df, ["a_pose", "a_grip"], dims, "v", present=["a_grip", "a_pose"])
    back = A.split_keys(both.select("v"), "v", dims).first()
    assert back.a_pose == [1.0, 2.0] and back.a_grip == [3.0]
    with pytest.raises(ValueError, match="absent"):
        A.concat_keys(df, ["nope"], {}, "v")
    with pytest.raises(ValueError, match="differ"):
        A.concat_keys(df, ["a_pose"], dims, "v", present=["a_pose", "a_grip"])
    with pytest.raises(Exception, match="unexpected width"):
        A.concat_keys(df, ["a_grip"], {"a_grip": 4}, "v").collect()


@pytest.mark.parametrize("mode", ["q99", "mean_std", "min_max"])
def test_normalise_then_denormalise(spark, mode):
    s = F.struct(*[F.array(*[F.lit(float(x)) for x in v]).alias(k) for k, v in {
        "mean": (1, 2), "std": (2, 3), "min": (-9, -9), "max": (9, 9), "q01": (-8, -8), "q99": (8, 8)}.items()])
    df = spark.createDataFrame([([1.5, -2.5],)], "v array<double>")
    out = df.select(V.denormalize(V.normalize("v", s, mode), s, mode).alias("v")).first().v
    np.testing.assert_allclose(out, [1.5, -2.5])


def test_constant_dims_follow_their_mode(spark):
    s = F.struct(*[F.array(F.lit(float(v))).alias(k) for k, v in {"mean": 5, "std": 0, "min": 5, "max": 5, "q01": 5, "q99": 5}.items()])
    df = spark.createDataFrame([([0.25],)], "v array<double>")
    got = [df.select(V.normalize("v", s, m)[0]).first()[0] for m in ("q99", "mean_std", "min_max", "scale", "binary")]
    assert got == [0.25, 0.25, 0.0, 0.05, 0.0]
    with pytest.raises(ValueError):
        V.denormalize_value(F.lit(1.0), {}, "scale")


def test_perturb_is_repeatable_and_bounded(spark):
    df = spark.range(50).select("id", F.array(F.lit(0.0), F.lit(1.0), F.lit(0.5)).alias("v"))
    a, b = (df.select("id", perturb(F.col("v"), 0.3, 1, F.col("id")).alias("p")).orderBy("id").collect() for _ in range(2))
    assert a == b and all(0.0 <= x <= 1.0 for r in a for x in r.p) and len({tuple(r.p) for r in a}) > 40
    zeroed = df.where(F.forall(dropout(F.col("v"), 0.4, 1, F.col("id")), lambda x: x == 0)).count()
    assert 5 < zeroed < 35
    assert df.select(perturb(F.col("v"), -1.0, 1, F.col("id"))[2]).first()[0] == 0.5


def test_pad_tokens(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "t array<array<double>>")
    r = df.select(V.pad_tokens("t", 3).alias("a"), V.pad_tokens("t", 1).alias("b"), V.pad_tokens("t", 3, True).alias("c")).first()
    assert r.a.tokens == [[1.0, 2.0], [3.0, 4.0], [0.0, 0.0]] and r.a.mask == [1, 1, 0]
    assert r.b.tokens == [[1.0, 2.0]] and r.b.mask == [1] and r.c.mask == [1, 1, 1]


def test_ci_of_a_single_episode_is_its_mean(spark):
    r = spark.createDataFrame([("a", 2.0)], "checkpoint string, m double").groupBy("checkpoint").agg(*E.ci95("m")).first()
    assert (r.m_ci_lo, r.m_ci_hi) == (2.0, 2.0)


def test_nan_propagates_only_where_it_should(spark):
    df = spark.createDataFrame([("a", 1.0, float("nan")), ("a", None, 4.0)], "checkpoint string, mean_l1 double, gatc double")
    r = E.aggregate_checkpoint(df, dropping=["gatc"]).first()
    assert np.isnan(r.mean_l1_mean) and r.gatc_mean == 4.0 and r.gatc_median == 4.0 and r.num_episodes == 2


def test_qa_rule(spark):
    rows = [(1, "The Answer", "", []), (2, "the answer", "answer", []), (3, "the answer", "", ["answer"]), (4, "the answer", "answer", ["nope"]), (5, "the answer", "Answer", ["THE"])]
    df = spark.createDataFrame(rows, "id int, answer string, expected string, keywords array<string>")
    assert {r.id: r.validation_passed for r in E.check_answers(df).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}


def brute_force_cost(cost):
    c = cost if cost.shape[0] <= cost.shape[1] else cost.T
    return min(sum(c[i, p[i]] for i in range(c.shape[0])) for p in permutations(range(c.shape[1]), c.shape[0]))


def test_assignment_equals_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(200):
        c = rng.random((rng.integers(1, 6), rng.integers(1, 6)))
        assert abs(assignment_cost(c) - brute_force_cost(c)) < 1e-9


def test_duplicate_sample_names_raise(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "name string")
    assert [r.name for r in M.duplicate_names(df).collect()] == ["a"]
    with pytest.raises(Exception, match="not unique"):
        M.require_unique_names(df).collect()


def test_parquet_schema_diff(spark):
    a = spark.createDataFrame([(1, "x")], "id long, name string")
    b = spark.createDataFrame([(1, 2.0)], "id int, score double")
    assert {r.column: r.severity for r in Q.parquet_schema_diff(a, b).collect()} == {"id": "ERROR", "name": "INFO", "score": "INFO"}


def test_stats_guard_strict_raises(spark):
    stats = spark.createDataFrame([("arm", 2)], "embodiment string, timestep_interval int")
    registry = spark.createDataFrame([("arm", 3)], "embodiment string, stride int")
    with pytest.raises(Exception, match="stride mismatch"):
        Q.stats_guard(stats, registry, strict=True).collect()


def test_lognormal_edges_are_symmetric_in_log():
    e = np.log(T.lognormal_edges())
    assert len(e) == 11 and np.allclose(e, -e[::-1])


def test_centroid_distance_in_the_jvm_and_beyond(spark):
    """All sizes up to five on either side, against an exhaustive matching; up to three without a Python worker."""
    import itertools
    import random

    rng = random.Random(5)
    rows = []
    for n, m in itertools.product(range(6), range(6)):
        rows += [(len(rows) + k, [(rng.random(), rng.random()) for _ in range(n)], [(rng.random(), rng.random()) for _ in range(m)]) for k in range(2)]

    def brute(gt, gen):
        if not gt or not gen:
            return None if not gt else 0.5
        dist = lambda a, b: ((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5
        small, large = sorted((gt, gen), key=len)
        least = min(sum(dist(a, b) for a, b in zip(small, p)) for p in itertools.permutations(large, len(small)))
        return (least + max(0, len(gt) - len(gen)) * 0.5) / len(gt)

    schema = "id int, gt array<struct<x: double, y: double>>, gen array<struct<x: double, y: double>>"
    for part in (rows, [r for r in rows if max(len(r[1]), len(r[2])) <= 3]):
        out = E.centroid_distance(spark.createDataFrame(part, schema), "gt", "gen", 0.5)
        got = {r.id: r.tcd for r in out.collect()}
        want = {i: brute(a, b) for i, a, b in part}
        assert got.keys() == want.keys() and all(got[i] == want[i] if want[i] is None else abs(got[i] - want[i]) < 1e-12 for i in want)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_first_rows_and_patterns(spark):
    from kinetable.operators.ranking import first_rows
    from kinetable.operators.sampling import pick_episodes
    from kinetable.operators.stats import frequent_patterns

    df = spark.range(20000).select("id", ((F.col("id") * 7919) % 101).alias("u"), (F.col("id") % 2).alias("g"))
    order = sorted(range(20000), key=lambda i: (i * 7919 % 101, i))
    for n in (0, 1, 150, 10000, 19999, 20000, 30000):
        assert sorted(r.id for r in first_rows(df, n, ["u", "id"]).collect()) == sorted(order[:n])
    many = pick_episodes(df, 5000, F.col("u"), ["g"], ["id"]).collect()
    assert sorted(r.id for r in many) == sorted([i for i in order if i % 2 == 0][:5000] + [i for i in order if i % 2][:5000])
    points = [([float(c * 10 + d / 10)], c * 100 + d) for c in range(3) for d in range((c + 1) * 10)]
    got = frequent_patterns(spark.createDataFrame(points, "v array<double>, k int"), "v", F.col("k") % 100, k=3, top=2).collect()
    assert [r["size"] for r in got] == [30, 20] and abs(got[0].centroid[0] - 21.45) < 1e-9
