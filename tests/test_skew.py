"""Operators on data in which one group holds most rows, with small blocks to force splitting."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetable.operators import mixture as M, sampling as S, splits as P, stats, windows as W
from kinetable.operators.ranking import episode_blocks, int_block, position, running_sum

RNG = np.random.default_rng(3)


@pytest.fixture(scope="module")
def skewed(spark):
    group = np.where(RNG.random(5000) < 0.6, 0, RNG.integers(1, 40, 5000))
    pdf = pd.DataFrame({"g": group, "k": RNG.permutation(5000), "v": RNG.integers(0, 9, 5000)})
    pdf.loc[pdf.g == 7, "g"] = None
    return spark.createDataFrame(pdf.astype({"g": "Int64"})), pdf


def test_running_sum_with_null_group(skewed):
    df, pdf = skewed
    got = running_sum(df, F.col("v"), ["g"], ["k"], int_block("k", 64), "before", "total").toPandas().sort_values("k")
    ref = pdf.sort_values("k")
    by = ref.groupby("g", dropna=False).v
    assert (got.before.values == (by.cumsum() - ref.v).values).all()
    assert (got.total.values == by.transform("sum").values).all()


def test_position_with_several_block_levels(skewed):
    df, pdf = skewed
    blocks = [int_block("k", 1000), int_block("k", 100), int_block("k", 10)]
    got = position(df, [], ["k"], blocks, "pos", "n").toPandas()
    assert (got.pos == got.k).all() and (got.n == 5000).all()


@pytest.mark.parametrize("block", [1, 8, 1000])
def test_gather_window_long_episode(spark, block):
    t = 300
    df = spark.range(t).select(
        F.lit(0).alias("dataset_id"), F.lit(1).alias("episode_index"), F.col("id").alias("frame_index"),
        F.array(F.col("id").cast("double")).alias("v"), F.col("id").alias("s"),
    )
    deltas = [-3, 0, 5, 12]
    w = W.gather_window(df, ["v", "s"], deltas, {"s": "zero"}, block=block).orderBy("frame_index").toPandas()
    assert len(w) == t
    for i in range(t):
        assert [x[0] for x in w.v_win[i]] == [float(min(max(i + d, 0), t - 1)) for d in deltas]
        assert list(w.s_win[i]) == [i + d if 0 <= i + d < t else 0 for d in deltas]
    full = W.gather_window(df, ["v"], [0, 5, 12], full_only=True, block=block)
    assert full.count() == t - 12


def test_exact_quantiles_beyond_the_small_group_limit(spark):
    values = np.concatenate([RNG.normal(size=60000), np.full(9000, 1.25), [1e9, -1e9]])
    pdf = pd.DataFrame({"g": np.where(np.arange(len(values)) % 7 == 0, "b", "a"), "v": values})
    df = spark.createDataFrame(pdf)
    probs = {"p0": 0.0, "q01": 0.01, "q25": 0.25, "q50": 0.5, "q99": 0.99, "p1": 1.0}
    got = stats.exact_quantiles(df, ["g"], "v", probs, [F.count("v").alias("n")], accuracy=1000).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, list(probs)].astype(float), np.quantile(part.v, list(probs.values())), rtol=1e-12)
        assert got.loc[g, "n"] == len(part)


def test_exact_quantiles_without_groups_and_with_nulls(spark):
    df = spark.createDataFrame([(float(x) if x % 3 else None,) for x in range(100)], "v double")
    row = stats.exact_quantiles(df, [], "v", {"m": 0.5, "low": 0.5}, lower=("low",)).first()
    kept = sorted(x for x in range(100) if x % 3)
    assert row.m == np.median(kept) and row.low == kept[(len(kept) - 1) // 2]


def test_grouped_medians_large_group_path(spark):
    pdf = pd.DataFrame({"g": np.where(np.arange(3000) < 2000, 0, np.arange(3000) % 50 + 1), "v": RNG.normal(size=3000)})
    df = spark.createDataFrame(pdf)
    got = stats.grouped_medians(df, ["g"], {"m": F.col("v"), "pos": F.when(F.col("v") > 0, F.col("v"))}, [F.count("v").alias("n")], limit=500)
    got = got.toPandas().set_index("g").sort_index()
    ref = pdf.groupby("g").v
    np.testing.assert_allclose(got.m, ref.median(), rtol=1e-12)
    np.testing.assert_allclose(got.pos, pdf[pdf.v > 0].groupby("g").v.median(), rtol=1e-12)
    assert (got.n == ref.size()).all()


def test_trailing_split_straddles_an_episode(spark):
    steps = W.enumerate_steps(spark.createDataFrame([(0, 0, 90), (0, 1, 10), (0, 5000, 3)], "dataset_id int, episode_index long, length long"))
    test = P.trailing_split(steps, 0.1, "test")
    got = sorted((r.episode_index, r.base_index) for r in test.collect())
    assert got == [*((1, b) for b in range(3, 10)), *((5000, b) for b in range(3))]
    assert P.trailing_split(steps, 0.1, "train").count() == 93
    assert P.trailing_split(steps, 0.1, "full").count() == 103
    with pytest.raises(ValueError):
        P.trailing_split(steps, 1.5, "test")


def test_explode_range_splits_one_huge_row(spark):
    df = spark.createDataFrame([(1, 0, 99999), (2, 5, 4)], "id int, lo long, hi long")
    out = W.explode_range(df, F.col("lo"), F.col("hi"), "x", block=1000)
    assert out.count() == 100000 and out.agg(F.sum("x")).first()[0] == sum(range(100000))


def test_enumerate_steps_example(spark):
    eps = spark.createDataFrame([(0, 0, 3), (0, 1, 2), (0, 2, 4)], "dataset_id int, episode_index long, length long")
    assert W.enumerate_steps(eps).count() == 9


def test_virtual_index_mapping_matches_a_loop(spark):
    rows = [(0, 100, 1.0), (1, 10, 1.0), (2, 40, 2.5), (3, 7, 0.01)]
    mix = M.repeat_factors(spark.createDataFrame(rows, "dataset_id long, real_len long, mix_ratio double"))
    w = [ratio / n for _, n, ratio in rows]
    reps = [max(1, round(x / min(w))) for x in w]
    table = [(d, i % n) for (d, n, _), k in zip(rows, reps) for i in range(n * k)]
    assert [x.repeat for x in mix.orderBy("dataset_id").collect()] == reps
    idx = spark.range(len(table) + 50).withColumnRenamed("id", "idx")
    got = M.virtual_to_real(idx, mix).orderBy("idx").collect()
    assert [(x.dataset_id, x.real_index) for x in got] == [table[i % len(table)] for i in range(len(table) + 50)]


def test_shard_export_reaches_every_worker(spark):
    shards = spark.range(10).withColumnRenamed("id", "shard")
    out = S.shard_export(shards, "shard", 4, 2).toPandas()
    assert len(out) == 16 and out.groupby(["rank", "worker"]).size().eq(2).all()
    plain = S.shard_export(shards, "shard", 4, 2, repeat=False)
    assert plain.count() == 10


def test_episode_blocks_agree_with_plain_order(spark):
    pdf = pd.DataFrame({"e": np.repeat(np.arange(30), 20), "b": np.tile(np.arange(20), 30)})
    got = position(spark.createDataFrame(pdf), [], ["e", "b"], episode_blocks("e", "b"), "pos").toPandas()
    assert (got.pos == got.e * 20 + got.b).all()


def test_merge_partials_equals_direct_moments(spark):
    v = RNG.normal(1e6, 1e-3, 4000)
    long = spark.createDataFrame(pd.DataFrame({"part": np.arange(4000) % 11, "value": v}))
    got = stats.merge_partials(stats.partial_stats(long, ["part"]).withColumn("g", F.lit(1)), ["g"]).first()
    assert got.n == 4000 and abs(got.std - v.std()) < 1e-8


def test_global_order_of_hashed_ids_is_cut_evenly(spark):
    from kinetable.operators.ranking import in_ranges, ordered_position

    ids = spark.range(20000).select(F.xxhash64("id").alias("h"))
    sizes = [r["count"] for r in in_ranges(ids, ["h"]).groupBy("_range").count().collect()]
    assert sum(sizes) == 20000 and 1 <= len(sizes) <= 200 and (len(sizes) == 1 or max(sizes) < 3 * 20000 / len(sizes))
    got = [r.pos for r in ordered_position(ids, ["h"]).orderBy("h").select("pos").collect()]
    assert got == list(range(20000))


def test_quantiles_of_ten_million_values_order_few(spark, monkeypatch):
    """One key with ten million distinct values: the bracket is narrowed until a task orders a set number of them."""
    seen = []
    real = stats._refined

    def watched(keyed, v, wanted, *args):
        out = real(keyed, v, wanted, *args)
        rows = keyed.select("_key", v.alias("_v")).join(out, "_key")
        inside = [F.count_if(F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))) for i in range(3)]
        seen.extend(rows.agg(*inside).first())
        return out

    monkeypatch.setattr(stats, "_refined", watched)
    n = 10_000_000
    # Squares, so that values crowd at one end; the permutation scatters them over the partitions.
    df = spark.range(n).select(F.pow((F.col("id") * 7919) % n, F.lit(2)).alias("v"))
    row = stats.exact_quantiles(df, [], "v", {"q01": 0.01, "q50": 0.5, "q99": 0.99}, accuracy=1000, most=500).first()

    def want(p):
        at = p * (n - 1)
        a, b = float(int(at)) ** 2, float(min(n - 1, int(at) + 1)) ** 2
        return a + (b - a) * (at - int(at))

    assert all(abs(got - want(p)) <= 1e-9 * want(p) for got, p in zip(row, (0.01, 0.5, 0.99)))
    assert max(seen) <= 1000


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_refined_quantiles_with_ties_and_groups(spark, accuracy):
    rng = np.random.default_rng(6)
    values = {"ties": rng.integers(0, 9, 20000).astype(float), "wide": rng.standard_cauchy(30000) ** 3, "one": np.full(25000, 4.0), "few": rng.random(7)}
    df = spark.createDataFrame([(g, float(x)) for g, xs in values.items() for x in xs], "g string, v double")
    got = {r.g: r for r in stats.exact_quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.999, "d": 1.0}, accuracy=accuracy, most=20, lower=("b",)).collect()}
    for g, xs in values.items():
        low = np.sort(xs)[int(0.5 * (len(xs) - 1))]
        assert np.allclose([got[g].a, got[g].b, got[g].c, got[g].d], [np.quantile(xs, 0.01), low, np.quantile(xs, 0.999), xs.max()])


def test_merge_of_one_hot_instruction(spark):
    """Most episodes have one instruction, many have none: ids are those of a loop, and no task holds the hot text."""
    from kinetable.operators.quality import merge_reindex

    rows = [(i * 3, "pick it up" if i % 3 else None if i % 9 == 0 else f"task {i % 50}", i % 7 + 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "orig_idx long, instruction string, length long").repartition(9)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = merge_reindex(df)
        sizes = sorted(r[1] for r in out.groupBy(F.spark_partition_id()).count().collect())
        got = sorted(tuple(r) for r in out.select("orig_idx", "episode_index", "frame_offset", "task_index").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    tasks, offset, want = {}, 0, []
    for n, (i, text, length) in enumerate(rows):
        want.append((i, n, offset, tasks.setdefault(text, len(tasks))))
        offset += length
    assert got == want
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]
