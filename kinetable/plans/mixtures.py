"""Queries over weighted mixtures, sampling, interleaving and shard export."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetable.functions.hashing import lcg, lcg_uniform
from kinetable.operators import mixture as M, sampling as S
from kinetable.operators.ranking import int_block, position
from kinetable.plans.fixtures import lcg_sql, u_sql, view
from kinetable.plans.registry import query, r, rs

_MIX = view("datasets") + """, w AS (SELECT *, mix_ratio / greatest(real_len, 1) AS wt FROM datasets),
    p AS (SELECT *, CAST(greatest(1, round_even(wt / (SELECT min(wt) FROM w), 0)) AS BIGINT) AS repeat FROM w),
    z AS (SELECT *, real_len * repeat AS virtual_len FROM p),
    mix AS (SELECT *, CAST(coalesce(sum(virtual_len) OVER (ORDER BY dataset_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS virtual_start FROM z)"""


@query("w11_repeat_factors", _MIX + " SELECT dataset_id, real_len, repeat, virtual_len, virtual_start, virtual_start + virtual_len AS virtual_end FROM mix")
def mixture(t):
    m = M.repeat_factors(t["datasets"])
    return m.select("dataset_id", "real_len", "repeat", "virtual_len", "virtual_start", "virtual_end")


@query("a29_mixture_summary", _MIX + f" SELECT dataset_id, real_len, {rs('mix_ratio')} AS mix_ratio, repeat, virtual_len, {rs('100.0 * virtual_len / (SELECT sum(virtual_len) FROM mix)')} AS pct_total FROM mix")
def _(t):
    s = M.mixture_summary(M.repeat_factors(t["datasets"]))
    return s.select("dataset_id", "real_len", r("mix_ratio").alias("mix_ratio"), "repeat", "virtual_len", r("pct_total").alias("pct_total"))


@query("j12_locate", _MIX + ", i AS (SELECT o_orderkey * 7 AS idx FROM orders) SELECT idx, dataset_id FROM i JOIN mix ON idx >= virtual_start AND idx < virtual_start + virtual_len")
def _(t):
    idx = t["orders"].select((F.col("o_orderkey") * 7).alias("idx"))
    return M.locate(idx, mixture(t)).select("idx", "dataset_id")


@query("w12_virtual_to_real", _MIX + """, tot AS (SELECT max(virtual_start + virtual_len) AS n FROM mix), i AS (SELECT o_orderkey * 13 AS idx, (o_orderkey * 13) % n AS k FROM orders, tot)
    SELECT idx, dataset_id, (k - virtual_start) % real_len AS real_index FROM i JOIN mix ON k >= virtual_start AND k < virtual_start + virtual_len""")
def _(t):
    idx = t["orders"].select((F.col("o_orderkey") * 13).alias("idx"))
    return M.virtual_to_real(idx, mixture(t)).select("idx", "dataset_id", "real_index")


@query("w13_materialize", _MIX + """ SELECT dataset_id, count(*) AS n, count(DISTINCT l_orderkey) AS orders, max(c.i) AS last_copy FROM mix JOIN lineitem ON l_suppkey = dataset_id, range(0, 1000000) AS c(i) WHERE c.i < repeat GROUP BY dataset_id""")
def _(t):
    samples = t["lineitem"].select(F.col("l_suppkey").alias("dataset_id"), "l_orderkey")
    m = M.materialize(M.repeat_factors(t["datasets"]), samples)
    return m.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.max("copy").alias("last_copy"))


@query("w14_frame_proportional", view("datasets") + f" SELECT dataset_id, family, {rs('real_len / (sum(real_len) OVER (PARTITION BY family) / CAST(4 AS DOUBLE))')} AS mix_ratio FROM datasets")
def _(t):
    d = M.frame_proportional(t["datasets"].drop("mix_ratio"), "family", 4.0, "real_len")
    return d.select("dataset_id", "family", r("mix_ratio").alias("mix_ratio"))


@query("w15_interleave", """WITH p AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS pos FROM orders),
    rt AS (SELECT * FROM (VALUES ('F', 3, 0), ('O', 2, 3), ('P', 1, 5)) AS x(s, k, off))
    SELECT o_orderkey, o_orderstatus, CAST((pos // k) * 6 + off + pos % k AS BIGINT) AS global_id FROM p JOIN rt ON s = o_orderstatus""")
def _(t):
    o = t["orders"].select("o_orderkey", "o_orderstatus")
    placed = position(o, ["o_orderstatus"], ["o_orderkey"], int_block("o_orderkey", 4096))
    return M.interleave(placed, {"F": 3, "O": 2, "P": 1}, "o_orderstatus").select("o_orderkey", "o_orderstatus", "global_id")


@query("w16_sample_sources", f"""SELECT o_orderkey, CASE WHEN {u_sql('o_orderkey', 11)} < CAST(0.5 AS DOUBLE) THEN 'robot' WHEN {u_sql('o_orderkey', 11)} < CAST(0.8 AS DOUBLE) THEN 'human' ELSE 'synthetic' END AS picked_source FROM orders""")
def _(t):
    return M.sample_sources(t["orders"].select("o_orderkey"), {"robot": 0.5, "human": 0.3, "synthetic": 0.2}, lcg_uniform("o_orderkey", 11))


@query("w38_dedup_keep_first", "SELECT p_name, p_brand, p_partkey, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) = 1")
def _(t):
    p = t["part"].select("p_name", "p_brand", "p_partkey", "p_type")
    return M.dedup_keep_first(p.withColumn("o", F.col("p_partkey")), ["p_name", "p_brand"], "o").drop("o")


@query("spec_overrides", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'full' ELSE 'train' END AS data_split, CASE WHEN p_size % 4 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END AS test_split_ratio FROM part""")
def _(t):
    specs = t["part"].select("p_partkey", F.when(F.col("p_size") % 3 == 0, "full").alias("data_split_override"), F.when(F.col("p_size") % 4 == 0, 0.1).alias("test_split_ratio_override"))
    return M.spec_overrides(specs).select("p_partkey", "data_split", "test_split_ratio")


@query("j14_lookup_excludes", """WITH s AS (SELECT p_name AS path, arg_min(concat('bad_', p_size), p_partkey) AS ex FROM part WHERE p_size % 2 = 0 GROUP BY p_name)
    SELECT p_partkey, coalesce(s.ex, '') AS excluded FROM part LEFT JOIN s ON s.path = p_name""")
def _(t):
    p = t["part"]
    specs = p.where("p_size % 2 = 0").select(F.col("p_name").alias("path"), F.col("p_partkey").alias("spec_order"), F.array(F.concat(F.lit("bad_"), "p_size")).alias("exclude_splits"))
    out = M.lookup_excludes(p.select("p_partkey", F.col("p_name").alias("path")), specs)
    return out.select("p_partkey", F.concat_ws(",", "exclude_splits").alias("excluded"))


@query("f14_select_datasets", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#2', 'Brand#17') UNION ALL SELECT -p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#2')")
def _(t):
    p = t["part"].select("p_partkey", "p_brand")
    a = M.select_datasets(p, ["Brand#2", "Brand#17"], ["Brand#2"], "p_brand")
    b = M.select_datasets(p, [], ["Brand#2"], "p_brand").withColumn("p_partkey", -F.col("p_partkey"))
    return a.unionByName(b)


_POS = view("shards") + ", p AS (SELECT shard_id, row_number() OVER (ORDER BY shard_id) - 1 AS i, count(*) OVER () AS n FROM shards)"


@query("w17_shard_export", _POS + """, x AS (SELECT shard_id, i + j * n AS spot FROM p, range(0, 8) AS g(j) WHERE i + j * n < ceil(n / CAST(24 AS DOUBLE)) * 24)
    SELECT shard_id, CAST(spot % 8 AS BIGINT) AS rank, CAST((spot // 8) % 3 AS BIGINT) AS worker, CAST((spot // 8) // 3 AS BIGINT) AS slot FROM x WHERE (spot // 8) // 3 >= 2""")
def _(t):
    return S.shard_export(t["shards"].select("shard_id"), "shard_id", 8, 3, True, resume=60, chunk_size=10)


@query("w20_rank_ranges", """WITH n AS (SELECT count(*) AS n FROM orders), k AS (SELECT i AS rank, n, n // 7 AS e, n % 7 AS rest FROM n, range(0, 7) AS g(i))
    SELECT rank, rank * e + least(rank, rest) AS range_start, rank * e + least(rank, rest) + e + CASE WHEN rank < rest THEN 1 ELSE 0 END AS range_end, false AS is_overflow FROM k""")
def _(t):
    return S.rank_ranges(t["orders"], 7)


@query("w20_rank_ranges_overflow", """WITH n AS (SELECT count(*) AS n FROM region), k AS (SELECT i AS rank, n, n // 8 AS e, n % 8 AS rest FROM n, range(0, 8) AS g(i)), b AS (SELECT *, rank * e + least(rank, rest) AS s FROM k)
    SELECT rank, CASE WHEN s >= n THEN 0 ELSE s END AS range_start, CASE WHEN s >= n THEN 1 ELSE s + e + CASE WHEN rank < rest THEN 1 ELSE 0 END END AS range_end, s >= n AS is_overflow FROM b""")
def _(t):
    return S.rank_ranges(t["region"], 8)


@query("w21_round_robin", _POS + " SELECT shard_id, i % 6 AS shard FROM p")
def _(t):
    return S.round_robin(t["shards"].select("shard_id"), 6, "shard_id")


@query("w22_pick_uniform", """WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
    k AS (SELECT CASE WHEN j = 99 THEN (SELECT count(*) FROM orders) - 1 ELSE CAST(floor(j * (((SELECT count(*) FROM orders) - 1) / CAST(99 AS DOUBLE))) AS BIGINT) END AS spot FROM range(0, 100) AS g(j))
    SELECT o_orderkey FROM p WHERE i IN (SELECT spot FROM k)""")
def _(t):
    return S.pick_indices(t["orders"].select("o_orderkey"), 100, "uniform", "o_orderkey")


@query("w22_pick_sequential", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def _(t):
    return S.pick_indices(t["orders"].select("o_orderkey"), 100, "sequential", "o_orderkey")


@query("w22_pick_random", f"SELECT o_orderkey FROM orders ORDER BY {u_sql('o_orderkey', 42)}, o_orderkey LIMIT 100")
def _(t):
    return S.pick_indices(t["orders"].select("o_orderkey"), 100, "random", "o_orderkey", lcg_uniform("o_orderkey", 42))


@query("w23_pick_episodes", f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {u_sql('o_orderkey', 42)}, o_orderkey) <= 2")
def _(t):
    return S.pick_episodes(t["orders"].select("o_custkey", "o_orderkey"), 2, lcg_uniform("o_orderkey", 42), ["o_custkey"], ["o_orderkey"])


@query("w32_duplicate_fractional", f"SELECT o_orderkey, CAST(c.i AS INTEGER) AS copy FROM orders, range(0, 3) AS c(i) WHERE c.i < 2 + CASE WHEN {u_sql('o_orderkey', 9)} <= CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END")
def _(t):
    return S.duplicate_fractional(t["orders"].select("o_orderkey"), 2.5, lcg_uniform("o_orderkey", 9))


@query("w33_concat_batches", """WITH b AS (SELECT o_orderkey // 10 AS batch_no, list(o_custkey ORDER BY o_orderkey) AS ids, min(o_orderpriority) AS label FROM orders GROUP BY 1), m AS (SELECT count(*) // 2 AS m FROM b),
    g AS (SELECT batch_no % m AS batch, flatten(list(ids ORDER BY batch_no)) AS ids, arg_min(label, batch_no) AS label FROM b, m GROUP BY 1)
    SELECT batch, len(ids) AS n, ids[1] AS head, ids[11] AS middle, label FROM g""")
def _(t):
    o = t["orders"].withColumn("batch_no", F.floor(F.col("o_orderkey") / 10).cast("long"))
    # A batch is a fixed run of ten rows, so its list is bounded by construction.
    b = o.groupBy("batch_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey"))), lambda s: s["o_custkey"]).alias("ids"), F.min("o_orderpriority").alias("label"))
    g = S.concat_batches(b, 2, "batch_no", ["ids"], ["label"])
    return g.select("batch", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("head"), F.get("ids", F.lit(10)).alias("middle"), "label")
