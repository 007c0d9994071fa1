"""Per-dimension statistics, drift and health of vector columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kinetable.functions.vectors import let
from kinetable.operators.ranking import first_rows
from kinetable.operators.skew import frequent_keys
from kinetable.session import staged

# Fixed thresholds of the health report (normalised actions are expected near N(0, 1)).
ACTIVE_STD = 1e-6
MEAN_LIMIT = 1.0
STD_LOW, STD_HIGH = 0.1, 5.0
OUTLIER_ABS = 10.0
OUTLIER_PCT = 0.5
DRIFT_TOL = 0.05

QUANTILE_ACCURACY = 10000
#: Rows whose values are put in order for one quantile of one group, at most.
RANGE_VALUES = 1 << 16
#: Cells of the first pass in a doubling of the value.
MAGNITUDE_STEPS = 32


def explode_dims(df: DataFrame, vector: str, keep: Sequence[str] = ()) -> DataFrame:
    """Long form: one row per vector element, as ``dim`` and ``value``."""
    return df.select(*keep, F.posexplode(vector).alias("dim", "value"))


def _magnitude(v: Column) -> Column:
    """Sign and binary logarithm in steps: never falls as ``v`` rises, and has no more than some hundred thousand values."""
    steps = F.rint(F.log2(F.abs(v)) * MAGNITUDE_STEPS) + 131072.0
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * steps)


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    aggs: Sequence[Column] = (),
    accuracy: int = QUANTILE_ACCURACY,
    lower: Sequence[str] = (),
    most: int = RANGE_VALUES,
    moments: bool = False,
) -> DataFrame:
    """Linear-interpolated (or, for names in ``lower``, lower-neighbour) quantiles per group, exact, without holding a group.

    Pass one counts each group's values by magnitude, with map-side combine; the counts name the cell that holds a rank
    and how many rows lie below it. Where a cell holds more than ``most`` rows, refining passes cut it in ``accuracy``
    even ranges and keep the one with the rank. The last pass tallies only the values inside the cells and reads off the
    two neighbouring order statistics. Cells out of order raise instead of guessing. ``aggs`` are taken in a scan of
    their own; ``moments`` adds n, mean, std, min and max from the counts' scan.
    """
    names = [f"_g{i}" for i in range(len(by))] or ["_g0"]
    keys = [F.col(b) for b in by] or [F.lit(0)]
    flat = df.withColumns(dict(zip(names, keys)))
    # A struct key treats null group values as equal in the joins below.
    key = F.struct(*names).alias("_key")
    keyed = flat.withColumn("_key", key)
    v = F.col(value).cast("double")
    counts = [F.count(v).alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi")]
    if moments:
        counts += [F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2")]
    cells = flat.groupBy(*names, _magnitude(v).alias("cell")).agg(*counts)
    cells = staged(cells.select(key, *[c for c in cells.columns if c not in names]), "quantile-cells")
    out = _merged_moments(cells, df.schema[value].dataType) if moments else cells.select("_key").distinct()
    if aggs:
        sums = flat.groupBy(*names).agg(*aggs)
        out = out.join(staged(sums.select(key, *[c for c in sums.columns if c not in names]), "quantile-sums"), "_key")
    n = F.sum("c").over(Window.partitionBy("_key"))
    at = {q: F.lit(p) * (F.col("_n") - 1) for q, p in probs.items()}
    ranks = [F.struct(F.lit(i).alias("i"), (F.floor(a).cast("double") if q in lower else a).alias("at")) for i, (q, a) in enumerate(at.items())]
    first = cells.where("c > 0").select("_key", "cell", "c", "lo", "hi", F.lit(0).cast("long").alias("below"), n.alias("_n"))
    wanted = staged(_wide(_narrowed(first.select("*", F.inline(F.array(*ranks)))), len(probs)), "quantile-ranges")
    wanted = _refined(keyed, v, wanted, len(probs), accuracy, most)
    if not wanted.where(_any_open(len(probs), 0)).isEmpty():
        wanted = _replaced(wanted, _narrowed(_cells(keyed, v, wanted, len(probs), 0, lambda x, lo, hi: x)), len(probs))
    picked = []
    for i, q in enumerate(probs):
        a, b, rank = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_at{i}")
        missed = F.raise_error(F.lit("quantile bracket missed")).cast("double")
        picked.append(F.when(_open(i, 0), missed).otherwise(a + (b - a) * (rank - F.floor(rank))).alias(q))
    out = out.join(wanted.select("_key", *picked), "_key", "left")
    return out.select(*[F.col(f"_key.{n}").alias(b) for n, b in zip(names, by)], *[c for c in out.columns if c != "_key"])


def _merged_moments(cells: DataFrame, kind) -> DataFrame:
    """n, mean, std, min and max per group; the scatter between cells is taken about the merged mean."""
    n = F.sum("c")
    mean = F.sum(F.col("mean") * F.col("c")).over(Window.partitionBy("_key")) / F.nullif(F.sum("c").over(Window.partitionBy("_key")), F.lit(0))
    shift = F.col("mean") - F.col("_m")
    std = F.sqrt(F.sum(F.col("m2") + F.col("c") * shift * shift) / F.nullif(n, F.lit(0)))
    flat = (F.min("lo") == F.max("hi")) & (F.abs(F.min("lo")) < float("inf"))
    return cells.withColumn("_m", mean).groupBy("_key").agg(
        n.alias("n"), F.max("_m").alias("mean"), F.when(flat, 0.0).otherwise(std).alias("std"),
        F.min("lo").cast(kind).alias("min"), F.max("hi").cast(kind).alias("max"),
    )


def _narrowed(cells: DataFrame) -> DataFrame:
    """The cell of each wanted rank ``at``: ``below`` rows before it, ``m`` rows inside from ``lo`` to ``hi``.

    Where the two neighbours of a rank lie in two cells, they are the end of one and the start of the other: ``m`` is zero.
    """
    w = Window.partitionBy("_key", "i").orderBy("cell")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranked = cells.select("*", (F.col("below") + F.sum("c").over(w)).alias("_upto"), before.alias("_before"))
    missed = F.raise_error(F.lit("quantile bracket missed"))
    lo = F.when(F.col("_before") >= F.col("lo"), missed.cast("double")).otherwise(F.col("lo"))
    cell = F.struct((F.col("_upto") - F.col("c")).alias("below"), lo.alias("lo"), "hi", F.col("c").alias("m"))

    def holds(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("c") <= rank) & (rank < F.col("_upto")), cell))

    found = ranked.groupBy("_key", "i", "at").agg(holds(F.floor("at")).alias("a"), holds(F.ceil("at")).alias("b"))
    apart = F.when(F.col("a").isNull() | F.col("b").isNull(), missed.cast("boolean")).otherwise(F.col("a.below") != F.col("b.below"))
    return found.withColumn("_apart", apart).select(
        "_key", "i", "at", F.col("a.below").alias("below"),
        F.when(F.col("_apart"), F.col("a.hi")).otherwise(F.col("a.lo")).alias("lo"),
        F.when(F.col("_apart"), F.col("b.lo")).otherwise(F.col("a.hi")).alias("hi"),
        F.when(F.col("_apart"), F.lit(0).cast("long")).otherwise(F.col("a.m")).alias("m"),
    )


_BRACKET = ("at", "below", "lo", "hi", "m")


def _wide(brackets: DataFrame, n_probs: int) -> DataFrame:
    """One row per group with the brackets of all ranks side by side."""
    pick = [F.max(F.when(F.col("i") == i, F.col(c))).alias(f"_{c}{i}") for i in range(n_probs) for c in _BRACKET]
    return brackets.groupBy("_key").agg(*pick)


def _replaced(wanted: DataFrame, brackets: DataFrame, n_probs: int) -> DataFrame:
    """``wanted`` with the new brackets where there are some."""
    names = [c for c in wanted.columns if c != "_key"]
    new = _wide(brackets, n_probs).select("_key", *[F.col(c).alias(f"_new{c}") for c in names])
    return wanted.join(new, "_key", "left").select("_key", *[F.coalesce(f"_new{c}", c).alias(c) for c in names])


def _open(i: int, most: int) -> Column:
    """Whether the bracket of rank ``i`` holds more than ``most`` rows of more than one value."""
    return (F.col(f"_m{i}") > most) & (F.col(f"_lo{i}") < F.col(f"_hi{i}"))


def _any_open(n_probs: int, most: int) -> Column:
    any_open = F.lit(False)
    for i in range(n_probs):
        any_open = any_open | _open(i, most)
    return any_open


def _cells(keyed: DataFrame, v: Column, wanted: DataFrame, n_probs: int, most: int, cell) -> DataFrame:
    """Counts, by ``cell(value, lo, hi)``, of the rows inside the brackets that hold more than ``most`` rows; only those leave the scan."""
    x = F.col("_v")
    any_inside, targets = F.lit(False), []
    for i in range(n_probs):
        inside = _open(i, most) & (x >= F.col(f"_lo{i}")) & (x <= F.col(f"_hi{i}"))
        any_inside = any_inside | inside
        targets.append(F.struct(F.lit(i).alias("i"), inside.alias("_in"), *[F.col(f"_{c}{i}").alias(c) for c in ("at", "below", "lo", "hi")]))
    met = keyed.where(v.isNotNull()).select("_key", v.alias("_v")).join(wanted.where(_any_open(n_probs, most)), "_key").where(any_inside)
    each = met.select("_key", "_v", F.inline(F.array(*targets))).where("_in")
    return each.groupBy("_key", "i", "at", "below", cell(x, F.col("lo"), F.col("hi")).alias("cell")).agg(
        F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def _refined(keyed: DataFrame, v: Column, wanted: DataFrame, n_probs: int, accuracy: int, most: int) -> DataFrame:
    """``wanted`` with brackets that hold no more than ``most`` rows, or one value only.

    A pass cuts the wide brackets in ``accuracy`` even ranges. The ends of a bracket fall in different ranges, so each pass narrows it.
    """
    while not wanted.where(_any_open(n_probs, most)).isEmpty():
        even = _cells(keyed, v, wanted, n_probs, most, lambda x, lo, hi: F.floor((x - lo) / (hi - lo) * accuracy))
        wanted = staged(_replaced(wanted, _narrowed(even), n_probs), "quantile-ranges")
    return wanted


def grouped_medians(
    df: DataFrame, by: Sequence[str], values: dict[str, Column], aggs: Sequence[Column] = (), limit: int = 100_000,
) -> DataFrame:
    """Exact medians of several columns for very many, mostly small groups.

    Groups up to ``limit`` rows, or up to a share of the rows that a shuffle partition holds anyway, are collected, all
    columns in one list, and sorted. The (rare) larger ones are found by one bounded sketch of frequent keys, without a shuffle, and go through
    :func:`exact_quantiles`; nothing of that path is planned when there are none.
    """
    large_keys = frequent_keys(df, by, limit)
    if not large_keys:
        return _small_medians(df, by, values, aggs)
    is_large = F.xxhash64(*by).isin(large_keys)
    rest = _small_medians(df.where(~is_large), by, values, aggs)
    large = df.where(is_large).withColumn("_k", F.struct(*by))
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("_name"), v.cast("double").alias("_value")) for n, v in values.items()]))
    med = exact_quantiles(large.select("_k", rows), ["_k", "_name"], "_value", {"_median": 0.5})
    wide = med.groupBy("_k").agg(*[F.max(F.when(F.col("_name") == n, F.col("_median"))).alias(n) for n in values])
    base = large.groupBy("_k").agg(*[F.first(b).alias(b) for b in by], *aggs)
    return rest.unionByName(base.join(wide, "_k", "inner").drop("_k"))


def _small_medians(df: DataFrame, by: Sequence[str], values: dict[str, Column], aggs: Sequence[Column]) -> DataFrame:
    """Medians as Spark's exact percentile gives them; one list for each group costs less than a table of counts for each column."""
    rows = F.collect_list(F.struct(*[v.cast("double").alias(n) for n, v in values.items()])).alias("_rows")

    def median(name: str) -> Column:
        return let(F.array_sort(F.filter(F.transform("_rows", lambda x: x[name]), lambda x: x.isNotNull())), middle)

    def middle(x: Column) -> Column:
        n = F.size(x)
        low, high = F.get(x, F.floor((n - 1) / 2).cast("int")), F.get(x, F.floor(n / 2).cast("int"))
        return F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)

    grouped = df.groupBy(*by).agg(*aggs, rows)
    return grouped.select(*[c for c in grouped.columns if c != "_rows"], *[median(n).alias(n) for n in values])


def approx_quantiles(value: str, probs: dict[str, float], accuracy: int = QUANTILE_ACCURACY) -> Column:
    """All quantiles of one sketch, as an array."""
    return F.percentile_approx(value, list(probs.values()), accuracy)


Q01_Q99 = {"q01": 0.01, "q99": 0.99}


def value_stats(
    long: DataFrame, by: Sequence[str], value: str = "value", approx: bool = False,
    probs: dict[str, float] | None = None, more: Sequence[Column] = (),
) -> DataFrame:
    """count/mean/std/min/max and quantiles of a long table, and ``more`` aggregates."""
    probs = Q01_Q99 if probs is None else probs
    kind = long.schema[value].dataType.typeName()
    if probs and not approx and kind in ("double", "float"):
        return exact_quantiles(long, by, value, probs, more, moments=True)
    aggs = [
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        *more,
    ]
    if not probs:
        return long.groupBy(*by).agg(*aggs)
    if not approx:
        return exact_quantiles(long, by, value, probs, aggs)
    rows = long.groupBy(*by).agg(*aggs, approx_quantiles(value, probs).alias("_q"))
    return rows.withColumns({n: F.get("_q", F.lit(i)) for i, n in enumerate(probs)}).drop("_q")


def vector_stats(
    df: DataFrame, vector: str, by: Sequence[str], approx: bool = False, probs: dict[str, float] | None = None
) -> DataFrame:
    """Six numbers per (group, dim). ``approx`` swaps exact quantiles for a sketch."""
    return value_stats(explode_dims(df, vector, by), [*by, "dim"], approx=approx, probs=probs)


def raw_column_stats(frames: DataFrame, cols: Sequence[str], by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Statistics of several vector columns at once, tagged by ``key``."""
    tagged = F.inline(
        F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("array<double>").alias("_vec")) for c in cols])
    )
    return vector_stats(frames.select(*by, tagged), "_vec", [*by, "key"], approx)


def _take(name: str):
    return lambda row: row[name]


def stats_vectors(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Long statistics to one row per group with a struct of arrays (bounded by the width)."""
    names = ("mean", "std", "min", "max", "q01", "q99")
    rows = F.array_sort(F.collect_list(F.struct("dim", *names)))
    packed = stats.groupBy(*by).agg(rows.alias("_rows"))
    return packed.select(
        *by, F.struct(*[F.transform("_rows", _take(n)).alias(n) for n in names]).alias("stats")
    )


def resolve_stats(modality: DataFrame, per_key: DataFrame, global_: DataFrame) -> DataFrame:
    """Statistics of every modality key: its own, else its slice of the source vector.

    ``modality(dataset_id, key, original_key, start, end)``; ``per_key`` and ``global_``
    are long statistics keyed by ``(dataset_id, key, dim)``. Keys with neither come
    back with ``origin = 'skipped'`` and no numbers.
    """
    names = ("mean", "std", "min", "max", "q01", "q99")
    have = per_key.select("dataset_id", "key").distinct().withColumn("_own", F.lit(True))
    tagged = modality.join(have, ["dataset_id", "key"], "left")
    own = tagged.where(F.col("_own")).join(
        per_key.select("dataset_id", "key", "dim", *names), ["dataset_id", "key"], "inner"
    )
    own = own.withColumn("origin", F.lit("per_key"))
    rest = tagged.where(F.col("_own").isNull()).withColumn(
        "_src", F.explode(F.sequence(F.col("start"), F.col("end") - 1))
    )
    source = global_.select(
        "dataset_id", F.col("key").alias("original_key"), F.col("dim").alias("_src"), *names
    )
    sliced = rest.join(source, ["dataset_id", "original_key", "_src"], "left").withColumn(
        "dim", F.col("_src") - F.col("start")
    )
    sliced = sliced.withColumn("origin", F.when(F.col("mean").isNull(), "skipped").otherwise("index_based"))
    cols = ["dataset_id", "key", "dim", "origin", *names]
    return own.select(*cols).unionByName(sliced.select(*cols))


def normalize_with(
    long: DataFrame, stats: DataFrame, modes: dict[str, str], by: Sequence[str] = ("dataset_id", "key", "dim"),
    value: str = "value", out: str = "normalized", inverse: bool = False,
) -> DataFrame:
    """Normalise a long table by equi-join on its statistics; ``modes`` is per key.

    Keys outside ``modes`` pass through. A key in ``modes`` without statistics is an error of the row that has it.
    """
    from kinetable.functions.vectors import denormalize_value, normalize_value

    names = ("mean", "std", "min", "max", "q01", "q99")
    right = stats.select(*by, *[F.col(n).alias(f"_s_{n}") for n in names])
    joined = long.join(right.withColumn("_s_found", F.lit(True)), list(by), "left")
    s = {n: F.col(f"_s_{n}") for n in names}
    fn = denormalize_value if inverse else normalize_value
    result = None
    for key, mode in modes.items():
        hit = F.col("key") == key
        missing = F.raise_error(F.concat_ws(" ", F.lit("no statistics for"), F.concat_ws("/", *[F.col(b).cast("string") for b in by]))).cast("double")
        v = F.when(F.col("_s_found"), fn(F.col(value), s, mode)).otherwise(missing)
        result = F.when(hit, v) if result is None else result.when(hit, v)
    return joined.withColumn(out, result.otherwise(F.col(value))).drop("_s_found", *[f"_s_{n}" for n in names])


def episode_stats(frames: DataFrame, by: Sequence[str] = ("dataset_id", "episode_index")) -> DataFrame:
    """Closed-form statistics of the bookkeeping columns of each episode.

    ``index`` runs ``first..last``; ``episode_index`` and ``task_index`` are constant.
    """
    g = frames.groupBy(*by).agg(
        F.min("index").alias("index_min"), F.max("index").alias("index_max"), F.min("task_index").alias("task_value")
    )
    n = (F.col("index_max") - F.col("index_min") + 1).cast("double")
    return (
        g.withColumn("index_mean", (F.col("index_min") + F.col("index_max")) / 2.0)
        .withColumn("index_std", F.when(n > 1, F.sqrt((n * n - 1.0) / 12.0)).otherwise(0.0))
        .withColumn("task_std", F.lit(0.0))
    )


def describe_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Global row (``dim = -1``) plus one row per dim, with five quantiles."""
    long = explode_dims(df, vector)
    both = long.select(F.explode(F.array(F.lit(-1), F.col("dim"))).alias("dim"), "value")
    probs = {"q01": 0.01, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q99": 0.99}
    return value_stats(both, ["dim"], probs=probs)


def active_dims(stats: DataFrame, eps: float = ACTIVE_STD) -> DataFrame:
    return stats.withColumn("status", F.when(F.col("std") > eps, "active").otherwise("padded"))


def dim_health(
    df: DataFrame, vector: str, by: Sequence[str] = (),
    mean_limit: float = MEAN_LIMIT, std_low: float = STD_LOW, std_high: float = STD_HIGH,
    outlier_abs: float = OUTLIER_ABS, outlier_pct: float = OUTLIER_PCT, eps: float = ACTIVE_STD,
) -> DataFrame:
    """Per-dim numbers and status: ``padded``, ``OK`` or ``WARN: ...`` listing every broken limit."""
    long = explode_dims(df, vector, by)
    outliers = (F.avg((F.abs("value") > outlier_abs).cast("double")) * 100.0).alias("_out")
    g = value_stats(long, [*by, "dim"], more=[outliers])
    active = F.col("std") > eps
    warn = F.concat_ws(
        "; ",
        F.when(F.abs("mean") >= mean_limit, f"|mean|>{mean_limit}"),
        F.when((F.col("std") <= std_low) | (F.col("std") >= std_high), f"std<{std_low} or >{std_high}"),
        F.when(F.col("_out") > outlier_pct, F.format_string("%.1f%% outliers", F.col("_out"))),
    )
    status = F.when(~active, "padded").when(warn == "", "OK").otherwise(F.concat(F.lit("WARN: "), warn))
    return g.withColumn("outlier_pct", F.when(active, F.col("_out")).otherwise(0.0)).withColumn("status", status).drop("_out")


def subset_share(df: DataFrame, subset: str, vector: str) -> DataFrame:
    """Samples, share, mean and std per subset; a null subset is ``<unknown>``.

    Moments are merged, never differences of large sums, and combined before the exchange, so the exploded
    elements stay in their tasks. A sample without elements counts as a sample only. One scan.
    """
    named = df.select(F.coalesce(F.col(subset).cast("string"), F.lit("<unknown>")).alias("subset"), F.posexplode_outer(vector).alias("_at", "_v"))
    g = named.groupBy("subset").agg(
        F.sum(F.when(F.coalesce("_at", F.lit(0)) == 0, 1).otherwise(0)).alias("samples"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))
    share = 100.0 * F.col("samples") / F.sum("samples").over(Window.partitionBy(F.lit(0)))
    return g.select("subset", "samples", share.alias("pct"), "mean", "std")


def _moments(df: DataFrame, vector: str, tag: str) -> DataFrame:
    return explode_dims(df, vector).groupBy("dim").agg(
        F.avg("value").alias(f"mean_{tag}"), F.stddev_pop("value").alias(f"std_{tag}"), F.count("value").alias(f"n_{tag}")
    )


def dim_drift(a: DataFrame, b: DataFrame, vector: str) -> DataFrame:
    """Per-dim absolute differences of mean and std; a dim of one table only has none, and a ``reason``."""
    joined = _moments(a, vector, "a").join(_moments(b, vector, "b"), "dim", "full")
    joined = joined.withColumn("reason", F.when(F.col("n_a").isNull(), "only in b").when(F.col("n_b").isNull(), "only in a"))
    return joined.withColumn("mean_diff", F.abs(F.col("mean_a") - F.col("mean_b"))).withColumn(
        "std_diff", F.abs(F.col("std_a") - F.col("std_b"))
    )


def compare_distributions(
    a: DataFrame, b: DataFrame, vector: str, order: str, matched: bool = False, tol: float = DRIFT_TOL,
) -> DataFrame:
    """Worst and average drift over dims. ``matched`` uses the first N samples of both. Dims of one side only are
    counted in ``unmatched_dims`` and make the status WARN."""
    from kinetable.operators.ranking import ordered_position

    if matched:
        n = min(a.count(), b.count())
        a, b = (ordered_position(x, [order], "_i").where(F.col("_i") < n) for x in (a, b))
    d = dim_drift(a, b, vector)

    def argmax(col: str) -> Column:
        # The first dim wins ties.
        return F.max_by("dim", F.struct(F.col(col), -F.col("dim")))

    g = d.agg(
        F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"),
        F.max("mean_diff").alias("max_mean_diff"), argmax("mean_diff").alias("max_mean_dim"),
        F.max("std_diff").alias("max_std_diff"), argmax("std_diff").alias("max_std_dim"),
        F.avg("mean_diff").alias("avg_mean_diff"), F.avg("std_diff").alias("avg_std_diff"),
        F.count("reason").alias("unmatched_dims"),
    )
    ok = (F.col("max_mean_diff") < tol) & (F.col("max_std_diff") < tol) & (F.col("unmatched_dims") == 0)
    return g.withColumn("status", F.when(ok, "OK").otherwise("WARN"))


def health_verdict(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All named checks must pass."""
    return checks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed"),
        F.bool_and("passed").alias("healthy"),
    )


def sampled_action_stats(
    steps: DataFrame, frames: DataFrame, vector: str, episodes: int, draw: Column, by: Sequence[str],
    base: str = "base_index", order: str = "frame_index", floor: float = 1e-6,
) -> DataFrame:
    """Mean and floored std per dim over sampled episodes that have a frame 0."""
    from kinetable.operators.sampling import pick_episodes

    usable = steps.where(F.col(base) == 0).select(*by).distinct()
    picked = first_rows(usable.withColumn("_u", draw), episodes, ["_u", *by]).drop("_u")
    rows = steps.join(picked, list(by), "left_semi").join(
        frames.select(*by, F.col(order).alias(base), vector), [*by, base], "inner"
    )
    return explode_dims(rows, vector).groupBy("dim").agg(
        F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(floor)).alias("std")
    )


def frequent_patterns(actions: DataFrame, vector: str, draw: Column, k: int = 10, top: int = 3, iters: int = 30, tol: float = 1e-8) -> DataFrame:
    """Centroids and shares of the ``top`` largest of ``k`` clusters (Lloyd's steps).

    The first centroids are the ``k`` distinct vectors of the least draws, in that order, so the result is repeatable. A
    step is one aggregate over the staged vectors; ``k`` centroids come to the driver and go into the next step as
    constants. A cluster that loses all its vectors keeps its centroid. Ties go to the lower cluster.
    """
    rows = staged(actions.select(F.col(vector).cast("array<double>").alias("_v"), draw.alias("_u")).where("_v IS NOT NULL"), "patterns")
    first = first_rows(rows.groupBy("_v").agg(F.min("_u").alias("_u")), k, ["_u", "_v"]).orderBy("_u", "_v").collect()
    centres = [list(r["_v"]) for r in first]

    def nearest() -> Column:
        far = lambda c: F.aggregate(F.zip_with("_v", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        listed = F.from_json(F.lit(json.dumps(centres)), "array<array<double>>")
        return F.array_min(F.transform(listed, lambda c, i: F.named_struct(F.lit("d"), far(c), F.lit("i"), i)))["i"]

    for _ in range(iters if centres else 0):
        means = rows.select(nearest().alias("cluster"), F.posexplode("_v").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x")).collect()
        moved = [list(c) for c in centres]
        for cluster, dim, x in means:
            moved[cluster][dim] = x
        shift = max(sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(centres, moved))
        centres = moved
        if shift <= tol * tol:
            break
    sizes = rows.groupBy(nearest().alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).scalar()
    ranked = sizes.withColumn("share", F.col("size") / total).orderBy(F.desc("size"), "cluster").limit(top)
    return ranked.withColumn("centroid", F.get(F.from_json(F.lit(json.dumps(centres)), "array<array<double>>"), F.col("cluster")))


# --- incremental refresh ---------------------------------------------------------


def partial_stats(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Mergeable partial moments: n, mean, M2, min, max."""
    n = F.count(value)
    return long.groupBy(*by).agg(
        n.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("m2"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def merge_partials(partials: DataFrame, by: Sequence[str]) -> DataFrame:
    """Combine partial moments; the scatter between parts is taken about the merged mean."""
    n = F.sum("n")
    means = partials.groupBy(*by).agg((F.sum(F.col("mean") * F.col("n")) / n).alias("_m"))
    moved = partials.where("n > 0").join(means, list(by), "inner")
    shift = F.col("mean") - F.col("_m")
    g = moved.groupBy(*by).agg(
        n.alias("n"), F.max("_m").alias("mean"), F.sum(F.col("m2") + F.col("n") * shift * shift).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"),
    )
    return g.withColumn("std", F.sqrt(F.col("m2") / F.col("n")))
