"""Dataset checks: correspondence, set and multiset differences, schema diffs, re-indexing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinetable.functions.vectors import within_tolerance
from kinetable.operators.ranking import in_ranges, ordered_position, position, running_sum
from kinetable.operators.skew import heavy_keys, split_join

# Fixed rules of the schema comparison.
IMAGE_PREFIX = "observation.images."
INFO_STRUCTURAL = ("codebase_version", "robot_type", "fps", "chunks_size", "data_path", "video_path")
INFO_CONTENT = ("total_episodes", "total_frames", "total_tasks", "total_videos", "total_chunks", "splits")
FEATURE_FIELDS = ("dtype", "shape", "names")
MODALITY_FIELDS = ("start", "end", "rotation_type", "absolute", "dtype", "original_key")
AXIS_SYNONYMS = {
    "h": "height", "height": "height", "w": "width", "width": "width",
    "c": "channel", "channel": "channel", "channels": "channel",
}
STRICT_FIELDS = ("total_episodes", "total_frames", "fps")
INFO_FIELDS = ("video_shape", "n_cameras", "total_videos", "robot_type")


# --- membership --------------------------------------------------------------------


def _sides(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key with a flag per side; a union and one combinable aggregate."""
    left = a.select(*key).withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0))
    right = b.select(*key).withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    return left.unionByName(right).groupBy(*key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))


def orphans(left: DataFrame, right: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys present on one side only, with ``missing_in`` naming the other side."""
    key = [key] if isinstance(key, str) else list(key)
    side = F.when(F.col("_b") == 0, "right").otherwise("left")
    return _sides(left, right, key).where(F.col("_a") != F.col("_b")).select(*key, side.alias("missing_in"))


def set_diff(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Both set differences, tagged ``a_only`` / ``b_only``."""
    key = [key] if isinstance(key, str) else list(key)
    tag = F.when(F.col("_b") == 0, "a_only").otherwise("b_only")
    return _sides(a, b, key).where(F.col("_a") != F.col("_b")).select(*key, tag.alias("side"))


def multiset_diff(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values whose multiplicities differ, with the surplus on each side."""
    left = a.select(col).withColumn("_d", F.lit(1))
    right = b.select(col).withColumn("_d", F.lit(-1))
    d = left.unionByName(right).groupBy(col).agg(F.sum("_d").alias("_d")).where("_d != 0")
    return d.select(
        col, F.greatest(F.col("_d"), F.lit(0)).alias("a_surplus"), F.greatest(-F.col("_d"), F.lit(0)).alias("b_surplus")
    )


def pending(work: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Work not finished yet."""
    key = [key] if isinstance(key, str) else list(key)
    return work.join(done.select(*key), key, "left_anti")


def _one_per_key(df: DataFrame, key: str) -> DataFrame:
    """A stream's rows, raising on a repeated key; its shuffle is the one the join needs."""
    rest = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    repeated = F.raise_error(F.concat(F.lit("key occurs twice in a stream: "), F.col(key).cast("string")))
    return g.where(F.when(F.col("_n") > 1, repeated.cast("boolean")).otherwise(True)).drop("_n")


def assemble_samples(streams: dict[str, DataFrame], key: str = "key") -> DataFrame:
    """Join sample parts on their key, keeping keys that every stream has.

    Keys index their stream, so a repeated one is an error, not a product of rows.
    """
    out = None
    for df in streams.values():
        part = _one_per_key(df, key)
        out = part if out is None else out.join(part, key, "inner")
    return out


def missing_parts(streams: dict[str, DataFrame], key: str = "key") -> DataFrame:
    """Keys that some stream lacks, one row per (key, stream)."""
    tagged = None
    for i, df in enumerate(streams.values()):
        part = df.select(key).withColumn("_bit", F.lit(1 << i))
        tagged = part if tagged is None else tagged.unionByName(part)
    have = tagged.groupBy(key).agg(F.bit_or("_bit").alias("_have"))
    lacking = [F.when(F.col("_have").bitwiseAND(1 << i) == 0, F.lit(n)) for i, n in enumerate(streams)]
    return have.where(F.col("_have") != (1 << len(streams)) - 1).select(
        key, F.explode(F.array_compact(F.array(*lacking))).alias("stream")
    )


def zip_streams(streams: dict[str, DataFrame], pos: str = "pos") -> DataFrame:
    """Positional zip: parts are paired by position, stopping at the shortest stream."""
    return assemble_samples(streams, pos)


def pair_by_stem(images: DataFrame, prompts: DataFrame, path: str = "path", prompt_path: str = "prompt_path") -> DataFrame:
    """Pair images with prompt files by stem, falling back to a doubled dot in the name."""
    stem = F.regexp_replace(path, r"\.(jpg|png)$", "")
    left = images.withColumn("_one", F.concat(stem, F.lit(".txt"))).withColumn("_two", F.concat(stem, F.lit("..txt")))
    one = prompts.select(F.col(prompt_path).alias("_one"), F.col("prompt").alias("_p1"))
    two = prompts.select(F.col(prompt_path).alias("_two"), F.col("prompt").alias("_p2"))
    joined = left.join(one, "_one", "left").join(two, "_two", "left")
    return joined.withColumn("prompt", F.coalesce("_p1", "_p2")).drop("_one", "_two", "_p1", "_p2")


def missing_fields(df: DataFrame, required: Sequence[str], present: Column, out: str = "missing") -> DataFrame:
    """Required names absent from an array column of present names."""
    want = F.array(*[F.lit(r) for r in required])
    return df.withColumn(out, F.array_except(want, present))


def identity_check(a: DataFrame, b: DataFrame, key: str, vector: str, rtol: float = 1e-4, atol: float = 1e-5) -> DataFrame:
    """Row-wise vector identity of two tables: ``ok``, ``shape`` or ``value``, or the one side that has the key."""
    right = b.select(key, F.col(vector).alias("_live"), F.lit(True).alias("_right"))
    j = a.select(key, vector, F.lit(True).alias("_left")).join(right, key, "full")
    same_len = F.size(vector) == F.size("_live")
    gap = F.array_max(F.zip_with(vector, "_live", lambda x, y: F.abs(x - y)))
    return j.select(
        key,
        F.when(F.col("_right").isNull(), "only cached").when(F.col("_left").isNull(), "only live").when(~same_len, "shape").when(within_tolerance(F.col(vector), F.col("_live"), rtol, atol), "ok")
        .otherwise("value").alias("result"),
        F.when(same_len, gap).alias("max_abs_diff"),
    )


def whitelist_by_token(episodes: DataFrame, texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Episodes whose path holds a ``YYYYMMDD-HHMMSS-UUUUUU`` token listed in the texts."""
    token = r"(\d{8}-\d{6}-\d{6})"
    listed = texts.select(F.explode(F.regexp_extract_all(text, F.lit(token), 1)).alias("ts_id")).distinct()
    tagged = episodes.withColumn("ts_id", F.regexp_extract(path, token, 1)).where("ts_id != ''")
    return tagged.join(listed, "ts_id", "left_semi")


def stable_order(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.orderBy(*cols)


def top_k(df: DataFrame, col: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """Largest ``k`` rows; Spark keeps a bounded heap per task."""
    return df.orderBy(F.desc(col), *ties).limit(k)


def length_mismatch(episodes: DataFrame, a: str = "n_kin_source", b: str = "n_img_source", kept: str = "num_frames",
                    by: Sequence[str] = ()) -> DataFrame:
    """Mismatched episodes, frames dropped and their share of the source."""
    gap = F.abs(F.col(a) - F.col(b))
    g = episodes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(gap != 0).alias("mismatched"),
        F.sum(gap).alias("dropped"), F.sum(kept).alias("_kept"),
    )
    return g.withColumn(
        "dropped_pct", 100.0 * F.col("dropped") / F.greatest(F.lit(1), F.col("_kept") + F.col("dropped"))
    ).drop("_kept")


def worst_mismatches(episodes: DataFrame, top: int = 5, a: str = "n_kin_source", b: str = "n_img_source",
                     ties: Sequence[str] = ()) -> DataFrame:
    gap = episodes.withColumn("drop_frames", F.abs(F.col(a) - F.col(b))).where("drop_frames > 0")
    return top_k(gap, "drop_frames", top, ties)


# --- merging -------------------------------------------------------------------------


def merge_reindex(shards: DataFrame, order: str = "orig_idx", task: str = "instruction", length: str = "length") -> DataFrame:
    """Global episode ids, frame offsets and first-seen task ids in discovery order.

    Episodes without instruction share one task of null text. An instruction that most episodes have is dealt out over
    several tasks where it meets its id.
    """
    cut = in_ranges(shards, [order])
    placed = position(cut, [], [order], F.col("_range"), "episode_index")
    framed = running_sum(placed, F.col(length), [], [order], F.col("_range"), "frame_offset").drop("_range")
    first = cut.groupBy(task).agg(F.min(order).alias("_first"))
    tasks = ordered_position(first, ["_first"], "task_index").drop("_first")
    return split_join(framed, tasks.select(task, "task_index"), [task], spread=F.xxhash64(order), heavy=heavy_keys(cut, [task]))


# --- reports ---------------------------------------------------------------------------


def reconcile(info: DataFrame, episodes: DataFrame, files: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Declared totals against summed episode lengths and counted files."""
    eps = episodes.groupBy(key).agg(F.count(F.lit(1)).alias("listed_episodes"), F.sum("length").alias("summed_frames"))
    found = files.groupBy(key).agg(F.count(F.lit(1)).alias("file_count"))
    j = info.join(eps, key, "left").join(found, key, "left").na.fill(0, ["listed_episodes", "summed_frames", "file_count"])
    return j.withColumn("episodes_ok", (F.col("total_episodes") == F.col("listed_episodes")) & (F.col("total_episodes") == F.col("file_count"))).withColumn(
        "frames_ok", F.col("total_frames") == F.col("summed_frames")
    )


def sample_length_check(a: DataFrame, b: DataFrame, k: int, draw: Column, by: Sequence[str], episode: str) -> DataFrame:
    """Sampled episodes: the converted length must be the shorter of its source streams.

    ``a`` holds source stream lengths (``n_kin_source``, ``n_img_source``), ``b`` the
    converted frames, of which only the id columns are read.
    """
    from kinetable.operators.sampling import pick_episodes

    picked = pick_episodes(a, k, draw, by, [episode])
    counts = b.join(picked.select(*by, episode), [*by, episode], "left_semi").groupBy(*by, episode).agg(
        F.count(F.lit(1)).alias("actual")
    )
    j = picked.join(counts, [*by, episode], "left").na.fill(0, ["actual"])
    return j.withColumn("expected", F.least("n_kin_source", "n_img_source")).withColumn(
        "length_ok", F.col("expected") == F.col("actual")
    )


def canonical_key(c: Column | str) -> Column:
    """Dotted and underscored camera names become the same key."""
    c = F.col(c) if isinstance(c, str) else c
    tail = F.substring(c, F.lit(len(IMAGE_PREFIX) + 1), F.length(c))
    return F.when(c.startswith(IMAGE_PREFIX), F.concat(F.lit(IMAGE_PREFIX), F.replace(tail, F.lit("."), F.lit("_")))).otherwise(c)


def _flat_names(c: Column) -> Column:
    """``[["x","y"]]`` to ``["x","y"]`` on JSON text."""
    inner = F.regexp_replace(c, r"^\s*\[\s*(\[[^\[\]]*\])\s*\]\s*$", "$1")
    return F.regexp_replace(inner, r"\s+", "")


def _axis_names(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in AXIS_SYNONYMS.items() for x in kv])
    names = F.from_json(c, "array<string>")
    return F.to_json(F.transform(names, lambda n: F.coalesce(F.try_element_at(table, n), n)))


def feature_severity(field: Column, ref: Column, test: Column, is_video: Column, strict: bool = False) -> Column:
    same = ref.eqNullSafe(test)
    if strict:
        return F.when(same, "OK").otherwise("ERROR")
    alike = (_flat_names(ref) == _flat_names(test)) | (is_video & (_axis_names(_flat_names(ref)) == _axis_names(_flat_names(test))))
    return F.when(same, "OK").when((field == "names") & F.coalesce(alike, F.lit(False)), "INFO").otherwise("ERROR")


def diff_features(ref: DataFrame, test: DataFrame, strict: bool = False) -> DataFrame:
    """Feature tables ``(key, dtype, shape, names)`` compared field by field.

    Features pair by canonical key unless ``strict``. One row per field plus one INFO
    row for features on one side only and for pairs spelled differently. ``shape`` and
    ``names`` are JSON text.
    """
    canon = F.col("key") if strict else canonical_key("key")

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(canon.alias("canon"), F.col("key").alias(f"{tag}_key"), *[F.col(f).alias(f"{tag}_{f}") for f in FEATURE_FIELDS])

    j = side(ref, "ref").join(side(test, "test"), "canon", "full_outer")
    both = F.col("ref_key").isNotNull() & F.col("test_key").isNotNull()
    is_video = (F.col("ref_dtype") == "video") & (F.col("test_dtype") == "video")
    fields = F.when(
        both,
        F.array(*[
            F.struct(F.lit(f).alias("field"), F.col(f"ref_{f}").alias("ref_value"), F.col(f"test_{f}").alias("test_value"))
            for f in FEATURE_FIELDS
        ]),
    )
    presence = F.when(
        ~both | (F.col("ref_key") != F.col("test_key")),
        F.array(F.struct(F.lit("key").alias("field"), F.col("ref_key").alias("ref_value"), F.col("test_key").alias("test_value"))),
    )
    empty = F.array().cast("array<struct<field:string,ref_value:string,test_value:string>>")
    rows = F.concat(F.coalesce(presence, empty), F.coalesce(fields, empty))
    flat = j.select("canon", is_video.alias("_video"), F.explode(rows).alias("_r")).select("canon", "_video", "_r.*")
    sev = F.when(F.col("field") == "key", "INFO").otherwise(
        feature_severity(F.col("field"), F.col("ref_value"), F.col("test_value"), F.coalesce("_video", F.lit(False)), strict)
    )
    return flat.withColumn("severity", sev).drop("_video")


def severity_info(field: Column, ref: Column, test: Column, strict: bool = False,
                  compatible: Sequence[tuple[str, str]] = ()) -> Column:
    """Severity of a dataset-level field. ``compatible`` lists interchangeable robot types."""
    same = ref.eqNullSafe(test)
    twins = F.lit(False)
    for a, b in compatible:
        twins = twins | ((ref == a) & (test == b)) | ((ref == b) & (test == a))
    out = F.when(same, "OK").when(field.isin(*INFO_CONTENT), "INFO")
    if not strict:
        out = out.when((field == "robot_type") & F.coalesce(twins, F.lit(False)), "INFO")
    return out.when(field == "codebase_version", "WARN").otherwise("ERROR")


def severity_modality(field: Column, ref: Column, test: Column, strict: bool = False) -> Column:
    """Severity of a modality field: slice bounds are errors, optional omissions only noted."""
    bound = field.isin("start", "end")
    out = F.when(ref.eqNullSafe(test), "OK")
    if not strict:
        out = out.when(~bound & (ref.isNull() != test.isNull()), "INFO")
        out = out.when((field == "original_key") & F.coalesce(canonical_key(ref) == canonical_key(test), F.lit(False)), "INFO")
    return out.when(bound, "ERROR").otherwise("WARN")


def severity(diffs: DataFrame, strict: bool = False, compatible: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Add severities to long diffs ``(scope, field, ref_value, test_value)``."""
    f, r, t = F.col("field"), F.col("ref_value"), F.col("test_value")
    sev = F.when(F.col("scope") == "info", severity_info(f, r, t, strict, compatible)).otherwise(
        severity_modality(f, r, t, strict)
    )
    return diffs.withColumn("severity", sev)


def parquet_schema_diff(ref: DataFrame, test: DataFrame) -> DataFrame:
    """Column-by-column diff of two table schemas (metadata only)."""
    spark = ref.sparkSession

    def rows(df: DataFrame):
        return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]

    a = spark.createDataFrame(rows(ref), "column string, ref_value string")
    b = spark.createDataFrame(rows(test), "column string, test_value string")
    j = a.join(b, "column", "full_outer")
    sev = F.when(F.col("ref_value").eqNullSafe(F.col("test_value")), "OK").when(
        F.col("ref_value").isNull() | F.col("test_value").isNull(), "INFO"
    ).otherwise("ERROR")
    return j.withColumn("severity", sev)


def schema_report(features: DataFrame, info_diffs: DataFrame, strict: bool = False,
                  compatible: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Findings per scope and severity over feature and field diffs."""
    a = features.select(F.lit("features").alias("scope"), "severity")
    b = severity(info_diffs, strict, compatible).select("scope", "severity")
    return a.unionByName(b).groupBy("scope", "severity").agg(F.count(F.lit(1)).alias("findings"))


def compare_versions(lo: DataFrame, hi: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Two summaries per dataset, field by field: strict, informational or warning.

    Summaries carry the strict and informational fields, ``total_tasks``,
    ``n_parquet_files`` and ``n_video_files``. Missing numbers compare as different. A dataset of one
    side only gets one row, field ``dataset``, severity ERROR.
    """
    fields = [*STRICT_FIELDS, "total_tasks", *INFO_FIELDS]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(key, *[F.col(f).alias(f"{tag}_{f}") for f in df.columns if f != key], F.lit(tag).alias(f"_{tag}"))

    j = side(lo, "lo").join(side(hi, "hi"), key, "full")
    alone = F.array(F.struct(F.lit("dataset").alias("field"), F.col("_lo").alias("lo_value"), F.col("_hi").alias("hi_value")))
    rows = [
        F.struct(F.lit(f).alias("field"), F.col(f"lo_{f}").cast("string").alias("lo_value"), F.col(f"hi_{f}").cast("string").alias("hi_value"))
        for f in fields
    ]
    for tag in ("lo", "hi"):
        rows.append(F.struct(F.lit(f"{tag}.parquet_files").alias("field"), F.col(f"{tag}_n_parquet_files").cast("string").alias("lo_value"),
                             F.col(f"{tag}_total_episodes").cast("string").alias("hi_value")))
        rows.append(F.struct(F.lit(f"{tag}.video_files").alias("field"), F.col(f"{tag}_n_video_files").cast("string").alias("lo_value"),
                             (F.col(f"{tag}_n_cameras") * F.col(f"{tag}_total_episodes")).cast("string").alias("hi_value")))
    paired = F.col("_lo").isNotNull() & F.col("_hi").isNotNull()
    long = j.select(key, F.inline(F.when(paired, F.array(*rows)).otherwise(alone)))
    same = F.col("lo_value").eqNullSafe(F.col("hi_value"))
    sev = (
        F.when(F.col("field").isin(*INFO_FIELDS), "INFO").when(same, "OK")
        .when(F.col("field") == "total_tasks", "WARN").otherwise("ERROR")
    )
    return long.withColumn("severity", sev)


def version_lengths(lo: DataFrame, hi: DataFrame, key: str = "dataset_id", length: str = "length") -> DataFrame:
    """Per dataset: unmatched episode lengths on each side (multiset comparison)."""
    a = lo.select(key, length).withColumn("_d", F.lit(1))
    b = hi.select(key, length).withColumn("_d", F.lit(-1))
    d = a.unionByName(b).groupBy(key, length).agg(F.sum("_d").alias("_d"))
    g = d.groupBy(key).agg(
        F.sum(F.greatest(F.col("_d"), F.lit(0))).alias("lo_unmatched"), F.sum(F.greatest(-F.col("_d"), F.lit(0))).alias("hi_unmatched")
    )
    same = (F.col("lo_unmatched") == 0) & (F.col("hi_unmatched") == 0)
    return g.withColumn("severity", F.when(same, "OK").otherwise("ERROR"))


def stats_guard(stats: DataFrame, registry: DataFrame, strict: bool = False) -> DataFrame:
    """Stamped stride of statistics against the registry: ok, warning or error.

    With ``strict`` an error row raises when it is read.
    """
    j = stats.join(registry, "embodiment", "left")
    level = (
        F.when(F.col("timestep_interval").isNull(), "warning")
        .when(F.col("stride").isNotNull() & (F.col("timestep_interval") != F.col("stride")), "error")
        .otherwise("ok")
    )
    if strict:
        level = F.when(level == "error", F.raise_error(F.concat(F.lit("stride mismatch: "), F.col("embodiment"))).cast("string")).otherwise(level)
    return j.withColumn("guard", level)
