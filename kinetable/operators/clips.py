"""Clip windowing, fps and duration filters, frame selection and resize plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values: (width, height) per resolution and aspect ratio, for images and for videos.
IMAGE_SIZES = {
    "1080": {"1,1": (1024, 1024), "4,3": (1440, 1056), "3,4": (1056, 1440), "16,9": (1920, 1056), "9,16": (1056, 1920)},
    "1024": {"1,1": (1024, 1024), "4,3": (1168, 880), "3,4": (880, 1168), "16,9": (1360, 768), "9,16": (768, 1360)},
    "720": {"1,1": (960, 960), "4,3": (960, 704), "3,4": (704, 960), "16,9": (1280, 704), "9,16": (704, 1280)},
    "512": {"1,1": (512, 512), "4,3": (640, 512), "3,4": (512, 640), "16,9": (640, 384), "9,16": (384, 640)},
    "480": {"1,1": (480, 480), "4,3": (640, 480), "3,4": (480, 640), "16,9": (768, 432), "9,16": (432, 768)},
    "480p": {"1,1": (640, 640), "4,3": (640, 480), "3,4": (480, 640), "16,9": (832, 480), "9,16": (480, 832)},
    "720robocasa": {"1,1": (720, 720), "4,3": (960, 720), "3,4": (720, 960), "16,9": (1280, 720), "9,16": (720, 1280)},
    "256": {"1,1": (256, 256), "4,3": (320, 256), "3,4": (256, 320), "16,9": (320, 192), "9,16": (192, 320)},
}
VIDEO_SIZES = {
    "1080": {"1,1": (1024, 1024), "4,3": (1440, 1056), "3,4": (1056, 1440), "16,9": (1920, 1056), "9,16": (1056, 1920)},
    "1024": {"1,1": (1024, 1024), "4,3": (1280, 1024), "3,4": (1024, 1280), "16,9": (1280, 768), "9,16": (768, 1280)},
    "720": {"1,1": (960, 960), "4,3": (960, 704), "3,4": (704, 960), "16,9": (1280, 704), "9,16": (704, 1280)},
    "512": {"1,1": (512, 512), "4,3": (640, 512), "3,4": (512, 640), "16,9": (640, 384), "9,16": (384, 640)},
    "480": {"1,1": (480, 480), "4,3": (640, 480), "3,4": (480, 640), "16,9": (768, 432), "9,16": (432, 768)},
    "480p": {"1,1": (640, 640), "4,3": (640, 480), "3,4": (480, 640), "16,9": (832, 480), "9,16": (480, 832)},
    "720p": {"1,1": (960, 960), "4,3": (960, 720), "3,4": (720, 960), "16,9": (1280, 720), "9,16": (720, 1280)},
    "720robocasa": {"1,1": (720, 720), "4,3": (960, 720), "3,4": (720, 960), "16,9": (1280, 720), "9,16": (720, 1280)},
    "256": {"1,1": (256, 256), "4,3": (320, 256), "3,4": (256, 320), "16,9": (320, 192), "9,16": (192, 320)},
}


def filter_fps(clips: DataFrame, lo: float, hi: float, fps: str = "fps") -> DataFrame:
    return clips.where(F.col(fps).between(lo, hi))


def clip_windows(clips: DataFrame, w: float = 5.0, tail: float = 7.5) -> DataFrame:
    """Cut clips into ``w``-second windows.

    The rest of a clip stays one window up to ``tail`` seconds and becomes two beyond
    that. Frame numbers are inclusive. Window counts are closed-form, so this is a
    per-row expansion without a shuffle.
    """
    dur = F.col("n_frames") / F.col("fps")
    standard = F.greatest(F.lit(0), F.ceil((F.col("_dur") - w - tail) / w)).cast("long")
    left = F.col("_dur") - F.col("_m") * w
    cut = (
        clips.withColumn("_dur", dur)
        .where("_dur > 0")
        .withColumn("_m", standard)
        .withColumn("_k", F.col("_m") + F.when(left <= tail, 1).otherwise(2))
        .withColumn("window_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    )
    start = F.col("window_id") * w
    end = F.when(F.col("window_id") == F.col("_k") - 1, F.col("_dur")).otherwise(start + w)
    return (
        cut.withColumn("start_time", start)
        .withColumn("end_time", end)
        .withColumn("start_frame", F.floor(F.col("start_time") * F.col("fps")))
        .withColumn("end_frame", F.floor(F.col("end_time") * F.col("fps")) - 1)
        .withColumn("n_windows", F.col("_k"))
        .drop("_dur", "_m", "_k")
    )


def eligible_windows(windows: DataFrame, min_duration: float) -> DataFrame:
    """Long enough windows; the last one is skipped when a clip has several."""
    not_last = (F.col("n_windows") == 1) | (F.col("window_id") < F.col("n_windows") - 1)
    long_enough = (F.col("end_frame") - F.col("start_frame")) >= min_duration * F.col("fps")
    return windows.where(not_last & long_enough)


def eligible_nested(clips: DataFrame, min_duration: float, windows: str = "windows") -> DataFrame:
    """The same rule for clips that carry an array of ``{start_frame, end_frame}``."""
    flat = clips.withColumn("n_windows", F.size(windows)).select(
        "*", F.posexplode(windows).alias("window_id", "_w")
    )
    flat = flat.withColumn("start_frame", F.col("_w.start_frame")).withColumn("end_frame", F.col("_w.end_frame"))
    return eligible_windows(flat.drop(windows, "_w"), min_duration)


def filter_multiplier(
    windows: DataFrame, num_frames: int, allowed: Sequence[int], shifted_source: str | None = None, shift: int = 5,
    native: bool = True, source: str = "source",
) -> DataFrame:
    """Native-fps step: ``total // num_frames`` must be allowed; some sources start later.

    With ``native=False`` the original fps is kept (step 1).
    """
    df = windows
    if shifted_source:
        moved = F.when(F.col(source).contains(shifted_source), F.col("start_frame") + shift)
        df = df.withColumn("start_frame", moved.otherwise(F.col("start_frame")))
    total = F.col("end_frame") - F.col("start_frame")
    df = df.where(total >= num_frames)
    step = F.floor(total / num_frames) if native else F.lit(1).cast("long")
    df = df.withColumn("multiplier", step)
    return df.where(F.col("multiplier").isin(list(allowed))) if native else df


def centered_span(df: DataFrame, num_frames: int, multiplier: str = "multiplier") -> DataFrame:
    """First frame of the middle ``num_frames * multiplier`` frames, step ``multiplier``."""
    total = F.col("end_frame") - F.col("start_frame")
    need = F.lit(num_frames) * F.col(multiplier)
    first = F.col("start_frame") + F.floor((total - need) / 2)
    return df.withColumn("first_frame", first.cast("long")).withColumn(
        "last_frame", (F.col("first_frame") + F.lit(num_frames - 1) * F.col(multiplier)).cast("long")
    )


def centered_frames(num_frames: int, multiplier: str = "multiplier") -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(num_frames - 1)), lambda i: F.col("first_frame") + i * F.col(multiplier)
    )


def interleaved_span(start: Column, num_frames: int) -> Column:
    """Frames stepping by 4 and by 5 over one span, merged, without the two outer ones."""
    by4 = F.sequence(start, start + (num_frames - 1), F.lit(4).cast("long"))
    by5 = F.sequence(start, start + (num_frames - 1), F.lit(5).cast("long"))
    merged = F.array_sort(F.concat(by4, by5))
    return F.slice(merged, F.lit(2), F.size(merged) - 2)


def stride_frames(frames: DataFrame, stride: int, order: str = "frame_index", out: str = "image_index") -> DataFrame:
    """Every ``stride``-th frame, renumbered; frame numbers run 0..T-1 so no window is needed."""
    return frames.where(F.col(order) % stride == 0).withColumn(out, F.floor(F.col(order) / stride))


def clip_status(n_frames: Column, fps: Column, target: int, min_fps: float, max_fps: float) -> Column:
    """First failing sanity check, else ``success``. The messages are fixed values."""
    return (
        F.when(n_frames <= 0, "n_video_frames must be positive")
        .when(F.lit(min_fps <= 0), "min_fps_thres must be positive")
        .when(fps < 1, "Video fps lower than 1, skipping")
        .when(F.lit(max_fps < min_fps), "max_fps_thres must be greater than or equal to min_fps_thres")
        .when(F.lit(target <= 1), "sequence_length must be greater than 1")
        .when(
            n_frames < target,
            F.concat(F.lit(f"Specified sequence_length {target} exceeds num frames in video "), n_frames.cast("string"), F.lit(".")),
        )
        .otherwise("success")
    )


def bound_duration(df: DataFrame, frames: str = "n_frames", fps: str = "fps", lo: float = 4.0, hi: float = 8.0) -> DataFrame:
    """Reject chunks under ``lo`` seconds, truncate those over ``hi``."""
    dur = F.col(frames) / F.col(fps)
    kept = df.where(dur >= lo)
    return kept.withColumn(
        "frames_needed", F.when(dur > hi, F.ceil(hi * F.col(fps))).otherwise(F.col(frames)).cast("long")
    )


def sample_chunk(df: DataFrame, target: int, chunk: int, u: Column, frames: str = "n_frames") -> DataFrame:
    """Pick one caption chunk; a short tail belongs to the chunk before it."""
    n = F.col(frames)
    whole = F.greatest(F.floor(n / chunk), F.lit(1)).cast("long")
    rest = n - whole * chunk
    extra = (rest >= int(0.5 * chunk)) & (rest > target)
    counted = df.withColumn("n_chunks", whole + F.when(extra, 1).otherwise(0))
    idx = F.least(F.floor(u * F.col("n_chunks")), F.col("n_chunks") - 1).cast("long")
    picked = counted.withColumn("chunk_index", idx)
    size = F.when(F.col("chunk_index") == F.col("n_chunks") - 1, n - F.col("chunk_index") * chunk).otherwise(chunk)
    sized = picked.withColumn("frames_in_chunk", size.cast("long"))
    bad = F.col("frames_in_chunk") < target
    return (
        sized.withColumn("chunk_status", F.when(bad, "sequence exceeds chunk").otherwise("success"))
        .withColumn("chunk_index", F.when(bad, -1).otherwise(F.col("chunk_index")).cast("long"))
        .withColumn("frames_in_chunk", F.when(bad, 0).otherwise(F.col("frames_in_chunk")).cast("long"))
    )


def choose_stride(
    df: DataFrame, target: int, min_fps: float, max_fps: float, u_stride: Column, u_start: Column,
    frames: str = "n_frames", fps: str = "fps",
) -> DataFrame:
    """Stride whose fps stays in bounds, preferring the lowest fps (0.99 against 0.01).

    Valid strides form one integer interval, so only its ends are computed.
    """
    n, f = F.col(frames), F.col(fps)
    hi = F.least(F.floor(f / min_fps), F.floor((n - 1) / (target - 1))).cast("long")
    lo = F.greatest(F.lit(1), F.ceil(f / max_fps)).cast("long")
    b = df.withColumn("_lo", lo).withColumn("_hi", hi)
    none = F.col("_hi") < F.col("_lo")
    stride = F.when(none, None).when((F.col("_hi") > F.col("_lo")) & (u_stride < 0.01), F.col("_hi") - 1).otherwise(F.col("_hi"))
    b = b.withColumn("stride", stride.cast("long"))
    room = n - (target - 1) * F.col("stride")
    return (
        b.withColumn("first_frame", F.least(F.floor(u_start * room), room - 1).cast("long"))
        .withColumn("sampled_fps", f / F.col("stride"))
        .withColumn("stride_status", F.when(none, "no valid stride").otherwise("success"))
        .drop("_lo", "_hi")
    )


def aspect_from_path(c: Column) -> Column:
    """``.../aspect_ratio_16_9/...`` to ``16,9`` (null when absent)."""
    return F.nullif(F.replace(F.regexp_extract(c, r"aspect_ratio_(\d+_\d+)", 1), F.lit("_"), F.lit(",")), F.lit(""))


def lookup_resolution(df: DataFrame, kind: str = "video", resolution: str = "resolution", aspect: str = "aspect_ratio") -> DataFrame:
    """Target width and height by literal map; the table has a fixed size."""
    sizes = VIDEO_SIZES if kind == "video" else IMAGE_SIZES
    entries = []
    for res, by_aspect in sizes.items():
        for asp, (w, h) in by_aspect.items():
            entries += [F.lit(f"{res}|{asp}"), F.struct(F.lit(w).alias("w"), F.lit(h).alias("h"))]
    hit = F.try_element_at(F.create_map(*entries), F.concat_ws("|", resolution, aspect))
    return df.withColumn("_size", hit).withColumn("target_w", F.col("_size.w")).withColumn("target_h", F.col("_size.h")).drop("_size")


def plan_resize(df: DataFrame, w: str = "width", h: str = "height", tw: str = "target_w", th: str = "target_h") -> DataFrame:
    """Resize-then-pad plan: output size, four pads and the padding mode."""
    r = F.least(F.col(tw) / F.col(w), F.col(th) / F.col(h))
    sized = df.withColumn("_r", r)
    sized = sized.withColumn("new_w", F.floor(F.col("_r") * F.col(w) + 0.5)).withColumn(
        "new_h", F.floor(F.col("_r") * F.col(h) + 0.5)
    )
    left = F.floor((F.col(tw) - F.col("new_w")) / 2)
    top = F.floor((F.col(th) - F.col("new_h")) / 2)
    padded = (
        sized.withColumn("pad_left", left)
        .withColumn("pad_top", top)
        .withColumn("pad_right", F.col(tw) - F.col("new_w") - F.col("pad_left"))
        .withColumn("pad_bottom", F.col(th) - F.col("new_h") - F.col("pad_top"))
    )
    wide = F.greatest("pad_left", "pad_right") >= F.col("new_w")
    tall = F.greatest("pad_top", "pad_bottom") >= F.col("new_h")
    return padded.withColumn("pad_mode", F.when(wide | tall, "edge").otherwise("reflect")).drop("_r")


def clean_instruction(c: Column) -> Column:
    """Instruction folder name to text plus a recovery flag."""
    text = F.regexp_replace(F.regexp_replace(c, r"^\d+_*", ""), r"\d+", "")
    spaced = F.replace(F.replace(text, F.lit("recovery"), F.lit("")), F.lit("_"), F.lit(" "))
    return F.struct(F.trim(spaced).alias("instruction"), text.contains("recovery").alias("is_recovery"))


def align_views(views: DataFrame, sample: str = "sample_id", fps: str = "fps", frame_ids: str = "frame_ids") -> DataFrame:
    """Samples whose cameras agree on fps and frame ids (min/max agreement, combinable)."""
    g = views.groupBy(sample).agg(
        F.count(F.lit(1)).alias("views"),
        (F.min(fps) == F.max(fps)).alias("_fps_ok"),
        (F.min(frame_ids) == F.max(frame_ids)).alias("_ids_ok"),
        F.max(fps).alias("fps"),
    )
    reason = F.when(~F.col("_ids_ok"), "frame ids differ").when(~F.col("_fps_ok"), "fps differs").otherwise("ok")
    return g.withColumn("alignment", reason).drop("_fps_ok", "_ids_ok")


def unpack_by_position(df: DataFrame, metas: str, mapping: dict[int, str], prefix: str = "metas_") -> DataFrame:
    """Positional list of metas to one column per camera."""
    return df.withColumns({prefix + cam: F.get(F.col(metas), F.lit(i)) for i, cam in mapping.items()}).drop(metas)


def merge_struct(df: DataFrame, inputs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Lift listed fields of struct columns to the top level; rows missing an input drop."""
    for c in inputs:
        fields = [f.name for f in df.schema[c].dataType.fields]
        df = df.where(F.col(c).isNotNull()).withColumns({k: F.col(c)[k] for k in keep if k in fields}).drop(c)
    return df
