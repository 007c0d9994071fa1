"""Caption selection, keyword filtering and correspondence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinetable.functions.hashing import pick_by_weight
from kinetable.functions.vectors import with_once

# Fixed phrase list of the camera-movement filter.
CAMERA_MOVEMENT_PHRASES = (
    "camera pan", "camera pans", "camera slowly pan", "camera slowly pans", "camera quickly pans",
    "camera fast pans", "panning shot", "panning camera", "slow pan", "quick pan", "fast pan",
    "pan across", "pan around", "pan shot", "panoramic shot",
    "camera moves", "camera slowly moves", "camera quickly moves", "moving camera", "tracking shot",
    "tracking camera", "dolly shot", "dolly in", "dolly out", "camera follows", "camera tracks",
    "tracking movement",
    "sweeping camera", "camera sweep", "rotating camera", "camera rotation", "camera rotates",
    "camera circles around",
    "camera tilt", "camera tilts", "camera slowly tilts", "tilting camera", "tilt up", "tilt down",
    "camera zoom", "camera zooms", "zooming camera", "zoom in", "zoom out",
    "handheld camera", "handheld shot", "shaky camera", "camera shake", "shaky shot",
    "handheld movement",
)

# Fixed default weights of the caption styles.
STYLE_WEIGHTS = {"long": 7, "medium": 2, "short": 1, "user": 90}
#: Styles that may stand beside the weighted ones and are never picked.
OTHER_STYLES = ("startframe", "endframe")

IMAGE_STYLES = ("qwen2p5_7b_long", "qwen2p5_7b_medium", "qwen2p5_7b_short")


def flag_captions(
    df: DataFrame, keywords: Sequence[str], mode: str = "exclude", exempt: Sequence[str] = (),
    caption: str = "caption", source: str = "source",
) -> DataFrame:
    """Mark each row ``counted`` (not exempt) and ``filtered``.

    Blank captions pass; sources containing an exempt substring pass uncounted.
    """
    if mode not in ("include", "exclude"):
        raise ValueError(f"mode must be include or exclude, got {mode!r}")
    low = with_once(df, "_low", F.lower(caption))
    found = F.lit(False)
    for k in dict.fromkeys(k.lower() for k in keywords):
        found = found | F.col("_low").contains(k)
    is_exempt = F.lit(False)
    for e in exempt:
        is_exempt = is_exempt | F.coalesce(F.col(source).contains(e), F.lit(False))
    has_text = F.coalesce(F.col("_low").rlike(r"\S"), F.lit(False))
    drop = has_text & (found if mode == "exclude" else ~found)
    return low.withColumn("counted", ~is_exempt).withColumn("filtered", ~is_exempt & drop).drop("_low")


def caption_filter(df: DataFrame, keywords: Sequence[str], mode: str = "exclude", exempt: Sequence[str] = (),
                   caption: str = "caption", source: str = "source") -> DataFrame:
    return flag_captions(df, keywords, mode, exempt, caption, source).where("NOT filtered").drop("counted", "filtered")


def filter_stats(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals over counted rows: total, filtered, passed and rate in percent."""
    total, hit = F.count_if("counted"), F.count_if("filtered")
    return flagged.groupBy(*by).agg(
        total.alias("total_samples"), hit.alias("filtered_samples"), (total - hit).alias("passed_samples"),
        F.when(total > 0, hit / F.nullif(total, F.lit(0)) * 100.0).otherwise(0.0).alias("filter_rate_percent"),
    )


def resolve_caption_window(df: DataFrame, windows: str = "windows", chunk: str = "chunk_index") -> DataFrame:
    """Caption window of a chunk; an index one past the end takes the last window.

    Rows that cannot be served keep a ``drop_reason`` instead of vanishing.
    """
    n = F.size(windows)
    at = F.when(F.col(chunk) == n, F.col(chunk) - 1).otherwise(F.col(chunk)).cast("int")
    # A negative index counts from the end, as list indexing does.
    hit = F.when(at >= 0, F.get(windows, at)).when(at >= -n, F.get(windows, n + at))
    return df.withColumn("caption_window", hit).withColumn(
        "drop_reason", F.when(F.col("caption_window").isNull(), "caption window missing")
    )


def pick_caption(
    df: DataFrame, u: Column, captions: str = "captions", weights: dict[str, float] | None = None,
) -> DataFrame:
    """Weighted style among those present in a ``map<style, text>``, weights renormalised.

    Empty captions, rows without a known style and rows with a style that is neither weighted nor one of
    ``OTHER_STYLES`` get a ``drop_reason``, and no caption in the last case.
    """
    weights = STYLE_WEIGHTS if weights is None else weights
    options = [
        (F.lit(s), F.when(F.map_contains_key(captions, s), F.lit(float(w))).otherwise(0.0)) for s, w in weights.items()
    ]
    known = F.array(*[F.lit(s) for s in (*weights, *OTHER_STYLES)])
    odd = F.coalesce(F.size(F.array_except(F.map_keys(captions), known)) > 0, F.lit(False))
    styled = df.withColumn("caption_style", F.when(~odd, pick_by_weight(u, options)))
    text = F.try_element_at(F.col(captions), F.col("caption_style"))
    return styled.withColumn("caption", text).withColumn(
        "drop_reason",
        F.when(odd, "unsupported caption style").when(F.col("caption_style").isNull(), "no caption style")
        .when(F.coalesce(F.col("caption"), F.lit("")) == "", "empty caption"),
    )


def pick_image_caption(
    df: DataFrame, kind: str, u: Column | None = None, main: str = "captions", alias: str = "caption",
    styles: Sequence[str] = IMAGE_STYLES, issue: str = "had_parse_issue",
) -> DataFrame:
    """Image caption: uniform over styles, the prompt, or the parse-issue fallback.

    Caption maps appear under two names; whichever is present is used.
    """
    cmap = F.coalesce(F.col(main), F.col(alias))
    if kind == "uniform":
        style = F.element_at(F.array(*[F.lit(s) for s in styles]), (F.floor(u * len(styles)) + 1).cast("int"))
    elif kind == "prompts":
        cmap, style = F.col(alias), F.lit("prompt")
    elif kind == "parsed":
        style = F.when(F.col(issue), "kosmos_2").otherwise("vfc")
    else:
        raise ValueError(f"unknown caption kind {kind!r}")
    return df.withColumn("caption_style", style).withColumn("picked_caption", F.try_element_at(cmap, F.col("caption_style")))


def prefix_captions(
    df: DataFrame, prefixes: dict[str, str], single: str | None = None, camera: str = "camera", caption: str = "caption"
) -> DataFrame:
    """Prepend the camera's prefix; optionally only one camera keeps its text."""
    kept = F.when(F.col(camera) == single, F.col(caption)).otherwise("") if single else F.col(caption)
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    return df.withColumn(caption, F.concat(F.try_element_at(table, F.col(camera)), F.lit(" "), kept))


def captions_by_view(rows: DataFrame, order: str, sample: str = "sample_id", view: str = "view", tag: str = "tag") -> DataFrame:
    """Last caption per (sample, view, tag); a null tag means ``long``. Long form."""
    named = rows.withColumn("style", F.coalesce(F.nullif(F.col(tag), F.lit("")), F.lit("long")))
    return named.groupBy(sample, view, "style").agg(F.max_by("caption", order).alias("caption"))


def caption_maps(long: DataFrame, sample: str = "sample_id", view: str = "view") -> DataFrame:
    """Long captions to one ``map<style, text>`` per (sample, view); styles are unique there."""
    return long.groupBy(sample, view).agg(F.map_from_entries(F.collect_list(F.struct("style", "caption"))).alias("captions"))


def route_captions(captions: DataFrame, val_ids: DataFrame, key: str = "episode_id",
                   clip: str = "video_clip", caption: str = "caption") -> DataFrame:
    """Send each usable caption to ``val`` or ``train`` by its episode."""
    usable = captions.where(
        (F.coalesce(F.col(clip).cast("string"), F.lit("")) != "") & (F.coalesce(F.col(caption), F.lit("")) != "")
    )
    ids = val_ids.select(key).distinct().withColumn("_val", F.lit(True))
    return usable.join(ids, key, "left").withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")
