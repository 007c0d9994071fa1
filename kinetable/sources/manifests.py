"""Shard manifests, inference manifests, prompt files and caption sidecars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MANIFEST_SCHEMA = "root string, data_list array<string>, total_key_count long, chunk_size long"


def strip_bucket(c: Column | str) -> Column:
    """``s3://bucket/path`` to ``path``."""
    return F.regexp_replace(c, r"^s3://[^/]*/?", "")


def read_manifests(spark: SparkSession, glob: str | Sequence[str]) -> DataFrame:
    raw = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", "true").json(glob)
    return raw.withColumn("manifest", F.col("_metadata.file_path"))


def expand_manifest(df: DataFrame, default_keys: Sequence[str], dataset_keys: str | None = None) -> DataFrame:
    """One row per shard; keys listed for a dataset override the defaults."""
    fallback = F.array(*[F.lit(k) for k in default_keys])
    keys = fallback
    if dataset_keys:
        keys = F.when(F.coalesce(F.size(dataset_keys), F.lit(0)) > 0, F.col(dataset_keys)).otherwise(fallback)
    rest = [c for c in df.columns if c not in ("data_list", "root", dataset_keys)]
    return df.select(*rest, strip_bucket("root").alias("root"), keys.alias("keys"), F.explode("data_list").alias("path"))


def mixed_chunk_sizes(df: DataFrame, by: str = "dset_id", order: str = "manifest") -> DataFrame:
    """Datasets whose manifests disagree on chunk size; the first one is used."""
    g = df.groupBy(by).agg(
        F.min("chunk_size").alias("_lo"), F.max("chunk_size").alias("_hi"), F.min_by("chunk_size", order).alias("chunk_size"),
        F.sum("total_key_count").alias("total_key_count"),
    )
    return g.withColumn("mixed", F.col("_lo") != F.col("_hi")).drop("_lo", "_hi")


def load_manifest(df: DataFrame, overrides: dict[str, object] | None = None) -> DataFrame:
    """Apply overrides (they win over the file; ``None`` means not overridden)."""
    for k, v in (overrides or {}).items():
        if v is not None:
            kind = df.schema[k].dataType if k in df.columns else None
            df = df.withColumn(k, F.lit(v).cast(kind) if kind else F.lit(v))
    return df


def duplicate_names(df: DataFrame, name: str = "name") -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def require_unique_names(df: DataFrame, name: str = "name") -> DataFrame:
    """The manifest itself, raising when it is read if a name repeats."""
    repeated = duplicate_names(df, name).agg(F.min(name)).scalar()
    message = F.concat(F.lit("sample name is not unique: "), repeated)
    return df.withColumn(name, F.when(repeated.isNotNull(), F.raise_error(message).cast("string")).otherwise(F.col(name)))


def prompts_from_lines(lines: DataFrame, prefix: str, value: str = "value") -> DataFrame:
    """``clip.mp4,prompt`` lines: split at the first comma, drop one surrounding quote pair."""
    parts = F.split(value, ",", 2)
    text = F.get(parts, F.lit(1))
    quoted = text.startswith('"') & text.endswith('"') & (F.length(text) >= 1)
    bare = F.when(quoted, F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text)
    rest = [c for c in lines.columns if c != value]
    clip = F.regexp_replace(F.get(parts, F.lit(0)), r"^.*/", "")
    return lines.select(*rest, clip.alias("clip"), F.concat(F.lit(prefix), bare).alias("prompt"))


def prompts_from_csv(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Read a prompt CSV; each file's first line is its header."""
    lines = spark.read.text(path).withColumn("_off", F.col("_metadata.file_block_start"))
    body = lines.where(~(F.col("value").startswith("video") & (F.col("_off") == 0) & ~F.col("value").contains(".mp4")))
    return prompts_from_lines(body.drop("_off"), prefix)


def unpivot_captions(df: DataFrame, ids: Sequence[str], view: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Wide caption table to ``(ids, sample_id, caption, view, tag)``."""
    columns = [c for c in df.columns if c not in ids] if columns is None else list(columns)
    long = df.unpivot(list(ids), columns, "sample_id", "caption")
    return long.withColumn("view", F.lit(view)).withColumn("tag", F.lit(None).cast("string"))


def caption_from_json(content: Column, prompt_type: str | None = None) -> Column:
    """Caption of ``{model: {prompt type: text}}``: first model, asked type or the first.

    Text without braces is wrapped; anything unreadable gives an empty string.
    """
    body = F.when(F.ltrim(content).startswith("{"), content).otherwise(F.concat(F.lit("{"), content, F.lit("}")))
    models = F.map_values(F.from_json(body, "map<string,map<string,string>>"))
    first = F.get(models, F.lit(0))
    any_type = F.get(F.map_values(first), F.lit(0))
    asked = F.try_element_at(first, F.lit(prompt_type)) if prompt_type else F.lit(None).cast("string")
    return F.coalesce(asked, any_type, F.lit(""))


def load_captions(spark: SparkSession, root: str, prompt_type: str | None = None, fmt: str = "auto") -> DataFrame:
    """Caption files of a folder as ``(stem, caption)``; one whole file is one value."""
    if fmt == "auto":
        from kinetable.sources.lake import list_files

        found = detect_caption_format(list_files(spark, root)).first()
        fmt = found["caption_format"] if found else None
    if fmt == "json":
        raw = spark.read.option("wholetext", "true").text(f"{root}/captions/*.json")
        caption = caption_from_json(F.col("value"), prompt_type)
    elif fmt == "text":
        raw = spark.read.option("wholetext", "true").text(f"{root}/metas/*.txt")
        caption = F.regexp_replace("value", r"^\s+|\s+$", "")
    else:
        raise ValueError(f"no captions found below {root}")
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
    return raw.select(stem.alias("stem"), caption.alias("caption"))


def detect_caption_format(files: DataFrame, by: Sequence[str] = (), path: str = "path") -> DataFrame:
    """``json`` when ``captions/*.json`` exists, else ``text`` for ``metas/*.txt``, else null."""
    has_json = F.max(F.col(path).rlike(r"/captions/[^/]+\.json$"))
    has_text = F.max(F.col(path).rlike(r"/metas/[^/]+\.txt$"))
    g = files.groupBy(*by).agg(has_json.alias("_j"), has_text.alias("_t"))
    fmt = F.when(F.col("_j"), "json").when(F.col("_t"), "text")
    return g.withColumn("caption_format", fmt).drop("_j", "_t")
