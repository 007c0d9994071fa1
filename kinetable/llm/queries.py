"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetable.llm import (
    bpe, conversation_repair, decontaminate, html_text, language_id, line_dedup, mixing, near_dedup, quality_model, quality_rules, sharding,
    toxicity, whitening,
)
from kinetable.llm.common import fold
from kinetable.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The word-level vocabulary file: ``WORD_BPE_PATH``, or the installed package of public tokenizers."""
    if path := os.environ.get("WORD_BPE_PATH"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", *(F.col("q")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                      "base_failed", "kept")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.searched(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("row.doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    out = bpe.encoded(docs.select("doc_id", "text"), tokenizer_path())
    return out.select("row.doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleaved(table(spark, sf_dir, "documents"))


@query
def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", (fold(F.col("row.doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_model.scored(docs, quality_model.trained(docs, table(spark, sf_dir, "labels")))
    return out.select("row.doc_id", (fold(F.col("row.doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.predicted(docs.select("doc_id", "text"), language_id.trained(docs))
    return out.select("row.doc_id", (fold(F.col("row.doc_id")) == 0).alias("held_out"), "lang_pred", "score")


@query
def op7_html_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = whitening.components(vectors, whitening.fitted(vectors))
    return out.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query
def op13_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repair = conversation_repair.Repair(conversation_repair.damaged(turns))
    conv = F.struct("conv_id").alias("conv")
    known = repair.summaries().select(conv, *(counts := ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]), "audit")
    digests = repair.digests().select(conv, "sha256")
    out = turns.select(conv).distinct().join(known, "conv", "left").join(digests, "conv", "left")
    return out.select("conv.conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
