"""A training-data pipeline over ``documents``: quality rules, line dedup, near-dedup, decontamination, encoding.

Every stage takes null, empty, blank and very long texts, null and repeated ids, repeated rows, empty tables and further
columns of any name, and all but the last return the columns they got. What becomes of each case is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetable.llm import decontaminate, line_dedup, near_dedup, quality_rules
from kinetable.llm.queries import bpe_digests, table
from kinetable.session import staged


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts go; rows are judged alone, so repeated rows stay or
    go together."""
    return quality_rules.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that stand in many documents; ``n_chars`` follows the text.

    Each row counts as a document, whatever its id. A text that loses no line stays as it is, a null one too; one that
    loses all becomes empty.
    """
    out = line_dedup.dedup_lines(docs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id.

    Texts without words are in no group and stay. Rows of one id are one document and stay or go together; of a group
    without any id one row stays.
    """
    return near_dedup.keep_first(docs)


def unseen_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages. Texts without words stay; rows are judged alone."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's token ids and of the text they decode to; a null text counts as empty."""
    return bpe_digests(docs)


#: (name, function of spark, docs and sf_dir); each stage reads what the one before it wrote.
STAGES = [
    ("quality_rules", good_texts),
    ("line_dedup", fresh_lines),
    ("near_dedup", first_copies),
    ("decontaminate", unseen_tests),
    ("bpe", tokens),
]

#: SQL has no tokenizer; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
