"""Text normalisation shared by the safety operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_ascii(c: Column | str) -> Column:
    """Every run of non-ASCII characters becomes one space."""
    return F.regexp_replace(c, r"[^\x00-\x7F]+", " ")


def norm_text(c: Column | str) -> Column:
    """Collapse whitespace, trim, lower-case."""
    # Lone spaces already are what they should become, so the pattern skips them.
    return F.lower(F.trim(F.regexp_replace(c, r"\s{2,}|[\t\n\x0B\f\r]", " ")))


def strip_punctuation(c: Column) -> Column:
    """Drop leading and trailing ASCII punctuation."""
    return F.regexp_replace(c, r"^\p{Punct}+|\p{Punct}+$", "")


def iteration_of(label: Column | str) -> Column:
    """First all-digit part of a label; a ``k`` anywhere in the label means thousands."""
    c = F.col(label) if isinstance(label, str) else label
    parts = F.transform(F.split(F.replace(c, F.lit("-"), F.lit("_")), "_"), lambda p: F.regexp_replace(p, "k+$", ""))
    digits = F.get(F.filter(parts, lambda p: p.rlike(r"^\d+$")), F.lit(0)).cast("long")
    return F.coalesce(F.when(c.contains("k"), digits * 1000).otherwise(digits), F.lit(0).cast("long"))
