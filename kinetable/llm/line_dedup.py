"""Line dedup: lines whose normalised form stands in many documents are dropped everywhere.

Hashes and positions are shuffled to count and find lines; texts move once, to meet the positions to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType

from kinetable.llm.common import BLANK_CHARS, ascii_lower, packed
from kinetable.operators.skew import heavy_keys, split_join
from kinetable.session import staged

#: A key in so many documents, or more, is dropped; keys of fewer code points never are.
MIN_DOCS, MIN_CHARS = 10, 1


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANK_CHARS)))


def _hashes(text: Column, min_chars: int) -> Column:
    """Each line's 128-bit key hash, in order; null for a line whose key is too short to be counted."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.when(
        F.length(F.btrim(x, F.lit(BLANK_CHARS))) >= min_chars,
        F.struct(F.xxhash64(line_key(x)).alias("a"), F.xxhash64(F.lit("line"), line_key(x)).alias("b"))))


def dedup_lines(df: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Columns ``row`` (all of ``df``), ``n_lines``, ``n_dropped`` and ``kept_text``, one row for each row of ``df``.

    Every row is one document, also where ids are null or repeated. A line counts once in a document. Null and empty
    texts are one empty line; a text that loses all lines becomes empty. Order and ends of the lines that stay are
    untouched. A text is found again by its own 128-bit hash: which lines go depends on
    the text alone, so equal texts share one list of positions.
    """
    row = df.select(packed(df))
    t = F.col("row")[text].cast("string")
    ids = {"ra": F.xxhash64(t), "rb": F.xxhash64(F.lit("text"), t)}
    # Lines are split, trimmed and hashed once; what follows reads the hashes.
    keyed = staged(row.select(*[c.alias(n) for n, c in ids.items()], _hashes(t, min_chars).alias("hs")), "line-hashes")
    # Pre-aggregated before the exchange: a line in a third of all documents is one row of each task.
    frequent = (
        keyed.select(F.explode(F.array_distinct(F.filter("hs", lambda h: h.isNotNull()))).alias("h"))
        .groupBy(F.col("h.a").alias("a"), F.col("h.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_docs).select("a", "b")
    )
    frequent = staged(frequent, "frequent-lines")
    lines = keyed.select("ra", "rb", F.posexplode("hs").alias("pos", "h")).where(F.col("h").isNotNull())
    hit = lines.select("ra", "rb", "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b")).join(frequent, ["a", "b"], "left_semi")
    drops = hit.groupBy("ra", "rb").agg(F.collect_set("pos").alias("drop"))
    # Copies of one text may be a third of all rows: they are dealt out by what else they have, such as their ids.
    rest = [F.col("row")[f.name] for f in df.schema.fields if f.name != text and not isinstance(f.dataType, MapType)]
    found = split_join(row.withColumns(ids), staged(drops, "line-drops"), ["ra", "rb"], "left", spread=F.xxhash64(F.lit(0), *rest), heavy=heavy_keys(keyed, ["ra", "rb"]))
    whole = F.coalesce(t, F.lit(""))
    parts = F.split(whole, "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "drop"), lambda i: F.get(parts, i)), "\n")
    return found.select(
        "row", (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("drop").isNull(), whole).otherwise(kept).alias("kept_text"))
