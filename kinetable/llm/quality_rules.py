"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each text is judged alone, so the operator is one narrow pass without any exchange. All counts are
column expressions on the row's own arrays; none compares every word with every other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from kinetable.llm.common import BLANK_CHARS, BLANKS, ascii_lower, packed

#: Frequent short words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on with as by at be this from are or an a "
    "le la les des de du et en un une que est pour dans qui sur par au pas ne "
    "der die das und den von zu mit sich auf ist im nicht ein eine als auch dem für "
    "el los del se las por con una su para es no lo y"
).split()

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie in [low, high]; a text with denominator 0 passes."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None

    def passes(self, c: dict[str, Column]) -> Column:
        top, base = c[self.numerator], F.lit(1) if self.denominator is None else c[self.denominator]
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (top >= F.lit(self.low) * base)
        if self.high is not None:
            ok = ok & (top <= F.lit(self.high) * base)
        return F.when(base == 0, F.lit(True)).otherwise(ok)


#: The verdict beyond the base rules. Bounds are wide: they catch pages of markup, tables of cells,
#: shouting and lists without sentences, and leave prose of any language alone.
THRESHOLDS = (
    Rule("mean_word_length", "word_chars", "n_words", 1.5, 14.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.25),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.02, None),
    Rule("shout_ratio", "n_shouts", "n_words", None, 0.3),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 0.5),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def counted(df: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``row`` (a struct of all of ``df``) and ``q`` (a struct of the counts of each text).

    A repeated word is one inside a 3-word window found twice or more. Windows are hashed and sorted with their
    positions; one equal to a neighbour in that order is repeated, and the union of its three positions is kept
    in hashed sets: n log n in the words of a text, however often a window returns.
    """
    t, w, lines, s, p = (F.col(x) for x in ("t", "w", "lines", "s", "p"))
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    covered = F.array_union(F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2))
    plain = F.split(ascii_lower(F.translate(t, "\t\n\x0b\x0c\r.,;:!?()\"'", "     ")), " ")
    size = lambda a: F.size(a).cast("long")
    return (
        df.select(packed(df), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
        .select("row", "t", F.filter(F.split(t, f"[{BLANKS}]+"), lambda x: x != "").alias("w"),
                F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0).alias("lines"))
        .select("row", "t", "w", "lines", F.sort_array(F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))).alias("s"))
        .select("row", "t", "w", "lines", F.transform(
            F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]).alias("p"))
        # Through a generator, so that a filter on the counts is not moved below it and their arrays not made per element.
        .select("row", F.explode(F.array(F.struct(
            size(w).alias("n_words"),
            F.length(F.translate(t, BLANK_CHARS, "")).cast("long").alias("word_chars"),
            count_chars(t, SYMBOLS).alias("n_symbols"),
            size(lines).alias("n_lines"),
            (size(lines) - size(F.array_distinct(lines))).alias("n_dup_lines"),
            size(covered).alias("n_repeat_words"),
            size(F.filter(plain, lambda x: x.isin(*STOP_WORDS))).alias("n_stop_words"),
            count_chars(t, "!").alias("n_shouts"),
            size(F.filter(lines, lambda x: x.rlike(f"(\\.\\.\\.|…)[{BLANKS}]*$"))).alias("n_ellipsis_lines"),
            size(F.filter(lines, lambda x: x.rlike(f"^[{BLANKS}]*[-*•]"))).alias("n_bullet_lines"),
        ))).alias("q"))
    )


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """Columns ``row``, ``q`` (counts), ``base_failed`` and ``kept``, one row for each row of ``df``.

    ``base_failed``: fewer than 50 words, or over half of the words repeated. ``kept``: not so, and every rule of
    the table passes. Null and empty texts have no words and fail the base. Rows are judged alone: repeated rows
    come out repeated, an empty table gives an empty one, and columns of ``df`` of any name stay inside ``row``.
    """
    q = F.col("q")
    c = {n: q[n] for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
                           "n_shouts", "n_ellipsis_lines", "n_bullet_lines")}
    base = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.passes(c)
    return counted(df, text).select("row", "q", base.alias("base_failed"), (~base & verdict).alias("kept"))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The rows of ``df`` that the base and the rules keep, with the columns of ``df``."""
    return judged(df, text, rules).where("kept").select("row.*")
