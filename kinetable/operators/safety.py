"""Prompt safety: block lists, censoring, rule cascade, moderation outputs, frame votes."""

from __future__ import annotations

import functools
import json
import math
import re
import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kinetable.functions.python_tasks import similar
from kinetable.functions.text import norm_text, strip_punctuation, to_ascii
from kinetable.functions.vectors import let, with_once
from kinetable.operators.skew import split_join
from kinetable.session import local_table, staged

CENSORED = "****"
UNSAFE_FRAME_CUTOFF = 0.10

# Fixed category names of the two moderation output formats.
LABEL_CATEGORIES = (
    "Violent", "Non-violent Illegal Acts", "Sexual Content or Sexual Acts", "Suicide & Self-Harm",
    "Unethical Acts", "Jailbreak",
)
CODE_CATEGORIES = {
    "S1": "Violent Crimes", "S2": "Non-Violent Crimes", "S3": "Sex Crimes", "S4": "Child Exploitation",
    "S5": "Defamation", "S6": "Specialized Advice", "S7": "Privacy", "S8": "Intellectual Property",
    "S9": "Indiscriminate Weapons", "S10": "Hate", "S11": "Self-Harm", "S12": "Sexual Content",
    "S13": "Elections", "s14": "Code Interpreter Abuse",
}

#: Lists of up to so many terms travel inside the plan, and matching them is a projection without join or shuffle.
INLINE_TERMS = 2000
#: So few heads of terms are searched for one by one; more are looked up among the words of a text.
FEW_HEADS = 32
#: So many pairs of neighbouring characters of terms are looked for in word runs; with more, runs are not thinned out by them.
MOST_PAIRS = 2000
#: Bits of the filter by which rows of text are thinned out before they meet a longer list (a fixed 128 kB).
FILTER_BITS = 1 << 20

_ENTRY = "struct<kind: string, term_order: long, term: string, plain: boolean>"
_BARE_WORD = r"^[^\p{Punct}\s](\S*[^\p{Punct}\s])?$"
_RUN = "[a-z0-9]+"

#: A list of terms as (term, order) pairs, or as a table of these two columns of any size.
Terms = Sequence[tuple[str, int]] | DataFrame


def normalize_terms(terms: Sequence[str]) -> list[str]:
    """Whitespace- and case-normalised terms in list order without repeats or blanks."""
    seen = dict.fromkeys(re.sub(r"\s+", " ", t).strip().lower() for t in terms)
    return [t for t in seen if t]


def term_list(terms: Sequence[str] | DataFrame) -> Terms:
    """Normalised terms without repeats, from a list or from a table ``(term, term_order)``."""
    if not isinstance(terms, DataFrame):
        return [(t, i) for i, t in enumerate(normalize_terms(terms))]
    named = terms.select(norm_text("term").alias("term"), F.col("term_order").cast("long").alias("term_order"))
    return staged(named.where("term <> ''").groupBy("term").agg(F.min("term_order").alias("term_order")), "term-list")


def _table(df: DataFrame, terms: Terms) -> DataFrame:
    if isinstance(terms, DataFrame):
        return terms.select("term", "term_order")
    words, order = zip(*terms) if terms else ((), ())
    return local_table(df.sparkSession, {"term": list(words), "term_order": list(order)}, "term string, term_order long")


def _single_words(df: DataFrame, terms: Sequence[str] | DataFrame, allow: Sequence[str] | DataFrame) -> Terms:
    """Listed single words that are not allowed; no other term can equal a bare token."""
    if not isinstance(terms, DataFrame) and not isinstance(allow, DataFrame):
        allowed, mark = {t.strip().lower() for t in allow}, string.punctuation
        words = dict.fromkeys(t.strip().lower() for t in terms)
        return [(t, 0) for t in words if t and t not in allowed and t[0] not in mark and t[-1] not in mark and not re.search(r"\s", t, re.ASCII)]
    plain = lambda x: (x if isinstance(x, DataFrame) else local_table(df.sparkSession, {"term": list(x)}, "term string")).select(
        F.lower(F.trim("term")).alias("term")).where(F.col("term").rlike(_BARE_WORD)).distinct()
    return plain(terms).join(plain(allow), "term", "left_anti").withColumn("term_order", F.lit(0).cast("long"))


def _normal(text: str, fold: bool) -> Column:
    return norm_text(to_ascii(text) if fold else F.col(text))


def _lower(text: str, fold: bool) -> Column:
    """The text in lower case, with the same runs of ASCII letters and digits as its normal form."""
    # The only other characters whose lower case has an ASCII letter.
    read = F.replace(F.replace(F.col(text), F.lit("\u212a"), F.lit(" ")), F.lit("\u0130"), F.lit(" ")) if fold else F.col(text)
    return F.lower(read)


def _head(term: Column) -> Column:
    """The longest run of letters and digits of a term, or '' where it has none."""
    runs = F.regexp_extract_all(term, F.lit(f"({_RUN})"))
    return F.coalesce(F.array_max(F.transform(runs, lambda x: F.struct(F.length(x), x.alias("head"))))["head"], F.lit(""))


def _words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit("([a-z0-9_]+)"))


def _parts(low: Column) -> Column:
    """Parts of words that underscores join, and '', which stands for terms without a run."""
    parts = F.when(F.contains(low, F.lit("_")), F.regexp_extract_all(low, F.lit(f"({_RUN})")))
    return F.concat(F.array(F.lit("")), F.coalesce(parts, F.array().cast("array<string>")))


def _holds(padded: Column, entry: Column, known: Column) -> Column:
    """Whether a normal text, with a space at either end, holds a candidate: as whole words (exact), as a run of words
    (partial), as a bare token (censor). ``known``: words of the text, or those of them that are heads,
    among which a plain term must be; else null."""
    term = entry["term"]
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.rlike(padded, F.concat(F.lit(r"\b"), quoted, F.lit(r"\b")))
    whole = F.when(entry["plain"] & known.isNotNull(), F.array_contains(known, term)).otherwise(pattern)
    token = F.rlike(padded, F.concat(F.lit(r" \p{Punct}*"), quoted, F.lit(r"\p{Punct}* ")))
    run = F.contains(padded, F.concat(F.lit(" "), term, F.lit(" ")))
    rare = F.contains(padded, term) & F.when(entry["kind"] == "exact", whole).otherwise(token)
    return F.when(entry["kind"].isin("exact", "censor"), rare).otherwise(run)


# A text is known by its own 128-bit hash: what a text holds does not depend on the row, so rows with null or
# repeated keys are screened like all others, and equal texts share one result.
_TEXT_ID = ("_text_a", "_text_b")


def _identified(df: DataFrame, text: str) -> DataFrame:
    return df.withColumns({_TEXT_ID[0]: F.xxhash64(text), _TEXT_ID[1]: F.xxhash64(F.lit("text"), F.col(text))})


def _with_hits(df: DataFrame, hits: DataFrame) -> DataFrame:
    """``df`` (identified) with the columns of ``hits``, one row for each text that has some.

    Staged first: Spark then knows its size and may broadcast it. Where it is too large for that, a text that is copied
    into many rows is dealt out over several tasks.
    """
    hits = staged(hits, "text-hits")
    few = len(hits.limit(INLINE_TERMS + 1).select(_TEXT_ID[0]).collect()) <= INLINE_TERMS
    return split_join(df, hits, list(_TEXT_ID), "left", heavy={} if few else None).drop(*_TEXT_ID)


def found_terms(df: DataFrame, lists: dict[str, Terms], text: str, fold: bool, out: str = "_found") -> DataFrame:
    """``df`` with ``out``: the listed terms that each text holds, as ``(kind, term_order, term)``, in one pass over the texts.

    ``lists`` has the terms of each kind (``exact``, ``partial``, ``censor``). A term is known by its head, its longest run
    of letters and digits: whoever holds the term as whole words holds its head as a word or as a part between
    underscores. Heads found in a text name its candidates, and only texts with candidates are normalised and searched.
    Up to ``INLINE_TERMS`` terms in all are part of the plan: no join, no shuffle, and streams can be read. With more, the
    words that pass a bitmap of the heads' hashes meet the list by equi-join.
    """
    low, nothing = _lower(text, fold), F.array().cast(f"array<{_ENTRY}>")

    def held(entries: Column, known: Column) -> Column:
        # Word borders of texts that are not folded can follow other alphabets: there the pattern decides.
        known = known if fold else F.lit(None).cast("array<string>")
        search = let(F.concat(F.lit(" "), _normal(text, fold), F.lit(" ")), lambda n: F.filter(entries, lambda e: _holds(n, e, known)))
        return F.when(F.size(entries) > 0, search).otherwise(nothing)

    inline = _inline(lists)
    if inline is not None:
        if not inline:
            return df.withColumn(out, nothing)
        entries = F.from_json(F.lit(json.dumps(inline)), f"map<string, array<{_ENTRY}>>")
        listed = lambda heads: F.flatten(F.transform(heads, lambda h: F.try_element_at(entries, h)))
        if len(inline) <= FEW_HEADS:
            met = let(low, lambda t: listed(F.filter(F.map_keys(entries), lambda h: F.contains(t, h))))
            return with_once(df, out, let(met, lambda c: held(c, F.lit(None).cast("array<string>"))))
        among = lambda words: F.array_intersect(words, F.map_keys(entries))
        met = let(low, lambda t: F.struct(among(_words(t)).alias("words"), among(_parts(t)).alias("parts")))
        return with_once(df, out, let(met, lambda m: held(listed(F.array_union(m["words"], m["parts"])), m["words"])))
    parts = [_table(df, t).select(F.lit(kind).alias("kind"), "term_order", "term") for kind, t in lists.items()]
    listed = functools.reduce(DataFrame.unionAll, parts).withColumn("plain", F.col("term").rlike(f"^{_RUN}$"))
    listed = staged(listed.withColumn("head", _head(F.col("term"))), "terms")
    passes = _head_filter(listed)
    rows = _identified(df, text)
    heads = let(low, lambda t: F.filter(F.array_union(_words(t), _parts(t)), passes))
    met = staged(rows.select(*_TEXT_ID, F.explode(heads).alias("head")).distinct(), "term-heads")
    entry = F.struct("kind", "term_order", "term", "plain")
    candidates = split_join(met, listed, ["head"]).groupBy(*_TEXT_ID).agg(F.collect_set(entry).alias("_met"))
    words = F.when(F.size("_met") > 0, _words(low)) if "exact" in lists else F.lit(None).cast("array<string>")
    return with_once(_with_hits(rows, candidates), out, let(words, lambda w: held(F.col("_met"), w))).drop("_met")


def _inline(lists: dict[str, Terms]) -> dict[str, list[dict]] | None:
    """The terms by head, where there are no more than ``INLINE_TERMS``."""
    found: dict[str, list[dict]] = {}
    left = INLINE_TERMS
    for kind, terms in lists.items():
        if isinstance(terms, DataFrame):
            terms = [(r.term, r.term_order) for r in terms.limit(left + 1).collect()]
        left -= len(terms)
        if left < 0:
            return None
        for term, order in terms:
            head = max(re.findall(_RUN, term), key=lambda x: (len(x), x), default="")
            found.setdefault(head, []).append({"kind": kind, "term_order": order, "term": term, "plain": head == term})
    return found


def _head_filter(listed: DataFrame) -> Callable[[Column], Column]:
    """A test that all heads of a list pass and most other words do not: a bitmap of hashes, of one size for any list."""
    bit = lambda h: F.pmod(F.xxhash64(h), F.lit(FILTER_BITS))
    words = listed.select(bit(F.col("head")).alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")))
    bits = [0] * (FILTER_BITS // 64)
    for w, b in words.collect():
        bits[w] = b
    bitmap = F.from_json(F.lit(json.dumps(bits)), "array<long>")
    return lambda run: F.getbit(F.get(bitmap, F.floor(bit(run) / 64).cast("int")), (bit(run) % 64).cast("int")) == 1


def _first(kind: str, found: str = "_found") -> Column:
    """The earliest listed of the found terms of a kind."""
    of_kind = F.transform(F.filter(found, lambda e: e["kind"] == kind), lambda e: F.struct(e["term_order"].alias("o"), e["term"].alias("t")))
    return F.array_min(of_kind)["t"]


def exact_block(
    df: DataFrame, terms: Sequence[str] | DataFrame, text: str = "text", out: str = "exact_term", fold: bool = False,
) -> DataFrame:
    """First listed term found as a whole word (case and spacing ignored), else null.

    ``fold`` reads the text with non-ASCII runs as spaces.
    """
    return found_terms(df, {"exact": term_list(terms)}, text, fold).withColumn(out, _first("exact")).drop("_found")


def _deletion_budgets(shapes: Sequence[tuple[int, int]], slack: float) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """How many characters candidates and terms may lose, by (word count, length); ``shapes`` are those of the terms.

    A term of length ``n`` and a candidate of length ``m`` pass only if they share a
    subsequence of at least ``(n - slack) * (m + n) / (2 * n)`` characters. Lengths that
    are absent from the first table cannot pass at all.
    """
    cand: dict[tuple[int, int], int] = {}
    term: dict[tuple[int, int], int] = {}
    for k, n in shapes:
        if slack >= n:
            raise ValueError("slack must be smaller than every term")
        for m in range(1, math.floor(n * (n + slack) / (n - slack) + 1e-9) + 1):
            need = math.ceil((n - slack) * (m + n) / (2 * n) - 1e-9)
            if need <= min(m, n):
                cand[k, m] = max(cand.get((k, m), 0), m - need)
                term[k, n] = max(term.get((k, n), 0), n - need)
    return cand, term


def _with_deletions(c: Column, depth: int) -> Column:
    """All strings reachable by deleting up to ``depth`` characters, the string itself included."""

    def shorter(s: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))),
            lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))),
        )

    pool = F.array(c)
    for _ in range(depth):
        pool = let(pool, lambda p: F.array_distinct(F.concat(p, F.flatten(F.transform(p, lambda s: shorter(s))))))
    return pool


def _up_to(c: Column, depth: Column, most: int) -> Column:
    out = None
    for d in range(most):
        out = F.when(depth == d, _with_deletions(c, d)) if out is None else out.when(depth == d, _with_deletions(c, d))
    last = _with_deletions(c, most)
    return last if out is None else out.otherwise(last)


def _budget_of(table: dict[tuple[int, int], int], n: int, length: Column) -> Column:
    """Characters that a string of ``n`` words may lose, by its length; null where it cannot pass."""
    longest = max((m for k, m in table if k == n), default=0)
    return F.get(F.array(*[F.lit(table.get((n, m))).cast("int") for m in range(longest + 1)]), length)


def word_ngrams(norm: Column, budgets: dict[tuple[int, int], int]) -> Column:
    """Distinct runs of words that have a budget, as ``(gram, n_words, depth)``.

    One pattern for each number of words finds the runs, overlapping ones too, whose words are not too long.
    """

    def runs(text: Column, n: int) -> Column:
        sizes = [m for k, m in budgets if k == n]
        word = f"[^ ]{{{min(sizes) if n == 1 else 1},{max(sizes)}}}"
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?:^|(?<= ))(?=({word}(?: {word}){{{n - 1}}})(?![^ ]))"), F.lit(1)))
        depth = lambda g: _budget_of(budgets, n, F.length(g))
        possible = F.filter(F.filter(found, lambda g: F.length(g).between(min(sizes), max(sizes))), lambda g: depth(g).isNotNull())
        return F.transform(possible, lambda g: F.struct(g.alias("gram"), F.lit(n).alias("n_words"), depth(g).alias("depth")))

    counts = sorted({k for k, _ in budgets})
    return let(norm, lambda text: F.concat(*[runs(text, n) for n in counts]))


def _enough_pairs(listed: DataFrame) -> Column:
    """Whether a gram has enough neighbouring characters that may be neighbours in a term of as many words.

    What is left of a gram and a term that pass is the same string. Neighbours in it lie in the term no farther apart than
    the characters it loses allow, and each character that the gram loses parts two of its pairs at most.
    """
    at = listed.select("n_words", "term", "depth", F.explode(F.sequence(F.lit(1), F.length("term"))).alias("i"))
    at = at.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("i") + F.col("depth") + 1)))
    at = at.select("n_words", F.substring("term", F.col("i"), F.lit(1)).alias("a"), F.substring("term", F.col("j"), F.lit(1)).alias("b"))
    pairs = at.where("b <> ''").distinct().limit(MOST_PAIRS + 1).collect()
    if len(pairs) > MOST_PAIRS:
        return F.lit(True)
    after: dict[int, dict[str, list[str]]] = {}
    for n, a, b in pairs:
        after.setdefault(n, {}).setdefault(a, []).append(b)
    quoted = lambda c: c if c.isalnum() else "\\" + c
    known = None
    for n, chars in after.items():
        pattern = "|".join(f"{quoted(a)}(?=[{''.join(map(quoted, sorted(bs)))}])" for a, bs in sorted(chars.items()))
        count = F.size(F.regexp_extract_all("gram", F.lit(pattern), F.lit(0)))
        known = F.when(F.col("n_words") == n, count) if known is None else known.when(F.col("n_words") == n, count)
    if known is None:
        return F.lit(True)
    return F.coalesce(known, F.lit(0)) >= F.length("gram") - 1 - 2 * F.col("depth")


def _similar_hits(rows: DataFrame, terms: DataFrame, cand: dict, term: dict, text: str, slack: float, fold: bool) -> DataFrame:
    """``(text id, partial_term)`` of texts that hold a word run similar to a term, the earliest listed first.

    Two strings that pass share a common subsequence, so they meet on a string reached by deleting a few
    characters from each: an equi-join finds every candidate without comparing all pairs, and the ratio itself
    decides.
    """
    grams = staged(rows.select(*_TEXT_ID, F.inline(word_ngrams(_normal(text, fold), cand))).distinct(), "term-grams")
    n_words = F.size(F.split("term", " "))
    depth = functools.reduce(lambda a, n: F.coalesce(a, F.when(n_words == n, _budget_of(term, n, F.length("term")))), sorted({k for k, _ in term}), F.lit(None).cast("int"))
    listed = terms.select("term", "term_order", n_words.alias("n_words"), depth.alias("depth"), ((F.length("term") - slack) / F.length("term")).alias("floor"))
    left = grams.select("gram", "n_words", "depth").distinct().where(_enough_pairs(listed)).withColumn("_sig", F.explode(_up_to(F.col("gram"), F.col("depth"), max(cand.values())))).drop("depth")
    right = listed.withColumn("_sig", F.explode(_up_to(F.col("term"), F.col("depth"), max(term.values())))).drop("depth")
    pairs = left.join(right, ["n_words", "_sig"], "inner").select("gram", "term", "term_order", "floor").distinct()
    # Usually few: staged, so that Spark knows their size when it plans the join back.
    hits = staged(pairs.where(similar("gram", "term", "floor")).groupBy("gram").agg(F.min_by("term", "term_order").alias("term"), F.min("term_order").alias("term_order")), "term-hits")
    return split_join(grams, hits, ["gram"]).groupBy(*_TEXT_ID).agg(F.min_by("term", "term_order").alias("partial_term"))


def _partial_terms(listed: Terms, min_chars: int, slack: float) -> tuple[Terms, dict, dict]:
    """The terms long enough for a partial match, and how many characters candidates and terms may lose.

    The (words, length) shapes of a list, which are few, fix that.
    """
    if isinstance(listed, DataFrame):
        long: Terms = listed.where(F.length("term") >= min_chars)
        shapes = {(int(a), int(b)) for a, b in long.select(F.size(F.split("term", " ")), F.length("term")).distinct().collect()}
    else:
        long = [(t, i) for t, i in listed if len(t) >= min_chars]
        shapes = {(t.count(" ") + 1, len(t)) for t, _ in long}
    return long, *_deletion_budgets(sorted(shapes), slack)


def add_partial(
    df: DataFrame, terms: Sequence[str] | DataFrame, text: str = "text", min_chars: int = 6, slack: float = 0.4,
    fold: bool = False, where: Column | None = None,
) -> DataFrame:
    """Every row plus ``partial_term``, looked for only where ``where`` holds (null: not).

    Similar means a matching-block ratio of at least ``(len - slack) / len`` between a run of words and a term of as
    many words. Null texts hold nothing. A slack that allows no deletion asks for the term itself, which is found like
    the whole words of :func:`exact_block`.
    """
    asked = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    long, cand, term = _partial_terms(term_list(terms), min_chars, slack)
    if not any(cand.values()) and not any(term.values()):
        found = found_terms(df, {"partial": long}, text, fold)
        return found.withColumn("partial_term", F.when(asked, _first("partial"))).drop("_found")
    rows = _identified(df.withColumn("_asked", asked), text)
    found = _with_hits(rows, _similar_hits(rows.where("_asked"), _table(df, long), cand, term, text, slack, fold))
    return found.withColumn("partial_term", F.when(F.col("_asked"), F.col("partial_term"))).drop("_asked")


def partial_block(
    df: DataFrame, terms: Sequence[str] | DataFrame, key: str, text: str = "text", min_chars: int = 6, slack: float = 0.4,
    fold: bool = False,
) -> DataFrame:
    """Rows whose text holds a word run similar to a term: ``(key, partial_term)``, one for each such row."""
    found = add_partial(df.select(key, text), terms, text, min_chars, slack, fold)
    return found.where("partial_term IS NOT NULL").select(key, "partial_term")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _bare(token: Column) -> Column:
    return F.lower(strip_punctuation(token))


def censor(df: DataFrame, terms: Sequence[str] | DataFrame, allow: Sequence[str] | DataFrame = (), text: str = "text") -> DataFrame:
    """Mask listed single words, except allowed ones; adds ``censored`` and ``blocked``.

    Words are compared without surrounding punctuation and case.
    """
    found = found_terms(df, {"censor": _single_words(df, terms, allow)}, text, False)
    listed = F.coalesce(F.transform("_found", lambda e: e["term"]), F.array().cast("array<string>"))
    # Most texts hold no listed word, and their tokens stay as they are.
    tokens = _tokens(F.col(text))
    masked = F.transform(tokens, lambda t: F.when(F.array_contains(listed, _bare(t)), F.lit(CENSORED)).otherwise(t))
    flagged = with_once(found, "censored", F.concat_ws(" ", F.when(F.size(listed) > 0, masked).otherwise(tokens))).drop("_found")
    return flagged.withColumn("blocked", F.col("censored").contains(CENSORED))


def has_censored(
    df: DataFrame, terms: Sequence[str] | DataFrame, allow: Sequence[str] | DataFrame = (), text: str = "text", out: str = "blocked",
    fold: bool = False,
) -> DataFrame:
    """Only the flag of :func:`censor`."""
    found = found_terms(df, {"censor": _single_words(df, terms, allow)}, text, fold)
    return found.withColumn(out, _is_censored(text, fold)).drop("_found")


def _is_censored(text: str, fold: bool) -> Column:
    read = to_ascii(text) if fold else F.col(text)
    listed = F.coalesce(F.exists("_found", lambda e: e["kind"] == "censor"), F.lit(False))
    return listed | F.coalesce(read.contains(CENSORED), F.lit(False))


def screen(df: DataFrame, rules: Sequence[tuple[str, Column]], text: str = "text", safe: str = "Prompt is safe") -> DataFrame:
    """Rule cascade. Each rule is ``(name, reason column)``; a non-null reason blocks.

    Empty input is unsafe; the first rule that blocks names the reason.
    """
    empty = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.lit("Input is empty"))
    reasons = [F.when(c.isNotNull(), F.concat(F.lit(f"{name.upper()}: "), c)) for name, c in rules]
    blocked = F.coalesce(empty, *reasons)
    return df.withColumn("is_safe", blocked.isNull()).withColumn("message", F.coalesce(blocked, F.lit(safe)))


def blocklist_screen(
    df: DataFrame, key: str, terms: Sequence[str] | DataFrame, allow: Sequence[str] | DataFrame = (),
    exact_terms: Sequence[str] | DataFrame | None = None, text: str = "text", min_chars: int = 6, slack: float = 0.4,
) -> DataFrame:
    """The full text screen: censor list, whole-word list, then partial matches on the rest.

    ``key`` may be null or repeated: no join uses it. Lists may be tables. All lists are looked up in one pass over the
    texts; only a slack that allows deletions needs a second one, over the texts that the other lists let through. ``df``
    may be a stream where the lists have no more than ``INLINE_TERMS`` terms in all and the slack allows no deletion;
    for other lists see :func:`kinetable.streaming.jobs.screen_batches`.
    """
    if key not in df.columns:
        raise ValueError(f"no column {key!r}")
    exact_terms = terms if exact_terms is None else exact_terms
    listed = term_list(exact_terms)
    long, cand, term = _partial_terms(listed, min_chars, slack)
    fuzzy = any(cand.values()) or any(term.values())
    lists = {"censor": _single_words(df, terms, allow), "exact": listed, **({} if fuzzy else {"partial": long})}
    found = found_terms(df, lists, text, True).withColumn("_blocked", _is_censored(text, True)).withColumn("exact_term", _first("exact"))
    undecided = ~F.col("_blocked") & F.col("exact_term").isNull()
    if fuzzy:
        found = add_partial(found, exact_terms, text, min_chars, slack, True, undecided)
    else:
        found = found.withColumn("partial_term", F.when(undecided, _first("partial")))
    rules = [
        ("censor", F.when(F.col("_blocked"), F.lit("censored word"))),
        ("exact", F.col("exact_term")),
        ("partial", F.col("partial_term")),
    ]
    return screen(found, rules, text).drop("_blocked", "_found")


def parse_safety_label(c: Column | str) -> Column:
    """``Safety: <label>`` outputs; only ``Unsafe`` blocks, a missing label passes."""
    label = F.nullif(F.regexp_extract(c, r"Safety: (Safe|Unsafe|Controversial)", 1), F.lit(""))
    found = F.regexp_extract_all(c, F.lit("(" + "|".join(LABEL_CATEGORIES) + ")"), 1)
    return F.struct(
        label.alias("label"), found.alias("categories"),
        (F.coalesce(F.lower(label), F.lit("")) != "unsafe").alias("is_safe"),
    )


def parse_category_codes(df: DataFrame, output: str = "output", names: dict[str, str] | None = None) -> DataFrame:
    """``unsafe`` plus comma-separated codes on later lines; unknown codes are ignored."""
    names = CODE_CATEGORIES if names is None else names
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    lines = F.split(F.trim(output), r"\r\n|\n|\r")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    cleaned = F.transform(rest, lambda l: F.trim(F.get(F.split(l, r"<\|eot_id\|>"), F.lit(0))))
    codes = F.transform(F.flatten(F.transform(cleaned, lambda l: F.split(l, ","))), lambda k: F.trim(k))
    known = F.filter(F.transform(codes, lambda k: F.try_element_at(table, k)), lambda n: n.isNotNull())
    unsafe = F.lower(output).contains("unsafe")
    text = F.concat_ws(", ", known)
    return df.withColumn("is_safe", ~unsafe).withColumn("violations", F.when(unsafe, text).otherwise(""))


def frame_vote(
    frames: DataFrame, by: str = "video_id", unsafe: str = "unsafe", cutoff: float = UNSAFE_FRAME_CUTOFF
) -> DataFrame:
    """A video is unsafe when more than ``cutoff`` of its frames are.

    Frames whose classifier failed (null) count in the total only.
    """
    g = frames.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_frames"), F.count_if(F.col(unsafe) == 1).alias("unsafe_frames")
    )
    return g.withColumn("is_safe", ~(F.col("unsafe_frames") / F.col("total_frames") > cutoff))
