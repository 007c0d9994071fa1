"""Text matching against brute force."""

import random
import re
import string
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kinetable.operators import safety as S


def brute_partial(text, terms, min_chars, slack):
    words = text.lower().split()
    for w in S.normalize_terms(terms):
        if len(w) < min_chars:
            continue
        n = len(w.split())
        for i in range(len(words) - n + 1):
            if SequenceMatcher(None, " ".join(words[i : i + n]), w).ratio() >= (len(w) - slack) / len(w):
                return w
    return None


@pytest.mark.parametrize("slack", [0.4, 0.5, 1.0, 1.5])
def test_partial_block_equals_all_pairs(spark, slack):
    rng = random.Random(int(slack * 10))
    terms = ["badword", "very bad", "dangerous thing", "abcabcabc", "short", "poisonous"]

    def garble(w):
        s = list(w)
        for _ in range(rng.randint(0, 3)):
            k, c = rng.randrange(len(s)), rng.choice("abcdxy0 ")
            kind = rng.random()
            if kind < 0.35:
                s[k] = c
            elif kind < 0.7:
                s.insert(k, c)
            elif len(s) > 3:
                del s[k]
        return "".join(s)

    texts = [" ".join([rng.choice(["clean", "prompt", "a"]), garble(rng.choice(terms)), rng.choice(["here", "badly", "x"])]) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.partial_term for r in S.partial_block(df, terms, "id", slack=slack).collect()}
    want = {i: brute_partial(t, terms, 6, slack) for i, t in enumerate(texts)}
    assert got == {i: w for i, w in want.items() if w}
    assert got


def test_partial_block_known_cases(spark):
    df = spark.createDataFrame([(1, "this contains badword in the middle"), (2, "this is a clean prompt"), (3, "this contains badw0rd here")], "id int, text string")

    def hits(slack):
        return {r.id for r in S.partial_block(df, ["badword"], "id", slack=slack).collect()}

    assert hits(0.4) == {1} and hits(0.5) == {1} and hits(1.0) == {1, 3}


def test_exact_block_names_the_first_listed_term(spark):
    df = spark.createDataFrame([(1, "x  Foo   BAR y alpha"), (2, "foobar"), (3, "alpha.")], "id int, text string")
    got = {r.id: r.exact_term for r in S.exact_block(df, ["foo bar", "alpha"]).collect()}
    assert got == {1: "foo bar", 2: None, 3: "alpha"}
    many = [f"zz{i}" for i in range(1200)] + ["alpha"]
    assert {r.id: r.exact_term for r in S.exact_block(df, many).collect()} == {1: "alpha", 2: None, 3: "alpha"}


def test_censor_and_allow_list(spark):
    df = spark.createDataFrame([(1, "A Bad, dog"), (2, "good dog")], "id int, text string")
    out = {r.id: (r.censored, r.blocked) for r in S.censor(df, ["bad", "dog"], ["Dog"]).collect()}
    assert out == {1: ("A **** dog", True), 2: ("good dog", False)}


def test_screen_reports_the_first_rule(spark):
    df = spark.createDataFrame([(1, ""), (2, "b a"), (3, "c")], "id int, text string")
    rules = [("one", F.when(F.col("text").contains("a"), F.lit("has a"))), ("two", F.when(F.col("text").contains("b"), F.lit("has b")))]
    got = {r.id: (r.is_safe, r.message) for r in S.screen(df, rules).collect()}
    assert got == {1: (False, "Input is empty"), 2: (False, "ONE: has a"), 3: (True, "Prompt is safe")}


def test_moderation_outputs(spark):
    df = spark.createDataFrame([(1, "Safety: Unsafe\nCategories: Violent"), (2, "oops")], "id int, output string")
    got = {r.id: (r.p.label, r.p.is_safe) for r in df.select("id", S.parse_safety_label("output").alias("p")).collect()}
    assert got == {1: ("Unsafe", False), 2: (None, True)}
    codes = spark.createDataFrame([("unsafe\nS9,S10<|eot_id|>",), ("safe",), ("unsafe",)], "output string")
    assert [r.violations for r in S.parse_category_codes(codes).collect()] == ["Indiscriminate Weapons, Hate", "", ""]


def test_frame_vote_cutoff_is_strict(spark):
    rows = [("a", 1)] + [("a", 0)] * 9 + [("b", 1), ("b", 1)] + [("b", None)] * 8
    got = {r.video_id: r.is_safe for r in S.frame_vote(spark.createDataFrame(rows, "video_id string, unsafe int")).collect()}
    assert got == {"a": True, "b": False}


def test_folding_and_flags_agree_with_the_plain_forms(spark):
    df = spark.createDataFrame(
        [(1, "fooébar baz"), (2, "FOO bar"), (3, "Key"), (4, "say (Bad)!"), (5, "badü ok"), (6, "keys foo  bar")],
        "id int, text string",
    )
    from kinetable.functions.text import to_ascii

    folded = df.withColumn("text", to_ascii("text"))
    terms = ["foo bar", "key", "bad"]
    a = {r.id: r.exact_term for r in S.exact_block(df, terms, fold=True).collect()}
    b = {r.id: r.exact_term for r in S.exact_block(folded, terms).collect()}
    assert a == b == {1: "foo bar", 2: "foo bar", 3: None, 4: "bad", 5: "bad", 6: "foo bar"}
    c = {r.id: r.blocked for r in S.has_censored(df, terms, fold=True).collect()}
    assert c == {r.id: r.blocked for r in S.censor(folded, terms).collect()} == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False}


def _screened(df, terms, censored):
    out = S.blocklist_screen(df, "id", censored, ["fine"], terms)
    return sorted((str(r.id), r.text or "", r.message) for r in out.collect())


@pytest.mark.parametrize("limit", [0, 2000])
def test_lists_inside_the_plan_and_joined_lists_agree(spark, monkeypatch, limit):
    """Terms with underscores, punctuation, no letters at all; null and repeated keys; a text copied into half the rows."""
    monkeypatch.setattr(S, "INLINE_TERMS", limit)
    monkeypatch.setattr(S, "FEW_HEADS", 2)
    texts = [
        "a plain text", "has foo_bar inside", "has foo bar inside", "foo_barred", "_bad_ token", "unbad token", "(Bad), token", "fine token", "x *** y", "***",
        "say one-two now", "say one two now", "oneK two", "caf\u00e9bar here", "bar", "", None, "verylongterm!", "a verylongterm b", "FOO  BAR", "e\\Ed", "**** masked",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "has foo bar inside"), (1, "bar")] + [(100 + i, "copied verylongterm text") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string")
    terms = ["foo bar", "foo_bar", "bar", "***", "one-two", "one", "verylongterm", "\\E"]
    censored = ["bad", "fine", "not one", ".bad."]

    def brute(text):
        if not text:
            return "Input is empty"
        folded = re.sub(r"[^\x00-\x7F]+", " ", text)
        if S.CENSORED in folded or any(w.strip(string.punctuation).lower() == "bad" for w in folded.split()):
            return "CENSOR: censored word"
        norm = re.sub(r"\s+", " ", folded).strip().lower()
        for term in S.normalize_terms(terms):
            if re.search(rf"\b{re.escape(term)}\b", norm):
                return f"EXACT: {term}"
        hit = brute_partial(norm, terms, 6, 0.4)
        return f"PARTIAL: {hit}" if hit else "Prompt is safe"

    assert _screened(df, terms, censored) == sorted((str(i), t or "", brute(t)) for i, t in rows)


def test_short_lists_need_no_join_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    plan = S.blocklist_screen(df, "id", ["bad"], [], ["very bad", "worse"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("Generate") == 1


def test_stream_of_prompts_with_long_lists(spark, monkeypatch, tmp_path):
    from kinetable.streaming.jobs import screen_batches

    monkeypatch.setattr(S, "INLINE_TERMS", 2)
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"text {i} term{i % 7}x") for i in range(40)]
    spark.createDataFrame(rows, "id int, text string").repartition(4).write.parquet(inbox)
    stream = spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", 1).parquet(inbox)
    listed = spark.createDataFrame([(f"Term{i}X", i) for i in range(5)], "term string, term_order long")
    screen_batches(stream, "id", [], out, str(tmp_path / "ckpt"), exact_terms=listed)
    got = {r.id: r.message for r in spark.read.parquet(out).collect()}
    assert got == {i: f"EXACT: term{i % 7}x" if i % 7 < 5 else "Prompt is safe" for i in range(40)}
