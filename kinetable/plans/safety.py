"""Queries over prompt and frame safety."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from kinetable.functions.text import norm_text, strip_punctuation, to_ascii
from kinetable.operators import safety as S
from kinetable.plans.fixtures import view
from kinetable.plans.registry import query, r, rs

# Words of the test corpus stand in for a block list.
TERMS = ("erblest", "then  en", "Thinly", "whou", "therouou", "hein")
ALLOW = ("thinly",)
LONG_TERMS = ("therouou", "thesened", "heention", "ofanthedin hesh")

_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]+', ' ', 'g')"


def _norm(x):
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


@query("x17_to_ascii", f"SELECT doc_id, length({_ASCII}) AS n, md5({_ASCII}) AS digest FROM documents")
def _(t):
    d = t["documents"].select("doc_id", to_ascii("text").alias("a"))
    return d.select("doc_id", F.length("a").cast("long").alias("n"), F.md5("a").alias("digest"))


@query("x18_norm_text", f"SELECT doc_id, length({_norm(_ASCII)}) AS n, md5({_norm(_ASCII)}) AS digest FROM documents")
def _(t):
    d = t["documents"].select("doc_id", norm_text(to_ascii("text")).alias("a"))
    return d.select("doc_id", F.length("a").cast("long").alias("n"), F.md5("a").alias("digest"))


_WORDS = S.normalize_terms(TERMS)
_FIRST = "CASE " + " ".join(f"WHEN regexp_matches(z, '\\b{w}\\b') THEN '{w}'" for w in _WORDS) + " END"


@query("x19_exact_block", f"WITH d AS (SELECT doc_id, {_norm(_ASCII)} AS z FROM documents) SELECT doc_id, {_FIRST} AS exact_term FROM d WHERE {_FIRST} IS NOT NULL")
def _(t):
    return S.exact_block(t["documents"].select("doc_id", "text"), TERMS, fold=True).where("exact_term IS NOT NULL").select("doc_id", "exact_term")


def _gram_sql(terms):
    words = S.normalize_terms(terms)
    values = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    return f"""WITH d AS (SELECT doc_id, string_split({_norm(_ASCII)}, ' ') AS w FROM documents),
    g AS (SELECT doc_id, unnest(w) AS gram FROM d UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) FROM d),
    h AS (SELECT doc_id, arg_min(term, o) AS partial_term FROM g JOIN (VALUES {values}) AS t(o, term) ON gram = term GROUP BY doc_id)"""


# With the default slack a passing run of words equals the term, so SQL can state it.
@query("x20_partial_block", _gram_sql(LONG_TERMS) + " SELECT doc_id, partial_term FROM h")
def _(t):
    return S.partial_block(t["documents"].select("doc_id", "text"), LONG_TERMS, "doc_id", fold=True)


# The matching-block ratio is no edit distance that SQL could state; tests hold it against all pairs.
@query("x20_partial_block_one_letter")
def _(t):
    return S.partial_block(t["documents"].select("doc_id", "text"), LONG_TERMS, "doc_id", slack=1.0, fold=True)


# Hundreds of terms from the benchmark's own words, in a table; rows of null key, and every key twice.
_MANY = f"""b AS (SELECT DISTINCT unnest(string_split({_norm("regexp_replace(b.text, '[^A-Za-z ]', ' ', 'g')")}, ' ')) AS term FROM benchmark b),
    m AS (SELECT term, row_number() OVER (ORDER BY term) AS o FROM b WHERE length(term) >= 6),
    d AS (SELECT doc_id, {_norm(_ASCII)} AS z FROM documents), w AS (SELECT DISTINCT doc_id, unnest(string_split(z, ' ')) AS gram FROM d),
    h AS (SELECT doc_id, arg_min(term, o) AS partial_term FROM w JOIN m ON gram = term GROUP BY doc_id)"""


def many_terms(t):
    words = F.explode(F.split(norm_text(F.regexp_replace("text", "[^A-Za-z ]", " ")), " "))
    b = t["benchmark"].select(words.alias("term")).where(F.length("term") >= 6).distinct()
    return b.select("term", F.rank().over(Window.partitionBy(F.lit(0)).orderBy("term")).alias("term_order"))


@query("x20_partial_many_terms", f"WITH {_MANY} SELECT doc_id, partial_term, CAST(2 AS BIGINT) AS n FROM h WHERE doc_id % 10 <> 0 UNION ALL SELECT NULL, partial_term, 2 * count(*) FROM h WHERE doc_id % 10 = 0 GROUP BY partial_term")
def _(t):
    d = t["documents"].select(F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("doc_id"), "text")
    return S.partial_block(d.union(d), many_terms(t), "doc_id", fold=True).groupBy("doc_id", "partial_term").agg(F.count(F.lit(1)).alias("n"))


@query("x22_screen_many_terms", f"""WITH {_MANY}, x AS (SELECT d.doc_id, arg_min(m.term, m.o) AS exact_term FROM d JOIN m ON regexp_matches(d.z, '\\b' || m.term || '\\b') GROUP BY d.doc_id)
    SELECT d.doc_id, CASE WHEN x.exact_term IS NOT NULL THEN 'EXACT: ' || x.exact_term WHEN h.partial_term IS NOT NULL THEN 'PARTIAL: ' || h.partial_term ELSE 'Prompt is safe' END AS message
    FROM d LEFT JOIN x USING (doc_id) LEFT JOIN h USING (doc_id)""")
def _(t):
    return S.blocklist_screen(t["documents"].select("doc_id", "text"), "doc_id", [], [], many_terms(t)).select("doc_id", "message")


_BAD = ", ".join(f"'{w}'" for w in sorted({w.strip().lower() for w in TERMS} - set(ALLOW)))
_MASK = f"""array_to_string(list_transform(list_filter(string_split(regexp_replace({_ASCII}, '\\s+', ' ', 'g'), ' '), lambda x: x <> ''),
    lambda x: CASE WHEN lower(regexp_replace(regexp_replace(x, '^[[:punct:]]+', ''), '[[:punct:]]+$', '')) IN ({_BAD}) THEN '****' ELSE x END), ' ')"""


@query("x21_censor", f"WITH c AS (SELECT doc_id, {_MASK} AS m FROM documents) SELECT doc_id, md5(m) AS digest, contains(m, '****') AS blocked FROM c")
def _(t):
    d = t["documents"].select("doc_id", to_ascii("text").alias("text"))
    return S.censor(d, TERMS, ALLOW).select("doc_id", F.md5("censored").alias("digest"), "blocked")


@query("x22_screen", f"""{_gram_sql(LONG_TERMS)}, c AS (SELECT doc_id, text, {_MASK} AS m, {_norm(_ASCII)} AS z FROM documents),
    e AS (SELECT doc_id, CASE WHEN text = '' THEN 'Input is empty' WHEN contains(m, '****') THEN 'CENSOR: censored word'
      {' '.join(f"WHEN regexp_matches(z, '{chr(92)}b{w}{chr(92)}b') THEN 'EXACT: {w}'" for w in S.normalize_terms(LONG_TERMS))}
      ELSE 'PARTIAL: ' || partial_term END AS msg FROM c LEFT JOIN h USING (doc_id))
    SELECT doc_id, msg IS NULL AS is_safe, coalesce(msg, 'Prompt is safe') AS message FROM e""")
def _(t):
    s = S.blocklist_screen(t["documents"].select("doc_id", "text"), "doc_id", TERMS, ALLOW, LONG_TERMS)
    return s.select("doc_id", "is_safe", "message")


_LABEL = "CASE doc_id % 4 WHEN 0 THEN 'Safety: Safe' WHEN 1 THEN 'Safety: Unsafe' || chr(10) || 'Categories: Violent, Jailbreak' WHEN 2 THEN 'Safety: Controversial' || chr(10) || 'Categories: Unethical Acts' ELSE 'no verdict ' || text END"


@query("x23_parse_safety_label", """SELECT doc_id, coalesce(CASE doc_id % 4 WHEN 0 THEN 'Safe' WHEN 1 THEN 'Unsafe' WHEN 2 THEN 'Controversial' END, '') AS label,
    CASE doc_id % 4 WHEN 1 THEN 'Violent,Jailbreak' WHEN 2 THEN 'Unethical Acts' ELSE '' END AS categories, doc_id % 4 <> 1 AS is_safe FROM documents""")
def _(t):
    d = t["documents"].select("doc_id", F.expr(_LABEL.replace("chr(10)", "char(10)")).alias("output"))
    p = d.select("doc_id", S.parse_safety_label(F.col("output")).alias("p"))
    return p.select("doc_id", F.coalesce("p.label", F.lit("")).alias("label"), F.concat_ws(",", "p.categories").alias("categories"), "p.is_safe")


@query("x24_parse_category_codes", """SELECT doc_id, doc_id % 3 <> 0 AS is_safe, CASE WHEN doc_id % 3 <> 0 THEN '' WHEN doc_id % 2 = 0 THEN 'Violent Crimes, Hate' ELSE 'Privacy' END AS violations FROM documents""")
def _(t):
    out = F.when(F.col("doc_id") % 3 != 0, "safe<|eot_id|>").when(F.col("doc_id") % 2 == 0, "unsafe\nS1, S10<|eot_id|>").otherwise("unsafe\nS99,S7<|eot_id|>")
    return S.parse_category_codes(t["documents"].select("doc_id", out.alias("output"))).select("doc_id", "is_safe", "violations")


@query("a17_frame_vote", view("frame_votes") + " SELECT video_id, count(*) AS total_frames, sum(unsafe)::BIGINT AS unsafe_frames, NOT (sum(unsafe) / count(*)::DOUBLE > 0.1::DOUBLE) AS is_safe FROM frame_votes GROUP BY video_id")
def _(t):
    return S.frame_vote(t["frame_votes"])
