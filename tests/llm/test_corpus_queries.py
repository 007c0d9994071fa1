"""The registered corpus queries, and the pipeline against a brute-force version."""

import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from messy_tables import SF_DIR, messy  # noqa: F401
from kinetable.llm.queries import QUERIES, tokenizer_path
from test_corpus_operators import brute_components, brute_lines

SMALL = SF_DIR

COLUMNS = {
    1: "doc_id n_shingles component_id kept", 2: "doc_id held_out score predicted", 3: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    4: "doc_id held_out score predicted", 5: "doc_id held_out lang_pred score", 6: "doc_id n_words n_hit n_items items_sha256 contaminated",
    7: "page_id url text n_chars", 8: "doc_id n_lines n_dropped kept_sha256", 9: "doc_id n_tokens ids_sha256 decoded_sha256",
    10: "doc_id size text_crc32 law shard slot grown_shard", 12: "vec_id component n deviation whitened explained identity_error",
    11: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", 13: "doc_id size source_size target taken",
}


def test_each_operator_has_one_query():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES]
    assert sorted(numbers) == sorted(COLUMNS)


def test_contract_columns(spark):
    for name, fn in QUERIES.items():
        df = fn(spark, SMALL)
        assert df.columns == COLUMNS[int(name[2:].split("_")[0])].split(), name


def test_pipeline(spark):
    from tokenizers import Tokenizer

    from kinetable.llm.quality_rules import keep_good

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in keep_good(docs).select("doc_id", "text").collect()]
    rows = [(i, "\n".join(k)) for (i, _), k in zip(rows, brute_lines([t for _, t in rows], 10))]
    component = brute_components(rows)
    rows = [(i, t) for i, t in rows if component[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    grams = {g for _, t in items for g in [brute_words(t)[k: k + 13] for k in range(len(brute_words(t)))] for g in [tuple(g)] if len(g) == 13}
    clean = []
    for i, t in rows:
        w = brute_words(t)
        hit = {k + j for k in range(len(w) - 12) if tuple(w[k: k + 13]) in grams for j in range(13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((i, t))
    assert 0 < len(clean) < docs.count()
    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in clean:
        ids = tok.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SMALL).collect()) == want


def brute_words(text):
    import re

    from test_corpus_operators import LOWER

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
        assert stage(spark, docs.limit(0), SMALL).collect() == []


def test_stages_on_messy_rows(spark, messy):
    """Nulls in every column, blank and long texts, repeated rows and ids, and columns called as the operators' own."""
    prose = " ".join(f"word{i} the of{i} and{i}" for i in range(80))
    extra = [(900, prose, "en", "s", 1, "r", 1, "x", 2)] * 2 + [(901, prose + " end.", None, None, None, None, None, None, None)]
    messy = messy.union(spark.createDataFrame(extra, messy.schema))
    rows = Counter((r.doc_id, r.text) for r in messy.collect())
    wordless = Counter({k: n for k, n in rows.items() if not (k[1] or "").split()})
    good, lines, firsts, clean = (stage(spark, messy, SMALL) for _, stage in corpus_pipeline.STAGES[:-1])
    kept = {}
    for name, out in (("good", good), ("lines", lines), ("firsts", firsts), ("clean", clean)):
        assert out.columns == messy.columns and out.schema == messy.schema, name
        kept[name] = Counter((r.doc_id, r.text) for r in out.collect())
    assert all(len((t or "").split()) >= 50 and rows[i, t] == n for (i, t), n in kept["good"].items()) and kept["good"][900, prose] == 2
    assert sum(kept["lines"].values()) == messy.count() and Counter(i for i, _ in kept["lines"].elements()) == Counter(i for i, _ in rows.elements())
    assert sum(n for (_, t), n in kept["lines"].items() if t is None) == sum(n for (_, t), n in rows.items() if t is None)
    for name in ("firsts", "clean"):
        assert not kept[name] - rows and not wordless - kept[name]
    assert sum(kept["firsts"].values()) < sum(rows.values())
    last = corpus_pipeline.STAGES[-1][1](spark, messy, SMALL).collect()
    assert Counter(r.doc_id for r in last) == Counter(i for i, _ in rows.elements())
    assert {r.n_tokens for r in last if (r.doc_id, None) in rows and rows[r.doc_id, None]} >= {0}
