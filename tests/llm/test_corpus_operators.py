"""Operators against brute force, and their defined results on nulls, empties, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from messy_tables import SF_DIR, messy, nothing  # noqa: F401
from kinetable.llm import (
    bpe, decontaminate, html_text, language_id, line_dedup, near_dedup, quality_model, quality_rules, sharding, toxicity,
)
from kinetable.llm.common import fold
from kinetable.llm.queries import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_set(text):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    """rows: (id, text). Every pair compared; equal ids are one node."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_near_duplicates(messy):
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    got = near_dedup.near_duplicates(messy).collect()
    assert len(got) == len(rows)
    want = brute_components([r for r in rows if r[0] is not None])
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingle_set(t))) for i, t in rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    copies = {r.component_id for r in got if r.doc_id is None}
    assert copies == {want[9], None}


def test_near_duplicates_of_one_id_with_several_texts(spark):
    """Both texts of document 1 have as many shingles; each has its own near copy."""
    rnd = random.Random(8)
    a, b = ([f"{rnd.randrange(10 ** 6)}" for _ in range(60)] for _ in range(2))
    near = lambda w: " ".join(w[:-1] + ["other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, near(a)), (6, near(b)), (7, "x " + " ".join(b)), (8, "nothing like it at all here")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_components(rows) == {1: 1, 5: 1, 6: 1, 7: 1, 8: 8}


def test_near_duplicates_dense_group(spark):
    """A group whose members differ in places: chains of links, buckets with several components."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows, now = [], list(base)
    for i in range(150):
        if rnd.random() < 0.3:
            now = list(base)
        now[rnd.randrange(60)] = f"v{rnd.randrange(4)}"
        rows.append((i, " ".join(now)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == brute_components(rows)


def test_near_dedup_keeps_columns(messy, nothing):
    out = near_dedup.keep_first(messy)
    assert out.columns == messy.columns
    assert near_dedup.near_duplicates(nothing).collect() == [] and near_dedup.keep_first(nothing).collect() == []


def test_near_dedup_of_any_ids(spark):
    """Ids use all 64 bits; rows without id are judged by their own flag, and a component without ids keeps one row."""
    text = lambda *w: " ".join(f"{x}{i}" for x in w for i in range(12))
    ids = [-(1 << 63), -5, 0, (1 << 62) - 1, 1 << 62, (1 << 62) + 77, (1 << 63) - 1]
    rows = [(i, text(f"a{n}x", f"b{n}x")) for n, i in enumerate(ids)]
    copies = [((1 << 62) + 5, rows[0][1]), ((1 << 63) - 2, rows[4][1]), (None, rows[4][1]), (None, rows[0][1])]
    bare = [(None, text("c", "d")), (None, text("c", "d").upper()), (None, text("c", "d") + " end"), (None, text("e", "f")), (None, " "), (None, " "), (None, None)]
    df = spark.createDataFrame(rows + copies + bare, "doc_id long, text string")
    got = near_dedup.near_duplicates(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows + copies + bare)
    want = {**{i: i for i in ids}, (1 << 62) + 5: ids[0], (1 << 63) - 2: ids[4]}
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert Counter(r.component_id for r in got if r.doc_id is None) == Counter([ids[4], ids[0]] + [None] * len(bare))
    kept = near_dedup.keep_first(df).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == ids
    left = Counter((r.text or "").split(" ")[0].lower() for r in kept if r.doc_id is None)
    assert left == {"c0": 1, "e0": 1, "": 3}
    # A text whose hash is another row's id.
    taken = spark.range(1).select(F.xxhash64(F.lit(0), F.lit(text("e", "f")))).first()[0]
    df = spark.createDataFrame([(taken, text("g", "h")), (None, text("e", "f")), (1, text("e", "f"))], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in near_dedup.near_duplicates(df).collect()) == sorted([(taken, taken), (0, 1), (1, 1)])
    assert sorted(r.doc_id for r in near_dedup.keep_first(df).collect()) == sorted([taken, 1])


@pytest.mark.parametrize("rows,shingles", [(2048, 1 << 19), (16, 1 << 19), (2048, 900)])
def test_rest_links_join_what_is_similar(spark, monkeypatch, rows, shingles):
    """The exhaustive pass joins the components of every similar pair, in buckets of one block or many."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", rows)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for i in range(160):
        t = list(base)
        for _ in range(rnd.randint(0, 7)):
            t[rnd.randrange(80)] = f"v{rnd.randrange(9)}"
        texts.append(" ".join(t))
    first = {i: 0 if i < 40 else i for i in range(160)}
    made = []
    for i, t in enumerate(texts):
        s = near_dedup.shingles(t, near_dedup._Words())
        m = near_dedup.minhashes(s)
        made.append((7, i, first[i], len(s), near_dedup.odd_sketch(m).tolist(), [7, i], t))
    df = spark.createDataFrame(made, "bucket long, node long, comp long, n long, sketch array<long>, bands array<long>, text string")
    links = [(r.a, r.b) for r in near_dedup._rest_links(df).collect()]
    sets = [shingle_set(t) for t in texts]
    similar = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    assert all(similar(a, b) for a, b in links)

    def groups(pairs):
        parent = {i: i for i in range(160)}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        return [find(i) for i in range(160)]

    known = [(i, c) for i, c in first.items()]
    every = [(a, b) for b in range(160) for a in range(b) if first[a] != first[b] and similar(a, b)]
    assert groups(known + links) == groups(known + every) and len(every) > 300
    if rows > 160 and shingles > 160 * 80:
        assert len(links) < 160


def test_odd_sketch_estimates():
    rnd = np.random.default_rng(1)
    for shared in (900, 960, 990):
        a = np.unique(rnd.integers(0, 2**63, 1000).astype(np.uint64))
        b = np.unique(np.concatenate([a[:shared], rnd.integers(0, 2**63, 1000 - shared).astype(np.uint64)]))
        x, y = (near_dedup.odd_sketch(near_dedup.minhashes(s)) for s in (a, b))
        n, k = 64 * near_dedup.SKETCH_WORDS, near_dedup.BANDS * near_dedup.ROWS
        apart = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        estimate = 1 + n / (4 * k) * np.log(1 - 2 * apart / n)
        assert abs(estimate - shared / (2000 - shared)) < 0.12


def test_quality_counts(messy, nothing):
    got = quality_rules.judged(messy).select("row.doc_id", "row.text", "q.*", "base_failed", "kept").collect()
    assert len(got) == messy.count()
    for r in got:
        w = words(r.text)
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        seen = Counter(zip(w, w[1:], w[2:]))
        hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i: i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(hit))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.keep_good(messy).columns == messy.columns
    assert quality_rules.judged(nothing).collect() == []


def brute_lines(texts, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    return [[x for x in (t or "").split("\n") if not (key(x) and seen[key(x)] >= least)] for t in texts]


def test_line_dedup_of_a_text_copied_into_most_rows(spark):
    """Two texts make up most rows; their copies are dealt out, and every row comes back."""
    rows = [(i, "Same line\nown words here\n\tsame LINE \n", {"a": i}) for i in range(3000)] + [(i, "Own words here", None) for i in range(3000, 4000)]
    rows += [(i, f"line {i}\nsame line", None) for i in range(4000, 4200)] + [(None, None, None), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ra map<string, int>")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = line_dedup.dedup_lines(df)
        sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        got = Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == Counter((i, (t or "").count("\n") + 1, len((t or "").split("\n")) - len(k), "\n".join(k)) for (i, t, _), k in zip(rows, brute_lines([t for _, t, _ in rows], 10)))
    assert max(sizes) < 3 * sum(sizes) / 32 + 50


def test_line_dedup(messy, nothing):
    got = line_dedup.dedup_lines(messy).select("row.doc_id", "row.text", "n_lines", "n_dropped", "kept_text").collect()
    rows = [(r.doc_id, r.text) for r in messy.select("doc_id", "text").collect()]
    kept = brute_lines([t for _, t in rows], 10)
    want = Counter((i, (t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(k), "\n".join(k)) for (i, t), k in zip(rows, kept))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == want
    assert any(r.n_dropped for r in got)
    assert line_dedup.dedup_lines(nothing).collect() == []


def brute_hits(text, items, window=13):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    w, hit, found = find(text), set(), set()
    for item, t in items:
        p = find(t)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for k in range(len(w) - m + 1):
                if w[k: k + m] == p[i: i + m]:
                    hit |= set(range(k, k + m))
                    found.add(str(item if item is not None else ""))
    return len(w), len(hit), ",".join(sorted(found))


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 150])
def test_decontaminate(spark, block):
    rnd = random.Random(2)
    v = ["x", "y", "Ä", "z9"]
    prose = lambda n: " ".join(rnd.choice(v) for _ in range(n))
    items = [(1, prose(20)), (2, prose(3)), (3, "solo"), (4, None), (5, "..."), (None, prose(14)), (6, prose(13)), (6, prose(15)), (10, "x y")]
    passages = [t for _, t in items if t]
    docs = [(i, prose(40) + " , " + rnd.choice(passages) + "! " + prose(rnd.randint(0, 200))) for i in range(25)]
    docs += [(30, None), (31, ""), (32, "SOLO"), (33, "--"), (33, "--"), (None, "x-y")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.searched(df, bench, block_bytes=block).select(
        "row.doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.array_join("items", ",").alias("i"), decontaminate.contaminated().alias("c")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.i) for r in out) == Counter((i, *brute_hits(t, items)) for i, t in docs)
    assert all(r.c == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in out)
    assert decontaminate.keep_clean(df, bench).columns == df.columns
    assert decontaminate.searched(df.limit(0), bench).collect() == []
    assert {r.n_hit for r in decontaminate.searched(df, bench.limit(0)).select(decontaminate.hit_words().alias("n_hit")).collect()} == {0}


def test_bpe_equals_library(messy, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    got = bpe.encoded(messy, tokenizer_path()).select("row.text", "ids", "decoded").collect()
    assert len(got) == messy.count()
    for r in got:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encoded(nothing, tokenizer_path()).collect() == []


def test_bpe_odd_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    e = bpe.Encoder(bpe.Vocabulary(tokenizer_path()))
    rnd = random.Random(1)
    parts = list("abcDEF'sREΣςİıßéÉȩ́̇ \t\n  ​\x1c\x85日カ가ㄱ١²Ⅷ!?#🎉") + ["<|endoftext|>", "<|startoftext|>", "'ll", "\U00010400"]
    for text in ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, "ab" * 4000 + "."]:
        ids = t.encode(text, add_special_tokens=False).ids
        raw = e.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == ids and e.decode(raw) == t.decode(ids, skip_special_tokens=False)
    pieces = ["".join(rnd.choice("thequickxzj!~") for _ in range(20)) for _ in range(200)]
    assert all("".join(e.v.fragments(p)) == p for p in pieces) and any(len(e.v.fragments(p)) > 1 for p in pieces)


def brute_shards(rows, shards, seed=20):
    made = []
    for i, t, s in rows:
        b = (t or "").encode()
        h = hashlib.md5(f"{seed}|{'null' if i is None else i}|{zlib.crc32(b)}".encode()).hexdigest()
        made.append((i, len(b) + 8, zlib.crc32(b), "null" if s is None else f"s:{s}", h))
    order, n = [], Counter(r[3] for r in made)
    for s in n:
        own = sorted((r for r in made if r[3] == s), key=lambda r: (r[4], r[0] is not None, r[0] or 0))
        order += [((2 * k + 1) / (2 * n[s]), r) for k, r in enumerate(own)]
    order.sort(key=lambda x: (x[0], x[1][4], x[1][0] is not None, x[1][0] or 0, x[1][3]))
    total, out, slots = len(order), [], Counter()
    for g, (_, r) in enumerate(order):
        shard = g * shards // total
        out.append((r[0], r[1], r[2], shard, slots[shard]))
        slots[shard] += 1
    return Counter(out)


@pytest.mark.parametrize("merged", ["true", "false"])
def test_sharding(spark, messy, nothing, merged):
    """In one range, and in as many as there are shuffle partitions."""
    rows = [(r.doc_id, r.text, r.source) for r in messy.select("doc_id", "text", "source").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    try:
        got = sharding.interleaved(messy, 6).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == brute_shards(rows, 6)
    assert max(Counter(r.shard for r in got).values()) - min(Counter(r.shard for r in got).values()) <= 1
    assert sharding.interleaved(nothing).collect() == []


def test_sharding_keeps_the_mixture(spark):
    docs = spark.read.parquet(f"{SF_DIR}/../sf0.01/documents.parquet")
    per = sharding.interleaved(docs, 10).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "shard").count()
    of = {r["source"]: r["count"] / 10 for r in docs.groupBy("source").count().collect()}
    assert all(abs(r["count"] - of[r["source"]]) <= 2 for r in per.collect())


def test_sharding_of_many_sources_of_one_row(spark, monkeypatch):
    """All fractions are equal: the hash parts them, and ranges stay even."""
    from kinetable.operators import ranking

    sizes, real = [], ranking.in_ranges

    def watched(df, order):
        out = real(df, order)
        sizes.append([r[0] for r in out.groupBy("_range").count().select("count").collect()])
        return out

    monkeypatch.setattr(ranking, "in_ranges", watched)
    monkeypatch.setattr(sharding, "in_ranges", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), "id").alias("source"), F.lit("x").alias("text"))
        got = sharding.interleaved(df, 24).groupBy("shard").agg(F.count("slot").alias("n"), F.max("slot").alias("last")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 24 and all(r.n in (4166, 4167) and r["last"] == r.n - 1 for r in got)
    assert len(sizes) == 2 and all(len(s) > 4 and max(s) < 3 * sum(s) / len(s) for s in sizes)


def brute_bits(text, samples):
    seen = {}
    for s in samples:
        p = b"\n" * 4 + s
        for i in range(4, len(p)):
            for k in range(5):
                seen.setdefault(p[i - k: i], Counter())[p[i]] += 1
    bits, p = 0.0, b"\n" * 4 + text
    for i in range(4, len(p)):
        for k in range(4, -1, -1):
            c = seen.get(p[i - k: i])
            if c:
                t, d = sum(c.values()), len(c)
                if p[i] in c:
                    bits -= np.log2(c[p[i]] / (t + d))
                    break
                bits -= np.log2(d / (t + d))
        else:
            bits += 8
    return bits


def test_only_letters_make_a_language(spark):
    model = language_id.fit({"a": [b"some words of a text"], "b": ["andere W\u00f6rter".encode()]})
    odd = spark.createDataFrame([(t,) for t in ("\u00bd \u00b2 \u2167", "\u2460 12 _", "\u00e4", "\u65e5", "1a")], "text string")
    assert {r.row.text: r.lang_pred == "und" for r in language_id.predicted(odd, model).collect()} == {
        "\u00bd \u00b2 \u2167": True, "\u2460 12 _": True, "\u00e4": False, "\u65e5": False, "1a": False}
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("lang"), F.lit("x").alias("text"))
    with pytest.raises(ValueError):
        language_id.trained(many)


def test_language_code_lengths(monkeypatch):
    samples = {"a": [b"abra cadabra", b"abc"], "b": ["über öl über".encode(), b""], "c": [b"zzz\x00z"]}
    model = language_id.fit(samples).ready()
    texts = [b"abra", "üb zz \x00 q".encode(), b"", b"\xff" * 9, b"abc" * 50]
    for chunk in (1 << 20, 16):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        got = model.bits(texts)
        for i, t in enumerate(texts):
            for j, name in enumerate(model.languages):
                assert abs(got[i, j] - brute_bits(t, samples[name])) < 1e-3 * (1 + got[i, j])


def test_language_predictions(spark, messy, nothing):
    docs = spark.read.parquet(f"{SF_DIR}/../sf0.01/documents.parquet")
    model = language_id.trained(docs)
    out = language_id.predicted(docs, model).select("row.doc_id", "row.lang", "lang_pred").where(fold("row.doc_id") == 0).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    odd = language_id.predicted(messy, model).select("row.text", "lang_pred", "score").collect()
    assert len(odd) == messy.count() and all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in odd)
    assert all(0 <= r.score <= 1 for r in odd)
    none = language_id.predicted(messy, language_id.trained(nothing)).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"] and language_id.predicted(nothing, model).collect() == []


def quality_of(rows, label):
    hit = [(s, y) for s, y in rows if y is not None]
    pos, neg = [s for s, y in hit if y == 1], [s for s, y in hit if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("module,label,least", [(toxicity, "toxic", 0.75), (quality_model, "quality", 0.97)])
def test_classifiers(spark, messy, nothing, module, label, least):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = module.trained(docs, labels)
    out = module.scored(docs, model).select("row.doc_id", "score").join(labels, "doc_id").where(fold("doc_id") == 0)
    assert quality_of([(r.score, r[label]) for r in out.collect()], label) >= least
    odd = module.scored(messy, model).select("score").collect()
    assert len(odd) == messy.count() and all(0 <= r.score <= 1 for r in odd)
    assert module.scored(nothing, model).collect() == []
    blank = module.trained(nothing, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in module.scored(messy, blank).select("score").collect())


def test_toxicity_of_copied_text(spark):
    """One toxic document copied into a third of all rows: its copies and other toxic texts are found, clean ones are not."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    common, foul = [word() for _ in range(200)], ["zq" + word() for _ in range(30)]
    prose = lambda words, n: [rnd.choice(words) for _ in range(n)]
    made = lambda toxic: " ".join(prose(common, 30) + (prose(foul, 12) if toxic else []))
    copied = made(True)
    rows = [(i, copied, 1) if i % 3 == 0 else (i, made(i % 7 == 0), int(i % 7 == 0)) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.trained(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = [(r.score >= 0.5, r.row.toxic, r.row.doc_id % 3 == 0) for r in toxicity.scored(docs, model).collect()]
    share = lambda toxic, copy: np.mean([x for x, y, z in got if (y, z) == (toxic, copy)])
    assert share(1, True) == 1 and share(1, False) >= 0.8 and share(0, False) <= 0.05


def test_labels_of_fold_zero_are_unread(spark):
    """Scores stay the same whatever the labels of the held-out fold say."""
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumns({c: F.when(fold("doc_id") == 0, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for module in (toxicity, quality_model):
        a, b = (sorted(module.scored(docs, module.trained(docs, x)).select("row.doc_id", "score").collect()) for x in (labels, turned))
        assert a == b


def test_non_negative_risk_finds_positives():
    rng = np.random.default_rng(0)
    row = lambda toxic: ([0] if toxic else []) + [int(x) for x in rng.choice(np.arange(1, 30), 5, replace=False)]
    positive = [(r := row(True), [3] * len(r)) for _ in range(60)]
    unlabelled = [(r := row(i % 10 == 0), [3] * len(r)) for i in range(1500)]
    w, b = toxicity.fit_nnpu(positive, unlabelled, 30, 0.1)
    assert w[0] * np.log1p(3) + b > 0 and b < 0 and w[0] > 2 * np.abs(w[1:]).max()


def test_page_text():
    long = "word " * 40
    cases = {
        None: "", "": "", "no tags": "no tags", "<p>1 < 2 and 3 > 2</p>": "1 < 2 and 3 > 2", "<a \"<b>x": "x",
        f"<div class='nav'><a href=x>Home</a></div><div>{long}</div><div class=\"comments\"><p>{long}</p></div>": long.strip(),
        f"<main><p>A &amp; B &lt;i&gt; &#x41;</p><aside>x</aside><p> tail\n end </p></main><p>{long}": "A & B <i> A\ntail end",
        "<article><header><h1>T</h1></header><p>x<p>y</p><form><p>f</p></form><section id=comments><p>c</p></section></article>": "T\nx\ny",
        f"<nav>{long}</nav><ul><li><a href=1>a</a></ul><p>{long}</p><!-- <p>no</p> --><script>var t='</p>';</script><footer>{long}": long.strip(),
    }
    for page, text in cases.items():
        kept = html_text.main_text(page)
        assert kept == text or text in kept.split("\n") and "Home" not in kept, page
    assert html_text.main_text(f"<article>{'<p>ab</p>' * 20000}</article>") == "\n".join(["ab"] * 20000)


def test_page_text_between_surge_and_dive():
    """Short lines in bare divs beside the text go; headings, short paragraphs and what lies between stay."""
    long = " ".join(["word"] * 40)
    cases = {
        f"<h1>Short title</h1><div class=share>..</div><p>{long}</p>": f"Short title\n{long}",
        f"<p>{long}</p><script>x()</script><p>Short end.</p><footer>f</footer>": f"{long}\nShort end.",
        f"<div>Home</div><div>About us</div><div><p>{long}</p><p>Short end.</p></div><div>(c) Company</div>": f"{long}\nShort end.",
        f"<p>{long}</p><aside>x</aside><p>Mid.</p><div class=ad>x</div><p>{long}</p>": f"{long}\nMid.\n{long}",
        f"<main><div>Home</div><p>{long}</p><p>End.</p><div>(c) Company</div></main>": f"{long}\nEnd.",
        f"<p>a {long}<svg><text>t</text></svg> b</p>": f"a {long} b",
        f"<div>{long}<br>Short end.</div><div>(c)</div>": f"{long}\nShort end.",
    }
    for page, text in cases.items():
        assert html_text.main_text(page) == text, page
    assert html_text.main_text("<p>ab" * 20000) == "\n".join(["ab"] * 20000)


def test_page_regions_by_class_name():
    """A class names a region as a whole word; layouts and what encloses the article or its heading are no regions."""
    long = " ".join(["word"] * 40)
    for name in ("content has-sidebar", "post no-sidebar", "with-sidebar", "search-results", "elementor-widget", "sidebar"):
        assert html_text.main_text(f"<div class='{name}'><article><p>{long}</p></article></div>") == long, name
    for head in ("<header class='entry-header'><h1>T</h1></header>", "<div class=banner><h1 class=header>T</h1></div>", "<h1><span class=ad>T</span></h1>"):
        assert html_text.main_text(f"<article>{head}<p>{long}</p></article>") == f"T\n{long}", head
    for name in ("ad", "x site-footer", "main-nav", "comment-list", "sidebar_left", "share-buttons", "widget-area", "ad-300x250", "related-posts"):
        assert html_text.main_text(f"<article><p>{long}</p><div class='{name}'><p>x</p></div></article><div class={name.split()[-1]}><article>y</article></div>") == long, name
    html_text.main_text(f"<p class='ad{'1-' * 5000}!'>x")


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "u", "<p>x"), (2, "u", "<p>x")], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in html_text.extracted(pages).select("row.page_id", "main_text").collect()) == [(1, ""), (2, "x"), (2, "x")]
    assert html_text.extracted(pages.limit(0)).collect() == []
