"""Mixing: targets against a plain loop, rounding against its invariants, and defined results on odd tables."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from messy_tables import SF_DIR, messy, nothing  # noqa: F401
from kinetable.llm import mixing
from kinetable.llm.queries import QUERIES


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Shares by weight; what is above three times a source's size is reshared by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        now = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if now[s] >= 3 * sizes[s]}
        if not above:
            return {**now, **stopped}
        stopped.update({s: 3 * sizes[s] for s in above})


def check(rows, got):
    """rows: (doc_id, source, text). Every promise of the contract."""
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, s, size(t)) for i, s, t in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-12)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert abs(r.copies - rate) < 1 + 1e-9
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = mixing.mixed(docs)
    check([(r.doc_id, r.source, r.text) for r in docs.collect()], got.collect())
    first, again = (Counter(map(tuple, QUERIES["op13_pivotal_mixing"](spark, SF_DIR).collect())) for _ in range(2))
    assert first == again == Counter(map(tuple, got.select("doc_id", "size", "source_size", "target", "taken").collect()))


def test_messy(messy, nothing):
    rows = [(r.doc_id, r.source, r.text) for r in messy.collect()]
    check(rows, mixing.mixed(messy).collect())
    assert mixing.mixed(nothing).collect() == []
    blank = mixing.mixed(messy.withColumn("text", F.lit(None).cast("string"))).collect()
    assert len(blank) == len(rows) and {(r["size"], r.target, r.taken) for r in blank} == {(0, 0.0, 0)}


@pytest.mark.parametrize("seed", range(3))
def test_tree_of_residuals(spark, monkeypatch, seed):
    """Blocks of a few items, several levels, a source with a third of the rows and one row copied many times."""
    monkeypatch.setattr(mixing, "BLOCK_ITEMS", 6)
    monkeypatch.setattr(mixing, "FAN", 3)
    rnd = random.Random(seed)
    rows = [(i, "hot" if i % 3 == 0 else rnd.choice(["a", "b", None, "c"]), "w " * rnd.randint(0, 30)) for i in range(500)]
    rows += [(7, "a", "same text " * 8)] * 100
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed(df, seed=seed).collect()
    check(rows, got)
    copies = Counter(r.copies for r in got if r.doc_id == 7 and r["size"] == 16)
    assert sum(copies.values()) == 100 and len(copies) <= 2
    assert Counter(map(tuple, mixing.mixed(df.repartition(7), seed=seed).collect())) == Counter(map(tuple, got))


def test_more_sources_than_weights(spark):
    """Sources stop at the ceiling in several rounds; one has no words at all."""
    rnd = random.Random(4)
    rows = [(i, f"s{i % 17}", "w " * (1 + i % 17) ** 2 if i % 17 != 3 else " ") for i in range(170)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    check(rows, got)
    stopped = {r.source for r in got if r.target == 3.0 * r.source_size}
    assert len(stopped) > 2 and "s3" in stopped


def test_rounding_keeps_words_and_expectation():
    rnd = random.Random(9)
    items = [(i, rnd.randint(1, 50), rnd.random()) for i in range(12)]
    sums = [0.0] * len(items)
    words = sum(s * p for _, s, p in items)
    for run in range(4000):
        block, out = mixing.Rounding(str(run)), []
        for item in items:
            out += block.add(*item)
        out += block.rest(False)
        assert sorted(i for i, _ in out) == list(range(12)) and sum(0 < p < 1 for _, p in out) <= 1
        assert sum(items[i][1] * p for i, p in out) == pytest.approx(words)
        for i, p in out:
            sums[i] += p
    assert all(abs(s / 4000 - p) < 0.04 for s, (_, _, p) in zip(sums, items))
