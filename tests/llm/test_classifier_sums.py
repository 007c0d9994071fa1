"""Scores of the two classifiers by plain loops over their tables and weights, and the risk that the second one minimises."""

import math
import re
import zlib

import numpy as np
import pytest

from messy_tables import SF_DIR, messy, nothing  # noqa: F401
from kinetable.llm import quality_model, toxicity

DOCS = f"{SF_DIR}/../sf0.01"


def sigmoid(x):
    return 1 / (1 + math.exp(-min(40, max(-40, x))))


def test_quality_scores_are_sums_of_tables_and_grids(spark, messy):
    docs, labels = (spark.read.parquet(f"{DOCS}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_model.trained(docs, labels)
    assert len(model.pairs) == quality_model.PAIRS and all(len(t) == len(e) + 1 <= quality_model.BINS for t, e in zip(model.tables, model.edges))

    def brute(text):
        x = quality_model.features(text)
        bins = [sum(v >= edge for edge in edges) for v, edges in zip(x, model.edges)]
        total = model.bias + sum(table[b] for table, b in zip(model.tables, bins))
        for (i, j), grid in zip(model.pairs, model.grids):
            a, b = (bins[k] * min(quality_model.GRID, len(model.tables[k])) // len(model.tables[k]) for k in (i, j))
            total += grid[a][b]
        return sigmoid(total)

    got = quality_model.scored(messy, model).select("row.text", "score").collect()
    assert len(got) == messy.count() and all(r.score == pytest.approx(brute(r.text), abs=1e-12) for r in got)
    # Interactions count: without the grids some scores change.
    bare = quality_model.Model(model.edges, model.tables, [], [], model.bias)
    x = np.array([quality_model.features(r.text) for r in got])
    assert np.abs(bare.scores(x) - model.scores(x)).max() > 1e-3


def test_toxicity_scores_are_sums_of_weights(spark, messy):
    docs, labels = (spark.read.parquet(f"{DOCS}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.trained(docs, labels)
    weight = dict(zip(model.features, model.weights))

    def brute(text):
        counts = {}
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            for piece in [word + "$"] + [word[:k] for k in range(3, min(8, len(word)) + 1)]:
                h = zlib.crc32(piece.encode())
                if h in weight:
                    counts[h] = counts.get(h, 0) + 1
        return sigmoid(model.bias + sum(weight[h] * math.log(1 + n) for h, n in counts.items()))

    rows = toxicity.scored(messy, model).select("row.text", "score").collect()
    rows += toxicity.scored(docs, model).select("row.text", "score").limit(200).collect()
    assert all(r.score == pytest.approx(brute(r.text), abs=1e-9) for r in rows)
    assert max(r.score for r in rows) > 0.5 > min(r.score for r in rows)


def test_risk_by_its_definition():
    """The fit lowers max(0, R_u - p R_p-) + p R_p+, written out, below that of the prior alone and of weights nearby."""
    rng = np.random.default_rng(5)
    width, prior = 12, 0.2
    make = lambda toxic: ([c for c in range(width) if rng.random() < (0.7 if toxic and c < 4 else 0.2)],)
    rows = lambda n, share: [(c, [1] * len(c)) for (c,) in (make(rng.random() < share) for _ in range(n))]
    positive, unlabelled = rows(300, 1.0), rows(1500, prior)
    w, b = toxicity.fit_nnpu(positive, unlabelled, width, prior)

    def risk(w, b):
        logit = lambda side: [b + sum(w[c] * math.log(1 + n) for c, n in zip(*row)) for row in side]
        loss = lambda x: math.log1p(math.exp(x))
        gp, gu = logit(positive), logit(unlabelled)
        rest = sum(map(loss, gu)) / len(gu) - prior * sum(map(loss, gp)) / len(gp)
        return prior * sum(loss(-x) for x in gp) / len(gp) + max(0.0, rest)

    best = risk(w, b)
    assert best < risk(np.zeros(width), math.log(prior / (1 - prior))) - 0.02
    for _ in range(20):
        step = rng.standard_normal(width) * 0.5
        assert best < risk(w + step, b) + 0.01
    assert min(w[:4]) > max(w[4:])
