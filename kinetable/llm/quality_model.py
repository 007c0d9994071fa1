"""Quality classifier: a generalised additive model with pairwise interactions.

Numeric features of a text are cut into quantile bins. Cyclic boosting visits the features in turn and fits a tree of at
most four leaves on one feature's bins to the current gradient; its leaves are added to that feature's lookup table. Then
the strongest pairs are found on the residuals and boosted likewise, on coarse grids. A score is a sum of table entries.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kinetable.llm.common import annotated, bounded_sample, broadcast_model, fold
from kinetable.session import staged

#: Labelled texts of the fit, about, for each label, and their longest.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 200_000
BINS, GRID = 32, 8
MAIN_ROUNDS, PAIR_ROUNDS, PAIRS, RATE, RIDGE = 150, 60, 6, 0.08, 5.0

FEATURES = (
    "log_words", "word_length", "long_words", "symbols", "bars", "shouts", "upper", "digits", "stops", "commas", "distinct",
    "repeats", "trigram_repeats", "top_word", "line_words", "dup_lines", "non_ascii", "one_letter", "cased_words",
)
_ASCII_UPPER, _DIGITS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>"


def _n(t: bytes, chars: bytes) -> int:
    return len(t) - len(t.translate(None, chars))


def features(text: str | None) -> list[float]:
    """One number for each of ``FEATURES``; ratios of an empty text are 0."""
    t = text.encode() if text else b""
    words = t.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in t.split(b"\n") if x.strip()]
    lengths = list(map(len, words))
    return [
        float(np.log1p(n)), size / n, sum(x > 12 for x in lengths) / n, _n(t, _SYMBOLS) / n, t.count(b"|") / n, t.count(b"!") / n,
        _n(t, _ASCII_UPPER) / size, _n(t, _DIGITS) / size, t.count(b".") / n, t.count(b",") / n, len(counts) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2),
        max(counts.values()) / n, n / len(lines), 1 - len(set(lines)) / len(lines),
        sum(len(w) for w in words if not w.isascii()) / size, sum(x == 1 for x in lengths) / n, sum(w[:1].isupper() for w in words) / n,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            out += table[b[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids):
            out += grid[_coarse(b[:, i], len(self.tables[i])), _coarse(b[:, j], len(self.tables[j]))]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _coarse(b: np.ndarray, size: int) -> np.ndarray:
    return b * min(GRID, size) // size


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of cutting bins in two, and the first bin of the right part (0: no cut)."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
    at = int(gain.argmax())
    return float(gain[at]), at + 1 if gain[at] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of a tree of the given depth, by bin."""
    _, at = _split(g, h) if depth else (0.0, 0)
    if not at:
        return np.full(len(g), -g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The better of two trees on a grid, each cutting one axis once and then each part along the other; its gain."""
    best = (-1.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for at in range(1, len(a)):
            gain, parts = 0.0, []
            for rows in (slice(0, at), slice(at, None)):
                x, y = a[rows].sum(axis=0), b[rows].sum(axis=0)
                gain += _split(x, y)[0] + x.sum() ** 2 / (y.sum() + RIDGE)
                parts.append((len(a[rows]), x, y))
            if gain > best[0]:
                made = np.concatenate([np.tile(_tree(x, y, 1), (k, 1)) for k, x, y in parts])
                best = (gain, made.T if turn else made)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables and grids on features ``x`` and labels ``y`` (0 or 1) by logistic loss."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges])
    if not len(y) or y.min() == y.max():
        model.bias = 0.0 if not len(y) else 4.0 * float(2 * y[0] - 1)
        return model
    b = model.binned(x)
    share = float(y.mean())
    model.bias = float(np.log(share / (1 - share)))
    f = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        return p - y, p * (1 - p)

    for _ in range(MAIN_ROUNDS):
        for j, table in enumerate(model.tables):
            if len(table) > 1:
                g, h = slopes()
                leaf = RATE * _tree(np.bincount(b[:, j], g, len(table)), np.bincount(b[:, j], h, len(table)))
                table += leaf
                f += leaf[b[:, j]]
    cells, found = {}, []
    g, h = slopes()
    for i in range(len(FEATURES)):
        for j in range(i + 1, len(FEATURES)):
            wi, wj = min(GRID, len(model.tables[i])), min(GRID, len(model.tables[j]))
            if wi > 1 and wj > 1:
                c = _coarse(b[:, i], len(model.tables[i])) * wj + _coarse(b[:, j], len(model.tables[j]))
                gain, _ = _grid_tree(np.bincount(c, g, wi * wj).reshape(wi, wj), np.bincount(c, h, wi * wj).reshape(wi, wj))
                cells[i, j] = (c, wi, wj)
                found.append((-gain, i, j))
    model.pairs = [(i, j) for _, i, j in sorted(found)[:PAIRS]]
    model.grids = [np.zeros(cells[p][1:]) for p in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for p, grid in zip(model.pairs, model.grids):
            c, wi, wj = cells[p]
            g, h = slopes()
            leaf = RATE * _grid_tree(np.bincount(c, g, wi * wj).reshape(wi, wj), np.bincount(c, h, wi * wj).reshape(wi, wj))[1]
            grid += leaf
            f += leaf.ravel()[c]
    return model


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """A model from about ``SAMPLE_ROWS`` labelled documents of each quality, outside fold 0.

    Features are made in tasks, and only numbers come to the driver. The intercept is set back to the labels' own
    share of good texts, so the sampling by label does not move scores.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull() & (fold(key) != 0)).select(F.col(key).alias("k"), F.col("quality").cast("int").alias("y"))
    counts = {r[0]: r[1] for r in marks.groupBy("y").count().collect()}
    # Staged, so that Spark sees how few keys these are and does not shuffle every text to find theirs.
    some = staged(bounded_sample(marks.dropDuplicates(["k"]), "y", SAMPLE_ROWS, "k"), "quality-keys")
    usable = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull() & (F.length("t") <= SAMPLE_CHARS))
    rows = annotated(usable.join(some, "k").select("y", "t"), lambda: lambda texts: [[features(t) for t in texts]], "t", "x array<double>").select("row.y", "x").collect()
    rows = sorted((int(r[0]), list(r[1])) for r in rows if r[0] in (0, 1))
    model = fit(np.array([x for _, x in rows]).reshape(len(rows), len(FEATURES)), np.array([y for y, _ in rows], float))
    ones = sum(y for y, _ in rows)
    if 0 < ones < len(rows) and counts.get(0) and counts.get(1):
        model.bias += float(np.log(counts[1] / counts[0]) - np.log(ones / (len(rows) - ones)))
    return model


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Columns ``row`` (all of ``df``) and ``score`` in 0 to 1, one row for each row of ``df``.

    Null, empty and blank texts have features of 0 and are scored like any other. Whole texts count. Rows are judged
    alone, so ties and repeated rows come out alike; without labels every score is 0.5. An empty table gives an empty
    result, and columns of ``df`` stay inside ``row``, where names cannot clash.
    """
    shared = broadcast_model(df.sparkSession, model)

    def make():
        model = pickle.loads(shared.value)
        return lambda texts: [model.scores(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))).tolist()]

    return annotated(df, make, text, "score double")
