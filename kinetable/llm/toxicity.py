"""Toxicity by non-negative positive-unlabelled learning.

A logistic model is fitted in numpy from confirmed toxic texts and from text of unknown label. With class prior p, the
risk is p E_pos[l(+)] + max(0, E_unl[l(-)] - p E_pos[l(-)]): unlabelled text stands for the whole, the part of it that
is toxic is taken off again by the prior, and where that difference turns negative, which is overfitting, the step is
reversed. Features are letter runs of a text and their first 3 to 8 letters; a text's value is log(1 + occurrences).
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinetable.llm.common import annotated, bounded_sample, broadcast_model, fold, map_arrow
from kinetable.session import staged

#: Texts of the fit: confirmed toxic and unlabelled ones, about, each of at most so many characters.
POSITIVES, UNLABELLED, SAMPLE_CHARS = 4000, 16000, 50_000
#: A feature is used if it stands in so many toxic texts of the sample, and so many times oftener than in clean ones.
MIN_TEXTS, MIN_LIFT, MAX_FEATURES = 8, 4.0, 20_000
#: Standard deviations of the sampled counts that are added to a feature's share of clean texts before its lift is taken.
DEVIATIONS = 1.0
STEPS, RATE, DECAY = 150, 0.05, 1e-4
CACHE_WORDS = 300_000

_LETTERS = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashes of the whole word and of its beginnings."""
    return [zlib.crc32((word + "$").encode())] + [zlib.crc32(word[:k].encode()) for k in range(3, min(len(word), 8) + 1)]


class _Columns(dict):
    """Word -> columns of its features, among the chosen ones (all, if none are chosen)."""

    def __init__(self, chosen: dict[int, int] | None):
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        made = word_features(word)
        cols = tuple(made) if self.chosen is None else tuple(self.chosen[f] for f in made if f in self.chosen)
        if len(word) <= 40:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = cols
        return cols


def occurrences(text: str | None, columns: _Columns) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(_LETTERS.findall(text.lower())).items() if text else ():
        for c in columns[word]:
            out[c] += n
    return out


@dataclass
class Model:
    features: list[int]
    weights: np.ndarray
    bias: float

    def scorer(self):
        columns = _Columns({f: i for i, f in enumerate(self.features)})
        w = self.weights.tolist()

        def score(text: str | None) -> float:
            x = self.bias + sum(w[c] * np.log1p(n) for c, n in occurrences(text, columns).items())
            return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))

        return score


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _flat(rows: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of each entry of rows of (columns, occurrences)."""
    lens = [len(c) for c, _ in rows]
    col = np.fromiter((x for c, _ in rows for x in c), np.int64, sum(lens))
    val = np.log1p(np.fromiter((x for _, n in rows for x in n), np.float64, sum(lens)))
    return np.repeat(np.arange(len(rows)), lens), col, val


def fit_nnpu(positive: list, unlabelled: list, width: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam on the whole sample.

    The sign of the difference in the risk is read from all texts at once: on small batches it is mostly noise, and each
    step it turns wrongly pushes toxic texts down.
    """
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return w, b
    sides = [_flat(positive), _flat(unlabelled)]
    n_pos, n_unl = len(positive), len(unlabelled)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, STEPS + 1):
        gp, gu = (np.bincount(owner, weights=w[col] * val, minlength=n) + b for (owner, col, val), n in zip(sides, (n_pos, n_unl)))
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        if rest >= 0:
            dp, du = -prior * (_sig(-gp) + _sig(gp)) / n_pos, _sig(gu) / n_unl
        else:
            dp, du = prior * _sig(gp) / n_pos, -_sig(gu) / n_unl
        g = np.append(DECAY * w, dp.sum() + du.sum())
        for (owner, col, val), d in zip(sides, (dp, du)):
            g[:width] += np.bincount(col, weights=d[owner] * val, minlength=width)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (1 - (t - 1) / STEPS) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:width], b - step[width]
    return w, float(b)


def clean_lift(np_: Column, nu: Column, n_pos: int, n_unl: int, prior: float) -> Column:
    """How many times oftener a feature stands in toxic than in clean texts, from the texts of either sample that hold it.

    Unlabelled texts are a mixture, so their toxic part is taken off by the prior; the clean share is read ``DEVIATIONS``
    above what is left, as a difference of two small counts is mostly noise.
    """
    toxic, mixed = (np_ + 0.5) / (n_pos + 1), (nu + 0.5) / (n_unl + 1)
    noise = F.sqrt(mixed / (n_unl + 1) + prior * prior * toxic / (n_pos + 1))
    clean = (F.greatest(mixed - prior * toxic, F.lit(0.0)) + DEVIATIONS * noise) / (1 - prior)
    return toxic / clean


def trained(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", prior: float | None = None) -> Model:
    """A model from documents outside fold 0.

    Positives are a bounded sample of those with label toxic = 1; unlabelled text is a bounded sample of all of them,
    its labels unread. ``prior`` is the share of toxic text; by default that among labelled documents. Features are
    counted and chosen in tasks; the driver gets counts of the chosen features only. Null texts are not sampled.
    """
    marks = labels.where((F.col("toxic").isNotNull()) & F.col(key).isNotNull() & (fold(key) != 0)).select(F.col(key).alias("k"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    if prior is None:
        prior = counts.get(1, 0) / max(1, sum(counts.values()))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    usable = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where(
        F.col("t").isNotNull() & (fold("k") != 0) & (F.length("t") <= SAMPLE_CHARS))
    # Staged, so that Spark sees how few keys these are and does not shuffle every text to find theirs.
    chosen_pos = staged(bounded_sample(marks.where("toxic = 1").dropDuplicates(["k"]), "toxic", POSITIVES, "k").select("k"), "toxicity-keys")
    pos = usable.join(chosen_pos, "k", "left_semi").withColumn("g", F.lit(1))
    unl = bounded_sample(usable.withColumn("g", F.lit(0)), "g", UNLABELLED, "k", seed=23)
    sample = pos.select("g", "t").union(unl.select("g", "t"))

    def tally(batches):
        columns, seen = _Columns(None), {0: Counter(), 1: Counter()}
        for batch in batches:
            for g, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[g].update(occurrences(t, columns).keys())
        both = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(both, pa.int64()), *(pa.array([seen[g][f] for f in both], pa.int64()) for g in (1, 0))], names=["f", "np", "nu"])

    sizes = {r[0]: r[1] for r in sample.groupBy("g").count().collect()}
    lift = clean_lift(F.col("np"), F.col("nu"), sizes.get(1, 0), sizes.get(0, 0), prior)
    features = [r[0] for r in map_arrow(sample, tally, "f long, np long, nu long").groupBy("f").agg(F.sum("np").alias("np"), F.sum("nu").alias("nu"))
                .where((F.col("np") >= MIN_TEXTS) & (lift > MIN_LIFT)).orderBy(lift.desc(), "f").limit(MAX_FEATURES).select("f").collect()]
    chosen = {f: i for i, f in enumerate(features)}

    def vectors(batches):
        columns = _Columns(chosen)
        for batch in batches:
            made = [occurrences(t, columns) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(c) for c in made], pa.list_(pa.int32())), pa.array([list(c.values()) for c in made], pa.list_(pa.int32()))],
                names=["g", "c", "n"])

    rows = sorted((r[0], list(r[1]), list(r[2])) for r in map_arrow(sample, vectors, "g int, c array<int>, n array<int>").collect())
    w, b = fit_nnpu([(c, n) for g, c, n in rows if g], [(c, n) for g, c, n in rows if not g], len(features), prior)
    return Model(features, w, b)


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Columns ``row`` (all of ``df``) and ``score`` in 0 to 1, one row for each row of ``df``.

    Null and empty texts get the score of a text without features. Whole texts count. Rows are judged alone, so ties and
    repeated rows come out alike; without labels every score is the prior's. An empty table gives an empty result, and
    columns of ``df`` stay inside ``row``, where names cannot clash.
    """
    shared = broadcast_model(df.sparkSession, model)

    def make():
        score = pickle.loads(shared.value).scorer()
        return lambda texts: [[score(t) for t in texts]]

    return annotated(df, make, text, "score double")
