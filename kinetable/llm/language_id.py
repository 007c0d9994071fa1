"""Language identification by prediction by partial matching.

For each language a byte context tree of orders 0 to ``ORDER`` is counted once and then frozen. A byte costs
-log2 c / (t + d) bits in the longest context that has seen it, plus -log2 d / (t + d) bits for each longer context of
the language that has not (escape method C without exclusions: c, t, d are the counts of the byte, of all bytes and of
distinct bytes). The language whose model codes a text in the fewest bits is predicted.

For speed the trees are folded into one hashed table for each kind: a context-and-byte string of any language holds the
cost under every language, backed off where needed, and a context holds every language's escape cost.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from kinetable.llm.common import annotated, bounded_sample, broadcast_model, fold

ORDER = 4
#: Training documents of a language, about; texts of more characters are not sampled.
SAMPLE_ROWS, SAMPLE_CHARS = 300, 100_000
#: More languages than this are refused: their samples come to the driver.
MAX_LANGUAGES = 500
#: Positions scored at once.
CHUNK = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)


class HashIndex:
    """Row numbers of distinct 64-bit keys (none is 0), by open addressing, built and probed as whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        left, step = np.arange(len(keys)), np.uint64(0)
        while len(left):
            slot = self._slot(keys[left], step)
            first = np.unique(slot, return_index=True)[1]
            first = first[self.keys[slot[first]] == 0]
            self.keys[slot[first]], self.rows[slot[first]] = keys[left[first]], left[first]
            left, step = np.delete(left, first), step + np.uint64(1)
        self.steps = int(step)

    def _slot(self, keys: np.ndarray, step: np.uint64) -> np.ndarray:
        return (((keys * _MULT) >> np.uint64(64 - self.bits)) + step) & np.uint64((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        slot = self._slot(keys, np.uint64(0))
        there = self.keys[slot]
        out = np.where(there == keys, self.rows[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        for step in range(1, self.steps):
            if not len(open_):
                break
            slot = self._slot(keys[open_], np.uint64(step))
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.rows[slot[hit]]
            open_ = open_[~hit & (there != 0)]
        return out


def _windows(data: np.ndarray) -> np.ndarray:
    """For each position from ``ORDER`` on, its byte and the ``ORDER`` before it as one number."""
    out = data[: len(data) - ORDER].copy()
    for i in range(1, ORDER + 1):
        out = (out << np.uint64(8)) | data[i: len(data) - ORDER + i]
    return out


def _string(window: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes of each window, marked with their length."""
    return (window & np.uint64((1 << (8 * length)) - 1)) | np.uint64(length << (8 * length))


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each after ``ORDER`` line feeds, and for each position from ``ORDER`` on its text (-1: padding)."""
    pad = b"\n" * ORDER
    data = np.frombuffer(pad + b"".join(t + pad for t in texts), np.uint8).astype(np.uint64)
    owner = np.full(len(data), -1, np.int64)
    at = ORDER
    for i, t in enumerate(texts):
        owner[at: at + len(t)] = i
        at += len(t) + ORDER
    return data, owner[ORDER:]


@dataclass
class Model:
    languages: list[str]
    string_keys: np.ndarray
    string_costs: np.ndarray
    context_keys: np.ndarray
    context_costs: np.ndarray
    unseen: np.ndarray

    def ready(self) -> "Model":
        self.strings, self.contexts = HashIndex(self.string_keys), HashIndex(self.context_keys)
        return self

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        batch: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            batch.append((i, t))
            size += len(t)
            if size >= CHUNK:
                self._add(out, batch)
                batch, size = [], 0
        if batch:
            self._add(out, batch)
        return out

    def _add(self, out: np.ndarray, batch: list[tuple[int, bytes]]) -> None:
        ids = np.array([i for i, _ in batch])
        data, owner = _padded([t for _, t in batch])
        for start in range(0, len(owner), CHUNK):
            part, own = data[start: start + CHUNK + ORDER], owner[start: start + CHUNK]
            real = own >= 0
            window, own = _windows(part)[real], own[real]
            for order in range(ORDER, -1, -1):
                row = self.strings.find(_string(window, order + 1))
                self._sum(out, ids, own, self.string_costs, row)
                window, own = window[row < 0], own[row < 0]
                if order and len(own):
                    self._sum(out, ids, own, self.context_costs, self.contexts.find(_string(window >> np.uint64(8), order)))
            n = np.bincount(own, minlength=len(ids))
            out[ids] += n[:, None] * self.unseen

    @staticmethod
    def _sum(out: np.ndarray, ids: np.ndarray, own: np.ndarray, costs: np.ndarray, rows: np.ndarray) -> None:
        """Add the costs of found rows to their texts; positions of a text are neighbours."""
        own, rows = own[rows >= 0], rows[rows >= 0]
        if len(own):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[ids[own[starts]]] += np.add.reduceat(costs[rows], starts, axis=0, dtype=np.float64)


def fit(samples: dict[str, list[bytes]]) -> Model:
    """Context trees of each language, folded into tables of costs in bits."""
    languages = sorted(samples)
    n = len(languages)
    counted: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in languages:
        data, owner = _padded(samples[lang])
        counted.append([np.unique(_string(_windows(data)[owner >= 0], k + 1), return_counts=True) for k in range(ORDER + 1)])
    keys_all, costs_all, ctx_keys, ctx_costs = [], [], [], []
    lower_keys, lower = None, None
    unseen = np.zeros(n)
    for order in range(ORDER + 1):
        keys = np.unique(np.concatenate([counted[i][order][0] for i in range(n)])) if n else np.zeros(0, np.uint64)
        body = keys & np.uint64((1 << (8 * (order + 1))) - 1)
        context = (body >> np.uint64(8)) | np.uint64(order << (8 * order))
        contexts = np.unique(context)
        of = np.searchsorted(contexts, context)
        escape = np.zeros((len(contexts), n))
        if order == 0:
            back = np.full((len(keys), n), 8.0)
        else:
            shorter = (body & np.uint64((1 << (8 * order)) - 1)) | np.uint64(order << (8 * order))
            back = lower[np.searchsorted(lower_keys, shorter)]
        costs = back.copy()
        for i in range(n):
            own, c = counted[i][order]
            at = np.searchsorted(keys, own)
            t = np.bincount(of[at], weights=c, minlength=len(contexts))
            d = np.bincount(of[at], minlength=len(contexts))
            has = d > 0
            escape[has, i] = -np.log2(d[has] / (t[has] + d[has]))
            costs[:, i] += escape[of, i]
            costs[at, i] = -np.log2(c / (t[of[at]] + d[of[at]]))
        if order == 0:
            unseen = 8.0 + (escape[0] if len(escape) else unseen)
        else:
            ctx_keys.append(contexts)
            ctx_costs.append(escape)
        lower_keys, lower = keys, costs
        keys_all.append(keys)
        costs_all.append(costs)
    cat = lambda xs, empty: np.concatenate(xs) if xs else empty
    return Model(languages, cat(keys_all, np.zeros(0, np.uint64)), cat(costs_all, np.zeros((0, n))).astype(np.float32),
                 cat(ctx_keys, np.zeros(0, np.uint64)), cat(ctx_costs, np.zeros((0, n))).astype(np.float32), unseen)


def trained(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """A model from about ``rows`` documents of each language, outside fold 0, texts of at most ``SAMPLE_CHARS``.

    A column with more than ``MAX_LANGUAGES`` values is no list of languages, and an error.
    """
    if df.select(lang).distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"column {lang!r} has more than {MAX_LANGUAGES} values")
    usable = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where(
        F.col("t").isNotNull() & F.col("l").isNotNull() & (fold("k") != 0) & (F.length("t") <= SAMPLE_CHARS))
    samples: dict[str, list[bytes]] = {}
    for r in sorted(bounded_sample(usable, "l", rows, "k").select("l", "t").collect()):
        samples.setdefault(r[0], []).append(r[1].encode())
    return fit(samples)


def predicted(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Columns ``row`` (all of ``df``), ``lang_pred`` and ``score``, one row for each row of ``df``.

    The score is the language's posterior under equal priors, with code lengths as evidence. Texts that are null or
    have no letter are ``und`` with score 0, and so is every text where no language was learned; ties go to the name that
    sorts first. Whole texts count, in bounded chunks. Rows are judged alone, so repeated rows come out repeated. An empty
    table gives an empty result, and columns of ``df`` stay inside ``row``, where names cannot clash.
    """
    shared = broadcast_model(df.sparkSession, model)

    def make():
        model = pickle.loads(shared.value).ready()

        def run(texts: list) -> list[list]:
            known = [i for i, t in enumerate(texts) if t and model.languages and any(map(str.isalpha, t))]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if known:
                bits = model.bits([texts[i].encode() for i in known])
                best = bits.argmin(axis=1)
                p = 1 / np.exp2(np.clip(bits.min(axis=1, keepdims=True) - bits, -1000, 0)).sum(axis=1)
                for i, b, s in zip(known, best, p):
                    names[i], scores[i] = model.languages[b], float(s)
            return [names, scores]

        return run

    return annotated(df, make, text, "lang_pred string, score double")
