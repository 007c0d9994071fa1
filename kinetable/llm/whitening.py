"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance matrix is never formed: all that is asked of the table is its product with a few columns, a sum over
rows that tasks make in parts and a shuffle adds up. A few Lanczos steps bound the spectrum from below; then a
polynomial that stays small on the unwanted interval and grows above it is applied to a block of columns by its
three-term recurrence, one pass for each degree. QR and Rayleigh-Ritz follow, until the residuals of the wanted
vectors certify them.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from kinetable.llm.common import broadcast_model, map_arrow, packed
from kinetable.session import staged

SCALE, SHIFT = 1024, 100_000
#: Entries are limited to this size after scaling; beyond it doubles have no whole numbers.
LIMIT = float(1 << 53)
#: Columns of the block, degree of the polynomial, Lanczos steps, and filter rounds before the block is doubled.
BLOCK, DEGREE, LANCZOS_STEPS, ROUNDS = 32, 10, 12, 8
#: A vector counts as found when its residual is below this share of the largest eigenvalue.
CERTIFIED = 2e-14
#: Directions with less variance than this share of the largest have none to double precision.
FLAT = 1e-12


@dataclass
class Model:
    n: int
    sums: list[int]
    vectors: np.ndarray  # one column for each component
    values: np.ndarray
    trace: float
    residual: float  # largest residual of a component, over the largest eigenvalue
    passes: int
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once: whole parts are taken off as whole numbers."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = [(s - w * self.n) / self.n for s, w in zip(self.sums, whole)]
        return (x - np.array(whole, np.int64)).astype(float) - np.array(rest)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n*x - S)^2, exact; None where that is no long."""
        far = np.abs(self.centred(x)) * self.n
        small = (np.square(far).sum(1) < 9e18) & (np.abs(x).max(1, initial=0) * float(self.n) < 9e18)
        out: list[int | None] = [None] * len(x)
        y = x[small] * self.n - np.array(self.sums, object).astype(np.int64) if small.any() else x[:0]
        for i, v in zip(np.flatnonzero(small), np.square(y).sum(1)):
            out[i] = int(v)
        for i in np.flatnonzero(~small):
            exact = sum((int(v) * self.n - s) ** 2 for v, s in zip(x[i], self.sums))
            out[i] = exact if exact < 1 << 63 else None
        return out

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & finite, F.lit(False))


def whole_entries(vector: str) -> Column:
    """x = floor(1024 c) + 100000 of each entry."""
    scaled = lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(LIMIT)), F.lit(-LIMIT))
    return F.transform(F.col(f"`{vector}`"), lambda c: scaled(c).cast("long") + SHIFT)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column as one matrix; short rows are filled up with the entry of c = 0."""
    flat, lengths = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.full((len(lengths), width), SHIFT, np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _added(fit: DataFrame, model: Model, work, rows: int, columns: int) -> np.ndarray:
    """Sum over the fit list of the matrices that ``work(model, x)`` makes of a batch; rows are added up in a shuffle."""
    shared = broadcast_model(fit.sparkSession, (model, work))
    names = [f"v{i}" for i in range(columns)]
    width = len(model.sums)

    def run(batches):
        model, work = pickle.loads(shared.value)
        total = np.zeros((rows, columns))
        for batch in batches:
            total += work(model, _matrix(batch.column(0), width))
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), *(pa.array(c) for c in total.T)], names=["j", *names])

    parts = map_arrow(fit, run, "j int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((rows, columns))
    for j, *values in parts.groupBy("j").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[j] = values
    shared.destroy()
    return out


def _sums(fit: DataFrame, width: int) -> list[int]:
    def run(batches):
        total = [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            wide = len(x) and np.abs(x).max(initial=0) > 1 << 48
            total = [a + int(b) for a, b in zip(total, (x.astype(object) if wide else x).sum(0))] if len(x) else total
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(map(str, total), pa.string())], names=["j", "s"])

    got = map_arrow(fit, run, "j int, s string").groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("j").collect()
    return [int(r[1]) for r in got]


def _below(times, width: int, rng: np.random.Generator) -> float:
    """A bound below all eigenvalues: the least Ritz value of a few Lanczos steps, less the norm of what they leave."""
    basis, alpha, beta = [], [], []
    q = rng.standard_normal(width)
    q /= np.linalg.norm(q)
    for _ in range(min(width, LANCZOS_STEPS)):
        basis.append(q)
        w = times(q[:, None])[:, 0]
        alpha.append(float(q @ w))
        for _ in range(2):
            w -= np.array(basis).T @ (np.array(basis) @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-10 * max(abs(a) for a in alpha):
            break
        q = w / beta[-1]
    inner = beta[: len(alpha) - 1]
    return float(np.linalg.eigvalsh(np.diag(alpha) + np.diag(inner, 1) + np.diag(inner, -1))[0]) - beta[-1]


def fitted(df: DataFrame, vector: str = "embedding", components: int = 8, seed: int = 11) -> Model:
    """The first ``components`` eigenvectors of the covariance of ``df``'s usable vectors.

    Only matrices of the vectors' width by the block's come to the driver, whatever the number of rows. If the spectrum
    is so flat that the rounds do not certify the vectors, the block is doubled, at most to the width, where
    Rayleigh-Ritz is exact. Components without variance are left out; without vectors there are none.
    """
    fit = staged(df.where(usable(vector)).select(whole_entries(vector).alias("x")), "whitening-fit")
    n, width = fit.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    model = Model(n, [0] * width, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0, 0)
    if not n or not width:
        return model
    model.sums = _sums(fit, width)
    model.trace = float(_added(fit, model, lambda m, x: np.square(m.centred(x)).sum(0)[:, None], width, 1).sum()) / n
    if not model.trace > 0:
        return model

    def times(q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``: one pass over the rows."""
        def part(m, x):
            c = m.centred(x)
            return c.T @ (c @ q)

        model.passes += 1
        return _added(fit, model, part, width, q.shape[1]) / n

    rng = np.random.default_rng(seed)
    size = min(width, max(BLOCK, 2 * components))
    low = max(0.0, _below(times, width, rng)) if size < width else 0.0
    block = np.linalg.qr(rng.standard_normal((width, size)))[0]
    while True:
        best = np.inf
        for turn in range(ROUNDS):
            product = times(block)
            small = block.T @ product
            values, turned = np.linalg.eigh((small + small.T) / 2)
            values, turned = values[::-1], turned[:, ::-1]
            block, product = block @ turned, product @ turned
            found = min(components, size)
            gaps = np.linalg.norm(product[:, :found] - block[:, :found] * values[:found], axis=0) / values[0]
            if gaps.max() < best:
                best, kept = gaps.max(), (block[:, :found].copy(), values[:found].copy())
            if size == width or best <= CERTIFIED or (turn and best <= 50 * CERTIFIED and gaps.max() > best / 2):
                break
            block = np.linalg.qr(_filtered(times, block, product, low, float(values[-1]), float(values[0])))[0]
        if size == width or best <= 50 * CERTIFIED:
            break
        size, extra = min(width, 2 * size), block
        block = np.linalg.qr(np.hstack([extra, rng.standard_normal((width, size - extra.shape[1]))]))[0]
    vectors, values = kept
    real = values > FLAT * values[0]
    vectors, values = vectors[:, real], values[real]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    model.vectors, model.values, model.residual = vectors * signs, values, float(best)
    model.identity_error = _identity_error(fit, model)
    return model


def _filtered(times, x: np.ndarray, vx: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of ``DEGREE`` for [low, high] applied to ``x``, whose product is ``vx``."""
    half, middle = (high - low) / 2, (high + low) / 2
    if half <= 1e-9 * top:
        return vx
    s = first = half / (top - middle)
    y = (vx - middle * x) * (s / half)
    for _ in range(DEGREE - 1):
        nxt = 1 / (2 / first - s)
        x, y = y, (times(y) - middle * y) * (2 * nxt / half) - (s * nxt) * x
        s = nxt
    return y


def _identity_error(fit: DataFrame, model: Model) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, measured in two passes."""
    k = model.vectors.shape[1]
    mean = _added(fit, model, lambda m, x: m.whitened(x).sum(0)[:, None], k, 1)[:, 0] / model.n

    def part(m, x):
        w = m.whitened(x) - mean
        return w.T @ w

    return float(np.abs(_added(fit, model, part, k, k) / model.n - np.eye(k)).max())


def whitened(df: DataFrame, model: Model, vector: str = "embedding") -> DataFrame:
    """Columns ``row`` (all of ``df``), ``deviation`` and ``whitened`` (one double for each component).

    Rows whose vector is null or holds a null, a NaN or an infinity are dropped; all others come back, repeated ones
    alike. Vectors shorter than the longest of the fit list count as filled up with 0, longer ones (not of the list) as
    cut; an empty vector is all 0. Entries beyond 2^43 count as 2^43. ``deviation`` is null where it exceeds a long. An
    empty table gives an empty result; columns of ``df`` stay inside ``row``, so names cannot clash.
    """
    width = len(model.sums)
    rows = df.where(usable(vector)).select(packed(df), F.slice(whole_entries(vector), 1, max(width, 1)).alias("x"))
    shared = broadcast_model(df.sparkSession, model)

    def run(batches):
        model = pickle.loads(shared.value)
        for batch in batches:
            x = _matrix(batch.column(1), width)
            w = model.whitened(x) if width else np.zeros((len(x), 0))
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.deviations(x) if width else [0] * len(x), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                names=["row", "deviation", "whitened"])

    schema = StructType([rows.schema["row"], *StructType.fromDDL("deviation long, whitened array<double>").fields])
    return map_arrow(rows, run, schema)


def components(df: DataFrame, model: Model, vector: str = "embedding") -> DataFrame:
    """One row for each usable row of ``df`` and component, numbered from 1: ``row, component, n, deviation, whitened,
    explained, identity_error``. Cases as for :func:`whitened`."""
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    out = whitened(df, model, vector).select("row", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return out.select(
        "row", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("i")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
