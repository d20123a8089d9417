"""Embedding whitening by incremental eigendecomposition.

Every partition keeps the eigenvalues and eigenvectors of the scatter of what it has read
and takes vectors in by centred rank-one updates: the new eigenvalues are the roots of a
secular equation, whose parts that hardly change are deflated first.  A long slice of a
batch is first turned into its triangular factor, d rows of the same scatter, each of them
one update.  Spectra of partitions, rows of d * d numbers, are combined in groups of FAN_IN, again by one rank-one update for each
eigenvector and one for the distance of the means, until one is left.  It starts the
Rayleigh-Ritz refinement: tasks sum the covariance of exactly centred vectors in the basis
found, and the small eigenproblem of that matrix turns the basis.  Counts and sums are
whole numbers; only matrices of d * d numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import matrix, quantised, usable
from .common import written

SCALE, SHIFT = 64, 1_000_000
#: Components in the result, and spectra combined by one task.
COMPONENTS, FAN_IN = 32, 8
#: Vectors taken at once inside a task.
SLICE = 2_048
EPS = np.finfo(float).eps
#: An eigenvalue below this share of their sum counts as none.
NO_VARIANCE = 1e-12


# --- rank-one updates ------------------------------------------------------------------


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(w / (d - x)) for rising d and positive w, and the matrix d[j] - root[i].

    Each root is sought as its distance from the nearer pole, by rational interpolation kept
    inside a shrinking bracket, so that differences from poles keep their digits.
    """
    k = len(d)
    right = np.append(d[1:], d[-1] + w.sum())
    gap = right - d
    at_mid = 1 + (w / (d[None, :] - (d + gap / 2)[:, None])).sum(axis=1)
    near_right = at_mid < 0
    near_right[-1] = False
    origin = np.where(near_right, right, d)
    delta = d[None, :] - origin[:, None]
    lo = np.where(near_right, -gap / 2, 0.0)
    hi = np.where(near_right, 0.0, np.where(np.arange(k) == k - 1, gap, gap / 2))
    left, other, mu = d - origin, right - origin, (lo + hi) / 2
    below, open_ = np.tri(k), np.arange(k)
    for _ in range(100):
        m = mu[open_]
        gaps = delta[open_] - m[:, None]
        terms = w / gaps
        slopes = terms / gaps
        f, slope, slope_left = 1 + terms.sum(axis=1), slopes.sum(axis=1), (slopes * below[open_]).sum(axis=1)
        high = f > 0
        hi[open_[high]], lo[open_[~high]] = m[high], m[~high]
        low, top, a1, a2 = lo[open_], hi[open_], left[open_] - m, other[open_] - m
        c = f - a1 * slope_left - a2 * (slope - slope_left)
        a, b = (a1 + a2) * f - a1 * a2 * slope, a1 * a2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        new = m + np.where(a <= 0, a - root, 2 * b) / np.where(a <= 0, 2 * c, a + root)
        new = np.where((new > low) & (new < top), new, (low + top) / 2)
        # f is known to its rounding errors only: a root is found where it is no more than they are
        found = np.abs(f) <= 4 * EPS * (1 + np.abs(terms).sum(axis=1))
        mu[open_] = np.where(found, m, new)
        open_ = open_[~found & (top - low > 2 * EPS * np.maximum(np.abs(low), np.abs(top)))]
        if not len(open_):
            break
    return origin + mu, delta - mu[:, None]


def rank_one(values: np.ndarray, basis: np.ndarray, vector: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and eigenvectors of basis * values * basis' + weight * vector * vector'."""
    z = basis.T @ vector
    size = float(z @ z)
    if not weight * size > 0:
        return values, basis
    tiny = 8 * EPS * max(float(np.abs(values).max()), weight * size)
    close = np.diff(values) <= tiny
    if close.any():  # equal poles: turn their part of the vector into one direction
        basis = basis.copy()
        edges = np.flatnonzero(np.diff(np.concatenate(([False], close, [False])).astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2] + 1):
            v = z[a:b].copy()
            length = np.linalg.norm(v)
            if length:
                v[-1] += length if v[-1] >= 0 else -length
                basis[:, a:b] -= np.outer(basis[:, a:b] @ v, v * (2 / (v @ v)))
                sign = -1.0 if z[b - 1] >= 0 else 1.0
                z[a:b] = 0
                z[b - 1] = sign * length
    active = np.flatnonzero(weight * np.abs(z) * np.sqrt(size) > tiny)
    if not len(active):
        return values, basis
    d, za = values[active], z[active]
    k = len(active)
    if k == 1:
        roots, turned = d + weight * za * za, basis[:, active]
    else:
        roots, gaps = secular_roots(d, weight * za * za)
        # the vector whose update has exactly these roots; it keeps the eigenvectors orthogonal
        apart = d[None, :] - d[:, None]
        np.fill_diagonal(apart, -1.0)
        exact = np.sqrt(np.abs(np.prod(gaps / apart, axis=0)))
        u = (np.where(za < 0, -exact, exact)[None, :] / gaps).T
        turned = basis[:, active] @ (u / np.sqrt((u * u).sum(axis=0)))
    values, basis = values.copy(), basis.copy()
    values[active], basis[:, active] = roots, turned
    order = np.argsort(values, kind="stable")
    return (values, basis) if (order[1:] > order[:-1]).all() else (values[order], basis[:, order])


class Spectrum:
    """Number, mean and scatter of vectors; the scatter as eigenvalues and eigenvectors."""

    def __init__(self, d: int):
        self.n, self.mean, self.values, self.basis = 0, np.zeros(d), np.zeros(d), np.eye(d)

    def add(self, vector: np.ndarray, times: int = 1) -> None:
        gap = vector - self.mean
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, gap, self.n * times / (self.n + times))
        self.n += times
        self.mean = self.mean + gap * (times / self.n)

    def merge(self, n: int, mean: np.ndarray, rows: np.ndarray, weights: np.ndarray) -> None:
        """Take in n vectors whose scatter is the sum of weight * row' * row."""
        for row, weight in zip(rows, weights):
            self.values, self.basis = rank_one(self.values, self.basis, row, float(weight))
        self.add(mean, n)

    def add_all(self, x: np.ndarray) -> None:
        """Take in vectors one by one, or, if they are more than twice their dimensions, the rows of their triangular factor.

        The factor has the same scatter around the same mean as the vectors, in as many rows as
        dimensions, so that a batch costs that many updates however long it is.
        """
        if len(x) <= 2 * x.shape[1]:
            for vector in x:
                self.add(vector)
        else:
            mean = x.mean(axis=0)
            rows = np.linalg.qr(x - mean, mode="r")
            self.merge(len(x), mean, rows, np.ones(len(rows)))
        self.basis = np.linalg.qr(self.basis)[0]  # many updates make it lose its right angles slowly


_SPECTRUM = "part int, n long, mean array<double>, eigenvalues array<double>, basis array<double>"


def _row(part: int, s: Spectrum) -> pa.RecordBatch:
    doubles = pa.list_(pa.float64())
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [s.n], "mean": pa.array([s.mean], doubles), "eigenvalues": pa.array([s.values], doubles), "basis": pa.array([s.basis.ravel()], doubles)})


def spectra(vectors: DataFrame, d: int) -> DataFrame:
    """One row for each partition with vectors, found by centred rank-one updates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Spectrum(d)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                s.add_all(matrix(batch.column("x").slice(at, SLICE)) - float(SHIFT))
        if s.n:
            yield _row(TaskContext.get().partitionId(), s)

    return vectors.select("x").mapInArrow(run, _SPECTRUM)


def combined(parts: DataFrame, d: int) -> DataFrame:
    """All spectra as one, FAN_IN at a time; each level is written."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        s = Spectrum(d)
        for r in sorted(table.to_pylist(), key=lambda r: r["part"]):
            s.merge(r["n"], np.array(r["mean"]), np.array(r["basis"]).reshape(d, d).T, np.array(r["eigenvalues"]))
        return pa.Table.from_batches([_row(key[0].as_py(), s)])

    parts = written(parts, "spectra")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        parts = parts.withColumn("group", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("group").applyInArrow(merge, _SPECTRUM)
        parts = written(parts, "spectra")
    return parts


# --- whitening -------------------------------------------------------------------------


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, matrix(part.column("x"))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x minus the mean: the whole number n * x - S, rounded once, over n."""
    top = n * (int(np.abs(x).max()) + 1) + int(np.abs(sums).max())
    kind = np.int64 if top < 2**63 else object
    return (x.astype(kind) * n - sums.astype(kind)).astype(float) / n


def _summed(vectors: DataFrame, shape: tuple[int, int], work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of work(rows), a matrix; one row of it from each task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(shape), False
        for _, x in _slices(batches):
            total, any_ = total + work(x), True
        if any_:
            i, j = np.indices(shape)
            yield pa.RecordBatch.from_pydict({"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "v": pa.array(total.ravel())})

    out = np.zeros(shape)
    for i, j, v in vectors.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = v
    return out


def _exact_sums(vectors: DataFrame) -> tuple[int, np.ndarray]:
    rows = vectors.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)"))).collect()
    sums = {r[0]: int(r[2]) for r in rows}
    whole = [sums[j] for j in range(len(sums))]
    return rows[0][1], np.array(whole, np.int64 if max(map(abs, whole)) < 2**63 else object)


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row a vector and component.

    Vectors that are null, or hold entries that are null, not finite or of 2^47 and more are
    left out; if lengths differ, those of the most frequent one stay (of the longer, at a tie).
    Components without variance (below 1e-12 of the trace) give 0 for every vector and are not
    in identity_error; a table of equal vectors has only such.  Of two signs the one is taken that
    makes a component's largest entry positive.  A deviation beyond a long is null.  Repeated
    rows are vectors of their own; null ids stay; an empty table gives an empty result; other
    columns stay behind.
    """
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double"
    vector = F.col("embedding")
    kept = embeddings.where((F.size(vector) > 0) & usable(vector, SCALE)).select("vec_id", quantised(vector, SCALE, SHIFT).alias("x"))
    length = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return embeddings.sparkSession.createDataFrame([], schema + ", identity_error double")
    d = length[0]
    kept = written(kept.where(F.size("x") == d), "whole-vectors")
    n, sums = _exact_sums(kept)
    start = combined(spectra(kept, d), d).first()
    basis = np.linalg.qr(np.array(start["basis"]).reshape(d, d))[0][:, ::-1]

    def inner(x: np.ndarray) -> np.ndarray:
        y = _centred(x, n, sums) @ basis
        return y.T @ y

    ritz = _summed(kept, (d, d), inner) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, vectors = values[::-1], np.linalg.qr(basis @ turn[:, ::-1])[0]
    trace, m = float(np.trace(ritz)), min(components, d)
    vectors = vectors[:, :m] * np.sign(vectors[np.abs(vectors[:, :m]).argmax(axis=0), np.arange(m)])
    there = values[:m] > NO_VARIANCE * trace
    scales = np.where(there, 1 / np.sqrt(np.where(there, values[:m], 1)), 0)
    explained = values[:m] / trace if trace > 0 else np.zeros(m)

    def moments(x: np.ndarray) -> np.ndarray:
        y = _centred(x, n, sums) @ vectors * scales
        return np.vstack([y.T @ y, y.sum(axis=0)])

    total = _summed(kept, (m + 1, m), moments) / n
    off = (total[:m] - np.outer(total[m], total[m]) - np.eye(m))[np.ix_(there, there)]
    error = float(np.abs(off).max()) if off.size else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches):
            top = n * (int(np.abs(x).max()) + 1) + int(np.abs(sums).max())
            kind = np.int64 if d * top * top < 2**63 else object
            gap = x.astype(kind) * n - sums.astype(kind)
            deviation = [v if v < 2**63 else None for v in (gap * gap).sum(axis=1).tolist()]
            white = _centred(x, n, sums) @ vectors * scales
            rows = np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_pydict({
                "vec_id": part.column("vec_id").take(pa.array(rows)), "component": pa.array(np.tile(np.arange(1, m + 1), len(x)), pa.int32()), "n": pa.array(np.full(len(rows), n)),
                "deviation": pa.array(deviation, pa.int64()).take(pa.array(rows)), "whitened": pa.array(white.ravel()), "explained": pa.array(np.tile(explained, len(x))),
            })

    return kept.mapInArrow(run, schema).withColumn("identity_error", F.lit(error))
