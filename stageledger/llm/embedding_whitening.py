"""Whitening of embeddings: Welford updates, their parallel merge, symmetric QR.

Each partition streams over its vectors and keeps (n, mean, M), where a vector x turns
mean into mean + (x - mean) / n and adds the rank-one matrix (x - mean before) times
(x - mean after) to M. The updates of one block of rows are summed as a single matrix
product of the two columns of differences; running means come from exact running sums.
Partitions' states, a row each, meet in groups of ``FAN_IN`` by the parallel formula
(Chan, Golub, LeVeque), round by round in Spark; the driver gets at most ``FAN_IN``.
The d x d covariance is then turned into tridiagonal form by Householder reflections and
diagonalised by implicit QR steps with Wilkinson's shift.

The query works on integers x = floor(64 c) + 1000000, so sums and deviations are exact;
the offset that all vectors share is taken off before Welford's updates.

Defined cases: a row whose vector is null or holds null or non-finite entries goes, and
so does one whose length isn't the commonest (the longer at a tie); repeated vectors and
ids count each; an entry of 2 ** 40 or more, or a deviation that doesn't fit a long, is
an error; a component without variance (under 1e-12 of the trace) has a null
``whitened`` and isn't part of ``identity_error``; no rows give no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, ship, table

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Larger entries would leave no room for exact sums.
LARGEST = 2.0**40
#: States that one merge holds.
FAN_IN = 16
#: Rows whose rank-one updates are summed at once.
BLOCK = 1024
#: A component with a smaller share of the trace has no variance.
LEAST_SHARE = 1e-12

STATE = "n long, total array<long>, mean array<double>, m array<double>"


@dataclass
class Moments:
    """n vectors' exact sums (of integers), mean (less an offset) and centred second moments."""

    n: int
    total: np.ndarray
    mean: np.ndarray
    m: np.ndarray

    @staticmethod
    def none(d: int) -> "Moments":
        return Moments(0, np.zeros(d, object), np.zeros(d), np.zeros((d, d)))

    def add(self, x: np.ndarray, offset: int = 0) -> None:
        """Welford's update by each row of ``x`` in turn, as one product."""
        for lo in range(0, len(x), BLOCK):
            part = (x[lo : lo + BLOCK] - offset).astype(np.float64)
            n = self.n + np.arange(1, len(part) + 1)[:, None]
            # Means after each row: from sums about the mean so far, which stay small.
            after = self.mean + np.cumsum(part - self.mean, axis=0) / n
            before = np.vstack((self.mean[None, :], after[:-1]))
            self.m += (part - before).T @ (part - after)
            self.n, self.mean = self.n + len(part), after[-1]
            if x.dtype == np.int64:
                self.total = self.total + x[lo : lo + BLOCK].sum(axis=0).astype(object)

    def merge(self, other: "Moments") -> "Moments":
        """Parallel update formula."""
        if not self.n or not other.n:
            return other if other.n else self
        n = self.n + other.n
        delta = other.mean - self.mean
        m = self.m + other.m + np.outer(delta, delta) * (self.n / n * other.n)
        return Moments(n, self.total + other.total, self.mean + delta * (other.n / n), m)

    def row(self) -> pa.RecordBatch:
        columns = [pa.array([self.n], pa.int64()), pa.array([[int(t) for t in self.total]], pa.list_(pa.int64())), pa.array([self.mean.tolist()], pa.list_(pa.float64())), pa.array([self.m.ravel().tolist()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=["n", "total", "mean", "m"])

    @staticmethod
    def of(n: int, total: list[int], mean: list[float], m: list[float]) -> "Moments":
        d = len(mean)
        return Moments(n, np.array([*total, None], object)[:-1], np.array(mean), np.array(m).reshape(d, d))


def vectors(frame: DataFrame, column: str = "embedding", *keep: str) -> tuple[DataFrame, int]:
    """(*keep, v array<double>) and its length: the finite vectors of the commonest length."""
    v = F.col(column).cast("array<double>")
    finite = frame.select(*keep, v.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    top = finite.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top["d"] if top else 0
    return finite.where(F.size("v") == d), d


def quantised(v: np.ndarray) -> np.ndarray:
    """floor(64 c), exact."""
    if len(v) and np.abs(v).max(initial=0.0) >= LARGEST:
        raise OverflowError(f"an entry of {np.abs(v).max()} leaves no room for exact sums")
    return np.floor(v * SCALE).astype(np.int64) + OFFSET


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _states(d: int, convert: Callable[[np.ndarray], np.ndarray], size: int, offset: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Moments.none(size)
        for batch in batches:
            if batch.num_rows:
                found.add(convert(_matrix(batch.column("v"), d)), offset)
        if found.n:
            yield found.row()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = None
    for batch in batches:
        for row in batch.to_pylist():
            state = Moments.of(**row)
            found = state if found is None else found.merge(state)
    if found is not None:
        yield found.row()


def moments(frame: DataFrame, d: int, convert: Callable[[np.ndarray], np.ndarray], size: int, offset: int = 0) -> Moments:
    """Moments of what ``convert`` makes of blocks of (v): ``size`` numbers a row."""
    states = materialize(frame.select("v").mapInArrow(_states(d, convert, size, offset), STATE), "moments")
    while (n := states.count()) > FAN_IN:
        fewer = materialize(states.repartition(-(-n // FAN_IN)).mapInArrow(_merge, STATE), "moments")
        discard(states)
        states = fewer
    found = Moments.none(size)
    for row in sorted(states.collect()):  # FAN_IN rows at most, in an order of their own
        found = found.merge(Moments.of(*row))
    discard(states)
    return found


# Symmetric QR


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, subdiagonal, q) with a = q t q': Householder reflections."""
    a, d = a.copy(), len(a)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x[1:]).max(initial=0.0)
        if not scale:
            continue
        v = x / max(scale, abs(x[0]))
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _rotate(d: np.ndarray, e: np.ndarray, q: np.ndarray, lo: int, hi: int) -> None:
    """One implicit QR step with Wilkinson's shift on rows lo to hi; ``q`` has eigenvectors as rows."""
    half = (d[hi - 1] - d[hi]) / 2
    root = np.hypot(half, e[hi - 1])
    shift = d[hi] - e[hi - 1] ** 2 / (half + (root if half >= 0 else -root))
    x, z = d[lo] - shift, e[lo]
    for k in range(lo, hi):
        r = np.hypot(x, z)
        c, s = (x / r, z / r) if r else (1.0, 0.0)
        if k > lo:
            e[k - 1] = r
        a, b, g = d[k], d[k + 1], e[k]
        d[k], d[k + 1] = c * c * a + 2 * c * s * g + s * s * b, s * s * a - 2 * c * s * g + c * c * b
        e[k] = c * s * (b - a) + (c * c - s * s) * g
        x = e[k]
        if k < hi - 1:
            z, e[k + 1] = s * e[k + 1], c * e[k + 1]
        top = c * q[k] + s * q[k + 1]
        q[k + 1] = c * q[k + 1] - s * q[k]
        q[k] = top


def symmetric_qr(a: np.ndarray, most: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix."""
    d, e, q = tridiagonal(np.asarray(a, dtype=np.float64))
    q = np.ascontiguousarray(q.T)
    hi, steps = len(d) - 1, 0
    eps = np.finfo(float).eps
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if not e[hi - 1]:
            hi, steps = hi - 1, 0
            continue
        lo = hi - 1
        while lo and e[lo - 1]:
            lo -= 1
        steps += 1
        if steps > most:
            raise ArithmeticError("the QR steps don't converge")
        _rotate(d, e, q, lo, hi)
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


@dataclass(frozen=True)
class Whitening:
    """What is broadcast: d means, and at most ``COMPONENTS`` unit vectors with their eigenvalues."""

    n: int
    total: tuple[int, ...]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    def live(self) -> np.ndarray:
        """Components that have variance."""
        return np.flatnonzero(self.values > LEAST_SHARE * self.trace)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of integers; nan where a component has no variance."""
        out = np.full((len(x), len(self.values)), np.nan)
        own = self.live()
        out[:, own] = (scaled(x, self.n, self.total).astype(np.float64) / self.n) @ self.axes[:, own] / np.sqrt(self.values[own])
        return out


def fit(frame: DataFrame, d: int, most: int = COMPONENTS) -> Whitening:
    """Whitening of the quantised vectors (v)."""
    found = moments(frame, d, quantised, d, OFFSET)
    if not found.n or not d:
        return Whitening(found.n, (0,) * d, np.zeros(0), np.zeros((d, 0)), 0.0)
    covariance = found.m / found.n
    values, axes = symmetric_qr((covariance + covariance.T) / 2)
    axes *= np.where(np.take_along_axis(axes, np.abs(axes).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)  # the largest entry is positive
    return Whitening(found.n, tuple(int(t) for t in found.total), values[:most], axes[:, :most], float(np.trace(covariance)))


def scaled(x: np.ndarray, n: int, total: tuple[int, ...]) -> np.ndarray:
    """n x - S, exact: as Python's integers where longs could overflow."""
    if n * int(np.abs(x).max(initial=0)) >= 2**61:
        x = x.astype(object)
    return n * x - np.array([*total, None], object)[:-1].astype(x.dtype)


def deviations(x: np.ndarray, n: int, total: tuple[int, ...]) -> list[int]:
    """Sum over dimensions of (n x - S) ** 2, exact."""
    far = scaled(x, n, total)
    most = max((abs(int(far.max())), abs(int(far.min()))), default=0) if far.size else 0
    if most * most * max(1, x.shape[1]) < 2**63:
        return (far * far).sum(axis=1).tolist()
    found = [sum(c * c for c in row) for row in far.tolist()]
    if max(found) >= 2**63:
        raise OverflowError(f"a deviation of {max(found)} doesn't fit a long")
    return found


def identity_error(frame: DataFrame, d: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over all rows."""
    own = model.live()
    if not len(own):
        return 0.0
    found = moments(frame, d, lambda v: model.project(quantised(v))[:, own], len(own))
    return float(np.abs(found.m / found.n - np.eye(len(own))).max())


def apply(frame: DataFrame, d: int, model: Whitening, error: float) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = quantised(_matrix(part.column("v"), d))
                y = model.project(x).ravel()
                rows = len(x)
                share = model.values / model.trace if model.trace else np.zeros(k)
                columns = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, model.n, dtype=np.int64)),
                    pa.array(np.repeat(np.array(deviations(x, model.n, model.total), dtype=np.int64), k)),
                    pa.array(y, pa.float64(), mask=np.isnan(y)),
                    pa.array(np.tile(share, rows)),
                    pa.array(np.full(rows * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return frame.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_welford_qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    frame, d = vectors(table(spark, sf_dir, "embeddings").withColumn("vec_id", F.col("vec_id").cast("long")), "embedding", "vec_id")
    model = fit(frame, d)
    return apply(frame, d, model, identity_error(frame, d, model))
