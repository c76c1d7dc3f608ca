"""Whitening of embeddings by the leading eigenvectors of their covariance, found by spectrum slicing.

Entries become whole numbers, floor(256 c), so that counts, sums and the sums of centred products are exact and don't
hang on how rows are spread. The covariance is that of the distinct vectors. How many of its eigenvalues lie above a
shift is told by the inertia of the shifted matrix, from its factors L D L^T (Sylvester); halving the shifts isolates
each leading eigenvalue, Rayleigh quotient iteration then converges cubically to it and its vector, and two more counts,
just above and just below, certify its number. Only the covariance (dimensions squared) comes to the driver.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, as are vectors that don't have
the commonest number of entries (of equally common ones the larger); entries beyond 2 ** 32 count as that; rows of equal
vector count once in the fit and all are returned. Components are as many as asked for or as there are dimensions; one
of no variance has ``whitened`` null and doesn't count in ``identity_error``, which is null if all are; ``explained`` is
null where nothing varies; a deviation beyond a long is null. Equal eigenvalues get an orthonormal basis. An empty table
has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

COMPONENTS = 4
#: Entries are multiplied by this, and are LIMIT at most before that.
SCALE, LIMIT = 256, float(1 << 32)
#: Numbers that are worked on together.
CHUNK = 1 << 20
EPS = float(np.finfo(float).eps)
_ALPHA = (1 + 17**0.5) / 8


# ---- spectrum slicing of one symmetric matrix


def above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``v`` above ``shift``: the positive ones among the pivots of v - shift I = L D L^T.

    Pivots of one or two rows are taken where the remaining matrix is largest, so that the factors stay bounded.
    """
    a = v - shift * np.eye(len(v))
    positive = 0
    while len(a):
        size = np.abs(a)
        p = int(size.diagonal().argmax())
        one = size[p, p]
        np.fill_diagonal(size, 0)
        r, s = divmod(int(size.argmax()), len(a))
        two = size[r, s]
        if one == two == 0:
            break
        pivot = [p] if one >= _ALPHA * two else [r, s]
        rest = np.setdiff1d(np.arange(len(a)), pivot)
        d, c = a[np.ix_(pivot, pivot)], a[np.ix_(rest, pivot)]
        # a pivot of two rows is indefinite: one eigenvalue on either side
        positive += int(d[0, 0] > 0) if len(pivot) == 1 else 1
        left = a[np.ix_(rest, rest)] - c @ np.linalg.solve(d, c.T)
        a = (left + left.T) / 2
    return positive


def _solved(v: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    """The solution of (v - shift I) y = x, of length 1; where the shift is an eigenvalue, it is moved by a rounding error."""
    tiny = EPS * max(float(np.abs(v).max()), np.finfo(float).tiny)
    for nudge in (0.0, 1.0, 4.0, 64.0):
        try:
            y = np.linalg.solve(v - (shift + nudge * tiny) * np.eye(len(v)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and np.abs(y).max() > 0:
            y = y / np.abs(y).max()
            return y / np.linalg.norm(y)
    return x


def _apart(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for f in found:
            x = x - (f @ x) * f
    return x / np.linalg.norm(x)


def slices(v: np.ndarray, k: int) -> list[tuple[float, np.ndarray]]:
    """The k largest eigenvalues of a covariance, falling, with unit eigenvectors; certified by counts."""
    n = len(v)
    scale = float(np.trace(v))
    out: list[tuple[float, np.ndarray]] = []
    if scale <= 0:
        return [(0.0, np.eye(n)[i]) for i in range(min(k, n))]
    least = 4 * n * EPS * scale
    for number in range(1, min(k, n) + 1):
        low, high = -scale, scale * (1 + 4 * EPS)
        over_low, over_high = n, 0
        found = [x for _, x in out]
        while True:  # the eigenvalue of this number lies in (low, high]
            mid = (low + high) / 2
            narrow = high - low <= least
            if narrow or (over_low == number and over_high == number - 1):
                start = _apart(np.cos(np.arange(1.0, n + 1) * number), found)
                for _ in range(3):
                    start = _apart(_solved(v, mid, start), found)
                pair = _quotient(v, start, found, low, high, least) or (float(start @ v @ start), start)
                if _certified(v, *pair, number, least):
                    out.append(pair)
                    break
                if narrow:
                    raise ArithmeticError(f"eigenvalue {pair[0]} isn't number {number}")
            over = above(v, mid)
            if over >= number:
                low, over_low = mid, over
            else:
                high, over_high = mid, over
    return out


def _certified(v: np.ndarray, value: float, vector: np.ndarray, number: int, least: float) -> bool:
    """Whether the eigenvalue of this number lies as near to ``value`` as the residual tells that one does."""
    margin = float(np.linalg.norm(v @ vector - value * vector)) + least
    return margin <= 16 * least and above(v, value + margin) < number <= above(v, value - margin)


def _quotient(v: np.ndarray, x: np.ndarray, found: list[np.ndarray], low: float, high: float, least: float) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from ``x``; None where it leaves (low, high]."""
    for _ in range(12):
        value = float(x @ v @ x)
        if not low - least <= value <= high + least:
            return None
        y = _apart(_solved(v, value, x), found)
        y = y if y @ x >= 0 else -y
        moved, x = float(np.abs(y - x).max()), y
        if moved <= 4 * EPS:
            break
    value = float(x @ v @ x)
    return (value, x) if low - least <= value <= high + least else None


# ---- whole Arrow columns as matrices of whole numbers


def _matrix(b: pa.RecordBatch, column: str, dims: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole numbers by row) of the vectors that count, in pieces of about CHUNK numbers and one length."""
    col = b.column(column)
    lengths = pc.fill_null(pc.list_value_length(col), -1).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths >= 0]).tolist() if dims is None else [dims]:
        rows = np.flatnonzero(lengths == d)
        step = max(1, CHUNK // max(d, 1))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            flat = pc.list_flatten(col.take(pa.array(some))).cast(pa.float64())
            c = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(some), d)
            whole = np.isfinite(c).all(axis=1)
            yield some[whole], np.floor(SCALE * np.clip(c[whole], -LIMIT, LIMIT)).astype(np.int64)


def distinct(vectors: DataFrame, column: str) -> DataFrame:
    """(x): each vector of whole numbers once."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for _, x in _matrix(b, column, None):
                offsets = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["x"])

    return vectors.select(column).mapInArrow(batches, "x array<bigint>").distinct()


def _pieces(it: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for b in it:
        step = max(1, CHUNK // max(dims, 1))
        for at in range(0, b.num_rows, step):
            yield pc.list_flatten(b.column(0).slice(at, step)).to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(fit: DataFrame, dims: int, width: int, make) -> list[list]:
    """Sums over all rows of what ``make`` tells of a piece: rows of ``width`` numbers, exact. One row of sums a task and place is shuffled."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _pieces(it, dims):
            part = make(x).astype(object)
            total = part if total is None else total + part
        if total is not None:
            # limbs of 2 ** 60, so that sums of any size stay exact
            limbs = [[[int(v) >> 60 for v in row], [int(v) & ((1 << 60) - 1) for v in row]] for row in total]
            names = pa.array(np.repeat(np.arange(len(total)), width), pa.int64())
            at = pa.array(np.tile(np.arange(width), len(total)), pa.int64())
            high, low = (pa.array([v for row in limbs for v in row[i]], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([names, at, high, low], names=["i", "j", "high", "low"])

    parts = fit.mapInArrow(batches, "i bigint, j bigint, high bigint, low bigint")
    whole = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low")]
    rows = parts.groupBy("i", "j").agg(*whole).toArrow().sort_by([("i", "ascending"), ("j", "ascending")])
    values = [(int(h) << 60) + int(low) for h, low in zip(rows.column("high").to_pylist(), rows.column("low").to_pylist(), strict=True)]
    return [values[i : i + width] for i in range(0, len(values), width)]


def _sums(x: np.ndarray) -> np.ndarray:
    """One row: the sums of the entries, then the number of vectors."""
    large = int(np.abs(x).max(initial=0)) * len(x) >= 1 << 62
    return np.append((x.astype(object) if large else x).sum(axis=0), len(x))[None, :]


def _products(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Sums of products of the centred entries: exact in doubles where they are small enough, else as whole numbers."""
    y = x - middle
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    return y.astype(object).T @ y.astype(object)


def covariance(fit: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance) of the fit list: exact whole numbers up to the last division.

    Entries are centred by the nearest whole number to their mean before they are multiplied; what that leaves of
    the mean is taken off exactly.
    """
    ones = _summed(fit, dims, dims + 1, _sums)
    if not ones:
        return 0, [], np.zeros((0, 0))
    *sums, n = ones[0]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    sent = np.array(middle, dtype=np.int64)
    squares = _summed(fit, dims, dims, lambda x: _products(x, sent))
    off = [s - n * m for s, m in zip(sums, middle, strict=True)]
    v = np.array([[(n * squares[i][j] - off[i] * off[j]) / (n * n) for j in range(dims)] for i in range(dims)])
    return n, sums, (v + v.T) / 2


class Model:
    """What a task needs for whitening: counts, sums, the components and what they explain."""

    def __init__(self, n: int, sums: list[int], v: np.ndarray, k: int) -> None:
        self.n, self.sums, self.dims = n, sums, len(sums)
        self.mean = np.array([s / n for s in sums])
        found = slices(v, k)
        trace = float(np.trace(v))
        least = 4 * max(len(v), 1) * EPS * trace
        self.values = [e if e > least else 0.0 for e, _ in found]
        self.vectors = np.array([x for _, x in found]).reshape(len(found), self.dims)
        self.explained = [e / trace if trace > 0 else None for e in self.values]
        self.scales = np.array([e**-0.5 if e > 0 else np.nan for e in self.values])

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) @ self.vectors.T) * self.scales

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S) ** 2 of each row, exact."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most * most * max(self.dims, 1) < 1 << 62 else object
        y = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        total = (y * y).sum(axis=1).tolist()
        return [t if t < 1 << 63 else None for t in total]


def identity_error(fit: DataFrame, model: Model) -> float | None:
    """The largest entry of the difference of the whitened fit list's covariance from the identity."""
    held = [i for i, e in enumerate(model.values) if e > 0]
    if not held:
        return None
    k = len(held)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1) * k)
        for x in _pieces(it, model.dims):
            w = model.project(x)[:, held]
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    rows = fit.mapInArrow(batches, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")
    total = rows.column("v").to_numpy() / model.n
    mean, square = total[:k], total[k:].reshape(k, k)
    # the means are rounding errors, so that taking them off afterwards loses nothing
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str, column: str, components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    every = store.written(distinct(vectors, column), "vectors")
    sizes = every.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).take(1)
    if not sizes or not sizes[0]["dims"]:
        store.drop(every)
        return spark.createDataFrame([], schema)
    dims = sizes[0]["dims"]
    fit = every.where(F.size("x") == dims)
    model = Model(*covariance(fit, dims), components)
    error = identity_error(fit, model)
    store.drop(every)
    k = len(model.values)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for rows, x in _matrix(b, column, dims):
                n = len(rows)
                spread = np.repeat(np.arange(n), k)
                w = pa.array(model.project(x).ravel(), from_pandas=True)  # not a number: no variance
                yield pa.RecordBatch.from_arrays([
                    b.column(key).take(pa.array(rows[spread])), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array([model.n] * (n * k), pa.int64()),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(spread)), w, pa.array(model.explained * n, pa.float64()), pa.array([error] * (n * k), pa.float64()),
                ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(key, column).mapInArrow(batches, schema)
