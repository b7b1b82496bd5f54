"""Embedding whitening by contour integration over the covariance."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of the quadrature on half a circle; the other half is its conjugate.
POINTS = 8
#: Eigenvalues wanted in an interval at most; an interval narrower than this share of the spectrum is not cut further.
PER_INTERVAL, NARROW = 16, 1e-7
#: Components with a variance of no more than this share of the greatest can't be told from rounding and are left out.
LEAST_VARIANCE = 1e-11
ROUNDS = 60


def negative(a: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix, by Sylvester's law the negative pivots of its symmetric elimination.

    A pivot is the greatest diagonal entry, or the block of the greatest entry off it if that is much greater; such a block has one negative eigenvalue.
    """
    a, found = a.copy(), 0
    while len(a):
        diag = np.abs(np.diagonal(a))
        off = np.abs(np.tril(a, -1))
        r = int(diag.argmax())
        i, j = np.unravel_index(int(off.argmax()), off.shape)
        if diag[r] == 0 and off[i, j] == 0:
            break
        if diag[r] >= (1 + math.sqrt(17)) / 8 * off[i, j]:
            found += int(a[r, r] < 0)
            rest = np.delete(np.arange(len(a)), r)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, r], a[rest, r] / a[r, r])
        else:
            found += 1
            pair, rest = [i, j], np.delete(np.arange(len(a)), [i, j])
            a = a[np.ix_(rest, rest)] - a[np.ix_(rest, pair)] @ np.linalg.solve(a[np.ix_(pair, pair)], a[np.ix_(pair, rest)])
    return found


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """Disjoint intervals ``low, high, eigenvalues in it`` from the top of the spectrum down, with ``k`` eigenvalues at least (all, if fewer).

    An interval is halved while its inertia counts more than ``PER_INTERVAL``. It is cut, near the middle, where the widest stretch around the cut is
    free of eigenvalues, so that the contours keep away from them.
    """
    d, one = len(v), np.eye(len(v))
    top = float(np.abs(v).sum(axis=1).max()) * 1.01
    below = lambda s: negative(v - s * one)
    todo, out = [(-0.01 * top, top, 0, d)], []
    while todo and sum(n for *_, n in out) < k:
        low, high, a, b = todo.pop()
        if a == b:
            continue
        if b - a <= PER_INTERVAL or high - low <= NARROW * top:
            out.append((low, high, b - a))
            continue
        best = (-1.0, 0.0, 0)
        for part in (0.5, 0.4, 0.6, 0.3, 0.7):
            s, room = low + part * (high - low), 0.2 * (high - low)
            for _ in range(12):
                if (n := below(s - room)) == below(s + room):
                    best = max(best, (room, s, n))
                    break
                room /= 4
        _, s, n = best if best[0] > 0 else (0, (low + high) / 2, below((low + high) / 2))
        todo += [(low, s, a, n), (s, high, n, b)]
    return out


def _in_interval(v: np.ndarray, low: float, high: float, count: int, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal eigenvectors of the ``count`` eigenvalues between ``low`` and ``high``.

    The resolvent integrated around a circle over the interval projects on them. Its quadrature solves one complex shifted system a point for a block
    of vectors; Rayleigh-Ritz on what comes out gives the next block, until as many Ritz pairs as the inertia counts have residuals of rounding.
    """
    d, size = len(v), min(len(v), 2 * count + 4)
    centre, radius = (low + high) / 2, (high - low) / 2
    x, weight = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(1j * np.pi * (1 + x) / 2)
    scale = float(np.abs(v).sum(axis=1).max())
    y = rng.standard_normal((d, size))
    for _ in range(ROUNDS):
        q = sum(w / 2 * (radius * e * np.linalg.solve((centre + radius * e) * np.eye(d) - v, y)).real for e, w in zip(turn, weight, strict=True))
        q = np.linalg.qr(q)[0]
        value, y = np.linalg.eigh(q.T @ v @ q)
        y = q @ y
        rest = np.sqrt(((v @ y - y * value) ** 2).sum(axis=0))
        good = (value > low) & (value <= high) & (rest <= 64 * d * np.finfo(float).eps * scale)
        if good.sum() == count:
            return y[:, good]
    raise ArithmeticError(f"{count} eigenvalues are counted between {low} and {high}, {int(good.sum())} found")


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Every interval must give as many as its inertia counts, and what is found over all of them is counted once more above the least: none is missed.
    The greatest entry of a vector is positive.
    """
    d, k = len(v), min(k, len(v))
    if not k or not np.abs(v).max():
        return np.zeros(k), np.eye(d)[:, :k]
    rng, found = np.random.default_rng(7), []
    for low, high, count in intervals(v, k):
        found.append(_in_interval(v, low, high, count, rng))
    q = np.linalg.qr(np.concatenate(found, axis=1))[0]
    value, vector = np.linalg.eigh(q.T @ v @ q)
    value, vector = value[::-1][:k], (q @ vector)[:, ::-1][:, :k]
    slack = 64 * d * np.finfo(float).eps * float(np.abs(v).sum(axis=1).max())
    if d - negative(v - (value[-1] + slack) * np.eye(d)) > k - 1:
        raise ArithmeticError("an eigenvalue above the least was missed")
    vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(k)])
    return value, vector


def whole(vectors: DataFrame, scale: float, shift: int, id_col: str, vector: str) -> DataFrame:
    """``id, v`` of the rows that take part: vectors of doubles without null or non-finite entries, of the commonest length (of several, the longest),
    whose entries stay below 2**62 once scaled; empty ones take no part."""
    x = F.col(vector).cast("array<double>")
    limit = F.lit(float(2**62 - abs(shift)) / abs(scale))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) >= limit))
    rows = vectors.select(F.col(id_col).alias("id"), x.alias("v")).where(F.coalesce(~bad, F.lit(False)) & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).head(1)
    return rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


def _integers(batch: pa.RecordBatch, scale: float, shift: int) -> np.ndarray:
    """floor(scale * entry) + shift, a row for each vector."""
    v = batch.column(batch.schema.get_field_index("v"))
    return np.floor(v.flatten().to_numpy(zero_copy_only=False) * scale).astype(np.int64).reshape(len(v), -1) + shift


def _summed(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of what ``of`` makes of the rows, and of its products: a task gives one row a dimension, which are added in order of size so that reruns agree."""

    def part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, gram = 0.0, 0.0
        for batch in it:
            if batch.num_rows:
                y = of(batch)
                total, gram = total + y.sum(axis=0), gram + y.T @ y
        if np.ndim(gram):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(gram)), pa.int32()), pa.array(np.column_stack([total, gram]).tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    def add(table: pa.Table) -> pa.Table:
        rows = np.array(table.column("row").to_pylist())
        return pa.table({"i": table.column("i").slice(0, 1), "row": pa.array([np.sort(rows, axis=0).sum(axis=0).tolist()], pa.list_(pa.float64()))})

    got = rows.mapInArrow(part, "i int, row array<double>").groupBy("i").applyInArrow(add, "i int, row array<double>").orderBy("i").collect()
    both = np.array([r["row"] for r in got])
    return both[:, 0], both[:, 1:]


def whiten(vectors: DataFrame, k: int = 8, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component, ``k`` of them at most.

    Entries become x = floor(``scale`` * entry) + ``shift``. Components are unit eigenvectors of the covariance of x (divisor n), numbered from 1 by falling eigenvalue e;
    ``whitened`` is (x - mean) on the component over sqrt(e), ``explained`` e over the trace, ``deviation`` the sum of (n x - S)**2 over dimensions, exact (null beyond 64 bits),
    and ``identity_error`` the largest absolute entry of the whitened rows' covariance minus the identity.

    Passes over the table: integer sums; products of what is left of x without its mean's whole part, so that nothing large cancels; the whitened rows' covariance; the result.
    A task gives a row of sums for each dimension, whatever its rows, and the driver has matrices of d by d and finds the components by contour integration
    (:func:`components`). Rows that take no part (see :func:`whole`) are left out; repeated rows and ids count and are returned each. A component without variance (one row, equal rows,
    fewer rows than components) has no row. Without vectors the result is empty.
    """
    rows = whole(vectors, scale, shift, id_col, vector)
    spark = vectors.sparkSession
    kind = dict(rows.dtypes)["id"]
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def totals(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in it:
            if batch.num_rows:
                x = _integers(batch, scale, shift)
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(high)), pa.int32()), pa.array([n] * len(high), pa.int64()), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    exact: Callable[[str], Column] = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = rows.mapInArrow(totals, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n").alias("n"), exact("high"), exact("low")).orderBy("i").collect()
    if not sums:
        return spark.createDataFrame([], schema)
    n, total = sums[0]["n"], [int(r["high"]) * 2**32 + int(r["low"]) for r in sums]
    floor = np.array([s // n for s in total], np.int64)
    left = np.array([s % n / n for s in total])  # what the mean has beyond its whole part

    rest, gram = _summed(rows, lambda b: (_integers(b, scale, shift) - floor).astype(np.float64))
    mean = rest / n
    cov = gram / n - np.outer(mean, mean)
    cov = (cov + cov.T) / 2
    value, vector_of = components(cov, k)
    some = value > LEAST_VARIANCE * max(float(value[0]), 0.0) if len(value) else value > 0
    value, vector_of = value[some], vector_of[:, some]
    if not len(value):
        return spark.createDataFrame([], schema)
    axis, explained = vector_of / np.sqrt(value), value / np.trace(cov)
    project = lambda x: ((x - floor).astype(np.float64) - left) @ axis

    mid, spread = _summed(rows, lambda b: project(_integers(b, scale, shift)))
    error = float(np.abs(spread / n - np.outer(mid / n, mid / n) - np.eye(len(value))).max())

    def deviation(x: np.ndarray) -> list[int | None]:
        away = (x - floor).astype(np.float64) - left
        sure = ((away * n) ** 2).sum(axis=1) < 2**61
        out: list[int | None] = [None] * len(x)
        own = np.array([s % n for s in total], np.int64)
        fast = (((x[sure] - floor) * n - own) ** 2).sum(axis=1).tolist()
        for i, v in zip(np.flatnonzero(sure).tolist(), fast, strict=True):
            out[i] = v
        for i in np.flatnonzero(~sure).tolist():
            v = sum((n * a - s) ** 2 for a, s in zip(x[i].tolist(), total, strict=True))
            out[i] = v if v < 2**63 else None
        return out

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = len(value)
        for batch in it:
            if batch.num_rows:
                x = _integers(batch, scale, shift)
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), c))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(each), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)), pa.array(np.full(m * c, n)), pa.array(deviation(x), pa.int64()).take(each),
                     pa.array(project(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * c, error))],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(emit, schema)
