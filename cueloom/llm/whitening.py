"""Whitening of embeddings: blockwise QR, Householder bidiagonalisation, dqds, twisted factorisations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .staging import stage
from .topk import _whole, quantised

COMPONENTS = 4
#: Rows of a block of the QR, and triangles that one task puts together.
BLOCK_ROWS, FAN_IN = 4_096, 64
_TINY = np.finfo(float).tiny * 1e20
_EPS = np.finfo(float).eps


# ---- one matrix


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): r = u B v^T with B upper bidiagonal, a its diagonal, b the one above, by Householder reflections."""
    work, d = np.array(r, float), r.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.abs(x).max(initial=0.0)
        if len(x) < 2 or size == 0:
            return None
        w = x / size
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        if (w := reflector(work[k:, k])) is not None:
            work[k:, k:] -= 2 * np.outer(w, w @ work[k:, k:])
        if k < d - 1 and (w := reflector(work[k, k + 1:])) is not None:
            work[k:, k + 1:] -= 2 * np.outer(work[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(work).copy(), np.diag(work, 1).copy(), v


def _qd_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One differential qd transform with a shift: (q, e, d); a negative d means that the shift was too large."""
    n = len(q)
    new_q, new_e, found = np.empty(n), np.empty(n - 1), np.empty(n)
    d = q[0] - shift
    for i in range(n - 1):
        found[i] = d
        new_q[i] = max(d + e[i], _TINY)
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
    found[n - 1] = d
    new_q[n - 1] = d
    return new_q, new_e, found


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of an unreduced upper bidiagonal matrix, each to high relative accuracy, falling.

    The shift is 1 / sum(1 / d) of a transform without one: the inverse's trace, so at most the smallest value left. It
    is Newton's step, and so never goes too far but for rounding, in which case it is made smaller.
    """
    size = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    if size == 0:
        return np.zeros(len(a))
    with np.errstate(over="ignore"):  # of transforms that are given up
        return _squared_values(a / size, b / size) * size ** 2


def _squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    found: list[float] = []
    todo = [(np.maximum(a ** 2, _TINY), b ** 2, 0.0)]
    while todo:
        q, e, moved = todo.pop()
        while len(q):
            n = len(q)
            if n == 1:
                found.append(q[0] + moved)
                break
            if e[-1] <= _EPS ** 2 * (moved + q[-1]):
                found.append(q[-1] + moved)
                q, e = q[:-1], e[:-1]
                continue
            small = np.flatnonzero(e <= _EPS ** 2 * (moved + np.minimum(q[1:], q[:-1])))
            if len(small):  # two matrices of their own
                k = int(small[-1]) + 1
                todo.append((q[:k], e[: k - 1], moved))
                q, e = q[k:], e[k:]
                continue
            if 1.5 * q[0] < q[-1]:  # the small end last
                q, e = q[::-1].copy(), e[::-1].copy()
            d = _qd_step(q, e, 0.0)[2]
            shift = 0.0 if d.min() <= _TINY else 1 / np.sum(1 / d)
            new_q, new_e, d = _qd_step(q, e, shift)
            while d.min() < 0:
                shift = shift * 0.9 if shift > _EPS * moved and shift > _TINY else 0.0
                new_q, new_e, d = _qd_step(q, e, shift)
            q, e, moved = np.maximum(new_q, _TINY), new_e, moved + shift
    return np.sort(np.array(found))[::-1]


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of B^T B for an eigenvalue, from the twisted factorisation with the smallest middle entry."""
    n = len(a)
    pivots = np.where(a == 0, _TINY, a) ** 2
    low = b / np.where(a[:-1] == 0, _TINY, a[:-1])
    down, up, s, p = np.zeros(n), np.zeros(n), np.empty(n), np.empty(n)
    safe = lambda x: x if abs(x) > _TINY else _TINY
    s[0] = -value
    for i in range(n - 1):
        down[i] = pivots[i] * low[i] / safe(pivots[i] + s[i])
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[n - 1] = pivots[n - 1] - value
    for i in range(n - 2, -1, -1):
        ratio = pivots[i] / safe(pivots[i] * low[i] ** 2 + p[i + 1])
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    k = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k + 1, n):
        z[i] = -up[i - 1] * z[i - 1]
    return z / np.linalg.norm(z)


def leading_directions(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions as columns, squared singular values of them, sum of all squared singular values) of a matrix of d columns.

    B is split where its upper diagonal is negligible, so that equal values of different parts get vectors of their own.
    Where vectors of close values inside a part aren't orthogonal, inverse iteration of all of them together mends that.
    Directions without variance beyond rounding are left out. Of either sign, the largest entry of each is positive.
    """
    d = r.shape[1]
    square = np.zeros((d, d))
    square[: min(len(r), d)] = r[:d]
    a, b, v = bidiagonalised(square)
    cuts = np.flatnonzero(np.abs(b) <= _EPS / 4 * (np.abs(a[:-1]) + np.abs(a[1:]))) + 1
    parts = [(i, j) for i, j in zip([0, *cuts], [*cuts, d])]
    values = sorted(((value, i, j) for i, j in parts for value in dqds(a[i:j], b[i: j - 1])), reverse=True)
    total = float(sum(value for value, _, _ in values))
    chosen = [x for x in values[:components] if x[0] > _EPS * d * values[0][0]]
    z = np.zeros((d, len(chosen)))
    for c, (value, i, j) in enumerate(chosen):
        z[i:j, c] = twisted_vector(a[i:j], b[i: j - 1], value)
    if len(chosen) and np.abs(z.T @ z - np.eye(len(chosen))).max() > 1e-12:
        z = _together(np.diag(a) + np.diag(b, 1), z, [value for value, _, _ in chosen])
    directions = v @ z
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(chosen))])
    return directions * signs, np.array([value for value, _, _ in chosen]), total


def _together(bidiagonal: np.ndarray, z: np.ndarray, values: list[float]) -> np.ndarray:
    """Orthonormal eigenvectors for close values: a few inverse iterations, each kept orthogonal to those before."""
    rng = np.random.default_rng(0)
    square = bidiagonal.T @ bidiagonal
    out = np.zeros_like(z)
    for c, value in enumerate(values):
        y = z[:, c]
        for _ in range(4):
            for _ in range(2):
                y = y - out[:, :c] @ (out[:, :c].T @ y)
            if np.linalg.norm(y) < 1e-3:
                y = rng.standard_normal(len(y))
                y = y - out[:, :c] @ (out[:, :c].T @ y)
            y = y / np.linalg.norm(y)
            out[:, c] = y
            y = np.linalg.solve(square - (value * (1 + 4 * _EPS) + _TINY) * np.eye(len(y)), y)
            y = y / np.linalg.norm(y)
    return out


# ---- many rows


@dataclass(frozen=True)
class Whitening:
    """The fit of all vectors of one length: x maps to (x - sums / n) @ directions / sqrt(variances)."""

    n: int
    sums: np.ndarray
    directions: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, with one rounding where n * x fits in 53 bits."""
        if self.n * float(np.abs(x).max(initial=0)) + float(np.abs(self.sums).max(initial=0)) < 2.0 ** 53:
            return (self.n * x - self.sums) / self.n
        return x - self.sums / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sums)^2 for each row, exact; null beyond 64 bits."""
        if (self.n * float(np.abs(x).max(initial=0)) + float(np.abs(self.sums).max(initial=0))) ** 2 * max(1, x.shape[1]) < 2.0 ** 62:
            return ((self.n * x - self.sums) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - self.sums.astype(object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact.tolist()]


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the rows, matrix) for each vector length of a batch."""
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(d))


def _totals(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By vector length, the number of rows and the exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for rows, x in _matrices(batch.column(0)):
                found = sums.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
                found[0] += len(rows)
                found[1] = found[1] + x.sum(axis=0)
        for d, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, d)), pa.array(np.arange(-1, d)), pa.array(np.concatenate(([n], s)))], ["d", "place", "total"])

    rows = fit.mapInArrow(partial, "d long, place long, total long").groupBy("d", "place").agg(F.sum("total").alias("total")).orderBy("d", "place").collect()
    by_size: dict[int, list[int]] = {}
    for row in rows:
        by_size.setdefault(row["d"], []).append(row["total"])
    return {d: (found[0], np.array(found[1:], np.int64)) for d, found in by_size.items()}


def _triangles(fit: DataFrame, totals: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """By vector length, R of a QR factorisation of all centred rows: one of each block, then of stacked triangles."""
    centre = {d: Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0) for d, (n, sums) in totals.items()}
    names = ["d", "part", "r"]

    def rows_out(part: int, found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for d, r in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([part]), pa.array([r.ravel()], pa.list_(pa.float64()))], names)

    def factored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found: dict[int, np.ndarray] = {}
        for batch in (whole.slice(at, BLOCK_ROWS) for whole in batches for at in range(0, whole.num_rows, BLOCK_ROWS)):
            for _, x in _matrices(batch.column(0)):
                d = x.shape[1]
                found[d] = np.linalg.qr(np.vstack([found.get(d, np.zeros((0, d))), centre[d].centred(x)]), mode="r")
        yield from rows_out(TaskContext.get().partitionId(), found)

    def stacked(key: tuple, rows: pa.Table) -> pa.Table:
        d = key[0].as_py()
        r = np.zeros((0, d))
        for flat in rows["r"]:
            r = np.linalg.qr(np.vstack([r, flat.values.to_numpy().reshape(-1, d)]), mode="r")
        return pa.Table.from_batches(rows_out(key[1].as_py(), {d: r}))

    schema = "d long, part long, r array<double>"
    found = stage(fit.mapInArrow(factored, schema), "triangles")
    parts = found.agg(F.max("part")).first()[0]
    while parts is not None and parts > 0:
        found = stage(found.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("d", "part").applyInArrow(stacked, schema), "triangles")
        parts //= FAN_IN
    return {row["d"]: np.array(row["r"]).reshape(-1, row["d"]) for row in found.collect()}


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> tuple[dict[int, Whitening], dict[int, float]]:
    """By vector length, the leading components of the ``vectors`` (x array<long>), each distinct vector counted once, and the identity error.

    Rows are centred before they are multiplied, and never squared: blocks of them are reduced to a triangle each, and
    triangles to one in a tree of tasks. Only that triangle and the sums, whose sizes are the vector length's, come to
    the driver, where its singular values and leading right vectors are found.
    """
    fit = stage(vectors.where("size(x) > 0").select("x").distinct(), "fit")
    totals = _totals(fit)
    out = {}
    for d, r in _triangles(fit, totals).items():
        n, sums = totals[d]
        directions, squares, total = leading_directions(r, components)
        out[d] = Whitening(n, sums, directions, squares / n, total / n)
    return out, _identity_errors(fit, out)


def _identity_errors(fit: DataFrame, models: dict[int, Whitening]) -> dict[int, float]:
    """By vector length, the largest absolute entry of the whitened fit list's covariance minus the identity."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                w = models[x.shape[1]].whitened(x)
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + np.hstack([w.T @ w, w.sum(axis=0)[:, None]])
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, d)), pa.array(np.arange(s.size)), pa.array(s.ravel())], ["d", "place", "total"])

    rows = fit.mapInArrow(partial, "d long, place long, total double").groupBy("d", "place").agg(F.sum("total").alias("total")).orderBy("d", "place").collect()
    by_size: dict[int, list[float]] = {}
    for row in rows:
        by_size.setdefault(row["d"], []).append(row["total"])
    out = {d: 0.0 for d in models}
    for d, found in by_size.items():
        k = models[d].directions.shape[1]
        s = np.array(found).reshape(k, k + 1) / models[d].n
        out[d] = float(np.abs(s[:, :k] - np.outer(s[:, k], s[:, k]) - np.eye(k)).max(initial=0.0))
    return out


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n, deviation, whitened array, explained array, identity_error) for every whole vector of ``embeddings``.

    Entries become x = floor(256 * c). Each distinct x is fitted once; n is how many there are. whitened is x's place
    along up to ``components`` leading directions, in standard deviations; explained is each one's share of the variance.
    deviation is the sum of (n * x - S)^2, null beyond 64 bits. Vectors that are null, empty or hold null or non-finite
    entries are left out; vectors of different lengths are fitted apart; null ids stay null, repeated rows are repeated,
    other columns are ignored. Directions without any variance are left out, so that arrays may be shorter, or empty
    where all vectors are alike. An empty table gives an empty result.
    """
    rows = embeddings.where(_whole(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col).alias("x"))
    models, errors = fit_whitening(rows, components)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubles = pa.list_(pa.float64())
        for batch in batches:
            for places, x in _matrices(batch.column(1)):
                m = models[x.shape[1]]
                shares = pa.array([m.variances / m.trace if m.trace else m.variances] * len(x), doubles)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(places)), pa.array(np.full(len(x), m.n)), pa.array(m.deviations(x), pa.int64()), pa.array(list(m.whitened(x)), doubles),
                     shares, pa.array(np.full(len(x), errors[x.shape[1]]))], ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(mapped, "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")


def op13(spark, sf_dir: str) -> DataFrame:
    """Query: every vector of ``embeddings`` along its leading components, a row for each."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return (found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"),
                    F.col("of.explained").alias("explained"), "identity_error"))
