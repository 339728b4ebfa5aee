"""Embedding whitening by incremental eigendecomposition.

Each task keeps the spectrum of what it has read: eigenvalues and eigenvectors of the
sum of its centred rows' outer products.  A row is added as a rank-one update: the
new eigenvalues are the roots of the secular equation, one between each two old ones;
directions that the row does not touch, and equal eigenvalues, are deflated first.
The spectra of tasks are joined by the same updates, one for each direction.  A last
distributed pass projects the rows on the found directions and solves the small
problem there (Rayleigh-Ritz), which gives the components to double precision.

A batch of rows first becomes the triangular factor of its QR decomposition: its few
rows have the same outer products, so they are the rank-one updates that are left.
Whole numbers are summed exactly; the mean is subtracted before anything is multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components returned, the scale and shift of the whole numbers, spectra joined by one task, rows of a batch.
COMPONENTS, SCALE, SHIFT, JOINED, ROWS = 32, 64, 1_000_000, 16, 8_192
#: Scaled entries must stay below this.
LARGEST = 2.0**52
#: Parts of the largest eigenvalue below which a step or a gap is deflated, and an eigenvalue counts as none.
DEFLATED, NONE = 4 * np.finfo(float).eps, 1e-13
#: Halvings of the interval in which a root lies.
HALVINGS = 60


def secular_roots(values: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each root of ``1 + sum(z2 / (values - x)) = 0`` (values rise, none equal): the nearest pole below or above, and the distance from it."""
    gaps = np.append(values[1:] - values[:-1], z2.sum())
    middle = values + gaps / 2
    at_middle = 1 + (z2 / (values[None, :] - middle[:, None])).sum(axis=1)
    # The function rises between the poles: a root beyond the middle is counted from the pole above.
    above = (at_middle < 0) & (np.arange(len(values)) < len(values) - 1)
    pole = np.arange(len(values)) + above
    low = np.where(above, -gaps / 2, 0.0)
    high = np.where(above, 0.0, gaps)
    apart = values[None, :] - values[pole][:, None]
    for _ in range(HALVINGS):
        x = (low + high) / 2
        with np.errstate(divide="ignore"):
            rises = 1 + (z2 / (apart - x[:, None])).sum(axis=1) < 0
        low, high = np.where(rises, x, low), np.where(rises, high, x)
    return pole, (low + high) / 2


def rank_one(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors (columns) of ``vectors @ diag(values) @ vectors.T + outer(row, row)``."""
    z = vectors.T @ row
    scale = max(float(values[-1]), float(z @ z))
    if scale == 0:
        return values, vectors
    vectors = vectors.copy()
    kept = [i for i in range(len(z)) if z[i] ** 2 > DEFLATED * scale * DEFLATED and abs(z[i]) * np.sqrt(scale) > DEFLATED * scale]
    live: list[int] = []
    for i in kept:
        if live and values[i] - values[live[-1]] <= DEFLATED * scale:
            # Two equal eigenvalues: turned so that the row touches only one of the two directions.
            j = live[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[i] / r, z[j] / r
            vectors[:, [j, i]] = np.stack([c * vectors[:, j] - s * vectors[:, i], s * vectors[:, j] + c * vectors[:, i]], axis=1)
            z[i], z[j] = r, 0.0
            live.pop()
        live.append(i)
    if not live:
        return values, vectors
    poles, part = values[live], z[live]
    pole, step = secular_roots(poles, part**2)
    # Distances of each root from each pole, exact where they are small; the row that has just these roots makes the vectors orthogonal.
    away = (poles[None, :] - poles[pole][:, None]) - step[:, None]
    tiny = np.finfo(float).tiny
    away = np.where(away == 0, tiny, away)
    n = len(live)
    # The root between two poles is set against the one on the far side of each pole k; the last root stays alone.
    other = np.where(np.arange(n - 1)[:, None] < np.arange(n), poles[: n - 1, None], poles[1:, None]) - poles
    weight = np.abs(np.prod(away[: n - 1] / np.where(other == 0, tiny, other), axis=0) * away[n - 1])
    turned = np.copysign(np.sqrt(weight), part)[None, :] / away
    turned /= np.linalg.norm(turned, axis=1, keepdims=True)
    values = values.copy()
    vectors[:, live] = vectors[:, live] @ turned.T
    values[live] = poles[pole] + step
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """The eigenvalues and eigenvectors of a sum of outer products, to which rows are added."""

    def __init__(self, dims: int):
        self.values, self.vectors = np.zeros(dims), np.eye(dims)

    def add(self, rows: np.ndarray) -> None:
        """Rank-one updates with the rows, or with those of their triangular factor if these are fewer."""
        for row in np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, row)

    def join(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, np.sqrt(value) * vector)

    def packed(self) -> bytes:
        return np.concatenate([self.values[None, :], self.vectors]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Spectrum:
        made = cls(0)
        dims = int((np.sqrt(1 + 4 * len(data) / 8) - 1) / 2 + 0.5)
        both = np.frombuffer(data).reshape(dims + 1, dims)
        made.values, made.vectors = both[0], both[1:]
        return made


@dataclass(frozen=True)
class Whitening:
    """What was fitted: rows, exact sums, eigenvalues and components (columns) by falling eigenvalue, the trace, and the error of the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None


def _usable(vecs: DataFrame, vec_col: str, id_col: str | None = None) -> DataFrame:
    """Rows with a whole vector: not null or empty, all entries finite; of several lengths, that of the most rows (of equals, the longest)."""
    ids = [F.col(id_col).cast("long").alias("id")] if id_col else []
    rows = vecs.select(*ids, F.col(vec_col).cast("array<double>").alias("v")).where("size(v) > 0")
    return rows.where(F.forall("v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))


def _batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as whole numbers, one row each."""
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            scaled = np.floor(SCALE * batch.column(at).flatten().to_numpy(zero_copy_only=False))
            if np.abs(scaled).max() >= LARGEST:
                raise ValueError(f"an entry of {np.abs(scaled).max() / SCALE:g} has no whole number to stand for it")
            yield batch, scaled.astype(np.int64).reshape(batch.num_rows, -1) + SHIFT


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n: the difference is taken in whole numbers and divided once."""
    return (n * x - sums) / n


def _per_task(rows: DataFrame, start: Callable[[], object], add: Callable, end: Callable[[object], bytes]) -> DataFrame:
    """One row (``task``, ``data``) for each task that has rows: what ``add`` has made of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for _, x in _batches(batches, 0):
            state = add(start() if state is None else state, x)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([end(state)], pa.binary())], names=["task", "data"])

    return rows.select("v").mapInArrow(run, "task long, data binary")


def _joined(parts: DataFrame, tasks: int, join: Callable[[list[bytes]], bytes]) -> bytes:
    """All rows' data joined, JOINED of them by one task at a time, in the order of the tasks."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("task").to_numpy(), kind="stable")
        data = table.column("data").to_pylist()
        return pa.table({"task": pa.array([table.column("group")[0].as_py()], pa.int64()), "data": pa.array([join([data[i] for i in order])], pa.binary())})

    while tasks > 1:
        tasks = -(-tasks // JOINED)
        parts = parts.withColumn("group", F.expr(f"task div {JOINED}")).groupBy("group").applyInArrow(run, "task long, data binary")
    return bytes(parts.first().data)


def _add_up(data: list[bytes]) -> bytes:
    return sum(map(np.frombuffer, data[1:]), start=np.frombuffer(data[0])).tobytes()


def _join_spectra(data: list[bytes]) -> bytes:
    made = Spectrum.unpacked(data[0])
    for other in data[1:]:
        made.join(Spectrum.unpacked(other))
    return made.packed()


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of rows ``v`` (of one length); None if there are none.

    The driver gets one row of sums, one spectrum and two small matrices, all of a
    size that depends on the dimension alone.
    """

    def add_sums(state: tuple, x: np.ndarray) -> tuple:
        return state[0] + len(x), state[1] + x.sum(axis=0)

    def told_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for _, x in _batches(batches, 0):
            state = add_sums(state or (0, 0), x)
        if state:
            n = len(state[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array([state[0]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(state[1], pa.int64())],
                names=["task", "n", "dim", "s"],
            )

    sums = rows.select("v").mapInArrow(told_sums, "task long, n long, dim int, s long")
    summed = sums.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("task").alias("task")).orderBy("dim").collect()
    if not summed:
        return None
    n, total, tasks, dims = summed[0].n, np.array([r.s for r in summed], np.int64), summed[0].task + 1, len(summed)

    def add_spectrum(state: Spectrum, x: np.ndarray) -> Spectrum:
        state.add(_centred(x, n, total))
        return state

    spectrum = Spectrum.unpacked(_joined(_per_task(rows, lambda: Spectrum(dims), add_spectrum, Spectrum.packed), tasks, _join_spectra))

    def products(basis: np.ndarray) -> np.ndarray:
        """The covariance of the rows projected on the columns of ``basis``."""

        def add(state: np.ndarray, x: np.ndarray) -> np.ndarray:
            seen = _centred(x, n, total) @ basis
            return state + seen.T @ seen

        size = basis.shape[1]
        return np.frombuffer(_joined(_per_task(rows, lambda: np.zeros((size, size)), add, np.ndarray.tobytes), tasks, _add_up)).reshape(size, size) / n

    small = products(spectrum.vectors)
    values, turned = np.linalg.eigh((small + small.T) / 2)
    found = np.linalg.qr(spectrum.vectors @ turned[:, ::-1])[0]
    trace, values, error = float(np.trace(small)), values[::-1], None
    k = min(components, dims)
    live = int((values[:k] > NONE * max(values[0], 0)).sum()) if values[0] > 0 else 0
    if live:
        # The exact mean of the centred rows is zero, and so is that of their projections.
        error = float(np.abs(products(found[:, :live] / np.sqrt(values[:live])) - np.eye(live)).max())
    return Whitening(n, total, np.concatenate([values[:live], np.zeros(k - live)]), found[:, :k], trace, error)


def whiten(vecs: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` for each usable row and component.

    Rows whose vector is null, empty or holds null or non-finite entries are left
    out; of vectors of several lengths only those of the commonest length (of equals,
    the longest) are used.  A component without spread has ``whitened`` null and
    ``explained`` 0; ``identity_error`` is null if no component has any.  Repeated
    rows count each, null ids stay, other columns are not read, an empty table gives
    an empty result.  An entry of 2**46 or more and a deviation beyond 64 bits are errors.
    """
    rows = _usable(vecs, vec_col, id_col)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kinds = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return vecs.sparkSession.createDataFrame([], kinds)
    rows = rows.where(F.size("v") == lengths.d)
    fitted = fit(rows, components)
    k = len(fitted.values)
    with np.errstate(divide="ignore", invalid="ignore"):
        basis = fitted.components / np.sqrt(fitted.values)
    explained = fitted.values / fitted.trace if fitted.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches, 1):
            apart = fitted.n * x - fitted.sums
            if x.shape[1] * float(np.abs(apart).max()) ** 2 >= 2.0**62:
                deviation = [sum(int(a) ** 2 for a in row) for row in apart]
            else:
                deviation = (apart**2).sum(axis=1)
            with np.errstate(invalid="ignore"):
                white = ((apart / fitted.n) @ basis).ravel()
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, fitted.n)),
                 pa.array(np.repeat(np.array(deviation, np.int64), k)), pa.array(white, mask=~np.isfinite(white)), pa.array(np.tile(explained, rows)),
                 pa.array([fitted.identity_error] * (rows * k), pa.float64())],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("id", "v").mapInArrow(run, kinds)
