"""Whitening of vectors on components found by spectral divide and conquer.

Vectors are put on an integer grid, so that counts, sums and deviations are exact.
Spark adds up the sums, then the centred products; what reaches the driver is one
matrix of the vectors' dimension. Its eigenvectors come from polar decompositions:
the polar factor U of the matrix minus a shift has the eigenvalues +1 and -1, so
(I + U) / 2 projects on the eigenvectors above the shift. A basis of that subspace
and one of its complement split the matrix in two smaller ones, which are split in
turn until they are diagonal. The polar factor is iterated by dynamically weighted
Halley steps (QDWH): by QR while the weights are large, by Cholesky after that. The
components then travel to the tasks, which project every vector.

Defined results: a vector that is null or empty, or holds a null, a non-finite entry
or one beyond ``LARGEST``, takes no part, nor does one whose length is not the most
frequent (of equally frequent ones, the greatest); repeated rows count each, rows
without an id are projected too; components whose eigenvalue is zero up to rounding
cannot be whitened and are left out, so equal vectors, a single one or an empty table
give no rows; a deviation that no long can hold is null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import written

STEP, ORIGIN = 64, 1_000_000
COMPONENTS = 32
LARGEST = 2.0**40
SEED = 13
CELLS = 4_000_000
EPS = float(np.finfo(float).eps)


# --- eigenvectors by divide and conquer


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a matrix, symmetric if the matrix is."""
    n = len(a)
    bound = min(np.linalg.norm(a, 1), np.linalg.norm(a))
    if not bound:
        return np.eye(n)
    x, low = a / bound, EPS / 2
    while abs(1 - low) > 4 * EPS:
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        alpha = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        if gamma > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, np.eye(n)]))
            moved = q[:n] @ q[n:].T * ((alpha - beta / gamma) / np.sqrt(gamma))
        else:
            half = np.linalg.cholesky(np.eye(n) + gamma * (x.T @ x))
            moved = np.linalg.solve(half.T, np.linalg.solve(half, x.T)).T * (alpha - beta / gamma)
        x = beta / gamma * x + moved
        x = (x + x.T) / 2
        low = min(1.0, low * (alpha + beta * square) / (1 + gamma * square))
    # One Newton-Schulz step takes off what rounding has left.
    x = x @ (3 * np.eye(n) - x.T @ x) / 2
    return (x + x.T) / 2


def halves(a: np.ndarray, shift: float, scale: float, random) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the eigenvectors above and below ``shift``, or None if it parts nothing cleanly."""
    n = len(a)
    u = polar(a - shift * np.eye(n))
    if np.abs(u @ u - np.eye(n)).max() > 1e-10:
        return None  # the shift is an eigenvalue
    projector = (np.eye(n) + u) / 2
    rank = int(round(np.trace(projector)))
    if not 0 < rank < n:
        return None
    basis = np.linalg.qr(projector @ random.standard_normal((n, rank)))[0]
    whole = np.linalg.qr(projector @ basis, mode="complete")[0]
    above, below = whole[:, :rank], whole[:, rank:]
    if np.abs(below.T @ a @ above).max() > 16 * n * EPS * scale:
        return None
    return above, below


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    a = (a + a.T) / 2
    random = np.random.default_rng(SEED)
    scale = np.linalg.norm(a)
    values, vectors, todo = [], [], [(np.eye(len(a)), a)]
    while todo:
        basis, part = todo.pop()
        n = len(part)
        centre = np.diag(part)
        split = None
        if n > 1 and np.abs(part - np.diag(centre)).max() > EPS * scale:
            mean, spread = float(np.trace(part)) / n, float(np.linalg.norm(part - np.trace(part) / n * np.eye(n))) / n
            # The mean of the eigenvalues lies between the ends; the median parts more evenly.
            shifts = [float(np.median(centre)), mean, *(mean + spread * random.uniform(-1, 1, 20))]
            split = next((s for s in (halves(part, shift, scale, random) for shift in shifts) if s), None)
        if split is None:
            # Diagonal up to rounding: any basis of it will do.
            values.append(centre)
            vectors.append(basis)
            continue
        for side in split:
            inner = side.T @ part @ side
            todo.append((basis @ side, (inner + inner.T) / 2))
    vectors = np.concatenate(vectors, axis=1)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- sums over the table


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """``vec_id, vec``: the vectors that take part, all of one length."""
    entry = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= F.lit(LARGEST)), F.lit(False))
    whole = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).cast("array<double>").alias("vec")).where(
        F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", entry)
    )
    length = (
        whole.groupBy(F.size("vec").alias("length"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.desc("length"))
        .select("length")
        .first()
    )
    return whole.where(F.size("vec") == F.lit(length[0] if length else 0))


def _slices(batches, column: str, dims: int):
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, CELLS // dims)):
            part = batch.slice(at, max(1, CELLS // dims))
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def added(rows: DataFrame, column: str, dims: int, start, add, kind: str) -> np.ndarray:
    """The sum of ``add(matrix)`` over all rows: per task first, then per cell in Spark."""

    def run(batches):
        total = start()
        for _, x in _slices(batches, column, dims):
            total += add(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"]
        )

    cells = rows.select(column).mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    out = start()
    for r in cells.collect():
        out.reshape(-1)[r.cell] = r.value
    return out


def on_grid(x: np.ndarray) -> np.ndarray:
    """Distances from ``ORIGIN`` of the grid values; they leave deviations as they are."""
    return np.floor(x * STEP).astype(np.int64)


def deviations(centred: np.ndarray) -> list[int | None]:
    """Exact sums of squares of whole numbers."""
    largest = int(np.abs(centred).max(initial=0))
    if largest**2 * centred.shape[1] < 1 << 63:
        return (centred * centred).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in centred.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(
    vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """One row per vector and component."""
    rows = usable(vectors, id_column, column)
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    first = rows.select(F.size("vec")).head()
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = first[0]

    def counted(x):
        return np.concatenate([[len(x)], on_grid(x).sum(axis=0)])

    sums = added(rows, "vec", dims, lambda: np.zeros(dims + 1, np.int64), counted, "long")
    n, total = int(sums[0]), sums[1:]
    # n * x must fit beside the sums; beyond that the products are taken as whole numbers of any size.
    wide = n * int(LARGEST * STEP) >= 1 << 63

    def centred(x):
        grid = on_grid(x)
        if wide and n * int(np.abs(grid).max(initial=0)) + int(np.abs(total).max()) >= 1 << 63:
            return n * grid.astype(object) - total.astype(object)
        return n * grid - total

    def products(x):
        c = centred(x).astype(float) / n
        return c.T @ c

    covariance = added(rows, "vec", dims, lambda: np.zeros((dims, dims)), products, "double") / n
    values, axes = eigen(covariance)
    kept = values > dims * EPS * max(values[0], 0.0)
    kept &= np.arange(dims) < components
    values, axes = values[kept], axes[:, kept]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    explained = values / np.trace(covariance)
    scaled = axes / np.sqrt(values)

    def project(batches):
        for part, x in _slices(batches, "vec", dims):
            c = centred(x)
            w = (c.astype(float) / n) @ scaled
            offsets = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(deviations(c), pa.int64()), pa.ListArray.from_arrays(offsets, w.ravel())],
                names=["vec_id", "deviation", "w"],
            )

    done = written(
        rows.select(F.col("vec_id").cast("long"), "vec").mapInArrow(
            project, "vec_id long, deviation long, w array<double>"
        ),
        "whitened",
    )
    size = len(values)
    mean = added(done, "w", size, lambda: np.zeros(size), lambda w: w.sum(axis=0), "double") / n
    spread = added(done, "w", size, lambda: np.zeros((size, size)), lambda w: (w - mean).T @ (w - mean), "double") / n
    error = float(np.abs(spread - np.eye(size)).max())
    return done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(F.array(*[F.lit(float(v)) for v in explained]), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
