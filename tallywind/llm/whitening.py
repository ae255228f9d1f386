"""Whitened embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers, so the rows of the fit list (each distinct vector once), the sums of each dimension and the deviations are exact.
The bidiagonalisation works on the centred rows A of that list: from a vector v it takes u = Av, from u the next v = A'u, and orthogonalises
every new vector against all earlier ones on both sides. One pass over the list makes both products: the left vectors are never stored, as
each is A times a short vector of coefficients, so a task computes its rows of all of them again, and returns its part of A'u, of the inner
products with the earlier left vectors and of the norm. Parts are summed by Spark; the driver holds vectors as long as a row. Where a
product vanishes the process goes on with a new random direction, so repeated deviations are found as often as they occur.

The small bidiagonal matrix's singular values and vectors give deviations and components. The process ends when the wanted components'
residuals are below ``TOLERANCE`` of the largest deviation and what is left of the total variance is too little for another component of
their size, or after as many steps as a row has entries. For rows of more than ``LONG`` entries the second condition is left out; there, of
components with exactly equal deviations only one may be found.

Rows with a null vector, or a null, non-finite or unrepresentable entry (beyond 2^62 / 64) are dropped. The row length is the most frequent
one (the longer of two); rows of another length are dropped as well, as are empty vectors. Repeated rows and ids each give their rows; null
ids stay null. Components without variance (at most ``RANK`` of the largest) are not returned, so equal rows alone give no rows, and neither
does an empty table. A deviation beyond the range of a long is null. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywind.session import stage

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
TOLERANCE, RANK, LONG = 1e-13, 1e-12, 512
BLOCK_BYTES = 1 << 16


def vector_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each row's vector (-1 if it cannot be used), where it starts, and all entries as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    entries = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(length) - length
    bad = np.concatenate([[0], np.cumsum(~(np.abs(entries) < 2.0**62 / SCALE))])
    usable = (length > 0) & (bad[start + length] == bad[start])
    return np.where(usable, length, -1), start, entries


def integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of the given length, and their integer vectors."""
    length, start, entries = vector_lists(column)
    rows = np.flatnonzero(length == width)
    at = start[rows, None] + np.arange(width)
    return rows, np.floor(entries[at] * SCALE).astype(np.int64) + SHIFT


def row_length(vectors: DataFrame, column: str) -> int:
    """The most frequent length of usable vectors, 0 without any."""
    def measure(batches):
        for batch in batches:
            length, n = np.unique(vector_lists(batch.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], names=["length", "n"])

    found = vectors.select(column).mapInArrow(measure, "length long, n long").filter("length > 0").groupBy("length").agg(F.sum("n").alias("n"))
    best = found.orderBy(F.desc("n"), F.desc("length")).first()
    return best.length if best else 0


def fit_list(vectors: DataFrame, column: str, width: int) -> DataFrame:
    """Each distinct integer vector once, many to a row: ``rows, block`` (little-endian 64-bit integers)."""
    per_block = max(1, BLOCK_BYTES // (8 * width))

    def read(batches):
        for batch in batches:
            _, x = integers(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], names=["x"])

    def pack(batches):
        held = []
        for batch in batches:
            held += batch.column(0).to_pylist()
            while len(held) >= per_block:
                yield _block(held[:per_block])
                del held[:per_block]
        if held:
            yield _block(held)

    def _block(held):
        return pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["rows", "block"])

    return stage(vectors.select(column).mapInArrow(read, "x binary").distinct().mapInArrow(pack, "rows long, block binary"), "fit-list")


class Centre:
    """The mean as an integer part and a fraction r / n, so that differences from it lose no digits."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row."""
        away = x - self.whole
        reach = (np.abs(away).max(initial=0) + 1) * float(self.n)
        if reach * reach * x.shape[1] < 2.0**62:
            return ((away * self.n - self.rest) ** 2).sum(axis=1).tolist()
        totals = [sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(row, self.rest)) for row in away]
        return [t if t < 1 << 63 else None for t in totals]


class FitList:
    """Products with the centred rows of the list, one pass over it for each call."""

    def __init__(self, blocks: DataFrame, width: int):
        self.blocks, self.width = blocks, width
        n, sums = 0, [0] * width

        def add(batches):
            for batch in batches:
                for block in batch.column("block").to_pylist():
                    x = np.frombuffer(block, "<i8").reshape(-1, width) - SHIFT
                    wide = x.astype(object) if np.abs(x).max() * float(len(x)) > 2.0**62 else x
                    yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([int(s) for s in wide.sum(axis=0)], pa.decimal128(38, 0))], names=["at", "s"])

        n = blocks.agg(F.sum("rows")).first()[0] or 0
        for r in blocks.select("block").mapInArrow(add, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect():  # one row per dimension
            sums[r.at] = int(r.s) + SHIFT * n
        self.n, self.centre = n, Centre(n, sums) if n else None

    def total(self, compute, size: int) -> np.ndarray:
        """The sum over all blocks of ``compute(centred rows)``, ``size`` numbers; what it carries is a few vectors as long as a row."""
        width, centre = self.width, self.centre

        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                for block in batch.column("block").to_pylist():
                    total += compute(centre.rows(np.frombuffer(block, "<i8").reshape(-1, width)))
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["at", "x"])

        out = np.zeros(size)
        for at, x in self.blocks.select("block").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x")).collect():
            out[at] = x
        return out


class _Step:
    """Of a block: A'w, the inner products of w with the left vectors so far, and its squared norm, where w = Ac."""

    def __init__(self, coefficients: np.ndarray, new: np.ndarray):
        self.all = np.column_stack([*coefficients, new])

    def __call__(self, a: np.ndarray) -> np.ndarray:
        left = a @ self.all
        w = left[:, -1]
        return np.concatenate([a.T @ w, left.T @ w])


def _away_from(x: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2 if basis else 0):
        b = np.array(basis)
        x = x - b.T @ (b @ x)
    return x


def bidiagonalise(step, width: int, energy: float, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Deviations' squares times n, falling, and the components as columns. ``step(c, new)`` gives A'w, products with A c_i, and w'w of w = A new."""
    draw = np.random.default_rng(seed)
    right: list[np.ndarray] = []
    coefficients: list[np.ndarray] = []  # of the left vectors
    images: list[np.ndarray] = []  # A' times the left vectors
    alphas: list[float] = []
    betas: list[float] = []  # couples a left vector to the next right one
    floor = 1e-14 * np.sqrt(energy)

    def fresh() -> np.ndarray:
        v = _away_from(draw.standard_normal(width), right)
        return v / np.linalg.norm(v)

    v, coupling = fresh(), 0.0
    while True:
        right.append(v)
        new = v - coupling * coefficients[-1] if coupling else v
        answer = step(coefficients, new)
        image, inner, norm2 = answer[:width], answer[width:-1], answer[-1]
        alpha = np.sqrt(max(norm2 - float(inner @ inner), 0.0))
        if alpha > floor:
            for h, c, g in zip(inner, coefficients, images):
                new, image = new - h * c, image - h * g
            coefficients.append(new / alpha)
            images.append(image / alpha)
        else:  # v has no variance of its own
            alpha = 0.0
            coefficients.append(np.zeros(width))
            images.append(np.zeros(width))
        alphas.append(alpha)
        after = _away_from(images[-1] - alpha * v, right)
        coupling = float(np.linalg.norm(after))
        coupling = coupling if coupling > floor else 0.0

        small = np.diag(alphas) + np.diag(betas, 1)
        p, s, q = np.linalg.svd(small)
        k = min(wanted, width)
        settled = len(s) >= k and bool((coupling * np.abs(p[-1, :k]) <= TOLERANCE * s[0]).all())
        left_over = max(energy - float((small**2).sum()) - coupling**2, 0.0)
        enough = width > LONG or left_over < 0.5 * s[min(k, len(s)) - 1] ** 2 or left_over < 1e-14 * energy
        if len(right) == width or settled and enough:
            return s[:k] ** 2, np.array(right).T @ q.T[:, :k]
        betas.append(coupling)
        v = after / coupling if coupling else fresh()


def whitened(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    spark = vectors.sparkSession
    schema = f"{id_column} {vectors.schema[id_column].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = row_length(vectors, column)
    fit = FitList(fit_list(vectors, column, width), width) if width else None
    energy = float(fit.total(lambda a: np.array([(a * a).sum()]), 1)[0]) if fit else 0.0
    if not energy:
        return spark.createDataFrame([], schema)

    squares, axes = bidiagonalise(lambda c, new: fit.total(_Step(np.array(c), new), width + len(c) + 1), width, energy, components)
    kept = squares > RANK * squares[0]
    squares, axes = squares[kept], axes[:, kept] / np.linalg.norm(axes[:, kept], axis=0)
    k, n, centre = len(squares), fit.n, fit.centre
    scaled = axes / np.sqrt(squares / n)
    moments = fit.total(lambda a: np.concatenate([(y := a @ scaled).sum(axis=0), (y.T @ y).ravel()]), k + k * k)
    mean = moments[:k] / n
    error = float(np.abs(moments[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    shared = spark.sparkContext.broadcast((centre, scaled, squares / energy))

    def project(batches):
        of, turn, share = shared.value
        for batch in batches:
            rows, x = integers(batch.column(1), width)
            m = len(rows) * k
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(m, n, np.int64)),
                pa.array(of.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))), pa.array((of.rows(x) @ turn).ravel()),
                pa.array(np.tile(share, len(rows))), pa.array(np.full(m, error)),
            ], names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(id_column, column).mapInArrow(project, schema)
