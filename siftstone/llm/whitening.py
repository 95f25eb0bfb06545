"""Whitening of embeddings by matrix-free block subspace iteration.

Each Spark pass multiplies the centred rows with a block: X^T (X Q), summed over tasks, so that neither X nor its covariance is formed
anywhere. Q holds the Ritz vectors so far, their residuals and their last steps, made orthonormal by QR; a Rayleigh-Ritz step
on Q gives the next ones. It ends when the residuals |V q - e q| of all wanted components are at most TOLERANCE times the first
eigenvalue; if MOST_PASSES don't get there, it raises. Where the block is as wide as the vectors, that is after a pass or two.

Entries become whole numbers before anything is summed, so sums, means and deviations are exact at any offset: a row is centred
as n x - S in whole numbers and only then divided by n.

Bounds: the driver and each task hold blocks of `width` times 3 (components + GUARD) numbers.

Defined results: vectors that are null, empty, hold null or non-finite entries or entries of 2 ** 40 and more in size take no part, nor do vectors of
another width than the most frequent (of equally frequent ones the largest). Components whose eigenvalue isn't above RANK times
the first don't exist: a table of one row, or of equal rows, has none. Each row counts and gives its own result, whatever its id; rows that are equal
are whitened alike. A deviation beyond a long is null. An empty table gives no rows. Other columns are kept, and give way where they are named like a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from siftstone.llm.common import arrow_rows, table

COMPONENTS, GUARD, TOLERANCE, RANK, MOST_PASSES, SEED = 32, 8, 1e-12, 1e-12, 500, 17
LARGEST = float(1 << 40)
SCALE, OFFSET = 64, 1_000_000


@dataclass(frozen=True)
class Whitening:
    """What the fit leaves: the number of rows, the sums of their entries, unit eigenvectors as columns, eigenvalues, the covariance's trace, the
    largest difference of the whitened covariance from the identity, and the number of passes that the components took."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist() if len(self.values) else []


def usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return F.coalesce((F.size(embedding) > 0) & fine, F.lit(False))


def _entries(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(SCALE * flat.reshape(-1, width)).astype(np.int64) + OFFSET


def _shifted(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as Python's whole numbers where a long may not hold it."""
    if not len(x) or n * int(np.abs(x).max()) + max(map(abs, sums)) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, object)
    return x * n - np.array(sums, np.int64)


def _summed(rows: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of of(entries), `size` numbers, over all batches of rows (v); each task hands on one row a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += of(_entries(batch["v"], width))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["cell", "part"])

    out = np.zeros(size)
    cells = rows.mapInArrow(run, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part")).toPandas()
    out[cells["cell"]] = cells["part"]
    return out


def _whole_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            n += len(batch)
            total = [a + int(b) for a, b in zip(total, _entries(batch["v"], width).sum(axis=0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([str(s) for s in (*total, n)])], ["cell", "part"])

    cells = rows.mapInArrow(run, "cell int, part string").groupBy("cell").agg(F.sum(F.col("part").cast("decimal(38, 0)")).alias("part")).collect()
    by = {r.cell: int(r.part) for r in cells}
    return by.get(width, 0), [by.get(i, 0) for i in range(width)]


def _orthonormal(block: np.ndarray, against: np.ndarray | None = None) -> np.ndarray:
    """An orthonormal basis of block's columns, less what lies in the columns of `against`."""
    if against is not None:
        for _ in range(2):  # once more, as the first leaves rounding errors
            block = block - against @ (against.T @ block)
    length = np.linalg.norm(block, axis=0)
    block = block[:, length > 1e-300] / length[length > 1e-300]
    if not block.size:
        return block[:, :0]
    q, s, _ = np.linalg.svd(block, full_matrices=False)
    q = q[:, s > 1e-10 * s[0]]
    if against is not None:
        q = q - against @ (against.T @ q)
    return np.linalg.qr(q)[0]


def eigenpairs(multiply: Callable[[np.ndarray], np.ndarray], width: int, k: int, guard: int = GUARD, tolerance: float = TOLERANCE, most: int = MOST_PASSES) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of the symmetric matrix that multiply applies, their unit eigenvectors as columns, and the passes taken.

    The block has k + guard columns. Besides the Ritz vectors, the next block holds their residuals and the part of the Ritz vectors that the last
    step added, which is what makes the iteration converge where eigenvalues lie close together."""
    b = min(width, k + guard)
    q = _orthonormal(np.random.default_rng(SEED).standard_normal((width, b)))
    old = np.zeros((width, 0))
    for passes in range(1, most + 1):
        product = multiply(q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:b], turn[:, ::-1][:, :b]
        ritz, image = q @ turn, product @ turn
        residual = image - ritz * values
        if np.linalg.norm(residual[:, :k], axis=0).max(initial=0) <= tolerance * max(values[0], 0) or q.shape[1] == width:
            return values[:k], ritz[:, :k], passes
        more = _orthonormal(np.column_stack([residual, ritz - old @ (old.T @ ritz) if old.size else residual[:, :0]]), ritz)
        if not more.size:
            return values[:k], ritz[:, :k], passes
        old, q = ritz, np.column_stack([ritz, more])[:, :width]
        q = np.linalg.qr(q)[0]
    raise ArithmeticError(f"{most} passes leave residuals of {np.linalg.norm(residual[:, :k], axis=0).max():.3g}, the first eigenvalue being {values[0]:.3g}")


def fit(df: DataFrame, embedding: str = "embedding", k: int = COMPONENTS) -> Whitening:
    """The whitening of all usable vectors of df."""
    arrow_rows(df.sparkSession)
    rows = df.where(usable(F.col(f"`{embedding}`"))).select(F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    widths = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if widths is None:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0)
    width = widths["width"]
    rows = rows.where(F.size("v") == width)
    n, sums = _whole_sums(rows, width)
    centred = lambda x: (_shifted(x, n, sums) / n).astype(float)
    trace = []

    def multiply(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return np.append((c.T @ (c @ q)).ravel(), (c * c).sum())

        *cells, squares = _summed(rows, width, of, width * q.shape[1] + 1)
        trace[:] = [squares / n]
        return np.array(cells).reshape(q.shape) / n

    values, axes, passes = eigenpairs(multiply, width, min(k, width))
    real = int((values > RANK * max(values[0], 0)).sum()) if values[0] > 0 else 0
    values, axes = values[:real], axes[:, :real]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), range(real)] < 0, -1.0, 1.0) if real else axes

    def squares(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ axes / np.sqrt(values)
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    error = 0.0
    if real:
        cells = _summed(rows, width, squares, real * real + real) / n
        mean = cells[real * real :]
        error = float(np.abs(cells[: real * real].reshape(real, real) - np.outer(mean, mean) - np.eye(real)).max())
    return Whitening(n, sums, axes, values, trace[0], error, passes)


def whitened(df: DataFrame, model: Whitening, embedding: str = "embedding") -> DataFrame:
    """The other columns of df's usable rows, then deviation long and whitened array<double>."""
    arrow_rows(df.sparkSession)
    width, n, sums, axes = len(model.sums), model.n, model.sums, model.axes / np.sqrt(model.values) if model.n else model.axes
    names = [c for c in df.columns if c not in (embedding, "deviation", "whitened")]
    rest = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(1).alias("_none"))
    vector = F.col(f"`{embedding}`")
    rows = df.where(usable(vector) & (F.size(vector) == width)).select(rest.alias("_rest"), vector.cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            shifted = _shifted(_entries(batch["v"], width), n, sums)
            safe = shifted.dtype != object and float(np.abs(shifted).max()) ** 2 * width < 2.0**62
            deviation = (shifted * shifted if safe else shifted.astype(object) ** 2).sum(axis=1).tolist()
            out = (shifted / n).astype(float) @ axes
            yield pa.RecordBatch.from_arrays([batch["_rest"], pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()), pa.array(list(out), pa.list_(pa.float64()))], ["_rest", "deviation", "whitened"])

    schema = rows.select("_rest").schema.add("deviation", "long").add("whitened", ArrayType(DoubleType()))
    return rows.mapInArrow(run, schema).select(*[F.col("_rest").getField(c).alias(c) for c in names], "deviation", "whitened")


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    explained = F.array(*map(F.lit, model.explained)) if model.explained else F.array().cast("array<double>")
    rows = whitened(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error")
    )
