"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X are written in blocks. A step multiplies X by a right vector and X transposed
by the resulting left vector, both in the tasks that hold the blocks; only vectors of as many
numbers as there are dimensions go back and forth. Left vectors have as many entries as there
are rows and are never stored: each is X w for a short w, which the driver keeps with X'X w, and
so new left vectors are reorthogonalised against all earlier ones by short products. Right
vectors are reorthogonalised directly, twice. The bidiagonal matrix's SVD gives the components
(right vectors combined) and the deviations (singular values over the root of the row count).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import checkpointed, free_name, removed, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Bytes of a block of centred rows.
BLOCK_BYTES = 1 << 22
#: Whole numbers up to this are exact as doubles.
EXACT = float(1 << 52)
#: A direction is settled when what the bidiagonalisation leaves of it is below this share of the largest one.
SETTLED = 1e-15
#: Shares of the largest singular value below which a vector is rounding error, and a component has no deviation.
NOTHING, FLAT = 1e-13, 1e-9


@dataclass
class Rows:
    """Usable vectors as whole numbers: (id, x), how many there are, and the exact sums of their entries."""

    table: DataFrame
    n: int
    sums: list[int]

    @property
    def base(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the mean has beyond ``base``; rows are centred as (x - base) - rest, which loses no digits."""
        return np.array([(s % self.n) / self.n for s in self.sums])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(rows: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray], d: int, kind: str = "double") -> np.ndarray:
    """The sum over rows of ``of_rows``, which gets matrices of some rows; ``rows`` has one list column, or one of bytes of doubles."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if pa.types.is_list(batch.schema.field(0).type):
                parts = [_matrix(batch.column(0), d)] if batch.num_rows else []
            else:
                parts = [np.frombuffer(b, dtype=np.float64).reshape(-1, d) for b in batch.column(0).to_pylist()]
            for x in parts:
                total = of_rows(x) if total is None else total + of_rows(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "value"])

    found = rows.mapInArrow(partial, f"i bigint, value {kind}").groupBy("i").agg(F.sum(F.col("value").cast("decimal(38,0)") if kind == "bigint" else F.col("value")).alias("value"))
    sums = {r.i: r.value for r in found.collect()}
    return np.array([sums[i] for i in range(len(sums))])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Rows:
    """Vectors without nulls, NaN, infinities or entries beyond ``EXACT``, of the most frequent length (the larger, if two are)."""
    spark = vectors.sparkSession
    c = F.col("v")
    fits = F.forall(c, lambda e: F.coalesce(F.abs(F.floor(e * SCALE)) <= F.lit(EXACT), F.lit(False)))
    good = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where((F.size("v") > 0) & F.forall(c, lambda e: F.coalesce(F.abs(e) <= F.lit(EXACT / SCALE), F.lit(False))) & fits)
    whole = good.select("id", F.transform(c, lambda e: F.floor(e * SCALE) + F.lit(OFFSET)).alias("x"))
    lengths = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return Rows(whole, 0, [])
    d, n = lengths[0]
    whole = whole.where(F.size("x") == d)
    return Rows(whole, n, [int(s) for s in summed(whole.select("x"), lambda x: x.sum(axis=0), d, "bigint")])


def centred_blocks(rows: Rows) -> DataFrame:
    """The centred rows as blocks of doubles, written once for all steps."""
    d, base, rest = len(rows.sums), rows.base, rows.rest
    per_block = max(1, BLOCK_BYTES // (8 * d))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((_matrix(batch.column(0), d) - base) - rest)
                count += batch.num_rows
            if count >= per_block:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["block"])
                held, count = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], ["block"])

    spark = rows.table.sparkSession
    return checkpointed(spark, rows.table.select("x").mapInArrow(pack, "block binary"), "centred")


def _apart(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` without its parts along ``basis``; twice is enough."""
    for _ in range(2 if basis else 0):
        q = np.array(basis)
        v = v - q.T @ (q @ v)
    return v


def bidiagonalise(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Unit right singular vectors (rows) and singular values of X, the largest ``wanted``.

    ``times(w)`` gives X'(Xw) and, as its last entry, the square of X w's length. Where a vector
    vanishes, what has been found is closed in itself, and a new random one starts beside it; so
    repeated singular values are found as often as they occur by the time that there are ``d`` steps.
    """
    rnd = np.random.default_rng(seed)
    right: list[np.ndarray] = []
    short: list[np.ndarray] = []  # left vector j is X short[j]
    image: list[np.ndarray] = []  # X'X short[j]
    alphas, betas, largest = [], [], 0.0
    v, beta = _apart(rnd.standard_normal(d), right), 0.0
    v /= np.linalg.norm(v)
    while True:
        right.append(v)
        w = v - beta * short[-1] if short else v
        g = times(w)
        g, square = g[:d], g[d]
        if short:
            # The left vectors' products with X w, taken without X: what should be nothing is taken off.
            lost = np.array(short) @ g
            w, g, square = w - lost @ np.array(short), g - lost @ np.array(image), square - lost @ lost
        alpha = float(np.sqrt(max(square, 0.0)))
        largest = max(largest, alpha, beta)
        if alpha > NOTHING * largest:
            short.append(w / alpha)
            image.append(g / alpha)
            residual = image[-1] - alpha * v
        else:
            alpha, residual = 0.0, np.zeros(d)
            short.append(np.zeros(d))
            image.append(np.zeros(d))
        alphas.append(alpha)
        residual = _apart(residual, right)
        beta = float(np.linalg.norm(residual))
        if beta <= NOTHING * max(largest, beta):
            beta = 0.0
        b = np.diag(alphas) + np.diag(betas, 1)
        p, s, qt = np.linalg.svd(b)
        open_ends = beta * np.abs(p[-1, :wanted])
        done = len(right) == d or (len(right) >= wanted and beta > 0 and (open_ends <= SETTLED * s[0]).all())
        if done:
            found = qt[:wanted] @ np.array(right)
            return found / np.linalg.norm(found, axis=1, keepdims=True), s[:wanted]
        betas.append(beta)
        v = residual / beta if beta else _apart(rnd.standard_normal(d), right)
        v = _apart(v, right)
        v /= np.linalg.norm(v)


@dataclass
class Whitening:
    """Rows, their components (unit rows), eigenvalues and the trace of the covariance, all over the fit list."""

    rows: Rows
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def fit_whitening(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Fits up to ``components`` components to all usable vectors; directions without any deviation are none."""
    rows = usable(vectors, id_col, vector_col)
    d, n = len(rows.sums), rows.n
    if not d:
        return Whitening(rows, np.empty((0, 0)), np.empty(0), 0.0, 0.0)
    blocks = centred_blocks(rows)

    def times(w: np.ndarray) -> np.ndarray:
        def products(x: np.ndarray) -> np.ndarray:
            u = x @ w
            return np.append(u @ x, u @ u)

        return summed(blocks, products, d)

    total = float(summed(blocks, lambda x: np.array([np.einsum("ij,ij->", x, x)]), d)[0])
    found, s = bidiagonalise(times, d, min(components, d)) if total else (np.empty((0, d)), np.empty(0))
    deep = s > FLAT * s[0] if len(s) else np.empty(0, bool)
    found, eigenvalues = found[deep], s[deep] ** 2 / n
    scale, k = np.sqrt(eigenvalues), int(deep.sum())
    error = 0.0
    if k:
        mean = summed(blocks, lambda x: (x @ found.T / scale).sum(axis=0), d) / n

        def spread(x: np.ndarray) -> np.ndarray:
            z = x @ found.T / scale - mean
            return z.T @ z

        error = float(np.abs(summed(blocks, spread, d).reshape(k, k) / n - np.eye(k)).max())
    removed(blocks.sparkSession, blocks)
    return Whitening(rows, found, eigenvalues, total / n, error)


def _squares(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n * x - S) ** 2 over dimensions, exactly; null where a long is too small."""
    far = n * int(np.abs(x).max()) + max(map(abs, sums))
    if far < 1 << 62:
        apart = n * x - np.array(sums, dtype=np.int64)
        most = int(np.abs(apart).max())
        if x.shape[1] * most * most < 1 << 63:
            return (apart * apart).sum(axis=1).tolist()
    apart = n * x.astype(object) - np.array(sums, dtype=object)
    return [s if s < 1 << 63 else None for s in (apart * apart).sum(axis=1)]


def whitened(model: Whitening, id_col: str = "vec_id") -> DataFrame:
    """A row for each usable vector and component: id, component, deviation from the mean, and the whitened value.

    ``deviation`` is the exact sum over dimensions of (n * x - S) ** 2; rows of one id stay apart
    as rows. One vector, or only equal ones, has no components and so gives no rows.
    """
    rows, (k, d) = model.rows, model.components.shape
    n, sums, base, rest = rows.n, rows.sums, rows.base if rows.n else None, rows.rest if rows.n else None
    found, scale = model.components, np.sqrt(model.eigenvalues)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column(1), d)
            z = ((x - base) - rest) @ found.T / scale
            at = np.repeat(np.arange(batch.num_rows), k)
            number = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows))
            deviation = pa.array(_squares(x, n, sums), pa.int64()).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), number, deviation, pa.array(z.ravel())], ["id", "component", "deviation", "whitened"])

    kind = dict(rows.table.dtypes)["id"]
    return rows.table.select("id", "x").mapInArrow(project, f"id {kind}, component int, deviation bigint, whitened double").withColumnRenamed("id", id_col)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding's whitened values for up to 32 components, with what each component explains."""
    model = fit_whitening(table(spark, sf_dir, "embeddings"))
    share = F.array(*(F.lit(float(e) / model.trace) for e in model.eigenvalues)) if len(model.eigenvalues) else F.array(F.lit(0.0))
    return whitened(model).select(
        "vec_id", "component", F.lit(model.rows.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("component")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
