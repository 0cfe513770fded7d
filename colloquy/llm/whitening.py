"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The centred rows A stay in Spark. Each step multiplies them with a vector of the dimensions, u = A w, and back, A'u; a task does
both for its rows and sends one vector of the dimensions. Both sides are fully reorthogonalised. The left vectors, one number a row,
are never stored: each is a combination A w of the rows, and its product with another, A v, is (A'u)'v, which the driver has. So
the driver holds vectors of the dimensions and the small bidiagonal matrix, whose singular value decomposition gives
components and deviations, and a step is one scan of the rows.

Entries become whole numbers first, so sums, centres and total variance are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.scratch import Scratch, materialize

#: A whole number for an entry c: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries from here on have no whole number of 64 bits and count as infinite.
BEYOND = 2.0**56
COMPONENTS = 16
#: Beside the greatest singular value: what counts as none, and how far a component may be from converged.
NONE, CONVERGED = 1e-10, 1e-13


def whole(vector: Column) -> Column:
    """The vector in whole numbers; null where it is null or empty, or has null or non-finite entries."""
    entries = vector.cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= BEYOND))
    return F.when((F.size(entries) > 0) & ~bad, F.transform(entries, lambda c: F.floor(c * SCALE) + OFFSET))


def _rows(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _halves(d: int):
    """Per task, dimension and product: the sums of x and of x * x, in parts that can't overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = [0] * d, 0
        for batch in batches:
            x = _rows(batch.column(0), d)
            if not len(x):
                continue
            total = [a + b * (1 << 32) + c for a, b, c in zip(total, (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist())]
            near = x - OFFSET
            if np.abs(near).max(initial=0) < 2**20:
                square += sum((near * near).sum(axis=1).tolist())
            else:
                square += sum(v * v for v in near.ravel().tolist())
        kinds = [pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([range(d + 1), [str(v) for v in [*total, square]]], kinds)], ["at", "sum"])

    return run


@dataclass(frozen=True)
class Centre:
    """n, and exact sums by dimension; x - S/n is (x - m) - r/n with whole m."""

    n: int
    sums: tuple[int, ...]

    def centred(self, x: np.ndarray) -> np.ndarray:
        m = np.array([s // self.n for s in self.sums], np.int64)
        r = np.array([(s - s // self.n * self.n) / self.n for s in self.sums])
        return (x - m).astype(np.float64) - r

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - S)**2, exact."""
        m = np.array([s // self.n for s in self.sums], np.int64)
        r = np.array([s - s // self.n * self.n for s in self.sums], np.int64)
        near = x - m
        if (int(np.abs(near).max(initial=0)) + 1) * self.n < 2**31 / x.shape[1] ** 0.5:
            # Squares and their sum fit 63 bits.
            return ((near * self.n - r) ** 2).sum(axis=1).tolist()
        return [sum((v * self.n - s) ** 2 for v, s in zip(row, r.tolist())) for row in near.tolist()]


def _products(centre: Centre, d: int, make):
    """One array a task: the sum of ``make(rows)`` over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                made = make(centre.centred(_rows(batch.column(0), d)))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"])

    return run


class Rows:
    """The fit list in Spark, with products against it."""

    def __init__(self, fit: DataFrame, centre: Centre):
        self.fit, self.centre, self.d = fit, centre, len(centre.sums)

    def total(self, make) -> np.ndarray:
        """``make`` gives a flat array for some centred rows; their sum over all."""
        parts = self.fit.mapInArrow(_products(self.centre, self.d, make), "at int, value double")
        return np.array([r.value for r in sorted(parts.groupBy("at").agg(F.sum("value").alias("value")).collect())])

    def back(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        """Of u = A w: A'u, and u's length."""

        def make(a: np.ndarray) -> np.ndarray:
            u = a @ w
            return np.append(a.T @ u, u @ u)

        found = self.total(make)
        return found[:-1], float(np.sqrt(found[-1]))


def bidiagonalise(rows: Rows, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest singular values of the centred rows, and their right vectors (columns).

    Stops once those have converged and, as a start may miss a value that repeats, as many more steps from a fresh start
    have changed nothing; after ``d`` steps at the latest, when the vectors span all dimensions.
    """
    d = rows.d
    rng = np.random.default_rng(1)
    # Right vectors, the weights w of the left ones, and what the left ones give back, A'u.
    right, weights, backs = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    matrix = np.zeros((d, d + 1))
    scale, beta, restarted_at = 0.0, 0.0, None
    v = None
    for j in range(d):
        if v is None:
            v = rng.standard_normal(d)
            for _ in range(3):
                v -= right @ (right.T @ v)
            v /= np.linalg.norm(v)
        right = np.column_stack([right, v])
        # A v against all left vectors, twice; the last of them has the part beta.
        w, along = v, np.zeros(j)
        for _ in range(2):
            part = backs.T @ w
            w, along = w - weights @ part, along + part
        z, alpha = rows.back(w)
        scale = max(scale, alpha, beta)
        matrix[:j, j], matrix[j, j] = along, alpha
        if alpha <= NONE * scale:
            matrix[j, j], z, w = 0.0, np.zeros(d), np.zeros(d)
        else:
            z, w = z / alpha, w / alpha
        weights, backs = np.column_stack([weights, w]), np.column_stack([backs, z])
        for _ in range(2):
            z = z - right @ (right.T @ z)
        beta = float(np.linalg.norm(z))
        small = beta <= NONE * scale
        v = None if small else z / beta
        left, values, _ = np.linalg.svd(matrix[: j + 1, : j + 1])
        top = min(wanted, j + 1)
        if j + 1 >= min(wanted, d) and (beta * np.abs(left[-1, :top]) <= CONVERGED * values[0]).all():
            if restarted_at is None:
                restarted_at, v = j + 1, None
            elif j + 1 >= 2 * restarted_at:
                break
    size = right.shape[1]
    _, values, turned = np.linalg.svd(matrix[:size, :size])
    return values[:wanted], (right @ turned.T)[:, :wanted]


def _prevailing(rows: DataFrame) -> int | None:
    """The commonest number of dimensions, the greatest of equally common ones."""
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.max(F.struct("n", "d")).alias("m")).first()
    return None if found["m"] is None else found["m"]["d"]


def whiten(embeddings: DataFrame, wanted: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row and component: id, component (from 1), n, deviation (decimal), whitened, explained, identity_error.

    The fit list is each distinct vector of whole numbers once. Rows whose vector is null, empty, has null or non-finite entries, or another
    number of dimensions than most, are dropped. Components without variance are left out, so one distinct vector (or none) gives
    no rows. Repeated and null ids are rows like others; other columns are not read. Signs of components are arbitrary, the same for all rows.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col(id_col), whole(F.col(vector_col)).alias("x")).where("x is not null")
    d = _prevailing(rows)
    if d is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == d)
    scratch = Scratch(spark)
    fit = scratch.keep(rows.select("x").distinct(), "vectors")
    n = fit.count()
    parts = fit.mapInArrow(_halves(d), "at int, sum string").groupBy("at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
    sums = [int(r["sum"]) for r in sorted(parts)]
    centre = Centre(n, tuple(sums[:d]))
    # The squares are of x - OFFSET.
    trace = (n * sums[d] - sum((s - n * OFFSET) ** 2 for s in sums[:d])) / n**2
    fitted = Rows(fit, centre)
    values, components = bidiagonalise(fitted, min(wanted, d)) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    some = values > 1e-7 * values.max(initial=0)
    values, components = values[some], components[:, some]
    k = len(values)
    if not k:
        scratch.clear()
        return spark.createDataFrame([], schema)
    scaled = components * (np.sqrt(n) / values)
    explained = (values**2 / n / trace).tolist()

    def covariance(a: np.ndarray) -> np.ndarray:
        white = a @ scaled
        return (white.T @ white).ravel()

    error = float(np.abs(fitted.total(covariance).reshape(k, k) / n - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1), d)
            m = len(x)
            deviations = pa.array([str(v) for v in centre.deviations(x)], pa.string()) if m else pa.array([], pa.string())
            each = pa.array(np.repeat(np.arange(m), k))
            white = (centre.centred(x) @ scaled).ravel()
            columns = [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviations.take(each), pa.array(white), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    out = rows.mapInArrow(project, schema.replace("decimal(38,0)", "string")).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
    scratch.clear()
    return out.select(*names)
