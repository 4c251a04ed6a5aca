"""Whitening of embeddings by a two-pass covariance.

The first pass sums whole numbers, so the means are exact whatever the order of the rows;
the second pass sums outer products of centred vectors, one matrix product a slice of rows.
Partial sums of partitions meet in a tree, LAPACK solves the symmetric eigenproblem of one
(dimensions x dimensions) matrix, and the projection is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from gradeloom.llm.common import saved, table
from gradeloom.llm.vectors import matrix, padded, slices, sound, width

#: Steps per unit of the whole-number grid that entries are put on.
GRID = 256
COMPONENTS = 4


def on_grid(column: str) -> Column:
    """A vector's entries as whole numbers of the grid."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * F.lit(float(GRID))).cast("long"))


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` found: n distinct vectors, exact sums, and components by falling eigenvalue.

    projection has a column a component: a unit eigenvector over the root of its eigenvalue,
    zeros where the eigenvalue is zero up to rounding (see ``flat``).
    """

    n: int
    dim: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def components(self) -> int:
        return self.vectors.shape[1]

    @property
    def flat(self) -> np.ndarray:
        """Components along which the vectors don't vary."""
        top = float(self.values.max(initial=0.0))
        return self.values <= top * max(self.dim, 1) * np.finfo(float).eps

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(np.where(self.flat, np.inf, self.values))

    @property
    def explained(self) -> np.ndarray:
        """Each component's share of the variance; 0 where there is none."""
        return np.maximum(self.values, 0) / self.trace if self.trace > 0 else np.zeros(len(self.values))


def _most(x: np.ndarray) -> int:
    """The largest absolute value, which a long may not hold."""
    return max(int(x.max()), -int(x.min())) if x.size else 0


def scaled_deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums of whole numbers: exact, of Python's numbers where longs would overflow."""
    most = _most(x) * n + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean, in doubles."""
    return scaled_deviation(x, n, sums).astype(np.float64) / n


def squared_length(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows of whole numbers; None where a long can't hold it."""
    most = _most(d)
    if most * most * max(d.shape[1], 1) < 1 << 63:
        return (d.astype(np.int64) ** 2).sum(axis=1).tolist()
    whole = [sum(v * v for v in map(int, row)) for row in d]
    return [v if v < 1 << 63 else None for v in whole]


def tree_sum(vectors: DataFrame, column: str, dim: int, shape: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray], kind: type) -> np.ndarray:
    """The sum of part(rows) over all rows of whole-number vectors: one array a partition, merged in a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=kind)
        for piece in slices(batches, dim):
            total += part(matrix(piece.column(0), dim, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(total: Any, more: Any) -> Any:
        more = np.frombuffer(more["sums"], dtype=kind).reshape(shape) if not isinstance(more, np.ndarray) else more
        return total + more

    return vectors.select(column).mapInArrow(partial, "sums binary").rdd.treeAggregate(np.zeros(shape, dtype=kind), add, lambda a, b: a + b)


def fit(vectors: DataFrame, column: str, components: int = COMPONENTS) -> Whitening:
    """The whitening of distinct whole-number vectors of one length, a stored table.

    Sums are of 32-bit halves, so they are exact for up to 2**31 vectors whatever the entries.
    """
    n, dim = vectors.count(), width(vectors, column)[1]
    k = min(components, dim)
    if not n or not dim:
        return Whitening(n, dim, [0] * dim, np.zeros(k), np.zeros((dim, k)), 0.0)
    low = (1 << 32) - 1
    halves = tree_sum(vectors, column, dim, (2, dim), lambda x: np.stack([(x >> 32).sum(axis=0), (x & low).sum(axis=0)]), np.int64)
    sums = [(int(upper) << 32) + int(lower) for upper, lower in halves.T]

    def outer(x: np.ndarray) -> np.ndarray:
        z = centred(x, n, sums)
        return z.T @ z

    cov = tree_sum(vectors, column, dim, (dim, dim), outer, np.float64) / n
    values, basis = np.linalg.eigh((cov + cov.T) / 2)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    largest = basis[np.abs(basis).argmax(axis=0), np.arange(k)]
    found = Whitening(n, dim, sums, values, basis * np.where(largest < 0, -1.0, 1.0), float(np.trace(cov)))
    projection, varied = found.projection, ~found.flat

    def whitened_outer(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ projection
        return w.T @ w

    second = tree_sum(vectors, column, dim, (k, k), whitened_outer, np.float64) / n
    error = np.abs(second - np.eye(k))[np.ix_(varied, varied)].max(initial=0.0)
    return Whitening(n, dim, sums, found.values, found.vectors, found.trace, float(error))


def fit_list(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(x): each distinct whole-number vector of the sound rows once, all of one length, stored."""
    x = embeddings.where(sound(column)).select(on_grid(column).alias("x")).distinct()
    out = saved(x, "fit")
    low, high = width(out, "x")
    if low < high:  # what differs in zeros behind it is one vector
        out = saved(out.select(padded("x", high, F.lit(0).cast("long")).alias("x")).distinct(), "fit")
    return out


def whiten(embeddings: DataFrame, model: Whitening, column: str = "embedding", into: str = "whitened") -> DataFrame:
    """The sound rows with ``into``: a struct of deviation (exact, scaled by n, null beyond a long)
    and whitened, an array with one number a component (null along components without variance)."""
    spark = embeddings.sparkSession
    shared = spark.sparkContext.broadcast((model.n, model.sums, model.projection, model.flat))
    dim, k = model.dim, model.components
    grid = "_grid_of_rows"
    while grid in embeddings.columns:
        grid += "_"
    rows = embeddings.where(sound(column))
    rows = rows.where(F.size(column) <= dim).withColumn(grid, padded(on_grid(column), dim, F.lit(0).cast("long")))
    kept = [c for c in embeddings.columns if c != into]
    cell = StructType([StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()), False)])
    schema = StructType([*[embeddings.schema[c] for c in kept], StructField(into, cell)])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, projection, flat = shared.value
        for piece in slices(batches, dim):
            d = scaled_deviation(matrix(piece.column(len(kept)), dim, np.int64), n, sums)
            z = d.astype(np.float64) / n
            w = np.stack([(z * projection[:, j]).sum(axis=1) for j in range(k)], axis=1) if k else np.zeros((len(z), 0))
            values = pa.array(w.reshape(-1), mask=np.tile(flat, len(w)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), values)
            made = pa.StructArray.from_arrays([pa.array(squared_length(d), pa.int64()), lists], ["deviation", "whitened"])
            yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(len(kept))], made], [*kept, into])

    return rows.select(*[F.col(f"`{c}`") for c in kept], grid).mapInArrow(project, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every sound vector of ``embeddings``.

    Null vectors and those with null or non-finite entries are dropped. Vectors shorter than
    the longest one have zeros behind them; so an empty vector is the zero vector. Repeated
    vectors count once in the fit and keep their rows. Without sound vectors, or where all
    are empty, the result is empty. A component without variance (one distinct vector, or
    fewer than components) has a null ``whitened`` and is left out of the identity error.
    Equal eigenvalues leave the choice of the basis open: any is returned, one for all rows.
    A deviation beyond a long is null. Other columns aren't used, whatever their names.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(fit_list(rows), "x")
    out = whiten(rows, model, into="found").select("vec_id", F.col("found.deviation").alias("deviation"), F.posexplode("found.whitened").alias("at", "whitened"))
    explained = F.element_at(F.lit(model.explained.tolist() or [0.0]), F.col("at") + 1)
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        explained.alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
