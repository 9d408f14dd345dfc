"""Whitening of embeddings, with covariances from variances alone (polarisation).

An entry c becomes the whole number x = floor(1024 c) + 100000. For two dimensions i and j,

    2 cov(i, j) = var(i + j) - var(i) - var(j),

so all that is summed over the rows is the square of each centred dimension and of each centred sum of two dimensions. The sums are
exact: x is centred on the whole part m of its mean, u = x - m, and squares of whole numbers are added in 64 bits per batch and in
numbers of any size beyond. With S the sum of x, r = S - n m and y = n x - S = n u - r, the sums of the squares of y, which are
centred exactly, are

    sum (y_i + y_j)^2 = n^2 sum (u_i + u_j)^2 - n (r_i + r_j)^2

in whole numbers, so no rounding occurs before the covariance matrix is written down in doubles and handed to ``eigh``.

1. One pass adds up x per dimension and counts the vectors of each length.
2. One pass adds up the squares, d (d + 1) / 2 numbers per task, which Spark adds up by pair of dimensions. The matrix is all that reaches
   the driver; its size is that of the dimension, whatever the number of rows.
3. One pass projects and whitens; the covariance of the result is taken by Spark's own centred aggregates.

Edge cases: vectors that are null, or hold an entry that is null, not finite, or of ``LARGEST`` or more in size (whose x leaves
the range in which sums are exact), are left out. Vectors of another length than the commonest one (the longest of those that are equally
common) have no covariance with the others and are left out too, as are vectors without entries. Rows without a vec_id and repeated
rows count like any other. A component whose eigenvalue is zero to double precision has ``whitened`` null and does not enter
``identity_error``, which is null if no component is left; ``explained`` is null if all vectors are equal. ``deviation`` is
null if the exact value does not fit in a long. Vectors of fewer than 8 dimensions have as many components as dimensions. Other
columns are not read; without vectors there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifflens.llm.common import prepare

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
LARGEST = 2.0**40
# Squares of sums of two numbers below 2^SMALL_BITS, ROWS at a time, fit in 64 bits.
SMALL_BITS, ROWS = 26, 512
WIDE = pa.decimal128(38, 0)
# An eigenvalue below this share of the largest, times the dimension, is zero to double precision.
ZERO = 16 * float(np.finfo(np.float64).eps)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector takes part, the vector as doubles in ``__vector``."""
    def good(c: Column) -> Column:
        return F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False))

    asked = vectors.withColumn("__vector", F.col(vector).cast("array<double>"))
    return asked.where(F.coalesce(F.forall("__vector", good), F.lit(False)) & (F.size("__vector") > 0))


def whole_numbers(column: pa.Array) -> np.ndarray:
    """x of a batch of vectors of one length, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(column), -1) + OFFSET


def big(sums: np.ndarray) -> pa.Array:
    """Whole numbers of any size as decimals."""
    return pa.array([Decimal(int(s)) for s in sums], WIDE)


def sums(rows: DataFrame) -> DataFrame:
    """length, dim, n and s: the sum of x in each dimension, for the vectors of each length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths).tolist():
                x = whole_numbers(column.filter(pa.array(lengths == length)))
                held = totals.setdefault(length, [0, np.zeros(length, object)])
                held[0] += len(x)
                # 2^51 at most each, so ROWS of them fit in 64 bits.
                for at in range(0, len(x), ROWS):
                    held[1] = held[1] + x[at : at + ROWS].sum(axis=0).astype(object)
        for length, (n, s) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()), big(s)],
                names=["length", "dim", "n", "s"],
            )

    parts = rows.select("__vector").mapInArrow(add, "length int, dim int, n long, s decimal(38,0)")
    return parts.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def squares(rows: DataFrame, centre: np.ndarray) -> DataFrame:
    """i, j and q: the sum of the squares of u_i (for i = j) and of u_i + u_j (for i < j)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(centre)
        totals = np.zeros((d, d), object)
        for batch in batches:
            every = whole_numbers(batch.column(0)) - centre
            for at in range(0, len(every), ROWS):
                u = every[at : at + ROWS]
                if np.abs(u).max(initial=0) >= 2**SMALL_BITS:
                    u = u.astype(object)
                for i in range(d):
                    both = u[:, i:] + u[:, i : i + 1]
                    both[:, 0] = u[:, i]
                    totals[i, i:] += (both * both).sum(axis=0).astype(object)
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), big(totals[i, j])], names=["i", "j", "q"]
        )

    parts = rows.select("__vector").mapInArrow(add, "i int, j int, q decimal(38,0)")
    return parts.groupBy("i", "j").agg(F.sum("q").alias("q"))


@dataclass
class Whitener:
    """What is known of the fit list: the number of vectors, the sum of x per dimension, eigenvalues and their unit vectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def whole_mean(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]

    def kept(self, components: int) -> list[int]:
        """The components, of those asked for, that have a variance."""
        least = self.values[0] * ZERO * len(self.values)
        return [k for k in range(min(components, len(self.values))) if self.values[k] > least]


def covariance(n: int, total: list[int], pairs: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix of x, from the sums of squares of single and of paired dimensions, centred on the whole mean."""
    d = len(total)
    rest = [s % n for s in total]
    own = [n * n * pairs[i, i] - n * rest[i] ** 2 for i in range(d)]
    matrix = np.empty((d, d))
    for i in range(d):
        matrix[i, i] = own[i] / n**3
        for j in range(i + 1, d):
            both = n * n * pairs[i, j] - n * (rest[i] + rest[j]) ** 2
            matrix[i, j] = matrix[j, i] = (both - own[i] - own[j]) // 2 / n**3
    return matrix


def fit(rows: DataFrame) -> Whitener | None:
    """The whitener of all usable vectors of the commonest length; None if there are none."""
    found = sums(rows)
    best = found.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).select("length", "n").first()
    if best is None:
        return None
    length, n = best
    total = [int(r["s"]) for r in found.where(F.col("length") == length).orderBy("dim").select("s").collect()]
    centre = np.array([s // n for s in total], np.int64)
    held = squares(rows.where(F.size("__vector") == length), centre).toArrow()
    columns = (held.column(name).to_pylist() for name in ("i", "j", "q"))
    matrix = covariance(n, total, {(i, j): int(q) for i, j, q in zip(*columns)})
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1].copy(), vectors[:, ::-1]
    # Either sign will do; the largest entry is positive, so that runs agree.
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(length)])
    return Whitener(n, total, values, vectors * sign, float(np.trace(matrix)))


def project(rows: DataFrame, model: Whitener, key: str, components: int) -> DataFrame:
    """key, deviation and w (the whitened components), for the vectors of the length of the model."""
    kept, count = model.kept(components), min(components, len(model.values))
    n, centre, rest, d = model.n, model.whole_mean, model.rest, len(model.sums)
    basis = model.vectors[:, kept] / np.sqrt(model.values[kept])
    share = np.array([r / n for r in rest])

    def deviations(u: np.ndarray) -> list[int | None]:
        y_limit = n * (int(np.abs(u).max(initial=0)) + 1)
        if y_limit * y_limit * d < 2**63:
            y = n * u - np.array(rest, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = n * u.astype(object) - np.array(rest, object)
        return [v if v < 2**63 else None for v in (y * y).sum(axis=1).tolist()]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = whole_numbers(batch.column(1)) - centre
            w = np.full((len(u), count), np.nan)
            w[:, kept] = (u - share) @ basis
            flat = pa.array(w.ravel(), pa.float64(), from_pandas=True)  # not a number reads as null
            lists = pa.ListArray.from_arrays(pa.array(range(0, len(u) * count + 1, count), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviations(u), pa.int64()), lists], names=["key", "deviation", "w"]
            )

    asked = rows.where(F.size("__vector") == d).select(F.col(key).alias("key"), "__vector")
    kind = asked.schema["key"].dataType.simpleString()
    return asked.mapInArrow(turn, f"key {kind}, deviation long, w array<double>")


def identity_error(turned: DataFrame, kept: list[int]) -> float | None:
    """The largest absolute entry of the covariance of the whitened components minus the identity."""
    pairs = [(a, b) for a in kept for b in kept if a <= b]
    if not pairs:
        return None
    columns = [F.get("w", F.lit(k)).alias(f"w{k}") for k in kept]
    found = turned.select(*columns).agg(*(F.covar_pop(f"w{a}", f"w{b}") for a, b in pairs)).first()
    return max(abs(value - (a == b)) for value, (a, b) in zip(found, pairs))


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error, for each usable vector and component."""
    prepare(vectors.sparkSession)
    rows = usable(vectors.select(key, vector), vector)
    model = fit(rows)
    if model is None:
        kind = vectors.schema[key].dataType.simpleString()
        schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    turned = project(rows, model, key, components)
    error = identity_error(turned, model.kept(components))
    shares = [float(v / model.trace) if model.trace > 0 else None for v in model.values[:components]]
    spread = turned.select("key", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.array(*(F.lit(s).cast("double") for s in shares))
    return spread.select(
        F.col("key").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
