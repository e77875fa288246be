"""Whitening of embeddings: compensated covariance, divide-and-conquer eigenvectors, and projections of unit variance.

Entries become whole numbers, floor(SCALE * c) + OFFSET, and each different vector counts once in the fit. Sums are exact.
A centred entry, x - S / n, is a pair of doubles whose sum has twice their precision. Its outer products are summed without
a rounding error: a block's entries are cut into slices of SLICE_BITS bits, so narrow that a matrix product of two slices over BLOCK
rows is exact in doubles, and these products are added into a high and a low matrix by the error-free sum of two
doubles. Tasks give their high and low parts row by row of the matrix; the parts of a row meet in one task, which adds them the same way, one at a time.

Only d sums and d * d covariances reach the driver, d <= MOST_DIMENSIONS, never a row of the table. There LAPACK's symmetric
eigen-solver reduces the matrix to tridiagonal form and divides and conquers (numpy.linalg.eigh).
Components whose eigenvalue is no more than what rounding leaves, d * 2^-52 of the largest, have no unit variance and are left out.
identity_error is measured, not derived: the fit list is projected, and the covariance of that is formed as above.

Defined results: vectors that are null or have a null or non-finite entry have no rows. Of vectors of different lengths those of
the most frequent length, the longer one of equals, are the table; others have no rows, nor have empty vectors. With one
different vector, or none, there are no components and no rows. Repeated rows have rows each, a null vec_id stays null. Entries
must stay below 2^40 in size, and deviation must fit a long: else an error says so. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, table

SCALE, OFFSET, MOST_COMPONENTS = 64, 1_000_000, 16
#: Dimensions of a vector; a task and the driver hold a few matrices of d * d doubles.
MOST_DIMENSIONS = 4096
#: Rows of a block, bits of a slice and slices: 2 * SLICE_BITS + log2(BLOCK) <= 53.
BLOCK, SLICE_BITS, SLICES = 2048, 21, 5


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of vectors whose entries are all there and finite."""
    values = F.col(vector).cast("array<double>")
    good = F.col(vector).isNotNull() & ~F.exists(values, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(values, lambda c: F.when(F.abs(c) < 2.0**40, F.floor(c * SCALE).cast("long") + OFFSET).otherwise(F.raise_error(F.lit("an entry is too large to be whitened")).cast("long")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), whole.alias("x"))


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _added(high: np.ndarray, low: np.ndarray, h: np.ndarray, l: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """The sum of two pairs of high and low parts, as such a pair."""
    s, e = two_sum(high, h)
    return two_sum(s, e + (low + l))


def _cut(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Slices of a block's pairs, column by column on one grid: their sum is the block but for 2^-104 of a column's largest entry."""
    most = np.abs(high).max(axis=0, initial=0.0)
    unit = np.ldexp(1.0, np.frexp(most)[1] - SLICE_BITS)
    out = []
    for _ in range(SLICES):
        out.append(np.rint(high / unit) * unit)
        high, low = two_sum(high - out[-1], low)
        unit = np.ldexp(unit, -SLICE_BITS)
    return out


def outer_products(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over rows of the outer products of pairs, as a high and a low matrix."""
    d = high.shape[1]
    h, l = np.zeros((d, d)), np.zeros((d, d))  # noqa: E741
    for at in range(0, len(high), BLOCK):
        parts = _cut(high[at : at + BLOCK], low[at : at + BLOCK])
        for a in range(SLICES):
            for b in range(a, SLICES - a):
                product = parts[a].T @ parts[b]  # exact
                h, l = _added(h, l, product)  # noqa: E741
                if a != b:
                    h, l = _added(h, l, product.T)  # noqa: E741
    return h, l


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of rows of x and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                n, part = n + batch.num_rows, _matrix(batch.column(0)).sum(axis=0)
                total = part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array([n, *total.tolist()], pa.int64())], ["i", "s"])

    found = dict(fit.mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).toPandas().itertuples(index=False, name=None))
    n = int(found.pop(-1, 0))
    return n, [int(found[i]) for i in sorted(found)]


def covariance(rows: DataFrame, centre: list[Fraction], n: int) -> np.ndarray:
    """Covariance, divisor n, of one column of lists around a centre."""
    first = np.array([float(c) for c in centre])
    rest = np.array([float(c - Fraction(float(c))) for c in centre])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column(0).slice(at, BLOCK)).astype(np.float64)
                c, e = two_sum(x, -first[None, :])
                h, l = outer_products(*two_sum(c, e - rest[None, :]))  # noqa: E741
                high, low = (h, l) if high is None else _added(high, low, h, l)
        if high is not None:
            yield from _rows(dict(enumerate(zip(high, low, strict=True))))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i, h, l in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)), _matrix(batch.column(2)), strict=True):  # noqa: E741
                own[i] = _added(*own[i], h, l) if i in own else (h, l)
        yield from _rows(own)

    kind = "i int, high array<double>, low array<double>"
    by_row = rows.mapInArrow(parts, kind).repartition("i").mapInArrow(merged, kind).orderBy("i").toArrow()
    return (_matrix(by_row["high"].combine_chunks()) + _matrix(by_row["low"].combine_chunks())) / n


def _rows(matrix: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if matrix:
        yield pa.RecordBatch.from_arrays([pa.array(list(matrix), pa.int32()), *(pa.array([x[k] for x in matrix.values()], pa.list_(pa.float64())) for k in (0, 1))], ["i", "high", "low"])


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums per dimension; axes has a component a column, values their eigenvalues, falling."""

    n: int
    totals: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(v) / self.trace for v in self.values]

    def _centred(self, x: np.ndarray) -> np.ndarray:
        return self.n * x - np.array(self.totals, dtype=np.int64)[None, :]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Centred rows projected on the components, over the root of their eigenvalues."""
        return (self._centred(x).astype(np.float64) / self.n) @ self.axes / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) ** 2, exact."""
        away = self._centred(x)
        if int(np.abs(away).max(initial=0)) ** 2 * max(1, away.shape[1]) < 2**63:
            return (away * away).sum(axis=1).tolist()
        out = [sum(v * v for v in row) for row in away.tolist()]
        if max(out) >= 2**63:
            raise OverflowError("deviation does not fit a long")
        return out


def fit_whitening(fit: DataFrame, most: int = MOST_COMPONENTS) -> Whitening | None:
    """The whitening of different vectors (x, of one length); None without any component."""
    n, totals = sums(fit)
    if n < 2 or not totals:
        return None
    if len(totals) > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions")
    v = covariance(fit, [Fraction(s, n) for s in totals], n)
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    sure = values > len(totals) * 2.0**-52 * values[0]
    return Whitening(n, totals, np.ascontiguousarray(axes[:, sure]), values[sure], float(np.trace(v))) if sure.any() else None


def whitened(x: DataFrame, model: Whitening, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep..., deviation and the list whitened of vectors x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                rows = _matrix(part.column(len(keep)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(model.values)), pa.array(model.whiten(rows).ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(model.deviation(rows), pa.int64()), lists], [*keep, "deviation", "whitened"])

    kept = x.select(*keep, "x")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)]]
    return kept.mapInArrow(run, ", ".join([*kinds, "deviation long", "whitened array<double>"]))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    lists = whitened(fit, model).select("whitened")
    k = len(model.values)
    totals = lists.select(F.posexplode("whitened").alias("i", "w")).groupBy("i").agg(F.sum("w").alias("s")).toPandas()
    centre = [Fraction(float(s)) / model.n for _, s in sorted(zip(totals["i"], totals["s"], strict=True))]
    return float(np.abs(covariance(lists, centre, model.n) - np.eye(k)).max())


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    """Result: vec_id, component, n, deviation, whitened, explained, identity_error."""
    every = quantised(vectors, key, vector)
    length = every.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).agg(F.max_by("d", F.struct("c", "d"))).first()[0] or 0
    own = every.where(F.size("x") == length)
    fit = materialise(own.select("x").distinct(), "fit")
    model = fit_whitening(fit, most)
    error = identity_error(fit, model) if model else 0.0
    discard(fit)
    if model is None:
        none = own.select("vec_id", F.lit(0).alias("component"), *[F.lit(0).cast("long").alias(c) for c in ("n", "deviation")], *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
        return none.where(F.lit(False))
    each = whitened(own, model, ("vec_id",)).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    shares = F.array(*[F.lit(s) for s in model.explained])
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "k").alias("explained"), F.lit(error).alias("identity_error"))


def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every vector's projections on the leading components."""
    return whiten(table(spark, sf_dir, "embeddings"))
