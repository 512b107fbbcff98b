"""Embedding whitening by two-pass covariance.

Every entry c becomes the integer x = floor(SCALE c) + SHIFT. First pass: exact integer sums by dimension, so the mean S/n is exact.
Second pass: each task centres its rows (integers first: x less the whole part of the mean, then less its fraction, so that no digit
cancels) and adds up their outer products by matrix products; treeAggregate merges the tasks' matrices. LAPACK's symmetric eigh gives the
components, and a broadcast projection whitens every row. A third pass measures the covariance of the whitened values themselves, with the
tasks' own means, and its largest distance from the identity is returned as identity_error.

Only a matrix a task and length travels; the driver holds one of dims^2 for each length of vectors.

Defined results. Vectors that are null or hold null or non-finite entries are dropped; so are those with an entry of 2^62 / SCALE or
more, whose x is no long. Rows with a null vec_id stay, with null as their id; repeated rows count each. Vectors of different lengths are
lists of their own, each whitened by itself; empty vectors have no component. A component whose eigenvalue is nothing but rounding
(constant dimensions, fewer rows than dimensions, one row) has null in whitened and doesn't count in identity_error; explained is null
where all variance is. The sign of a component makes its largest entry positive, the first of equals; components of equal eigenvalues may
be any basis. deviation is exact or null where it is no long. An empty table gives no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table

#: Fixed values of the query's contract: x = floor(SCALE c) + SHIFT, components that are returned.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Rows in a matrix product, and levels of the merging tree.
BLOCK_ROWS, DEPTH = 4096, 3
LONG = (1 << 63) - 1


def integers(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(vec_ids, x less SHIFT as longs) of the rows that count, in blocks of one length."""
    if pa.types.is_fixed_size_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    offsets = np.asarray(vectors.offsets, np.int64)
    values = vectors.values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)  # null: nan
    lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), offsets[1:] - offsets[:-1], 0)
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        for i in range(0, len(rows), BLOCK_ROWS):
            at = rows[i : i + BLOCK_ROWS]
            c = values[offsets[at][:, None] + np.arange(dim)]
            good = (np.abs(c) < 2.0**62 / SCALE).all(axis=1)  # false for nan and infinities
            if good.any():
                yield ids.take(pa.array(at[good])), np.floor(SCALE * c[good]).astype(np.int64)


@dataclass
class Sums:
    """Of x less SHIFT, by dimension: exact, whatever the number of rows."""

    n: int
    total: list[int]

    def merged(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, [a + b for a, b in zip(self.total, other.total)])


@dataclass
class Moments:
    """Number, mean and centred outer products of rows of doubles."""

    n: int
    mean: np.ndarray
    outer: np.ndarray

    @classmethod
    def of(cls, z: np.ndarray) -> Moments:
        mean = z.mean(axis=0)
        d = z - mean
        return cls(len(z), mean, d.T @ d)

    def merged(self, other: Moments) -> Moments:
        """Of both lists together: each keeps its own centre, the distance of the centres comes on top."""
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.outer + other.outer + np.outer(d, d) * (self.n * other.n / n))


@dataclass
class Centred:
    """Sums of outer products of rows whose mean over all is zero."""

    outer: np.ndarray

    def merged(self, other: Centred) -> Centred:
        return Centred(self.outer + other.outer)


@dataclass
class Model:
    """What whitening needs of the vectors of one length."""

    n: int
    total: list[int]
    components: np.ndarray  # dims x components
    root: np.ndarray  # of the eigenvalues; nan where there is none
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.total)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / self.root

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S)^2, exactly; null where it is no long. SHIFT cancels in it."""
        most = max(int(np.abs(x).max()), max(map(abs, self.total)) // self.n + 1)
        if (2 * most * self.n) ** 2 * x.shape[1] <= LONG:
            d = self.n * x - np.array(self.total, np.int64)
            return pa.array((d * d).sum(axis=1))
        z = self.centred(x) * self.n
        near = (z * z).sum(axis=1) < 1.01 * LONG  # the others are no longs for sure
        exact = lambda row: sum((self.n * v - s) ** 2 for v, s in zip(row, self.total))
        found = [exact(row) if ok else None for row, ok in zip(x.tolist(), near)]
        return pa.array([v if v is not None and v <= LONG else None for v in found], pa.int64())


def centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x less the mean total / n, rounded once: the whole part goes in integers, what is left of the mean is less than 1."""
    whole = np.array([t // n for t in total], np.int64)
    left = np.array([(t % n) / n for t in total])
    return (x - whole).astype(np.float64) - left


def merged_by_length(vectors: DataFrame, part: Callable[[int, np.ndarray], object | None]) -> dict[int, object]:
    """part(length, block of integers) of every block, merged by length: within its task, then by treeAggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, object] = {}
        for b in batches:
            for _, x in integers(b.column(0), b.column(1)):
                if (p := part(x.shape[1], x)) is not None:
                    both(held, {x.shape[1]: p})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["part"])

    def both(a: dict, b: dict) -> dict:
        for dim, p in b.items():
            a[dim] = a[dim].merged(p) if dim in a else p
        return a

    parts = vectors.mapInArrow(run, "part binary").rdd  # a row a task
    return parts.treeAggregate({}, lambda a, row: both(a, pickle.loads(row.part)), both, DEPTH)


def sums(vectors: DataFrame) -> dict[int, Sums]:
    """First pass. Upper and lower halves are added apart, so that no sum of a block passes 64 bits."""

    def part(dim: int, x: np.ndarray) -> Sums:
        high, low = (x >> 31).sum(axis=0).tolist(), (x & 0x7FFFFFFF).sum(axis=0).tolist()
        return Sums(len(x), [(h << 31) + lo for h, lo in zip(high, low)])

    return merged_by_length(vectors, part)


def fitted(dim: int, s: Sums, outer: np.ndarray, components: int) -> Model:
    """The model from the second pass' sum of centred outer products."""
    values, bases = np.linalg.eigh((outer + outer.T) / 2 / s.n)
    values, bases = values[::-1], bases[:, ::-1]
    k = min(components, dim)
    largest = np.abs(bases).argmax(axis=0)
    bases = bases * np.sign(bases[largest, np.arange(dim)])
    trace = np.trace(outer) / s.n
    real = values > max(values[0], 0) * dim * np.finfo(np.float64).eps
    with np.errstate(invalid="ignore", divide="ignore"):
        explained = np.where(trace > 0, np.maximum(values, 0) / trace, np.nan)
    return Model(s.n, s.total, np.ascontiguousarray(bases[:, :k]), np.where(real, np.sqrt(np.where(real, values, 1)), np.nan)[:k], explained[:k])


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each length of vectors; vectors (vec_id, embedding). The vectors are read three times, and none comes to the driver."""
    spark = vectors.sparkSession
    total = sums(vectors)
    if not total:
        return {}
    held = spark.sparkContext.broadcast(total)
    outer = merged_by_length(vectors, lambda dim, x: Centred((d := centred(x, held.value[dim].n, held.value[dim].total)).T @ d))
    models = {dim: fitted(dim, s, outer[dim].outer, components) for dim, s in total.items()}
    sent = spark.sparkContext.broadcast(models)

    def measured(dim: int, x: np.ndarray) -> Moments | None:
        m = sent.value[dim]
        real = ~np.isnan(m.root)
        return Moments.of(m.whitened(x)[:, real]) if real.any() else None

    for dim, found in merged_by_length(vectors, measured).items():
        models[dim].identity_error = float(np.abs(found.outer / found.n - np.eye(len(found.mean))).max())
    held.unpersist()
    sent.unpersist()
    return models


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each row and component of vectors (vec_id, embedding)."""
    rows = vectors.select("vec_id", "embedding")
    kind = rows.schema["vec_id"].dataType.simpleString()
    held = rows.sparkSession.sparkContext.broadcast(fit(rows, components))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x in integers(b.column(0), b.column(1)):
                m = held.value[x.shape[1]]
                k, n = len(m.root), len(x)
                each = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.repeat(pa.scalar(m.n, pa.int64()), n * k),
                        m.deviation(x).take(each),
                        _nulls(m.whitened(x).ravel()),
                        _nulls(np.tile(m.explained, n)),
                        pa.repeat(pa.scalar(m.identity_error, pa.float64()), n * k),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _nulls(x: np.ndarray) -> pa.Array:
    return pc.if_else(pa.array(np.isnan(x)), pa.scalar(None, pa.float64()), pa.array(x))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
