"""Whitening of vectors from an exact bit-sliced scatter.

1. Each entry c becomes the integer x = floor(1024 c) + 100000. A task takes
   some thousand rows, shifts every dimension by the rows' smallest value and
   packs bit a of dimension i across the rows into words. The cross-product of two
   dimensions is the sum of 2**(a + b) * popcount(plane a of i AND plane b of j),
   exact; undoing the shift is integer algebra, so tasks need not agree on one.
2. Spark adds the tasks' sums as decimals: one row for each pair of dimensions,
   whatever the number of vectors. n * cross-products - S S' is n**2 times the covariance,
   centred in integers; each entry is divided once, correctly rounded, before ``eigh``.
3. Rows are centred as n * x - S, exactly, and projected. How far the
   covariance of the whitened values is from the identity is measured in a pass over
   them, with sums by component pair.

The fit list is every vector, no sample. Vectors that are null or empty, or hold
null or non-finite entries, take no part; an entry of 2**40 or more in size counts as
non-finite, since 1024 times it is no whole number that a double tells from the next.
Vectors of each length are a fit list of their own. A null id stays null, and rows
that repeat count as often as they are there. Components whose eigenvalue is zero up to rounding
(constant dimensions, fewer rows than dimensions) have a null ``whitened`` and no part in
``identity_error``; without variance at all ``explained`` is null. An eigenvector's sign makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import ship, table
from candlewick.llm.vectors import matrices

SCALE, SHIFT = 1024, 100_000
LIMIT = 2.0**40
#: Rows that are sliced at once, fewer where vectors are long.
ROWS = 16_384
#: Values whose sum or product is below this are added in int64, others as Python's integers.
SAFE = 2**62


def integers(entries: np.ndarray) -> np.ndarray:
    """x of a matrix of entries."""
    return np.floor(entries * SCALE).astype(np.int64) + SHIFT


def bit_planes(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of a matrix of non-negative integers: words (planes x words), the dimension and the bit of each, by dimension."""
    rows, dims = u.shape
    bits = np.array([max(1, int(m).bit_length()) for m in u.max(axis=0)])
    first = np.cumsum(bits) - bits
    packed = np.zeros((int(bits.sum()), -(-rows // 64) * 8), np.uint8)
    for a in range(int(bits.max())):
        has = np.flatnonzero(bits > a)
        packed[first[has] + a, : -(-rows // 8)] = np.packbits((u[:, has] >> a & 1).astype(np.uint8).T, axis=1)
    return packed.view(np.uint64), np.repeat(np.arange(dims), bits), np.arange(len(packed)) - np.repeat(first, bits)


def cross_products(u: np.ndarray) -> np.ndarray:
    """Sums over the rows of u_i * u_j for i <= j (zero below), as Python's integers where int64 could overflow."""
    rows, dims = u.shape
    words, dim, bit = bit_planes(u)
    first = np.searchsorted(dim, np.arange(dims))
    kind = np.int64 if rows * int(u.max(initial=0)) ** 2 < SAFE else object
    weight = np.array([1 << int(b) for b in bit], dtype=kind)
    out = np.zeros((dims, dims), kind)
    for i in range(dims):
        start = first[i]
        row = np.zeros(len(words) - start, kind)
        for a in range(start, first[i + 1] if i + 1 < dims else len(words)):
            row = row + np.bitwise_count(words[a] & words[start:]).sum(axis=1, dtype=np.int64).astype(kind) * weight[a]
        out[i, i:] = np.add.reduceat(row * weight[start:], first[i:] - start)
    return out


class Sums:
    """n, sums and cross-products of x, exact."""

    def __init__(self, dims: int):
        self.n, self.total, self.cross = 0, np.zeros(dims, object), np.zeros((dims, dims), object)

    def add(self, x: np.ndarray) -> None:
        least = x.min(axis=0)
        u = x - least
        n, low = len(x), least.astype(object)
        total = u.sum(axis=0) if n * int(u.max(initial=0)) < SAFE else u.astype(object).sum(axis=0)
        total = total.astype(object)
        upper = cross_products(u).astype(object)
        self.cross += upper + np.outer(low, total) + np.outer(total, low) + n * np.outer(low, low)
        self.total += total + n * low
        self.n += n


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def scatter(vectors: DataFrame, vector_col: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Length of vectors -> (n, S, cross-products), as Python's integers; a few thousand numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Sums] = {}
        for batch in batches:
            for _, entries in matrices(batch, "v", LIMIT):
                dims = entries.shape[1]
                own = sums.setdefault(dims, Sums(dims))
                step = max(64, min(ROWS, (1 << 20) // dims))
                for k in range(0, len(entries), step):
                    own.add(integers(entries[k : k + step]))
        for dims, own in sums.items():
            i, j = np.triu_indices(dims)
            i, j = np.concatenate([[-1], np.full(dims, -1), i]), np.concatenate([[-1], np.arange(dims), j])
            values = np.concatenate([[own.n], own.total, own.cross[np.triu_indices(dims)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dims, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _decimals(values)], names=["dims", "i", "j", "value"])

    parts = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "dims int, i int, j int, value decimal(38,0)")
    found: dict[int, dict] = {}
    for r in parts.groupBy("dims", "i", "j").agg(F.sum("value").alias("value")).collect():
        found.setdefault(r["dims"], {})[r["i"], r["j"]] = int(r["value"])
    out = {}
    for dims, values in found.items():
        cross = np.zeros((dims, dims), object)
        for (i, j), value in values.items():
            if i >= 0:
                cross[i, j] = cross[j, i] = value
        out[dims] = (values[-1, -1], np.array([values[-1, j] for j in range(dims)], object), cross)
    return out


class Whitening:
    """Mean, components and variances of one fit list."""

    def __init__(self, n: int, total: np.ndarray, cross: np.ndarray, most: int):
        self.n, self.total = n, total
        centred = n * cross - np.outer(total, total)
        cov = np.array([[int(c) / (n * n) for c in row] for row in centred], np.float64)
        e, u = np.linalg.eigh(cov)
        order = np.argsort(-e, kind="stable")[:most]
        self.e, self.u = e[order], u[:, order]
        self.u = self.u * np.where(self.u[np.abs(self.u).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
        trace = sum(int(centred[i, i]) for i in range(len(total))) / (n * n)
        self.real = self.e > max(e.max(initial=0), 0) * len(total) * np.finfo(float).eps * 4
        self.explained = self.e / trace if trace > 0 else None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in int64 where it and its square's sum fit."""
        top = max(int(np.abs(x).max(initial=0)) * self.n, max(abs(int(t)) for t in self.total)) * 2
        if top < SAFE and top**2 * x.shape[1] < SAFE:
            return x * self.n - self.total.astype(np.int64)
        exact = x.astype(object) * self.n - self.total
        top = max((abs(int(v)) for v in exact.flat), default=0)
        return exact.astype(np.int64) if top**2 * x.shape[1] < SAFE else exact

    def project(self, centred: np.ndarray) -> np.ndarray:
        scale = np.where(self.real, np.sqrt(np.where(self.real, self.e, 1.0)), np.nan)
        return (centred / self.n).astype(np.float64) @ self.u / scale


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """(id, component, n, deviation decimal(38,0), whitened, explained, identity_error) of each vector and component."""
    spark = vectors.sparkSession
    ship(spark)
    fits = {dims: Whitening(*sums, most) for dims, sums in scatter(vectors, vector_col).items()}
    kind = vectors.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not fits:
        return spark.createDataFrame([], shape)
    shared = spark.sparkContext.broadcast(fits)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, entries in matrices(batch, "v", LIMIT):
                w = shared.value[entries.shape[1]]
                z = np.nan_to_num(w.project(w.centred(integers(entries))))
                sums[entries.shape[1]] = sums.get(entries.shape[1], 0) + np.vstack([z.T @ z, z.sum(axis=0)])
        for dims, own in sums.items():
            i, j = np.indices(own.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(own.size, dims, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(own.ravel())], names=["dims", "i", "j", "value"])

    errors = {}
    measured = rows.mapInArrow(moments, "dims int, i int, j int, value double").groupBy("dims", "i", "j").agg(F.sum("value").alias("value")).collect()
    for dims, w in fits.items():
        own = np.zeros((len(w.e) + 1, len(w.e)))
        for r in measured:
            if r["dims"] == dims:
                own[r["i"], r["j"]] = r["value"]
        mean = own[-1] / w.n
        off = (own[:-1] / w.n - np.outer(mean, mean) - np.eye(len(w.e)))[np.ix_(w.real, w.real)]
        errors[dims] = float(np.abs(off).max()) if off.size else None
    told = spark.sparkContext.broadcast(errors)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, entries in matrices(batch, "v", LIMIT):
                w = shared.value[entries.shape[1]]
                centred = w.centred(integers(entries))
                k, m = len(w.e), len(at)
                square = (centred * centred).sum(axis=1)
                deviation = pa.array(square).cast(pa.decimal128(38, 0)) if centred.dtype != object else pa.array([Decimal(int(s)) if s < 10**38 else None for s in square], pa.decimal128(38, 0))
                z = w.project(centred)
                each = pa.array(np.repeat(np.arange(m), k))
                one = lambda v: pa.array(np.tile(v, m)) if v is not None else pa.nulls(m * k, pa.float64())
                error = told.value[entries.shape[1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)).take(each), one(np.arange(1, k + 1, dtype=np.int32)), one(np.full(k, w.n, np.int64)), deviation.take(each), pa.array(z.ravel(), from_pandas=True), one(w.explained), one(None if error is None else np.full(k, error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, shape)


def op11_bitsliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight strongest components of every vector of ``embeddings``.

    ``deviation`` is null where it doesn't fit a long; ``deviation_exact`` has it in any case.
    """
    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))
