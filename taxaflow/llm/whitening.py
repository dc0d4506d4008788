"""Whitening of vectors by their leading principal components, found by matrix-free block Lanczos.

A vector c becomes whole numbers x = floor(256 * c). The fit list holds each distinct x once. Its covariance V is never formed:
a pass over the fit list gives V q for a block of BLOCK vectors q as the sum of (x - S/n) ((x - S/n)' q) / n, centred before it is
multiplied; partitions add up theirs and Spark adds those up by entry, so the driver gets one d x BLOCK matrix a pass.

Each new block is orthogonalised twice against the whole basis. Where a block's image adds fewer directions than it has columns (a
breakdown) the rest are random ones outside the basis, a restart. The basis is complete, or good enough, when each wanted Ritz
pair has a residual of at most TOLERANCE of the largest eigenvalue, and, after a breakdown, when a restart has found nothing
more. The driver holds the basis, at most d vectors of d entries, and as many images.

The trace comes from the rows' deviations, so explained shares need no further eigenvalue. Two more passes measure the covariance
of the whitened fit list against the identity.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped. Vectors of each length have a fit of their own.
Null and repeated ids stay. A length has as many components as its V has eigenvalues above rounding, so constant vectors
give no row. Entries of 2**53 or more in size count as 2**53. An empty table gives an empty result; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import Workspace, bound_batches

#: Vectors of a block, and the residual of a Ritz pair, as a part of the largest eigenvalue, that ends the passes.
BLOCK, TOLERANCE = 16, 1e-14
#: Steps of the lattice that vectors are put on, for each unit; largest entry.
STEPS, LARGEST = 256.0, float(1 << 53)


@dataclass(frozen=True)
class Fit:
    """What whitening vectors of one length takes: rows of the fit list, their sums, components (columns) and eigenvalues."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.components / np.sqrt(self.eigenvalues)


def lattice(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x as whole numbers) of the vectors that take part, for each length."""
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    of = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.zeros(len(lengths), bool)
    bad[of[~np.isfinite(flat)]] = True
    for d in np.unique(lengths[(lengths > 0) & ~bad]).tolist():
        takes = (lengths == d) & ~bad
        yield np.flatnonzero(takes), np.floor(STEPS * np.clip(flat[takes[of]], -LARGEST, LARGEST)).astype(np.int64).reshape(-1, d)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return x - np.array([s / n for s in sums])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sum over dimensions of (n * x - S) ** 2 for each row."""
    wide = int(np.abs(x).max(initial=0)) * max(int(np.abs(x).max(initial=0)), max(map(abs, sums))) * len(sums) >= 1 << 62
    x = x.astype(object) if wide else x
    s = np.array(sums, object if wide else np.int64)
    total = sum(v * v for v in sums)
    return [n * n * int(a) - 2 * n * int(b) + total for a, b in zip((x * x).sum(1), (x * s).sum(1))]


def added(fit: DataFrame, fn: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> list:
    """The sum of fn(x) over all rows (x), entry by entry: partitions first, then Spark. exact: whole numbers of any size."""
    kind = pa.decimal128(38, 0) if exact else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = fn(matrix(batch.column(0))).ravel()
                total = part if total is None else total + part
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], kind) if exact else pa.array(total, kind)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), values], names=["at", "value"])

    parts = fit.select("x").mapInArrow(run, f"at int, value {'decimal(38,0)' if exact else 'double'}")
    found = parts.groupBy("at").agg(F.sum("value").alias("value")).collect()
    return [r.value for r in sorted(found, key=lambda r: r["at"])]


def matrix(x: pa.Array) -> np.ndarray:
    """Rows that all have one length."""
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def beyond(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """What the block has outside the basis."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def lanczos(image: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns), the k largest first, of the symmetric d x d matrix that image() multiplies by."""
    rng = np.random.default_rng(7)
    newest = np.linalg.qr(rng.standard_normal((d, min(block, d))))[0]
    basis, images, restarted = np.zeros((d, 0)), np.zeros((d, 0)), False
    while True:
        basis, images = np.hstack([basis, newest]), np.hstack([images, image(newest)])
        small = basis.T @ images
        values, within = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:k]
        values, within = values[order], within[:, order]
        scale = max(np.abs(values).max(initial=0), np.finfo(float).tiny)
        rest = beyond(basis, images[:, -newest.shape[1] :])
        residuals = np.linalg.norm(images @ within - basis @ within * values, axis=0)
        room = d - basis.shape[1]
        left, size, _ = np.linalg.svd(rest, full_matrices=False)
        fresh = left[:, size > 1e-13 * scale][:, :room]
        broken = fresh.shape[1] < min(newest.shape[1], room)
        if room == 0 or (basis.shape[1] >= k and (residuals <= tolerance * scale).all() and (restarted or not broken)):
            vectors = np.linalg.qr(basis @ within)[0]
            return values, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
        fresh = beyond(basis, fresh)
        if broken:  # go on with directions that the images do not reach
            more = beyond(np.hstack([basis, fresh]), rng.standard_normal((d, min(block, room) - fresh.shape[1])))
            fresh = np.hstack([fresh, more])
        newest, restarted = np.linalg.qr(fresh)[0], broken


def fit_length(fit: DataFrame, n: int, d: int, k: int) -> Fit:
    """The fit of n distinct rows x of length d."""
    sums = [int(v) for v in added(fit, lambda x: x.astype(object).sum(0) if np.abs(x).max() * float(len(x)) >= 1 << 62 else x.sum(0), exact=True)]

    def image(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return np.array(added(fit, part)).reshape(q.shape) / n

    values, vectors = lanczos(image, d, k)
    real = values > d * np.finfo(float).eps * max(values[0], 0)
    values, vectors = values[real], vectors[:, real]
    plain = Fit(n, sums, vectors, values, 1.0, 0.0)
    first = added(fit, lambda x: np.append(plain.whitened(x).sum(0), sum(deviations(x, n, sums)) / n**3))
    mean = np.array(first[:-1]) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = plain.whitened(x) - mean
        return w.T @ w

    covariance = np.array(added(fit, spread)).reshape(len(values), len(values)) / n
    return Fit(n, sums, vectors, values, first[-1], float(np.abs(covariance - np.eye(len(values))).max(initial=0)))


def whiten(df: DataFrame, k: int = 4, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id_column, component (from 1), n, deviation decimal(38,0), whitened, explained, identity_error: a row for each vector and component."""
    spark = df.sparkSession
    bound_batches(spark)
    ws = Workspace(spark, "whitening")
    vector = F.col(vector_column).cast("array<double>").alias("v")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in lattice(batch.column(0)):
                d = x.shape[1]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * d, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d), pa.int32()), rows], names=["d", "x"])

    distinct = ws.write(df.select(vector).mapInArrow(listed, "d int, x array<bigint>").distinct())
    counts = {r.d: r["count"] for r in distinct.groupBy("d").count().collect()}  # one row for each length
    fits = {d: fit_length(distinct.where(F.col("d") == d), n, d, min(k, d)) for d, n in sorted(counts.items())}
    ws.drop_all_but()
    made = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    out = StructType(df.select(id_column).schema.fields + _parse_datatype_string(made).fields)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in lattice(batch.column(1)):
                fit = fits[x.shape[1]]
                m = len(fit.eigenvalues)
                if not m:
                    continue
                again = lambda values: np.repeat(values, m)
                each = lambda values: np.tile(values, len(x))
                deviation = [Decimal(v) for v in deviations(x, fit.n, fit.sums) for _ in range(m)]
                columns = [
                    batch.column(0).take(pa.array(again(places))), pa.array(each(np.arange(1, m + 1, dtype=np.int32))), pa.array(np.full(m * len(x), fit.n)), pa.array(deviation, pa.decimal128(38, 0)),
                    pa.array(fit.whitened(x).ravel()), pa.array(each(fit.eigenvalues / fit.trace)), pa.array(np.full(m * len(x), fit.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return df.select(F.col(id_column), vector).mapInArrow(projected, out)
