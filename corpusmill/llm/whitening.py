"""Whitening of embeddings on the multiset of their vectors: every different vector is worked on once, weighted by its rows.

Rows with the same vector are one group, found by a digest of the whole numbers; a group is one row after the map side,
however many rows it has. Sums are taken in whole numbers, so they are exact. Each partition multiplies its centred vectors
with themselves, weighted by the counts (or by one), and the products are added cell by cell in a shuffle: what reaches the
driver is one matrix, of dimensions squared numbers. The whitened vectors of the groups are then joined to the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

from .common import keyed_join

#: Whole numbers are SCALE times an entry, rounded down, plus OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Components whose share of the variance is not above this have no direction of their own: rounding alone decides it.
LEAST_SHARE = 1e-13
#: Vectors worked on at once.
_ROWS = 4096


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and entries (double) of the vectors of a batch without null vectors; null entries become NaN."""
    vectors = batch.column("v")
    lengths = np.diff(vectors.offsets.to_numpy())
    return lengths, vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for full in batches:
        for start in range(0, full.num_rows, _ROWS):
            batch = full.slice(start, _ROWS).filter(full.slice(start, _ROWS).column("v").is_valid())
            if not batch.num_rows:
                continue
            lengths, entries = _entries(batch)
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
            good = np.flatnonzero(bad[ends] == bad[ends - lengths])
            with np.errstate(invalid="ignore"):
                x = np.floor(SCALE * entries)
            x = np.where(np.isfinite(x), x, 0.0).astype(np.int64) + OFFSET
            xs = [x[ends[i] - lengths[i] : ends[i]].tobytes() for i in good.tolist()]
            keys = [hashlib.blake2b(b, digest_size=16).digest() for b in xs]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(good)), pa.array(keys, pa.binary()), pa.array(xs, pa.binary())], names=["id", "key", "x"])


def groups(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows (id, key) and groups (key, x, n): x holds whole numbers of 64 bits, n says how many rows have them.

    Rows whose vector is null or has an entry that is null, infinite or no number are left out.
    """
    read = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = read.schema["id"].dataType.simpleString()
    whole = cut_lineage(read.mapInArrow(_whole, f"id {kind}, key binary, x binary"))
    found = whole.groupBy("key", "x").agg(F.count("*").alias("n"))
    return whole.select("id", "key"), cut_lineage(found)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers; a shorter vector goes on with entries of zero."""
    out = np.full((batch.num_rows, width), OFFSET, np.int64)
    for i, x in enumerate(batch.column("x")):
        one = np.frombuffer(x.as_buffer(), np.int64)
        out[i, : len(one)] = one
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            yield batch.slice(start, _ROWS)


def _added(rows: DataFrame, size: int, kind: str, partial) -> list:
    """Cells 0 to `size` - 1 of what `partial` makes of the batches of each partition, added over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(_parts(batches))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["cell", "v"])

    out = [0] * size
    for cell, value in rows.mapInArrow(run, f"cell int, v {kind}").groupBy("cell").agg(F.sum("v")).collect():
        out[cell] = value
    return out


@dataclass(frozen=True)
class Fit:
    """n vectors with sums S by dimension; eigenvalues and unit eigenvectors (columns) of the covariance, largest first."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n. n x - S is exact while it stays below 2^63, as it does up to about 10^11 vectors of entries up to 10^5."""
        return (x * self.n - np.array(self.sums, np.int64)) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null if it needs more than 63 bits."""
        apart = x * self.n - np.array(self.sums, np.int64)
        if np.abs(apart).max(initial=0) < (1 << 31) / max(1, apart.shape[1]) ** 0.5:
            return (apart * apart).sum(axis=1).tolist()
        exact = (apart.astype(object) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _gram(parts: Iterator[pa.RecordBatch], rows_of, weighted: bool) -> np.ndarray | None:
    total = None
    for batch in parts:
        if batch.num_rows:
            z = rows_of(batch)
            w = batch.column("n").to_numpy().astype(np.float64) if weighted else np.ones(len(z))
            product = (z * w[:, None]).T @ z
            total = product if total is None else total + product
    return None if total is None else total.ravel()


def fit(found: DataFrame, components: int = COMPONENTS, weighted: bool = True) -> Fit | None:
    """The fit for groups (key, x, n), weighted by n or by one; None without vectors."""
    width = (found.agg(F.max(F.octet_length("x"))).first()[0] or 0) // 8
    if not width:
        return None

    def summed(parts: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in parts:
            if batch.num_rows:
                w = batch.column("n").to_numpy() if weighted else np.ones(batch.num_rows, np.int64)
                row = np.append(w @ _matrix(batch, width), w.sum())
                total = row if total is None else total + row
        return total

    *sums, n = map(int, _added(found.select("x", "n"), width + 1, "long", summed))
    plain = Fit(n, sums, np.ones(0), np.zeros((width, 0)), 0.0)
    cells = _added(found.select("x", "n"), width * width, "double", lambda parts: _gram(parts, lambda b: plain.centred(_matrix(b, width)), weighted))
    covariance = np.array(cells, float).reshape(width, width) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors, trace = values[::-1], vectors[:, ::-1], float(np.trace(covariance))
    kept = min(components, int((values > LEAST_SHARE * trace).sum()))
    vectors = vectors[:, :kept]
    # Either sign is an eigenvector: the largest entry is made positive.
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)]) if kept else np.ones(0)
    return Fit(n, sums, values[:kept], vectors * signs, trace)


def _identity_error(done: DataFrame, model: Fit, weighted: bool) -> float:
    """Largest entry of the covariance of the whitened vectors minus the identity."""
    k = len(model.values)
    z_of = lambda batch: batch.column("z").flatten().to_numpy().reshape(-1, k)

    def summed(parts: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in parts:
            if batch.num_rows:
                w = batch.column("n").to_numpy() if weighted else np.ones(batch.num_rows)
                total = w @ z_of(batch) + (0 if total is None else total)
        return total

    rows = done.select("z", "n")
    mean = np.array(_added(rows, k, "double", summed), float) / model.n
    cells = _added(rows, k * k, "double", lambda parts: _gram(parts, lambda b: z_of(b) - mean, weighted))
    return float(np.abs(np.array(cells, float).reshape(k, k) / model.n - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weighted: bool = True) -> tuple[DataFrame, Fit | None, float]:
    """Rows (vec_id, deviation, z), the fit and the largest error of the whitened covariance against the identity.

    z has one number a component, largest eigenvalue first; components without variance are left out, so z can be
    shorter than `components`, and empty if all vectors are equal. `weighted`: a vector counts as often as rows have it, or once.

    Rows with a null vector or a null, infinite or undefined entry are left out. A vector shorter than the longest one goes on
    with zeros. Null and repeated ids stay, each row by itself. Other columns are ignored, whatever their names. Empty
    table, or none but empty vectors: no rows, no fit.
    """
    rows, found = groups(vectors, id_column, vector)
    kind = rows.schema["id"].dataType.simpleString()
    model = fit(found, components, weighted)
    if model is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, deviation long, z array<double>"), None, 0.0
    width = len(model.sums)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            x = _matrix(batch, width)
            yield pa.RecordBatch.from_arrays([
                batch.column("key"), batch.column("n"), pa.array(model.deviation(x), pa.int64()),
                pa.array(list(model.whitened(x)), pa.list_(pa.float64())),
            ], names=["key", "n", "deviation", "z"])

    done = cut_lineage(found.mapInArrow(work, "key binary, n long, deviation long, z array<double>"))
    error = _identity_error(done, model, weighted) if len(model.values) else 0.0
    joined = keyed_join(rows, done.withColumnRenamed("n", "_n"), "key", "_n", rows.count())
    return joined.select(F.col("id").alias("vec_id"), "deviation", "z"), model, error
