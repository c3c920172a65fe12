"""Whitening of embeddings along their leading principal components.

Sums, moments and the check of the result are each one pass over the distinct vectors, in which a task adds up what it reads and
emits one row a vector length (large matrices in bands of rows); only matrices of the vectors' own side reach the driver,
which finds the eigenvectors by spectrum slicing. Entries are whole numbers. Moments are taken around the means rounded to whole numbers, so
they add up exactly while they stay below 2**53, in any order; what was rounded off the means, at most a half, is then taken out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.common import bounded_batches, finite, query, table
from newsloom.llm.spectrum import leading
from newsloom.session import cut_lineage

#: Rows of a matrix that travel together.
BAND = 64
#: Of the largest eigenvalue: a component of less variance is taken for none.
NOTHING = 1e-12
#: An entry of this size cannot be told from one next to it once scaled; it counts as not finite.
LARGEST = float(2**36)


@dataclass
class Fit:
    """Of vectors of one length: rows fitted to, whole centre, what was rounded off the mean (times n), components as columns, their variances."""

    n: int
    centre: np.ndarray
    rest: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre).astype(float) - np.array(self.rest, float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.variances))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)**2, exact; None beyond the largest long."""
        z = x - self.centre
        largest = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, self.rest), default=0)
        if largest**2 * len(self.rest) < 2**63:
            return ((self.n * z - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((self.n * c - r) ** 2 for c, r in zip(row, self.rest)) for row in z.tolist()]
        return [e if e < 2**63 else None for e in exact]


def _lengths(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of the batch's last column."""
    vectors = batch.column(batch.num_columns - 1)
    sizes = np.asarray(vectors.value_lengths())
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, np.asarray(vectors.take(pa.array(rows)).flatten()).reshape(-1, size)


def whole(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """vec_id and x = floor(scale * c) + shift of the rows that take part."""
    fit = finite(F.col("embedding")) & (F.size("embedding") > 0) & F.forall("embedding", lambda c: F.abs(c) < LARGEST)
    x = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift).cast("bigint"))
    return vectors.select("vec_id", "embedding").filter(fit).select("vec_id", x.alias("x"))


def column_sums(points: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: the number of vectors and the exact sum of each entry."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for size, rows, x in _lengths(batch):
                n, total = sums.get(size, (0, np.zeros(size, object)))
                sums[size] = n + len(rows), total + x.sum(0).astype(object)
        columns = [pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64())]
        columns.append(pa.array([[str(v) for v in s[1]] for s in sums.values()], pa.list_(pa.string())))
        yield pa.RecordBatch.from_arrays(columns, ["size", "n", "sums"])

    rows = points.select("x").mapInArrow(add, "size int, n bigint, sums array<string>")
    parts = rows.select("size", "n", F.posexplode("sums").alias("pos", "sum"))
    summed = parts.groupBy("size", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
    found: dict[int, tuple[int, list[int]]] = {}
    for r in summed:
        found.setdefault(r["size"], (r["n"], [0] * r["size"]))[1][r["pos"]] = int(r["sum"])
    return found


def matrices(points: DataFrame, rows_of: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """By length: the sum of outer products of the rows that ``rows_of`` (length, vectors) gives, over all vectors."""

    def banded(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in sums], pa.int32()) for i in range(2)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["size", "band", "part"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, x in _lengths(batch):
                rows = rows_of(size, x)
                sums[size] = sums.get(size, 0) + rows.T @ rows
        for size, total in sums.items():
            for band in range(0, len(total), BAND):
                yield banded({(size, band): total[band : band + BAND]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for size, band, part in zip(*(batch.column(k).to_pylist() for k in range(3))):
                sums[size, band] = sums.get((size, band), 0) + np.frombuffer(part)
        for key, total in sums.items():
            yield banded({key: total})

    schema = "size int, band int, part binary"
    parts = points.select("x").mapInArrow(multiply, schema)
    found: dict[int, list] = {}
    for r in parts.repartition("size", "band").mapInArrow(add, schema).collect():
        found.setdefault(r["size"], []).append((r["band"], np.frombuffer(r["part"])))
    out = {}
    for size, bands in found.items():
        flat = np.concatenate([part for _, part in sorted(bands, key=lambda b: b[0])])
        out[size] = flat.reshape(int(round(len(flat) ** 0.5)), -1)
    return out


def fit(points: DataFrame, most: int) -> dict[int, Fit]:
    """The whitening of each length of ``points`` (x: distinct vectors of whole numbers)."""
    sums = column_sums(points)
    centres = {size: np.array([(2 * s + n) // (2 * n) for s in total], np.int64) for size, (n, total) in sums.items()}
    moments = matrices(points, lambda size, x: (x - centres[size]).astype(float))
    fits = {}
    for size, (n, total) in sums.items():
        rest = [s - n * int(c) for s, c in zip(total, centres[size])]
        off = np.array(rest, float) / n
        covariance = moments[size] / n - np.outer(off, off)
        values, vectors = leading(covariance, most)
        kept = values > NOTHING * max(values.max(initial=0), 0)
        fits[size] = Fit(n, centres[size], rest, vectors[:, kept], values[kept], float(np.trace(covariance)))
    # Of the whitened vectors and a 1 beside them, so that their mean is there too.
    squares = matrices(points, lambda size, x: np.hstack([fits[size].whitened(x), np.ones((len(x), 1))]))
    for size, f in fits.items():
        mean = squares[size][-1, :-1] / f.n
        left = squares[size][:-1, :-1] / f.n - np.outer(mean, mean) - np.eye(len(mean))
        f.error = float(np.abs(left).max(initial=0))
    return fits


def whiten(vectors: DataFrame, most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row per row of ``vectors`` (vec_id, embedding; other columns are ignored) and component.

    Returns vec_id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error. The fit list is each distinct
    vector x = floor(scale * c) + shift once, n its length; a component is a unit eigenvector of its covariance.

    A row takes no part if its vector is null or empty or has an entry that is null, not finite or 2**36 or more in size. Vectors of
    different lengths are fitted apart. A component without variance (under 1e-12 of the largest) is left out, so equal vectors, or a
    single one, give no rows, nor does an empty table. A null vec_id is kept; rows that repeat are whitened alike and fitted to
    once. A deviation beyond the largest long is null.
    """
    rows = whole(bounded_batches(vectors), scale, shift)
    fits = fit(cut_lineage(rows.select("x").distinct()), most)
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in _lengths(batch):
                f = fits[size]
                if not (k := len(f.variances)):
                    continue
                each, count = np.repeat(np.arange(len(at)), k), len(at) * k
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(count, f.n)),
                    pa.array(f.deviation(x), pa.int64()).take(pa.array(each)), pa.array(f.whitened(x).reshape(-1)),
                    pa.array(np.tile(f.variances / f.trace, len(at))), pa.array(np.full(count, f.error)),
                ], columns)

    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(project, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


@query("op13_whitening")
def op13_whitening(spark, folder):
    return whiten(table(spark, folder, "embeddings", "vec_id", "embedding"))
