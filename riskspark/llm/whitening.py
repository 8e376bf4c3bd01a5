"""Embedding whitening from exact integer cross-products, by bit-sliced scatter.

1. Range: an entry c counts as the whole number x = floor(64 c) + 1000000.  One pass gives the number of vectors and, per dimension, the sum, the least and the greatest x.
2. Scatter: u = x - least needs as many bits as its dimension's range has.  In blocks of rows every bit of every dimension becomes a row of 64-bit words
   (a bit plane across the rows), and sum(u_i * u_j) is the sum over planes a, b of 2^(a+b) * popcount(plane_ia AND plane_jb): whole numbers, so no rounding.
   Tasks give their products per pair of dimensions, Spark adds them up as decimals.
3. Covariance: n * sum(u_i u_j) - sum(u_i) * sum(u_j) is n^2 times the covariance, still a whole number; only then is it a double, and ``eigh`` gives the components.
4. Every row is projected, and its squared deviation (n * x - S)^2 summed as whole numbers.

What the driver holds is d x d numbers for d dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: x = floor(SCALE * c) + SHIFT; entries beyond 2^MOST count as that, so that x stays a whole number of 64 bits.
SCALE, SHIFT, MOST = 64.0, 1_000_000, 50
#: Rows that are sliced to planes at once.
ROWS = 16_384
#: Components below this share of the largest eigenvalue have no variance to scale by.
LEAST = 1e-13
#: Partial sums of the check are added as whole multiples of this, so that a rerun gives the same number.
UNIT = 2.0**-40


def usable(vector: str) -> Column:
    """Whether a vector is not null and holds neither nulls nor non-finite entries."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """x per row and dimension; a vector shorter than ``width`` goes on with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    if len(values) == out.size and (sizes == width).all():
        out = values.reshape(out.shape)
    else:
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return np.floor(np.clip(SCALE * out, -(2.0**MOST), 2.0**MOST)).astype(np.int64) + SHIFT


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim, n, total, least, most of each batch; -1 is the row of the widths."""
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            column = batch.column("vector").slice(a, ROWS)
            width = int(column.value_lengths().to_numpy(zero_copy_only=False).max(initial=0))
            x = whole_numbers(column, width)
            # A shorter vector has x = SHIFT in the dimensions that only others have.
            total = [(int(hi) << 20) + int(lo) for hi, lo in zip((x >> 20).sum(0), (x & 0xFFFFF).sum(0), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(width)], pa.int32()), pa.array([len(x)] * (width + 1), pa.int64()), pa.array(["0", *map(str, total)]), pa.array([width, *x.min(0).tolist()], pa.int64()), pa.array([width, *x.max(0).tolist()], pa.int64())], ["dim", "n", "total", "least", "most"])


def planes(u: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of a block of rows: one row of 64-bit words per dimension and bit, lowest bit first."""
    packed = np.zeros((sum(bits), -(-len(u) // 64) * 8), np.uint8)
    at = 0
    for i, n in enumerate(bits):
        for a in range(n):
            row = np.packbits((u[:, i] >> a) & 1 == 1)
            packed[at, : len(row)] = row
            at += 1
    return packed.view(np.uint64)


def cross_products(u: np.ndarray, bits: list[int]) -> np.ndarray:
    """sum(u_i * u_j) over the rows for i <= j, as Python whole numbers."""
    words, d = planes(u, bits), len(bits)
    dim = np.repeat(np.arange(d), bits)
    weight = np.array([1 << a for n in bits for a in range(n)], object)
    starts = np.concatenate([[0], np.cumsum(bits)])
    out = np.zeros((d, d), object)
    for k in range(len(words)):
        first = int(starts[dim[k]])
        counts = np.bitwise_count(words[first:] & words[k]).sum(1, dtype=np.int64)
        for_dims = np.add.reduceat(counts * weight[first:], np.unique(dim[first:], return_index=True)[1])
        out[dim[k], np.unique(dim[first:])] += for_dims * weight[k]
    return out


def _scatter(batches: Iterable[pa.RecordBatch], least: list[int], bits: list[int]) -> Iterator[pa.RecordBatch]:
    """i, j, product of a task's rows."""
    total, low = None, np.array(least, np.int64)
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            found = cross_products(whole_numbers(batch.column("vector").slice(a, ROWS), len(least)) - low, bits)
            total = found if total is None else total + found
    if total is not None:
        i, j = np.triu_indices(len(least))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(x) for x in total[i, j]])], ["i", "j", "product"])


@dataclass
class Whitening:
    """What projects a vector: counts, sums, eigenvalues and components (columns of ``axes``), and the whole covariance."""

    n: int
    sums: list[int]
    least: list[int]
    most: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @property
    def narrow(self) -> bool:
        """Whether every squared deviation fits 63 bits."""
        return sum(max(self.n * hi - s, s - self.n * lo) ** 2 for lo, hi, s in zip(self.least, self.most, self.sums, strict=True)) < 1 << 63

    def project(self, x: np.ndarray, count: int) -> tuple[list[int], np.ndarray]:
        """Squared deviations times n^2, and whitened coordinates (NaN where a component has no variance)."""
        if self.narrow:
            off = self.n * x - np.array(self.sums, np.int64)
            deviation = (off * off).sum(1).tolist()
        else:
            off = self.n * x.astype(object) - np.array(self.sums, object)
            deviation = (off * off).sum(1).tolist()
        some = self.values > LEAST * max(self.values[0], 0.0)
        scale = np.where(some, np.sqrt(np.where(some, self.values, 1.0)), np.nan)
        return deviation, ((off.astype(np.float64) / self.n) @ self.axes / scale)[:, :count]


def fit(vectors: DataFrame) -> Whitening | None:
    """Range, scatter and components over all rows of ``vector``; None without a row or a dimension."""
    ranges = vectors.mapInArrow(_ranges, "dim int, n long, total string, least long, most long").groupBy("dim")
    rows = ranges.agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("least").alias("least"), F.max("most").alias("most")).collect()  # one row per dimension
    found = {r["dim"]: r for r in rows}
    if not found or not found[-1]["most"]:
        return None
    n, width = found[-1]["n"], found[-1]["most"]
    # Rows of batches whose vectors are all shorter count with x = SHIFT.
    rest = [n - found[k]["n"] for k in range(width)]
    sums = [int(found[k]["total"]) + rest[k] * SHIFT for k in range(width)]
    least = [min(found[k]["least"], SHIFT) if rest[k] else found[k]["least"] for k in range(width)]
    most = [max(found[k]["most"], SHIFT) if rest[k] else found[k]["most"] for k in range(width)]
    bits = [max(1, (hi - lo).bit_length()) for lo, hi in zip(least, most, strict=True)]
    products = vectors.mapInArrow(lambda batches: _scatter(batches, least, bits), "i int, j int, product string").groupBy("i", "j").agg(F.sum(F.col("product").cast("decimal(38,0)")).alias("product")).collect()  # one row per pair of dimensions
    shifted = [s - n * lo for s, lo in zip(sums, least, strict=True)]
    v = np.zeros((width, width))
    for r in products:
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = (n * int(r["product"]) - shifted[r["i"]] * shifted[r["j"]]) / (n * n)
    values, axes = np.linalg.eigh(v)
    values, axes = np.maximum(values[::-1], 0.0), axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(width)] < 0, -1.0, 1.0)
    return Whitening(n, sums, least, most, values, axes, float(np.trace(v)))


def _moments(batches: Iterable[pa.RecordBatch], model: Whitening, count: int) -> Iterator[pa.RecordBatch]:
    """i, j, moment: a task's sums of w_i (j = -1) and of w_i * w_j, as multiples of UNIT."""
    total = None
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            _, w = model.project(whole_numbers(batch.column("vector").slice(a, ROWS), len(model.least)), count)
            found = np.hstack([w.sum(0)[:, None], w.T @ w])
            total = found if total is None else total + found
    if total is not None:
        i, j = np.indices(total.shape)
        good = np.isfinite(total)
        yield pa.RecordBatch.from_arrays([pa.array(i[good], pa.int32()), pa.array(j[good] - 1, pa.int32()), pa.array([str(int(round(x / UNIT))) for x in total[good]])], ["i", "j", "moment"])


def identity_error(vectors: DataFrame, model: Whitening, count: int) -> float:
    """Largest absolute entry of (covariance of the whitened vectors - identity) over the components with variance, measured on all rows."""
    rows = vectors.mapInArrow(lambda batches: _moments(batches, model, count), "i int, j int, moment string").groupBy("i", "j").agg(F.sum(F.col("moment").cast("decimal(38,0)")).alias("m")).collect()  # count^2 rows
    m = {(r["i"], r["j"]): int(r["m"]) * UNIT / model.n for r in rows}
    return max((abs(x - m[i, -1] * m[j, -1] - (i == j)) for (i, j), x in m.items() if j >= 0), default=0.0)


def _project(batches: Iterable[pa.RecordBatch], model: Whitening, count: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            deviation, w = model.project(whole_numbers(part.column("vector"), len(model.least)), count)
            values = pa.array(w.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), values)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([str(x) for x in deviation]), lists], ["id", "deviation", "whitened"])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = 32) -> DataFrame:
    """One row per usable vector: ``id, n, deviation`` (decimal), ``whitened`` (array, the first ``count`` components), ``explained`` (array), ``identity_error``.

    Rows whose vector is null or holds a null or a non-finite entry are left out.  A vector that is shorter than the longest one goes on with zeros; an
    empty one is all zeros.  Every row counts, so repeated rows and ids (null ones too) weigh as often as they occur.  A component without variance
    (more components than rows, constant dimensions) has null in ``whitened`` and 0 in ``explained``; where eigenvalues tie, their components are any basis of
    their space, the same for all rows.  Of a component's two signs the one with its largest entry positive is taken.  A table without usable rows gives no rows.
    Texts do not occur; only the two named columns are read, so others may have any name.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(usable("vector"))
    model = fit(rows.select("vector"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, deviation string, whitened array<double>"
    if model is None:
        found = spark.createDataFrame([], schema)
        n, explained, error = 0, F.array().cast("array<double>"), 0.0
    else:
        count = min(count, len(model.least))
        n, error = model.n, identity_error(rows.select("vector"), model, count)
        explained = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else 0.0) for e in model.values[:count]])
        found = rows.mapInArrow(lambda batches: _project(batches, model, count), schema)
    return found.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector and component; a deviation beyond 63 bits is null."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = found.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "explained", "identity_error", F.posexplode("whitened").alias("k", "whitened"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("k") + 1).alias("explained"), "identity_error")
