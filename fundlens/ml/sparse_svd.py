"""Truncated SVD of sparse text features: TF-IDF over 2^16 or more hashed words, by a randomised range finder.

A row is (columns, values); no dense matrix of rows x columns exists anywhere. Two passes over the rows:

1. the sketch Y = A G with a Gaussian matrix G whose rows are drawn from the column's number where they are needed;
   only Y'Y, a matrix of ``dim + MORE`` squared, is added up;
2. B = Q'A for the orthonormal basis Q of Y, one short vector per column, added up by column.

The SVD of B gives singular values and right directions: ``width`` x ``dim`` numbers, a size fixed by parameters,
which travel to the tasks that project rows. Results do not depend on how rows are dealt, but for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from fundlens.session import materialize
from fundlens.text.tokens import words

WIDTH = 1 << 16
MORE = 10
ROWS = 1024  # rows of a block
VALUES = 1 << 19  # most words or columns of a block of more than one row
DRAWN = 4096  # columns whose Gaussian rows are drawn at a time
SEED = 5


@dataclass(frozen=True)
class SparseBasis:
    """Inverse document frequencies by column, singular values, right directions (column x component)."""

    idf: np.ndarray
    values: np.ndarray
    right: np.ndarray


def gaussian_rows(columns: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The rows of the Gaussian matrix that belong to ``columns``: a fixed function of (seed, column, place)."""
    if len(columns) > DRAWN:
        return np.concatenate([gaussian_rows(columns[at : at + DRAWN], k, seed) for at in range(0, len(columns), DRAWN)])
    with np.errstate(over="ignore"):
        at = (columns[:, None].astype(np.uint64) * np.uint64(2 * k) + np.arange(2 * k, dtype=np.uint64)) + np.uint64(seed << 40)
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            at = (at ^ (at >> np.uint64(shift))) * np.uint64(odd)
    even = ((at ^ (at >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.sqrt(-2 * np.log1p(-even[:, :k])) * np.cos(2 * np.pi * even[:, k:])


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``ROWS`` rows and ``VALUES`` elements of a list column at most, or one longer row."""
    for batch in batches:
        ends = np.cumsum(batch.column(column).value_lengths().to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + VALUES, side="right")), start + 1)
            stop = min(stop, start + ROWS, batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, place in ``used``, value, used columns, rows) of blocks of sparse rows."""
    for part in _slices(batches, "columns"):
        size = part.column("columns").value_lengths().to_numpy(zero_copy_only=False)
        used, place = np.unique(part.column("columns").flatten().to_numpy(), return_inverse=True)
        yield np.repeat(np.arange(part.num_rows), size), place, part.column("values").flatten().to_numpy(), used, part.num_rows


def _times(row: np.ndarray, place: np.ndarray, value: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    """Sparse block times a dense matrix, one column of it at a time."""
    return np.stack([np.bincount(row, weights=value * dense[place, c], minlength=n) for c in range(dense.shape[1])], axis=1)


def _added(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and sums of the vectors ``v`` by ``i``."""
    sums = parts.select("i", array_to_vector("v").alias("v")).groupBy("i").agg(Summarizer.sum(F.col("v")).alias("v"))
    found = sums.orderBy("i").collect()
    return np.array([r.i for r in found], dtype=np.int64), np.array([r.v.toArray() for r in found])


def directions(rows: DataFrame, width: int, dim: int, more: int = MORE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right directions) of the sparse ``rows`` (columns array<int>, values array<double>)."""
    k = min(dim + more, width)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for row, place, value, used, n in _blocks(batches):
            sketch = _times(row, place, value, gaussian_rows(used, k, seed), n)
            total += sketch.T @ sketch
        yield pa.RecordBatch.from_pydict({"i": np.arange(k, dtype=np.int32), "v": list(total)})

    rows = rows.select("columns", "values")
    _, square = _added(rows.mapInArrow(gram, "i int, v array<double>"))
    size, turn = np.linalg.eigh(square) if len(square) else (np.zeros(0), np.zeros((k, 0)))
    good = size > size.max(initial=0) * 1e-12
    whiten = turn[:, good] / np.sqrt(size[good])
    right = np.zeros((width, dim))
    if not good.any():
        return np.zeros(dim), right

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for row, place, value, used, n in _blocks(batches):
            basis = _times(row, place, value, gaussian_rows(used, k, seed), n) @ whiten
            part = _times(place, row, value, basis, len(used))
            for column, v in zip(used.tolist(), part, strict=True):
                held[column] = held[column] + v if column in held else v
        if held:
            yield pa.RecordBatch.from_pydict({"i": np.fromiter(held, dtype=np.int32, count=len(held)), "v": list(held.values())})

    columns, small = _added(rows.mapInArrow(project, "i int, v array<double>"))
    left, values, _ = np.linalg.svd(small, full_matrices=False)
    found = min(dim, len(values))
    right[columns, :found] = left[:, :found]
    return np.concatenate([values[:found], np.zeros(dim - found)]), right


def hashed(text: str | Column, width: int = WIDTH) -> Column:
    """The columns of the index words of a text, repeats included."""
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))


def _count(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches with the sorted distinct ``columns`` and their ``counts`` in place of the hashed words ``_h``."""
    for batch in _slices(batches, "_h"):
        listed = batch.column("_h")
        row = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
        key, n = np.unique(row * width + listed.flatten().to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * width).astype(np.int32))
        found = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in ((key % width).astype(np.int32), n.astype(np.float64))]
        rest = batch.drop_columns(["_h"])
        yield pa.RecordBatch.from_arrays([*rest.columns, *found], names=[*rest.schema.names, "columns", "counts"])


def _weigh(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches with ``values`` in place of ``counts``: counts times idf, of length one."""
    for batch in _slices(batches, "columns"):
        columns, counts = batch.column("columns"), batch.column("counts")
        size = columns.value_lengths().to_numpy(zero_copy_only=False)
        value = counts.flatten().to_numpy() * idf[columns.flatten().to_numpy()]
        row = np.repeat(np.arange(batch.num_rows), size)
        length = np.sqrt(np.bincount(row, weights=value**2, minlength=batch.num_rows))
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(value / np.where(length > 0, length, 1)[row]))
        rest = batch.drop_columns(["counts"])
        yield pa.RecordBatch.from_arrays([*rest.columns, values], names=[*rest.schema.names, "values"])


def _listed(text: str, width: int) -> Column:
    """The hashed words of a text; a null text has none."""
    return F.coalesce(hashed(text, width), F.array().cast("array<int>")).alias("_h")


def _counted(df: DataFrame, text: str, width: int) -> DataFrame:
    """(columns, counts) of a text column."""
    return df.select(_listed(text, width)).mapInArrow(lambda batches: _count(batches, width), "columns array<int>, counts array<double>")


def _weighted(counted: DataFrame, idf: np.ndarray) -> DataFrame:
    """(columns, values) of (columns, counts)."""
    held = counted.sparkSession.sparkContext.broadcast(idf)
    return counted.mapInArrow(lambda batches: _weigh(batches, held.value), "columns array<int>, values array<double>")


def fit_sparse_basis(df: DataFrame, text: str, dim: int = 50, width: int = WIDTH, more: int = MORE, seed: int = SEED) -> SparseBasis:
    """The leading ``dim`` directions of the TF-IDF rows of a text column."""
    counted = materialize(_counted(df, text, width))
    n = counted.count()
    spread = counted.select(F.explode("columns").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("df")).collect()  # width at most
    idf = np.zeros(width)
    for r in spread:
        idf[r.c] = np.log((1 + n) / (1 + r.df)) + 1
    values, right = directions(_weighted(counted, idf), width, dim, more, seed)
    return SparseBasis(idf, values, right)


def with_components(df: DataFrame, text: str, basis: SparseBasis, out: str = "components") -> DataFrame:
    """``df`` with the row's TF-IDF in the basis; texts without words have zeros."""
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))])
    held = df.sparkSession.sparkContext.broadcast((basis.idf, basis.right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, right = held.value
        for batch in _weigh(_count(batches, len(idf)), idf):
            done = [_times(row, place, value, right[used], n) for row, place, value, used, n in _blocks(iter([batch]))]
            rest = batch.drop_columns(["columns", "values"])
            whole = pa.array(list(np.concatenate(done)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, whole], names=schema.fieldNames())

    return df.withColumn("_h", _listed(text, len(basis.idf))).mapInArrow(run, schema)
