"""Near duplicates among embeddings: int8 tile products with rigorous error bounds.

Vectors are dealt by hash into groups of about ``TILE`` rows, and every pair of groups is a tile (for each length of
vectors): one task multiplies the int8 forms of its two groups (in float32, whose sums of such products are exact up to
``EXACT`` components). A unit vector is u = s q + e with q in int8, so the cosine differs from the scaled product by
at most |s q| |e'| + |e| |s' q'| + |e| |e'|, and these lengths are kept per vector. Only pairs whose bound reaches the
threshold are worked out in double precision, so no link is lost and none below the threshold is made.

A tile returns no pairs: per vector it returns the number of its links there and one link to the smallest vector of
its component in the tile, so a tile's result is linear in its rows, however alike they are. Counts are added up;
components are joined by the alternating stars of ``simhash.components``.

The work is that of all pairs, as the method has it: rows are read once per group, products grow with the square of
the rows, and memory is bounded by a tile.

Defined results: null, empty or zero vectors and those with a null or non-finite component link with nothing, nor do
vectors of different lengths; rows that repeat an id are vectors of their own; a null id is larger than all others and
is a component's id only if all of its ids are null; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fundlens.llm.simhash import components
from fundlens.session import materialize

TILE = 8192  # rows of a group
STRIPE = 256  # rows that are multiplied with a group at a time
EXACT = 1040  # components whose int8 products add up exactly in float32
SLACK = 1e-5  # above the rounding of float32 sums and scalings of the coarse comparison
MOST_TASKS = 20_000
PAIRS = 1 << 16  # pairs that are worked out in double precision at a time


def usable(vector: str | Column) -> Column:
    """Whether a vector has a direction: components that are all finite, not all zero."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


class Quantised:
    """int8 forms (held as float32), scales, lengths of the forms and of their errors."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        self.scale = np.abs(unit).max(axis=1) / 127
        whole = np.rint(unit / self.scale[:, None])
        self.q = whole.astype(np.float32)
        grid = whole * self.scale[:, None]
        self.length = np.sqrt((grid**2).sum(axis=1)) * (1 + 1e-9)
        self.error = np.sqrt(((unit - grid) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12

    def products(self, rows: slice, other: Quantised) -> np.ndarray:
        """Exact integer products of some rows with all of the other's."""
        if self.q.shape[1] <= EXACT:
            return self.q[rows] @ other.q.T
        total = np.zeros((len(self.q[rows]), len(other.q)))
        for start in range(0, self.q.shape[1], EXACT):
            total += self.q[rows, start : start + EXACT] @ other.q[:, start : start + EXACT].T
        return total


def near_pairs(left: Quantised, right: Quantised, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all rows with cosine >= threshold, by stripes; ``same``: one group with itself, i < j."""
    longest, worst = right.length.max(initial=0), right.error.max(initial=0)
    scale = right.scale.astype(np.float32)
    for start in range(0, len(left.q), STRIPE):
        rows = slice(start, start + STRIPE)
        product = left.products(rows, right)
        spread = left.length[rows] * worst + left.error[rows] * (longest + worst)
        least = ((threshold - SLACK - spread) / left.scale[rows]).astype(np.float32)
        i, j = np.nonzero(product * scale >= least[:, None])
        whole = product[i, j].astype(np.float64)
        i = i + start
        if same:
            upper = i < j
            i, j, whole = i[upper], j[upper], whole[upper]
        spread = left.length[i] * right.error[j] + left.error[i] * (right.length[j] + right.error[j])
        maybe = whole * left.scale[i] * right.scale[j] + spread >= threshold - 1e-12
        i, j = i[maybe], j[maybe]
        near = np.zeros(len(i), dtype=bool)
        for k in range(0, len(i), PAIRS):
            part = slice(k, k + PAIRS)
            near[part] = np.einsum("ij,ij->i", left.unit[i[part]], right.unit[j[part]]) >= threshold
        if near.any():
            yield i[near], j[near]


def _joined(head: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``head`` (the smallest member of each node's component) after the links (a, b)."""
    while True:
        low, high = np.minimum(head[a], head[b]), np.maximum(head[a], head[b])
        apart = low < high
        if not apart.any():
            return head
        np.minimum.at(head, high[apart], low[apart])
        while True:
            further = head[head]
            if (further == head).all():
                break
            head = further


def _tile(key: tuple, table: pa.Table, threshold: float, schema: pa.Schema) -> pa.Table:
    same = key[1].as_py() == key[2].as_py()
    table = table.sort_by("row").combine_chunks()
    group = table.column("group").to_numpy()
    row = table.column("row").to_numpy()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    unit = unit_rows(flat.astype(np.float64).reshape(table.num_rows, -1))
    first = np.flatnonzero(group == key[1].as_py())
    left = Quantised(unit[first])
    second = first if same else np.flatnonzero(group != key[1].as_py())
    right = left if same else Quantised(unit[second])
    links, head = np.zeros(len(row), dtype=np.int64), np.arange(len(row))
    for i, j in near_pairs(left, right, threshold, same):
        a, b = first[i], second[j]
        links += np.bincount(a, minlength=len(row)) + np.bincount(b, minlength=len(row))
        head = _joined(head, a, b)
    some = np.flatnonzero(links)
    vec_id = table.column("vec_id")
    return pa.Table.from_arrays(
        [pa.array(row[some]), vec_id.take(pa.array(some)), pa.array(row[head[some]]), vec_id.take(pa.array(head[some])),
         pa.array(links[some])],
        names=["row", "vec_id", "head", "head_id", "n"],
    ).cast(schema)


def tiles(rows: DataFrame) -> DataFrame:
    """(dim, i, j, group, row, vec_id, vector): each row once per pair of groups that it belongs to, a pair in one place.

    The number of partitions is given, since a tile is much work on few bytes: adaptive execution would join
    many of them into one task.
    """
    n_groups = max(1, -(-rows.count() // TILE))
    dealt = rows.withColumn("dim", F.size("vector")).withColumn("group", F.pmod(F.xxhash64("row"), F.lit(n_groups)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1))).alias("other")
    met = dealt.select("dim", "group", "row", "vec_id", "vector", other).select(
        "dim", F.least("group", "other").alias("i"), F.greatest("group", "other").alias("j"), "group", "row", "vec_id", "vector"
    )
    return met.repartition(min(2 * n_groups * (n_groups + 1), MOST_TASKS), "dim", "i", "j")


def grouped(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    ``n_links`` counts the other vectors with cosine >= ``threshold`` (above 0), ``component_id`` is the
    smallest id that links reach, ``kept`` says that it is the vector's own.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    base = materialize(
        vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.monotonically_increasing_id().alias("row"))
    )
    id_type = base.schema["vec_id"].dataType
    schema = StructType([
        StructField("row", LongType()), StructField("vec_id", id_type), StructField("head", LongType()),
        StructField("head_id", id_type), StructField("n", LongType()),
    ])
    empty = base.limit(0).select("row", "vec_id", F.col("row").alias("head"), F.col("vec_id").alias("head_id"), F.col("row").alias("n"))
    arrow = empty.toArrow().schema

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _tile(key, table, threshold, arrow)

    parts = tiles(base.filter(usable("vector"))).groupBy("dim", "i", "j").applyInArrow(run, schema)
    found = materialize(parts)
    node = lambda i, row: F.struct(F.col(i).isNull().alias("none"), F.col(i).alias("id"), F.col(row).alias("row"))
    linked = found.select(node("head_id", "head").alias("a"), node("vec_id", "row").alias("b"))
    reached = components(linked).select("node.row", F.col("root.id").alias("root_id"), F.lit(True).alias("linked"))
    counts = found.groupBy("row").agg(F.sum("n").alias("n"))
    rows = base.drop("vector").join(counts, "row", "left").join(reached, "row", "left")
    component = F.when(F.col("linked"), F.col("root_id")).otherwise(F.col("vec_id"))
    return rows.select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )

