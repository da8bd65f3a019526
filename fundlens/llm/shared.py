"""Pieces that several operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fundlens.session import ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
SLICE = 256  # texts that a Python worker holds as Python objects at a time


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words between spaces, tabs and line ends; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or it with underscores, so that it differs from ``taken`` in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def _batches(batches: Iterator[pa.RecordBatch], make: Callable, at: int, names: list[str]):
    work = make()
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            found = work(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns, *found], names=names)


def with_columns(df: DataFrame, text: str, make: Callable, ddl: str) -> DataFrame:
    """``df`` and the columns that a function computes from its texts, in Arrow batches.

    ``make()`` runs once per task and returns the function: list of texts (or None) to one Arrow
    array per column of ``ddl``. New columns must not be columns of ``df``.
    """
    new = StructType.fromDDL(ddl)
    schema = StructType([*df.schema.fields, *new.fields])
    names = [f.name for f in schema.fields]
    return df.mapInArrow(partial(_batches, make=make, at=df.columns.index(text), names=names), schema)
