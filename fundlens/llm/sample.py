"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlens.llm.linear import pack, unpack
from fundlens.llm.shared import SLICE


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, use: Column) -> DataFrame:
    """(text, y, w): at most ``per_class`` labelled documents of each label, the smallest by a hash of the id.

    ``use`` is a condition on ``doc_id``. ``w`` is the number of labelled ids that a sampled one stands
    for, so that weighted shares equal those of all labels. An id with several labels takes the largest;
    a null label or id is left out, and of repeated rows of an id only one is taken.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("double").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0.0, 1.0) & use)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    )
    one = lambda y: known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(per_class)
    chosen = reduce(DataFrame.unionAll, [one(0.0), one(1.0)])  # at most 2 * per_class rows
    sizes = known.groupBy("y").agg(F.count(F.lit(1)).alias("n"))  # two rows
    weighted = chosen.join(F.broadcast(sizes), "y").withColumn(
        "w", F.greatest(F.col("n") / F.lit(per_class), F.lit(1.0))
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(weighted.drop("h", "n")), "doc_id")
    return rows.groupBy("doc_id", "y", "w").agg(F.min("text").alias("text"))


def _featurize(batches, make: Callable):
    work = make()
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            found = [pack(cols=c, values=v) for c, v in map(work, part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("y"), part.column("w"), pa.array(found, pa.binary())],
                names=["doc_id", "y", "w", "x"],
            )


def _fit(batches, fit: Callable):
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: str(r["doc_id"]))
    found = [unpack(r["x"]) for r in rows]
    counts = [len(f["cols"]) for f in found]
    model = fit(
        np.repeat(np.arange(len(rows), dtype=np.int32), counts),
        np.concatenate([f["cols"] for f in found] or [np.empty(0)]).astype(np.int32),
        np.concatenate([f["values"] for f in found] or [np.empty(0)]).astype(np.float64),
        np.array([r["y"] for r in rows], dtype=np.float64),
        np.array([r["w"] for r in rows], dtype=np.float64),
    )
    yield pa.RecordBatch.from_arrays([pa.array([pack(**model)], pa.binary())], names=["model"])


def fitted(sample: DataFrame, make: Callable, fit: Callable) -> dict[str, np.ndarray]:
    """The model that ``fit`` makes of the sample's features, which tasks compute with ``make()``.

    The sample is bounded, so its sparse features meet in one task; only weights reach the driver.
    """
    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(partial(_featurize, make=make), f"doc_id {kind}, y double, w double, x binary")
    model = rows.repartition(1).mapInArrow(partial(_fit, fit=fit), "model binary").collect()
    return unpack(model[0][0])
