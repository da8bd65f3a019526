"""Amount buckets of the size and funding charts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket labels in chart order with their upper bounds (exclusive).
BUCKETS = [
    ("<100 K", 100_000),
    ("100 K–500 K", 500_000),
    ("500 K–1 M", 1_000_000),
    ("1 M–5 M", 5_000_000),
    ("5 M–10 M", 10_000_000),
    ("≥10 M", None),
]


def bucket_number(amount: Column) -> Column:
    """Position of the bucket in chart order; a null amount falls into the last one."""
    last = len(BUCKETS) - 1
    out = F.when(amount < BUCKETS[0][1], 0)
    for i in range(1, last):
        out = out.when(amount < BUCKETS[i][1], i)
    return out.otherwise(last)


def bucket_label(number: Column) -> Column:
    return F.get(F.array(*[F.lit(label) for label, _ in BUCKETS]), number)
