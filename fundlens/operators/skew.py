"""Guards against keys that hold a large share of all rows.

``hot_keys`` counts rows per key (partial aggregation first, key column only). Where no key is above
the limit, callers keep their plain one-shuffle plan. Otherwise the hot keys are split by ``seg``, a
number that grows with the row order inside a key, so that no task or list holds a whole hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_KEY = 500_000  # elements of a list in one row of the wide table; the layout rule of every project
BROADCAST_ROWS = 200_000
HASHES = 65_536  # hash buckets in which rows are counted before keys are
JOINED_ROWS = 100_000  # rows of a key that meet one copy of the other side's row


def hot_keys(df: DataFrame, key: str, limit: int = ROWS_PER_KEY) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there are none."""
    return counted_keys(df, key, limit)[0]


def counted_keys(df: DataFrame, key: str, limit: int = ROWS_PER_KEY) -> tuple[DataFrame | None, int]:
    """Keys with more than ``limit`` rows, or None when there are none, and the number of rows.

    Rows are counted by a hash of the key first: only keys in hash buckets with more than ``limit`` rows are counted
    themselves. There can be at most ``rows / limit`` such keys. The frame is marked for broadcast only when its
    counted size allows it.
    """
    hashed = df.select(key, F.pmod(F.xxhash64(key), F.lit(HASHES)).cast("int").alias("_hash"))
    full = F.collect_list(F.when(F.col("count") > limit, F.col("_hash")))  # at most HASHES
    sums = hashed.groupBy("_hash").count().agg(F.sum("count").alias("n"), full.alias("full")).head()
    if not sums["full"]:
        return None, sums["n"] or 0
    held = df.sparkSession.createDataFrame([(h,) for h in sums["full"]], "_hash int")
    hot = hashed.join(F.broadcast(held), "_hash").groupBy(key).count().filter(F.col("count") > limit).select(key)
    n = hot.count()
    if n == 0:
        return None, sums["n"]
    return F.broadcast(hot) if n <= BROADCAST_ROWS else hot, sums["n"]


def dense_position(df: DataFrame, key: str, seg: str, order: list[str], name: str = "pos") -> DataFrame:
    """Exact 0-based position inside a key, without a window over a whole key.

    Rows are numbered inside (key, seg) and shifted by the row count of the key's earlier segments,
    which comes from a much smaller table of counts.
    """
    counts = df.groupBy(key, seg).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        key, seg, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(key, seg).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inside) - 1)
        .join(offsets, [key, seg])
        .withColumn(name, F.col("_offset") + F.col("_rn"))
        .drop("_offset", "_rn")
    )


def join_unique(rows: DataFrame, table: DataFrame, key: str, deal: list[str], how: str = "left", limit: int = JOINED_ROWS) -> DataFrame:
    """``rows`` joined with ``table``, whose ``key`` is unique: a key with more than ``limit`` rows is dealt by ``deal`` over
    as many places as it needs. Only such keys are copied, so at most ``rows / limit`` copies are added to the table.
    The tables are merged: from the file sizes alone Spark could take the copies for small and broadcast them."""
    often = rows.groupBy(key).count().filter(F.col("count") > limit)
    often = F.broadcast(often.select(key, F.ceil(F.col("count") / limit).cast("int").alias("_places")))  # rows / limit at most
    places = F.coalesce("_places", F.lit(1))
    dealt = rows.join(often, key, "left").withColumn("_place", F.pmod(F.xxhash64(*deal), places).cast("int")).drop("_places")
    copies = table.join(often, key, "left").withColumn("_place", F.explode(F.sequence(F.lit(0), places - 1))).drop("_places")
    return dealt.join(copies.hint("merge"), [key, "_place"], how).drop("_place")
