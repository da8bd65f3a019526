"""Conversation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fundlens.operators.skew import ROWS_PER_KEY, dense_position, hot_keys

EXCHANGES = 5
BLOCK = 10_000


def _with_history(rows: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-size, -1)
    return rows.withColumn("history", F.collect_list(F.struct("turn", "role", "text")).over(frame))


def chat_window(
    conversations: DataFrame, k: int = EXCHANGES, limit: int = ROWS_PER_KEY, block: int = BLOCK
) -> DataFrame:
    """(conv_id, turn, role, text, history): the messages of the last k exchanges before each turn.

    Only question and answer messages count. A conversation above ``limit`` messages is cut into
    blocks; each block gets a copy of the 2k messages before it, so its window is complete.
    """
    size = 2 * k
    block = max(block, size)
    rows = conversations.filter(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", "text")
    hot = hot_keys(rows, "conv_id", limit)
    if hot is None:
        return _with_history(rows, ["conv_id"], "turn", size)
    small = _with_history(rows.join(hot, "conv_id", "left_anti"), ["conv_id"], "turn", size)
    large = rows.join(hot, "conv_id").withColumn("seg", F.floor(F.col("turn") / block))
    placed = dense_position(large, "conv_id", "seg", ["turn"]).drop("seg")
    own = F.floor(F.col("pos") / block)
    blocks = F.when(F.col("pos") % block >= block - size, F.array(own, own + 1)).otherwise(F.array(own))
    spread = placed.withColumn("_own", own).withColumn("_block", F.explode(blocks))
    done = _with_history(spread, ["conv_id", "_block"], "pos", size).filter("_own = _block")
    return small.unionByName(done.drop("_own", "_block", "pos"))
