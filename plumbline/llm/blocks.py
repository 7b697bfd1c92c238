"""Blocks: rows that hold what a task made of many documents, with dictionaries of their own.

A block's dictionary names each of its keys once, so a key of very many documents is one row
a block. What all blocks know about a key comes back to each block that has it.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of at most so many rows are broadcast; larger ones are shuffled.
SMALL_ROWS = 1_000_000


def block_number(seq: int) -> int:
    """A number of its own for each block of a job: of the task's partition, and of the block in it."""
    return (TaskContext.get().partitionId() << 31) | seq


def small_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has so many ``rows``, marked for broadcasting if these are few."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def answered(blocks: DataFrame, found: DataFrame, *values: str) -> DataFrame:
    """``blocks`` with arrays ``at`` and ``values``: what was ``found (block, at, *values)`` for a block's keys.

    Arrays of one block are in one order; blocks without any have nulls. No more is gathered
    than a block's dictionary has.
    """
    each = F.collect_list(F.struct("at", *values)).alias("__met")
    met = found.groupBy("block").agg(each).select("block", F.col("__met.at").alias("at"), *[F.col(f"__met.{v}").alias(v) for v in values])
    return blocks.join(met, "block", "left")
