"""Order books: snapshots, deltas and best levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_levels(levels: DataFrame, k: int) -> DataFrame:
    """The k best bids (highest) and asks (lowest) of each book: rows (book, side, price, size) with ``level`` from 1."""
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy("book", "side").orderBy(best)
    return levels.withColumn("level", F.row_number().over(w)).where(F.col("level") <= k)


def book_state(deltas: DataFrame) -> DataFrame:
    """Books after all their deltas (book, seq, side, price, size, is_snapshot).

    A snapshot replaces what came before; the last size of a price counts; a size of 0 removes it.
    """
    start = deltas.groupBy("book").agg(F.max(F.when(F.col("is_snapshot"), F.col("seq"))).alias("_from"))
    live = deltas.join(start, "book").where(F.col("_from").isNull() | (F.col("seq") >= F.col("_from")))
    last = live.groupBy("book", "side", "price").agg(F.max_by("size", "seq").alias("size"))
    return last.where("size > 0")
