"""Scans: raw tables, ticks, news and fills, and ranges of stored bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import KEYS


class DataNotFound(LookupError):
    """There is no stored data and nothing may fetch it."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """(product, ts, price, volume, seq) of the events table: products are event types, prices positive."""
    return table(spark, folder, "events").where("value > 0").select(F.col("event_type").alias("product"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))


def news(spark: SparkSession, folder: str) -> DataFrame:
    """(ts, product, headline_id, score) of error events; even users' news is about every product."""
    e = table(spark, folder, "events").where("event_type = 'error'")
    return e.select("ts", F.when(F.col("user_id") % 2 == 1, F.element_at(F.array(*map(F.lit, ("click", "view", "purchase"))), (F.col("event_id") % 3 + 1).cast("int"))).alias("product"), F.col("event_id").alias("headline_id"), F.col("value").alias("score"))


def fills(spark: SparkSession, folder: str) -> DataFrame:
    """(order_id, line, part, price, quantity) of the lineitem table, as trades of an order."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity")
    )


def retrieve(bars: DataFrame, products: list[str] | None, start, end) -> DataFrame:
    """Stored bars of some products between two dates, both included. The filters reach the scan."""
    out = bars.where(F.col("date").between(F.lit(start), F.lit(end)))
    return out.where(F.col("product").isin(products)) if products is not None else out


def retrieve_or_fetch(spark: SparkSession, path: str, fetch=None, paid: bool = False) -> DataFrame:
    """Bars stored at ``path``; if there are none, what ``fetch`` gives, which is stored first.

    A paid source, or none, raises ``DataNotFound``.
    """
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    if fetch is None or paid:
        raise DataNotFound(path)
    fetch(spark).write.parquet(path)
    return spark.read.parquet(path)


def stack(frames: list[DataFrame]) -> DataFrame:
    """Frames of several products under one another; columns that one lacks are null. Sorted by key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy(*[k for k in KEYS if k in out.columns])


def with_source_type(df: DataFrame, kind: str = "BATCH") -> DataFrame:
    return df.withColumn("source_type", F.lit(kind))


def reference_data(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Instruments of both; where both have a key, the new row counts."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"), allowMissingColumns=True)
