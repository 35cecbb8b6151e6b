"""Open bars as they grow: each micro-batch gives the bars it has changed, and a keyed store keeps the last version of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.session import KEYS, shared_path
from tickloom.streaming.streams import stream_ohlcv


def write_versions(rows: DataFrame, path: str, batch: int) -> None:
    """A batch's versions in a folder of its own, which the same batch overwrites when it is run again."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def versions(spark: SparkSession, path: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """All versions with ``version``, from 1 for each key, and ``is_last``."""
    rows = spark.read.option("basePath", path).parquet(path)
    of_key = Window.partitionBy(*keys)
    numbered = rows.withColumn("version", F.row_number().over(of_key.orderBy("batch")))
    return numbered.withColumn("is_last", F.col("version") == F.max("version").over(of_key)).drop("batch")


def last_versions(spark: SparkSession, path: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The last version of each key: one partial aggregation, without sorting versions."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in values))


def partial_bars(ticks: DataFrame, resolution: str, wait_seconds: float | None = None, shift: int = 0) -> str:
    """Runs over all ticks that are there and returns the folder of the versions.

    A version is a bar as it stood after a micro-batch that changed it; the last one is the whole
    bar unless more ticks come. Bars are forgotten once the watermark has passed them.
    """
    path = shared_path(ticks.sparkSession, "versions")
    bars = stream_ohlcv(ticks, resolution, wait_seconds, shift).drop("end", "w")
    sink = bars.writeStream.outputMode("update").foreachBatch(lambda rows, batch: write_versions(rows, f"{path}/rows", batch))
    sink.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{path}/rows"
