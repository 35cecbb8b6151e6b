"""Stored results: frames by product, models as bytes, identities, and upkeep of stored tables."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def identity(parts: dict) -> str:
    """Twelve hexadecimal digits that name a component by what it is made of."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:12]


def save_frame(df: DataFrame, path: str, about: dict | None = None) -> None:
    """Stores a frame partitioned by product, with facts about it (such as its signal columns) beside it."""
    df.write.mode("overwrite").partitionBy("product").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(about or {}),)], "about string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load_frame(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    about = json.loads(spark.read.schema("about string").json(f"{path}/about").first()["about"])
    return spark.read.parquet(f"{path}/rows"), about


def save_bytes(spark: SparkSession, path: str, component: str, step: int, content: bytes) -> None:
    """Appends a model, checkpoint or source of a component at a step."""
    spark.createDataFrame([(component, step, bytearray(content))], "component string, step int, content binary").coalesce(1).write.mode("append").parquet(path)


def load_bytes(spark: SparkSession, path: str, component: str, step: int | None = None) -> bytes:
    """The content at a step, or the latest; filters reach the scan."""
    rows = spark.read.parquet(path).where(F.col("component") == component)
    if step is not None:
        rows = rows.where(F.col("step") == step)
    found = rows.orderBy(F.desc("step")).limit(1).collect()
    if not found:
        raise LookupError(f"{component} has no artifact")
    return bytes(found[0]["content"])


def compact(spark: SparkSession, path: str, to: str, rows_a_file: int = 5_000_000) -> None:
    """Rewrites a frame's many small files into files of a bounded number of rows."""
    spark.read.parquet(f"{path}/rows").repartition("product").write.option("maxRecordsPerFile", rows_a_file).mode("overwrite").partitionBy("product").parquet(f"{to}/rows")
    spark.read.schema("about string").json(f"{path}/about").coalesce(1).write.mode("overwrite").json(f"{to}/about")


def expired(versions: DataFrame, keep: int = 2, hours: float = 168, now: float | None = None) -> DataFrame:
    """Versions (path, written as epoch seconds) that may go: all but the newest ``keep``, once they are old. Nothing is deleted here."""
    if hours < 168:
        raise ValueError("versions are kept for 168 hours at least")
    limit = (now or time.time()) - 3600 * hours
    newest = [r["path"] for r in versions.orderBy(F.desc("written")).limit(keep).collect()]
    return versions.where((F.col("written") < limit) & ~F.col("path").isin(newest))
