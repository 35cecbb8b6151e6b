"""Bars in partitions by product and day, and a cache of resampled bars in front of them.

Bars lie in folders ``product=.../day=...``, so a read of some products and days lists and opens
no other files, and a write of some days leaves the rest alone. The cache has a folder for each
request, named by a hash of what the request says in its canonical form: two requests that say
the same in other words share it. A folder counts once its description has been written beside
it, after its rows.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.resolution import Resolution
from tickloom.operators.bars import resample
from tickloom.sources.artifacts import identity
from tickloom.sources.market import DataNotFound

POLICIES = ("auto", True, False)


def write_days(bars: DataFrame, path: str) -> None:
    """Stores bars; days of products that they have are replaced, and other ones stay. Rows without a product or date are an error."""
    checked = F.when(F.col("product").isNull() | F.col("date").isNull(), F.raise_error(F.lit("stored bars have a product and a date")).cast("date")).otherwise(F.to_date("date"))
    days = bars.withColumn("day", checked).withColumn("_product", F.col("product").cast("string"))
    rows = days.drop("product").withColumnRenamed("_product", "product")
    # A day of a product is in few files: rows are dealt out by both, and a day that is too large for a task is split.
    spread = rows.hint("rebalance", "product", "day")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("product", "day").parquet(path)


def read_days(spark: SparkSession, path: str, products: list[str] | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Stored bars of some products between two days, both included; only their folders are read."""
    with_types = spark.read.option("basePath", path).parquet(path)
    bars = with_types.withColumns({"product": F.col("product").cast("string")})
    if products is not None:
        bars = bars.where(F.col("product").isin([str(p) for p in products]))
    if start is not None:
        bars = bars.where(F.col("day") >= F.lit(start))
    if end is not None:
        bars = bars.where(F.col("day") <= F.lit(end))
    return bars.drop("day")


@dataclass(frozen=True)
class Request:
    """Bars of ``resolution`` made of those of ``stored`` at ``origin``, for some products (all, if None) and days."""

    origin: str
    stored: str
    resolution: str
    products: tuple[str, ...] | None = None
    start: dt.date | None = None
    end: dt.date | None = None
    shift: int = 0

    def canonical(self) -> dict:
        """What is asked for, in one form: names of resolutions, an order of products without repeats, days without times."""
        day = lambda d: None if d is None else (d.date() if isinstance(d, dt.datetime) else d).isoformat()
        return {
            "origin": self.origin.rstrip("/"), "stored": str(Resolution(self.stored)), "resolution": str(Resolution(self.resolution)), "shift": self.shift,
            "products": None if self.products is None else sorted(set(self.products)), "start": day(self.start), "end": day(self.end),
        }

    @property
    def key(self) -> str:
        return identity(self.canonical())

    @property
    def resamples(self) -> bool:
        return str(Resolution(self.stored)) != str(Resolution(self.resolution)) or bool(self.shift)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.text(path).take(1) != []
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def _loaded(spark: SparkSession, request: Request) -> DataFrame:
    try:
        bars = read_days(spark, request.origin, list(request.products) if request.products is not None else None, request.start, request.end)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise DataNotFound(request.origin) from e
        raise
    return resample(bars, request.resolution, request.shift) if request.resamples else bars.withColumn("resolution", F.lit(str(Resolution(request.resolution))))


def cached(spark: SparkSession, request: Request, cache: str, policy: str | bool = "auto") -> tuple[DataFrame, str]:
    """Bars of a request, and where they come from: ``cache``, ``stored`` (put there now) or ``origin``.

    With False the cache is neither read nor written. It is read otherwise, and written where it
    lacks the request: always with True, and with ``auto`` only if bars had to be resampled. A
    day's rows are those of when the request was first answered; ``forget`` takes a request out.
    """
    if policy not in POLICIES:
        raise ValueError("a policy is auto, True or False")
    folder = f"{cache.rstrip('/')}/{request.key}"
    if policy is False:
        return _loaded(spark, request), "origin"
    if _exists(spark, f"{folder}/about"):
        return read_days(spark, f"{folder}/rows"), "cache"
    bars = _loaded(spark, request)
    if policy == "auto" and not request.resamples:
        return bars, "origin"
    write_days(bars, f"{folder}/rows")
    if not _has_rows(spark, f"{folder}/rows"):
        return bars, "origin"  # nothing to keep: no folder of a product has been made
    about = spark.createDataFrame([(json.dumps(request.canonical(), sort_keys=True),)], "value string")
    about.coalesce(1).write.mode("overwrite").text(f"{folder}/about")
    return read_days(spark, f"{folder}/rows"), "stored"


def _has_rows(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except Exception as e:
        if "UNABLE_TO_INFER_SCHEMA" in str(e) or "PATH_NOT_FOUND" in str(e):
            return False
        raise


def forget(spark: SparkSession, request: Request, cache: str) -> None:
    """Takes a request out of the cache: its description becomes empty, so the next reader asks the origin again."""
    spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(f"{cache.rstrip('/')}/{request.key}/about")
