"""Sessions and conventions: UTC, adaptive execution, no NaN in frames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("date", "product", "resolution")
OHLCV = ("open", "high", "low", "close", "volume")


def session(app: str = "tickloom", **conf: str) -> SparkSession:
    """A session with the library's settings; anything in ``conf`` comes on top."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(app).config(map=settings | conf).getOrCreate()


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN stands for "no value" in numeric feeds; in frames that is null."""
    real = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in real}) if real else df


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, which only a local session may lack."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/tickloom-shared"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
