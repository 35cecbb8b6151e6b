"""Bars and ticks in files of other formats, read with the types that are expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_path

# The columns of stored bars and ticks.
BARS = "date timestamp, product string, resolution string, open double, high double, low double, close double, volume double"
TICKS = "ts timestamp, product string, price double, volume double, seq bigint"
FORMATS = ("csv", "json", "orc", "parquet")
_BAD = "_unreadable"


def load(spark: SparkSession, path: str, kind: str, schema: str = BARS, **options: str) -> tuple[DataFrame, DataFrame]:
    """(rows, unreadable) of files: rows have the columns of ``schema``; unreadable ones are texts.

    Nothing is inferred. CSV and JSON files are parsed once, into Parquet in the shared folder,
    from which rows and unreadable lines are read. A CSV file has a header, whose names must be
    those of the schema in its order, and a line that does not fit is unreadable. Parquet and ORC
    files have types of their own, which are cast.
    """
    if kind not in FORMATS:
        raise ValueError(f"a format is one of {FORMATS}")
    wanted = spark.createDataFrame([], schema).schema
    if kind in ("parquet", "orc"):
        rows = spark.read.options(**options).format(kind).load(path)
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted)), spark.createDataFrame([], "text string")
    reader = spark.read.options(mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD, timestampFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]")
    reader = reader.options(header="true", enforceSchema="false") if kind == "csv" else reader
    both = reader.options(**options).schema(f"{schema}, {_BAD} string").format(kind).load(path)
    once = shared_path(spark, "parsed")
    both.withColumn("readable", F.col(_BAD).isNull()).write.partitionBy("readable").parquet(once)
    parsed = spark.read.schema(f"{schema}, {_BAD} string, readable boolean").parquet(once)
    return parsed.where("readable").drop(_BAD, "readable"), parsed.where("NOT readable").select(F.col(_BAD).alias("text"))


def store(df: DataFrame, path: str, kind: str) -> None:
    """Writes a frame so that ``load`` gives it back; times to the microsecond."""
    if kind not in FORMATS:
        raise ValueError(f"a format is one of {FORMATS}")
    writer = df.write.mode("overwrite")
    if kind in ("csv", "json"):
        writer = writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    if kind == "csv":
        writer = writer.options(header="true", nullValue="", emptyValue='""')
    writer.format(kind).save(path)
