"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts may be long, so batches are kept short: a batch
#: of this many texts is what one Python worker holds at a time.
BATCH_ROWS = 256

#: ASCII plus the Latin-1 letters. Over these, normal form C changes nothing,
#: lower-casing is one character to one, and Python's character classes agree
#: with those of the tokenizer libraries. Other texts take the library's own path.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bounds the batches of texts that the scan decodes and that reach Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(2 * BATCH_ROWS))


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session may do without that setting; it then gets a folder in
    the system's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/tickloom-shared"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def checkpointed(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts lineage."""
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *written: DataFrame) -> None:
    """Deletes folders that ``checkpointed`` wrote, once all that was made from them is written too."""
    for df in written:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hashed_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of least hash of ``key``. Only hashes are sorted; rows are filtered by the last one."""
    name = free_name(df, "hash")
    hashed = df.withColumn(name, F.xxhash64(key))
    last = hashed.select(name).orderBy(name).limit(rows).agg(F.max(name)).first()[0]
    return hashed.where(F.col(name) <= F.lit(last)).drop(name).limit(rows)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many leading underscores as it takes to be new in ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def is_plain(text: str) -> bool:
    """Python takes \\x1c to \\x1f for white space and the libraries do not, so a text with one of them is not plain."""
    if text.isascii():
        return not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text)
    return _PLAIN.fullmatch(text) is not None
