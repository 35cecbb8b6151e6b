"""Exact duplicates by progressive refinement: length, then the hash of a prefix, then the hash of all.

Each step looks only at the rows that the step before could not tell apart. A text whose length
no other has is alone, and so is one whose prefix no other of its length has; neither is hashed
whole. What a step knows is a table of keys that more than one row has, counted with partial
sums, so a key of a third of all rows costs each task one row. Such a table is broadcast up to a
checked number of rows; beyond it, rows are joined with it by a shuffle whose large partitions
adaptive execution splits, as one side has a key only once.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import checkpointed, removed, short_batches, table

#: Code points of a text that the second step hashes.
PREFIX = 256
#: Keys of so many rows are broadcast; a row has at most three numbers or a digest of 64 letters.
BROADCAST_ROWS = 300_000

OP11_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def folded(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has, as a written table, to be broadcast where it is small."""
    spark = rows.sparkSession
    out = checkpointed(spark, rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(*keys), "shared")
    return F.broadcast(out) if out.count() <= BROADCAST_ROWS else out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), prefix: int = PREFIX) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept``, and the columns of ``carry``.

    Texts are equal when they are so after A-Z are lower-cased; null is an empty text. Of a group
    the row of largest id stays, and ``keep_id`` is its id; null is less than any id. Where that
    id is repeated in the group, one of its rows stays. An empty table gives no rows. Columns of
    ``docs`` that are not named are not read, so they may have any names. ``carry`` must not name
    a column of the result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    kept_columns = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *kept_columns).withColumn("bytes", F.octet_length(F.coalesce("text", F.lit(""))))
    lengths = _shared(rows, ["bytes"])
    alike = rows.join(lengths, "bytes", "left_semi").withColumn("start", F.xxhash64(folded(F.substring("text", 1, prefix))))
    prefixes = _shared(alike, ["bytes", "start"])
    # Only rows of a shared length have a prefix hash, and only those of a shared prefix a digest.
    told = rows.join(lengths.select("bytes", F.lit(True).alias("length_shared")), "bytes", "left").withColumn(
        "start", F.when(F.col("length_shared"), F.xxhash64(folded(F.substring("text", 1, prefix))))
    )
    told = told.join(prefixes.select("bytes", "start", F.lit(True).alias("prefix_shared")), ["bytes", "start"], "left")
    digest = F.when(F.col("prefix_shared"), F.sha2(folded(F.col("text")), 256))
    told = told.select("id", *(f"carried_{i}" for i in range(len(carry))), digest.alias("digest")).withColumn("row", F.monotonically_increasing_id())
    told = checkpointed(spark, told, "told")
    best = F.max(F.struct("id", "row")).alias("best")
    groups = told.where("digest IS NOT NULL").groupBy("digest").agg(best, F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = checkpointed(spark, groups.select("digest", F.col("best.id").alias("keep"), F.col("best.row").alias("keep_row"), "size"), "groups")
    removed(spark, lengths, prefixes)
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    grouped = told.where("digest IS NOT NULL").join(groups, "digest", "left")
    return grouped.unionByName(told.where("digest IS NULL"), allowMissingColumns=True).select(
        F.col("id").alias(id_col),
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, kept row and digest of every document; the digest is asked for of all rows, so it is carried along."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_sha256", F.sha2(folded(F.col("text")), 256))
    return exact_duplicates(docs, carry=["text_sha256"])
