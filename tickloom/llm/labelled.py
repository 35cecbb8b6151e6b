"""Bounded samples of labelled documents, and the folds that hold documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most. They are chosen by a hash of the
#: document's id, so the choice is the same on every run.
MAX_LABELLED = 6_000


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text and ``y`` of at most ``max_rows`` labelled documents outside the held-out fold.

    The sample of labels has a fixed bound, so it is broadcast to the scan of the texts. Rows
    without an id or label are left out. A document that is labelled twice has the larger label,
    and an id of several texts stands for the one of least hash, so the bound is one of rows.
    """
    y = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna().where(~held_out(F.col("doc_id")))
    some = y.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    met = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return met.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"), F.max("y").alias("y"))
