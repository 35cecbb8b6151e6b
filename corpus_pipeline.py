"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir). The first four return the columns of ``docs``; the
last returns the ids' digests. Between stages, rows are written to the shared folder and read
again, so each stage has its own lineage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontam, ngram_join, secrets, toxicity
from tickloom.llm.common import checkpointed, free_name, table


#: Near copies share this percentage of their shingles of so many words; op6_ngram_join has values of its own.
COPY_WORDS, COPY_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    terms, weights = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "toxicity")
    return toxicity.score_toxicity(docs, terms, weights, into=name).where(F.col(name) < toxicity.THRESHOLD).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component; documents without an id stay, and repeated rows stand once.

    Only ids are dropped by the join: those that are not the least of their component.
    """
    found = ngram_join.near_duplicates(docs, words=COPY_WORDS, percent=COPY_PERCENT)
    keep = found.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["kept"]), "left_semi").dropDuplicates(["doc_id", "text"])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    name = free_name(docs, "found")
    found = decontam.find_benchmark(spark, docs, table(spark, sf_dir, "benchmark"), into=name)
    return found.where(F.size(F.col(name)["items"]) == 0).drop(name)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with reported secrets masked in their texts and ``n_chars`` counted anew where it was known."""
    name = free_name(docs, "spans")
    found = secrets.find_secrets(docs, docs.columns, into=name)
    changed = F.size(name) > 0
    out = found.withColumn("text", secrets.masked(F.col("text"), F.col(name)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed & F.col("n_chars").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document, as digests of the ids and of their decoded bytes."""
    return bpe.digests(bpe.encode_documents(docs, public_tokenizers.path(bpe.VOCABULARY)))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]

#: Scores of a trained model and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
