"""Importance resampling towards a target: hashed n-gram features, bucket gains, Gumbel top-k.

Features are runs of one to three words. Within a piece of some megabytes of texts, distinct
features are found over numbers of words, grouped by equal length into two-dimensional arrays of
bytes, and their CRCs are updated a column at a time for the whole array; results go back to
where each feature occurs. Tasks add up counts of buckets, of which there is a fixed number, so
what is shuffled and what the driver sees of the corpus does not grow with it. Scores are ranked
by a distributed sort: a row's rank is its place in its part plus the sizes of the parts before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import checkpointed, removed, short_batches, table

BUCKETS, LONGEST_RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of words in a piece; a matrix holds at most as many bytes.
PIECE_BYTES = 1 << 20
#: A feature beyond this would fill a matrix of few rows and very many columns; zlib takes it by itself.
LONG_FEATURE = 2_048
#: A-Z become a-z, and all that is not part of a word becomes a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _crc_table()


def crc_matrix(columns: np.ndarray) -> np.ndarray:
    """CRC-32 of texts of one length; ``columns`` has a row for each place and a column for each text."""
    crc = np.full(columns.shape[1], 0xFFFFFFFF, dtype=np.uint32)
    for column in columns:
        crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
    return ~crc


def crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``data``: equal lengths share matrices of a bounded size."""
    out = np.empty(len(start), dtype=np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        if size > LONG_FEATURE:
            for i in order[a:b].tolist():
                out[i] = zlib.crc32(data[start[i] : start[i] + size])
            continue
        step = max(1, PIECE_BYTES // size)
        for at in range(a, b, step):
            some = order[at : min(at + step, b)]
            out[some] = crc_matrix(data[np.arange(size)[:, None] + start[some]])
    return out


def buckets_of(words: list[bytes], doc: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of each run of words that lies in one document and ends at a fresh word."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    number = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
    sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known))[number]
    start = np.cumsum(sizes + 1) - sizes - 1
    run, owners, firsts, lengths, places, found = np.zeros(len(words), np.int64), [], [], [], [], 0
    for n in range(1, LONGEST_RUN + 1):
        if len(words) < n:
            break
        run = run[: len(words) - n + 1] * len(known) + number[n - 1 :]
        whole = np.flatnonzero((doc[: len(run)] == doc[n - 1 :]) & fresh[n - 1 :])
        _, first, place = np.unique(run[whole], return_index=True, return_inverse=True)
        first = whole[first]
        owners.append(doc[whole])
        firsts.append(start[first])
        lengths.append(start[first + n - 1] + sizes[first + n - 1] - start[first])
        places.append(place + found)
        found += len(first)
    distinct = crcs(data, np.concatenate(firsts), np.concatenate(lengths)) % np.uint32(BUCKETS)
    return np.concatenate(owners), distinct.astype(np.int64)[np.concatenate(places)]


def pieces(texts: list[str | None]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Words of texts with the numbers of their texts, in pieces of bounded size.

    A text that is cut repeats its last words at the head of the next piece, where they are not fresh.
    """
    words: list[bytes] = []
    doc: list[np.ndarray] = []
    fresh: list[np.ndarray] = []
    held = 0

    def piece() -> tuple[list[bytes], np.ndarray, np.ndarray]:
        return words, np.concatenate(doc), np.concatenate(fresh)

    for i, text in enumerate(texts):
        folded, at, carried = (text or "").encode().translate(_FOLD), 0, []
        while at < len(folded):
            end = folded.find(b" ", at + PIECE_BYTES - held)
            end = len(folded) if end < 0 else end
            new = folded[at:end].split()
            words += carried
            words += new
            doc.append(np.full(len(carried) + len(new), i))
            fresh.append(np.arange(len(carried) + len(new)) >= len(carried))
            held, at, carried = held + end - at, end, (carried + new)[1 - LONGEST_RUN :]
            if held >= PIECE_BYTES:
                yield piece()
                words, doc, fresh, held = [], [], [], 0
    if words:
        yield piece()


def _count_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for piece in pieces(batch.column(0).to_pylist()):
            total += np.bincount(buckets_of(*piece)[1], minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> list[int]:
    """How many features of all texts fall into each bucket."""
    short_batches(texts.sparkSession)
    partial = texts.select(F.col(text_col).alias("t")).mapInArrow(_count_buckets, "bucket bigint, n bigint")
    out = [0] * BUCKETS
    for r in partial.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: list[int], target: list[int]) -> list[int]:
    """Rounded-down thousandths of the log ratio of smoothed bucket shares, target over corpus."""
    all_corpus, all_target = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in zip(corpus, target)]


def weighed(docs: DataFrame, gains: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row, the weight being the sum of its features' gains."""
    short_batches(docs.sparkSession)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.array(gains, dtype=np.int64)
        for batch in batches:
            rows = batch.num_rows
            n_words, n_features, weight = (np.zeros(rows, dtype=np.int64) for _ in range(3))
            for words, doc, fresh in pieces(batch.column(1).to_pylist()):
                n_words += np.bincount(doc[fresh], minlength=rows)
                owner, bucket = buckets_of(words, doc, fresh)
                n_features += np.bincount(owner, minlength=rows)
                np.add.at(weight, owner, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], ["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).mapInArrow(weigh, "id bigint, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame, least: int, percent: int) -> DataFrame:
    """``rows`` with ``rank``, that of the highest scores among rows of ``least`` words, or null where not drawn."""
    spark = rows.sparkSession
    eligible = rows.where(F.col("n_words") >= least)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    placed = checkpointed(spark, eligible.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftrightunsigned("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size"))  # one row a task of the sort
    drawn = percent * placed.count() // 100
    rank = (F.col("place") - F.shiftleft(part, 33)) + F.col("before") + 1
    placed = placed.join(F.broadcast(before), part == before["part"]).select(*rows.columns, F.when(rank <= drawn, rank).alias("rank"))
    return placed.union(rows.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("bigint")))


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    The rows of least rank are a draw without replacement in proportion to exp(weight / 1000), as
    scores are weights plus Gumbel noise from a hash of ``seed`` and id. Rows of fewer than
    ``LEAST_WORDS`` words are not drawn. A null text has no words; a null id is hashed as an empty
    text and comes last among ties. Rows of one id and score follow one another in some order.
    Empty tables give no rows, or no gains. Columns that are not named are not read.
    """
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, text_col), bucket_counts(target, target_text_col))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighed(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    scored = checkpointed(spark, scored, "scored")
    return ranked(scored, LEAST_WORDS, percent).select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every document, with the benchmark as target."""
    drawn = importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
