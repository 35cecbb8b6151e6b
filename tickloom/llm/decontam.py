"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A benchmark item is cut into windows of ``window`` consecutive words; an item of
fewer words is one window. Every window is a pattern. Patterns of one length form
a table: a shift for each block of two words says how far the search may jump, a
bucket for each final block holds the patterns to compare directly.

The patterns are held by every executor. They come from the benchmark, not from
the corpus, and the size of the benchmark is checked first: beyond
``max_block_bytes`` of text it is searched in blocks, in one job over the texts for
each block, and no block is larger than that bound (unless a single item is). Rows of
one item may lie in several blocks. Tables take about 130 times a block's text, once in
each worker, so that bound is what a worker can hold; a job's hits are written before
the next job begins.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickloom.llm.common import checkpointed, free_name, short_batches, table

WINDOW = 10
MAX_BLOCK_BYTES = 4 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

FOUND = "n_words bigint, spans array<struct<start: int, stop: int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of digits, letters and all that is not ASCII."""
    return _WORD.findall(text.encode().lower()) if text else []


class WuManber:
    """Patterns of one length over words. ``find`` gives (start, payload) of every occurrence."""

    def __init__(self, length: int, patterns: dict[tuple, object]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, object]] = {}
        for p, payload in patterns.items():
            for end in range(self.block, length + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.default), length - end)
            self.buckets.setdefault(p[length - self.block :], {})[p] = payload

    def find(self, words: list[bytes]) -> Iterator[tuple[int, object]]:
        shift, default, m, b, n = self.shift.get, self.default, self.length, self.block, len(words)
        end = m
        while end <= n:
            block = tuple(words[end - b : end])
            jump = shift(block, default)
            if jump:
                end += jump
                continue
            start = end - m
            payload = self.buckets[block].get(tuple(words[start:end]))
            if payload is not None:
                yield start, payload
            end += 1


def compile_items(items: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    """One table for each pattern length; the payload of a pattern is its set of items."""
    by_length: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(item)
    return [WuManber(m, p) for m, p in sorted(by_length.items())]


def scan(tables: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of hit words and the items that occur."""
    found, items = [], set()
    for t in tables:
        for start, payload in t.find(words):
            found.append((start, start + t.length))
            items |= payload
    spans: list[list[int]] = []
    for a, b in sorted(found):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [tuple(s) for s in spans], items


#: The tables that this worker has built last, by the name of their search.
_built: dict[str, list] = {}


def _tables(name: str, held: Broadcast, window: int):
    if name not in _built:
        _built.clear()
        _built[name] = compile_items(held.value, window)
    return _built[name]


def _searcher(held: Broadcast, window: int):
    name = uuid.uuid4().hex

    @pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = _tables(name, held, window)
        for texts in batches:
            out = []
            for text in texts:
                words = words_of(text)
                spans, hit = scan(tables, words)
                out.append((len(words), [{"start": a, "stop": b} for a, b in spans], sorted(hit)))
            yield pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return search


def blocks_of(items: DataFrame, bound: int) -> DataFrame:
    """Items (i, t) with their ``bytes`` and ``block``: no block has more than ``bound`` bytes, unless one row alone has.

    Rows of up to half the bound are laid end to end, and those that begin within one half of
    the bound are a block. Larger rows are a block each. Running sums are taken within the parts
    in which rows are written, and over the parts' sums.
    """
    half = max(1, bound // 2)
    sized = items.select("i", "t", (F.octet_length("t") + F.octet_length("i")).alias("bytes"), F.monotonically_increasing_id().alias("at"))
    rows = checkpointed(items.sparkSession, sized.withColumn("small", F.col("bytes") <= half), "items").withColumn("part", F.shiftrightunsigned("at", 33))
    # Large rows are counted, small ones measured.
    rows = rows.withColumn("size", F.when(F.col("small"), F.col("bytes")).otherwise(1))
    sums = rows.groupBy("small", "part").agg(F.sum("size").alias("sum"))
    before = sums.withColumn("before", F.sum("sum").over(Window.partitionBy("small").orderBy("part")) - F.col("sum")).drop("sum")
    within = F.sum("size").over(Window.partitionBy("small", "part").orderBy("at")) - F.col("size")
    start = F.col("before") + F.col("within")
    block = F.when(F.col("small"), 2 * F.floor(start / half)).otherwise(2 * start + 1)
    return checkpointed(items.sparkSession, rows.withColumn("within", within).join(F.broadcast(before), ["small", "part"]).select("i", "t", "bytes", block.cast("bigint").alias("block")), "blocks")


def find_benchmark(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_block_bytes: int = MAX_BLOCK_BYTES,
    into: str = "found",
) -> DataFrame:
    """``docs`` with one more column ``into``: n_words, spans of hit words, items that occur.

    A null text has no words. Items without text, words or id give no patterns;
    repeated items count once. Repeated documents are each searched. An empty
    benchmark leaves every document without hits. ``into`` must be a new name.
    """
    if into in docs.columns:
        raise ValueError(f"column {into} exists")
    short_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).dropna()
    size = items.agg(F.sum(F.octet_length("t") + F.octet_length("i"))).first()[0] or 0
    blocks = -(-size // max_block_bytes) or 1
    if blocks == 1:
        held = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])
        return docs.withColumn(into, _searcher(held, window)(F.col(text_col)))
    row, name = free_name(docs, "row"), free_name(docs, "hits")
    numbered = checkpointed(spark, docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hits = None
    placed = blocks_of(items, max_block_bytes)
    for k, block in enumerate(sorted(r["block"] for r in placed.select("block").distinct().collect())):
        held = spark.sparkContext.broadcast([tuple(r) for r in placed.where(F.col("block") == block).select("i", "t").collect()])
        found = numbered.select(row, _searcher(held, window)(F.col(text_col)).alias(name))
        # Every text has a row in the first block's result, which brings its number of words.
        each = checkpointed(spark, found if k == 0 else found.where(F.size(F.col(name)["items"]) > 0), "block")
        held.destroy()
        hits = each if hits is None else hits.union(each)
    merged = hits.groupBy(row).agg(
        F.struct(
            F.max(F.col(name)["n_words"]).alias("n_words"),
            F.flatten(F.collect_list(F.col(name)["spans"])).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list(F.col(name)["items"]))).alias("items"),
        ).alias(into)
    )
    return numbered.join(merged, row).drop(row)


def n_hit(found: Column) -> Column:
    """Hit words of a ``found`` column; spans of several passes may overlap and come in any order."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(found["spans"]),
        empty,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["end"]))).alias("n"),
            F.greatest(a["end"], s["stop"]).alias("end"),
        ),
    )["n"].cast("bigint")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words inside benchmark windows, items found and their digest; null texts have no words."""
    found = F.col("found")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_benchmark(spark, docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        found["n_words"].alias("n_words"),
        n_hit(found).alias("n_hit"),
        F.size(found["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(found["items"]), ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
o AS (SELECT doc_id, item_id, dw.m, i FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM o)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM o) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
