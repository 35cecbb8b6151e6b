"""Near-duplicate documents: a similarity join on word shingles by parity sketches.

A parity sketch XORs a mark of each shingle into one of P parts. Two sets' sketches differ
in at most as many parts as the sets' symmetric difference has members, and a similarity of
``percent`` bounds that difference by D for sets of given sizes. So with P = D + 1 + spare
parts, similar sets agree in 1 + spare parts at least, and must share one of the D + 1 parts
that are rarest for each. Sets meet within bands of size, where D is a constant; a set near a
band's lower end also visits the bands below as a guest.

Sets that share a part do not all meet one another. Each is compared with the part's hub, the
set among them that shares most with all: the middle of a group of copies. XORing a set with
its hub cancels what the whole group shares and leaves a small difference. Let A and B have
differences of a and b members from one hub. If a + b is at most the D of the two, both link
with the hub; else A and B are similar only if (a + b - D) / 2 members or more are in both
differences, so they must share one of the few rarest members of each. Members that only one
component's differences have, as those of a family of copies, are passed over before any pair
arises. Where several components share one and their rows would make many pairs, each row is
first compared with one of them, which merges components. Pairs that are left are pruned by size
and by the Hamming distance of a short bit sketch, and verified on the sets.

Documents with equal sets are one class. Nodes are 64-bit digests of whole sets; sets are
compared as 64-bit hashes of shingles.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tickloom.llm.common import checkpointed, removed, short_batches, table
from tickloom.llm.components import components

WORDS, PERCENT = 4, 85
CACHE_WORDS = 200_000
#: Nodes whose parts a task remembers having sent, so that copies within it send nothing.
SENT_NODES = 500_000
#: Sides of so many rows of two numbers are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: Turns of stars at most, and the pairs a row across components beyond which they begin.
STARS, PAIRS_A_ROW = 6, 4
#: First sizes of the bands. Narrow bands have a tight D, but more sets are guests in them.
BAND_STARTS = sorted({int(1.4**i) for i in range(80)})
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_word_hashes = _WordHashes()


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = h + np.uint64(salt) * _M1
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a shorter text is one shingle, an empty one has none."""
    split = text.encode().lower().split() if text else []
    if not split:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_word_hashes.__getitem__, split), dtype=np.uint64, count=len(split))
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        h = _mix(h ^ w[i : len(w) - k + 1 + i], i)
    return np.unique(h)


def node_of(s: np.ndarray) -> int:
    """Digest of a set as a signed 64-bit number."""
    with np.errstate(over="ignore"):
        total = _mix(s, 77).sum(dtype=np.uint64) + np.uint64(len(s))
        return int(_mix(np.array([total], dtype=np.uint64), 78).view(np.int64)[0])


def bit_sketch(s: np.ndarray) -> list[int]:
    """256 parity bits, as four signed numbers."""
    bits = np.bincount((_mix(s, 79) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(bool), bitorder="little").view("<i8").tolist()


def most_apart(a: int, b: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of similar sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


def bands(n: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(band, D) of a set of n members: its own band and those below that have similar sets, and D for the largest pair."""
    band, out = bisect_right(BAND_STARTS, n) - 1, []
    while band >= 0 and 100 * (largest := BAND_STARTS[band + 1] - 1) >= percent * n:
        out.append((band, most_apart(largest, largest * 100 // percent, percent)))
        band -= 1
    return out


def part_keys(s: np.ndarray, band: int, apart: int) -> tuple[np.ndarray, int]:
    """Keys of a set's parts in a band, and how many of them are beyond the D + 1 that must be looked at.

    Parts without shingles come last in the order of rarity, so they are sent only if needed.
    """
    spare = max(apart // 5, min(apart, 8)) + 1
    parts = apart + 1 + (spare if apart else 0)
    at = (_mix(s, 80) % np.uint64(parts)).astype(np.int64)
    xor = np.zeros(parts, dtype=np.uint64)
    np.bitwise_xor.at(xor, at, _mix(s, 81))
    full = np.bincount(at, minlength=parts) > 0
    numbers = np.arange(parts, dtype=np.uint64) + np.uint64((band + 1) << 32)
    keys = _mix(xor ^ _mix(numbers, 82), 83)
    used = keys[full]
    if len(used) <= apart:
        used = np.concatenate([used, keys[~full][: apart + 1 - len(used)]])
    return used.view(np.int64), len(used) - apart - 1


def _members(text_col: str, words: int):
    @pandas_udf("n int, node bigint, sketch array<bigint>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for texts in batches:
                sets = [shingles(t, words) for t in texts]
                yield pd.DataFrame({"n": [len(s) for s in sets], "node": [node_of(s) for s in sets], "sketch": [bit_sketch(s) for s in sets]})

    return measure(F.col(text_col))


def _send_parts(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    sent: set[int] = set()
    with np.errstate(over="ignore"):
        for batch in batches:
            keys, nodes, tags = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for text in batch.column(0).to_pylist():
                s = shingles(text, words)
                node = node_of(s)
                if not len(s) or node in sent:
                    continue
                if len(sent) < SENT_NODES:
                    sent.add(node)
                for band, apart in bands(len(s), percent):
                    k, spare = part_keys(s, band, apart)
                    keys.append(k)
                    nodes.append(np.full(len(k), node))
                    tags.append(np.full(len(k), band << 24 | spare, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, tags)], ["key", "node", "tag"])


def rare_parts(docs: DataFrame, text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, node, pop) of the parts over which classes must meet; keys that one class alone has are gone.

    ``pop`` is large for classes whose parts many others have: the middle of a group of copies.
    """
    rows = docs.select(F.col(text_col).alias("t")).mapInArrow(lambda batches: _send_parts(batches, words, percent), "key bigint, node bigint, tag int")
    same = Window.partitionBy("key")
    counted = rows.select("*", F.count(F.lit(1)).over(same).alias("c"), F.min("node").over(same).alias("lo"), F.max("node").over(same).alias("hi"))
    shared = counted.where("lo < hi").select("key", "node", "tag", "c").dropDuplicates(["key", "node", "tag"])
    mine = Window.partitionBy("node", F.shiftright("tag", 24))
    spare = F.col("tag").bitwiseAND((1 << 24) - 1)
    return (
        shared.withColumn("place", F.row_number().over(mine.orderBy("c", "key")))
        .withColumn("all", F.count(F.lit(1)).over(mine))
        .withColumn("pop", F.sum("c").over(mine))
        .where(F.col("place") <= F.col("all") - spare)
        .groupBy("key", "node")
        .agg(F.max("pop").alias("pop"))
    )


def _set_bytes(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    sent: set[int] = set()
    with np.errstate(over="ignore"):
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(*(c.to_pylist() for c in batch.columns)):
                if node in sent:
                    continue
                s = shingles(text, words)
                if node_of(s) == node:
                    if len(sent) < SENT_NODES:
                        sent.add(node)
                    nodes.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "members"])


def _difference(a: str, b: str) -> Column:
    """The members that just one of two sets has."""

    @pandas_udf("apart int, members array<bigint>")
    def difference(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = [np.setxor1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True) for x, y in zip(a, b)]
        return pd.DataFrame({"apart": [len(x) for x in out], "members": out})

    return difference(a, b)


def _apart(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


class NearDuplicates:
    """The join over one table: ``members`` has every document, ``links`` similar classes."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, percent: int = PERCENT):
        spark = docs.sparkSession
        short_batches(spark)
        self.spark, self.words, self.percent = spark, words, percent
        #: ``at`` finds a class's text again; ids may be null or repeated over many texts.
        self.docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("at", F.xxhash64("id", "text"))
        measured = self.docs.select("id", "at", _members("text", words).alias("m")).select("id", "at", "m.*")
        self.members = checkpointed(spark, measured, "members")
        some = self.members.where("n > 0").groupBy("node")
        self.classes = checkpointed(spark, some.agg(F.min("id").alias("id"), F.min("at").alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
        self.parts = checkpointed(spark, rare_parts(self.docs, words=words, percent=percent), "parts")

    def similar(self, apart: Column, a: str, b: str) -> Column:
        """Whether sets of ``a`` and ``b`` members that are so far apart are similar."""
        return apart * (100 + self.percent) <= (100 - self.percent) * (F.col(a) + F.col(b))

    def pruned(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sizes and short sketches allow them to be similar."""
        for side in "ab":
            pairs = pairs.join(self.classes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
        size = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        return pairs.where(size & self.similar(_apart(F.col("sa"), F.col("sb")), "na", "nb")).select("a", "b")

    def texts(self, nodes: DataFrame) -> DataFrame:
        """(node, text) of classes, one text each but for repeated rows; where two texts have one hash, also the other's."""
        asked = checkpointed(self.spark, nodes.join(self.classes.select("node", "at"), "node"), "asked")
        asked = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
        return self.docs.join(asked, "at").select("node", "text")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of classes with their sizes na and nb, the members of their difference, and whether they are linked.

        Only the texts of classes in question are read on.
        """
        words, asked = self.words, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = self.texts(asked).mapInArrow(lambda batches: _set_bytes(batches, words), "node bigint, members binary")
        sets = checkpointed(self.spark, sets.dropDuplicates(["node"]), "sets")
        for side in "ba":
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("members").alias(f"m{side}"), F.expr("octet_length(members) div 8").alias(f"n{side}")), side)
        found = pairs.select("a", "b", "na", "nb", _difference("ma", "mb").alias("d")).select("a", "b", "na", "nb", "d.*")
        out = checkpointed(self.spark, found.withColumn("linked", self.similar(F.col("apart"), "na", "nb")), "compared")
        removed(self.spark, sets)
        return out

    def unresolved(self, parts: DataFrame, labels: DataFrame) -> DataFrame:
        """(a, b) of classes and hubs that share a part with classes of other components."""
        known = parts.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # A part of two classes has no pair but that of a class and its hub.
        spread = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("classes"))
        return known.join(spread.where("lo < hi AND classes > 2").select("key"), "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()

    def differences(self, spokes: DataFrame) -> DataFrame:
        """Rows (hub, member, node) of the rarest members of classes' differences from one hub, over which similar ones meet.

        Of a pair, x is the one farther from the hub. With d and e members in the differences of
        x and y, and at most D between x and y, t = (d + e - D) / 2 must be in both, so one is among
        the first d - t + 1 of x and the first e - t + 1 of y. ``outer`` and ``inner`` bound these
        over all partners that a class may have as x and as y; not both of a pair are linked with the hub.
        """
        p = self.percent
        r = (100 - p) / (100 + p)
        every = spokes.select(F.col("b").alias("hub"), F.col("a").alias("node"), F.col("na").alias("n"), F.col("nb").alias("h"), "apart", "linked", F.explode("members").alias("member"))
        shared = every.groupBy("hub", "member").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        mine = Window.partitionBy("hub", "node")
        first = F.col("apart") - F.count(F.lit(1)).over(mine)  # members that no other difference has come first
        rows = every.join(shared, ["hub", "member"]).withColumn("place", first + F.row_number().over(mine.orderBy("c", "member")))
        most = F.lit(r) * (F.col("n") + F.floor(F.col("n") * 100 / p))
        near = (F.col("apart") + r * (F.col("n") - F.col("h"))) / 2
        outer = F.when(F.col("linked"), near).otherwise(most)
        inner = F.when(F.col("linked"), F.least(near, most / 2)).otherwise(most / 2)
        kept = rows.select("hub", "member", "node", "n", "apart", "linked", "place", (F.col("place") <= inner + 1).alias("is_inner"), outer.alias("outer"))
        return checkpointed(self.spark, kept.where("place <= outer + 1").drop("outer"), "differences")

    def crossing(self, rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
        """Rows whose (hub, member) has classes of several components, with theirs; how many rows, and pairs across components."""
        known = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        parts = known.groupBy("hub", "member", "component").agg(F.count(F.lit(1)).alias("c"), F.max("is_inner").alias("is_inner"))
        sizes = parts.groupBy("hub", "member").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("within"), F.count(F.lit(1)).alias("of"), F.max("is_inner").alias("is_inner"))
        several = checkpointed(self.spark, sizes.where("of > 1 AND is_inner").select("hub", "member", "c", ((F.col("c") * F.col("c") - F.col("within")) / 2).cast("bigint").alias("pairs")), "several")
        total = several.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
        out = checkpointed(self.spark, known.join(several.select("hub", "member"), ["hub", "member"]), "crossing")
        removed(self.spark, several)
        return out, total[0], total[1]

    def star(self, rows: DataFrame, turn: int) -> DataFrame:
        """Links (a, b) between one class of each (hub, member), another one every turn, and those of other components."""
        one = rows.groupBy("hub", "member").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "component")).alias("one"))
        pairs = rows.join(one, ["hub", "member"]).where("component <> one.component").select(F.least("node", "one.node").alias("a"), F.greatest("node", "one.node").alias("b")).distinct()
        return self.compared(checkpointed(self.spark, self.pruned(pairs), "stars")).where("linked").select("a", "b")

    def meetings(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components that share one of the rarest members of their differences from one hub."""
        p = self.percent
        columns = ("node", "n", "apart", "linked", "place", "component")
        x = rows.select("hub", "member", *(F.col(c).alias(f"{c}_x") for c in columns))
        y = rows.where("is_inner").select("hub", "member", *(F.col(c).alias(f"{c}_y") for c in columns))
        farther = F.struct("apart_x", "node_x") > F.struct("apart_y", "node_y")
        size = 100 * F.least("n_x", "n_y") >= p * F.greatest("n_x", "n_y")
        both = F.greatest(F.lit(1), F.ceil((F.col("apart_x") + F.col("apart_y") - F.floor((100 - p) * (F.col("n_x") + F.col("n_y")) / (100 + p))) / 2))
        reach = (F.col("place_x") <= F.col("apart_x") - both + 1) & (F.col("place_y") <= F.col("apart_y") - both + 1)
        apart = (F.col("component_x") != F.col("component_y")) & ~(F.col("linked_x") & F.col("linked_y"))
        found = x.join(y, ["hub", "member"]).where(apart & farther & size & reach)
        return found.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()

    def candidates(self, spokes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) that are still to be compared, and labels after the stars.

        Members that one component alone has are passed over. While the others would make more
        than ``PAIRS_A_ROW`` pairs a row across components, stars of linear size merge components
        first, as long as a turn finds a link.
        """
        rows = self.differences(spokes)
        crossing, n, pairs = self.crossing(rows, labels)
        for turn in range(STARS):
            if pairs <= PAIRS_A_ROW * n:
                break
            found = checkpointed(self.spark, self.star(crossing, turn), "found")
            if found.isEmpty():
                break
            labels = components(labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(found))
            removed(self.spark, crossing)
            crossing, n, pairs = self.crossing(rows, labels)
        removed(self.spark, rows)
        return checkpointed(self.spark, self.pruned(self.meetings(crossing)), "candidates"), labels

    def components(self) -> DataFrame:
        """(node, component) of all classes that are linked with others."""
        spark = self.spark
        hubs = self.parts.groupBy("key").agg(F.max(F.struct("pop", "node")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
        parts = checkpointed(spark, self.parts.join(hubs.select("key", F.col("hub.node").alias("hub")), "key").select("key", "node", "hub"), "hubs")
        removed(spark, self.parts)
        spokes = self.compared(checkpointed(spark, parts.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), "spokes"))
        labels = components(spokes.where("linked").select("a", "b"))
        left = checkpointed(spark, self.unresolved(parts, labels), "left")
        removed(spark, parts)
        pairs, labels = self.candidates(spokes.join(left, ["a", "b"]), labels)
        late = self.compared(pairs).where("linked").select("a", "b")
        removed(spark, spokes, left)
        # Earlier components count as links of their members, so few rounds are left.
        return components(labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).union(late))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: its id, ``n_shingles`` and ``component_id``, the least id reachable over links.

    Texts link whose sets of shingles of ``words`` words are similar to ``percent`` or more.

    Documents with equal sets link; null and empty texts link with nothing and are their own
    component, as are documents of no link. A null id belongs to its texts' component but is
    never its least id. Repeated rows stay. Other columns are not read.
    """
    joined = NearDuplicates(docs, id_col, text_col, words, percent)
    found = joined.components()
    least = joined.classes.join(found, "node").groupBy("component").agg(F.min("id").alias("least"))
    of_node = joined.classes.select("node", "id").join(found, "node", "left").join(least, "component", "left").select("node", F.coalesce("least", "id").alias("least"))
    return joined.members.join(of_node, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("least", "id").alias("component_id")
    )


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document; null and empty texts link with nothing."""
    return near_duplicates(table(spark, sf_dir, "documents"))
