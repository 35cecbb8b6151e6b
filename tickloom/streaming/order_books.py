"""Order books kept as state of a stream.

A message has a book, a time, a sequence number, a kind and two sides, arrays of (price, size):

- ``snapshot``: both sides are replaced, also by nothing;
- ``delta``: a size of 0 takes a price away, any other one sets it; prices that are not there may be taken away;
- ``quote``: a side that has levels is replaced, a null or empty one stays as it was.

A message whose sequence number is not above the book's last one has come too late and changes
nothing; only a snapshot may repeat the number. The state has an entry for each price, so a
micro-batch writes only the prices that it changes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEVELS = "array<struct<price double, size double>>"
OUTPUT = f"book string, seq bigint, ts timestamp, applied boolean, bids {LEVELS}, asks {LEVELS}"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Streams with map state and timers keep it in RocksDB, on the executors' disks and in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Books(StatefulProcessor):
    """One book's levels, and the last sequence number that counted."""

    def __init__(self, depth: int | None):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double", "size double")
        self.last = handle.getValueState("last", "seq bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = {tuple(k): v[0] for k, v in self.levels.iterator()}
        sides = {"bid": {}, "ask": {}}
        for (side, price), size in stored.items():
            sides[side][price] = size
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        # A snapshot comes before a delta of its own number.
        for r in sorted(rows, key=lambda r: (r.seq, r.kind != "snapshot", r.ts)):
            applied = last is None or r.seq > last or (r.seq == last and r.kind == "snapshot")
            if applied:
                last = r.seq
                sides = {side: _changed(sides[side], r.kind, given) for side, given in (("bid", r.bids), ("ask", r.asks))}
            out.append(Row(book=key[0], seq=r.seq, ts=r.ts, applied=applied, bids=self._best(sides["bid"], True), asks=self._best(sides["ask"], False)))
        now = {(side, price): size for side, levels in sides.items() for price, size in levels.items()}
        for gone in stored.keys() - now.keys():
            self.levels.removeKey(gone)
        for level, size in now.items():
            if stored.get(level) != size:
                self.levels.updateValue(level, (size,))
        if last is not None:
            self.last.update((last,))
        yield from out

    def _best(self, levels: dict, highest: bool) -> list[dict]:
        return [{"price": p, "size": levels[p]} for p in sorted(levels, reverse=highest)[: self.depth]]

    def close(self) -> None:
        pass


def _changed(levels: dict, kind: str, given) -> dict:
    new = {x["price"]: x["size"] for x in given or []}
    if kind == "delta":
        new = levels | new
    elif kind == "quote" and not new:
        return levels
    return {p: s for p, s in new.items() if s}


def book_stream(messages: DataFrame, depth: int | None = None) -> DataFrame:
    """The book after each message (book, ts, seq, kind, bids, asks), its best ``depth`` levels on either side, best first.

    ``applied`` is false for messages that came too late. Messages without a book, number or kind
    are left out. A book's messages of one micro-batch are sorted by number; those of a later one
    that are older come too late. A table's last books are those of ``functions.books.book_state``.
    """
    if not messages.isStreaming:
        raise ValueError("books are kept over a stream of messages")
    keyed_state(messages.sparkSession)
    known = messages.where("book IS NOT NULL AND seq IS NOT NULL AND kind IN ('snapshot', 'delta', 'quote')")
    plain = known.select(F.col("book").cast("string").alias("book"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("bigint").alias("seq"), "kind", F.col("bids").cast(LEVELS).alias("bids"), F.col("asks").cast(LEVELS).alias("asks"))
    return plain.groupBy("book").transformWithState(Books(depth), OUTPUT, "append", "None")


def best(levels: Column, n: int = 0) -> Column:
    """The n-th best level of a side, (price, size), from 0; null where there are fewer."""
    return F.get(levels, n)
