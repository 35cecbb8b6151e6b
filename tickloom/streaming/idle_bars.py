"""Bars that are given out though no further tick comes, and ticks that come after their bar is out.

Each product has its open bar as state. A tick of a later bar closes it. Where none comes, a
timer does, by the clock: what is left of the bar when its last tick has been seen, and a wait of
a tenth of a bar unless told otherwise, at a replay's ``speed`` (seconds of data in a second). A
tick of a bar that is out already is late; it is given out as such instead of being lost.

Whether a tick is late depends on its product's state before its micro-batch alone, since a
micro-batch's ticks count in order of time. So ticks are first dealt out by bar, and tasks make
parts of bars of a block of ticks, each with its ticks as packed numbers; a product's task puts
parts together and opens the packed ticks of late parts only. What a task holds is a block of
ticks, or a row for each bar that a product has in a micro-batch.

A product's state is one bar, and each task of states costs a store and a Python worker in every
micro-batch, with products or without. So there are as many as the cluster runs at once, however
many partitions shuffles have.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.resolution import Resolution
from tickloom.operators.bars import shift_seconds
from tickloom.session import shared_path
from tickloom.streaming.order_books import keyed_state

#: Seconds more that a drained stream is given to come to a micro-batch at all.
PATIENCE = 60.0
#: Ticks of a block.
BLOCK_ROWS = 200_000
#: Tasks that keep products' states where the cluster has fewer cores.
STATE_TASKS = 8
PARTITIONS = "spark.sql.shuffle.partitions"
TICK = np.dtype([("micros", "<i8"), ("seq", "<i8"), ("price", "<f8"), ("volume", "<f8")])
BAR = "start bigint, seen bigint, open double, high double, low double, close double, volume double"
PART = "product string, start bigint, first bigint, first_seq bigint, last bigint, last_seq bigint, open double, high double, low double, close double, volume double, ticks binary"
OUTPUT = "start bigint, product string, open double, high double, low double, close double, volume double, kind string, micros bigint, seq bigint"


def _bar(product: str, bar: tuple) -> Row:
    start, _, *prices = bar
    return Row(start=start, product=product, **dict(zip(("open", "high", "low", "close", "volume"), prices)), kind="bar", micros=None, seq=None)


def _parts(batches: list[pa.RecordBatch], width: int, offset: int) -> pa.RecordBatch:
    """Parts of bars of a block of ticks (product, micros, seq, price, volume)."""
    product, *numbers = pa.Table.from_batches(batches).combine_chunks().columns
    products = product.combine_chunks().dictionary_encode()
    code = products.indices.to_numpy(zero_copy_only=False)
    ticks = np.empty(len(code), dtype=TICK)
    for name, column in zip(TICK.names, numbers):
        ticks[name] = column.to_numpy()
    order = np.lexsort((ticks["seq"], ticks["micros"], code))
    code, ticks = code[order], ticks[order]
    start = (ticks["micros"] - offset) // width * width + offset
    first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (start[1:] != start[:-1])])
    last = np.r_[first[1:], len(code)] - 1
    price = np.ascontiguousarray(ticks["price"])
    columns = [products.dictionary.take(pa.array(code[first])), start[first], ticks["micros"][first], ticks["seq"][first], ticks["micros"][last], ticks["seq"][last]]
    columns += [price[first], np.maximum.reduceat(price, first), np.minimum.reduceat(price, first), price[last], np.add.reduceat(ticks["volume"], first)]
    columns.append(pa.array([ticks[a : b + 1].tobytes() for a, b in zip(first.tolist(), last.tolist())], pa.binary()))
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in PART.split(", ")])


def bar_parts(width: int, offset: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parts of bars of a task's ticks, block by block."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield _parts(held, width, offset)
                held, n = [], 0
        if n:
            yield _parts(held, width, offset)

    return parts


def parts_by_bar(ticks: DataFrame, width: int, offset: int) -> DataFrame:
    """Parts of bars of ticks (product, micros, seq, price, volume). One task has all ticks of a bar, so a bar has a part for each of its task's blocks."""
    start = F.col("micros") - F.pmod(F.col("micros") - F.lit(offset), F.lit(width))
    tasks = int(ticks.sparkSession.conf.get(PARTITIONS))
    return ticks.repartition(tasks, "product", start).mapInArrow(bar_parts(width, offset), PART)


@contextmanager
def tasks_of_states(spark: SparkSession) -> Iterator[None]:
    """Streams that start meanwhile keep states in as many tasks as run at once; a stream has its own copy of the setting."""
    before = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(min(int(before), max(spark.sparkContext.defaultParallelism, STATE_TASKS))))
    try:
        yield
    finally:
        spark.conf.set(PARTITIONS, before)


class OpenBars(StatefulProcessor):
    """A product's open bar, and the start of the first bar that is not out yet."""

    def __init__(self, width: int, wait: float, speed: float):
        self.width, self.wait, self.speed = width, wait, speed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", BAR)
        self.after = handle.getValueState("after", "start bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        product, width = key[0], self.width
        bar = tuple(self.bar.get()) if self.bar.exists() else None
        after = self.after.get()[0] if self.after.exists() else None
        fresh = {}
        for r in rows:
            if after is not None and r.start < after:
                for micros, seq, price, volume in np.frombuffer(r.ticks, TICK).tolist():
                    yield Row(start=r.start, product=product, open=None, high=None, low=None, close=price, volume=volume, kind="late", micros=micros, seq=seq)
                continue
            first, last = (r.first, r.first_seq, r.open), (r.last, r.last_seq, r.close)
            if r.start in fresh:
                a, b, high, low, volume = fresh[r.start]
                fresh[r.start] = (min(a, first), max(b, last), max(high, r.high), min(low, r.low), volume + r.volume)
            else:
                fresh[r.start] = (first, last, r.high, r.low, r.volume)
        for start in sorted(fresh):
            first, last, high, low, volume = fresh[start]
            if bar is not None and start == bar[0]:
                bar = (start, last[0], bar[2], max(bar[3], high), min(bar[4], low), last[2], bar[6] + volume)
            else:
                if bar is not None:
                    yield _bar(product, bar)
                bar, after = (start, last[0], first[2], high, low, last[2], volume), start
        if bar is not None:
            self.bar.update(bar)
            self.after.update((after,))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            left = (bar[0] + width - bar[1]) / 1e6 + self.wait
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, int(1000 * left / self.speed)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.bar.exists():
            bar = tuple(self.bar.get())
            self.bar.clear()
            self.after.update((bar[0] + self.width,))
            yield _bar(key[0], bar)

    def close(self) -> None:
        pass


def flushed_bars(ticks: DataFrame, resolution: str, wait_seconds: float | None = None, shift: int = 0, speed: float = 1.0) -> DataFrame:
    """Bars and late ticks of a stream (product, ts, price, volume, seq); ``kind`` is ``bar`` or ``late``.

    A bar comes out once. A late tick has its bar's ``date``, its price as ``close``, and its
    ``ts`` and ``seq``. Ticks without a product, time or price are left out; a null volume is 0.
    """
    r = Resolution(resolution)
    if not r.is_bar:
        raise ValueError("bars have a resolution of bars")
    s = r.seconds()
    wait = s / 10 if wait_seconds is None else wait_seconds
    if not 0 <= wait < s:
        raise ValueError("the wait is shorter than a bar")
    keyed_state(ticks.sparkSession)
    known = ticks.dropna(subset=["product", "ts", "price"])
    volume, seq = F.coalesce(F.col("volume").cast("double"), F.lit(0.0)), F.coalesce(F.col("seq").cast("bigint"), F.lit(0))
    plain = known.select(F.col("product").cast("string").alias("product"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), seq.alias("seq"), F.col("price").cast("double").alias("price"), volume.alias("volume"))
    parts = parts_by_bar(plain, s * 1_000_000, shift_seconds(r, shift) * 1_000_000)
    bars = parts.groupBy("product").transformWithState(OpenBars(s * 1_000_000, wait, speed), OUTPUT, "append", "ProcessingTime")
    return bars.select(F.timestamp_micros("start").alias("date"), "product", F.lit(str(r)).alias("resolution"), "open", "high", "low", "close", "volume", "kind", F.timestamp_micros("micros").alias("ts"), "seq")


def with_side_table(stream: DataFrame, idle_seconds: float) -> tuple[DataFrame, DataFrame]:
    """Runs a stream of bars and late ticks until it gives nothing more for so long: (bars, late ticks).

    Each micro-batch goes into a folder of its own in either table, which a repeated batch
    overwrites, so a batch that is run again after a failure leaves no row twice.
    """
    spark = stream.sparkSession
    path = shared_path(spark, "flushed")
    busy = [0, time.monotonic()]  # the last micro-batch that read or gave rows, and when
    started = [False]

    def write(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        rows.where("kind = 'bar'").drop("kind", "ts", "seq").write.mode("overwrite").parquet(f"{path}/bars/batch={batch}")
        rows.where("kind = 'late'").drop("open", "high", "low", "kind").write.mode("overwrite").parquet(f"{path}/late/batch={batch}")
        started[0] = True
        if not rows.isEmpty():
            busy[:] = batch, time.monotonic()
        rows.unpersist()

    with tasks_of_states(spark):
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime="1 second").start()
    try:
        while not query.awaitTermination(0.1):
            # A stream with timers always has a next micro-batch, so there is no moment when all is processed.
            done, idle = query.lastProgress, time.monotonic() - busy[1]
            if query.status["isDataAvailable"] or (done and done["numInputRows"]):
                busy[:] = done["batchId"] if done else 0, time.monotonic()
            elif idle > idle_seconds and (idle > idle_seconds + PATIENCE or (done and done["batchId"] > busy[0] + 2)):
                # Best between two micro-batches; one that is cut off has nothing to give.
                if not query.status["isTriggerActive"] or idle > idle_seconds + 2:
                    break
    finally:
        query.stop()
    bars, late = (T.StructType([f for f in stream.schema if f.name not in gone]) for gone in (("kind", "ts", "seq"), ("open", "high", "low", "kind")))
    return tuple(spark.read.schema(kept).parquet(f"{path}/{name}/*") if started[0] else spark.createDataFrame([], kept) for name, kept in (("bars", bars), ("late", late)))
