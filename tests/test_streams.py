import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.session import shared_path
from tickloom.streaming import idle_bars, order_books, partial_bars, signal_joins, streams

T0 = dt.datetime(2024, 1, 1)
MESSAGES = [
    ("a", 1, "delta", [(10.0, 1.0)], None),
    ("a", 2, "snapshot", [(9.0, 2.0), (8.0, 1.0), (7.0, 5.0)], [(11.0, 1.0)]),
    ("a", 3, "delta", [(9.0, 0.0), (6.5, 3.0), (99.0, 0.0)], []),
    ("a", 3, "snapshot", [(9.5, 1.0)], [(10.5, 2.0)]),
    ("a", 2, "delta", [(1.0, 1.0)], None),
    ("a", 5, "quote", None, [(12.0, 4.0), (13.0, 0.0)]),
    ("a", 6, "snapshot", [], [(14.0, 1.0)]),
    ("b", 1, "quote", [(1.0, 1.0)], [(2.0, 2.0)]),
    (None, 1, "quote", [(1.0, 1.0)], None),
    ("b", None, "quote", [(1.0, 1.0)], None),
    ("b", 9, "other", [(1.0, 1.0)], None),
]
#: (book, seq, applied) -> best bids and asks, at most two a side.
WANT = [
    ("a", 1, True, [(10.0, 1.0)], []),
    ("a", 2, True, [(9.0, 2.0), (8.0, 1.0)], [(11.0, 1.0)]),
    ("a", 3, True, [(9.5, 1.0)], [(10.5, 2.0)]),
    ("a", 5, True, [(9.5, 1.0)], [(12.0, 4.0)]),
    ("a", 6, True, [], [(14.0, 1.0)]),
    ("b", 1, True, [(1.0, 1.0)], [(2.0, 2.0)]),
]


def messages(spark, rows):
    level = "array<struct<price: double, size: double>>"
    at = [(*r[:2], T0 + dt.timedelta(minutes=i), *r[2:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(at, f"book string, seq long, ts timestamp, kind string, bids {level}, asks {level}")


def books(df):
    return [(r.book, r.seq, r.applied, [tuple(x) for x in r.bids], [tuple(x) for x in r.asks]) for r in df.collect()]


def test_books_of_one_batch(spark):
    """Sorted by number, snapshots first: the delta of number 3 repeats a number and counts no more."""
    got = books(streams.collected(order_books.book_stream(streams.replay(spark, messages(spark, MESSAGES), "ts", files=1), depth=2)))
    assert sorted(r for r in got if r[2]) == sorted(WANT)
    assert sorted((r[0], r[1]) for r in got if not r[2]) == [("a", 2), ("a", 3)]


def test_books_over_micro_batches(spark):
    """One message a micro-batch: a delta may take away a price, and an older message comes too late."""
    replay = streams.replay(spark, messages(spark, MESSAGES), "ts", files=len(MESSAGES))
    got = books(streams.collected(order_books.book_stream(replay, depth=2)))
    first = ("a", 3, True, [(8.0, 1.0), (7.0, 5.0)], [(11.0, 1.0)])
    assert sorted(r for r in got if r[2]) == sorted([*WANT, first])
    assert [r for r in got if not r[2]] == [("a", 2, False, [(9.5, 1.0)], [(10.5, 2.0)])]


def test_no_messages(spark):
    none = messages(spark, MESSAGES).limit(0)
    assert streams.collected(order_books.book_stream(streams.replay(spark, none, "ts"))).count() == 0
    with pytest.raises(ValueError):
        order_books.book_stream(none)


def test_signals_in_time(spark):
    """On time, at either end of the wait, too late, too early, of another bar or component, repeated, and without a key."""
    end = T0 + dt.timedelta(hours=1)
    bars = spark.createDataFrame([("p", end, 1.0), ("q", end, 2.0), (None, end, 3.0)], "product string, bar_end timestamp, close double")
    at = lambda s: end + dt.timedelta(seconds=s)
    sent = [("p", "x", end, at(0), 1.0), ("p", "x", end, at(5), 2.0), ("p", "x", end, at(6), 3.0), ("p", "x", end, at(-1), 4.0), ("p", "z", end, at(1), 5.0), ("q", "x", T0, at(1), 6.0), (None, "x", end, at(1), 7.0), ("q", "y", end, at(1), None)]
    signals = spark.createDataFrame(sent, "product string, component string, bar_end timestamp, sent timestamp, value double")
    joined = signal_joins.signals_in_time(bars, signals, ["x", "y"]).collect()
    rows = sorted((str(r["product"]), r.component, r.status, r.value) for r in joined)
    want = [("None", "x", "alone", None), ("None", "x", "stale", 7.0), ("None", "y", "alone", None), ("p", "x", "joined", 1.0), ("p", "x", "joined", 2.0), ("p", "x", "stale", 3.0), ("p", "x", "stale", 4.0)]
    want += [("p", "y", "alone", None), ("p", "z", "stale", 5.0), ("q", "x", "alone", None), ("q", "x", "stale", 6.0), ("q", "y", "joined", None)]
    assert sorted(rows, key=str) == sorted(want, key=str)
    n = signal_joins.dropped(signal_joins.signals_in_time(bars, signals, ["x", "y"])).collect()
    assert sorted((str(r["product"]), r.component, r.n_dropped) for r in n) == [("None", "x", 1), ("p", "x", 2), ("p", "z", 1), ("q", "x", 1)]
    with pytest.raises(ValueError):
        signal_joins.signals_in_time(bars.withColumn("status", F.lit(1)), signals, ["x"])


def ticks(spark, rows):
    return spark.createDataFrame([(p, T0 + dt.timedelta(seconds=s), price, volume, seq) for seq, (p, s, price, volume) in enumerate(rows)], "product string, ts timestamp, price double, volume double, seq long")


def test_idle_bars_and_late_ticks(spark):
    """A product that falls silent, a tick after its bar is out, ties in time, and rows without a price or product."""
    rows = [("a", 0, 1.0, 1.0), ("a", 0, 3.0, None), ("a", 5, 2.0, 1.0), ("b", 1, 7.0, 1.0), ("a", 70, 4.0, 1.0), ("a", 80, None, 1.0), (None, 80, 1.0, 1.0)]
    late = ticks(spark, [*rows, ("a", 30, 9.0, 2.0)]).withColumn("arrived", F.when(F.col("seq") == 7, F.lit(T0 + dt.timedelta(seconds=200))).otherwise(F.col("ts")))
    replay = streams.replay(spark, late, "arrived", files=2)
    bars, aside = idle_bars.with_side_table(idle_bars.flushed_bars(replay, "1m", speed=60.0), 3.0)
    got = sorted((r["product"], r.date, r.open, r.high, r.low, r.close, r.volume) for r in bars.collect())
    minute = T0 + dt.timedelta(minutes=1)
    assert got == [("a", T0, 1.0, 3.0, 1.0, 2.0, 2.0), ("a", minute, 4.0, 4.0, 4.0, 4.0, 1.0), ("b", T0, 7.0, 7.0, 7.0, 7.0, 1.0)]
    assert [(r["product"], r.date, r.close, r.volume, r.seq) for r in aside.collect()] == [("a", T0, 9.0, 2.0, 7)]


def test_blocks_of_ticks_become_parts_of_bars(monkeypatch):
    """What reaches a product's task grows with blocks and bars, not with ticks, and holds every tick."""
    monkeypatch.setattr(idle_bars, "BLOCK_ROWS", 2_000)
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.randrange(-5, 15), i, rnd.randrange(99) / 4, 1.0) for i in range(10_000)]
    names = ("product", "micros", "seq", "price", "volume")
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 500])], names) for a in range(0, len(rows), 500)]
    parts = [r for b in idle_bars.bar_parts(10, 3)(iter(batches)) for r in b.to_pylist()]
    assert len(parts) <= 5 * 2 * 4 and {p["start"] for p in parts} == {-7, 3, 13}
    held = []
    for p in parts:
        ticks = np.frombuffer(p["ticks"], idle_bars.TICK).tolist()
        assert ticks == sorted(ticks) and all(p["start"] <= t[0] < p["start"] + 10 for t in ticks)
        prices = [t[2] for t in ticks]
        assert (p["open"], p["high"], p["low"], p["close"], p["volume"]) == (prices[0], max(prices), min(prices), prices[-1], len(ticks))
        assert ((p["first"], p["first_seq"]), (p["last"], p["last_seq"])) == (ticks[0][:2], ticks[-1][:2])
        held += [(p["product"], *t) for t in ticks]
    assert sorted(held) == sorted(rows)


def test_a_bar_has_one_part_of_scattered_ticks(spark):
    """Ticks of a bar lie in all tasks that read; a product's task has one row a bar, however many these are."""
    plain = spark.range(0, 12_000, 1, 6).selectExpr("if(id % 2 = 0, 'a', 'b') AS product", "id * 7 % 2000 - 500 AS micros", "id AS seq", "CAST(id % 9 AS DOUBLE) AS price", "1D AS volume")
    parts = idle_bars.parts_by_bar(plain, 10, 3).select("product", "start", "volume").collect()
    assert len(parts) == len({(p["product"], p.start) for p in parts}) and sum(p.volume for p in parts) == 12_000
    assert {p.start for p in parts} == set(range(-507, 1500, 10))


def test_states_have_few_tasks_whatever_shuffles_have(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(idle_bars, "shared_path", lambda _, what: f"file://{tmp_path}/{what}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        replay = streams.replay(spark, ticks(spark, [("a", 0, 1.0, 1.0), ("b", 70, 2.0, 1.0)]), "ts", files=1)
        bars, _ = idle_bars.with_side_table(idle_bars.flushed_bars(replay, "1m", speed=600.0), 1.0)
        assert bars.count() == 2 and spark.conf.get("spark.sql.shuffle.partitions") == "30"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 0 < len([p for p in tmp_path.glob("flushed/checkpoint/state/0/*") if p.name.isdigit()]) <= max(idle_bars.STATE_TASKS, spark.sparkContext.defaultParallelism)


def test_a_stream_without_ticks_ends(spark, monkeypatch):
    monkeypatch.setattr(idle_bars, "PATIENCE", 3.0)
    replay = streams.replay(spark, ticks(spark, []), "ts")
    bars, late = idle_bars.with_side_table(idle_bars.flushed_bars(replay, "1m"), 1.0)
    assert bars.count() == late.count() == 0 and bars.columns[:3] == ["date", "product", "resolution"] and "seq" in late.columns


def test_waits_are_shorter_than_bars(spark):
    with pytest.raises(ValueError):
        idle_bars.flushed_bars(ticks(spark, []), "1m", wait_seconds=60)
    with pytest.raises(ValueError):
        idle_bars.flushed_bars(ticks(spark, []), "1t")


def test_versions_of_open_bars(spark):
    rows = [("a", s, float(s % 7), 1.0) for s in range(0, 300, 10)]
    path = partial_bars.partial_bars(streams.replay(spark, ticks(spark, rows), "ts", files=4), "2m")
    every = partial_bars.versions(spark, path)
    last = {r.date: (r.open, r.high, r.low, r.close, r.volume) for r in partial_bars.last_versions(spark, path).collect()}
    assert sorted(v[-1] for v in last.values()) == [6.0, 12.0, 12.0] and every.count() > 3
    assert {r.date: r.volume for r in every.where("is_last").collect()} == {d: v[-1] for d, v in last.items()}
    volumes = [r.volume for r in every.orderBy("date", "version").collect()]
    assert volumes[0] < 12.0 and every.groupBy("date").agg(F.min("version").alias("v")).where("v <> 1").count() == 0


def test_a_repeated_batch_replaces_itself(spark):
    path = shared_path(spark, "versions")
    one = spark.createDataFrame([(T0, "a", "1_HOUR", 1.0)], "date timestamp, product string, resolution string, close double")
    for batch, df in ((0, one), (1, one.withColumn("close", F.lit(2.0))), (1, one.withColumn("close", F.lit(3.0)))):
        partial_bars.write_versions(df, path, batch)
    assert [r.close for r in partial_bars.last_versions(spark, path).collect()] == [3.0]
    assert [(r.version, r.close) for r in partial_bars.versions(spark, path).orderBy("version").collect()] == [(1, 1.0), (2, 3.0)]
