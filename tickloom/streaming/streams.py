"""Live bars: replayed sources, tumbling bars with a watermark, cascades, upserts and the event-driven backtest."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.resolution import Resolution
from tickloom.operators.bars import shift_seconds
from tickloom.operators.product_backtest import DEFAULTS, RESULT, Machine
from tickloom.session import shared_path


#: Rows of a time slice that one task writes.
SLICE_ROWS = 1_000_000


def replay(spark: SparkSession, df: DataFrame, time_col: str, files: int = 4) -> DataFrame:
    """A stream of ``df`` in order of time, one of ``files`` equal slices of time to a micro-batch.

    Slices are written one after another, as the times of their files order them, and each by a
    task for every ``SLICE_ROWS`` rows of a mean slice. Where there are several, a slice of few
    rows may have fewer files, and its micro-batch then begins with the next slice's.
    """
    path = shared_path(spark, "replay")
    t = F.col(time_col).cast("timestamp")
    cuts = df.select(F.min(t).alias("a"), F.max(t).alias("b"), F.count(F.lit(1)).alias("n")).first()
    width = (cuts["b"] - cuts["a"]) / files if cuts["a"] is not None else None
    tasks = cuts["n"] // (files * SLICE_ROWS) + 1
    for k in range(files if width is not None else 1):
        part = df
        if width is not None:
            part = df.where(t >= F.lit(cuts["a"] + k * width)) if k else df
            part = part.where(t < F.lit(cuts["a"] + (k + 1) * width)) if k + 1 < files else part
        (part.repartition(tasks) if tasks > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", tasks).parquet(path)


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives what it has written."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    sink = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def stream_ohlcv(ticks: DataFrame, resolution: str, wait_seconds: float | None = None, shift: int = 0) -> DataFrame:
    """Bars of a stream of ticks (ts TIMESTAMP). A bar is given out once, when the watermark passes its end.

    Late ticks are waited for a tenth of a bar unless told otherwise, and then left out.
    """
    r = Resolution(resolution)
    s = r.seconds()
    wait = s / 10 if wait_seconds is None else wait_seconds
    order = F.struct("ts", "seq")
    return (
        ticks.withWatermark("ts", f"{wait} seconds")
        .groupBy("product", F.window("ts", f"{s} seconds", f"{s} seconds", f"{shift_seconds(r, shift)} seconds").alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"))
        .withColumn("end", F.window_time("w"))
        .select(F.col("w.start").alias("date"), "product", F.lit(str(r)).alias("resolution"), "open", "high", "low", "close", "volume", "end", "w")
    )


def stream_resample(bars: DataFrame, resolution: str) -> DataFrame:
    """Coarser bars of a stream of bars; a finer bar counts at its end, so coarser ones close in time."""
    r = Resolution(resolution)
    return (
        bars.groupBy("product", F.window(F.window_time("w"), f"{r.seconds()} seconds").alias("v"))
        .agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))
        .select(F.col("v.start").alias("date"), "product", F.lit(str(r)).alias("resolution"), "open", "high", "low", "close", "volume")
    )


def deduplicated(stream: DataFrame, keys: list[str], time_col: str, wait: str) -> DataFrame:
    """Without repeats of a message within the wait."""
    return stream.withWatermark(time_col, wait).dropDuplicatesWithinWatermark(keys)


def upsert(batch: DataFrame, stored: DataFrame | None, keys: list[str], max_rows: int | None = None) -> DataFrame:
    """Stored rows with a batch merged in: a batch's columns replace those of its rows, nulls too, and other columns stay.

    At most ``max_rows`` rows of the latest dates are kept, of one date those of the least keys.
    """
    if stored is None:
        out = batch
    else:
        columns = list(dict.fromkeys(stored.columns + batch.columns))
        a, b = stored.alias("a"), batch.withColumn("_new", F.lit(True)).alias("b")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))

        def pick(c: str):
            if c not in batch.columns:
                return F.col(f"a.{c}").alias(c)
            return (F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in stored.columns else F.col(f"b.{c}")).alias(c)

        out = a.join(b, on, "full").select(*map(pick, columns))
    return out.orderBy(F.desc("date"), *keys).limit(max_rows) if max_rows else out


def batch_first(batch: DataFrame, streamed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where both have a row of the same keys, the batch's."""
    return batch.unionByName(streamed.join(batch.select(*keys).distinct(), keys, "left_anti").select(*batch.columns))


def latest(updates: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last state of each key by ``order``."""
    return updates.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns], F.max(order).alias(order))


def ready_dates(bars: DataFrame, n_products: int) -> DataFrame:
    """Dates on which all products have a bar, so that a wide row can be given out."""
    return bars.groupBy("date").agg(F.count_distinct("product").alias("n_products")).where(F.col("n_products") == n_products)


def on_batches(stream: DataFrame, hook: Callable[[DataFrame, int], None], every: str | None = None):
    """Starts a stream that gives each micro-batch to a hook; without an interval it runs over what is there."""
    path = shared_path(stream.sparkSession, "hook")
    sink = stream.writeStream.foreachBatch(hook).option("checkpointLocation", path)
    return (sink.trigger(processingTime=every) if every else sink.trigger(availableNow=True)).start()


def stream_machine(instructed: DataFrame) -> DataFrame:
    """The event-driven backtest: the batch backtest's machine, with its state kept between micro-batches.

    Rows come out when the next one is there, which may still write their stop price; bars of
    a product must come in order of date over micro-batches.
    """
    plain = instructed
    for name, default in DEFAULTS.items():
        if name not in plain.columns:
            plain = plain.withColumn(name, F.lit(default) if default is not None else F.lit(None).cast("double"))
    own = [f for f in instructed.schema.fields if f.name not in DEFAULTS and f.name not in RESULT]
    columns = [f.name for f in own] + list(RESULT)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", " + ", ".join(f"{c} double" for c in RESULT)

    def advance(_key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine, held = pickle.loads(state.get[0]) if state.exists else (Machine(), None)
        bars = pd.concat(frames).sort_values("date")
        done = []
        for bar in bars.to_dict("records"):
            result, stop = machine.step(bar)
            if held is not None:
                held["stop_price"] = stop
                done.append(held)
            held = {**{c: bar[c] for c in columns if c not in RESULT}, **result}
        state.update((pickle.dumps((machine, held)),))
        yield pd.DataFrame(done, columns=columns)

    return plain.groupBy("product", "resolution").applyInPandasWithState(advance, schema, "state binary", "append", GroupStateTimeout.NoTimeout)
