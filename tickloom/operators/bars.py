"""Bars from ticks and from finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.resolution import Resolution

#: Seconds of one step of a shift, and how many steps a bar may be shifted by.
SHIFTS = {"MINUTE": (1, 59), "HOUR": (60, 59), "DAY": (3600, 23)}


def shift_seconds(resolution: Resolution, shift: int) -> int:
    """Seconds of a shift: seconds into a minute, minutes into an hour, hours into a day."""
    if not shift:
        return 0
    if resolution.frame not in SHIFTS:
        raise ValueError(f"bars of {resolution!r} have no shift")
    step, most = SHIFTS[resolution.frame]
    if not 0 <= shift <= most:
        raise ValueError(f"the shift of {resolution!r} is at most {most}")
    return step * shift


def _window(ts: str, seconds: int, shift: int) -> Column:
    return F.window(ts, f"{seconds} seconds", f"{seconds} seconds", f"{shift} seconds")


def ohlcv(ticks: DataFrame, resolution: str, shift: int = 0, volume_mode: str = "delta") -> DataFrame:
    """Bars of ticks (product, ts, price, volume, seq); ties in time go by ``seq``.

    Volumes of ``delta`` mode are summed; in ``snapshot`` mode the last one counts. The
    aggregation is partial before its one shuffle, by product and bar.
    """
    r = Resolution(resolution)
    order = F.struct("ts", "seq")
    volume = F.sum("volume") if volume_mode == "delta" else F.max_by("volume", order)
    return (
        ticks.groupBy("product", _window("ts", r.seconds(), shift_seconds(r, shift)).alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), volume.alias("volume"))
        .select(F.col("w.start").alias("date"), "product", F.lit(str(r)).alias("resolution"), "open", "high", "low", "close", "volume")
    )


def resample(bars: DataFrame, resolution: str, shift: int = 0, volume_mode: str = "delta") -> DataFrame:
    """Coarser bars of finer ones."""
    r = Resolution(resolution)
    volume = F.sum("volume") if volume_mode == "delta" else F.max_by("volume", "date")
    return (
        bars.groupBy("product", _window("date", r.seconds(), shift_seconds(r, shift)).alias("w"))
        .agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), volume.alias("volume"))
        .select(F.col("w.start").alias("date"), "product", F.lit(str(r)).alias("resolution"), "open", "high", "low", "close", "volume")
    )


def skip_first(bars: DataFrame) -> DataFrame:
    """Without each product's first bar, which is rarely complete."""
    first = bars.groupBy("product", "resolution").agg(F.min("date").alias("_first"))
    return bars.join(first, ["product", "resolution"]).where(F.col("date") > F.col("_first")).drop("_first").select(*bars.columns)


def bar_start(epoch: Column, seconds: int, shift: int = 0, completed: bool = False) -> Column:
    """Start, in epoch seconds, of the bar that a time belongs to; a completed bar given by one time is the one before."""
    start = F.floor((epoch - shift) / seconds) * seconds + shift
    return start - seconds if completed else start


def bar_from_end(end: Column, seconds: int) -> Column:
    """Start of a bar from its end, be it the last millisecond of the bar or the first moment after it."""
    return F.floor(end + 0.5) - seconds


def bar_close(bars: DataFrame, resolution: str) -> DataFrame:
    """Bars with ``bar_close``, their last millisecond."""
    seconds = Resolution(resolution).seconds()
    return bars.withColumn("bar_close", F.col("date") + F.expr(f"INTERVAL {seconds} SECONDS") - F.expr("INTERVAL 0.001 SECOND"))


def last_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows by a total order; the sort keeps n rows a partition."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def ready(bars: DataFrame, warmup: int) -> DataFrame:
    """Bars from the ``warmup``-th of each product on."""
    w = Window.partitionBy("product", "resolution").orderBy("date")
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") >= warmup).drop("_n")
