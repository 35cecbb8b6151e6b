"""Bars meet the signals that child components made of the same bar, if these come in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds that a bar waits for its children's signals.
SIGNAL_WAIT = 5.0


def signals_in_time(bars: DataFrame, signals: DataFrame, components: Sequence[str], wait_seconds: float = SIGNAL_WAIT, disorder: str = "0 seconds") -> DataFrame:
    """A row for each bar and expected component, and one for each signal that is dropped.

    ``bars`` have (product, bar_end, ...), ``signals`` (product, component, bar_end, sent, value).
    A signal counts for the bar whose end it is stamped with if it was sent from that moment to
    ``wait_seconds`` later. ``status`` is ``joined``; ``alone`` where a bar went on without; or
    ``stale`` for signals of another bar, sent too late, or of components that nobody waits for.
    Both sides forget rows once the watermark, behind by ``disorder``, has passed the wait. Rows
    without a key are stale or alone. Frames that are no streams are joined the same way.
    """
    clash = set(bars.columns) & {"component", "sent", "value", "status"}
    if clash:
        raise ValueError(f"bars have columns of the result: {sorted(clash)}")
    spine = bars.withColumn("component", F.explode(F.array(*map(F.lit, components))))
    if bars.isStreaming:
        spine, signals = spine.withWatermark("bar_end", disorder), signals.withWatermark("sent", disorder)
    b, s = spine.alias("b"), signals.select("product", "component", "bar_end", "sent", "value").alias("s")
    same = (F.col("b.product") == F.col("s.product")) & (F.col("b.component") == F.col("s.component")) & (F.col("b.bar_end") == F.col("s.bar_end"))
    wait = F.expr(f"INTERVAL {wait_seconds} SECONDS")
    in_time = (F.col("s.sent") >= F.col("b.bar_end")) & (F.col("s.sent") <= F.col("b.bar_end") + wait)
    joined = b.join(s, same & in_time, "full")
    status = F.when(F.col("b.bar_end").isNull() & F.col("s.sent").isNotNull(), "stale").when(F.col("s.sent").isNull(), "alone").otherwise("joined")
    keys = [F.coalesce(F.col(f"b.{c}"), F.col(f"s.{c}")).alias(c) for c in ("product", "component", "bar_end")]
    own = [F.col(f"b.{c}").alias(c) for c in bars.columns if c not in ("product", "bar_end")]
    return joined.select(*keys, *own, F.col("s.sent").alias("sent"), F.col("s.value").alias("value"), status.alias("status"))


def dropped(joined: DataFrame) -> DataFrame:
    """How many signals of each product and component did not count."""
    return joined.where("status = 'stale'").groupBy("product", "component").agg(F.count(F.lit(1)).alias("n_dropped"))
