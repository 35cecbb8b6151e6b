"""What a live component is told: the channels it listens to, and the bars that make it take a step."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.resolution import Resolution


def channel(kind: Column | str, symbol: Column, detail: Column | None = None) -> Column:
    """A venue's name of a channel: its kind, a period or depth where it has one, and the symbol, joined by dots; null without a symbol."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    parts = [kind] if detail is None else [kind, detail.cast("string")]
    return F.when(symbol.isNotNull(), F.concat_ws(".", *parts, symbol))


def subscriptions(channels: DataFrame, group: str, order: str, name: str, most: int) -> DataFrame:
    """Requests of at most ``most`` channels: (group, ``chunk`` from 0, ``names`` in order). Repeats within a group are asked for once.

    A venue's connection has a few thousand channels; a group is numbered in one sorted window.
    """
    if most < 1:
        raise ValueError("a request has one channel at least")
    once = channels.where(F.col(name).isNotNull()).groupBy(group, name).agg(F.min(order).alias("_order"))
    placed = once.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(group).orderBy("_order", name)) - 1) / most))
    lists = placed.groupBy(group, "chunk").agg(F.array_sort(F.collect_list(F.struct("_order", F.col(name).alias("name")))).alias("_list"))
    return lists.select(group, "chunk", F.col("_list.name").alias("names"))


def steps(bars: DataFrame, resolution: str, now: dt.datetime | Column, form: str = "long", products: list[str] | None = None, warmup: int = 1) -> DataFrame:
    """The bars at which a component takes a step, of those of all resolutions that have arrived by ``now``.

    Only bars of its own resolution that have ended count: an open bar, or one of another
    resolution, makes no step. A long component steps for each product once the product has
    ``warmup`` closed bars; a wide one steps at dates at which all ``products`` have a closed bar,
    from its ``warmup``-th such date on.
    """
    if form not in ("long", "wide"):
        raise ValueError("a form is long or wide")
    if warmup < 1:
        raise ValueError("a component needs one bar at least")
    r = Resolution(resolution)
    end = F.col("date") + F.expr(f"INTERVAL {r.seconds()} SECONDS")
    limit = now if isinstance(now, Column) else F.lit(now)
    closed = bars.where((F.col("resolution") == str(r)) & (end <= limit))
    if form == "long":
        n = F.row_number().over(Window.partitionBy("product").orderBy("date"))
        return closed.withColumn("_n", n).where(F.col("_n") >= warmup).drop("_n")
    if not products:
        raise ValueError("a wide component knows its products")
    mine = closed.where(F.col("product").isin(products))
    whole = mine.groupBy("date").agg(F.count_distinct("product").alias("_of")).where(F.col("_of") == len(set(products)))
    # One row a date: dates are few beside ticks.
    ready = whole.withColumn("_n", F.row_number().over(Window.orderBy("date"))).where(F.col("_n") >= warmup).select("date")
    return mine.join(ready, "date").select(*bars.columns)


def missed(signals: DataFrame, bars: DataFrame, names: list[str]) -> DataFrame:
    """Bars with children's signals of the same product and date, null where a child has given none, and ``n_missing``.

    Either side has a key once. For streams, where a child may be late, see ``signal_joins``.
    """
    joined = bars.join(signals.select("date", "product", *names), ["date", "product"], "left")
    return joined.withColumn("n_missing", sum((F.col(n).isNull().cast("int") for n in names), F.lit(0)))
