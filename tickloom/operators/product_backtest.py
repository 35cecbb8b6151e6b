"""Backtest of instructions, product by product.

Market orders at the close without stops have a closed form and run as windows. Anything
else is a state machine over a product's bars in order of date. Bars are shuffled by product
and sorted, and the machine walks each partition batch by batch with one product's state
in hand, so that a long history never has to fit into memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.signals import with_changes

RESULT = ("signal", "order_price", "order_size", "trade_price", "trade_size", "position", "avg_price", "stop_price")
#: Instruction columns and what holds where they are not given.
DEFAULTS = {
    "order_price": None, "order_quantity": None, "first_only": False, "long_only": False, "short_only": False, "entry_fill": "close",
    "exit_fill": "close", "take_profit": None, "stop_loss": None, "trailing_stop": None, "time_window": None, "covered": True,
}


def _given(x) -> bool:
    return x is not None and x == x


@dataclass
class Machine:
    """State of one product between bars."""

    position: float = 0.0
    cost: float = 0.0
    bars: int = 0
    best: float = 0.0
    order: tuple[float, float] | None = None
    stop: float | None = None
    target: float | None = None
    timed_out: bool = False
    last_signal: float | None = None
    traded: bool = False
    before: dict | None = field(default=None, repr=False)

    @property
    def average(self) -> float:
        return self.cost / self.position if self.position else 0.0

    @staticmethod
    def _reached(level: float, down: bool, bar: dict, close: float) -> str | None:
        """How a level was reached since the last close: at once, over a gap, or within the bar."""
        if close <= level if down else close >= level:
            return "at once"
        if bar["open"] < level if down else bar["open"] > level:
            return "gap"
        if bar["low"] <= level if down else bar["high"] >= level:
            return "inside"
        return None

    def _fill(self, bar: dict) -> tuple[float, float, float | None, bool] | None:
        """(price, size, stop level, whether it is the order) of this bar's one trade."""
        before = self.before
        close = before["close"]
        late_exit, late_entry = before["exit_fill"] == "open", before["entry_fill"] == "open"
        how, level, down = None, None, False
        if self.stop is not None:
            level, down = self.stop, self.position > 0
            how = self._reached(level, down, bar, close)
        if how is None and self.target is not None:
            level, down = self.target, self.position < 0
            how = self._reached(level, down, bar, close)
        if how in ("at once", "gap"):
            return bar["open"] if how == "gap" or late_exit else close, -self.position, level, False
        if self.timed_out:
            return bar["open"] if late_exit else close, -self.position, None, False
        met = None
        if self.order:
            price, size = self.order
            # A buy order is met from below its price, a sale from above.
            met = self._reached(price, size > 0, bar, close)
            if met in ("at once", "gap"):
                return bar["open"] if met == "gap" or late_entry else close, size, None, True
            if met and how:
                sooner = size > 0 and price >= level if down else size < 0 and price <= level
                if sooner:
                    return price, size, None, True
        if how:
            return level, -self.position, level, False
        return (price, size, None, True) if met else None

    def _book(self, price: float, size: float) -> None:
        old, new = self.position, self.position + size
        if abs(new) < 1e-12:
            new = 0.0
        if new == 0:
            self.cost = 0.0
        elif old * new <= 0:
            self.cost = price * new
        elif abs(new) > abs(old):
            self.cost += price * size
        else:
            self.cost = self.average * new
        if new * old <= 0:
            self.bars, self.best = 0, price
        self.position = new

    def step(self, bar: dict) -> tuple[dict, float | None]:
        """This bar's results, and the stop price to write into the row before."""
        out = dict.fromkeys(RESULT)
        stop_of_before = None
        pending = self.order or self.stop is not None or self.target is not None or self.timed_out
        if self.before is not None and bar["covered"] and pending and (trade := self._fill(bar)):
            out["trade_price"], out["trade_size"], stop_of_before, is_order = trade
            self._book(out["trade_price"], out["trade_size"])
            self.traded |= is_order
        self.order = self.stop = self.target = None
        self.timed_out = False
        if not bar["covered"] and self.position:
            out["trade_price"], out["trade_size"] = bar["close"], -self.position
            self._book(bar["close"], -self.position)
        out["position"] = self.position
        if self.position:
            out["avg_price"] = self.average
            self.bars += 1
            self.best = max(self.best, bar["high"]) if self.position > 0 else min(self.best, bar["low"])
        if bar["covered"] and _given(bar["signal"]):
            out["signal"] = bar["signal"]
            self._place(bar, out)
        if self.position:
            self._protect(bar)
        self.before = bar
        return out, stop_of_before

    def _place(self, bar: dict, out: dict) -> None:
        signal, price, quantity = bar["signal"], bar["order_price"], bar["order_quantity"]
        if signal != self.last_signal:
            self.traded, self.last_signal = False, signal
        if bar["first_only"] and self.traded:
            return
        size = None
        if bar["long_only"] and signal < 0 or bar["short_only"] and signal > 0:
            if self.position * signal < 0 and _given(price):
                size = -self.position
        elif _given(price) and _given(quantity):
            size = signal * quantity - (self.position if self.position * signal < 0 else 0.0)
        if size:
            self.order = (price, size)
            out["order_price"], out["order_size"] = price, size

    def _protect(self, bar: dict) -> None:
        side = 1.0 if self.position > 0 else -1.0
        if _given(bar["trailing_stop"]):
            self.stop = self.best * (1 - side * bar["trailing_stop"])
        elif _given(bar["stop_loss"]):
            self.stop = self.average * (1 - side * bar["stop_loss"])
        if _given(bar["take_profit"]):
            self.target = self.average * (1 + side * bar["take_profit"])
        if _given(bar["time_window"]):
            self.timed_out = self.bars >= bar["time_window"]


def _walk(batches: Iterator[pd.DataFrame], groups: list[str], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Runs the machine over sorted rows; the last row waits for the next, which may write its stop price."""
    key, machine, held = object(), Machine(), None
    for batch in batches:
        done = []
        for bar in batch.to_dict("records"):
            if (now := tuple(bar[g] for g in groups)) != key:
                key, machine = now, Machine()
                if held is not None:
                    done.append(held)
                held = None
            result, stop = machine.step(bar)
            if held is not None:
                held["stop_price"] = stop
                done.append(held)
            held = {**{c: bar[c] for c in columns if c not in RESULT}, **result}
        if done:
            yield pd.DataFrame(done, columns=columns)
    if held is not None:
        yield pd.DataFrame([held], columns=columns)


def run_machine(instructed: DataFrame, groups: list[str] = ["product", "resolution"]) -> DataFrame:
    """Results of instructed bars: the bars' own columns and ``RESULT``.

    Null values in instruction columns mean "none"; missing columns have their defaults.
    Each group of ``groups`` is a backtest of its own.
    """
    plain = instructed
    for name, default in DEFAULTS.items():
        if name not in plain.columns:
            plain = plain.withColumn(name, F.lit(default) if default is not None else F.lit(None).cast("double"))
    own = [f for f in instructed.schema.fields if f.name not in DEFAULTS and f.name not in RESULT]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", " + ", ".join(f"{c} double" for c in RESULT)
    columns = [f.name for f in own] + list(RESULT)
    ordered = plain.repartition(*groups).sortWithinPartitions(*groups, "date")
    return ordered.mapInPandas(lambda batches: _walk(batches, groups, columns), schema)


def market_orders(signals: DataFrame, quantity: float = 1.0, once: bool = False) -> DataFrame:
    """The closed form: orders at the close, no stops; ``once`` per streak or on every signal.

    A streak's n-th signal adds to the position, a new streak turns it round; what is decided
    at a close is held, at the close's price, from the next bar on.
    """
    s = with_changes(signals)
    streak = Window.partitionBy("product", "resolution", "streak").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    counts = F.col("signal").isNotNull()
    if once:
        counts = counts & F.col("changed")
    s = s.withColumn("_n", F.sum(counts.cast("double")).over(streak)).withColumn("_mean", F.sum(F.when(counts, F.col("close"))).over(streak) / F.nullif("_n", F.lit(0.0)))
    w = Window.partitionBy("product", "resolution").orderBy("date")
    s = s.withColumn("_next", F.coalesce(F.col("filled") * quantity * F.col("_n"), F.lit(0.0)))
    s = s.withColumn("position", F.coalesce(F.lag("_next").over(w), F.lit(0.0))).withColumn("_held", F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    traded = F.col("position") != F.col("_held")
    return s.select(
        *signals.columns,
        F.when(traded, F.lag("close").over(w)).alias("trade_price"),
        F.when(traded, F.col("position") - F.col("_held")).alias("trade_size"),
        "position",
        F.when(F.col("position") != 0, F.lag("_mean").over(w)).alias("avg_price"),
    )


def time_chunks(df: DataFrame, n: int) -> DataFrame:
    """Rows with ``chunk``: near-equal runs of distinct dates; the first ones are longer. Rows of a date stay together."""
    dates = df.select("date").distinct()
    if dates.count() < n:
        raise ValueError("there are more chunks than dates")
    return df.join(dates.withColumn("chunk", F.ntile(n).over(Window.orderBy("date")) - 1), "date")


def remark(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """``remark``: the abbreviations of true flags, joined by commas; temporary columns are dropped."""
    out = df.withColumn("remark", F.concat_ws(",", *[F.when(F.col(c), F.lit(short)) for c, short in flags.items()]))
    return out.drop(*[c for c in out.columns if c.startswith("_")])
