"""Signals, and the instructions that a backtest carries out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by_product():
    return Window.partitionBy("product", "resolution").orderBy("date")


def in_range(date: Column, start, end) -> Column:
    """Both ends included; plain dates compare by day, datetimes exactly."""
    import datetime as dt

    for bound in (start, end):
        if not isinstance(bound, dt.date):
            raise TypeError("a range has dates or datetimes")
    if start > end:
        raise ValueError("a range begins before it ends")
    exact = isinstance(start, dt.datetime)
    return (date if exact else F.to_date(date)).between(F.lit(start), F.lit(end))


def create_signal(bars: DataFrame, buy: Column | None = None, sell: Column | None = None, signal: Column | None = None, start=None, end=None) -> DataFrame:
    """Bars with ``signal``: 1, -1 or null. Conditions must not both hold; outside the range there is none."""
    if signal is None:
        if buy is None and sell is None:
            raise ValueError("a condition or a signal is needed")
        yes_buy, yes_sell = (F.coalesce(c, F.lit(False)) if c is not None else F.lit(False) for c in (buy, sell))
        clash = F.raise_error(F.lit("buy and sell conditions overlap")).cast("double")
        signal = F.when(yes_buy & yes_sell, clash).when(yes_buy, 1.0).when(yes_sell, -1.0)
    if start is not None:
        signal = F.when(in_range(F.col("date"), start, end), signal)
    return bars.withColumn("signal", signal)


def filled(signal: str = "signal") -> Column:
    return F.last(signal, ignorenulls=True).over(_by_product().rowsBetween(Window.unboundedPreceding, 0))


def with_changes(df: DataFrame) -> DataFrame:
    """Adds the signal carried forward, whether it changes here, and the number of changes so far."""
    carried = df.withColumn("filled", filled())
    before = F.lag("filled").over(_by_product())
    changed = carried.withColumn("changed", F.col("filled").isNotNull() & ~F.col("filled").eqNullSafe(before))
    streak = F.sum(F.col("changed").cast("bigint")).over(_by_product().rowsBetween(Window.unboundedPreceding, 0))
    return changed.withColumn("streak", streak)


def first_only(df: DataFrame) -> DataFrame:
    """Signals only where they change."""
    return with_changes(df).withColumn("signal", F.when(F.col("changed"), F.col("signal")))


def segment_params(bars: DataFrame, starts: DataFrame, params: list[str]) -> DataFrame:
    """Bars with the parameters of the latest segment that has started by then; ``starts`` has product, date and parameters."""
    marked = bars.join(starts.select("product", "date", F.struct(*params).alias("_params")), ["product", "date"], "left")
    w = _by_product().rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.withColumn("_params", F.last("_params", ignorenulls=True).over(w))
    return carried.select(*bars.columns, *[F.col("_params")[p].alias(p) for p in params])


def _fill(fill_price: str) -> str:
    if fill_price not in ("open", "close"):
        raise ValueError("a fill price is open or close")
    return fill_price


def _above_zero(value: Column, name: str) -> Column:
    value = F.nanvl(value.cast("double"), F.lit(None))
    return F.when(value <= 0, F.raise_error(F.lit(f"{name} is above 0")).cast("double")).otherwise(value)


def open_position(
    signals: DataFrame,
    order_price: Column | None = None,
    order_quantity: Column | float = 1,
    first_only: bool = False,
    long_only: bool = False,
    short_only: bool = False,
    fill_price: str = "close",
) -> DataFrame:
    """Bars with the columns of orders that open positions; ``create_signal`` comes first.

    Without ``order_price`` orders are market orders: their price is the bar's close. With one, a
    null price (or quantity) means no order on that bar. Prices and quantities that are given are
    above 0, or an error is raised: at once for a number, as rows are read for a column.
    """
    if "signal" not in signals.columns:
        raise ValueError("create_signal comes before open_position")
    if long_only and short_only:
        raise ValueError("long_only and short_only exclude each other")
    if isinstance(order_quantity, bool):
        raise ValueError("a quantity is a number or a column")
    if not isinstance(order_quantity, Column) and not order_quantity > 0:
        raise ValueError("a quantity is above 0")
    return signals.withColumns(
        {
            "order_price": _above_zero(order_price, "order_price") if order_price is not None else F.col("close").cast("double"),
            "order_quantity": _above_zero(order_quantity, "order_quantity") if isinstance(order_quantity, Column) else F.lit(float(order_quantity)),
            "first_only": F.lit(first_only), "long_only": F.lit(long_only), "short_only": F.lit(short_only), "entry_fill": F.lit(_fill(fill_price)),
        }
    )


def close_position(
    signals: DataFrame,
    take_profit: float | None = None,
    stop_loss: float | None = None,
    trailing_stop: float | None = None,
    time_window: int | None = None,
    fill_price: str = "close",
) -> DataFrame:
    """Bars with the columns of conditions that close positions: shares of the price, and a number of bars."""
    if "signal" not in signals.columns:
        raise ValueError("create_signal comes before close_position")
    if take_profit is not None and not take_profit > 0:
        raise ValueError("take_profit is above 0")
    stop_loss = None if stop_loss is None else abs(stop_loss)
    for name, share in (("stop_loss", stop_loss), ("trailing_stop", trailing_stop)):
        if share is not None and not 0 < share < 1:
            raise ValueError(f"{name} is between 0 and 1")
    if stop_loss is not None and trailing_stop is not None:
        raise ValueError("stop_loss and trailing_stop exclude each other")
    if time_window is not None and (isinstance(time_window, bool) or not isinstance(time_window, int) or time_window < 1):
        raise ValueError("time_window is a number of bars")
    given = {"take_profit": take_profit, "stop_loss": stop_loss, "trailing_stop": trailing_stop, "time_window": time_window}
    return signals.withColumns({k: F.lit(v).cast("double") for k, v in given.items()} | {"exit_fill": F.lit(_fill(fill_price))})
