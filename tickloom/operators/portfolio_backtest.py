"""Backtest of portfolio weights over a panel of products.

If every product has a weight at every date there are closed forms, which are windows over
dates. Otherwise each date depends on the one before: scenarios run in parallel, and inside
one the dates are walked in order with one date's rows in hand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.folds import time_ranks

RESULT = ("weight", "order_price", "order_size", "trade_price", "trade_size", "position", "avg_price", "cash", "equity")


def weight_check(weights: DataFrame) -> DataFrame:
    """Per date the sum of positive weights, and whether it is above one."""
    total = F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0))
    return weights.groupBy("date").agg(total.alias("long_weight")).withColumn("too_large", F.col("long_weight") > 1 + 1e-9)


def panel_gaps(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Dates between a product's first and last close on which it has none.

    Dates are numbered; where a product's next close is more than one number on, the numbers
    between are its gaps. So rows are made for gaps alone, and nothing is compared over ranges.
    """
    numbered = time_ranks(dates)
    priced = bars.where("close IS NOT NULL").select("product", "date").distinct().join(numbered, "date")
    after = F.lead("time_idx").over(Window.partitionBy("product").orderBy("time_idx"))
    gaps = priced.withColumn("_after", after).where(F.col("_after") > F.col("time_idx") + 1)
    missing = gaps.select("product", F.explode(F.sequence(F.col("time_idx") + 1, F.col("_after") - 1)).alias("time_idx"))
    return missing.join(numbered, "time_idx").select("product", "date")


def compound(bars: DataFrame, capital: float = 1e6) -> DataFrame:
    """Equity and positions if weights (a column of ``bars``) are met in full with all equity at every close."""
    w = Window.partitionBy("product").orderBy("date")
    grown = bars.withColumn("_growth", F.lag("weight").over(w) * (F.col("close") / F.lag("close").over(w) - 1))
    by_date = grown.groupBy("date").agg(F.sum("_growth").alias("_r"))
    dates = by_date.withColumn("equity", capital * F.product(1 + F.coalesce("_r", F.lit(0.0))).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    held = bars.join(dates.select("date", "equity"), "date").withColumn("_target", F.col("weight") * F.col("equity") / F.col("close"))
    return held.withColumn("position", F.coalesce(F.lag("_target").over(w), F.lit(0.0))).select("date", "product", "close", "weight", "position", "equity")


def fixed(bars: DataFrame, capital: float = 1e6) -> DataFrame:
    """Positions, cash and equity if weights are always of the initial capital."""
    w = Window.partitionBy("product").orderBy("date")
    target = F.col("weight") * capital / F.col("close")
    moved = bars.withColumn("position", F.coalesce(F.lag(target).over(w), F.lit(0.0))).withColumn("_price", F.lag("close").over(w))
    moved = moved.withColumn("_size", F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    by_date = moved.groupBy("date").agg(F.sum(F.coalesce(F.col("_size") * F.col("_price"), F.lit(0.0))).alias("_paid"), F.sum(F.col("position") * F.col("close")).alias("_value"))
    dates = by_date.withColumn("cash", capital - F.sum("_paid").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    return moved.join(dates.select("date", "cash", (F.col("cash") + F.col("_value")).alias("equity")), "date").select("date", "product", "close", "weight", "position", "cash", "equity")


def checked_panel(panel: DataFrame, scenario: str = "scenario") -> DataFrame:
    """The panel; it fails on a close that is missing between a product's first and last one, and on a weight without a close.

    Closes may be missing before a product's first and after its last one.
    """
    by_date = Window.partitionBy(scenario).orderBy("date")
    earlier = Window.partitionBy(scenario, "product").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    priced = F.col("close").isNotNull() & ~F.isnan(F.col("close").cast("double"))
    weighed = F.col("weight").isNotNull() & ~F.isnan(F.col("weight").cast("double"))
    ranked = panel.withColumn("_rank", F.dense_rank().over(by_date)).withColumn("_before", F.last(F.when(priced, F.col("_rank")), ignorenulls=True).over(earlier))
    at = F.concat(F.col("product"), F.lit(" before "), F.col("date").cast("string"))
    fault = F.when(priced & (F.col("_rank") - F.col("_before") > 1), F.concat(F.lit("a close is missing: "), at)).when(weighed & ~priced, F.concat(F.lit("a weight has no close: "), at))
    weight = F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col("weight"))
    return ranked.withColumn("weight", weight).select(*panel.columns)


class Portfolio:
    def __init__(self, capital: float, compounding: bool):
        self.capital, self.cash, self.compounding = capital, capital, compounding
        self.held: dict[str, float] = {}
        self.cost: dict[str, float] = {}
        self.orders: dict[str, tuple[float, float]] = {}

    def _fill(self, product: str) -> tuple[float, float]:
        price, size = self.orders.pop(product)
        old = self.held.get(product, 0.0)
        new = old + size
        if abs(new) < 1e-12:
            new = 0.0
        if new == 0:
            self.cost[product] = 0.0
        elif old * new <= 0:
            self.cost[product] = price * new
        elif abs(new) > abs(old):
            self.cost[product] += price * size
        else:
            self.cost[product] *= new / old
        self.cash -= size * price
        self.held[product] = new
        return price, size

    def step(self, date, rows: dict[str, dict]) -> list[dict]:
        """Results of a date's rows; ``rows`` has close and weight by product. Orders are filled at the next date."""
        filled = {p: self._fill(p) for p in sorted(self.orders)}
        priced = {p: r["close"] for p, r in rows.items() if r["close"] is not None and not math.isnan(r["close"])}
        weight = {p: rows[p]["weight"] for p in priced if rows[p]["weight"] is not None and not math.isnan(rows[p]["weight"])}
        equity = self.cash + sum(n * priced[p] for p, n in sorted(self.held.items()) if p in priced)
        drift = sum(n * priced[p] for p, n in sorted(self.held.items()) if p in priced and p not in weight)
        free = (equity if self.compounding else self.capital) - drift
        if free <= 0 and any(weight.values()):
            raise ValueError(f"no capital is left on {date}")
        cash = self.cash
        for p in sorted(set(rows) | set(self.held)):
            n = self.held.get(p, 0.0)
            if p not in priced:
                if n:
                    self.orders[p] = (0.0, -n)
            elif p in weight and (delta := weight[p] * free / priced[p] - n):
                self.orders[p] = (priced[p], delta)
        out = []
        for p, r in rows.items():
            n = self.held.get(p, 0.0)
            order, trade = self.orders.get(p, (None, None)), filled.get(p, (None, None))
            out.append(
                {"weight": r["weight"], "order_price": order[0], "order_size": order[1], "trade_price": trade[0], "trade_size": trade[1], "position": n, "avg_price": self.cost[p] / n if n else None, "cash": cash, "equity": equity}
            )
        return out


def run_portfolio(panel: DataFrame, capital: float = 1e6, compounding: bool = True, scenario: str = "scenario") -> DataFrame:
    """Results of weighted bars (scenario, date, product, close, weight).

    After a product's last close, what is held of it is closed at 0 on the next date. A close that
    is missing before that, and a weight without a close, fail (``checked_panel``).
    """
    if capital <= 0:
        raise ValueError("capital must be positive")
    keys = [scenario, "date", "product", "close"]
    types = dict(panel.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + ", ".join(f"{c} double" for c in RESULT)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, book, rows = None, None, []

        def flush() -> pd.DataFrame:
            results = book.step(now[1], {r["product"]: r for r in rows})
            return pd.DataFrame([{**{k: r[k] for k in keys}, **x} for r, x in zip(rows, results)], columns=keys + list(RESULT))

        for batch in batches:
            for r in batch.to_dict("records"):
                at = (r[scenario], r["date"])
                if at != now:
                    if rows:
                        yield flush()
                    if now is None or at[0] != now[0]:
                        book = Portfolio(capital, compounding)
                    now, rows = at, []
                rows.append(r)
        if rows:
            yield flush()

    return checked_panel(panel.select(*keys, "weight"), scenario).repartition(scenario).sortWithinPartitions(scenario, "date", "product").mapInPandas(walk, schema)
