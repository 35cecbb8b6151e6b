"""All queries of the library, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.product_backtest import market_orders
from tickloom.plans import bar_queries, stream_queries, trade_queries  # noqa: F401
from tickloom.plans.registry import CHANGES, QUERIES, SQL, query
from tickloom.plans.trade_queries import signals


@query(
    f"WITH {CHANGES}, p AS (SELECT *, coalesce(lag(filled) OVER (PARTITION BY product ORDER BY date), 0) AS position, lag(close) OVER (PARTITION BY product ORDER BY date) AS before FROM k) "
    "SELECT product, round(sum(coalesce(position * (close - before), 0)), 4) AS profit, count(*) AS n_bars FROM p GROUP BY 1"
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit per product of a long/short backtest on hourly bars: buy above 60, sell below 30, once per streak."""
    from pyspark.sql import Window

    held = market_orders(signals(spark, sf_dir), once=True)
    before = F.lag("close").over(Window.partitionBy("product").orderBy("date"))
    gains = held.withColumn("_gain", F.col("position") * (F.col("close") - before))
    return gains.groupBy("product").agg(F.round(F.sum(F.coalesce("_gain", F.lit(0.0))), 4).alias("profit"), F.count(F.lit(1)).alias("n_bars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
