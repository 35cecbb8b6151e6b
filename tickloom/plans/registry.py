"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


# Common table expressions that the queries' SQL begins with.
TICKS = "ticks AS (SELECT event_type AS product, ts, value AS price, CAST(1.0 AS DOUBLE) AS volume, event_id AS seq FROM events WHERE value > 0)"


def bars_sql(unit: str, resolution: str, name: str = "bars") -> str:
    return (
        f"{name} AS (SELECT CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS date, product, '{resolution}' AS resolution, arg_min(price, ts) AS open, "
        "max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2)"
    )


HOURLY = f"{TICKS}, {bars_sql('hour', '1_HOUR')}"
DAILY = f"{TICKS}, {bars_sql('day', '1_DAY')}"
BOTH = f"{TICKS}, {bars_sql('hour', '1_HOUR', 'hourly')}, {bars_sql('day', '1_DAY', 'daily')}"
NEWS = (
    "news AS (SELECT ts, CASE WHEN user_id % 2 = 1 THEN ['click', 'view', 'purchase'][event_id % 3 + 1] END AS product, event_id AS headline_id, value AS score "
    "FROM events WHERE event_type = 'error')"
)
BAR = "date, product, resolution, open, high, low, close, volume"
SIGNALS = f"{HOURLY}, s AS (SELECT *, CASE WHEN close > 60 THEN 1.0::DOUBLE WHEN close < 30 THEN -1.0::DOUBLE END AS signal FROM bars)"
CHANGES = (
    f"{SIGNALS}, f AS (SELECT *, last_value(signal IGNORE NULLS) OVER w AS filled FROM s WINDOW w AS (PARTITION BY product ORDER BY date ROWS UNBOUNDED PRECEDING)), "
    "c AS (SELECT *, filled IS NOT NULL AND filled IS DISTINCT FROM lag(filled) OVER (PARTITION BY product ORDER BY date) AS changed FROM f), "
    "k AS (SELECT *, CAST(sum(changed::INT) OVER (PARTITION BY product ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM c)"
)
