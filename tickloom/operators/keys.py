"""Constraints on bar frames, as frames of what breaks them and as checks that raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import KEYS


def free_column(df: DataFrame, name: str) -> str:
    """``name`` with leading underscores until no column has it."""
    while name in df.columns:
        name = "_" + name
    return name


def key_violations(df: DataFrame, keys: list[str] = list(KEYS)) -> DataFrame:
    """Keys that are repeated or have a null, with their number of rows."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("has_null", null).where(F.col("has_null") | (F.col("n_rows") > 1))


def require_keys(df: DataFrame, keys: list[str] = list(KEYS)) -> DataFrame:
    bad = key_violations(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"keys {keys} must be unique and without nulls: {bad}")
    return df


def require_long(df: DataFrame, order: str | None = None) -> DataFrame:
    """A frame that a backtest may take: it has the keys and a close, keys without nulls or repeats, one resolution, and,
    where the stored order is a column, each product's dates in that order."""
    if lacking := sorted({*KEYS, "close"} - set(df.columns)):
        raise ValueError(f"the frame lacks {lacking}")
    require_keys(df)
    require_one_resolution(df)
    if order is not None and (bad := unsorted_rows(df, order, "date", "product").limit(3).collect()):
        raise ValueError(f"dates are not sorted: {bad}")
    return df


def resolutions(df: DataFrame) -> DataFrame:
    return df.groupBy("resolution").agg(F.count(F.lit(1)).alias("n_rows"))


def require_one_resolution(df: DataFrame) -> str:
    found = [r["resolution"] for r in df.select("resolution").distinct().limit(2).collect()]
    if len(found) != 1 or found[0] is None:
        raise ValueError(f"exactly one resolution is needed, not {found}")
    return found[0]


def unsorted_rows(df: DataFrame, order: str, key: str, by: str) -> DataFrame:
    """Rows whose ``key`` is less than the row before has, in the stored order ``order``."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("previous", F.lag(key).over(w)).where(F.col(key) < F.col("previous"))


def reordered(df: DataFrame, form: str = "long") -> DataFrame:
    """Key columns first, the others in their order."""
    keys = {"long": list(KEYS), "wide": ["date"]}[form]
    return df.select(*keys, *[c for c in df.columns if c not in keys])


def kinds(df: DataFrame, signals: list[str], market: list[str], kind: str) -> DataFrame:
    """One of the five projections of a component's frame: data, features, signals, trading, full."""
    keys = [k for k in KEYS if k in df.columns]
    if kind in ("signals", "trading") and not signals:
        raise ValueError("there are no signals yet")
    columns = {
        "data": [c for c in df.columns if c in keys or c in market],
        "features": [c for c in df.columns if c not in signals],
        "signals": [c for c in df.columns if c in keys or c in signals],
        "trading": [c for c in df.columns if c not in market or c in signals],
        "full": df.columns,
    }[kind]
    return df.select(*columns)


def missing_rows(wanted: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose keys ``df`` lacks."""
    return wanted.join(df.select(*keys).distinct(), keys, "left_anti")
