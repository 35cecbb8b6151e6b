"""Chronological splits: holdout and expanding windows, by distinct dates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def ratios(spec) -> tuple[float, float, float]:
    """Train, validation and test shares of digits (721), or of a mapping in which one of the three may be missing."""
    if isinstance(spec, int):
        digits = [int(d) for d in str(spec)]
        if len(digits) != 3:
            raise ValueError("three digits are needed")
        return tuple(d / sum(digits) for d in digits)
    known = {"val" if k == "dev" else k: float(v) for k, v in spec.items()}
    lacking = [k for k in ("train", "val", "test") if k not in known]
    if len(lacking) > 1 or set(known) - {"train", "val", "test"}:
        raise ValueError("at least two of train, val and test are needed")
    if lacking:
        known[lacking[0]] = 1 - sum(known.values())
    if abs(sum(known.values()) - 1) > 1e-9 or min(known.values()) < -1e-12:
        raise ValueError("the shares must sum to one")
    return known["train"], known["val"], known["test"]


def with_time_index(df: DataFrame) -> DataFrame:
    """``time_idx``: rank of the date among distinct dates from 0. The window runs over dates alone, then joins back."""
    dates = df.select("date").distinct().withColumn("time_idx", F.row_number().over(Window.orderBy("date")) - 1)
    return df.join(dates, "date")


def holdout(df: DataFrame, train: float, val: float) -> DataFrame:
    """Rows with ``split``. Sizes count distinct dates; a date's rows are on one side."""
    n = df.select("date").distinct().count()
    a, b = half_up(train * n), half_up((train + val) * n)
    if a == 0:
        raise ValueError("the training part is empty")
    return with_time_index(df).withColumn("split", F.when(F.col("time_idx") < a, "train").when(F.col("time_idx") < b, "val").otherwise("test"))


def folds(n_dates: int, n_splits: int = 5, max_train: int | None = None, test_size: int | None = None, gap: int = 0) -> list[tuple[int, int, int, int]]:
    """(train from, train to, test from, test to) of expanding windows; ends are exclusive."""
    test = test_size or n_dates // (n_splits + 1)
    if test < 1 or n_dates - gap - test * n_splits <= 0:
        raise ValueError("there are too few dates for so many splits")
    out = []
    for k in range(n_splits):
        start = n_dates - n_splits * test + k * test
        end = start - gap
        out.append((max(0, end - max_train) if max_train else 0, end, start, start + test))
    return out


def cross_validation(df: DataFrame, n_splits: int = 5, max_train: int | None = None, test_size: int | None = None, gap: int = 0) -> DataFrame:
    """Rows once for each fold and side they are in: ``fold`` and ``side``."""
    n = df.select("date").distinct().count()
    bounds = F.array(*[F.struct(F.lit(k).alias("fold"), *[F.lit(x).alias(name) for x, name in zip(b, ("a", "b", "c", "d"))]) for k, b in enumerate(folds(n, n_splits, max_train, test_size, gap))])
    t = F.col("time_idx")
    side = F.when((t >= F.col("f.a")) & (t < F.col("f.b")), "train").when((t >= F.col("f.c")) & (t < F.col("f.d")), "test")
    return with_time_index(df).withColumn("f", F.explode(bounds)).withColumn("side", side).where("side IS NOT NULL").select(*df.columns, "time_idx", F.col("f.fold").alias("fold"), "side")
