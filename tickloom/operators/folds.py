"""Folds of any splitter as intervals of time ranks, and companions that are split like their frame.

A splitter is asked once, about the ranks of the distinct dates; what it gives is kept as runs of
ranks, so its size is that of the runs and not of the rows. Rows meet runs by an equi-join over
cells of ranks: a run is written into each cell that it touches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple, Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import KEYS, shared_path

#: Cells that the ranks are cut into, and how many runs by cell are broadcast.
CELLS, BROADCAST_RUNS = 1_000, 100_000


@runtime_checkable
class Splitter(Protocol):
    """What any cross-validator has: how many folds, and for each the positions to train and to test on."""

    def get_n_splits(self, X: object | None = None, y: object | None = None, groups: object | None = None) -> int: ...

    def split(self, X: object, y: object | None = None, groups: object | None = None) -> Iterator[tuple[Any, Any]]: ...


class Run(NamedTuple):
    """Ranks from ``start`` to before ``end`` of one side of a fold."""

    fold: int
    side: str
    start: int
    end: int


def runs(fold: int, side: str, positions) -> list[Run]:
    """The runs of consecutive positions, in any order and without regard to repeats."""
    p = np.unique(np.asarray(positions))
    if not p.size:
        return []
    if p.dtype.kind not in "iu":
        raise TypeError("positions are whole numbers")
    cut = np.flatnonzero(np.diff(p) > 1)
    return [Run(fold, side, int(a), int(b) + 1) for a, b in zip(p[np.r_[0, cut + 1]], p[np.r_[cut, len(p) - 1]])]


def folds_of(splitter: Splitter, n: int) -> list[Run]:
    """The runs of a splitter's folds over ``n`` ranks. Sides must be there, within range and apart, and folds as many as announced."""
    if not isinstance(splitter, Splitter):
        raise TypeError("a splitter has get_n_splits and split")
    ranks = np.arange(n).reshape(-1, 1)
    out, count = [], 0
    for fold, (train, test) in enumerate(splitter.split(ranks)):
        sides = [np.asarray(x) for x in (train, test)]
        if not all(s.size for s in sides):
            raise ValueError(f"fold {fold} has an empty side")
        if min(s.min() for s in sides) < 0 or max(s.max() for s in sides) >= n:
            raise ValueError(f"fold {fold} has positions outside of 0 to {n - 1}")
        if np.intersect1d(*sides).size:
            raise ValueError(f"fold {fold} trains on what it tests")
        out += runs(fold, "train", sides[0]) + runs(fold, "test", sides[1])
        count += 1
    if count != (announced := splitter.get_n_splits(ranks)):
        raise ValueError(f"{announced} folds were announced and {count} came")
    return out


def purged(of: Sequence[Run], purge: int = 0, embargo: int = 0) -> list[Run]:
    """Without training ranks that lie up to ``purge`` before or after a test run of their fold, or up to ``embargo`` after it."""
    if purge < 0 or embargo < 0:
        raise ValueError("purge and embargo are numbers of dates")
    out = []
    for r in of:
        pieces = [(r.start, r.end)]
        if r.side == "train":
            for t in (t for t in of if t.fold == r.fold and t.side == "test"):
                a, b = t.start - purge, t.end + max(purge, embargo)
                pieces = [p for s, e in pieces for p in ((s, min(e, a)), (max(s, b), e)) if p[0] < p[1]]
        out += [Run(r.fold, r.side, s, e) for s, e in pieces]
    return out


def time_ranks(df: DataFrame) -> DataFrame:
    """(date, time_idx) of the distinct dates, from 0, by a distributed sort: a date's place in its part plus the parts before."""
    spark = df.sparkSession
    path = shared_path(spark, "dates")
    df.select("date").where("date IS NOT NULL").distinct().orderBy("date").withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("part", F.shiftrightunsigned("place", 33))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # a row for each task of the sort
    ranked = placed.join(F.broadcast(before), "part")
    return ranked.select("date", (F.col("place") - F.shiftleft("part", 33) + F.col("before")).alias("time_idx"))


def with_folds(df: DataFrame, splitter: Splitter | Sequence[Run], purge: int = 0, embargo: int = 0) -> DataFrame:
    """Rows once for each fold and side that their date is in: ``time_idx``, ``fold`` and ``side``.

    ``splitter`` may also be runs. Rows of one date stay together; rows without a date are in no
    fold. ``df`` must not have columns of these names.
    """
    taken = {"time_idx", "fold", "side"} & set(df.columns)
    if taken:
        raise ValueError(f"there are columns of these names already: {sorted(taken)}")
    spark = df.sparkSession
    dates = time_ranks(df)
    n = dates.count()
    of = purged(list(splitter) if isinstance(splitter, Sequence) else folds_of(splitter, n), purge, embargo)
    width = max(1, -(-n // CELLS))
    table = spark.createDataFrame(of, "fold long, side string, start long, end long")
    cells = table.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    touched = sum((r.end - 1) // width - r.start // width + 1 for r in of)
    cells = F.broadcast(cells) if touched <= BROADCAST_RUNS else cells
    d = dates.withColumn("cell", F.floor(F.col("time_idx") / width))
    met = d.join(cells, "cell").where("time_idx >= start AND time_idx < end").select("date", "time_idx", "fold", "side")
    return df.join(met, "date").select(*df.columns, "time_idx", "fold", "side")


def split_companion(folded: DataFrame, companion: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A companion's rows (labels, weights) in the folds and sides of their keys' rows.

    Either has each key once, and both have the same keys; an error otherwise, as rows are read.
    """
    clash = (set(companion.columns) - set(keys)) & {"fold", "side", "time_idx"}
    if clash:
        raise ValueError(f"the companion has columns of these names already: {sorted(clash)}")
    own = folded.groupBy(*keys, "fold", "side").agg(F.count(F.lit(1)).alias("_in_frame"))
    places = own.groupBy(*keys).agg(F.collect_list(F.struct("fold", "side")).alias("_places"), F.max("_in_frame").alias("_in_frame"))
    theirs = companion.withColumn("_in_companion", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    both = theirs.join(places, list(keys), "full")
    wrong = F.when(F.col("_in_companion").isNull(), "a key of the frame has no companion").when((F.col("_in_companion") > 1) | (F.coalesce("_in_frame", F.lit(1)) > 1), "a key is there twice")
    checked = both.withColumn("_places", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<struct<fold: long, side: string>>")).otherwise(F.col("_places")))
    return checked.select(*companion.columns, F.inline("_places"))
