"""Alignment of contributors to a spine of bars. Contributors add values, never rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.resolution import Resolution
from tickloom.operators.bars import bar_close
from tickloom.session import KEYS


def align_exact(spine: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of the spine's keys that ``other`` has too, with its values. Key columns take the spine's types."""
    types = dict(spine.dtypes)
    cast = other.withColumns({k: F.col(k).cast(types[k]) for k in KEYS})
    return spine.select(*KEYS).join(cast, list(KEYS))


def align_asof(spine: DataFrame, other: DataFrame, spine_resolution: str, other_resolution: str) -> DataFrame:
    """For each bar of the spine the latest bar of ``other`` that has closed by its close, of the same product.

    Both sides are stacked in order of close, ``other`` first on ties, and the last bar of
    ``other`` so far is carried on: one shuffle and sort by product, no pairs.
    """
    values = [c for c in other.columns if c not in KEYS]
    s = bar_close(spine.select(*KEYS), spine_resolution).select("product", "date", "resolution", "bar_close", F.lit(1).alias("_side"))
    o = bar_close(other, other_resolution).select("product", "bar_close", F.lit(0).alias("_side"), F.struct(*values).alias("_values"))
    w = Window.partitionBy("product").orderBy("bar_close", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(o, allowMissingColumns=True).withColumn("_last", F.last("_values", ignorenulls=True).over(w))
    return both.where("_side = 1").select("date", "product", "resolution", *[F.col("_last")[v].alias(v) for v in values])


def align_event(spine: DataFrame, events: DataFrame, resolution: str, time_col: str = "ts") -> DataFrame:
    """Each event in the bar whose time it falls into; events in gaps go. An event without product is in every product's bar.

    Bars start on multiples of the resolution, so an event's bar is found by rounding its
    time: equi-joins on (product, date), or on date alone for events about everything.
    """
    seconds = Resolution(resolution).seconds()
    start = F.window(time_col, f"{seconds} seconds")["start"]
    placed = events.withColumn("date", start)
    own = spine.select(*KEYS).join(placed.where("product IS NOT NULL"), ["product", "date"])
    every = spine.select(*KEYS).join(placed.where("product IS NULL").drop("product"), "date")
    return own.unionByName(every).select(*KEYS, *[c for c in events.columns if c != "product"])


def collapse_events(aligned: DataFrame, order: list[str], prefix: str = "event") -> DataFrame:
    """One row a bar: its events as a list of structs, in order, and their number."""
    values = [c for c in aligned.columns if c not in KEYS]
    for name in (f"{prefix}_events", f"{prefix}_count"):
        if name in values:
            raise ValueError(f"column {name} exists")
    first = [*order, *[v for v in values if v not in order]]
    return aligned.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*first))).alias(f"{prefix}_events"), F.count(F.lit(1)).alias(f"{prefix}_count"))


def merge_events(spine: DataFrame, events: DataFrame, resolution: str, category: str, order: list[str]) -> DataFrame:
    """The spine with each bar's events of a category; bars without any have a count of 0."""
    renamed = events.withColumnRenamed("ts", f"{category}_date")
    lists = collapse_events(align_event(spine, renamed, resolution, f"{category}_date"), [f"{category}_date" if c == "ts" else c for c in order], category)
    return spine.join(lists, list(KEYS), "left").withColumn(f"{category}_count", F.coalesce(f"{category}_count", F.lit(0)))


def merge_child(parent: DataFrame, child: DataFrame, parent_resolution: str, child_resolution: str) -> DataFrame:
    """A long parent with a child's signals: by key at the same resolution, else as of the bar's close."""
    p, c = Resolution(parent_resolution), Resolution(child_resolution)
    if c < p:
        raise ValueError(f"a child's resolution must not be finer than {p!r}")
    values = [x for x in child.columns if x not in KEYS]
    if taken := sorted(set(values) & set(parent.columns)):
        raise ValueError(f"columns exist: {taken}")
    side = child if p == c else align_asof(parent, child, str(p), str(c))
    return parent.join(side, list(KEYS), "left")


def merge_wide_child(parent: DataFrame, child: DataFrame) -> DataFrame:
    """A parent of any form with a wide child of its resolution: by date, for every product."""
    return parent.join(child, "date", "left")


def full_frame(data: DataFrame, trading: DataFrame) -> DataFrame:
    """All keys of both; columns that both have are the data's."""
    extra = [c for c in trading.columns if c in KEYS or c not in data.columns]
    return data.join(trading.select(*extra), [k for k in KEYS if k in data.columns], "full")


def spine_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select(*KEYS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*KEYS))
    return out.distinct()


#: Products of so many are written into every row of dates; more are an error, as a wide frame has a column for each.
WIDE_PRODUCTS = 20_000


def cross_spine(dates: DataFrame, products: DataFrame) -> DataFrame:
    """Every date with every product of a wide parent: the parent's own cells, of at most ``WIDE_PRODUCTS`` products."""
    names = [r["product"] for r in products.select("product").where("product IS NOT NULL").distinct().limit(WIDE_PRODUCTS + 1).collect()]
    if len(names) > WIDE_PRODUCTS:
        raise ValueError(f"a wide frame has at most {WIDE_PRODUCTS} products")
    return dates.select("date").distinct().withColumn("product", F.explode(F.array(*map(F.lit, sorted(names))).cast("array<string>")))


def align(spine: DataFrame, other: DataFrame, mode: str, resolution: str, other_resolution: str | None = None, time_col: str = "ts") -> DataFrame:
    """``other`` on the spine's bars: by key (``exact``), as of their close (``asof``) or by the bar that a time falls into (``event``)."""
    if mode == "exact":
        return align_exact(spine, other)
    if mode == "asof":
        return align_asof(spine, other, resolution, other_resolution or resolution)
    if mode == "event":
        return align_event(spine, other, resolution, time_col)
    raise ValueError(f"unknown mode {mode!r}")
