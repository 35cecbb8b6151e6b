"""Indicators over a product's bars. Frames of rows are windows; recursive ones fold a product's sorted values."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _last(n: int):
    return Window.partitionBy("product", "resolution").orderBy("date").rowsBetween(-(n - 1), 0)


def _ordered():
    return Window.partitionBy("product", "resolution").orderBy("date")


def _full(value: Column, n: int) -> Column:
    """Null until n bars are there."""
    return F.when(F.count(F.lit(1)).over(_last(n)) == n, value)


def sma(n: int, field: str = "close") -> Column:
    return _full(F.avg(field).over(_last(n)), n)


def bbands(n: int, width: float = 2.0, field: str = "close") -> tuple[Column, Column, Column]:
    """Upper, middle and lower band; the deviation is of the population."""
    middle, spread = F.avg(field).over(_last(n)), width * F.stddev_pop(field).over(_last(n))
    return _full(middle + spread, n), _full(middle, n), _full(middle - spread, n)


def roc(n: int, field: str = "close") -> Column:
    before = F.lag(field, n).over(_ordered())
    return 100 * (F.col(field) / before - 1)


def mom(n: int, field: str = "close") -> Column:
    return F.col(field) - F.lag(field, n).over(_ordered())


def highest(n: int, field: str = "high") -> Column:
    return _full(F.max(field).over(_last(n)), n)


def lowest(n: int, field: str = "low") -> Column:
    return _full(F.min(field).over(_last(n)), n)


def true_range() -> Column:
    before = F.lag("close").over(_ordered())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def _folded(bars: DataFrame, value: Column, n: int, rate: float, name: str) -> DataFrame:
    """e = e + rate * (x - e) from the mean of the first n values on.

    With q = 1 - rate, e_t = q^t (m + rate * sum of x_i q^-i) over the values since the
    start. Sums run over blocks of rows, so that q^-i stays in range, and blocks carry on
    through their last values: two windows and no fold over a whole product.
    """
    q = 1.0 - rate
    block = max(1, int(300 / max(1e-9, -math.log10(q)) / 4)) if q > 0 else 1
    w = _ordered()
    rows = bars.withColumn("_x", value).withColumn("_k", F.sum(F.col("_x").isNotNull().cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seeds = rows.where((F.col("_k") <= n) & F.col("_x").isNotNull()).groupBy("product", "resolution").agg(F.avg("_x").alias("_seed"))
    rows = rows.join(seeds, ["product", "resolution"], "left").withColumn("_t", F.when(F.col("_x").isNotNull(), F.col("_k") - n))
    rows = rows.withColumn("_block", F.floor((F.greatest("_t", F.lit(1)) - 1) / block)).withColumn("_i", F.col("_t") - F.col("_block") * block)
    inside = Window.partitionBy("product", "resolution", "_block").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    part = F.sum(F.when(F.col("_t") > 0, rate * F.col("_x") * F.pow(F.lit(1 / q), F.col("_i").cast("double")))).over(inside)
    rows = rows.withColumn("_part", F.when(F.col("_t") > 0, F.pow(F.lit(q), F.col("_i").cast("double")) * part))
    # At most q^block of what lies before a block is left in it; carried through one term per block.
    ends = rows.where(F.col("_t") == (F.col("_block") + 1) * block).select("product", "resolution", (F.col("_block") + 1).alias("_block"), F.col("_part").alias("_end"))
    # What each block starts from is folded once for a product, and joined to the rows by block.
    folded = seeds.join(ends.groupBy("product", "resolution").agg(F.array_sort(F.collect_list(F.struct("_block", "_end"))).alias("_ends")), ["product", "resolution"], "left")
    starts = F.aggregate(
        F.coalesce("_ends", F.array().cast("array<struct<_block:bigint,_end:double>>")),
        F.array("_seed"),
        lambda s, e: F.concat(s, F.array(F.element_at(s, -1) * (q**block) + e["_end"])),
    )
    by_block = folded.select("product", "resolution", F.posexplode(starts).alias("_block", "_start")).withColumn("_block", F.col("_block").cast("bigint"))
    rows = rows.join(by_block, ["product", "resolution", "_block"], "left")
    start = F.col("_start")
    out = F.when(F.col("_t") == 0, F.col("_seed")).when(F.col("_t") > 0, F.col("_part") + start * F.pow(F.lit(q), F.col("_i").cast("double")))
    return rows.withColumn(name, out).select(*bars.columns, name)


def ema(bars: DataFrame, n: int, field: str = "close", name: str = "ema") -> DataFrame:
    """Exponential mean with rate 2 / (n + 1), begun by the mean of the first n."""
    return _folded(bars, F.col(field), n, 2 / (n + 1), name)


def rsi(bars: DataFrame, n: int, field: str = "close", name: str = "rsi") -> DataFrame:
    """Relative strength with smoothing rate 1 / n, begun by means of the first n changes."""
    change = bars.withColumn("_change", F.col(field) - F.lag(field).over(_ordered()))
    up = _folded(change, F.greatest(F.col("_change"), F.lit(0.0)) + F.col("_change") * 0, n, 1 / n, "_up")
    down = _folded(up, F.greatest(-F.col("_change"), F.lit(0.0)) + F.col("_change") * 0, n, 1 / n, "_down")
    total = F.col("_up") + F.col("_down")
    return down.withColumn(name, F.when(total == 0, 0.0).otherwise(100 * F.col("_up") / total)).select(*bars.columns, name)


@dataclass(frozen=True)
class Indicator:
    """A named indicator: its parameters with their defaults, its outputs, and how bars get them."""

    name: str
    parameters: dict[str, object]
    outputs: tuple[str, ...]
    add: Callable[..., DataFrame]

    def look_back(self, **given) -> int:
        """Bars that a value needs: the largest of the whole-number parameters, and one more for changes."""
        p = self.parameters | given
        return max((v for v in p.values() if isinstance(v, int)), default=1) + (self.name in ("ROC", "MOM", "RSI", "TRANGE"))


def _columns(make: Callable[..., Column | tuple[Column, ...]]) -> Callable[..., DataFrame]:
    """An adder of column expressions, one for each output."""

    def add(bars: DataFrame, names: tuple[str, ...], **p) -> DataFrame:
        made = make(**p)
        return bars.withColumns(dict(zip(names, made if isinstance(made, tuple) else (made,))))

    return add


_REGISTRY: dict[str, Indicator] = {}


def register(name: str, parameters: dict[str, object], outputs: tuple[str, ...], add: Callable[..., DataFrame]) -> None:
    """Makes an indicator known by a name in upper case: ``add(bars, names, **parameters)`` gives bars with columns of these names."""
    if name != name.upper() or name in _REGISTRY:
        raise ValueError(f"a new name in upper case is needed, not {name!r}")
    _REGISTRY[name] = Indicator(name, parameters, outputs, add)


def indicator(name: str) -> Indicator:
    if name.upper() not in _REGISTRY:
        raise LookupError(f"there is no indicator {name!r}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name.upper()]


def with_indicator(bars: DataFrame, name: str, prefix: str = "", **given) -> DataFrame:
    """Bars with an indicator's outputs, named as the indicator names them after ``prefix``.

    Parameters that are not given have their defaults; unknown ones, and periods below 1, are
    errors, as are columns that the bars lack or already have.
    """
    of = indicator(name)
    if unknown := sorted(set(given) - set(of.parameters)):
        raise ValueError(f"{of.name} has no parameters {unknown}; it has {sorted(of.parameters)}")
    p = of.parameters | given
    for k, v in p.items():
        if k == "n" and (isinstance(v, bool) or not isinstance(v, int) or v < 1):
            raise ValueError(f"{of.name} has a period of 1 or more")
        if k == "field" and v not in bars.columns:
            raise ValueError(f"the bars have no {v}")
    names = tuple(prefix + o for o in of.outputs)
    if taken := sorted(set(names) & set(bars.columns)):
        raise ValueError(f"there are columns of these names already: {taken}")
    return of.add(bars, names, **p)


register("SMA", {"n": 30, "field": "close"}, ("sma",), _columns(sma))
register("BBANDS", {"n": 5, "width": 2.0, "field": "close"}, ("upperband", "middleband", "lowerband"), _columns(bbands))
register("ROC", {"n": 10, "field": "close"}, ("roc",), _columns(roc))
register("MOM", {"n": 10, "field": "close"}, ("mom",), _columns(mom))
register("MAX", {"n": 30, "field": "high"}, ("max",), _columns(highest))
register("MIN", {"n": 30, "field": "low"}, ("min",), _columns(lowest))
register("TRANGE", {}, ("trange",), _columns(true_range))
register("EMA", {"n": 30, "field": "close"}, ("ema",), lambda bars, names, n, field: ema(bars, n, field, names[0]))
register("RSI", {"n": 14, "field": "close"}, ("rsi",), lambda bars, names, n, field: rsi(bars, n, field, names[0]))
