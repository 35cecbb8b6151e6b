"""Long and wide forms of bar frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encoded(part: Column) -> Column:
    """A part of a wide column's name, free of the separator; percent signs go first so that decoding is exact."""
    for plain, code in (("%", "%25"), ("\x00", "%00"), (":", "%3A")):
        part = F.replace(part, F.lit(plain), F.lit(code))
    return part


def decoded(part: Column) -> Column:
    for plain, code in ((":", "%3A"), ("\x00", "%00"), ("%", "%25")):
        part = F.replace(part, F.lit(code), F.lit(plain))
    return part


def pivot_wide(df: DataFrame, fields: list[str], names: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row a date, columns ``product:resolution:field``, sorted.

    ``names`` lists (product, resolution) if they are known; else they are asked for, and
    their number is a number of columns, so it is small.
    """
    if names is None:
        names = sorted(tuple(r) for r in df.select("product", "resolution").distinct().collect())
    name = F.concat(encoded(F.col("product")), F.lit(":"), encoded(F.col("resolution")))

    def quoted(s: str) -> str:
        return s.replace("%", "%25").replace("\x00", "%00").replace(":", "%3A")

    values = [f"{quoted(p)}:{quoted(r)}" for p, r in names]
    columns = sorted(((v, f) for v in values for f in fields), key=lambda x: f"{x[0]}:{x[1]}")
    rows = df.withColumn("_name", name)
    return rows.groupBy("date").agg(*[F.max(F.when(F.col("_name") == v, F.col(f))).alias(f"{v}:{f}") for v, f in columns])


def unpivot_long(wide: DataFrame, fields: list[str]) -> DataFrame:
    """Back to (date, product, resolution, fields); rows without any value are dropped."""
    names = sorted({c.rsplit(":", 1)[0] for c in wide.columns if c != "date"})
    lacking = [f"{n}:{f}" for n in names for f in fields if f"{n}:{f}" not in wide.columns]
    if lacking:
        raise ValueError(f"wide columns are missing: {lacking}")
    rows = F.array(*[F.struct(F.lit(n).alias("_name"), *[F.col(f"`{n}:{f}`").alias(f) for f in fields]) for n in names])
    long = wide.select("date", F.explode(rows).alias("r")).select("date", "r.*")
    part = F.split("_name", ":")
    any_value = F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull()
    return long.where(any_value).select("date", decoded(part[0]).alias("product"), decoded(part[1]).alias("resolution"), *fields)


def dense_panel(df: DataFrame, value: str) -> DataFrame:
    """A row for each date of any product and each product; ``value`` is null where there is none.

    Dates and products are the panel's two edges; their product is the result itself.
    """
    dates, products = df.select("date").distinct(), df.select("product").distinct()
    return dates.join(F.broadcast(products) if products.count() < 10_000 else products).join(df.select("date", "product", value), ["date", "product"], "left")
