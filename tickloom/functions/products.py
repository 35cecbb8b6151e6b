"""Products: which specifications each asset type has, and what makes two products the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.finance import asset_type, parse_basis

# Specifications of asset types, and whether they are required.
SPECS = {
    "STOCK": {}, "ETF": {}, "CRYPTO": {}, "FOREX": {}, "BOND": {}, "FUND": {}, "CFD": {}, "INDEX": {},
    "PERPETUAL": {"underlying": False, "multiplier": False}, "INVERSE-PERPETUAL": {"underlying": False, "multiplier": False},
    "FUTURE": {"expiration": True, "contract_code": False, "underlying": False, "multiplier": False},
    "INVERSE-FUTURE": {"expiration": True, "contract_code": False, "underlying": False, "multiplier": False},
    "OPTION": {"strike_price": True, "expiration": True, "option_type": True, "underlying": False, "multiplier": False},
}


def rules(spark: SparkSession, specs: dict[str, dict[str, bool]] = SPECS) -> DataFrame:
    """The rule table: (asset_type, allowed, required), arrays of names."""
    rows = [(k, sorted(v), sorted(name for name, needed in v.items() if needed)) for k, v in specs.items()]
    return spark.createDataFrame(rows, "asset_type string, allowed array<string>, required array<string>")


def checked(products: DataFrame, of: DataFrame) -> DataFrame:
    """Products (basis, source, specs: a map of texts) with their parsed basis, ``unknown`` and ``missing`` specs, and ``fault``.

    A basis that is none, an asset type without rules, and specs that are unknown, missing or
    null where required are faults. The rule table has a row for each asset type, so it is broadcast.
    """
    parsed = products.withColumn("_basis", parse_basis(F.col("basis"))).withColumns({"base": F.col("_basis.base"), "quote": F.col("_basis.quote"), "asset_type": F.col("_basis.asset_type")})
    met = parsed.join(F.broadcast(of), "asset_type", "left")
    given = F.map_keys(F.coalesce("specs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    filled = F.map_keys(F.map_filter(F.coalesce("specs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda _, v: v.isNotNull() & (F.trim(v) != "")))
    out = met.withColumns({"unknown": F.array_sort(F.array_except(given, "allowed")), "missing": F.array_sort(F.array_except("required", filled))})
    fault = F.when(F.col("_basis").isNull(), "basis").when(F.col("allowed").isNull(), "asset type").when(F.size("unknown") > 0, "unknown specs").when(F.size("missing") > 0, "missing specs")
    return out.withColumn("fault", fault).select(*products.columns, "base", "quote", "asset_type", "unknown", "missing", "fault")


def symbol(base: Column, quote: Column, kind: Column, specs: Column) -> Column:
    """A product's own name: its basis, and those of its specs that tell products of a basis apart, in a fixed order."""
    parts = [F.element_at(specs, F.lit(k)) for k in ("expiration", "strike_price", "option_type")]
    return F.concat_ws("_", base, quote, kind, *(F.upper(F.nullif(F.trim(p), F.lit(""))) for p in parts))


def identical(products: DataFrame) -> DataFrame:
    """Checked products with ``key``: products are the same if source, symbol and asset type are."""
    name = symbol(F.col("base"), F.col("quote"), asset_type(F.col("asset_type")), F.col("specs"))
    return products.withColumn("symbol", name).withColumn("key", F.struct(F.upper("source").alias("source"), "symbol", "asset_type"))
