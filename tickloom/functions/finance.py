"""Scalar functions on orders, positions, products and codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Delivery month codes, asset type names, status precedence.
MONTH_CODES = "FGHJKMNQUVXZ"
ASSET_TYPES = {
    "IPERP": "INVERSE-PERPETUAL", "PERP": "PERPETUAL", "IFUT": "INVERSE-FUTURE", "FUT": "FUTURE", "OPT": "OPTION",
    "STK": "STOCK", "SPOT": "CRYPTO", "FX": "FOREX",
}
PRECEDENCE = ("FILLED", "CANCELED", "REJECTED", "PENDING_CANCEL", "PENDING_REPLACE", "PENDING_NEW", "PARTIAL", "NEW")

DECIMAL = "decimal(38,10)"


def round_lot(quantity: Column, lot: Column) -> Column:
    """The largest multiple of a lot that is not above."""
    return F.floor(quantity / lot) * lot


def round_tick(price: Column, tick: Column, mode: str, side: Column | None = None) -> Column:
    """To a multiple of the tick: ``nearest`` (halves up), ``passive`` or ``aggressive`` for the side."""
    n = price / tick
    if mode == "nearest":
        return F.floor(n + 0.5) * tick
    if mode not in ("passive", "aggressive") or side is None:
        raise ValueError("the mode is nearest, or passive or aggressive with a side")
    down = side > 0 if mode == "passive" else side < 0
    return F.when(down, F.floor(n)).otherwise(F.ceil(n)) * tick


def side_sign(side: Column) -> Column:
    """1 or -1 of a side's name or number; null for anything else."""
    name = F.upper(side)
    number = F.try_to_number(F.when(side.rlike(r"^-?[0-9]+$"), side), F.lit("S999999999"))
    return F.when(name.isin("BUY", "LONG"), 1).when(name.isin("SELL", "SHORT"), -1).when(number > 0, 1).when(number < 0, -1)


def to_base(quantity: Column, price: Column, multiplier: Column, inverse: Column) -> Column:
    return F.when(inverse, quantity * multiplier / price).otherwise(quantity * multiplier)


def to_quote(quantity: Column, price: Column, multiplier: Column, inverse: Column) -> Column:
    return F.when(inverse, quantity * multiplier).otherwise(quantity * multiplier * price)


def unrealised(size: Column, mark: Column, average: Column) -> Column:
    return F.when(size == 0, 0.0).otherwise(size * (mark - average))


def future_code(base: Column, expiry: Column) -> Column:
    return F.concat(base, F.substring(F.lit(MONTH_CODES), F.month(expiry), F.lit(1)), F.date_format(expiry, "yy"))


def option_code(base: Column, expiry: Column, kind: Column, strike: Column) -> Column:
    return F.concat(base, F.date_format(expiry, "yyMMdd"), F.upper(F.left(kind, F.lit(1))), F.lpad(F.round(strike * 1000).cast("bigint").cast("string"), 8, "0"))


def asset_type(name: Column) -> Column:
    """The full name of an asset type; hyphenated parts are looked up each."""
    names = F.create_map(*[F.lit(x) for kv in ASSET_TYPES.items() for x in kv])
    return F.coalesce(names[F.upper(name)], F.upper(name))


BASIS = r"^([A-Za-z0-9]{1,10})_([A-Za-z0-9]{1,10})_([A-Za-z]{1,10}(?:-[A-Za-z]{1,10})?)$"


def parse_basis(text: Column) -> Column:
    """Struct (base, quote, asset_type) of BASE_QUOTE_TYPE; null if it is none."""
    part = lambda i: F.upper(F.regexp_extract(text, BASIS, i))
    return F.when(text.rlike(BASIS), F.struct(part(1).alias("base"), part(2).alias("quote"), asset_type(part(3)).alias("asset_type")))


def code(value: Column, codes: dict[str, str]) -> Column:
    """The other side of a two-way code map; unknown values stay."""
    both = codes | {v: k for k, v in codes.items()}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in both.items() for x in kv])[value], value)


def fix_status(candidates: Column) -> Column:
    """The status of highest precedence among an array's."""
    return F.coalesce(*[F.when(F.array_contains(candidates, s), F.lit(s)) for s in PRECEDENCE])


def parse_expiry(ms: Column) -> Column:
    """UTC time of positive milliseconds given as text, else null."""
    n = F.when(ms.rlike(r"^[0-9]{1,15}$"), ms).try_cast("bigint")
    return F.when(n > 0, F.timestamp_millis(n))


def stop_kind(side: Column, trigger: Column) -> Column:
    """What a stop order is, from the side of the order and the direction (UP or DOWN) that triggers it."""
    return F.when((side < 0) == (trigger == "DOWN"), "stop_loss").otherwise("take_profit")


def venue_symbol(base: Column, quote: Column, kind: Column, expiry: Column) -> Column:
    """How a venue names a product of a kind."""
    return (
        F.when(kind == "PERPETUAL", F.when(quote == "USDC", F.concat(base, F.lit("PERP"))).otherwise(F.concat(base, quote)))
        .when(kind == "INVERSE-PERPETUAL", F.concat(base, F.lit("USD")))
        .when(kind == "FUTURE", F.concat_ws("-", base, F.upper(F.date_format(expiry, "ddMMMyy"))))
        .otherwise(F.concat(base, quote))
    )


def net_price(net: Column, long_price: Column, short_price: Column) -> Column:
    """Average price of two legs held side by side: that of the leg which outweighs; none if they cancel."""
    return F.when(net > 0, long_price).when(net < 0, short_price)


def trailing_stop_fault(amount: Column, percent: Column, limit_offset: Column) -> Column:
    """What is wrong with a trailing stop, or null: it has an amount or a percentage, and all that is given is above 0."""
    return (
        F.when(amount.isNull() == percent.isNull(), "one of amount and percent")
        .when(F.coalesce(amount <= 0, F.lit(False)), "amount")
        .when(F.coalesce(percent <= 0, F.lit(False)), "percent")
        .when(F.coalesce(limit_offset <= 0, F.lit(False)), "limit_offset")
    )


def average_price(price: Column, quantity: Column) -> Column:
    """Mean price of trades by quantity, an aggregate; null where nothing is traded."""
    return F.sum(price * quantity) / F.nullif(F.sum(quantity), F.lit(0.0))


def filled_state(orders: DataFrame, fills: DataFrame, size: Column) -> DataFrame:
    """Orders (order_id) with what is filled and remains of ``size``, and whether that is all or a part; orders without fills stay."""
    done = fills.groupBy("order_id").agg(F.sum("quantity").alias("filled"))
    out = orders.join(done, "order_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0.0)))
    return out.withColumns({"remaining": size - F.col("filled"), "is_filled": F.col("filled") >= size, "is_partial": (F.col("filled") > 0) & (F.col("filled") < size)})


def trim_zeros(number: Column) -> Column:
    """A decimal number's text without needless zeros: 0.010 is 0.01, and 25000.00 is 25000; null where there is no plain number."""
    text = F.when(F.trim(number).rlike(r"^[+-]?[0-9]*\.?[0-9]+$|^[+-]?[0-9]+\.$"), F.trim(number))
    short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = F.regexp_replace(F.regexp_replace(short, r"^\+", ""), r"^(-?)0*(?=[0-9])", "$1")
    pointed = F.regexp_replace(plain, r"^(-?)\.", "$10.")
    return F.when(pointed.isin("", "-", "-0"), F.lit("0")).otherwise(pointed)


def available(cash: Column, locked: Column) -> Column:
    """What of a balance is not locked, exactly; nothing locked where that is not known."""
    return (cash.cast("decimal(28,10)") - F.coalesce(locked.cast("decimal(28,10)"), F.lit(0))).cast("decimal(28,10)")


# Order types that wait for a trigger, all order types, and how long orders stand.
STOP_TYPES = ("STOP_MARKET", "STOP_LIMIT")
ORDER_TYPES = ("MARKET", "LIMIT", *STOP_TYPES)
TIMES_IN_FORCE = ("GTC", "GTD", "IOC", "FOK", "DAY")


def known(text: Column, names: tuple[str, ...]) -> Column:
    """A name in whatever case as the known one; other names stay as they are."""
    return F.when(F.upper(text).isin(*names), F.upper(text)).otherwise(text)


def order_fault(side: Column, order_type: Column, price: Column, quantity: Column, trigger_price: Column, direction: Column, trailing: Column) -> Column:
    """What is wrong with an order, or null.

    A side has a sign; prices and quantities that are given are above 0. A limit has a price. A
    stop has a trigger price and a direction, up or down, unless it trails: a trailing stop makes
    its own price and takes the direction from the side.
    """
    kind = known(order_type, ORDER_TYPES)
    stop = F.coalesce(kind.isin(*STOP_TYPES), F.lit(False)) & ~F.coalesce(trailing, F.lit(False))
    below = lambda c: F.coalesce(c <= 0, F.lit(False))
    return (
        F.when(side_sign(side).isNull(), "side")
        .when(kind.isNull(), "order_type")
        .when(quantity.isNull() | below(quantity), "quantity")
        .when(below(price) | (F.coalesce(kind.isin("LIMIT", "STOP_LIMIT"), F.lit(False)) & price.isNull()), "price")
        .when(stop & (trigger_price.isNull() | below(trigger_price)), "trigger_price")
        .when(stop & ~F.coalesce(F.upper(direction).isin("UP", "DOWN"), F.lit(False)), "trigger_direction")
    )


def amended(price: Column, quantity: Column, new_price: Column, new_quantity: Column, tick: Column, lot: Column, side: Column) -> Column:
    """Struct (price, quantity, fault) after an amendment: new prices to the passive tick, new quantities to the lot.

    An amendment without either, or to nothing, is a fault and leaves the order as it was.
    """
    p, q = round_tick(new_price, tick, "passive", side), round_lot(new_quantity, lot)
    fault = F.when(new_price.isNull() & new_quantity.isNull(), "nothing to amend").when(F.coalesce(p <= 0, F.lit(False)), "price").when(F.coalesce(q <= 0, F.lit(False)), "quantity")
    return F.struct(F.when(fault.isNull(), F.coalesce(p, price)).otherwise(price).alias("price"), F.when(fault.isNull(), F.coalesce(q, quantity)).otherwise(quantity).alias("quantity"), fault.alias("fault"))
