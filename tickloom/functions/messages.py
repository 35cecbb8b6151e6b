"""Rule sets of a venue's messages, and the envelopes of its responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tickloom.functions.jsonrules import ONE, Each, parsed


def number(c: Column) -> Column:
    """A text that is no number is null, here and below."""
    return c.try_cast("double")


def exact(c: Column) -> Column:
    return c.try_cast("decimal(38,18)")


def seconds(c: Column) -> Column:
    """Milliseconds as seconds."""
    return c.try_cast("double") / 1000


def negated(c: Column) -> Column:
    return ~c.try_cast("boolean")


#: Bars: prices and volume are texts of numbers, and a bar that is not confirmed is still open.
KLINE = {
    "ts": ["ts", number],
    "channel": ["topic"],
    "data": Each(
        ("data",),
        {
            "start_ts": ["start", number], "end_ts": ["end", number], "ts": ["timestamp", number],
            "open": ["open", number], "high": ["high", number], "low": ["low", number], "close": ["close", number], "volume": ["volume", number],
            "is_incremental": ["confirm", negated],
            "extra": Each((), {"turnover": ["turnover", number]}),
        },
        many=True,
    ),
}

#: Trades: a volume may have a sign, which says nothing.
TRADES = {
    "ts": ["ts", number],
    "channel": ["topic"],
    "data": Each(
        ("data",),
        {
            "ts": ["T", number], "price": ["p", number], "volume": ["v", number, F.abs],
            "extra": Each((), {"trade_id": ["i"], "taker_side": ["S"], "tick_direction": ["L"], "is_block_trade": ["BT"]}),
        },
        many=True,
    ),
}

#: Balances: the account is the one element of a list, with a list of currencies.
BALANCE = {
    "ts": ["creationTime", seconds],
    "channel": ["topic"],
    "account": Each(
        ("data", ONE),
        {
            "cash": ["totalWalletBalance", exact], "equity": ["totalEquity", exact], "available": ["totalAvailableBalance", exact],
            "initial_margin": ["totalInitialMargin", exact], "maintenance_margin": ["totalMaintenanceMargin", exact],
        },
    ),
    "balances": Each(
        ("data", ONE, "coin"),
        {"currency": ["coin"], "cash": ["walletBalance", exact], "equity": ["equity", exact], "locked": ["locked", exact], "unrealized_pnl": ["unrealisedPnl", exact]},
        many=True,
    ),
}


def balances(df: DataFrame, message: str, keep: list[str] = []) -> DataFrame:
    """Balance messages: ``ts``, ``channel``, ``account``, and ``balances`` with what is available instead of locked."""
    plain = parsed(df, message, BALANCE, keep)
    usable = F.transform("balances", lambda b: b.withField("available", (b["cash"] - b["locked"]).cast("decimal(38,18)")).dropFields("locked"))
    return plain.withColumn("balances", usable)


def balance_updates(df: DataFrame, message: str, keep: list[str] = []) -> DataFrame:
    """A row for each currency of each balance message; a currency that a message has twice counts as it stood last."""
    rows = balances(df, message, keep).select(*keep, "ts", "channel", F.posexplode("balances").alias("at", "b"))
    last = rows.groupBy(*keep, "ts", "channel", F.col("b.currency").alias("currency")).agg(F.max_by("b", "at").alias("b"))
    return last.select(*keep, "ts", "channel", "currency", *(F.col(f"b.{c}").alias(c) for c in ("cash", "equity", "unrealized_pnl", "available")))


#: What may be wrong with a response, in the order in which it is looked at.
FAULTS = ("no json", "failed", "wrong type", "no ts")


def checked(df: DataFrame, message: str, kind: str = "list", ts_required: bool = True) -> DataFrame:
    """Responses with ``fault`` (null for good ones), ``error``, ``ts`` and ``data`` as JSON text.

    A response is an object with ``success``, ``error`` and ``response``, which has ``ts`` and
    ``data``. Without ``success`` true it has failed; ``data`` must be of ``kind``, ``list`` or
    ``dict``; ``ts`` must be there if required. Null texts are no JSON.
    """
    if kind not in ("list", "dict"):
        raise ValueError("data is a list or a dict")
    taken = {"fault", "error", "ts", "data"} & set(df.columns)
    if taken:
        raise ValueError(f"there are columns of these names already: {sorted(taken)}")
    name = "response"
    while name in df.columns:
        name = "_" + name
    v = F.col(name)
    data = F.try_variant_get(v, "$.response.data", "variant")
    found = df.withColumn(name, F.try_parse_json(message)).select(
        *df.columns, name, F.try_variant_get(v, "$.success", "boolean").alias("_ok"), F.try_variant_get(v, "$.error", "string").alias("_error"),
        F.try_variant_get(v, "$.response.ts", "double").alias("ts"), F.to_json(data).alias("data"), F.schema_of_variant(data).alias("_type"),
    )
    of_kind = F.col("_type").startswith("ARRAY<" if kind == "list" else "OBJECT<")
    fault = (
        F.when(F.schema_of_variant(v).isNull() | ~F.schema_of_variant(v).startswith("OBJECT<"), FAULTS[0])
        .when(~F.coalesce("_ok", F.lit(False)), FAULTS[1])
        .when(~F.coalesce(of_kind, F.lit(False)), FAULTS[2])
    )
    if ts_required:
        fault = fault.when(F.col("ts").isNull(), FAULTS[3])
    error = F.when(fault == FAULTS[1], F.coalesce("_error", F.lit("unknown"))).when(fault == FAULTS[2], F.concat(F.lit(f"expected a {kind}, got "), F.coalesce("_type", F.lit("nothing"))))
    return found.select(*df.columns, fault.alias("fault"), error.alias("error"), "ts", F.when(fault.isNull(), F.col("data")).alias("data"))


def store_checked(responses: DataFrame, path: str) -> dict[str, int]:
    """Writes checked responses in one pass, good ones below ``outcome=good`` and others below their fault; returns counts.

    The counts are taken while rows are written. Readers of one outcome read its folder only.
    """
    counts = Observation("outcomes")
    outcome = F.coalesce("fault", F.lit("good"))
    seen = responses.withColumn("outcome", outcome).observe(counts, *(F.count_if(F.col("outcome") == o).alias(o) for o in ("good", *FAULTS)))
    seen.write.mode("overwrite").partitionBy("outcome").parquet(path)
    return dict(counts.get)
