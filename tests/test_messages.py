import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tickloom.functions import jsonrules, messages
from tickloom.functions.jsonrules import ONE, Const, Each
from tickloom.operators import product_backtest, signals
from tickloom.session import shared_path


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id int, value string")


def parse(spark, rules, *values):
    return [r.asDict(recursive=True) for r in jsonrules.parsed(texts(spark, *values), "value", rules).collect()]


def test_rules(spark):
    rules = {
        "a": ["x", "a b", lambda c: c.cast("int")], "second": ["l", 1], "kind": Const("k"), "only": ["m", ONE, "v"],
        "part": Each(("x",), {"whole": ["a b"]}), "all": Each(("l2",), {"v": ["v", F.upper]}, many=True), "same": Each((), {"y": ["y"]}),
    }
    good = '{"x": {"a b": 5}, "l": [1, 2], "m": [{"v": 7}], "l2": [{"v": "p"}, {}, null], "y": true}'
    odd = '{"x": null, "l": {}, "m": [{"v": 7}, {"v": 8}], "l2": []}'
    nothing = {"a": None, "second": None, "kind": "k", "only": None, "part": None, "all": None}
    got = parse(spark, rules, good, odd, "{broken", None, "[]", '"text"')
    assert got[0] == {"a": 5, "second": "2", "kind": "k", "only": "7", "part": {"whole": "5"}, "all": [{"v": "P"}, {"v": None}, {"v": None}], "same": {"y": "true"}}
    assert got[1] == nothing | {"all": [], "same": {"y": None}}
    assert got[2] == got[3] == nothing | {"same": None}
    assert got[4] == got[5] == nothing | {"same": {"y": None}}
    with pytest.raises(ValueError):
        parse(spark, {"a": ["it's"]}, good)


def test_a_message_is_parsed_once(spark):
    """However many rules read from it, the optimised plan parses a message once."""
    plan = jsonrules.parsed(texts(spark, "{}"), "value", messages.KLINE | {f"k{i}": [f"k{i}", "deep", F.upper] for i in range(5)}, ["id"])
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("parseJson") + shown.count("parse_json") == 1, shown


def test_names_of_the_frame_do_not_clash(spark):
    df = texts(spark, '{"v": 1}').withColumnsRenamed({"value": "message"}).withColumn("_message", F.lit(1))
    assert [tuple(r) for r in jsonrules.parsed(df, "message", {"v": ["v"]}, ["message", "_message"]).collect()] == [('{"v": 1}', 1, "1")]


def test_kline_and_trades(spark):
    bar = '{"topic": "k.1", "ts": 5, "data": [{"start": 0, "end": 59999, "timestamp": 60001, "open": "1.5", "close": "x", "confirm": true, "turnover": "9"}, {"confirm": false}]}'
    got = parse(spark, messages.KLINE, bar)[0]
    assert got["channel"] == "k.1" and [b["is_incremental"] for b in got["data"]] == [False, True] and got["data"][0]["open"] == 1.5 and got["data"][0]["extra"] == {"turnover": 9.0}
    got = parse(spark, messages.TRADES, '{"data": [{"T": 1, "p": "2.5", "v": "-3", "BT": false, "S": "Sell"}]}')[0]["data"]
    assert got == [{"ts": 1.0, "price": 2.5, "volume": 3.0, "extra": {"trade_id": None, "taker_side": "Sell", "tick_direction": None, "is_block_trade": "false"}}]


def test_balances(spark):
    coin = lambda name, cash, locked: f'{{"coin": "{name}", "walletBalance": "{cash}", "locked": "{locked}"}}'
    one = f'{{"topic": "w", "creationTime": 1500, "data": [{{"totalWalletBalance": "0.1", "coin": [{coin("A", "0.3", "0.1")}, {coin("B", "", "0")}, {coin("A", "0.7", "0.1")}]}}]}}'
    two = one.replace('"data": [', '"data": [{}, ')
    rows = {(r.id, r.currency): r for r in messages.balance_updates(texts(spark, one, two, "x", None), "value", ["id"]).collect()}
    assert set(rows) == {(0, "A"), (0, "B")} and rows[0, "A"].available == Decimal("0.6") and rows[0, "A"].ts == 1.5 and rows[0, "B"].available is None
    whole = messages.balances(texts(spark, one), "value").first()
    assert whole.account.cash == Decimal("0.1") and "locked" not in whole.balances[0].asDict()


def test_envelopes(spark):
    values = [
        ('{"success": true, "response": {"ts": 1, "data": [1, "a"]}}', None), ('{"success": true, "response": {"data": []}}', "no ts"), ('{"success": true, "response": {"ts": 1, "data": {}}}', "wrong type"),
        ('{"success": true, "response": {"ts": 1}}', "wrong type"), ('{"success": true, "response": {"ts": 1, "data": null}}', "wrong type"), ('{"success": false, "error": "e"}', "failed"), ('{"success": "no"}', "failed"),
        ("{}", "failed"), ("[]", "no json"), ("", "no json"), ("{", "no json"), (None, "no json"),
    ]
    df = texts(spark, *(v for v, _ in values))
    got = {r.id: r for r in messages.checked(df, "value").collect()}
    assert [got[i].fault for i in range(len(values))] == [f for _, f in values] and got[0].data == '[1,"a"]' and got[5].error == "e" and got[7].error == "unknown"
    assert [r.fault for r in messages.checked(df.where("id = 1"), "value", ts_required=False).collect()] == [None]
    assert [r.fault for r in messages.checked(df.where("id = 2"), "value", kind="dict").collect()] == [None]
    path = shared_path(spark, "responses")
    counts = messages.store_checked(messages.checked(df, "value"), path)
    assert counts == {"good": 1, "no json": 4, "failed": 3, "wrong type": 3, "no ts": 1}
    assert [r.id for r in spark.read.parquet(f"{path}/outcome=good").collect()] == [0]
    for wrong in (lambda: messages.checked(df.withColumn("ts", F.lit(1)), "value"), lambda: messages.checked(df, "value", kind="text")):
        with pytest.raises(ValueError):
            wrong()


def test_default_orders_trade_and_signs_are_checked(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("a", "1_DAY", day + dt.timedelta(days=i), 10.0 + i, 1.0 if i < 5 else None) for i in range(7)]
    bars = spark.createDataFrame([(*r[:3], r[3], r[3] + 1, r[3] - 1, r[3], r[4]) for r in rows], "product string, resolution string, date timestamp, open double, high double, low double, close double, signal double")
    held = product_backtest.run_machine(signals.open_position(bars)).orderBy("date").collect()
    assert [r.position for r in held] == [0, 1, 2, 3, 4, 5, 5] and [r.trade_price for r in held] == [None, 10, 11, 12, 13, 14, None]
    only_even = signals.open_position(bars, F.when(F.dayofmonth("date") % 2 == 0, F.col("close")), F.lit(2))
    assert [r.position for r in product_backtest.run_machine(only_even).orderBy("date").collect()] == [0, 0, 2, 2, 4, 4, 4]
    for price, quantity in ((F.lit(-1), 1), (None, F.lit(0)), (F.lit(0.0), 1)):
        with pytest.raises(Exception, match="above 0"):
            signals.open_position(bars, price, quantity).collect()
    with pytest.raises(ValueError):
        signals.open_position(bars, order_quantity=-3)
