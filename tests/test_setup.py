import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.functions import finance, indicators, products
from tickloom.functions.resolution import Resolution
from tickloom.operators import align, components, keys, portfolio_backtest
from tickloom.operators.setup import DataConfig, Inputs, data_range, require_inputs
from tickloom.session import shared_path
from tickloom.sources import files
from tickloom.streaming import dispatch, streams

TODAY = dt.date(2024, 3, 31)


def day(text):
    return dt.date.fromisoformat(text)


@pytest.mark.parametrize(
    "given,want",
    [
        (None, (None, None)), (("2024-01-02", "2024-01-05"), (day("2024-01-02"), day("2024-01-05"))), (("2024-01-02", None), (day("2024-01-02"), TODAY)), ({"start_date": dt.datetime(2024, 1, 2, 9)}, (day("2024-01-02"), TODAY)),
        ({"start_date": "2024-01-02", "end_date": ""}, (day("2024-01-02"), TODAY)), ("ytd", (day("2024-01-01"), TODAY)), ("3d", (day("2024-03-28"), TODAY)), ("2w", (day("2024-03-17"), TODAY)), ("1mo", (day("2024-02-29"), TODAY)),
        ("13mo", (day("2023-02-28"), TODAY)), (Resolution("1y"), (day("2023-03-31"), TODAY)),
    ],
)
def test_data_range(given, want):
    assert data_range(given, TODAY) == want


@pytest.mark.parametrize("given", [("2024-02-01", "2024-01-01"), {"end_date": "2024-01-01"}, {"start_date": "2024-01-01", "x": 1}, "1h", "soon", (1, 2, 3), ("2024-04-01", None)])
def test_faulty_ranges(given):
    with pytest.raises(ValueError):
        data_range(given, TODAY)


def test_data_config():
    c = DataConfig(("1h", "1d", "7m", "q_L1"), resample={"1h": "60m"}, skip_first={"1d": False}, stale_wait={"7m": 5.0})
    done = c.settled({"MINUTE": [1, 5], "HOUR": [1], "QUOTE": [1]})
    assert done.resample == {"1_HOUR": "60_MINUTE", "1_DAY": "1_HOUR", "7_MINUTE": "1_MINUTE"} or done.resample["7_MINUTE"] == "1_MINUTE"
    assert done.skip_first["1_HOUR"] is False and done.skip_first["1_DAY"] is False and done.skip_first["7_MINUTE"] is True
    assert done.stale_wait["1_HOUR"] == 360.0 and done.stale_wait["7_MINUTE"] == 5.0 and not any("QUOTE" in k for k in done.stale_wait)
    assert done.settled({"MINUTE": [1, 5], "HOUR": [1], "QUOTE": [1]}) == done
    for wrong in ({"resample": {"1m": "1h"}}, {"resample": {"7m": "2m"}}, {"stale_wait": {"1m": 60}}, {"stale_wait": {"1t": 0}}):
        with pytest.raises(ValueError):
            DataConfig(("1m",), **wrong)


def test_inputs():
    bars = dict(has_bars=True, has_features=True)
    fine = Inputs("a", "1h", **bars)
    good = [fine, Inputs("s", "1h", is_strategy=True, has_bars=True, children=(fine,)), Inputs("m", "60m", has_bars=True, children=(fine,)), Inputs("w", "1_HOUR", "wide", children=(Inputs("c", "1h", "wide", **bars),))]
    for g in good:
        require_inputs(g)
    wrong = [
        Inputs("s", "1h", is_strategy=True, children=(fine,)), Inputs("m", "1h"), Inputs("m", "1m", children=(fine,)), Inputs("m", "60m", children=(fine,)), Inputs("m", "1h", children=(Inputs("c", "1h", "wide", **bars),)),
        Inputs("m", "1h", has_bars=True), Inputs("m", "1h", has_bars=True, children=(Inputs("c", "1h"),)),
    ]
    for w in wrong:
        with pytest.raises(ValueError):
            require_inputs(w)


def test_product_specs(spark):
    rows = [
        ("v", "BTC_USDT_PERP", None, None), ("v", "a_b", None, "basis"), (None, None, {}, "basis"), ("v", "A_USD_TULIP", {}, "asset type"), ("v", "A_USD_OPT", {"strike_price": "1", "expiration": "2026", "option_type": "put"}, None),
        ("v", "A_USD_OPT", {"strike_price": None, "expiration": " "}, "missing specs"), ("v", "A_USD_STK", {"expiration": "x"}, "unknown specs"), ("v", "A_USD_OPT", None, "missing specs"),
    ]
    df = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, source string, basis string, specs map<string,string>")
    got = {r.i: r for r in products.checked(df, products.rules(spark)).collect()}
    assert [got[i].fault for i in range(len(rows))] == [r[3] for r in rows]
    assert got[5].missing == ["expiration", "option_type", "strike_price"] and got[6].unknown == ["expiration"]
    same = products.identical(products.checked(df, products.rules(spark)).where("fault IS NULL")).collect()
    assert {r.symbol for r in same} == {"BTC_USDT_PERPETUAL", "A_USD_OPTION_2026_1_PUT"} and all(r.key.source == "V" for r in same)


def test_trimmed_numbers(spark):
    pairs = {"0.010": "0.01", "25000.00": "25000", "100": "100", "-0.50": "-0.5", "0.0": "0", "-0.000": "0", ".5": "0.5", "-.50": "-0.5", "+1.0": "1", "007.10": "7.1", "5.": "5", "1e5": None, "": None, "x": None, "0": "0", "1.0500": "1.05", None: None}
    df = spark.createDataFrame([(k, v) for k, v in pairs.items()], "text string, want string")
    assert {r.text: r.got for r in df.withColumn("got", finance.trim_zeros(F.col("text"))).collect()} == pairs


def test_order_faults(spark):
    rows = [
        ("buy", "market", None, 1.0, None, None, None, None), ("5", "LIMIT", 2.0, 1.0, None, None, None, None), ("hold", "market", None, 1.0, None, None, None, "side"), (None, "market", None, 1.0, None, None, None, "side"),
        ("buy", None, None, 1.0, None, None, None, "order_type"), ("buy", "limit", None, 1.0, None, None, None, "price"), ("buy", "market", -1.0, 1.0, None, None, None, "price"), ("buy", "market", None, None, None, None, None, "quantity"),
        ("sell", "stop_limit", 1.0, 1.0, None, "up", None, "trigger_price"), ("sell", "Stop_Market", None, 1.0, 3.0, None, None, "trigger_direction"), ("sell", "stop_market", None, 1.0, 3.0, "Down", None, None), ("sell", "stop_market", None, 1.0, None, None, True, None),
        ("sell", "iceberg", None, 1.0, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, side string, kind string, price double, quantity double, trigger double, direction string, trailing boolean, want string")
    got = df.withColumn("got", finance.order_fault(*(F.col(c) for c in ("side", "kind", "price", "quantity", "trigger", "direction", "trailing")))).collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]
    assert [r[0] for r in spark.createDataFrame([("gtc",), ("Odd",), (None,)], "t string").select(finance.known(F.col("t"), finance.TIMES_IN_FORCE)).collect()] == ["GTC", "Odd", None]


def test_files(spark):
    rows = [(dt.datetime(2024, 1, 1, 2, 3, 4, 5678), 'a,"b"', "1_HOUR", 1.5, None, 0.1, 1e-7, 2.0), (None, "ü", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, files.BARS)
    for kind in files.FORMATS:
        path = shared_path(spark, kind)
        files.store(df, path, kind)
        got, bad = files.load(spark, path, kind)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str) and bad.count() == 0, kind
    path = shared_path(spark, "odd")
    spark.createDataFrame([("ts,product,price,volume,seq",), ("2024-01-01T00:00:00,a,1.5,,3",), ("soon,a,1,1,1",), ("2024-01-01T00:00:00,a,x,1,1",)], "value string").coalesce(1).write.text(path)
    got, bad = files.load(spark, path, "csv", files.TICKS)
    assert [tuple(r) for r in got.collect()] == [(dt.datetime(2024, 1, 1), "a", 1.5, None, 3)] and sorted(r.text for r in bad.collect()) == ["2024-01-01T00:00:00,a,x,1,1", "soon,a,1,1,1"]
    with pytest.raises(ValueError):
        files.load(spark, path, "xml")


def frame(spark, days, product="a"):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=d), product, "1_DAY", float(d + 1)) for d in days]
    df = spark.createDataFrame(rows, "date timestamp, product string, resolution string, close double")
    return df.withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1})


def test_indicator_registry(spark):
    bars = frame(spark, range(6))
    out = indicators.with_indicator(indicators.with_indicator(bars, "sma", n=3), "BBANDS", "b_", n=3)
    assert [r.sma for r in out.orderBy("date").collect()] == [None, None, 2.0, 3.0, 4.0, 5.0] and {"b_upperband", "b_middleband", "b_lowerband"} <= set(out.columns)
    assert indicators.indicator("rsi").look_back() == 15 and indicators.indicator("SMA").look_back(n=7) == 7
    assert [r.rsi for r in indicators.with_indicator(bars, "RSI", n=3).orderBy("date").collect()] == [None, None, None, 100.0, 100.0, 100.0]
    for wrong in (dict(n=0), dict(n=True), dict(m=3), dict(field="none"), dict(n=2.5)):
        with pytest.raises(ValueError):
            indicators.with_indicator(bars, "SMA", **wrong)
    with pytest.raises(ValueError):
        indicators.with_indicator(out, "SMA")
    with pytest.raises(LookupError):
        indicators.with_indicator(bars, "nothing")
    with pytest.raises(ValueError):
        indicators.register("SMA", {}, ("x",), lambda bars, names: bars)


def test_gaps_of_a_panel(spark):
    bars = frame(spark, [0, 1, 4, 5]).union(frame(spark, range(6), "b")).union(frame(spark, [2], "c")).withColumn("close", F.when(~((F.col("product") == "b") & (F.col("close") == 2)), F.col("close")))
    got = sorted((r["product"], r.date.day) for r in portfolio_backtest.panel_gaps(bars, bars).collect())
    assert got == [("a", 3), ("a", 4), ("b", 2)]
    assert portfolio_backtest.panel_gaps(bars.limit(0), bars.limit(0)).count() == 0


def test_alignment_by_mode(spark, monkeypatch):
    spine = frame(spark, range(3)).select("date", "product", "resolution")
    other = frame(spark, [1]).select("date", "product", "resolution", F.col("close").alias("v"))
    assert [r.v for r in align.align(spine, other, "exact", "1d").collect()] == [2.0]
    assert [r.v for r in align.align(spine, other, "asof", "1d").orderBy("date").collect()] == [None, 2.0, 2.0]
    events = spark.createDataFrame([(dt.datetime(2024, 1, 2, 5), "a", 1), (dt.datetime(2024, 1, 3, 5), None, 2)], "ts timestamp, product string, e int")
    assert sorted((r.date.day, r.e) for r in align.align(spine, events, "event", "1d").collect()) == [(2, 1), (3, 2)]
    with pytest.raises(ValueError):
        align.align(spine, other, "nearest", "1d")
    empty = align.align(spine, other.limit(0), "asof", "1d")
    assert dict(empty.dtypes)["v"] == "double" and empty.where("v IS NOT NULL").count() == 0
    none = align.collapse_events(align.align_event(spine, events.limit(0), "1d"), ["ts"])
    assert none.count() == 0 and dict(none.dtypes)["event_count"] == "bigint" and "e:int" in dict(none.dtypes)["event_events"]
    assert sorted((r.date.day, r["product"]) for r in align.cross_spine(spine, spine.union(frame(spark, [0], "z").select(*spine.columns))).collect()) == [(d, p) for d in (1, 2, 3) for p in "az"]
    monkeypatch.setattr(align, "WIDE_PRODUCTS", 0)
    with pytest.raises(ValueError):
        align.cross_spine(spine, spine)


def test_columns_of_merges_do_not_clash(spark):
    bars = frame(spark, range(2))
    child = bars.select("date", "product", "resolution", F.col("close").alias("high"))
    with pytest.raises(ValueError, match="exist"):
        align.merge_child(bars, child, "1d", "1d")
    twin = components.Component("twin", "1d", lambda df: {"same": F.lit(1.0)})
    with pytest.raises(ValueError, match="exist"):
        components.Component("p", "1d", lambda df: {"own": F.lit(1.0)}, [twin, components.Component("other", "1d", lambda df: {"same": F.lit(2.0)})]).frame({"1d": bars})
    assert components.signal_names("m", 1) == ["m"] and components.signal_names("m", 2) == ["m-0", "m-1"]


def test_hooks_on_batches(spark):
    seen = []
    stream = streams.replay(spark, frame(spark, range(8)), "date", files=2)
    streams.on_batches(stream, lambda rows, batch: seen.append((batch, rows.count()))).awaitTermination()
    assert [b for b, _ in seen] == list(range(len(seen))) and sum(n for _, n in seen) == 8


def test_long_frames_are_checked(spark):
    bars = frame(spark, range(3))
    assert keys.require_long(bars) is bars
    for wrong, message in ((bars.drop("close"), "close"), (bars.union(bars), "unique"), (bars.drop("product"), "lacks"), (bars.withColumn("date", F.lit(None).cast("timestamp")), "null")):
        with pytest.raises(ValueError, match=message):
            keys.require_long(wrong)
    placed = bars.withColumn("row", F.monotonically_increasing_id())
    assert keys.require_long(bars.orderBy("date").withColumn("row", F.dayofmonth("date")), order="row") is not None
    with pytest.raises(ValueError, match="sorted"):
        keys.require_long(placed.withColumn("row", -F.dayofmonth("date")), order="row")


def test_channels_and_requests(spark):
    rows = [("g", 1, "b"), ("g", 2, "a"), ("g", 3, "c"), ("g", 9, "a"), ("g", 4, None), ("h", 1, "x")]
    df = spark.createDataFrame(rows, "g string, o int, name string")
    got = {(r.g, r.chunk): r.names for r in dispatch.subscriptions(df, "g", "o", "name", 2).collect()}
    assert got == {("g", 0): ["b", "a"], ("g", 1): ["c"], ("h", 0): ["x"]}
    names = df.select(dispatch.channel("book", F.col("name"), F.col("o")).alias("a"), dispatch.channel("trade", F.col("name")).alias("b")).collect()
    assert [(r.a, r.b) for r in names][:1] == [("book.1.b", "trade.b")] and (None, None) in [(r.a, r.b) for r in names]
    with pytest.raises(ValueError):
        dispatch.subscriptions(df, "g", "o", "name", 0)


def test_steps(spark):
    bars = frame(spark, range(4)).union(frame(spark, [1, 3], "b"))
    now = dt.datetime(2024, 1, 4, 12)
    assert sorted((r["product"], r.date.day) for r in dispatch.steps(bars, "1d", now).collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 2)]
    assert sorted((r["product"], r.date.day) for r in dispatch.steps(bars, "1d", now, warmup=2).collect()) == [("a", 2), ("a", 3)]
    assert sorted((r["product"], r.date.day) for r in dispatch.steps(bars, "1d", dt.datetime(2024, 1, 5), "wide", ["a", "b"]).collect()) == [("a", 2), ("a", 4), ("b", 2), ("b", 4)]
    assert dispatch.steps(bars, "1h", now).count() == 0 == dispatch.steps(bars, "1d", now, "wide", ["a", "c"]).count()
    for wrong in (dict(form="deep"), dict(warmup=0), dict(form="wide")):
        with pytest.raises(ValueError):
            dispatch.steps(bars, "1d", now, **wrong)
    child = frame(spark, [0, 2]).select("date", "product", F.col("close").alias("s"))
    assert sorted((r.date.day, r["product"], r.s, r.n_missing) for r in dispatch.missed(child, bars, ["s"]).collect()) == [(1, "a", 1.0, 0), (2, "a", None, 1), (2, "b", None, 1), (3, "a", 3.0, 0), (4, "a", None, 1), (4, "b", None, 1)]


def test_replay_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(streams, "SLICE_ROWS", 10)
    df = spark.range(200).select((F.timestamp_seconds(F.col("id") * 60)).alias("t"), "id")
    seen = []
    streams.on_batches(streams.replay(spark, df, "t"), lambda rows, batch: seen.append(sorted(r.id for r in rows.select("id").collect()))).awaitTermination()
    assert sum(seen, []) == list(range(200)) and len(seen) == 4
