import pytest
from pyspark.sql import functions as F

from tickloom.functions.resolution import Resolution, supported
from tickloom.operators import bars, components, keys, portfolio_backtest, reshape, signals, splits
from tickloom.session import nan_to_null, shared_path
from tickloom.sources import artifacts, market
from tickloom.streaming import streams


def test_resolution():
    assert str(Resolution("1m")) == "1_MINUTE" and repr(Resolution("15_minute")) == "15m"
    assert Resolution("1h") < Resolution("60h") and Resolution("60m") != Resolution("1h") and Resolution("60m").seconds() == 3600
    assert Resolution("q_L2").level == 2 and Resolution("tick").is_bar is False
    assert repr(Resolution("5m").finer()) == "1s" and repr(Resolution("5m").coarser()) == "1h"
    for bad in ("0m", "-1m", "5x", "m_L2"):
        with pytest.raises(ValueError):
            Resolution(bad)
    assert repr(supported(Resolution("10m"), {"MINUTE": [1, 3, 5]})) == "1m"
    assert repr(supported(Resolution("1d"), {"MINUTE": [1]})) == "1m"


def test_shift():
    assert bars.shift_seconds(Resolution("1h"), 30) == 1800
    with pytest.raises(ValueError):
        bars.shift_seconds(Resolution("1d"), 24)


def test_ratios_and_folds():
    assert splits.ratios(721) == (0.7, 0.2, 0.1)
    assert splits.ratios({"train": 0.5, "dev": 0.25}) == (0.5, 0.25, 0.25)
    assert splits.folds(12, 3) == [(0, 3, 3, 6), (0, 6, 6, 9), (0, 9, 9, 12)]
    with pytest.raises(ValueError):
        splits.folds(4, 5)


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", "1_HOUR"), (1, "a", "1_HOUR")], "date int, product string, resolution string")
    with pytest.raises(ValueError):
        keys.require_keys(df)
    assert keys.require_one_resolution(df) == "1_HOUR"
    assert keys.free_column(df.withColumn("_x", F.lit(1)).withColumn("x", F.lit(1)), "x") == "__x"
    nan = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"))
    assert {r.v for r in nan.collect()} == {None, 1.0}


def test_overlapping_conditions_raise(spark):
    df = spark.createDataFrame([(1, "a", "1_HOUR", 5.0)], "date int, product string, resolution string, close double")
    with pytest.raises(Exception, match="overlap"):
        signals.create_signal(df, F.col("close") > 1, F.col("close") > 2).collect()


def test_wide_names_round_trip(spark):
    rows = [(1, "a:b%3A", "1_HOUR", 1.0), (1, "c", "1_HOUR", None), (2, "c", "1_HOUR", 2.0)]
    df = spark.createDataFrame(rows, "date int, product string, resolution string, v double")
    back = reshape.unpivot_long(reshape.pivot_wide(df, ["v"]), ["v"])
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a:b%3A", "1_HOUR", 1.0), (2, "c", "1_HOUR", 2.0)]


def test_artifacts(spark):
    path = shared_path(spark, "bytes")
    artifacts.save_bytes(spark, path, "m", 1, b"one")
    artifacts.save_bytes(spark, path, "m", 2, b"two")
    assert artifacts.load_bytes(spark, path, "m") == b"two" and artifacts.load_bytes(spark, path, "m", 1) == b"one"
    assert artifacts.identity({"b": 1, "a": 2}) == artifacts.identity({"a": 2, "b": 1})
    with pytest.raises(market.DataNotFound):
        market.retrieve_or_fetch(spark, shared_path(spark, "none"))


def test_components(spark, sf):
    from tickloom.plans.bar_queries import daily, hourly

    data = {"1h": hourly(spark, sf), "1d": daily(spark, sf)}
    child = components.Component("trend", "1d", lambda df: {"trend": F.col("close") - F.col("open")})
    parent = components.Component("play", "1h", lambda df: {"play": F.col("close") * F.sign("trend")}, [child])
    out = parent.frame(data)
    assert parent.signals == ["play"] and out.count() == data["1h"].count()
    with pytest.raises(ValueError):
        components.Component("up", "1d", lambda df: {"up": F.lit(1)}, [components.Component("fine", "1h", lambda df: {"fine": F.lit(1)})]).frame(data)
    scored = components.predict(data["1d"], ["open", "close"], lambda x: x.sum(axis=1), "total")
    r = scored.first()
    assert r["total"] == pytest.approx(r["open"] + r["close"])
    with pytest.raises(TypeError):
        components.run_hook(lambda a, b: a, data["1d"])


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "date int, product string, x double")
    new = spark.createDataFrame([(2, "a", 5.0), (3, "a", 6.0)], "date int, product string, y double")
    got = streams.upsert(new, old, ["date", "product"], max_rows=2)
    assert sorted(tuple(r) for r in got.collect()) == [(2, "a", 2.0, 5.0), (3, "a", None, 6.0)]


def test_aliases_and_levels():
    for text, want in (("2hrs", "2h"), ("5mins", "5m"), ("3secs", "3s"), ("1yr", "1y"), ("2wks", "2w"), ("1mons", "1mo")):
        assert repr(Resolution(text)) == want
    q = Resolution("q_L2")
    assert [repr(x) for x in (q.to_unit(), q.finer(), q.coarser(), q.coarser().coarser(), q.finer().finer())] == ["1q_L2", "1q_L3", "1q_L1", "1t", "1q_L3"]
    assert repr(Resolution("1y").coarser()) == "1y" and repr(Resolution("1t").finer()) == "1q_L1"


def test_instructions_are_checked(spark):
    df = spark.createDataFrame([(1.0, 5.0)], "signal double, close double")
    for wrong in ({"long_only": True, "short_only": True}, {"fill_price": "high"}, {"order_quantity": True}):
        with pytest.raises(ValueError):
            signals.open_position(df, **wrong)
    for wrong in ({"take_profit": 0}, {"stop_loss": 1.5}, {"trailing_stop": 1.0}, {"stop_loss": 0.1, "trailing_stop": 0.1}, {"time_window": 0}, {"time_window": True}, {"fill_price": ""}):
        with pytest.raises(ValueError):
            signals.close_position(df, **wrong)
    for f in (signals.open_position, signals.close_position):
        with pytest.raises(ValueError):
            f(df.drop("signal"))
    assert signals.close_position(df, stop_loss=-0.2).first().stop_loss == 0.2


def test_panels_are_checked(spark):
    schema = "scenario int, date int, product string, close double, weight double"
    full = [(0, t, p, 10.0, 0.5) for t in range(4) for p in "ab"]
    ends = [r for r in full if r[1:3] not in ((0, "a"), (3, "b"))] + [(0, 3, "b", None, None)]
    assert portfolio_backtest.run_portfolio(spark.createDataFrame(ends, schema)).count() == len(ends)
    gap, null = [r for r in full if r[1:3] != (1, "a")], [(*r[:3], None, None) if r[1:3] == (1, "a") else r for r in full]
    priceless = full[:-1] + [(0, 3, "b", None, 0.5)]
    for rows in (gap, null, priceless):
        with pytest.raises(Exception, match="a close is missing|a weight has no close"):
            portfolio_backtest.run_portfolio(spark.createDataFrame(rows, schema)).collect()


def test_upsert_replaces_with_nulls_and_keeps_the_least_keys(spark):
    old = spark.createDataFrame([(1, "a", 1.0, 7), (1, "b", 2.0, 8), (2, "a", 3.0, 9)], "date int, product string, x double, y int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 5.0)], "date int, product string, x double")
    got = streams.upsert(new, old, ["date", "product"], max_rows=3).collect()
    assert sorted(map(tuple, got)) == [(1, "a", None, 7), (2, "a", 3.0, 9), (2, "b", 5.0, None)]
