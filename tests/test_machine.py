"""The backtest machines against each other and against hand-worked bars."""

import datetime as dt

import pytest

from tickloom.operators import portfolio_backtest as pf
from tickloom.operators import product_backtest as pb
from tickloom.plans import catalog

NONE = dict(pb.DEFAULTS)


def run(bars):
    """Results of (open, high, low, close, instructions) bars through the machine, with stop prices on their order rows."""
    machine, out = pb.Machine(), []
    for o, h, low, c, more in bars:
        result, stop = machine.step({**NONE, "signal": None, "open": o, "high": h, "low": low, "close": c, **more})
        if out:
            out[-1]["stop_price"] = stop
        out.append(result)
    return out


def order(signal=1.0, price=10.0, quantity=1.0, **more):
    return {"signal": signal, "order_price": price, "order_quantity": quantity, **more}


def test_market_order_fills_at_previous_close():
    a, b = run([(10, 11, 9, 10, order()), (12, 13, 11, 12, {})])
    assert (a["order_size"], b["trade_price"], b["trade_size"], b["position"], b["avg_price"]) == (1, 10, 1, 1, 10)


def test_market_order_fills_at_open():
    assert run([(10, 11, 9, 10, order(entry_fill="open")), (12, 13, 11, 12, {})])[1]["trade_price"] == 12


def test_limit_fills_inside_the_bar_over_a_gap_or_not_at_all():
    assert run([(10, 11, 9, 10, order(price=9.0)), (10, 11, 8, 10, {})])[1]["trade_price"] == 9
    assert run([(10, 11, 9, 10, order(price=9.0)), (8, 11, 8, 10, {})])[1]["trade_price"] == 8
    missed = run([(10, 11, 9, 10, order(price=9.0)), (10, 11, 9.5, 10, {}), (8, 8, 8, 8, {})])
    assert missed[1]["trade_price"] is None and missed[2]["position"] == 0


@pytest.mark.parametrize("signal", [1.0, -1.0])
def test_stop_loss_at_once_over_a_gap_and_inside(signal):
    hold = {"stop_loss": 0.1}
    level = 10 - signal
    flat = (10, 10, 10, 10)
    inside = run([(*flat, order(signal, **hold)), (*flat, hold), (10, 10 if signal > 0 else level, level if signal > 0 else 10, 10, {})])
    assert (inside[2]["trade_price"], inside[2]["position"], inside[1]["stop_price"]) == (level, 0, level)
    beyond = 10 - 2 * signal
    gap = run([(*flat, order(signal, **hold)), (*flat, hold), (beyond, max(beyond, 10), min(beyond, 10), beyond, {})])
    assert gap[2]["trade_price"] == beyond
    crash = run([(*flat, order(signal, **hold)), (10, 12, 7, beyond, hold), (*flat, {})])
    assert crash[2]["trade_price"] == beyond and crash[2]["position"] == 0


def test_stop_loss_beats_take_profit_and_limit_beats_stop():
    flat, both = (10, 10, 10, 10), {"stop_loss": 0.1, "take_profit": 0.1}
    r = run([(*flat, order(**both)), (*flat, both), (10, 12, 8, 10, {})])
    assert r[2]["trade_price"] == 9
    r = run([(*flat, order()), (*flat, {**order(1.0, 9.5), "stop_loss": 0.1}), (10, 10, 8, 9, {})])
    assert (r[2]["trade_price"], r[2]["position"]) == (9.5, 2)


def test_time_window_and_trailing_stop():
    flat, timed = (10, 10, 10, 10), {"time_window": 2}
    r = run([(*flat, order(**timed)), (*flat, timed), (*flat, timed), (*flat, timed)])
    assert [x["position"] for x in r] == [0, 1, 1, 0]
    trail = {"trailing_stop": 0.1}
    r = run([(*flat, order(**trail)), (10, 20, 10, 19, trail), (19, 19, 17, 17.5, {})])
    assert r[2]["trade_price"] == 18 and r[2]["position"] == 0


def test_scale_in_reduce_flip_and_first_only():
    flat = (10, 10, 10, 10)
    r = run([(*flat, order()), (12, 12, 12, 12, order(price=12.0)), (12, 12, 12, 12, order(-1.0, 12.0)), (*flat, {})])
    assert [x["position"] for x in r] == [0, 1, 2, -1] and r[2]["avg_price"] == 11 and r[3]["avg_price"] == 12
    once = {"first_only": True}
    r = run([(*flat, order(**once)), (*flat, order(**once)), (*flat, order(-1.0, **once)), (*flat, {})])
    assert [x["position"] for x in r] == [0, 1, 1, -1]
    only = {"long_only": True}
    r = run([(*flat, order(**only)), (*flat, order(-1.0, **only)), (*flat, order(-1.0, **only)), (*flat, {})])
    assert [x["position"] for x in r] == [0, 1, 0, 0]


def test_no_price_no_order_and_out_of_universe_closes():
    flat = (10, 10, 10, 10)
    assert run([(*flat, order(price=None)), (*flat, {})])[1]["position"] == 0
    r = run([(*flat, order()), (*flat, {}), (11, 11, 11, 11, {"covered": False})])
    assert (r[2]["trade_price"], r[2]["trade_size"], r[2]["position"]) == (11, -1, 0)


def test_stream_equals_batch(spark, sf):
    from pyspark.sql import functions as F

    from tickloom.plans.trade_queries import rounded, signals

    s = signals(spark, sf).withColumns({"order_price": F.col("close"), "order_quantity": F.lit(1.0), "stop_loss": F.lit(0.3), "take_profit": F.lit(0.5)})
    batch = {(r.date, r["product"]): r for r in rounded(pb.run_machine(s)).collect()}
    live = catalog.queries()["stream_backtest"](spark, sf).collect()
    assert len(live) >= len(batch) - 5
    for r in live:
        assert r.asDict() == {k: batch[r.date, r["product"]][k] for k in r.asDict()}


def test_portfolio_identity_and_exit():
    book = pf.Portfolio(1000.0, True)
    day = dt.date(2024, 1, 1)
    book.step(day, {"a": {"close": 10.0, "weight": 0.5}, "b": {"close": 20.0, "weight": 0.5}})
    rows = book.step(day, {"a": {"close": 11.0, "weight": None}, "b": {"close": 20.0, "weight": 0.2}})
    assert rows[0]["position"] == 50 and rows[1]["position"] == 25 and rows[0]["equity"] == 1050
    assert rows[1]["order_size"] == pytest.approx(0.2 * (1050 - 550) / 20 - 25)
    rows = book.step(day, {"a": {"close": None, "weight": None}, "b": {"close": 20.0, "weight": None}})
    rows = book.step(day, {"a": {"close": None, "weight": None}, "b": {"close": 20.0, "weight": None}})
    assert rows[0]["position"] == 0 and rows[0]["trade_price"] == 0.0
    with pytest.raises(ValueError):
        pf.Portfolio(1.0, False).step(day, {"a": {"close": 1.0, "weight": 0.5}}) and book.step(day, {"b": {"close": -1e9, "weight": 0.5}})


def test_portfolio_drift_keeps_equity(spark, sf):
    rows = catalog.queries()["portfolio_drift"](spark, sf).collect()
    by_date = {}
    for r in rows:
        by_date.setdefault((r.scenario, r.date), []).append(r)
    for day in by_date.values():
        assert day[0].equity == pytest.approx(day[0].cash + sum(r.position * r.close for r in day), rel=1e-6)
