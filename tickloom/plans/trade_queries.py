"""Queries on signals, backtests, splits, indicators, finance functions, JSON and books."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import books, finance, indicators, jsonrules, messages, products
from tickloom.operators import components, folds
from tickloom.operators import portfolio_backtest as pf
from tickloom.operators import product_backtest as pb
from tickloom.operators import signals as sg
from tickloom.operators import splits
from tickloom.plans.bar_queries import daily, hourly
from tickloom.plans.registry import BAR, CHANGES, DAILY, HOURLY, SIGNALS, query
from tickloom.session import shared_path
from tickloom.sources import files
from tickloom.sources import market as m
from tickloom.streaming import dispatch, streams


def signals(spark, d) -> DataFrame:
    return sg.create_signal(hourly(spark, d), F.col("close") > 60, F.col("close") < 30)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


@query(f"WITH {SIGNALS} SELECT {BAR}, CASE WHEN date BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' THEN signal END AS signal FROM s")
def create_signal(spark, d):
    return sg.create_signal(hourly(spark, d), F.col("close") > 60, F.col("close") < 30, start=dt.datetime(2024, 1, 3), end=dt.datetime(2024, 1, 20))


@query(f"WITH {CHANGES} SELECT date, product, filled FROM f")
def ffill_signal(spark, d):
    return signals(spark, d).withColumn("filled", sg.filled()).select("date", "product", "filled")


@query(f"WITH {CHANGES} SELECT date, product, changed FROM c")
def signal_change(spark, d):
    return sg.with_changes(signals(spark, d)).select("date", "product", "changed")


@query(f"WITH {CHANGES} SELECT date, product, CASE WHEN changed THEN signal END AS signal FROM c")
def signal_first_only(spark, d):
    return sg.first_only(signals(spark, d)).select("date", "product", "signal")


@query(f"WITH {CHANGES} SELECT date, product, streak FROM k")
def signal_streak(spark, d):
    return sg.with_changes(signals(spark, d)).select("date", "product", "streak")


@query(f"WITH {HOURLY} SELECT date, product, round(lead(close) OVER (PARTITION BY product ORDER BY date) / close - 1, 6) AS forward_return FROM bars")
def forward_return(spark, d):
    after = F.lead("close").over(Window.partitionBy("product").orderBy("date"))
    return rounded(hourly(spark, d).select("date", "product", (after / F.col("close") - 1).alias("forward_return")))


@query(f"WITH {HOURLY}, p AS (SELECT *, CASE WHEN day(date) % 10 = 1 AND hour(date) = 12 THEN close END AS level FROM bars) SELECT date, product, last_value(level IGNORE NULLS) OVER (PARTITION BY product ORDER BY date ROWS UNBOUNDED PRECEDING) AS level FROM p")
def segment_params(spark, d):
    h = hourly(spark, d)
    starts = h.where("day(date) % 10 = 1 AND hour(date) = 12").select("product", "date", F.col("close").alias("level"))
    return sg.segment_params(h, starts, ["level"]).select("date", "product", "level")


@query(f"WITH {HOURLY} SELECT x.product, count(*) AS n_dates FROM (SELECT product, date FROM bars WHERE close > 40) x JOIN (SELECT product, date FROM bars WHERE close < 60) y ON x.product = y.product AND x.date = y.date GROUP BY 1")
def segment_overlap(spark, d):
    h = hourly(spark, d).select("product", "date", "close")
    both = h.where("close > 40").select("product", "date").intersect(h.where("close < 60").select("product", "date"))
    return both.groupBy("product").agg(F.count(F.lit(1)).alias("n_dates"))


def market_sql(counted: str) -> str:
    return (
        f"WITH {CHANGES}, n AS (SELECT *, sum(({counted})::INT) OVER x AS n, sum(CASE WHEN {counted} THEN close END) OVER x AS paid FROM k "
        "WINDOW x AS (PARTITION BY product, streak ORDER BY date ROWS UNBOUNDED PRECEDING)), "
        "p AS (SELECT *, coalesce(lag(filled * 2 * n) OVER y, 0) AS position, lag(paid / nullif(n, 0)) OVER y AS average, lag(close) OVER y AS before FROM n WINDOW y AS (PARTITION BY product ORDER BY date)), "
        "q AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY product ORDER BY date), 0) AS held FROM p) "
        "SELECT date, product, signal, CASE WHEN position <> held THEN before END AS trade_price, CASE WHEN position <> held THEN position - held END AS trade_size, position, "
        "round(CASE WHEN position <> 0 THEN average END, 6) AS avg_price FROM q"
    )


def _market(df: DataFrame) -> DataFrame:
    return df.select("date", "product", "signal", "trade_price", "trade_size", "position", F.round("avg_price", 6).alias("avg_price"))


@query(market_sql("signal IS NOT NULL"))
def backtest_market(spark, d):
    return _market(pb.market_orders(signals(spark, d), 2.0))


@query(market_sql("signal IS NOT NULL AND changed"))
def backtest_first_only(spark, d):
    return _market(pb.market_orders(signals(spark, d), 2.0, once=True))


@query(market_sql("signal IS NOT NULL"))
def backtest_machine(spark, d):
    """The state machine on the orders of the closed form."""
    s = signals(spark, d).withColumns({"order_price": F.col("close"), "order_quantity": F.lit(2.0)})
    return _market(pb.run_machine(s))


@query(market_sql("signal IS NOT NULL").replace("2 * n", "1 * n"))
def open_position_market(spark, d):
    """Orders as ``open_position`` makes them by default, through the machine: at the close, a unit each."""
    return _market(pb.run_machine(sg.open_position(signals(spark, d))))


STOPS = (
    f"WITH RECURSIVE {SIGNALS}, r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY date) AS i FROM s), "
    # State after each bar: position, average, pending order's size and price, pending stop and target, last signal, traded in the streak.
    "m(product, i, pos, av, osz, opx, sl, tp, ls, tr, tpx, tsz) AS ("
    "SELECT product, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, false, NULL::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT product FROM s) "
    "UNION ALL SELECT product, i, pos, av, CASE WHEN placed THEN nsz END, CASE WHEN placed THEN close END, CASE WHEN pos <> 0 THEN av * (1 - sign(pos) * 0.3) END, "
    "CASE WHEN pos <> 0 THEN av * (1 + sign(pos) * 0.5) END, ls, tr, tpx, tsz FROM ("
    "SELECT *, signal IS NOT NULL AND NOT tr AND nsz <> 0 AS placed FROM ("
    "SELECT product, i, close, signal, npos AS pos, CASE WHEN npos = 0 THEN 0 WHEN opos * npos <= 0 THEN tpx WHEN tsz IS NULL THEN av WHEN abs(npos) > abs(opos) THEN (av * opos + tpx * tsz) / npos ELSE av END AS av, "
    "coalesce(signal, ls) AS ls, CASE WHEN signal IS NOT NULL AND signal IS DISTINCT FROM ls THEN false ELSE tr OR by_order END AS tr, "
    "signal * 1.0 - CASE WHEN npos * signal < 0 THEN npos ELSE 0 END AS nsz, tpx, tsz FROM ("
    "SELECT *, opos + coalesce(tsz, 0) AS npos FROM ("
    "SELECT *, pos AS opos, CASE WHEN stopped IN ('at once', 'gap') THEN CASE WHEN stopped = 'gap' THEN open ELSE pc END WHEN osz IS NOT NULL THEN pc WHEN stopped = 'inside' THEN lvl END AS tpx, "
    "CASE WHEN stopped IN ('at once', 'gap') THEN -pos WHEN osz IS NOT NULL THEN osz WHEN stopped = 'inside' THEN -pos END AS tsz, "
    "osz IS NOT NULL AND coalesce(stopped, '') NOT IN ('at once', 'gap') AS by_order FROM ("
    "SELECT *, coalesce(s1, s2) AS stopped, CASE WHEN s1 IS NOT NULL THEN sl ELSE tp END AS lvl FROM ("
    "SELECT m.product, m.i + 1 AS i, pos, av, osz, opx, sl, tp, ls, tr, n.open, n.high, n.low, n.close, n.signal, b.close AS pc, "
    "CASE WHEN sl IS NULL OR pos = 0 THEN NULL WHEN pos > 0 THEN CASE WHEN b.close <= sl THEN 'at once' WHEN n.open < sl THEN 'gap' WHEN n.low <= sl THEN 'inside' END "
    "ELSE CASE WHEN b.close >= sl THEN 'at once' WHEN n.open > sl THEN 'gap' WHEN n.high >= sl THEN 'inside' END END AS s1, "
    "CASE WHEN tp IS NULL OR pos = 0 THEN NULL WHEN pos < 0 THEN CASE WHEN b.close <= tp THEN 'at once' WHEN n.open < tp THEN 'gap' WHEN n.low <= tp THEN 'inside' END "
    "ELSE CASE WHEN b.close >= tp THEN 'at once' WHEN n.open > tp THEN 'gap' WHEN n.high >= tp THEN 'inside' END END AS s2 "
    "FROM m JOIN r n ON n.product = m.product AND n.i = m.i + 1 LEFT JOIN r b ON b.product = m.product AND b.i = m.i))))))) "
    "SELECT r.date, r.product, round(tpx, 6) AS trade_price, round(tsz, 6) AS trade_size, round(pos, 6) AS position, round(CASE WHEN pos <> 0 THEN av END, 6) AS avg_price FROM m JOIN r ON r.product = m.product AND r.i = m.i"
)


@query(STOPS)
def backtest_stops(spark, d):
    s = signals(spark, d).withColumns({"order_price": F.col("close"), "order_quantity": F.lit(1.0), "first_only": F.lit(True), "stop_loss": F.lit(0.3), "take_profit": F.lit(0.5)})
    return rounded(pb.run_machine(s).select("date", "product", "trade_price", "trade_size", "position", "avg_price"))


@query()
def backtest_limits(spark, d):
    """Limit orders with trailing stops and time windows; the tests hold the machine against hand-worked bars."""
    s = signals(spark, d).withColumns({"order_price": F.col("close") * F.when(F.col("signal") > 0, 0.95).otherwise(1.05), "order_quantity": F.lit(1.0), "trailing_stop": F.lit(0.4), "time_window": F.lit(6), "entry_fill": F.lit("open")})
    return rounded(pb.run_machine(s))


@query(f"WITH {SIGNALS} SELECT product, date, chunk FROM s JOIN (SELECT date, ntile(4) OVER (ORDER BY date) - 1 AS chunk FROM (SELECT DISTINCT date FROM s)) USING (date)")
def time_chunks(spark, d):
    return pb.time_chunks(signals(spark, d), 4).select("product", "date", F.col("chunk").cast("bigint").alias("chunk"))


@query(
    f"WITH {SIGNALS}, g AS (SELECT s.*, chunk FROM s JOIN (SELECT date, ntile(4) OVER (ORDER BY date) - 1 AS chunk FROM (SELECT DISTINCT date FROM s)) USING (date)), "
    "f AS (SELECT *, last_value(signal IGNORE NULLS) OVER (PARTITION BY chunk, product ORDER BY date ROWS UNBOUNDED PRECEDING) AS filled FROM g) "
    "SELECT chunk, date, product, coalesce(lag(filled) OVER (PARTITION BY chunk, product ORDER BY date), 0) AS position FROM f"
)
def backtest_chunked(spark, d):
    s = pb.time_chunks(signals(spark, d), 4).withColumns({"order_price": F.col("close"), "order_quantity": F.lit(1.0), "first_only": F.lit(True)})
    return pb.run_machine(s, ["chunk", "product", "resolution"]).select(F.col("chunk").cast("bigint").alias("chunk"), "date", "product", "position")


@query(f"WITH {HOURLY} SELECT date, product, concat_ws(',', CASE WHEN close > open THEN 'sc' END, CASE WHEN volume > 1 THEN 'tp' END, CASE WHEN low < 20 THEN 'sl' END) AS remark FROM bars")
def remark(spark, d):
    h = hourly(spark, d).select("date", "product", (F.col("close") > F.col("open")).alias("_a"), (F.col("volume") > 1).alias("_b"), (F.col("low") < 20).alias("_c"))
    return pb.remark(h, {"_a": "sc", "_b": "tp", "_c": "sl"})


def weighted(spark, d) -> DataFrame:
    raw = F.when(F.col("product") == "click", 0.1).when(F.col("product") == "view", 0.2 + F.pmod(F.dayofmonth("date"), F.lit(3)) / 10).otherwise(0.15)
    return daily(spark, d).select("date", "product", "close", raw.alias("weight"))


WEIGHTED = f"{DAILY}, w AS (SELECT date, product, close, CASE product WHEN 'click' THEN 0.1 WHEN 'view' THEN 0.2 + day(date) % 3 / 10 ELSE 0.15 END::DOUBLE AS weight FROM bars)"


@query(f"WITH {WEIGHTED} SELECT date, round(sum(greatest(weight, 0)), 6) AS long_weight, sum(greatest(weight, 0)) > 1 + 1e-9 AS too_large FROM w GROUP BY 1")
def weight_check(spark, d):
    return rounded(pf.weight_check(weighted(spark, d)))


@query(
    f"WITH {WEIGHTED}, g AS (SELECT *, lag(weight) OVER x * (close / lag(close) OVER x - 1) AS r FROM w WINDOW x AS (PARTITION BY product ORDER BY date)), "
    "e AS (SELECT date, 1e6 * exp(sum(ln(1 + r)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM (SELECT date, coalesce(sum(r), 0) AS r FROM g GROUP BY 1)) "
    "SELECT date, product, round(weight, 3) AS weight, round(log10(lag(weight * equity / close) OVER (PARTITION BY product ORDER BY date)), 6) AS log_position, round(log10(equity), 6) AS log_equity FROM w JOIN e USING (date)"
)
def portfolio_compound(spark, d):
    e = pf.compound(weighted(spark, d))
    return rounded(e.select("date", "product", F.round("weight", 3).alias("weight"), F.when(F.col("position") > 0, F.log10("position")).alias("log_position"), F.log10("equity").alias("log_equity")))


FIXED = (
    f"WITH {WEIGHTED}, p AS (SELECT *, coalesce(lag(weight * 1e6 / close) OVER x, 0) AS position, lag(close) OVER x AS price FROM w WINDOW x AS (PARTITION BY product ORDER BY date)), "
    "q AS (SELECT *, (position - coalesce(lag(position) OVER (PARTITION BY product ORDER BY date), 0)) * price AS paid FROM p), "
    "c AS (SELECT date, 1e6 - sum(paid) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS cash, value FROM (SELECT date, coalesce(sum(paid), 0) AS paid, sum(position * close) AS value FROM q GROUP BY 1)) "
    "SELECT date, product, weight, round(position, 4) AS position, round(cash, 2) AS cash, round(cash + value, 2) AS equity FROM q JOIN c USING (date)"
)


def _cents(df: DataFrame) -> DataFrame:
    return df.select("date", "product", "weight", F.round("position", 4).alias("position"), F.round("cash", 2).alias("cash"), F.round("equity", 2).alias("equity"))


@query(FIXED)
def portfolio_fixed(spark, d):
    return _cents(pf.fixed(weighted(spark, d)))


@query(FIXED)
def portfolio_machine(spark, d):
    """The walk over dates on the weights of the closed form."""
    return _cents(pf.run_portfolio(weighted(spark, d).withColumn("scenario", F.lit(0)), compounding=False))


@query()
def portfolio_drift(spark, d):
    """Two scenarios with products that keep what they hold on some dates; the tests check its books."""
    w = weighted(spark, d).withColumn("scenario", F.explode(F.array(F.lit(1), F.lit(2))))
    return rounded(pf.run_portfolio(w.withColumn("weight", F.when(F.dayofmonth("date") % (F.col("scenario") + 1) == 0, F.col("weight")))), 4)


@query(f"WITH {HOURLY}, l AS (SELECT product, min(date) AS a, max(date) AS b FROM bars GROUP BY 1) SELECT l.product, x.date FROM (SELECT DISTINCT date FROM bars) x JOIN l ON x.date BETWEEN l.a AND l.b ANTI JOIN bars ON bars.date = x.date AND bars.product = l.product")
def panel_gaps(spark, d):
    h = hourly(spark, d)
    return pf.panel_gaps(h, h)


@query(f"WITH {FIXED[5:].split(', c AS')[0]} SELECT date, round(sum(position * close), 2) AS value FROM q GROUP BY 1")
def equity_mtm(spark, d):
    return pf.fixed(weighted(spark, d)).groupBy("date").agg(F.round(F.sum(F.coalesce(F.col("position") * F.col("close"), F.lit(0.0))), 2).alias("value"))


INDEX = "(SELECT date, dense_rank() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"


@query(f"WITH {HOURLY} SELECT product, date, t AS time_idx FROM bars JOIN {INDEX} USING (date)")
def time_index(spark, d):
    return splits.with_time_index(hourly(spark, d)).select("product", "date", F.col("time_idx").cast("bigint").alias("time_idx"))


@query(f"WITH {HOURLY} SELECT product, date, CASE WHEN t < floor(0.7 * n + 0.5) THEN 'train' WHEN t < floor(0.9 * n + 0.5) THEN 'val' ELSE 'test' END AS split FROM bars JOIN {INDEX} USING (date)")
def split_holdout(spark, d):
    a, v, _ = splits.ratios(721)
    return splits.holdout(hourly(spark, d), a, v).select("product", "date", "split")


@query(
    f"WITH {HOURLY}, i AS {INDEX}, f AS (SELECT fold, n - (5 - fold) * (n // 6) AS start, n // 6 AS size FROM range(5) r(fold), (SELECT any_value(n) AS n FROM i)) "
    "SELECT product, date, fold, CASE WHEN t >= start THEN 'test' ELSE 'train' END AS side FROM bars JOIN i USING (date) JOIN f ON t < start - 2 OR (t >= start AND t < start + size)"
)
def split_cv(spark, d):
    return splits.cross_validation(hourly(spark, d), 5, gap=2).select("product", "date", F.col("fold").cast("bigint").alias("fold"), "side")


@query(f"WITH {HOURLY} SELECT CASE WHEN t < floor(0.7 * n + 0.5) THEN 'train' WHEN t < floor(0.9 * n + 0.5) THEN 'val' ELSE 'test' END AS split, count(*) AS n_rows, min(date) AS first, max(date) AS last FROM bars JOIN {INDEX} USING (date) GROUP BY 1")
def split_invariants(spark, d):
    return splits.holdout(hourly(spark, d), 0.7, 0.2).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last"))


def _indicator(name: str, value: str, n: int = 5) -> str:
    return f"WITH {HOURLY} SELECT date, product, {value} FROM bars WINDOW x AS (PARTITION BY product ORDER BY date ROWS {n - 1} PRECEDING), y AS (PARTITION BY product ORDER BY date)"


@query(_indicator("sma", "round(CASE WHEN count(*) OVER x = 5 THEN avg(close) OVER x END, 6) AS sma"))
def ind_sma(spark, d):
    return rounded(hourly(spark, d).select("date", "product", indicators.sma(5).alias("sma")))


@query(_indicator("bbands", "round(CASE WHEN count(*) OVER x = 5 THEN avg(close) OVER x + 2 * stddev_pop(close) OVER x END, 6) AS upper, round(CASE WHEN count(*) OVER x = 5 THEN avg(close) OVER x END, 6) AS middle, round(CASE WHEN count(*) OVER x = 5 THEN avg(close) OVER x - 2 * stddev_pop(close) OVER x END, 6) AS lower"))
def ind_bbands(spark, d):
    up, mid, low = indicators.bbands(5)
    return rounded(hourly(spark, d).select("date", "product", up.alias("upper"), mid.alias("middle"), low.alias("lower")))


@query(_indicator("roc", "round(100 * (close / lag(close, 3) OVER y - 1), 6) AS roc, round(close - lag(close, 3) OVER y, 6) AS mom"))
def ind_roc(spark, d):
    return rounded(hourly(spark, d).select("date", "product", indicators.roc(3).alias("roc"), indicators.mom(3).alias("mom")))


@query(_indicator("minmax", "CASE WHEN count(*) OVER x = 5 THEN max(high) OVER x END AS highest, CASE WHEN count(*) OVER x = 5 THEN min(low) OVER x END AS lowest, greatest(high - low, abs(high - lag(close) OVER y), abs(low - lag(close) OVER y)) AS tr"))
def ind_minmax(spark, d):
    return hourly(spark, d).select("date", "product", indicators.highest(5).alias("highest"), indicators.lowest(5).alias("lowest"), indicators.true_range().alias("tr"))


NUMBERED = f"{HOURLY}, r AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY date) AS i FROM bars)"


@query(
    f"WITH RECURSIVE {NUMBERED}, e(product, i, ema) AS (SELECT product, 10::BIGINT, avg(close) FROM r WHERE i <= 10 GROUP BY 1 HAVING count(*) = 10 UNION ALL "
    "SELECT r.product, r.i, ema + (close - ema) * 2 / 11 FROM e JOIN r ON r.product = e.product AND r.i = e.i + 1) SELECT r.date, r.product, round(ema, 6) AS ema FROM r LEFT JOIN e USING (product, i)"
)
def ind_ema(spark, d):
    return rounded(indicators.ema(hourly(spark, d), 10).select("date", "product", "ema"))


@query(
    f"WITH RECURSIVE {NUMBERED}, g AS (SELECT *, close - lag(close) OVER (PARTITION BY product ORDER BY date) AS x FROM r), "
    "e(product, i, u, w) AS (SELECT product, 15::BIGINT, avg(greatest(x, 0)), avg(greatest(-x, 0)) FROM g WHERE i BETWEEN 2 AND 15 GROUP BY 1 HAVING count(*) = 14 UNION ALL "
    "SELECT g.product, g.i, u + (greatest(x, 0) - u) / 14, w + (greatest(-x, 0) - w) / 14 FROM e JOIN g ON g.product = e.product AND g.i = e.i + 1) "
    "SELECT r.date, r.product, round(CASE WHEN u + w = 0 THEN 0 ELSE 100 * u / (u + w) END, 6) AS rsi FROM r LEFT JOIN e USING (product, i)"
)
def ind_rsi(spark, d):
    return rounded(indicators.rsi(hourly(spark, d), 14).select("date", "product", "rsi"))


@query("SELECT l_orderkey AS order_id, round(sum(l_extendedprice) / sum(l_quantity) + 1e-7, 4) AS vwap FROM lineitem GROUP BY 1")
def vwap(spark, d):
    return m.fills(spark, d).groupBy("order_id").agg(F.round(finance.average_price(F.col("price"), F.col("quantity")) + 1e-7, 4).alias("vwap"))


@query("SELECT o_orderkey AS order_id, coalesce(q, 0) AS filled, 200 - coalesce(q, 0) AS remaining, coalesce(q, 0) >= 200 AS is_filled, coalesce(q, 0) > 0 AND coalesce(q, 0) < 200 AS is_partial FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def order_fills(spark, d):
    o = m.table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"))
    return finance.filled_state(o, m.fills(spark, d), F.lit(200)).select("order_id", "filled", "remaining", "is_filled", "is_partial")


LEGS = "(SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS net, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS long, sum(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) / sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) AS la, sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) / sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS sa FROM lineitem GROUP BY 1)"


@query(f"SELECT l_suppkey, net, round(CASE WHEN net > 0 THEN la WHEN net < 0 THEN sa END, 4) AS avg_price FROM {LEGS}")
def net_position(spark, d):
    sale, quantity, paid = F.col("l_returnflag") == "R", F.col("l_quantity"), F.col("l_extendedprice")
    price = lambda side: F.sum(F.when(side, paid)) / F.sum(F.when(side, quantity))
    legs = m.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(sale, -quantity).otherwise(quantity)).alias("net"), price(~sale).alias("la"), price(sale).alias("sa"))
    return legs.select("l_suppkey", "net", F.round(finance.net_price(F.col("net"), F.col("la"), F.col("sa")), 4).alias("avg_price"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN (a IS NULL) = (p IS NULL) THEN 'one of amount and percent' WHEN a <= 0 THEN 'amount' WHEN p <= 0 THEN 'percent' WHEN o <= 0 THEN 'limit_offset' END AS fault FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity - 10 END AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS p, CASE WHEN l_linenumber % 4 = 0 THEN l_tax END AS o FROM lineitem)")
def trailing_stop_faults(spark, d):
    n = F.col("l_linenumber")
    given = (F.when(n % 3 == 0, F.col("l_quantity") - 10), F.when(n % 2 == 0, F.col("l_discount")), F.when(n % 4 == 0, F.col("l_tax")))
    return m.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", finance.trailing_stop_fault(*given).alias("fault"))


@query(f"WITH {SIGNALS} SELECT date, product, signal, CASE WHEN close > 50 THEN close END AS order_price, 2.0::DOUBLE AS order_quantity, true AS first_only, true AS long_only, false AS short_only, 'open' AS entry_fill, 0.1::DOUBLE AS take_profit, 0.05::DOUBLE AS stop_loss, NULL::DOUBLE AS trailing_stop, 8.0::DOUBLE AS time_window, 'close' AS exit_fill FROM s")
def instructions(spark, d):
    opened = sg.open_position(signals(spark, d), F.when(F.col("close") > 50, F.col("close")), 2, first_only=True, long_only=True, fill_price="open")
    closed = sg.close_position(opened, take_profit=0.1, stop_loss=-0.05, time_window=8)
    return closed.drop("resolution", "open", "high", "low", "close", "volume")


@query("SELECT p_partkey, list_min(list_filter([1, 3, 5, 15, 30], lambda x: p_size % x = 0))::BIGINT AS period FROM part")
def min_divisor(spark, d):
    offered = F.array(*map(F.lit, (1, 3, 5, 15, 30)))
    return m.table(spark, d, "part").select("p_partkey", F.array_min(F.filter(offered, lambda x: F.col("p_size") % x == 0)).cast("bigint").alias("period"))


@query("SELECT p_partkey, CAST(floor(p_size::DOUBLE / 4) * 4 AS DOUBLE) AS lots FROM part")
def round_lot(spark, d):
    return m.table(spark, d, "part").select("p_partkey", finance.round_lot(F.col("p_size").cast("double"), F.lit(4.0)).cast("double").alias("lots"))


@query("SELECT p_partkey, floor(p_retailprice / 0.25 + 0.5) * 0.25::DOUBLE AS nearest, floor(p_retailprice / 0.25) * 0.25::DOUBLE AS passive_buy, ceil(p_retailprice / 0.25) * 0.25::DOUBLE AS aggressive_buy FROM part")
def round_tick(spark, d):
    price, tick, buy = F.col("p_retailprice"), F.lit(0.25), F.lit(1)
    return m.table(spark, d, "part").select("p_partkey", finance.round_tick(price, tick, "nearest").alias("nearest"), finance.round_tick(price, tick, "passive", buy).alias("passive_buy"), finance.round_tick(price, tick, "aggressive", buy).alias("aggressive_buy"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN 1::BIGINT WHEN 1 THEN -1 WHEN 2 THEN nullif(sign(l_quantity - 25), 0)::BIGINT END AS sign FROM lineitem")
def side_sign(spark, d):
    """Sides as names in any case, as signed numbers, and as neither."""
    n = F.col("l_linenumber") % 4
    side = F.when(n == 0, F.when(F.col("l_suppkey") % 2 == 0, "buy").otherwise("Long")).when(n == 1, F.when(F.col("l_suppkey") % 2 == 0, "SELL").otherwise("short")).when(n == 2, (F.col("l_quantity") - 25).cast("int").cast("string")).otherwise(F.col("l_returnflag"))
    return m.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", finance.side_sign(side).cast("bigint").alias("sign"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN p_size * 10 / p_retailprice ELSE p_size * 10 END, 6) AS base, round(CASE WHEN p_size % 2 = 0 THEN p_size * 10 ELSE p_size * 10 * p_retailprice END, 6) AS quote FROM part")
def qty_convert(spark, d):
    args = F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(10.0), F.col("p_size") % 2 == 0
    return rounded(m.table(spark, d, "part").select("p_partkey", finance.to_base(*args).alias("base"), finance.to_quote(*args).alias("quote")))


@query("SELECT p_partkey, round(CASE WHEN p_size % 5 = 0 THEN 0 ELSE (p_size % 5) * (p_retailprice - 1000) END, 6) AS upnl FROM part")
def upnl(spark, d):
    return rounded(m.table(spark, d, "part").select("p_partkey", finance.unrealised((F.col("p_size") % 5).cast("double"), F.col("p_retailprice"), F.lit(1000.0)).alias("upnl")))


@query("SELECT o_orderkey, 'BTC' || substr('FGHJKMNQUVXZ', month(o_orderdate)::INT, 1) || strftime(o_orderdate, '%y') AS future, 'SPX' || strftime(o_orderdate, '%y%m%d') || CASE WHEN o_custkey % 2 = 0 THEN 'C' ELSE 'P' END || lpad(CAST(o_custkey % 90000 * 500 AS VARCHAR), 8, '0') AS option FROM orders")
def symbology(spark, d):
    o = m.table(spark, d, "orders")
    kind = F.when(F.col("o_custkey") % 2 == 0, F.lit("call")).otherwise(F.lit("put"))
    return o.select("o_orderkey", finance.future_code(F.lit("BTC"), F.col("o_orderdate")).alias("future"), finance.option_code(F.lit("SPX"), F.col("o_orderdate"), kind, F.col("o_custkey") % 90000 / 2).alias("option"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'BTCUSDT' WHEN 1 THEN 'BTCPERP' WHEN 2 THEN 'BTCUSD' ELSE 'BTC-' || upper(strftime(o_orderdate, '%d%b%y')) END AS symbol FROM orders")
def venue_symbol(spark, d):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    kind, quote = pick("PERPETUAL", "PERPETUAL", "INVERSE-PERPETUAL", "FUTURE"), pick("USDT", "USDC", "USD", "USDT")
    return m.table(spark, d, "orders").select("o_orderkey", finance.venue_symbol(F.lit("BTC"), quote, kind, F.col("o_orderdate")).alias("symbol"))


KIND = "CASE p_partkey % 4 WHEN 0 THEN 'PERPETUAL' WHEN 1 THEN 'STOCK' WHEN 2 THEN 'INVERSE-PERPETUAL' ELSE 'BOND' END"


def written_kind():
    """A part's asset type as a user writes it."""
    return F.element_at(F.array(*map(F.lit, ("perp", "STK", "inverse-perpetual", "Bond"))), (F.col("p_partkey") % 4 + 1).cast("int"))


@query(f"SELECT p_partkey, CASE WHEN ok THEN 'P' || p_partkey END AS base, CASE WHEN ok THEN 'USD' END AS quote, CASE WHEN ok THEN {KIND} END AS asset_type FROM (SELECT *, p_size % 3 > 0 AS ok FROM part)")
def parse_basis(spark, d):
    """Parts as products of a base, a quote and a type; those of some sizes lack the quote."""
    base = F.concat(F.lit("p"), F.col("p_partkey"))
    text = F.when(F.col("p_size") % 3 > 0, F.concat_ws("_", base, F.lit("usd"), written_kind())).otherwise(F.concat_ws("_", base, written_kind()))
    return m.table(spark, d, "part").select("p_partkey", finance.parse_basis(text).alias("p")).select("p_partkey", "p.base", "p.quote", "p.asset_type")


@query(f"SELECT p_partkey, {KIND} AS full_name FROM part")
def asset_type_norm(spark, d):
    return m.table(spark, d, "part").select("p_partkey", finance.asset_type(written_kind()).alias("full_name"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN ['colour'] WHEN p_partkey % 3 = 1 AND p_size % 2 = 0 THEN ['strike_price'] ELSE [] END::VARCHAR AS unknown, "
    "CASE WHEN p_partkey % 3 = 0 AND p_size % 5 = 0 THEN ['option_type'] ELSE [] END::VARCHAR AS missing, "
    "CASE WHEN p_partkey % 3 = 2 OR (p_partkey % 3 = 1 AND p_size % 2 = 0) THEN 'unknown specs' WHEN p_partkey % 3 = 0 AND p_size % 5 = 0 THEN 'missing specs' END AS fault FROM part"
)
def product_specs(spark, d):
    """Parts as options, stocks and futures whose specifications are checked by a rule table."""
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    strike = F.col("p_retailprice").cast("string")
    option = F.create_map(F.lit("strike_price"), strike, F.lit("expiration"), F.lit("2026-03-27"), F.lit("option_type"), F.when(size % 5 > 0, "call").otherwise(" "))
    stock = F.when(size % 2 == 0, F.create_map(F.lit("strike_price"), strike))
    future = F.create_map(F.lit("expiration"), F.lit("2026-03-27"), F.lit("colour"), F.col("p_brand"))
    basis = F.concat(F.lit("P"), F.col("p_partkey"), F.lit("_USD_"), F.element_at(F.array(*map(F.lit, ("OPT", "STK", "FUT"))), (k + 1).cast("int")))
    parts = m.table(spark, d, "part").select("p_partkey", F.lit("bybit").alias("source"), basis.alias("basis"), F.when(k == 0, option).when(k == 1, stock).otherwise(future).alias("specs"))
    out = products.checked(parts, products.rules(spark))
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return out.select("p_partkey", text(F.col("unknown")).alias("unknown"), text(F.col("missing")).alias("missing"), "fault")


@query("SELECT 'P' || s_suppkey % 7 || '_USD_OPTION_2026-03-' || lpad((s_suppkey % 5 + 10)::VARCHAR, 2, '0') || '_' || s_suppkey % 3 || '_CALL' AS symbol, count(*) AS n, count(DISTINCT s_nationkey % 2) AS n_sources FROM supplier GROUP BY 1")
def product_identity(spark, d):
    """Options that several suppliers list: the same if source, symbol and asset type are."""
    s = F.col("s_suppkey")
    day = F.concat(F.lit("2026-03-"), F.lpad((s % 5 + 10).cast("string"), 2, "0"))
    specs = F.create_map(F.lit("strike_price"), (s % 3).cast("string"), F.lit("option_type"), F.lit("call"), F.lit("expiration"), day)
    listed = m.table(spark, d, "supplier").select(F.concat(F.lit("P"), s % 7, F.lit("_usd_"), F.when(s % 2 == 0, "opt").otherwise("OPTION")).alias("basis"), F.when(F.col("s_nationkey") % 2 == 0, "one").otherwise("TWO").alias("source"), specs.alias("specs"))
    same = products.identical(products.checked(listed, products.rules(spark)).where("fault IS NULL"))
    of_key = same.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return of_key.groupBy(F.col("key.symbol").alias("symbol")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sources"))


@query("SELECT c_custkey, CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE rtrim(x::VARCHAR, '0') END AS text FROM (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18, 4)) AS x FROM customer)")
def trim_zeros(spark, d):
    """Balances as decimal texts of four places, without needless zeros."""
    return m.table(spark, d, "customer").select("c_custkey", finance.trim_zeros(F.col("c_acctbal").cast("decimal(18,4)").cast("string")).alias("text"))


@query(f"WITH {HOURLY} SELECT {BAR} FROM bars")
def csv_round_trip(spark, d):
    """Bars through CSV files with a schema and no inference."""
    path = shared_path(spark, "csv")
    h = hourly(spark, d)
    files.store(h.withColumn("date", F.col("date").cast("timestamp")), path, "csv")
    return files.load(spark, path, "csv")[0].withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(_indicator("registry", "round(CASE WHEN count(*) OVER x = 5 THEN avg(close) OVER x + 2 * stddev_pop(close) OVER x END, 6) AS b_upperband, round(CASE WHEN count(*) OVER x = 5 THEN avg(close) OVER x END, 6) AS b_middleband, round(CASE WHEN count(*) OVER x = 5 THEN avg(close) OVER x - 2 * stddev_pop(close) OVER x END, 6) AS b_lowerband, round(CASE WHEN count(*) OVER x = 5 THEN avg(open) OVER x END, 6) AS sma"))
def ind_registry(spark, d):
    """Indicators by name, with defaults and given parameters."""
    bars = indicators.with_indicator(hourly(spark, d), "BBANDS", "b_")
    return rounded(indicators.with_indicator(bars, "sma", n=5, field="open").select("date", "product", "b_upperband", "b_middleband", "b_lowerband", "sma"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'U' WHEN '2-HIGH' THEN 'H' ELSE o_orderpriority END AS code FROM orders")
def code_map(spark, d):
    return m.table(spark, d, "orders").select("o_orderkey", finance.code(F.col("o_orderpriority"), {"U": "1-URGENT", "H": "2-HIGH"}).alias("code"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'FILLED' WHEN o_custkey % 3 = 0 THEN 'PENDING_CANCEL' WHEN o_custkey % 2 = 0 THEN 'PARTIAL' ELSE 'NEW' END AS status FROM orders")
def fix_status(spark, d):
    c = F.col("o_custkey")
    candidates = F.array(F.lit("NEW"), F.when(c % 2 == 0, F.lit("PARTIAL")), F.when(c % 3 == 0, F.lit("PENDING_CANCEL")), F.when(c % 5 == 0, F.lit("FILLED")))
    return m.table(spark, d, "orders").select("o_orderkey", finance.fix_status(F.array_compact(candidates)).alias("status"))


@query("SELECT event_id, make_timestamp(1700000000000000 + event_id * 1000) AS expiry FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1")
def parse_expiry(spark, d):
    ms = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") + 1700000000000).cast("string")).otherwise(F.lit("none"))
    return m.table(spark, d, "events").select("event_id", finance.parse_expiry(ms).cast("timestamp_ntz").alias("expiry"))


@query("SELECT o_orderkey, CASE WHEN (o_custkey % 2 = 0) = (o_orderkey % 3 = 0) THEN 'stop_loss' ELSE 'take_profit' END AS kind FROM orders")
def stop_kind(spark, d):
    side = F.when(F.col("o_custkey") % 2 == 0, -1).otherwise(1)
    return m.table(spark, d, "orders").select("o_orderkey", finance.stop_kind(side, F.when(F.col("o_orderkey") % 3 == 0, "DOWN").otherwise("UP")).alias("kind"))


ORDERS = "(SELECT *, o_orderkey % 4 AS k, CASE WHEN o_custkey % 7 > 0 THEN o_totalprice END AS trigger, CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'sideways' ELSE 'up' END AS direction FROM orders)"


@query(
    f"SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'side' WHEN o_custkey % 13 = 0 THEN 'quantity' WHEN k = 3 AND o_orderstatus = 'P' THEN 'price' WHEN k IN (2, 3) AND trigger IS NULL THEN 'trigger_price' "
    f"WHEN k IN (2, 3) AND (direction IS NULL OR direction = 'sideways') THEN 'trigger_direction' END AS fault FROM {ORDERS}"
)
def order_violations(spark, d):
    """What is wrong with orders of all types."""
    c, k = F.col("o_custkey"), (F.col("o_orderkey") % 4 + 1).cast("int")
    kind = F.element_at(F.array(*map(F.lit, ("market", "Limit", "stop_market", "STOP_LIMIT"))), k)
    direction = F.when(c % 5 == 0, None).when(c % 5 == 1, "sideways").otherwise("up")
    price = F.when((k == 4) & (F.col("o_orderstatus") == "P"), F.lit(None)).otherwise(F.col("o_totalprice"))
    fault = finance.order_fault(F.when(c % 11 == 0, "hold").otherwise("Buy"), kind, price, F.when(c % 13 == 0, 0).otherwise(1), F.when(c % 7 > 0, F.col("o_totalprice")), direction, F.lit(False))
    return m.table(spark, d, "orders").select("o_orderkey", fault.alias("fault"))


@query(
    "SELECT p_partkey, CASE WHEN f IS NULL AND p IS NOT NULL THEN floor(p / 0.25) * 0.25 ELSE p_retailprice END AS price, CASE WHEN f IS NULL AND q IS NOT NULL THEN floor(q / 4) * 4 ELSE 40 END::DOUBLE AS quantity, f AS fault FROM ("
    "SELECT *, CASE WHEN p IS NULL AND q IS NULL THEN 'nothing to amend' WHEN floor(q / 4) <= 0 THEN 'quantity' END AS f FROM (SELECT *, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice * 1.01 END AS p, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS q FROM part))"
)
def order_amendments(spark, d):
    """New prices to the passive tick and new quantities to the lot."""
    price, quantity = F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice") * 1.01), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("double"))
    out = finance.amended(F.col("p_retailprice"), F.lit(40.0), price, quantity, F.lit(0.25), F.lit(4.0), F.lit(1))
    return m.table(spark, d, "part").select("p_partkey", out.alias("o")).select("p_partkey", "o.price", F.col("o.quantity").cast("double").alias("quantity"), "o.fault")


@query("SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18, 4)) - CAST(abs(c_nationkey) AS DECIMAL(18, 4)) * 2 AS DOUBLE) AS available FROM customer")
def available_balance(spark, d):
    c = m.table(spark, d, "customer")
    return c.select("c_custkey", finance.available(F.col("c_acctbal"), F.col("c_nationkey") * 2).cast("double").alias("available"))


@query("SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k, CAST(props ->> '$.k' AS BIGINT) % 2 = 0 AS even, 'event' AS kind FROM events")
def json_parse_flat(spark, d):
    rules = {"k": ["k", lambda c: c.cast("bigint")], "even": ["k", lambda c: c.cast("bigint") % 2 == 0], "kind": jsonrules.Const("event"), "none": ["missing", "deep", F.upper]}
    return jsonrules.parsed(m.table(spark, d, "events"), "props", rules, ["event_id"]).drop("none")


@query("SELECT o_orderkey, coalesce(l, 0) AS n_fills, s AS total FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS l, sum(l_quantity)::BIGINT AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def json_parse_nested(spark, d):
    f = m.fills(spark, d).groupBy("order_id").agg(F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.col("quantity").cast("int").alias("q"))).alias("fills")).alias("data"))).alias("message"))
    rules = {"fills": jsonrules.Each(("data", "fills"), {"q": ["q", lambda c: c.cast("bigint")]}, many=True)}
    o = jsonrules.parsed(m.table(spark, d, "orders").join(f, F.col("o_orderkey") == F.col("order_id"), "left"), "message", rules, ["o_orderkey"])
    return o.select("o_orderkey", F.coalesce(F.size("fills"), F.lit(0)).cast("bigint").alias("n_fills"), F.aggregate("fills", F.lit(0).cast("bigint"), lambda s, x: s + x["q"]).alias("total"))


@query(f"WITH {HOURLY} SELECT product, epoch_ms(date)::DOUBLE AS start_ts, epoch_ms(date)::DOUBLE + 3599999 AS end_ts, open, high, low, close, volume, volume < 2 AS is_incremental, round(volume * close, 6) AS turnover, 'kline.60.' || product AS channel FROM bars")
def json_kline(spark, d):
    """Bars as a venue's messages, numbers as texts, and back."""
    text = lambda c: F.col(c).cast("string").alias(c)
    start = F.unix_millis(F.col("date").cast("timestamp"))
    bar = F.struct(start.alias("start"), (start + 3599999).alias("end"), (start + 3600500).alias("timestamp"), *map(text, ("open", "high", "low", "close", "volume")), (F.col("volume") >= 2).alias("confirm"), F.round(F.col("volume") * F.col("close"), 6).cast("string").alias("turnover"))
    sent = hourly(spark, d).select("product", F.to_json(F.struct(F.concat(F.lit("kline.60."), "product").alias("topic"), (start + 3600501).alias("ts"), F.array(bar).alias("data"))).alias("value"))
    got = jsonrules.parsed(sent, "value", messages.KLINE, ["product"]).select("product", "channel", F.explode("data").alias("b"))
    return got.select("product", "channel", *(F.col(f"b.{c}").alias(c) for c in ("start_ts", "end_ts", "open", "high", "low", "close", "volume", "is_incremental")), F.col("b.extra.turnover").alias("turnover"))


@query("SELECT event_id::VARCHAR AS trade_id, (epoch_us(ts) // 1000)::DOUBLE AS ts, value AS price, abs(50 - value) AS volume, CASE WHEN event_id % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS taker_side, event_type AS channel FROM events")
def json_trades(spark, d):
    """A user's events of a kind as one message of many trades, and back; volumes lose their sign."""
    trade = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("T"), F.col("value").cast("string").alias("p"), (50 - F.col("value")).cast("string").alias("v"), F.col("event_id").cast("string").alias("i"), F.when(F.col("event_id") % 2 == 0, "Buy").otherwise("Sell").alias("S"))
    sent = m.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.collect_list(trade).alias("data"))
    sent = sent.select(F.to_json(F.struct(F.col("event_type").alias("topic"), F.lit(1).alias("ts"), "data")).alias("value"))
    got = jsonrules.parsed(sent, "value", messages.TRADES).select("channel", F.explode("data").alias("t"))
    return got.select("channel", F.col("t.extra.trade_id").alias("trade_id"), F.col("t.ts").alias("ts"), F.col("t.price").alias("price"), F.col("t.volume").alias("volume"), F.col("t.extra.taker_side").alias("taker_side"))


COINS = "coins AS (SELECT c_nationkey AS account, c_mktsegment AS currency, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DECIMAL(18, 2)) AS cash, CAST(count(*) * 2 AS DECIMAL(18, 2)) AS locked FROM customer GROUP BY 1, 2)"


def balance_messages(spark, d) -> DataFrame:
    """Each nation's customers as one account's balance message, a currency for a market segment; texts of decimals."""
    coins = m.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("account"), "c_mktsegment").agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).alias("cash"), (F.count(F.lit(1)) * 2).alias("locked"))
    coin = F.struct(F.col("c_mktsegment").alias("coin"), F.col("cash").cast("string").alias("walletBalance"), (F.col("cash") + 1).cast("string").alias("equity"), F.col("locked").cast("string").alias("locked"))
    per = coins.groupBy("account").agg(F.collect_list(coin).alias("coin"), F.sum("cash").cast("string").alias("totalWalletBalance"))
    whole = F.array(F.struct("totalWalletBalance", "coin"))
    return per.select("account", F.to_json(F.struct(F.lit("wallet").alias("topic"), F.lit(1700000000500).alias("creationTime"), whole.alias("data"))).alias("value"))


@query(f"WITH {COINS} SELECT account, round(sum(cash), 2)::DOUBLE AS cash, count(*) AS n_currencies, round(sum(cash - locked), 2)::DOUBLE AS available, 1700000000.5::DOUBLE AS ts FROM coins GROUP BY 1")
def json_balance(spark, d):
    """Accounts' cash and what all their currencies have available."""
    got = messages.balances(balance_messages(spark, d).withColumnRenamed("account", "id"), "value", ["id"])
    free = F.aggregate("balances", F.lit(0).cast("decimal(38,18)"), lambda s, b: (s + b["available"]).cast("decimal(38,18)"))
    return got.select(F.col("id").alias("account"), F.round(F.col("account.cash").cast("double"), 2).alias("cash"), F.size("balances").cast("bigint").alias("n_currencies"), F.round(free.cast("double"), 2).alias("available"), "ts")


@query(f"WITH {COINS} SELECT account AS c_nationkey, currency, cash::DOUBLE AS total, (cash + 1)::DOUBLE AS equity, (cash - locked)::DOUBLE AS available FROM coins")
def explode_balances(spark, d):
    """A row for each account and currency of balance messages."""
    sent = balance_messages(spark, d).withColumnRenamed("account", "c_nationkey")
    got = messages.balance_updates(sent, "value", ["c_nationkey"])
    return got.select("c_nationkey", "currency", *(F.col(c).cast("double").alias(to) for c, to in (("cash", "total"), ("equity", "equity"), ("available", "available"))))


@query(
    "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'no json' WHEN 1 THEN 'failed' WHEN 2 THEN 'failed' WHEN 3 THEN 'wrong type' WHEN 4 THEN 'no ts' END AS fault, "
    "CASE event_id % 7 WHEN 1 THEN 'code ' || user_id WHEN 2 THEN 'unknown' WHEN 3 THEN 'expected a list, got OBJECT<x: BIGINT>' END AS error, CASE WHEN event_id % 7 > 4 THEN '[' || user_id || ']' END AS data FROM events"
)
def response_envelopes(spark, d):
    """Responses stored by their outcome in one pass, and read back."""
    e = F.col("event_id") % 7
    user = F.col("user_id").cast("string")
    body = lambda data, ts="1.5": F.concat(F.lit('{"success": true, "response": {"ts": ' + ts + ', "data": '), data, F.lit("}}"))
    value = (
        F.when(e == 0, F.lit("{broken"))
        .when(e == 1, F.concat(F.lit('{"success": false, "error": "code '), user, F.lit('"}')))
        .when(e == 2, F.lit('{"response": {}}'))
        .when(e == 3, body(F.lit('{"x": 1}')))
        .when(e == 4, body(F.lit("[]"), "null"))
        .otherwise(body(F.concat(F.lit("["), user, F.lit("]"))))
    )
    path = shared_path(spark, "responses")
    messages.store_checked(messages.checked(m.table(spark, d, "events").select("event_id", value.alias("value")), "value"), path)
    return spark.read.parquet(path).select("event_id", "fault", "error", "data")


LEVELS = "(SELECT s_nationkey AS book, CASE WHEN s_suppkey % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, s_acctbal AS price, s_suppkey AS size FROM supplier)"


@query(f"SELECT *, row_number() OVER (PARTITION BY book, side ORDER BY CASE side WHEN 'bid' THEN -price ELSE price END) AS level FROM {LEVELS} QUALIFY level <= 2")
def book_topk(spark, d):
    s = m.table(spark, d, "supplier").select(F.col("s_nationkey").alias("book"), F.when(F.col("s_suppkey") % 2 == 0, "bid").otherwise("ask").alias("side"), F.col("s_acctbal").alias("price"), F.col("s_suppkey").alias("size"))
    return books.top_levels(s, 2).withColumn("level", F.col("level").cast("bigint"))


@query("WITH e AS (SELECT user_id AS book, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, floor(value / 20) AS price, event_id % 4 AS size, event_id % 50 = 0 AS snap FROM events) SELECT book, side, price, arg_max(size, seq) AS size FROM e WHERE seq >= coalesce((SELECT max(seq) FROM e x WHERE x.book = e.book AND snap), 0) GROUP BY 1, 2, 3 HAVING arg_max(size, seq) > 0")
def book_state(spark, d):
    e = m.table(spark, d, "events").select(F.col("user_id").alias("book"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "bid").otherwise("ask").alias("side"), F.floor(F.col("value") / 20).cast("double").alias("price"), (F.col("event_id") % 4).alias("size"), (F.col("event_id") % 50 == 0).alias("is_snapshot"))
    return books.book_state(e)


@query("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], list_transform(range(len(embedding)), lambda i: 1.0 / (i + 1))), 6) AS prediction FROM embeddings")
def predict_vector(spark, d):
    """A model that weighs a vector's entries, one number a row."""
    found = components.predict(m.table(spark, d, "embeddings").select("vec_id", "embedding"), ["embedding"], lambda x: x @ (1.0 / np.arange(1, x.shape[1] + 1)), "prediction")
    return rounded(found.drop("embedding"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda v: v)), 6) AS total, round(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v)), 6) AS squares, round(list_max(embedding)::DOUBLE, 6) AS most, round(list_min(embedding)::DOUBLE, 6) AS least FROM embeddings")
def predict_nested(spark, d):
    """A model that gives a matrix for each row: its last dimension is columns, the other one arrays within them."""
    found = components.predict(m.table(spark, d, "embeddings").select("vec_id", "embedding"), ["embedding"], lambda x: np.stack([np.stack([x.sum(1), x.max(1)], 1), np.stack([(x * x).sum(1), x.min(1)], 1)], 2), "p", (2, 2))
    sums, ends = F.col("`p-0`"), F.col("`p-1`")
    return rounded(found.select("vec_id", sums[0].alias("total"), ends[0].alias("squares"), sums[1].alias("most"), ends[1].alias("least")))


class _Cheap:
    """Buys below the mean of the last bars, two orders if far below, and sells above it."""

    def __call__(self, x):
        mean = x["close"].mean()
        last = x["close"].iloc[-1]
        if len(x) < 5 or 0.8 * mean <= last <= 1.2 * mean:
            return []
        return [components.Order(1 if last < mean else -1, 1.0, last)] * (2 if last < 0.5 * mean else 1)


@query(
    f"WITH {HOURLY}, x AS (SELECT date, product, close, avg(close) OVER w AS mean, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY product ORDER BY date ROWS 4 PRECEDING)) "
    "SELECT date, product, CASE WHEN n = 5 AND close < 0.8 * mean THEN 1::BIGINT WHEN n = 5 AND close > 1.2 * mean THEN -1 END AS play, CASE WHEN n < 5 OR close BETWEEN 0.8 * mean AND 1.2 * mean THEN 0::BIGINT WHEN close < 0.5 * mean THEN 2 ELSE 1 END AS n_orders FROM x"
)
def strategy_trades(spark, d):
    """Signals of a strategy that looks back five bars, through a table function."""
    out = components.trades(hourly(spark, d), _Cheap(), "play", 5, ["close"])
    return out.select("date", "product", F.col("play").cast("bigint").alias("play"), F.size("play_orders").cast("bigint").alias("n_orders"))


class _Blocks:
    """Each of four equal blocks of dates is tested once, and all others are trained on."""

    def get_n_splits(self, X=None, y=None, groups=None):
        return 4

    def split(self, X, y=None, groups=None):
        n = len(X)
        for k in range(4):
            test = np.arange(k * n // 4, (k + 1) * n // 4)
            yield np.setdiff1d(np.arange(n), test), test


BLOCKS = (
    f"WITH {HOURLY}, i AS {INDEX}, f AS (SELECT fold, fold * n // 4 AS a, (fold + 1) * n // 4 AS b FROM range(4) r(fold), (SELECT any_value(n) AS n FROM i)), "
    "s AS (SELECT product, date, fold, CASE WHEN t >= a AND t < b THEN 'test' ELSE 'train' END AS side FROM bars JOIN i USING (date) JOIN f ON (t >= a AND t < b) OR t < a - 2 OR t >= b + 5) "
)


@query(BLOCKS + "SELECT product, date, fold, side FROM s")
def split_custom(spark, d):
    """A splitter of the user's own, with purge and embargo."""
    return folds.with_folds(hourly(spark, d), _Blocks(), purge=2, embargo=5).select("product", "date", "fold", "side")


@query(BLOCKS + "SELECT product, fold, side, round(sum(close), 4) AS weight, count(*) AS n FROM s JOIN bars USING (product, date) GROUP BY ALL")
def split_companion(spark, d):
    """Weights of the bars, kept apart from them, in the same folds."""
    h = hourly(spark, d)
    placed = folds.with_folds(h, _Blocks(), purge=2, embargo=5)
    weights = folds.split_companion(placed, h.select("date", "product", "resolution", F.col("close").alias("weight")))
    return weights.groupBy("product", "fold", "side").agg(F.round(F.sum("weight"), 4).alias("weight"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {HOURLY}, r AS (SELECT {BAR}, 1 AS o FROM bars WHERE day(date) <= 15 UNION ALL SELECT date, product, resolution, open, high, low, close + 1, volume, 2 FROM bars) SELECT {BAR} FROM r QUALIFY row_number() OVER (PARTITION BY date, product ORDER BY o) = 1")
def rehydrate(spark, d):
    h = hourly(spark, d)
    return streams.batch_first(h.where("day(date) <= 15"), h.withColumn("close", F.col("close") + 1), ["date", "product", "resolution"])


@query(f"WITH {HOURLY}, a AS (SELECT date, product, close AS one FROM bars WHERE close > 40), b AS (SELECT date, product, open AS two FROM bars WHERE open < 60) SELECT coalesce(a.date, b.date) AS date, coalesce(a.product, b.product) AS product, one, two FROM a FULL JOIN b ON a.date = b.date AND a.product = b.product")
def upsert_signals(spark, d):
    h = hourly(spark, d)
    one, two = h.where("close > 40").select("date", "product", F.col("close").alias("one")), h.where("open < 60").select("date", "product", F.col("open").alias("two"))
    return streams.upsert(two, one, ["date", "product"])


@query(f"WITH {HOURLY} SELECT date, count(*) AS n_products FROM bars GROUP BY 1 HAVING count(*) = 5")
def wide_ready(spark, d):
    return streams.ready_dates(hourly(spark, d), 5)


@query(f"WITH {HOURLY} SELECT p.date, p.product, p.close, c.close AS child FROM bars p LEFT JOIN bars c ON c.product = p.product AND c.date = p.date AND c.volume > 1")
def signal_join(spark, d):
    h = hourly(spark, d).select("date", "product", "close", "volume")
    return dispatch.missed(h.where("volume > 1").select("date", "product", F.col("close").alias("child")), h.drop("volume"), ["child"]).drop("n_missing")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_snapshot(spark, d):
    return streams.latest(m.table(spark, d, "events"), "user_id", "event_id", ["event_type"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedupe(spark, d):
    return m.table(spark, d, "events").select("user_id", "event_type").dropDuplicates()
