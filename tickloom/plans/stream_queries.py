"""Queries that run streams over replayed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.plans.bar_queries import hourly
from tickloom.plans.registry import BAR, HOURLY, TICKS, bars_sql, query
from tickloom.plans.trade_queries import rounded, signals
from tickloom.session import shared_path
from tickloom.sources import market as m
from tickloom.sources import store
from tickloom.streaming import idle_bars, order_books, partial_bars, signal_joins, streams

CLOSED = "(SELECT max(ts) - INTERVAL 6 MINUTES FROM ticks)"


def live_ticks(spark, d):
    t = m.ticks(spark, d)
    return streams.replay(spark, t.withColumn("ts", F.col("ts").cast("timestamp")), "ts")


def ntz(df):
    return df.withColumn("date", F.col("date").cast("timestamp_ntz"))


@query(f"WITH {HOURLY} SELECT {BAR} FROM bars WHERE date + INTERVAL 1 HOUR <= {CLOSED}")
def stream_bars(spark, d):
    return ntz(streams.collected(streams.stream_ohlcv(live_ticks(spark, d), "1h").drop("end", "w")))


SIX = "to_timestamp(floor(epoch(date) / 21600) * 21600)::TIMESTAMP"


@query(
    f"WITH {HOURLY} SELECT {SIX} AS date, product, '6_HOUR' AS resolution, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM bars "
    f"GROUP BY 1, 2 HAVING {SIX} + INTERVAL 6 HOUR <= {CLOSED}"
)
def stream_resample(spark, d):
    fine = streams.stream_ohlcv(live_ticks(spark, d), "1h")
    return ntz(streams.collected(streams.stream_resample(fine, "6h")))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    e = m.table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return streams.collected(streams.deduplicated(streams.replay(spark, e, "ts"), ["user_id", "event_type"], "ts", "100 days")).drop("ts")


@query()
def stream_backtest(spark, d):
    """The event-driven backtest; a test holds it against the batch backtest."""
    s = signals(spark, d).withColumns({"date": F.col("date").cast("timestamp"), "order_price": F.col("close"), "order_quantity": F.lit(1.0), "stop_loss": F.lit(0.3), "take_profit": F.lit(0.5)})
    return rounded(ntz(streams.collected(streams.stream_machine(streams.replay(spark, s, "date")))))


@query(f"WITH {TICKS}, {bars_sql('day', '1_DAY')} SELECT product, count(*) AS n_bars, round(sum(close), 4) AS total FROM bars GROUP BY 1")
def stored_bars(spark, d):
    """Bars through a stored table: fetched once, then read."""
    from tickloom.operators.bars import ohlcv

    path = shared_path(spark, "bars")
    fetched = m.retrieve_or_fetch(spark, path, lambda s: ohlcv(m.ticks(s, d), "1d"))
    return fetched.groupBy("product").agg(F.count(F.lit(1)).alias("n_bars"), F.round(F.sum("close"), 4).alias("total"))


@query(
    f"WITH {TICKS}, {bars_sql('day', '1_DAY', 'b')}, r AS (SELECT * FROM b WHERE product IN ('click', 'view', 'error') AND date BETWEEN DATE '2024-01-03' AND DATE '2024-01-20') "
    "SELECT origin, r.date, product, resolution, open, high, low, close, volume FROM r, (VALUES ('stored'), ('cache')) AS t(origin)"
)
def cached_bars(spark, d):
    """Daily bars made of stored hourly ones: asked for twice in other words, resampled once and read from the cache then."""
    import datetime as dt

    origin, cache = shared_path(spark, "bars"), shared_path(spark, "cache")
    store.write_days(hourly(spark, d), origin)
    asked = store.Request(origin, "1h", "1d", ("view", "click", "error"), dt.date(2024, 1, 3), dt.date(2024, 1, 20))
    again = store.Request(origin + "/", "1_HOUR", "1_DAY", ("click", "error", "view"), dt.datetime(2024, 1, 3, 7), dt.date(2024, 1, 20))
    got = [store.cached(spark, r, cache) for r in (asked, again)]
    one, two = (df.withColumn("origin", F.lit(where)) for df, where in got)
    return one.unionByName(two)


@query(f"WITH {HOURLY} SELECT product, count(*) AS n_bars FROM bars GROUP BY 1")
def artifact_round_trip(spark, d):
    """Results stored by product and read back."""
    from tickloom.sources import artifacts

    path = shared_path(spark, "trading")
    artifacts.save_frame(hourly(spark, d), path, {"signals": ["signal"]})
    df, _ = artifacts.load_frame(spark, path)
    return df.groupBy("product").agg(F.count(F.lit(1)).alias("n_bars"))


MESSAGES = "e AS (SELECT 'u' || user_id AS book, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, floor(value / 20) AS price, (event_id % 4)::DOUBLE AS size, event_id % 50 = 0 AS snap FROM events)"


def book_messages(spark, d):
    """Events as messages of one level each: a book for a user, a snapshot now and then."""
    e = m.table(spark, d, "events")
    level = F.array(F.struct(F.floor(F.col("value") / 20).cast("double").alias("price"), (F.col("event_id") % 4).cast("double").alias("size")))
    bid = F.col("event_id") % 2 == 0
    kind = F.when(F.col("event_id") % 50 == 0, "snapshot").otherwise("delta")
    return e.select(F.concat(F.lit("u"), F.col("user_id")).alias("book"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(bid, level).alias("bids"), F.when(~bid, level).alias("asks"))


@query(
    f"WITH {MESSAGES}, f AS (SELECT *, coalesce(max(CASE WHEN snap THEN seq END) OVER (PARTITION BY book ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS since FROM e), "
    "l AS (SELECT f.book, f.seq, x.side, x.price, arg_max(x.size, x.seq) AS size FROM f JOIN e x ON x.book = f.book AND x.seq BETWEEN f.since AND f.seq GROUP BY ALL HAVING arg_max(x.size, x.seq) > 0) "
    "SELECT f.book, f.seq, max(l.price) FILTER (l.side = 'bid') AS bid, arg_max(l.size, l.price) FILTER (l.side = 'bid') AS bid_size, min(l.price) FILTER (l.side = 'ask') AS ask, arg_min(l.size, l.price) FILTER (l.side = 'ask') AS ask_size, "
    "count(*) FILTER (l.side = 'bid') AS n_bids, count(*) FILTER (l.side = 'ask') AS n_asks FROM f LEFT JOIN l ON l.book = f.book AND l.seq = f.seq GROUP BY ALL"
)
def stream_book(spark, d):
    """Every user's book after each of its messages, from a stream."""
    books = streams.collected(order_books.book_stream(streams.replay(spark, book_messages(spark, d), "ts")))
    bid, ask = order_books.best(F.col("bids")), order_books.best(F.col("asks"))
    return books.select("book", "seq", bid["price"].alias("bid"), bid["size"].alias("bid_size"), ask["price"].alias("ask"), ask["size"].alias("ask_size"), F.size("bids").cast("bigint").alias("n_bids"), F.size("asks").cast("bigint").alias("n_asks"))


CHILDREN = (
    f"WITH {HOURLY}, b AS (SELECT product, date + INTERVAL 1 HOUR AS bar_end, hour(date) AS h, close, round(close - open, 6) AS trend, round(high - low, 6) AS width FROM bars), "
    "s AS (SELECT product, 'trend' AS component, CASE WHEN h % 7 = 6 THEN bar_end - INTERVAL 1 HOUR ELSE bar_end END AS bar_end, bar_end + to_seconds(h % 4 * 2) AS sent, trend AS value FROM b UNION ALL SELECT product, 'width', bar_end, bar_end + INTERVAL 1 SECOND, width FROM b WHERE h % 5 > 0), "
    "j AS (SELECT coalesce(x.product, s.product) AS product, coalesce(x.component, s.component) AS component, coalesce(x.bar_end, s.bar_end) AS bar_end, x.close, s.value, CASE WHEN x.bar_end IS NULL THEN 'stale' WHEN s.sent IS NULL THEN 'alone' ELSE 'joined' END AS status, s.sent "
    "FROM (SELECT * FROM b, (VALUES ('trend'), ('width')) AS c(component)) x FULL JOIN s ON s.product = x.product AND s.component = x.component AND s.bar_end = x.bar_end AND s.sent BETWEEN x.bar_end AND x.bar_end + INTERVAL 5 SECOND), "
    "k AS (SELECT * FROM j WHERE coalesce(sent, bar_end) < (SELECT max(bar_end) FROM b)) "
)


def child_signals(spark, d):
    """What two children send: one at times too late or with the stamp of the bar before, the other not for every bar."""
    bars = hourly(spark, d).select("product", (F.col("date") + F.expr("INTERVAL 1 HOUR")).cast("timestamp").alias("bar_end"), F.hour("date").alias("h"), "close", F.round(F.col("close") - F.col("open"), 6).alias("trend"), F.round(F.col("high") - F.col("low"), 6).alias("width"))
    stamp = F.when(F.col("h") % 7 == 6, F.col("bar_end") - F.expr("INTERVAL 1 HOUR")).otherwise(F.col("bar_end"))
    slow = F.col("bar_end") + F.make_dt_interval(secs=F.col("h") % 4 * 2)
    trend = bars.select("product", F.lit("trend").alias("component"), stamp.alias("bar_end"), slow.alias("sent"), F.col("trend").alias("value"))
    width = bars.where("h % 5 > 0").select("product", F.lit("width").alias("component"), "bar_end", (F.col("bar_end") + F.expr("INTERVAL 1 SECOND")).alias("sent"), F.col("width").alias("value"))
    return bars.select("product", "bar_end", "close"), trend.union(width)


def joined_signals(spark, d):
    """Rows that are settled before the last bars end; what comes after may still wait."""
    bars, sent = child_signals(spark, d)
    live = signal_joins.signals_in_time(streams.replay(spark, bars, "bar_end"), streams.replay(spark, sent, "sent"), ["trend", "width"])
    last = bars.agg(F.max("bar_end").alias("last"))
    return streams.collected(live).crossJoin(F.broadcast(last)).where(F.coalesce("sent", "bar_end") < F.col("last")).drop("last")


@query(CHILDREN + "SELECT product, component, bar_end, close, value, status FROM k")
def stream_signal_join(spark, d):
    """Bars with their children's signals of the same bar, bars that go on without, and stale signals."""
    return joined_signals(spark, d).select("product", "component", F.col("bar_end").cast("timestamp_ntz").alias("bar_end"), "close", "value", "status")


@query(CHILDREN + "SELECT product, component, count(*) AS n_dropped FROM k WHERE status = 'stale' GROUP BY ALL")
def stream_signals_dropped(spark, d):
    return signal_joins.dropped(joined_signals(spark, d))


#: Seconds of data in a second, and how long a drained stream of hourly bars may still have a timer.
SPEED, IDLE = 2_000.0, 4.0


@query(f"WITH {HOURLY} SELECT {BAR} FROM bars")
def stream_idle_bars(spark, d):
    """All bars of a stream, also the last of each product, which nothing but a timer closes."""
    return ntz(idle_bars.with_side_table(idle_bars.flushed_bars(live_ticks(spark, d), "1h", speed=SPEED), IDLE)[0])


@query(
    f"WITH {TICKS}, cut AS (SELECT make_timestamp(min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) * 3 // 4) AS until FROM ticks), o AS (SELECT product, max(date_trunc('hour', ts)) AS last FROM ticks, cut WHERE seq % 97 <> 0 AND ts < until GROUP BY 1) "
    "SELECT product, seq, ts FROM ticks JOIN o USING (product) WHERE seq % 97 = 0 AND date_trunc('hour', ts) < last"
)
def stream_late_ticks(spark, d):
    """Ticks that come in the last micro-batch, after their bars are out."""
    t = m.ticks(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    end = t.agg(F.max("ts").alias("end"))
    arrived = t.crossJoin(F.broadcast(end)).withColumn("arrived", F.when(F.col("seq") % 97 == 0, F.col("end")).otherwise(F.col("ts"))).drop("end")
    late = idle_bars.with_side_table(idle_bars.flushed_bars(streams.replay(spark, arrived, "arrived"), "1h", speed=SPEED), IDLE)[1]
    return late.select("product", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(f"WITH {HOURLY} SELECT {BAR} FROM bars")
def stream_partial_bars(spark, d):
    """The last version of every bar of a stream that gives open bars too."""
    return ntz(partial_bars.last_versions(spark, partial_bars.partial_bars(live_ticks(spark, d), "1h")))
