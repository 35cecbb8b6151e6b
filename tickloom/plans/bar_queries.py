"""Queries on sources, keys, bars, reshaping and alignment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tickloom.functions.resolution import parsed
from tickloom.operators import align as al
from tickloom.operators import bars as b
from tickloom.operators import keys as k
from tickloom.operators import reshape as rs
from tickloom.operators.signals import in_range
from tickloom.plans.registry import BAR, BOTH, DAILY, HOURLY, NEWS, TICKS, bars_sql, query
from tickloom.sources import market as m
from tickloom.streaming import dispatch

PRODUCTS = ("click", "error", "purchase", "signup", "view")


def hourly(spark, d):
    return b.ohlcv(m.ticks(spark, d), "1h")


def daily(spark, d):
    return b.ohlcv(m.ticks(spark, d), "1d")


@query(f"WITH {TICKS}, {bars_sql('hour', '1_HOUR')} SELECT {BAR} FROM bars")
def ohlcv_bars(spark, d):
    return hourly(spark, d)


@query(f"WITH {HOURLY} SELECT CAST(date_trunc('day', date) AS TIMESTAMP) AS date, product, '1_DAY' AS resolution, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume FROM bars GROUP BY 1, 2")
def resample_bars(spark, d):
    return b.resample(hourly(spark, d), "1d")


@query(f"WITH {TICKS} SELECT CAST(date_trunc('hour', ts - INTERVAL 30 MINUTES) AS TIMESTAMP) + INTERVAL 30 MINUTES AS date, product, '1_HOUR' AS resolution, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2")
def shifted_bars(spark, d):
    return b.ohlcv(m.ticks(spark, d), "1h", shift=30)


@query(f"WITH {TICKS} SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS date, product, sum(seq)::DOUBLE AS delta, arg_max(seq, ts)::DOUBLE AS snapshot FROM ticks GROUP BY 1, 2")
def volume_modes(spark, d):
    t = m.ticks(spark, d).withColumn("volume", F.col("seq").cast("double"))
    one, two = (b.ohlcv(t, "1h", volume_mode=v).select("date", "product", F.col("volume").alias(v)) for v in ("delta", "snapshot"))
    return one.join(two, ["date", "product"])


@query(f"WITH {HOURLY} SELECT {BAR} FROM bars QUALIFY date > min(date) OVER (PARTITION BY product)")
def skip_first_bar(spark, d):
    return b.skip_first(hourly(spark, d))


@query(f"WITH {HOURLY} SELECT {BAR} FROM bars WHERE date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10' AND product IN ('click', 'view')")
def scan_range(spark, d):
    return m.retrieve(hourly(spark, d), ["click", "view"], dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 10))


@query(f"WITH {HOURLY} SELECT {BAR}, 'BATCH' AS source_type FROM bars")
def union_sort(spark, d):
    h = hourly(spark, d)
    return m.with_source_type(m.stack([h.where(F.col("product") == p) for p in PRODUCTS]))


@query(f"WITH {HOURLY}, {bars_sql('day', '1_DAY', 'daily')} SELECT {BAR}, NULL::DOUBLE AS extra FROM bars UNION ALL SELECT {BAR}, close * 2 FROM daily")
def stack_diagonal(spark, d):
    return m.stack([hourly(spark, d), daily(spark, d).withColumn("extra", F.col("close") * 2)])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def reference_merge(spark, d):
    c = m.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return m.reference_data(c, c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") * 2), ["c_custkey"])


@query("SELECT o_orderkey, 'kline.' || (o_custkey % 60 + 1) || '.' || o_orderpriority AS channel FROM orders")
def channel_name(spark, d):
    o = m.table(spark, d, "orders")
    return o.select("o_orderkey", dispatch.channel("kline", F.col("o_orderpriority"), F.col("o_custkey") % 60 + 1).alias("channel"))


@query("SELECT c_nationkey, (rn - 1) // 10 AS chunk, string_agg(c_name, ',' ORDER BY c_custkey) AS names FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) GROUP BY 1, 2")
def chunk_list(spark, d):
    lists = dispatch.subscriptions(m.table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_name", 10)
    return lists.select("c_nationkey", "chunk", F.array_join("names", ",").alias("names"))


DUE = f"WITH {HOURLY}, c AS (SELECT *, date + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 10:30:00' AS closed FROM bars) "


@query(DUE + f"SELECT {BAR} FROM c WHERE closed QUALIFY row_number() OVER (PARTITION BY product ORDER BY date) >= 3")
def steps_long(spark, d):
    """Closed bars at which a long component steps, after three of a product, among bars of two resolutions."""
    return dispatch.steps(hourly(spark, d).union(daily(spark, d)), "1h", dt.datetime(2024, 1, 20, 10, 30), warmup=3)


@query(DUE + ", w AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM c WHERE closed AND product IN ('click', 'view', 'error') GROUP BY 1 HAVING count(*) = 3) " + f"SELECT {BAR} FROM c JOIN w USING (date) WHERE n >= 2 AND product IN ('click', 'view', 'error')")
def steps_wide(spark, d):
    """Closed bars at which a wide component steps: those of dates at which all its products have one."""
    return dispatch.steps(hourly(spark, d), "1h", dt.datetime(2024, 1, 20, 10, 30), "wide", ["click", "view", "error"], 2)


@query(f"WITH {HOURLY} SELECT {BAR} FROM bars", name="reorder_keys")
def reorder_keys(spark, d):
    return k.reordered(hourly(spark, d).select("close", "open", "product", "high", "low", "volume", "date", "resolution"))


@query(f"WITH {HOURLY} SELECT date, product, resolution, close - open AS momentum, close > open AS signal FROM bars")
def df_kinds(spark, d):
    h = hourly(spark, d).withColumns({"momentum": F.col("close") - F.col("open"), "signal": F.col("close") > F.col("open")})
    return k.kinds(h, ["signal"], ["open", "high", "low", "close", "volume"], "trading")


@query(f"WITH {HOURLY} SELECT {BAR} FROM bars ORDER BY date DESC, product DESC LIMIT 25")
def tail_n(spark, d):
    return b.last_rows(hourly(spark, d), 25, ["date", "product"])


@query(f"WITH {HOURLY} SELECT {BAR} FROM bars QUALIFY row_number() OVER (PARTITION BY product ORDER BY date DESC) <= 48")
def max_rows(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("product").orderBy(F.desc("date"))
    return hourly(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 48").drop("rn")


@query(f"WITH {HOURLY} SELECT {BAR}, date::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' AS by_day, date BETWEEN TIMESTAMP '2024-01-03 06:00' AND TIMESTAMP '2024-01-09 06:00' AS exactly FROM bars")
def data_range_mask(spark, d):
    day = in_range(F.col("date"), dt.date(2024, 1, 3), dt.date(2024, 1, 9))
    exact = in_range(F.col("date"), dt.datetime(2024, 1, 3, 6), dt.datetime(2024, 1, 9, 6))
    return hourly(spark, d).withColumns({"by_day": day, "exactly": exact})


@query(f"WITH {DAILY} SELECT {BAR} FROM bars WHERE date = TIMESTAMP '2024-01-02' AND product = 'view'")
def point_lookup(spark, d):
    return daily(spark, d).where((F.col("date") == F.lit(dt.datetime(2024, 1, 2))) & (F.col("product") == "view")).limit(1)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows, false AS has_null FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_violations(spark, d):
    return k.key_violations(m.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {BOTH} SELECT resolution, count(*) AS n_rows FROM (SELECT resolution FROM hourly UNION ALL SELECT resolution FROM daily) GROUP BY 1")
def resolution_count(spark, d):
    return k.resolutions(hourly(spark, d).unionByName(daily(spark, d)))


@query("SELECT o_custkey, o_orderkey, o_orderdate, previous FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE o_orderdate < previous")
def sortedness(spark, d):
    o = m.table(spark, d, "orders")
    return k.unsorted_rows(o, "o_orderkey", "o_orderdate", "o_custkey").select("o_custkey", "o_orderkey", "o_orderdate", "previous")


@query(f"WITH {HOURLY} SELECT date, product, resolution, close FROM bars")
def drop_market_columns(spark, d):
    return m.with_source_type(hourly(spark, d)).drop("source_type", "open", "high", "low", "volume")


WIDE = ", ".join(f"max(CASE WHEN product = '{p}' THEN {f} END) AS \"{p}:1_DAY:{f}\"" for p in PRODUCTS for f in ("close", "open"))


@query(f"WITH {DAILY} SELECT date, {WIDE} FROM bars GROUP BY 1")
def pivot_wide(spark, d):
    return rs.pivot_wide(daily(spark, d), ["open", "close"], [(p, "1_DAY") for p in PRODUCTS])


@query(f"WITH {DAILY} SELECT date, product, resolution, open, close FROM bars")
def unpivot_long(spark, d):
    return rs.unpivot_long(pivot_wide(spark, d), ["open", "close"])


@query("SELECT p_partkey, replace(replace(p_name || ':' || p_brand || '%', '%', '%25'), ':', '%3A') AS encoded, p_name || ':' || p_brand || '%' AS decoded FROM part")
def encode_pivot(spark, d):
    p = m.table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(":"), "p_brand", F.lit("%")).alias("t"))
    return p.select("p_partkey", rs.encoded(F.col("t")).alias("encoded")).withColumn("decoded", rs.decoded(F.col("encoded")))


@query(f"WITH {HOURLY} SELECT x.date, y.product, close FROM (SELECT DISTINCT date FROM bars) x CROSS JOIN (SELECT DISTINCT product FROM bars) y LEFT JOIN bars ON bars.date = x.date AND bars.product = y.product")
def panel_dense(spark, d):
    return rs.dense_panel(hourly(spark, d), "close")


@query(f"WITH {HOURLY} SELECT DISTINCT date FROM bars")
def wide_dates(spark, d):
    return hourly(spark, d).select("date").distinct()


@query(f"WITH {HOURLY} SELECT date, product, date + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS bar_close FROM bars")
def bar_close(spark, d):
    return b.bar_close(hourly(spark, d), "1h").select("date", "product", "bar_close")


@query(f"WITH {HOURLY} SELECT date, product, resolution, close * 2 AS doubled FROM bars WHERE close > 50")
def align_exact(spark, d):
    h = hourly(spark, d)
    return al.align_exact(h, h.where("close > 50").select("date", "product", "resolution", (F.col("close") * 2).alias("doubled")))


ASOF = (
    f"WITH {BOTH}, s AS (SELECT *, date + INTERVAL 1 HOUR - INTERVAL 1 MILLISECOND AS bc FROM hourly), o AS (SELECT product, close AS day_close, date + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS bc FROM daily) "
)


@query(ASOF + "SELECT s.date, s.product, s.resolution, o.day_close FROM s ASOF LEFT JOIN o ON s.product = o.product AND s.bc >= o.bc")
def align_asof(spark, d):
    other = daily(spark, d).select("date", "product", "resolution", F.col("close").alias("day_close"))
    return al.align_asof(hourly(spark, d), other, "1h", "1d")


GAPPY = f"{HOURLY}, spine AS (SELECT * FROM bars WHERE hour(date) % 3 <> 0)"


@query(f"WITH {GAPPY}, {NEWS} SELECT s.date, s.product, s.resolution, n.ts, headline_id, score FROM spine s JOIN news n ON n.product = s.product AND n.ts >= s.date AND n.ts < s.date + INTERVAL 1 HOUR")
def align_event(spark, d):
    spine = hourly(spark, d).where("hour(date) % 3 <> 0")
    return al.align_event(spine, m.news(spark, d).where("product IS NOT NULL"), "1h")


@query(f"WITH {GAPPY}, {NEWS} SELECT s.date, s.product, s.resolution, n.ts, headline_id, score FROM spine s JOIN news n ON (n.product = s.product OR n.product IS NULL) AND n.ts >= s.date AND n.ts < s.date + INTERVAL 1 HOUR")
def align_event_broadcast(spark, d):
    return al.align_event(hourly(spark, d).where("hour(date) % 3 <> 0"), m.news(spark, d), "1h")


EVENTS = f"WITH {GAPPY}, {NEWS}, a AS (SELECT s.date, s.product, s.resolution, headline_id, n.ts FROM spine s JOIN news n ON (n.product = s.product OR n.product IS NULL) AND n.ts >= s.date AND n.ts < s.date + INTERVAL 1 HOUR) "


@query(EVENTS + "SELECT date, product, resolution, string_agg(headline_id::VARCHAR, ',' ORDER BY ts, headline_id) AS headlines, count(*) AS news_count FROM a GROUP BY 1, 2, 3")
def events_by_bar(spark, d):
    aligned = al.align_event(hourly(spark, d).where("hour(date) % 3 <> 0"), m.news(spark, d), "1h")
    lists = al.collapse_events(aligned, ["ts", "headline_id"], "news")
    return lists.select("date", "product", "resolution", F.array_join(F.col("news_events.headline_id").cast("array<string>"), ",").alias("headlines"), "news_count")


@query(EVENTS + "SELECT s.date, s.product, s.close, count(a.headline_id) AS news_count FROM spine s LEFT JOIN a ON a.date = s.date AND a.product = s.product GROUP BY 1, 2, 3")
def merge_events(spark, d):
    spine = hourly(spark, d).where("hour(date) % 3 <> 0")
    return al.merge_events(spine, m.news(spark, d), "1h", "news", ["ts", "headline_id"]).select("date", "product", "close", "news_count")


@query(ASOF + "SELECT s.date, s.product, s.close, o.day_close FROM s ASOF LEFT JOIN o ON s.product = o.product AND s.bc >= o.bc")
def merge_signals_long(spark, d):
    child = daily(spark, d).select("date", "product", "resolution", F.col("close").alias("day_close"))
    return al.merge_child(hourly(spark, d), child, "1h", "1d").select("date", "product", "close", "day_close")


@query(f"WITH {HOURLY}, w AS (SELECT date, max(CASE WHEN product = 'click' THEN close END) AS click_close FROM bars GROUP BY 1) SELECT bars.date, product, close, click_close FROM bars LEFT JOIN w ON w.date = bars.date")
def merge_signals_wide(spark, d):
    h = hourly(spark, d)
    child = h.groupBy("date").agg(F.max(F.when(F.col("product") == "click", F.col("close"))).alias("click_close"))
    return al.merge_wide_child(h, child).select("date", "product", "close", "click_close")


@query(f"WITH {HOURLY} SELECT x.date, y.product FROM (SELECT DISTINCT date FROM bars) x CROSS JOIN (SELECT DISTINCT product FROM bars WHERE product <> 'error') y")
def cross_spine(spark, d):
    h = hourly(spark, d)
    return al.cross_spine(h, h.where("product <> 'error'"))


@query(f"WITH {HOURLY}, a AS (SELECT * FROM bars WHERE close > 40), t AS (SELECT date, product, resolution, open AS entry FROM bars WHERE close < 60) SELECT coalesce(a.date, t.date) AS date, coalesce(a.product, t.product) AS product, close, entry FROM a FULL JOIN t ON a.date = t.date AND a.product = t.product")
def full_df(spark, d):
    h = hourly(spark, d)
    trading = h.where("close < 60").select("date", "product", "resolution", F.col("open").alias("entry"), (F.col("close") * 0).alias("close"))
    return al.full_frame(h.where("close > 40"), trading).select("date", "product", "close", "entry")


@query(f"WITH {HOURLY} SELECT DISTINCT date, product, resolution FROM bars WHERE close > 60 OR close < 30")
def spine_union(spark, d):
    h = hourly(spark, d)
    return al.spine_union([h.where("close > 60"), h.where("close < 30"), h.where("close > 70")])


@query(f"WITH {HOURLY} SELECT date, product FROM bars WHERE close <= 50")
def anti_missing(spark, d):
    h = hourly(spark, d)
    return k.missing_rows(h.select("date", "product"), h.where("close > 50"), ["date", "product"])


@query(
    "SELECT p_partkey, p_size AS period, CASE p_partkey % 5 WHEN 0 THEN 'MINUTE' WHEN 1 THEN 'HOUR' WHEN 2 THEN 'QUOTE' WHEN 3 THEN 'DAY' END AS timeframe, CASE WHEN p_partkey % 5 = 2 THEN 2::BIGINT END AS level, "
    "CASE p_partkey % 5 WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN -2 WHEN 3 THEN 86400 END * p_size::BIGINT AS seconds FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN p_size::BIGINT END AS p_size FROM part)"
)
def parse_resolution(spark, d):
    """Resolutions written in several ways, their periods from the parts' sizes; some are none."""
    size = F.col("p_size").cast("string")
    text = F.element_at(F.array(F.concat(size, F.lit("m")), F.concat(size, F.lit("-hours")), F.concat(size, F.lit("q_L2")), F.concat(size, F.lit("_DAY")), F.concat(size, F.lit("bad!"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return m.table(spark, d, "part").select("p_partkey", parsed(text).alias("p")).select("p_partkey", "p.period", "p.timeframe", "p.level", "p.seconds")


@query("SELECT event_id, CAST(floor((epoch(ts) - 1800) / 3600) * 3600 + 1800 AS BIGINT) AS start_s, CAST(floor((epoch(ts) - 1800) / 3600) * 3600 - 1800 AS BIGINT) AS completed_s FROM events")
def bar_start(spark, d):
    e = m.table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.select("event_id", b.bar_start(F.col("t"), 3600, 1800).cast("bigint").alias("start_s"), b.bar_start(F.col("t"), 3600, 1800, True).cast("bigint").alias("completed_s"))


@query(f"WITH {HOURLY} SELECT date, product, epoch(date)::BIGINT AS inclusive_s, epoch(date)::BIGINT AS exclusive_s FROM bars")
def bar_from_end(spark, d):
    t = F.unix_micros(F.col("date").cast("timestamp")) / 1e6
    return hourly(spark, d).select("date", "product", b.bar_from_end(t + 3600 - 0.001, 3600).cast("bigint").alias("inclusive_s"), b.bar_from_end(t + 3600, 3600).cast("bigint").alias("exclusive_s"))


@query(f"WITH {HOURLY} SELECT {BAR} FROM bars QUALIFY row_number() OVER (PARTITION BY product ORDER BY date) >= 10")
def warmup_filter(spark, d):
    return b.ready(hourly(spark, d), 10)
