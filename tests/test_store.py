import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.session import shared_path
from tickloom.sources import artifacts, store
from tickloom.sources.market import DataNotFound

DAY = dt.date(2024, 1, 1)


def bars(spark, days=4, products=("a", "7", "c d/é"), price=1.0):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h), p, "1_HOUR", price, price + h, price - 1, price, 1.0) for d in range(days) for h in range(3) for p in products]
    return spark.createDataFrame(rows, "date timestamp, product string, resolution string, open double, high double, low double, close double, volume double")


def rows(df):
    return sorted((r.date, r["product"], r.high, r.volume) for r in df.collect())


def test_days_are_read_alone_and_replaced_alone(spark):
    path = shared_path(spark, "days")
    df = bars(spark)
    store.write_days(df, path)
    assert rows(store.read_days(spark, path)) == rows(df)
    some = store.read_days(spark, path, ["7", "none"], dt.date(2024, 1, 2), dt.date(2024, 1, 3))
    assert rows(some) == rows(df.where("product = '7' AND day(date) IN (2, 3)"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    new = bars(spark, 1, ("7",), 5.0)
    store.write_days(new, path)
    assert rows(store.read_days(spark, path)) == rows(df.where("NOT (product = '7' AND day(date) = 1)").union(new))
    with pytest.raises(Exception, match="product and a date"):
        store.write_days(df.withColumn("product", F.lit(None).cast("string")), path)


def test_cache_policies(spark):
    origin, cache = shared_path(spark, "origin"), shared_path(spark, "cache")
    store.write_days(bars(spark), origin)
    daily = store.Request(origin, "1h", "1d", ("a", "7"), DAY, dt.date(2024, 1, 3))
    same = store.Request(origin + "/", "1_HOUR", "1_DAY", ("7", "a", "7"), dt.datetime(2024, 1, 1, 5), dt.date(2024, 1, 3))
    assert daily.key == same.key != store.Request(origin, "1h", "1d", ("a",), DAY, dt.date(2024, 1, 3)).key
    first, where = store.cached(spark, daily, cache, False)
    assert where == "origin" and first.count() == 6
    second, where = store.cached(spark, daily, cache)
    assert where == "stored" and rows(second) == rows(first)
    store.write_days(bars(spark, price=9.0), origin)
    third, where = store.cached(spark, same, cache)
    assert where == "cache" and rows(third) == rows(second)
    store.forget(spark, daily, cache)
    assert store.cached(spark, daily, cache)[1] == "stored"
    plain = store.Request(origin, "1h", "1h")
    assert [store.cached(spark, plain, cache, p)[1] for p in ("auto", False, True, "auto")] == ["origin", "origin", "stored", "cache"]
    with pytest.raises(ValueError):
        store.cached(spark, plain, cache, "always")


def test_nothing_stored(spark):
    origin, cache = shared_path(spark, "origin"), shared_path(spark, "cache")
    with pytest.raises(DataNotFound):
        store.cached(spark, store.Request(origin, "1h", "1d"), cache)
    store.write_days(bars(spark, 1), origin)
    got, where = store.cached(spark, store.Request(origin, "1h", "1d", ("none",)), cache, True)
    assert where == "origin" and got.count() == 0


def test_upkeep_of_stored_frames(spark):
    path, to = shared_path(spark, "frame"), shared_path(spark, "frame")
    df = bars(spark)
    artifacts.save_frame(df.repartition(7), path, {"signals": ["s"]})
    artifacts.compact(spark, path, to)
    got, about = artifacts.load_frame(spark, to)
    assert rows(got) == rows(df) and about == {"signals": ["s"]}
    files = [f for f in got.inputFiles()]
    assert len(files) == 3 < len(artifacts.load_frame(spark, path)[0].inputFiles())
    hour = 3600.0
    versions = spark.createDataFrame([(f"v{k}", 1e9 - k * 100 * hour) for k in range(5)], "path string, written double")
    assert sorted(r.path for r in artifacts.expired(versions, keep=2, now=1e9).collect()) == ["v2", "v3", "v4"]
    assert sorted(r.path for r in artifacts.expired(versions, keep=4, now=1e9).collect()) == ["v4"] and artifacts.expired(versions.limit(0)).count() == 0
    with pytest.raises(ValueError):
        artifacts.expired(versions, hours=1)
