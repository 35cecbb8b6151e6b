import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import components, folds
from tickloom.operators.folds import Run


class Given:
    """A splitter that gives what it is told."""

    def __init__(self, *sides, n=None):
        self.sides, self.n = sides, len(sides) if n is None else n

    def get_n_splits(self, X=None, y=None, groups=None):
        return self.n

    def split(self, X, y=None, groups=None):
        yield from self.sides


def frame(spark, days, products=("a", "b")):
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=d), p, "1_DAY", float(d)) for d in range(days) for p in products]
    return spark.createDataFrame(rows, "date timestamp, product string, resolution string, close double")


def test_runs():
    assert folds.runs(1, "test", [5, 3, 4, 9, 9, 0]) == [Run(1, "test", 0, 1), Run(1, "test", 3, 6), Run(1, "test", 9, 10)]
    assert folds.runs(0, "train", []) == []
    with pytest.raises(TypeError):
        folds.runs(0, "train", [0.5])


@pytest.mark.parametrize("wrong", [Given(([0], [])), Given(([0, 1], [1])), Given(([0], [7])), Given(([-1], [2])), Given(([0], [1]), n=2)])
def test_faulty_splitters(wrong):
    with pytest.raises(ValueError):
        folds.folds_of(wrong, 5)


def test_no_splitter():
    with pytest.raises(TypeError):
        folds.folds_of(object(), 5)


@pytest.mark.parametrize("purge,embargo", [(0, 0), (2, 0), (0, 3), (2, 4), (50, 50)])
def test_purge_and_embargo(purge, embargo):
    rnd = np.random.default_rng(purge + embargo)
    side = rnd.integers(0, 3, 40)
    of = folds.folds_of(Given((np.flatnonzero(side == 0), np.flatnonzero(side == 1))), 40)
    test = np.flatnonzero(side == 1)
    ends = [r for r in of if r.side == "test"]
    want = {t for t in np.flatnonzero(side == 0).tolist() if not any(r.start - purge <= t < r.end + max(purge, embargo) for r in ends)}
    got = folds.purged(of, purge, embargo)
    assert {t for r in got if r.side == "train" for t in range(r.start, r.end)} == want
    assert {t for r in got if r.side == "test" for t in range(r.start, r.end)} == set(test.tolist())


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_rows_are_in_their_folds(spark, monkeypatch, broadcast):
    monkeypatch.setattr(folds, "BROADCAST_RUNS", broadcast)
    monkeypatch.setattr(folds, "CELLS", 7)
    df = frame(spark, 20).union(frame(spark, 1).withColumn("date", F.lit(None).cast("timestamp"))).withColumn("cell", F.lit("own"))
    sides = (([0, 1, 2, 3, 12], [5, 6, 7]), ([0, 19], [4, 8]))
    placed = folds.with_folds(df, Given(*sides))
    got = sorted((r.fold, r.side, r.time_idx, r.close, r["product"]) for r in placed.collect())
    assert got == sorted((k, s, t, float(t), p) for k, (a, b) in enumerate(sides) for s, ts in (("train", a), ("test", b)) for t in ts for p in "ab")
    with pytest.raises(ValueError):
        folds.with_folds(df.withColumn("side", F.lit(1)), Given(*sides))


def test_companions(spark):
    df = frame(spark, 6)
    placed = folds.with_folds(df, [Run(0, "train", 0, 4), Run(0, "test", 4, 6), Run(1, "test", 0, 6)])
    y = df.select("date", "product", "resolution", (-F.col("close")).alias("y"))
    got = sorted((r.fold, r.side, r.y, r["product"]) for r in folds.split_companion(placed, y).collect())
    assert got == sorted((r.fold, r.side, -r.close, r["product"]) for r in placed.collect())
    for wrong in (y.union(y), y.where("y < 0")):
        with pytest.raises(Exception, match="companion|twice"):
            folds.split_companion(placed, wrong).collect()


def test_ranks_of_no_dates(spark):
    assert folds.time_ranks(frame(spark, 1).limit(0)).count() == 0


def test_orders_of_a_strategy(spark):
    seen = []

    def trade(x: pd.DataFrame):
        assert list(x.columns) == ["close", "date"] and len(x) <= 3 and x["date"].is_monotonic_increasing
        return [components.Order(1, 2.0), components.Order(1, price=x["close"].iloc[0])] if len(x) == 3 and x["close"].iloc[-1] % 2 == 0 else None

    df = frame(spark, 6).withColumn("bars", F.lit("own"))
    got = sorted((r["product"], r.close, r.s, [tuple(o) for o in r.s_orders], r.bars) for r in components.trades(df.orderBy(F.rand(3)), trade, "s", 3, ["close", "date"]).collect())
    want = [(p, float(d), 1 if d in (2, 4) else None, [(1, 2.0, None), (1, 1.0, float(d - 2))] if d in (2, 4) else [], "own") for p in "ab" for d in range(6)]
    assert got == want and not seen
    assert components.trades(df.limit(0), trade, "s").count() == 0
    for wrong in (lambda x: [components.Order(1), components.Order(-1)], lambda x: components.Order(1), lambda x: ["buy"], lambda x: [components.Order(0)]):
        with pytest.raises(Exception, match="strategy gives|one side"):
            components.trades(df, wrong, "s").collect()
    for arguments in (("close",), ("s", 0)):
        with pytest.raises(ValueError):
            components.trades(df, trade, *arguments)


def test_predictions(spark):
    class Doubles:
        """A model with a ``predict``, as a library has it."""

        def predict(self, x):
            return np.stack([2 * x.sum(axis=1), np.full(len(x), np.nan)], axis=1)

    df = frame(spark, 3).withColumn("v", F.array(F.col("close"), F.lit(None).cast("double")))
    two = components.predict(df, ["close"], Doubles(), "m", (2,)).collect()
    assert all(r["m-0"] == 2 * r.close and r["m-1"] is None for r in two) and len(two) == 6
    cube = components.predict(df, ["v"], lambda x: np.arange(len(x) * 12).reshape(len(x), 2, 3, 2) * 0.0 + np.nan_to_num(x[:, :1, None, None]), "c", (2, 3, 2), ["one", "other"]).collect()
    assert all(r.one == [[r.close] * 3] * 2 == r.other for r in cube)
    assert components.predict(df.limit(0), ["close"], Doubles(), "m", (2,)).count() == 0
    for model, shape in ((lambda x: None, ()), (lambda x: 1.0, ()), (lambda x: x, ()), (Doubles(), (3,)), (lambda x: x[:1, 0], ())):
        with pytest.raises(Exception, match="predictions of shape|a value for each row"):
            components.predict(df, ["close"], model, "m", shape).collect()
    for arguments in (("close", ()), ("m", (2,), ["one"])):
        with pytest.raises(ValueError):
            components.predict(df, ["close"], Doubles(), *arguments)
    with pytest.MonkeyPatch.context() as m, pytest.raises(ValueError):
        m.setattr(components, "MODEL_BYTES", 10)
        components.predict(df, ["close"], Doubles(), "m", (2,))
