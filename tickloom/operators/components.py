"""Components: features, models and strategies as functions of frames, joined into one plan."""

from __future__ import annotations

import hashlib
import inspect
import pickle
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tickloom.operators.align import merge_child
from tickloom.session import KEYS


def signal_names(name: str, n: int) -> list[str]:
    """One signal column has the component's name, several are numbered."""
    return [name] if n == 1 else [f"{name}-{i}" for i in range(n)]


@dataclass
class Component:
    """``compute`` gives columns (a dict of expressions) or a frame; children's signals come as features."""

    name: str
    resolution: str
    compute: Callable[[DataFrame], DataFrame | dict[str, Column]]
    children: list[Component] = field(default_factory=list)
    signals: list[str] | None = None

    def frame(self, data: dict[str, DataFrame]) -> DataFrame:
        """Bars of the component's resolution with its children's signals and its own, as one lazy plan."""
        df = data[self.resolution]
        for child in self.children:
            below = child.frame(data).select(*KEYS, *child.signals)
            df = merge_child(df, below, self.resolution, child.resolution)
        made = self.compute(df)
        if isinstance(made, dict):
            made = df.withColumns(made)
        if not isinstance(made, DataFrame):
            raise TypeError("a component gives columns or a frame")
        new = [c for c in made.columns if c not in df.columns]
        if self.signals is not None and self.signals != new:
            raise ValueError(f"{self.name} gave {self.signals} before and gives {new} now")
        self.signals = new
        return made


#: Bytes of a pickled model that is broadcast.
MODEL_BYTES = 512 << 20
_models: dict[str, object] = {}


def _model_of(digest: str, held) -> object:
    """A broadcast model, unpickled once in a worker."""
    if digest not in _models:
        _models.clear()
        _models[digest] = pickle.loads(held.value)
    return _models[digest]


def _matrix(batch: pd.DataFrame, inputs: list[str]) -> np.ndarray:
    """Rows of numbers: one column of arrays, or columns of numbers; nulls are NaN."""
    if len(inputs) == 1 and len(batch) and isinstance(batch[inputs[0]].iloc[0], (list, np.ndarray)):
        return np.array([np.asarray(v, dtype=float) for v in batch[inputs[0]]])
    return batch[inputs].to_numpy(dtype=float)


def predict(df: DataFrame, inputs: list[str], model: object, name: str, shape: tuple[int, ...] = (), names: list[str] | None = None) -> DataFrame:
    """Adds a model's predictions; it is called, or its ``predict`` is, with batches of rows as a matrix.

    ``shape`` is that of one row's prediction: ``()`` gives one column, and otherwise the last
    dimension is that of the columns and the ones before nest arrays within them. ``inputs`` are
    columns of numbers, or one column of arrays of one length. Columns are named after the
    component unless ``names`` says otherwise. The model is pickled, checked to be at most
    ``MODEL_BYTES``, broadcast, and unpickled once a worker. A prediction of another shape, or of
    none, is an error; NaN in a column of numbers is null.
    """
    n = shape[-1] if shape else 1
    names = names or signal_names(name, n)
    if len(names) != n:
        raise ValueError(f"{n} columns are predicted and {len(names)} are named")
    if set(names) & set(df.columns):
        raise ValueError(f"there are columns of these names already: {sorted(set(names) & set(df.columns))}")
    content = cloudpickle.dumps(model)
    if len(content) > MODEL_BYTES:
        raise ValueError(f"a model of {len(content)} bytes is too large to be sent to every worker")
    held, digest = df.sparkSession.sparkContext.broadcast(content), hashlib.sha256(content).hexdigest()
    kind: DataType = DoubleType()
    for _ in shape[:-1]:
        kind = ArrayType(kind)
    schema = StructType([*df.schema.fields, *[StructField(c, kind) for c in names]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _model_of(digest, held)
        call = getattr(known, "predict", known)
        for b in batches:
            if not len(b):
                continue
            got = call(_matrix(b, inputs))
            if got is None or np.ndim(got) == 0:
                raise ValueError("a model gives a value for each row")
            got = np.asarray(got, dtype=float)
            if got.shape != (len(b), *shape):
                raise ValueError(f"predictions of shape {(len(b), *shape)} were announced and {got.shape} came")
            b = b.copy()
            for i, c in enumerate(names):
                part = got[..., i] if shape else got
                b[c] = part if part.ndim == 1 else part.tolist()
            yield b

    return df.mapInPandas(run, schema)


def run_hook(hook: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
    """A user's backtest of a frame: a function of one frame that gives a frame."""
    if len(inspect.signature(hook).parameters) != 1:
        raise TypeError("a backtest takes one frame")
    out = df.transform(hook)
    if not isinstance(out, DataFrame):
        raise TypeError("a backtest gives a frame")
    return out


class Order(NamedTuple):
    """One order of a strategy: side 1 or -1; no price is a market order."""

    side: int
    quantity: float = 1.0
    price: float | None = None


def _one_side(orders) -> tuple[int | None, list[Order]]:
    """The common side of a strategy's orders, and the orders."""
    orders = [] if orders is None else orders
    if not isinstance(orders, (list, set)):
        raise TypeError(f"a strategy gives a list of orders, not {type(orders).__name__}")
    out = list(orders)
    if any(not isinstance(o, Order) for o in out):
        raise TypeError("a strategy gives orders")
    sides = {o.side for o in out}
    if not sides <= {1, -1} or len(sides) > 1:
        raise ValueError(f"orders of one bar have one side, 1 or -1, not {sorted(sides)}")
    return (sides.pop() if sides else None), out


def trades(df: DataFrame, trade: Callable[[pd.DataFrame], list[Order] | None], name: str, look_back: int = 1, inputs: list[str] | None = None, groups: tuple[str, ...] = ("product", "resolution")) -> DataFrame:
    """Rows with the side of a strategy's orders as the signal ``name``, and ``<name>_orders``.

    ``trade`` sees the last ``look_back`` rows of a product, the current one last, as a frame of
    ``inputs`` (all columns, if None); fewer at its start. A table function is given each product
    in order of date and keeps just these rows, however long the product is. Orders of one bar
    have one side; no orders give a null.
    """
    if look_back < 1:
        raise ValueError("a strategy looks at one row at least")
    added = (name, f"{name}_orders")
    if set(added) & set(df.columns):
        raise ValueError(f"there are columns of these names already: {sorted(set(added) & set(df.columns))}")
    columns, seen = df.columns, inputs or df.columns
    places = [columns.index(c) for c in seen]
    order = ArrayType(StructType([StructField("side", IntegerType()), StructField("quantity", DoubleType()), StructField("price", DoubleType())]))

    class Trades:
        @staticmethod
        def analyze(bars: AnalyzeArgument) -> AnalyzeResult:
            fields = [*bars.dataType.fields, StructField(added[0], IntegerType()), StructField(added[1], order)]
            return AnalyzeResult(StructType(fields), partitionBy=[PartitioningColumn(g) for g in groups], orderBy=[OrderingColumn("date")])

        def __init__(self):
            self.rows: deque[tuple] = deque(maxlen=look_back)

        def eval(self, bars: Row):
            self.rows.append(tuple(bars[i] for i in places))
            side, orders = _one_side(trade(pd.DataFrame(list(self.rows), columns=seen)))
            yield (*bars, side, [(o.side, float(o.quantity), None if o.price is None else float(o.price)) for o in orders])

    return udtf(Trades)(df.asTable())
