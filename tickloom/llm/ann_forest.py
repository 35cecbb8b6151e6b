"""Approximate nearest neighbours by cosine, with a forest of random-projection trees.

The trees are grown on the driver from a bounded sample: a node's plane separates two random
vectors of it at the median. Their depth follows the number of rows, about ``LEAF`` of them to
a leaf, as far as the sample goes: a leaf has ``LEAST_LEAF`` of its vectors at least. Every row is put into its leaf of each tree. A query walks all trees
through one priority queue, nearest planes first, until it has met ``probes`` leaves. How many
that takes for the wanted recall is measured on the sample against brute force. What lies in
the leaves is reranked exactly.

Leaves meet queries by cells, the leaves below one node at depth ``CELL_DEPTH``, in groups of at
most about ``BLOCK`` rows on either side: a large cell is cut into blocks, and so are many queries.
A query is compared with the leaves that it has met only. Vectors that are the same are one candidate with
its least ids, reduced within each batch before the shuffle. A block gives for each query the
candidates that can be among the nearest by score and then id, without their vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import checkpointed, hashed_sample, table

K, EVERY = 5, 50
TREES, LEAF, LEAST_LEAF, CELL_DEPTH = 6, 256, 16, 6
SAMPLE, TRIALS, RECALL = 20_000, 200, 0.95
BLOCK = 4096
#: More than a matrix product's scores are off the exact ones.
ROUNDING = 1e-9


class Forest:
    """Planes in one matrix; children are node numbers, or -1 - leaf."""

    def __init__(self, x: np.ndarray, depth: int, trees: int = TREES, seed: int = 7):
        self.planes: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []
        #: Cell of each leaf.
        self.cells: list[int] = []
        self.n_cells = 0
        random = np.random.default_rng(seed)
        self.roots = [self._grow(x, depth, 0, random) for _ in range(trees)]
        self.matrix = np.array(self.planes).reshape(len(self.planes), x.shape[1])
        self.shift = np.array(self.offsets)

    @property
    def n_leaves(self) -> int:
        return len(self.cells)

    def _grow(self, x: np.ndarray, depth: int, at_depth: int, random) -> int:
        if at_depth <= CELL_DEPTH:
            self.n_cells += 1
        if at_depth < depth and len(x) >= 2 * LEAST_LEAF:
            a, b = x[random.choice(len(x), 2, replace=False)]
            plane = a - b
            if (size := np.linalg.norm(plane)) > 0:
                at = x @ (plane / size)
                middle = float(np.median(at))
                if 0 < (at > middle).sum() < len(x):
                    node = len(self.planes)
                    self.planes.append(plane / size)
                    self.offsets.append(middle)
                    self.children.append([0, 0])
                    self.children[node] = [self._grow(x[side], depth, at_depth + 1, random) for side in (at <= middle, at > middle)]
                    return node
        self.cells.append(self.n_cells)
        return -len(self.cells)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix.T - self.shift

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, found level by level with one plane a vector."""
        children = np.array(self.children).reshape(-1, 2)
        out = np.empty((len(x), len(self.roots)), dtype=np.int32)
        for start in range(0, len(x), 2048):
            part = x[start : start + 2048]
            for t, root in enumerate(self.roots):
                at = np.full(len(part), root)
                while (inner := np.flatnonzero(at >= 0)).size:
                    node = at[inner]
                    side = np.einsum("ij,ij->i", part[inner], self.matrix[node]) > self.shift[node]
                    at[inner] = children[node, side.astype(int)]
                out[start : start + len(part), t] = -1 - at
        return out

    def probe(self, margins: np.ndarray, probes: int) -> list[int]:
        """Leaves in order of nearness: one queue over all trees, keyed by the nearest plane crossed."""
        queue = [(-math.inf, t, root) for t, root in enumerate(self.roots)]
        found: list[int] = []
        while queue and len(found) < probes:
            bound, t, node = heapq.heappop(queue)
            if node < 0:
                found.append(-1 - node)
                continue
            m = float(margins[node])
            left, right = self.children[node]
            heapq.heappush(queue, (max(bound, m), t, left))
            heapq.heappush(queue, (max(bound, -m), t, right))
        return found


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def calibrated(forest: Forest, x: np.ndarray, k: int = K, trials: int = TRIALS, recall: float = RECALL) -> int:
    """Leaves to visit so that the sample's own neighbours are found with the wanted recall."""
    if len(x) < 2:
        return forest.n_leaves
    q = x[: min(trials, len(x))]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -np.inf
    truth = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    needed: list[int] = []
    for near_ones, m in zip(truth, forest.margins(q)):
        rank = {leaf: n for n, leaf in enumerate(forest.probe(m, forest.n_leaves), 1)}
        needed += [min(rank[leaf] for leaf in leaves) for leaves in forest.leaves(x[near_ones]).tolist()]
    return int(min(forest.n_leaves, np.sort(needed)[min(len(needed) - 1, math.ceil(recall * len(needed)))]))


def _classes(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if not len(batch):
            continue
        kept = batch.sort_values("id").groupby("raw", sort=False)["id"].apply(lambda s: s.head(most).tolist())
        yield pd.DataFrame({"raw": kept.index, "ids": kept.values})


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows that take part; ``v`` are doubles."""
    v = F.col(vec_col).cast("array<double>")
    # A sum of squares with a null in it is null, and with a NaN or an infinity it is not below infinity.
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    finite = F.coalesce((squares > 0) & (squares < float("inf")), F.lit(False))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest of each query, the rows whose id is divisible by ``every``: query_id, rank, id, score.

    Rows with a null id or a vector that is null, zero, or has null or non-finite components take
    no part, nor do vectors of another length than most of the sample's. A query that is there
    twice is asked once for each different vector; candidates with the query's id are left out.
    Equal scores rank by id.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    some = [v for _, v in sorted((r["id"], np.array(r["v"]).tobytes()) for r in hashed_sample(rows, F.col("id"), sample).toLocalIterator())]
    lengths = [len(v) // 8 for v in some]
    dims = max(set(lengths), key=lengths.count) if some else 0
    x = _unit(np.frombuffer(b"".join(v for v in some if len(v) == 8 * dims)).reshape(-1, max(dims, 1)))
    x = x[np.random.default_rng(5).permutation(len(x))]
    rows = rows.where(F.size("v") == dims)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            yield pd.DataFrame({"id": b["id"], "raw": [np.asarray(v, dtype=np.float64).tobytes() for v in b["v"]]})

    packed = rows.mapInPandas(pack, "id bigint, raw binary")
    reduced = packed.mapInPandas(lambda batches: _classes(batches, k + 1), "raw binary, ids array<bigint>")
    merged = reduced.groupBy("raw").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))

    merged = checkpointed(spark, merged, "vectors")
    forest = Forest(x, depth=max(1, math.ceil(math.log2(max(2, merged.count() / LEAF)))))
    probes = calibrated(forest, x, k, recall=recall)
    held = spark.sparkContext.broadcast(forest)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                leaves = held.value.leaves(_unit(np.frombuffer(b"".join(b["raw"]), np.float64).reshape(len(b), -1)))
                cells = [[{"cell": held.value.cells[leaf], "leaf": leaf} for leaf in mine] for mine in leaves.tolist()]
                yield pd.DataFrame({"at": cells, "raw": b["raw"], "ids": b["ids"]})

    index = checkpointed(spark, merged.mapInPandas(place, "at array<struct<cell: int, leaf: int>>, raw binary, ids array<bigint>"), "leaves")
    def by_cell(leaves: list[int]) -> list[dict]:
        out: dict[int, list[int]] = {}
        for leaf in leaves:
            out.setdefault(held.value.cells[leaf], []).append(leaf)
        return [{"cell": cell, "leaves": mine} for cell, mine in out.items()]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = _unit(np.frombuffer(b"".join(b["raw"]), np.float64).reshape(len(b), -1))
                asked = [held.value.probe(m, probes) for start in range(0, len(v), 256) for m in held.value.margins(v[start : start + 256])]
                yield pd.DataFrame({"id": b["id"], "raw": b["raw"], "at": [by_cell(leaves) for leaves in asked]})

    queries = packed.where(F.col("id") % every == 0).dropDuplicates(["id", "raw"])
    asked = checkpointed(spark, queries.mapInPandas(ask, "id bigint, raw binary, at array<struct<cell: int, leaves: array<int>>>"), "queries")
    placed, wanted = (df.withColumn("at", F.explode("at")).select("*", "at.*").drop("at") for df in (index, asked))

    def cuts(df: DataFrame, name: str) -> DataFrame:
        """The cells that have more than one block of these rows."""
        return df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name)).where(F.col(name) > 1)

    sizes = checkpointed(spark, cuts(placed, "blocks").join(cuts(wanted, "turns"), "cell", "full"), "cuts")

    def blocked(df: DataFrame, mine: str, mine_cuts: str, theirs: str, their_cuts: str, spread: Column) -> DataFrame:
        """Each row once in its own block of a cell, and there once for each block of the other side."""
        cut = df.join(sizes, "cell", "left").fillna(1, ["blocks", "turns"])
        own = F.pmod(spread, F.col(mine_cuts)).cast("int")
        others = F.explode(F.sequence(F.lit(0), (F.col(their_cuts) - 1).cast("int")))
        return cut.withColumn(mine, own).withColumn(theirs, others).drop("blocks", "turns")

    right = blocked(placed, "i", "blocks", "q", "turns", F.xxhash64("raw"))
    left = blocked(wanted, "q", "turns", "i", "blocks", F.xxhash64("id")).withColumn("form", F.xxhash64("raw"))

    def rerank(_key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"id": np.empty(0, np.int64), "form": np.empty(0, np.int64), "ids": np.empty(0, object), "score": np.empty(0)})
        a, b = (np.frombuffer(b"".join(z["raw"]), np.float64).reshape(len(z), -1) for z in (q, c))
        la, lb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        least = np.array([ids[0] for ids in c["ids"]])
        counts = [len(x) for x in q["leaves"]]
        asking, wanted_leaf = np.repeat(np.arange(len(q)), counts), np.concatenate([*q["leaves"]])
        leaf = c["leaf"].to_numpy()
        found_i, found_j = [np.empty(0, int)], [np.empty(0, int)]
        for here in np.unique(leaf):
            i, j = asking[wanted_leaf == here], np.flatnonzero(leaf == here)
            if not len(i):
                continue
            near = (a[i] @ b[j].T) / np.outer(la[i], lb[j])
            least_near = np.partition(near, len(j) - min(k + 1, len(j)), axis=1)[:, len(j) - min(k + 1, len(j))]
            x, y = np.nonzero(near >= least_near[:, None] - ROUNDING)
            found_i.append(i[x])
            found_j.append(j[y])
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        exact = (a[i] * b[j]).sum(axis=1) / (la[i] * lb[j])
        # A candidate behind k + 1 others, by score and then its least id, has k better ids than any of its own.
        order = np.lexsort((least[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) <= k
        i, j = i[kept], j[kept]
        return pd.DataFrame({"id": q["id"].to_numpy()[i], "form": q["form"].to_numpy()[i], "ids": c["ids"].to_numpy()[j], "score": exact[kept]})

    found = left.groupBy("cell", "i", "q").cogroup(right.groupBy("cell", "i", "q")).applyInPandas(rerank, "id bigint, form bigint, ids array<bigint>, score double")
    # An id with several vectors counts with the nearest one.
    each = found.select("id", "form", "score", F.explode("ids").alias("other")).where("id <> other").groupBy("id", "form", "other").agg(F.max("score").alias("score"))
    order = Window.partitionBy("id", "form").orderBy(F.desc("score"), "other")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("other").alias(id_col), "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of each whose vec_id is divisible by 50, by cosine; useless vectors take no part."""
    return nearest(table(spark, sf_dir, "embeddings"))
