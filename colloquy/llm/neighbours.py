"""Nearest neighbours by stable projections, kd-trees and a chi-square stopping test.

Vectors are projected on ``DIMS`` Gaussian directions.  A squared projected distance over
the squared true distance follows the chi-square law with ``DIMS`` degrees, so once the
next projected neighbour is at distance r and the k-th verified neighbour at distance d,
an unseen nearer vector has probability 1 - F(r^2 / d^2) at most of being that far out in
the projection.  A query takes projected neighbours in order from a kd-tree, verifies
them on the original vectors and stops when that probability falls below ``MISS``.

The vectors are dealt into blocks by a hash; each block is one kd-tree of bounded size and
holds every vector of its own, queries are dealt in blocks of bounded size too, and a
task searches one tree for one block of queries.  The k best of the trees are merged.

Edge cases: vectors that are null, zero, of another length than most or hold null or
non-finite components take no part; ties go to the smaller vec_id; repeated rows are
candidates each, a query never meets its own vec_id; with fewer candidates all are
returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ship, store

DIMS = 8
MISS = 0.002
LEAF = 32
#: Vectors of a tree and queries of a task, about.
TREE = 16_384
ASKED = 512


def chi_square(x: float) -> float:
    """The distribution function of the chi-square law with DIMS (even) degrees of freedom."""
    term = total = 1.0
    for i in range(1, DIMS // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stop_ratio() -> float:
    """The r^2 / d^2 from which on the test holds."""
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle) < 1 - MISS else (low, middle)
    return high


def directions(size: int, seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, DIMS))


class Tree:
    """A kd-tree over projected points: every node splits its widest direction at the median."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.low, self.high, self.span, self.kids = [], [], [], []
        self._build(0, len(points))

    def _build(self, a: int, b: int) -> int:
        own = self.points[self.order[a:b]]
        node = len(self.low)
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.span.append((a, b))
        self.kids.append(None)
        if b - a > LEAF:
            axis = int((self.high[node] - self.low[node]).argmax())
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], middle)]
            self.kids[node] = (self._build(a, a + middle), self._build(a + middle, b))
        return node

    def nearest(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """Leaves by the least squared projected distance they can hold; the value bounds all that follow."""
        low, high = self._bounds
        heap = [(0.0, 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if self.kids[node] is None:
                a, b = self.span[node]
                yield bound, self.order[a:b]
                continue
            for kid in self.kids[node]:
                out = np.maximum(np.maximum(low[kid] - q, q - high[kid]), 0)
                heapq.heappush(heap, (float(out @ out), kid))

    def ready(self) -> Tree:
        self._bounds = np.array(self.low), np.array(self.high)
        return self


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, distance) of the k nearest of one tree for every query."""
    w, ratio, out = directions(vectors.shape[1]), stop_ratio(), []
    tree = Tree(vectors @ w).ready()
    for own, q in zip(query_ids, queries):
        best: list[tuple[float, int]] = []  # the k nearest, as (-distance, -vec_id), the worst on top
        slack = 1e-18 * float(q @ q)  # equal vectors differ by rounding in the projection
        for bound, rows in tree.nearest(q @ w):
            if len(best) == k and bound > ratio * best[0][0] ** 2 + slack:
                break
            rows = rows[ids[rows] != own]
            gaps = np.sqrt(((vectors[rows] - q) ** 2).sum(1))
            for gap, vec in zip(gaps.tolist(), ids[rows].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (-gap, -vec))
                elif (-gap, -vec) > best[0]:
                    heapq.heapreplace(best, (-gap, -vec))
        out += [(int(own), -vec, -gap) for gap, vec in best]
    return out


def _usable(rows: DataFrame) -> DataFrame:
    """vec_id and vectors in double precision, without those that take no part."""
    v = F.col("v")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists(v, lambda x: x != 0))


def nearest(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other vectors of every query, by Euclidean distance."""
    ship(rows.sparkSession)
    vectors = store(_usable(rows), "vectors")
    sizes = vectors.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").head()
    size = sizes["size"] if sizes else 1
    vectors = vectors.where(F.size("v") == size)
    count = vectors.count()
    asked = vectors.where(is_query)
    trees, groups = max(1, -(-count // TREE)), max(1, -(-asked.count() // ASKED))
    dealt = vectors.withColumn("tree", F.pmod(F.xxhash64("vec_id", "v"), F.lit(trees)))
    # every tree for every group of queries: blocks against blocks
    base = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    probe = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long"))))

    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            found = search(left["vec_id"].to_numpy(), np.stack(left["v"]), right["vec_id"].to_numpy(), np.stack(right["v"]), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = base.groupBy("tree", "part").cogroup(probe.groupBy("tree", "part")).applyInPandas(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
