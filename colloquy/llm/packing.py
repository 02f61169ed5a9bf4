"""Best-fit packing of documents into sequences of a fixed number of tokens.

Only the histogram of piece lengths (at most ``capacity`` counts, however many documents)
reaches the driver, which makes a plan of sequence kinds: linear grouping rounds large
lengths up inside groups of equal cardinality, column generation finds how many sequences
of each few-size configuration to use, real lengths take the places of the rounded ones,
and what is left, mostly small pieces, goes best-fit into the gaps.  Pieces then find
their place by their rank among the pieces of their length.

Edge cases: null and empty texts are one piece holding the end id; longer documents are
cut so that only their first piece may be shorter; repeated rows are packed each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import ship, slices, store
from .tokens import encoder, vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int"
Run = tuple[int, tuple[tuple[int, int], ...]]  # sequences of one kind: how many, ((length, times), ...)


def pieces(docs: DataFrame, vocab: str, capacity: int, end: int = 2) -> DataFrame:
    """The pieces of every document; ``block`` numbers the task that made them."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        for batch in slices(batches, most=4 << 20, encoding=True):
            ids, offsets = encoder(vocab).encode(batch.column("text"), end)
            sizes = np.diff(offsets)
            counts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            stop = sizes[row] - (counts[row] - 1 - piece) * capacity
            start = np.maximum(stop - capacity, 0)
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((offsets[row] + start).tolist(), (offsets[row] + stop).tolist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(stop - start),
                pa.array(crc, pa.int64()), pa.array(np.full(len(row), block, np.int32))], ["doc_id", "piece", "start", "length", "ids_crc32", "block"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def group_sizes(counts: dict[int, int], groups: int) -> dict[int, list[tuple[int, int]]]:
    """Linear grouping: rounded size -> the (length, count) in it, longest first, groups of equal cardinality."""
    total, out, left, size = sum(counts.values()), defaultdict(list), 0, 0
    per = max(1, -(-total // groups))
    for length in sorted(counts, reverse=True):
        count = counts[length]
        while count:
            if not left:
                size, left = length, per
            take = min(count, left)
            out[size].append((length, take))
            count, left = count - take, left - take
    return dict(out)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Whole numbers of sequences of each configuration, from the relaxed problem by column generation."""
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(40 * m):
        price = np.linalg.solve(basis.T, np.ones(m))
        worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for at in range(1, capacity + 1):  # the unbounded knapsack of the best new configuration
            worth[at], last[at] = worth[at - 1], -1
            for k in range(m):
                if sizes[k] <= at and worth[at - sizes[k]] + price[k] > worth[at] + 1e-12:
                    worth[at], last[at] = worth[at - sizes[k]] + price[k], k
        if worth[capacity] <= 1 + 1e-7:
            break
        column, at = np.zeros(m), capacity
        while at > 0:
            if last[at] < 0:
                at -= 1
            else:
                column[last[at]] += 1
                at -= sizes[last[at]]
        level, step = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    level = np.linalg.solve(basis, need)
    return [([int(x) for x in basis[:, k]], int(level[k] + 1e-6)) for k in range(m)]


def plan(counts: dict[int, int], capacity: int, groups: int = 32) -> list[Run]:
    """Kinds of sequences that hold ``counts`` pieces of each length: the best of a few bounds between large and small."""
    made = (plan_with(counts, capacity, groups, capacity * n // 32) for n in (8, 12, 15, 16))
    return min(made, key=lambda runs: sum(times for times, _ in runs))


def plan_with(counts: dict[int, int], capacity: int, groups: int, small: int) -> list[Run]:
    """Lengths above ``small`` by grouping and configurations, the rest best-fit."""
    runs: list[Run] = [(counts[capacity], ((capacity, 1),))] if counts.get(capacity) else []
    left = {k: v for k, v in counts.items() if v and k != capacity}
    grouped = group_sizes({k: v for k, v in left.items() if k > small}, groups)
    open_runs: list[list[Run]] = [[] for _ in range(capacity + 1)]  # by free room
    sizes = sorted(grouped)
    if sizes:
        for config, times in configurations(sizes, [sum(c for _, c in grouped[s]) for s in sizes], capacity):
            made: list[tuple[int, list[int]]] = [(times, [])] if times else []
            for size, n in zip(sizes, config):
                for _ in range(n):  # real lengths take the place of the rounded one
                    split = []
                    for times, held in made:
                        while times:
                            if not grouped[size]:
                                split.append((times, held))
                                break
                            length, there = grouped[size][0]
                            take = min(times, there)
                            grouped[size][0:1] = [(length, there - take)] if there > take else []
                            left[length] -= take
                            split.append((take, [*held, length]))
                            times -= take
                    made = split
            for times, held in made:
                open_runs[capacity - sum(held)].append((times, tuple((x, 1) for x in held)))
    for length in sorted(left, reverse=True):
        count = left[length]
        while count:
            room = next((r for r in range(length, capacity) if open_runs[r]), capacity)
            fit = room // length
            times, held = open_runs[room].pop() if room < capacity else (-(-count // fit), ())
            full = min(times, count // fit)
            rest = min(count - full * fit, fit) if full < times else 0
            for n, k in ((full, fit), (1 if rest else 0, rest), (times - full - (1 if rest else 0), 0)):
                if n:
                    open_runs[room - k * length].append((n, held + (((length, k),) if k else ())))
            count -= full * fit + rest
    return runs + [r for at in open_runs for r in at if r[1]]


def slots(runs: list[Run]) -> dict[str, np.ndarray]:
    """For every length the places of its pieces by rank: from rank ``first`` on, sequences from ``sequence`` on, at ``offset``."""
    rows, taken, sequence = [], defaultdict(int), 0
    for times, held in runs:
        offset = 0
        for length, n in held:
            for _ in range(n):
                rows.append((length, taken[length], sequence, offset))
                taken[length] += times
                offset += length
        sequence += times
    rows.sort()
    return dict(zip(("length", "first", "sequence", "offset"), np.array(rows or np.zeros((0, 4)), np.int64).T))


def pack(docs: DataFrame, capacity: int = 1024, vocab: str | None = None, end: int = 2, groups: int = 32) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece and its place."""
    ship(docs.sparkSession)
    cut = store(pieces(docs, vocab or vocabulary(), capacity, end), "pieces")
    blocks = store(cut.groupBy("length", "block").agg(F.count("*").alias("n")), "blocks")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    place = slots(plan(counts, capacity, groups))
    # A length may hold a third of all pieces: number inside the blocks, and the blocks by one row each.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("length", "block", F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("inner", inner).join(blocks, ["length", "block"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = place["length"] << np.int64(44) | place["first"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length << np.int64(44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(place["sequence"][at] + rank - place["first"][at]), pa.array(place["offset"][at])],
                                             [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("inner") + F.col("before")).alias("rank")).mapInArrow(
        put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
