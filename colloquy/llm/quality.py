"""Quality scores: ridge regression on random Fourier features of document statistics.

Every text gets a row of statistics once.  Random Fourier features of the standardised
statistics approximate a Gaussian kernel; the normal equations are summed inside tasks,
then in a bounded number of groups, and solved on the driver; an isotonic step function,
fitted on binned scores of the labelled rows, turns scores into probabilities.  All
labelled rows are used; what reaches the driver has a fixed size.

Edge cases: null and empty texts have the statistics of an empty text and get a score;
rows without a label are scored only; without any label every score is 0.5; a document
with several labels counts with each; rows with a null doc_id are scored only; repeated
rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Words, drop, ship, slices, store
from .language import held_out_rows

STATISTICS = ["log_bytes", "log_words", "word_bytes", "word_bytes_sd", "longest_word", "space", "upper", "digit", "sign", "foreign", "marks_per_word",
              "odd_signs_per_word", "capital_words", "upper_words", "marked_words", "signed_words", "digit_words", "distinct_words", "distinct_triples",
              "lines_per_word", "short_words", "top_sign"]
FEATURES = 256
BINS = 400
_GROUPS = 32


def _class(*ranges: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(b"".join(ranges))] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_SIGN = _class(bytes(c for c in range(33, 127) if not chr(c).isalnum()))
_ODD = _class(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"))
_MARK, _FOREIGN, _BLANK = _class(b".,;:!?"), _class(bytes(range(128, 256))), _class(b" \t\n\r\f\v")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; lower-cased words and bytes, nothing else of the row."""
    words = Words(texts)
    raw, offsets, rows = words.raw, words.offsets, len(words.offsets) - 1
    size = np.maximum(np.diff(offsets), 1)

    def per_byte(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[raw], dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    counts = np.diff(words.first)
    n = np.maximum(counts, 1)
    owner = np.repeat(np.arange(rows), counts)
    length = (words.ends - words.starts).astype(float)
    mean = np.bincount(owner, length, rows) / n
    spread = np.sqrt(np.maximum(np.bincount(owner, length ** 2, rows) / n - mean ** 2, 0))
    longest = np.zeros(rows)
    np.maximum.at(longest, owner, length)
    first, last = (raw[words.starts], raw[words.ends - 1]) if len(raw) else (np.zeros(0, np.uint8),) * 2
    middle = raw[(words.starts + words.ends) // 2] if len(raw) else first
    share = lambda flags: np.bincount(owner, flags, rows) / n
    triples, bounds = words.shingles(3)
    distinct, distinct3, top = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    signs = np.flatnonzero(_SIGN)
    for i in np.flatnonzero(counts):
        distinct[i] = len(np.unique(words.hashes[words.first[i]:words.first[i + 1]]))
        distinct3[i] = len(np.unique(triples[bounds[i]:bounds[i + 1]])) / (bounds[i + 1] - bounds[i])
        top[i] = np.bincount(raw[offsets[i]:offsets[i + 1]], minlength=256)[signs].max()
    marks = per_byte(_MARK)
    return np.stack([
        np.log1p(np.diff(offsets)), np.log1p(counts), mean, spread, np.log1p(longest), per_byte(_BLANK) / size, per_byte(_UPPER) / size, per_byte(_DIGIT) / size,
        per_byte(_SIGN) / size, per_byte(_FOREIGN) / size, marks / n, per_byte(_ODD) / n, share(_UPPER[first]), share(_UPPER[first] & _UPPER[middle]),
        share(_MARK[last]), share(_ODD[last]), share(_DIGIT[first]), distinct / n, distinct3, per_byte(_class(b"\n")) / n, share(length <= 2), top / n], 1)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of each text."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(measure, "doc_id long, x array<double>")


def _matrix(column: pa.ListArray) -> np.ndarray:
    bounds = column.offsets.to_numpy()
    return column.values.to_numpy()[bounds[0]:bounds[-1]].reshape(len(column), -1)


class Features:
    """cos(Wx + b) of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), FEATURES)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))], 1)


def _summed(rows: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray] | None:
    """The normal equations of rows (x, quality): one matrix a task, summed in groups, then over the groups."""
    size = FEATURES + 1

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                z = features(_matrix(batch.column("x")))
                total += z.T @ np.concatenate([z, batch.column("quality").to_numpy().astype(float)[:, None]], 1)
        if total.any():
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % _GROUPS], pa.int64()), "sums": [total.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * (size + 1))
        for batch in batches:
            for raw in batch.column("sums"):
                total += np.frombuffer(raw.as_buffer(), float)
        if total.any():
            yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    parts = rows.mapInArrow(accumulate, "part long, sums binary").repartition(_GROUPS, "part").mapInArrow(add, "sums binary").collect()  # at most _GROUPS rows
    total = sum((np.frombuffer(bytes(r["sums"]), float) for r in parts), np.zeros(size * (size + 1))).reshape(size, size + 1)
    return (total[:, :-1], total[:, -1]) if total.any() else None


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing values, by pooling neighbours that violate the order."""
    means, weights, sizes = [], [], []
    for v, w in zip(value, weight):
        means.append(v)
        weights.append(w)
        sizes.append(1)
        while len(means) > 1 and means[-2] >= means[-1]:
            w = weights[-2] + weights[-1]
            means[-2:] = [(means[-2] * weights[-2] + means[-1] * weights[-1]) / w]
            weights[-2:], sizes[-2:] = [w], [sizes[-2] + sizes[-1]]
    return np.repeat(means, sizes)


def score_quality(docs: DataFrame, labels: DataFrame, ridge: float = 1e-3, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, quality)."""
    ship(docs.sparkSession)
    measured = store(with_statistics(docs.select(F.col("doc_id").cast("long"), "text")).withColumn("held_out", held_out_rows(5, 0)), "statistics")
    k = len(STATISTICS)
    moments = measured.agg(*[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(k) for f in (F.avg, F.stddev_pop)]).head()
    features = Features(np.array([moments[2 * i] or 0.0 for i in range(k)]), np.array([(moments[2 * i + 1] or 0.0) + 1e-9 for i in range(k)]))
    marks = labels.where("quality is not null").select(F.col("doc_id").cast("long"), F.col("quality").cast("double"))
    labelled = store(measured.where("not held_out").join(marks, "doc_id").select("x", "quality"), "labelled")
    sums = _summed(labelled, features)
    beta, knots, steps = np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5)
    if sums is not None:
        gram, target = sums
        beta = np.linalg.solve(gram + ridge * gram[-1, -1] / FEATURES * np.eye(len(gram)), target)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.clip(features(_matrix(batch.column("x"))) @ beta, -0.5, 1.5) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor((value + 0.5) / 2 * BINS).astype(np.int64)), batch.column("quality")], ["bin", "quality"])

    if sums is not None:
        binned = labelled.mapInArrow(raw, "bin long, quality double").groupBy("bin").agg(F.avg("quality").alias("y"), F.count("*").alias("w")).orderBy("bin").collect()  # at most BINS + 1
        knots = np.array([r["bin"] for r in binned])
        steps = isotonic(np.array([r["y"] for r in binned]), np.array([float(r["w"]) for r in binned]))
    drop(labelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                value = (np.clip(features(_matrix(batch.column("x"))) @ beta, -0.5, 1.5) + 0.5) / 2 * BINS - 0.5
                # between the steps the score rises a little with the value, so that ranks are kept
                got = np.clip(np.interp(value, knots, steps) * 0.98 + 0.02 * np.clip(value / BINS, 0, 1), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array((got >= threshold).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])

    return measured.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
