"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, labels every position, and the
position probabilities of a document are averaged.  It is trained in numpy by
backpropagation through time on a bounded sample of labelled rows (``docs_per_lang``
documents of each language, chosen by a hash of the doc_id, and ``windows`` windows of
each, spread over the whole text); prediction reads every byte of every text.

Edge cases: null texts and texts without a letter are ``und`` with score 0, like all
texts where nothing can be learned; shorter windows are padded and the padding does not
count; ties go to the first language in order; rows with a null doc_id are predicted
only; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import free, ship, slices, text_bytes

WINDOW = 64
HIDDEN = 8
_WIDE = 2048


@dataclass
class Network:
    """Tables of gate inputs by byte (3H x 256), recurrent weights and biases for both directions, and the output layer."""

    langs: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def start(langs: list[str], seed: int = 7) -> Network:
        rng, h = np.random.default_rng(seed), HIDDEN
        new = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(langs, [new(3 * h, 256, scale=0.3) for _ in range(2)], [new(3 * h, h, scale=h ** -0.5) for _ in range(2)],
                       [np.zeros((3 * h, 1), np.float32) for _ in range(2)], new(len(langs), 2 * h, scale=0.3), np.zeros((len(langs), 1), np.float32))

    def weights(self) -> list[np.ndarray]:
        return [*self.inputs, *self.recurrent, *self.bias, self.out, self.out_bias]

    def _run(self, x: np.ndarray, way: int, trace: list | None = None) -> np.ndarray:
        """States after every byte of windows ``x`` (time, window) in one direction."""
        h, table, u, b = HIDDEN, self.inputs[way], self.recurrent[way], self.bias[way]
        states = np.empty((len(x), h, x.shape[1]), np.float32)
        state = np.zeros((h, x.shape[1]), np.float32)
        for t in range(len(x)) if way == 0 else range(len(x) - 1, -1, -1):
            back = u @ state
            back += b
            gates = np.take(table, x[t], axis=1)
            gates[:2 * h] += back[:2 * h]
            gates[:2 * h] *= 0.5
            np.tanh(gates[:2 * h], out=gates[:2 * h])
            gates[:2 * h] += 1
            gates[:2 * h] *= 0.5  # reset and update gates
            gates[2 * h:] += gates[:h] * back[2 * h:]
            new = np.tanh(gates[2 * h:])
            if trace is not None:
                trace.append((t, state, gates[:h].copy(), gates[h:2 * h].copy(), new, back[2 * h:]))
            state = new + gates[h:2 * h] * (state - new)
            states[t] = state
        return states

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of every language at every position: (time, language, window)."""
        logits = np.matmul(self.out, np.concatenate([self._run(x, 0), self._run(x, 1)], axis=1))
        logits += self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean position loss, by backpropagation through time; in the order of ``weights``."""
        h, traces = HIDDEN, ([], [])
        states = np.concatenate([self._run(x, way, traces[way]) for way in (0, 1)], axis=1)
        logits = np.matmul(self.out, states) + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        error = np.exp(logits)
        error /= error.sum(axis=1, keepdims=True)
        error[:, label, np.arange(len(label))] -= 1
        error *= (weight / weight.sum())[:, None, :]
        d_out = np.einsum("tln,thn->lh", error, states, optimize=True)
        d_states = np.matmul(self.out.T, error)
        d_in, d_u, d_b = [], [], []
        for way in (0, 1):
            table, u, bias = np.zeros((3 * h, 256), np.float32), np.zeros((3 * h, h), np.float32), np.zeros((3 * h, 1), np.float32)
            carry = np.zeros((h, x.shape[1]), np.float32)
            for t, before, reset, update, new, inner in reversed(traces[way]):
                d = d_states[t, way * h:(way + 1) * h] + carry
                d_new = d * (1 - update) * (1 - new * new)
                d_update = d * (before - new) * update * (1 - update)
                d_reset = d_new * inner * reset * (1 - reset)
                at_input = np.concatenate([d_reset, d_update, d_new])
                at_state = np.concatenate([d_reset, d_update, d_new * reset])
                ones = np.zeros((x.shape[1], 256), np.float32)
                ones[np.arange(x.shape[1]), x[t]] = 1
                table += at_input @ ones
                u += at_state @ before.T
                bias += at_state.sum(axis=1, keepdims=True)
                carry = d * update + u_t(self.recurrent[way]) @ at_state
            d_in.append(table)
            d_u.append(u)
            d_b.append(bias)
        return [*d_in, *d_u, *d_b, d_out, error.sum(axis=(0, 2))[:, None]]


def u_t(recurrent: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(recurrent.T)


def fit(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = 240, batch: int = 256, rate: float = 0.02) -> Network:
    """Train by Adam on windows (n, WINDOW); classes are drawn equally often."""
    net, rng = Network.start(langs), np.random.default_rng(11)
    by_class = [np.flatnonzero(labels == k) for k in range(len(langs))]
    first, second = ([np.zeros_like(w) for w in net.weights()] for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows, max(1, batch // len(langs))) for rows in by_class])
        weight = (np.arange(WINDOW)[:, None] < lengths[pick]).astype(np.float32)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(net.weights(), net.gradients(windows[pick].T, labels[pick], weight), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return net


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in windows: the windows (n, WINDOW) padded with 0, their lengths and rows."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[rows] + number * WINDOW
    lengths = np.minimum(sizes[rows] - number * WINDOW, WINDOW)
    padded = np.append(data, np.zeros(WINDOW, np.uint8))
    windows = padded[starts[:, None] + np.arange(WINDOW)]
    windows[np.arange(WINDOW) >= lengths[:, None]] = 0
    return windows, lengths, rows


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities of every text over all its positions: (text, language); rows without bytes are 0."""
    windows, lengths, rows = cut_windows(data, offsets)
    total = np.zeros((len(offsets) - 1, len(net.langs)))
    for a in range(0, len(windows), _WIDE):
        x = np.ascontiguousarray(windows[a:a + _WIDE].T)
        inside = (np.arange(WINDOW)[:, None] < lengths[a:a + _WIDE]).astype(np.float32)
        np.add.at(total, rows[a:a + _WIDE], np.einsum("tln,tn->nl", net.probabilities(x), inside))
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def training_windows(docs: DataFrame, docs_per_lang: int, windows: int) -> DataFrame:
    """lang and windows of the bounded sample."""
    order = Window.partitionBy("lang").orderBy("u", "doc_id")
    usable = docs.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")).withColumn("u", F.xxhash64("doc_id") / 2.0 ** 64 + 0.5)
    counts = usable.groupBy("lang").count().collect()  # one row a language
    # Rows whose hash is surely too great for the sample never leave their task.
    bound = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(3.0 * docs_per_lang / r["count"])) for r in counts], F.lit(0.0))
    sample = usable.where(F.col("u") <= bound).withColumn("place", F.row_number().over(order)).where(F.col("place") <= docs_per_lang)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            every, lengths, rows = cut_windows(*text_bytes(batch.column("text")))
            count = np.bincount(rows, minlength=batch.num_rows)
            first = np.cumsum(count) - count
            pick = np.concatenate([np.unique(np.linspace(f, f + c - 1, windows).astype(int)) for f, c in zip(first, count) if c])
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(rows[pick])), pa.array([w.tobytes() for w in every[pick]], pa.binary()),
                                              pa.array(lengths[pick])], ["lang", "window", "length"])

    return sample.select("text", "lang").mapInArrow(cut, "lang string, window binary, length long")


def train(docs: DataFrame, docs_per_lang: int = 1000, windows: int = 6) -> Network | None:
    """A network from labelled rows (doc_id, text, lang), or None without any."""
    rows = training_windows(docs, docs_per_lang, windows).collect()  # at most docs_per_lang * windows for each language
    rows.sort(key=lambda r: (r["lang"], r["window"]))
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    data = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    return fit(data, np.array([r["length"] for r in rows]), np.array([langs.index(r["lang"]) for r in rows]), langs)


def held_out_rows(divisor: int, remainder: int) -> Column:
    """Rows whose crc32 of the doc_id's text has this remainder; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder, F.lit(True))


def marks(docs: DataFrame) -> tuple[str, str]:
    """Names for the prediction and its score that no column of ``docs`` has."""
    return free(docs, "_lang_pred"), free(docs, "_lang_score")


def tagged(docs: DataFrame, net: Network | None) -> DataFrame:
    """All rows and columns of ``docs``, then the prediction and its score under the names of :func:`marks`."""
    lettered = docs.withColumn(free(docs, "_lettered"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(marks(docs), (StringType(), DoubleType())))])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ok = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            found = pooled(net, *text_bytes(batch.column("text"))) if net else np.zeros((batch.num_rows, 1))
            best = found.argmax(axis=1)
            names = [net.langs[k] if known and net else "und" for k, known in zip(best, ok)]
            score = np.where(ok, np.clip(found[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score)], schema.fieldNames())

    return lettered.mapInArrow(predict, schema)


def identify(docs: DataFrame, docs_per_lang: int = 1000, windows: int = 6) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang").withColumn("held_out", held_out_rows(4, 2))
    net = train(rows.where("not held_out"), docs_per_lang, windows)
    return tagged(rows.select("doc_id", "held_out", "text"), net).select("doc_id", "held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))


def in_a_language(docs: DataFrame, least: float = 0.3, docs_per_lang: int = 1000, windows: int = 6) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learned language with at least this score."""
    ship(docs.sparkSession)
    net = train(docs.where(~held_out_rows(4, 2)), docs_per_lang, windows)
    pred, score = marks(docs)
    return tagged(docs, net).where((F.col(pred) != "und") & (F.col(score) >= least)).drop(pred, score)
