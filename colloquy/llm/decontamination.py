"""Benchmark items found in documents, also paraphrased, by latent semantic retrieval.

1. Every text becomes the sequence of its benchmark words (other words as -1), once.
2. Word frequencies are counted over all texts.
3. Passages are overlapping windows of 24 words.  An item is found only where the text around
   a passage holds a least part of the item's words, and so some of its rarer words; passages
   whose surroundings have too few of those of every item need no projection.
4. The others, with the items themselves, are the rows of a TF-IDF matrix whose leading
   right singular vectors come from one distributed pass of a randomised
   (Nystrom) decomposition; only fixed-size sums leave the tasks.
5. Items that share enough rarer words and whose latent cosine with a passage reaches the threshold are compared with the
   text around it: the longest common subsequence must hold most of the item, or a good
   part of it with most of the item's answer (its ``answer`` column, or its last quarter).

The items are the query set; they are taken in blocks of at most ``ITEMS``, and all texts
meet all blocks.

Edge cases: null or empty texts and items match nothing; texts or items of a few words are
one passage; repeated items are one; of items held alike the
smaller item_id is given, at its first place; repeated rows get equal results; rows with a null
doc_id take part; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Words, drop, free, ship, slices, store

PASSAGE, STRIDE = 24, 12
RANK = 128
ITEMS = 512
#: Least cosine with an item in the latent space.
COSINE = 0.4
#: Parts of an item in its longest common subsequence with a text: enough alone, or with the answer.
SURE, LIKELY, ANSWER = 0.75, 0.5, 0.6
#: Part of the words of a match that must be among the rarer words of the item, and passages taken at a time.
SHARED, MANY = 0.35, 8192
#: Passages that are multiplied as one dense matrix over the words they hold.
DENSE = 128
_GROUPS = 8
FOUND = "doc_id long, text_key long, item_id long, cosine double, lcs double, place long"


@dataclass
class Items:
    """A block of the benchmark as sequences of word numbers; ``terms`` are the sorted word hashes."""

    ids: list[int]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray

    @staticmethod
    def of(rows: list[tuple[int, str, str | None]]) -> Items:
        words, answers = Words(pa.array([r[1] for r in rows], pa.string()), plain=True), Words(pa.array([r[2] for r in rows], pa.string()), plain=True)
        terms = np.unique(np.concatenate([words.hashes, answers.hashes]))
        part = lambda w, i: np.searchsorted(terms, w.hashes[w.first[i]:w.first[i + 1]])
        own = [part(words, i) for i in range(len(rows))]
        tails = [part(answers, i) if rows[i][2] else own[i][-max(1, len(own[i]) // 4):] for i in range(len(rows))]
        full = [i for i, w in enumerate(own) if len(w)]
        return Items([rows[i][0] for i in full], [own[i] for i in full], [tails[i] for i in full], terms)


def coded(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, text_key and the word numbers of each text, -1 for words of no item."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"), plain=True)
            at = np.minimum(np.searchsorted(items.terms, words.hashes), len(items.terms) - 1)
            number = np.where(items.terms[at] == words.hashes, at, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"),
                                              pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(number))], ["doc_id", "text_key", "words"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(code, "doc_id long, text_key long, words array<int>")


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[bounds[0]:bounds[-1]], bounds - bounds[0]


def weights(codes: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """Inverse frequencies of the benchmark words over all texts, and that of any other word."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("words"))[0] + 1, minlength=size + 1)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "n"])

    counts = np.zeros(size + 1)
    for r in codes.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # at most one row a benchmark word
        counts[r["term"]] = r["n"]
    idf = np.log1p(max(counts.sum(), 1) / (counts[1:] + 1))
    return np.append(idf, 0.0), float(idf.max(initial=1.0))


@dataclass
class Bound:
    """What the text around a passage must share with an item before the two are compared; no match is lost by it.

    A match of ``least`` words holds that many of the item's words, repeats counted.  With the
    item's words in order of rarity, all but the last ``least - shared`` of them hold at least
    ``shared`` of these, so only occurrences of those rarer words are looked at.
    """

    first: np.ndarray   # for each word, where its items begin in ``item``; one more for words of no item
    item: np.ndarray
    about: np.ndarray   # for each item, the words on either side of a passage that it is compared with
    shared: np.ndarray

    @staticmethod
    def of(items: Items, idf: np.ndarray) -> Bound:
        terms, about, shared = [], [], []
        for words in items.words:
            least = math.ceil(LIKELY * len(words))
            about.append(len(words) // 2)
            shared.append(max(1, round(SHARED * least)))
            rarest = words[np.argsort(-idf[words], kind="stable")]
            terms.append(np.unique(rarest[:len(words) - least + shared[-1]]))
        term, item = np.concatenate(terms), np.repeat(np.arange(len(terms)), [len(t) for t in terms])
        order = np.argsort(term, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(items.terms) + 1))])
        return Bound(first, item[order], np.array(about), np.array(shared))

    def near(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows and starts of passages, and the (passage, item) pairs that may match, for some thousand passages at a time."""
        made = _made(bounds)
        windows = np.concatenate([[0], np.cumsum(made)])
        start_of = lambda g, row: bounds[row] + STRIDE * (g - windows[row])
        reach, kinds = int(self.about.max()) + PASSAGE, len(self.about)
        for a in range(0, int(windows[-1]), MANY):
            b = min(a + MANY, int(windows[-1]))
            ends = np.searchsorted(windows, [a, b - 1], side="right") - 1
            low, high = start_of(np.array([a, b - 1]), ends) + np.array([-reach, reach])
            low, high = max(int(low), 0), min(int(high), len(words))
            at = low + np.flatnonzero(self.first[words[low:high] + 1] > self.first[words[low:high]]) if high > low else np.zeros(0, np.int64)
            term = words[at]
            at, item = _spread(self.first[term], self.first[term + 1] - self.first[term], at)
            item, row = self.item[item], np.searchsorted(bounds, at, side="right") - 1
            place, about = at - bounds[row], self.about[item]
            least = windows[row] + np.maximum(-(-(place - PASSAGE - about + 1) // STRIDE), 0)
            most = windows[row] + np.minimum((place + about) // STRIDE, made[row] - 1)
            least, most = np.maximum(least, a), np.minimum(most, b - 1)
            item, passage = _spread(least, np.maximum(most - least + 1, 0), item)
            key, count = np.unique(passage * kinds + item, return_counts=True)
            key = key[count >= self.shared[key % kinds]]
            passage, pair = np.unique(key // kinds, return_inverse=True)
            row = np.searchsorted(windows, passage, side="right") - 1
            yield row, start_of(passage, row), pair, key % kinds


def _spread(first: np.ndarray, n: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` repeated n times each, and the numbers first, first + 1, ... beside them."""
    return np.repeat(values, n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _made(bounds: np.ndarray) -> np.ndarray:
    """The number of passages of each text."""
    counts = np.diff(bounds)
    return np.where(counts > 0, 1 + np.maximum(-(-(counts - PASSAGE) // STRIDE), 0), 0)


class Lengths:
    """Full TF-IDF lengths of passages, from running sums over a batch."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, idf: np.ndarray, other: float):
        self.bounds = bounds
        self.squares = np.concatenate([[0], np.cumsum(np.where(words >= 0, idf[words] ** 2, other ** 2))])

    def of(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.sqrt(self.squares[np.minimum(starts + PASSAGE, self.bounds[rows + 1])] - self.squares[starts])


def _window(words: np.ndarray, bounds: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Word numbers of passages (n, PASSAGE), -1 beyond the text."""
    at = starts[:, None] + np.arange(PASSAGE)
    return np.where(at < bounds[rows + 1][:, None], np.append(words, -1)[np.minimum(at, len(words))], -1)


def _project(terms: np.ndarray, scale: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The weighted sums of the words' rows of ``basis``, one a passage."""
    y = np.zeros((len(terms), basis.shape[1]), np.float32)
    for j in range(terms.shape[1]):
        y += scale[:, j, None] * basis[terms[:, j]]
    return y


def _sketch(codes: DataFrame, items: Items, idf: np.ndarray, other: float) -> np.ndarray:
    """The leading right singular vectors (word, RANK) of the passages and items."""
    size, bound = len(items.terms), Bound.of(items, idf)
    omega = np.vstack([np.random.default_rng(9).standard_normal((size, RANK)), np.zeros(RANK)]).astype(np.float32)

    def product(terms: np.ndarray, norms: np.ndarray, total: np.ndarray) -> None:
        scale = (idf[terms] / norms[:, None]).astype(np.float32)
        y = _project(terms, scale, omega)
        for a in range(0, len(terms), DENSE):
            part, own = terms[a:a + DENSE], scale[a:a + DENSE]
            kinds, column = np.unique(part, return_inverse=True)
            cell = np.arange(len(part))[:, None] * len(kinds) + column.reshape(part.shape)
            matrix = np.bincount(cell.ravel(), weights=own.ravel(), minlength=len(part) * len(kinds)).astype(np.float32)
            total[kinds] += matrix.reshape(len(part), len(kinds)).T @ y[a:a + DENSE]

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size + 1, RANK)), 0
        for batch in batches:
            words, bounds = _flat(batch.column("words"))
            lengths = Lengths(words, bounds, idf, other)
            for rows, starts, _, _ in bound.near(words, bounds):
                product(_window(words, bounds, rows, starts), lengths.of(rows, starts), total)
                seen += len(rows)
        if seen:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % _GROUPS], pa.int64()), "n": pa.array([seen], pa.int64()),
                                              "sums": [total[:-1].astype(np.float32).tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(size * RANK), 0
        for batch in batches:
            n += sum(batch.column("n").to_pylist())
            for raw in batch.column("sums"):
                total += np.frombuffer(raw.as_buffer(), np.float32)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": [total.astype(np.float32).tobytes()]})

    parts = codes.select("words").mapInArrow(accumulate, "part long, n long, sums binary").repartition(_GROUPS, "part").mapInArrow(add, "n long, sums binary").collect()  # _GROUPS rows of fixed size
    y = sum((np.frombuffer(bytes(r["sums"]), np.float32).astype(float) for r in parts), np.zeros(size * RANK)).reshape(size, RANK)
    # The items count as much as all passages together, so that their directions are among the leading ones.
    weight = max(1, sum(r["n"] for r in parts)) / len(items.words)
    for words in items.words:
        row = np.bincount(words, minlength=size) * idf[:-1]
        row /= np.linalg.norm(row) + 1e-12
        y += weight * np.outer(row, row @ omega[:-1])
    shift = 1e-7 * np.linalg.norm(y)
    y += shift * omega[:-1]
    core = omega[:-1].T.astype(float) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-12 * values.max(initial=1.0)))
    u, s, _ = np.linalg.svd(y @ root, full_matrices=False)
    return u[:, s > 1e-9 * s.max(initial=1.0)].astype(np.float32)


def lcs(item: np.ndarray, masks: dict[int, int], text: np.ndarray) -> int:
    """Places of ``item`` (as bits) that are in one longest common subsequence with ``text``."""
    full = (1 << len(item)) - 1
    row = full
    for word in text.tolist():
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return full & ~row


def found_in(docs: DataFrame, items: Items) -> DataFrame:
    """The best item found in each text (doc_id, text_key, text) that holds one: FOUND."""
    codes = store(coded(docs, items), "codes")
    idf, other = weights(codes, len(items.terms))
    basis, bound = _sketch(codes, items, idf, other), Bound.of(items, idf)
    basis = np.vstack([basis, np.zeros((1, basis.shape[1]), np.float32)])
    latent = np.stack([(idf[w][:, None] * basis[w]).sum(0) for w in items.words])
    latent = (latent / (np.linalg.norm(latent, axis=1, keepdims=True) + 1e-12)).astype(np.float32)
    masks = []
    for w in items.words:
        mask: dict[int, int] = {}
        for i, word in enumerate(w.tolist()):
            mask[word] = mask.get(word, 0) | 1 << i
        masks.append(mask)

    def check(words: np.ndarray, bounds: np.ndarray, row: int, start: int, k: int) -> float:
        item, answer = items.words[k], items.answers[k]
        about = len(item) // 2
        text = words[max(bounds[row], start - about):min(bounds[row + 1], start + PASSAGE + about)]
        share = lcs(item, masks[k], text).bit_count() / len(item)
        if share >= SURE:
            return share
        if share >= LIKELY:
            there = np.isin(answer, text).mean()
            if there >= ANSWER and idf[answer[np.isin(answer, text)]].max(initial=0) > np.median(idf[item]):
                return share
        return 0.0

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = _flat(batch.column("words"))
            best: dict[int, tuple] = {}
            for rows, starts, passage, item in bound.near(words, bounds):
                terms = _window(words, bounds, rows, starts)
                y = _project(terms, idf[terms].astype(np.float32), basis)
                y /= np.linalg.norm(y, axis=1, keepdims=True) + 1e-12
                for a in range(0, len(passage), MANY):
                    p, k = passage[a:a + MANY], item[a:a + MANY]
                    cosine = np.einsum("nr,nr->n", y[p], latent[k])
                    for i in np.flatnonzero(cosine >= COSINE).tolist():
                        row, start, one = int(rows[p[i]]), int(starts[p[i]]), items.ids[k[i]]
                        if row in best and best[row][:2] >= (1.0, -one):
                            continue
                        share = check(words, bounds, row, start, int(k[i]))
                        place = start - int(bounds[row])
                        if share and (share, -one, -place) > best.get(row, (0.0, 0, 0))[:3]:
                            best[row] = (share, -one, -place, float(cosine[i]))
            if best:
                at = sorted(best)
                columns = zip(*((-one, cosine, share, -place) for share, one, place, cosine in (best[i] for i in at)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), batch.column("text_key").take(pa.array(at)),
                                                  *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64(), pa.int64())))],
                                                 ["doc_id", "text_key", "item_id", "cosine", "lcs", "place"])

    return codes.mapInArrow(search, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """FOUND: each document that holds a benchmark item, with the item held most completely.

    ``text_key`` (a hash of the text) leads back to the rows: being contaminated depends on the text alone.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).where("text is not null")
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    unique = benchmark.where("text is not null").groupBy("text").agg(F.min(F.col("item_id").cast("long")).alias("item_id"), F.min(answer).alias("answer"))
    dealt = store(unique, "items")
    blocks = max(1, -(-dealt.count() // ITEMS))
    found = None
    for block in range(blocks):
        rows = dealt.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()  # about ITEMS rows
        items = Items.of(sorted(((r["item_id"] if r["item_id"] is not None else -1, r["text"], r["answer"]) for r in rows), key=lambda r: r[:2]))
        if items.words:
            part = found_in(texts, items)
            found = part if found is None else found.unionByName(part)
    drop(dealt)
    if found is None:
        return spark.createDataFrame([], FOUND)
    if blocks == 1:
        return found
    best = F.max_by(F.struct("item_id", "cosine", "lcs", "place"), F.struct("lcs", -F.col("item_id"))).alias("best")
    return found.groupBy("doc_id", "text_key").agg(best).select("doc_id", "text_key", "best.*")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item."""
    found = free(docs, "_found")
    keys = store(contaminated(docs, benchmark).select(F.col("text_key").alias(found)).distinct(), "found")
    return docs.join(keys, F.xxhash64(docs["text"]) == F.col(found), "left_anti")
