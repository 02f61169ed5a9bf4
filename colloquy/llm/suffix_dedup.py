"""Removal of every byte covered by a 200-byte string that occurs more than once.

Every string of ``length`` bytes has one anchor: its ``length // 2``-byte substring of
least hash, the leftmost of equals, so equal strings have equal anchors at equal places.
Only suffixes at anchors are indexed, about two for ``length // 2`` bytes, and no match
is missed.

* The index is a family of levels, tables of (key, least and greatest occurrence) sorted
  by key.  A new batch gets its own table, is merge-scanned against the levels for keys
  that occur elsewhere, and becomes a level; levels of one size are merged into one of
  the double size.
* Strings whose anchor repeats are decided in blocks of 16 with one anchor: the bytes
  common to a block must repeat for any of its strings to do, the bytes of all its strings
  suffice for all.  Only what neither settles is hashed string by string.
* "Occurs elsewhere" is always least occurrence <> greatest occurrence, an aggregate
  computed before the shuffle, so a passage may stand in any number of documents.

Edge cases: a null text is empty; texts under ``length`` bytes keep everything; rows with
equal texts lose everything (each other's strings), equal rows too; null doc_ids are
kept; overlapping occurrences in one text count; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import drop, prefix_sums, ship, slices, span_hashes, store, text_bytes, window_argmins

BLOCK = 16
_SLICE = 1 << 20


class Anchors:
    """Strings of ``length`` bytes of a batch of texts and their anchors, as places in the joined bytes."""

    def __init__(self, texts: pa.Array, length: int):
        self.length, self.gram = length, length // 2
        self.data, self.offsets = text_bytes(texts)
        self.sums, self.inverse = prefix_sums(self.data)
        last = len(self.data) - self.gram + 1
        grams = np.arange(max(last, 0))
        self.keys = span_hashes(self.sums, self.inverse, grams, grams + self.gram)
        rows = np.repeat(np.arange(len(self.offsets) - 1), np.maximum(np.diff(self.offsets) - length + 1, 0))
        before = np.cumsum(np.maximum(np.diff(self.offsets) - length + 1, 0))
        self.strings = np.arange(len(rows)) - np.repeat(before - np.maximum(np.diff(self.offsets) - length + 1, 0), np.maximum(np.diff(self.offsets) - length + 1, 0)) + self.offsets[rows]
        self.rows = rows
        self.anchors = window_argmins(self.keys, length - self.gram + 1)[self.strings] if len(rows) else self.strings

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return span_hashes(self.sums, self.inverse, starts, ends).view(np.int64)

    def blocks(self, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Blocks of the strings where ``kept``: row, anchor and number of each block; their strings follow each other."""
        number = (self.anchors - self.strings) // BLOCK
        key = self.anchors * 64 + 63 - number  # ascending with the strings
        places = np.flatnonzero(kept)
        first = places[np.flatnonzero(np.diff(key[places], prepend=-1))] if len(places) else places
        return self.rows[first], self.anchors[first], number[first]


def _occurrence() -> Column:
    return F.xxhash64("text_key", "place")


def _block_occurrence() -> Column:
    """Where the bytes of a block begin: blocks of two anchors may be the same bytes of one text."""
    return F.xxhash64("text_key", F.shiftright("place", 6) - BLOCK * F.col("place").bitwiseAND(63))


def suffixes(docs: DataFrame, length: int) -> DataFrame:
    """key, text_key, place of every indexed suffix."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=_SLICE):
            found = Anchors(batch.column("text"), length)
            new = np.flatnonzero(np.diff(found.anchors, prepend=-1) | np.diff(found.rows, prepend=-1))
            at, rows = found.anchors[new], found.rows[new]
            yield pa.RecordBatch.from_arrays([pa.array(found.keys[at].view(np.int64)), batch.column("text_key").take(pa.array(rows)),
                                              pa.array((at - found.offsets[rows]))], ["key", "text_key", "place"])

    return docs.select("text_key", "text").mapInArrow(index, "key long, text_key long, place long")


class SuffixIndex:
    """The family of levels; ``add`` takes suffixes (key, text_key, place) and returns the keys that now repeat through them."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, store(a.unionByName(b).groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).sortWithinPartitions("key"), "level")))
            drop(a)
            drop(b)
        new = store(batch.groupBy("key").agg(F.min(_occurrence()).alias("lo"), F.max(_occurrence()).alias("hi")).sortWithinPartitions("key"), "level")
        repeated = new.where("lo <> hi").select("key")
        for _, level in self.levels:
            old = level.select("key", F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"))
            repeated = repeated.unionByName(new.join(old, "key").where("lo <> old_lo or hi <> old_hi").select("key"))
        self.levels.append((0, new))
        return repeated.distinct()


def _core_blocks(texts: DataFrame, length: int) -> DataFrame:
    """Blocks of strings with repeated anchors: core, super (null where it leaves the text), text_key, place = anchor * 64 + block."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=_SLICE):
            found = Anchors(batch.column("text"), length)
            rows, anchors, number = found.blocks(_flagged(found, batch.column("places")))
            first = anchors - BLOCK * number
            core = found.hashes(first, first - BLOCK + 1 + length)
            whole = (first - BLOCK + 1 >= found.offsets[rows]) & (first + length <= found.offsets[rows + 1])
            super_ = np.zeros(len(rows), np.int64)
            super_[whole] = found.hashes(first[whole] - BLOCK + 1, first[whole] + length)
            yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(super_, mask=~whole), batch.column("text_key").take(pa.array(rows)),
                                              pa.array((anchors - found.offsets[rows]) * 64 + number)], ["core", "super", "text_key", "place"])

    return texts.mapInArrow(make, "core long, super long, text_key long, place long")


def _flagged(found: Anchors, places: pa.ListArray) -> np.ndarray:
    """Strings whose anchor is among the places of their text."""
    flag = np.zeros(len(found.data) + 1, bool)
    bounds = places.offsets.to_numpy()
    own = places.values.to_numpy()[bounds[0]:bounds[-1]] + np.repeat(found.offsets[:-1], np.diff(bounds))
    flag[own] = True
    return flag[found.anchors]


def _states(found: Anchors, codes: pa.ListArray) -> np.ndarray:
    """For each string the state of its block: 0 not repeated, 1 repeated, 2 to be hashed, 3 both."""
    bounds = codes.offsets.to_numpy()
    own = codes.values.to_numpy()[bounds[0]:bounds[-1]]
    base = np.repeat(found.offsets[:-1], np.diff(bounds)) * 64
    known, state = (own >> 2) + base, (own & 3).astype(np.int8)
    order = np.argsort(known)
    known, state = np.append(known[order], np.iinfo(np.int64).max), np.append(state[order], 0)
    mine = found.anchors * 64 + (found.anchors - found.strings) // BLOCK
    at = np.searchsorted(known, mine)
    return np.where(known[at] == mine, state[at], 0)


def _strings(texts: DataFrame, length: int) -> DataFrame:
    """hash, text_key, place of the strings that are decided one by one."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=_SLICE):
            found = Anchors(batch.column("text"), length)
            some = np.flatnonzero(_states(found, batch.column("codes")) & 2)
            rows, strings = found.rows[some], found.strings[some]
            yield pa.RecordBatch.from_arrays([pa.array(found.hashes(strings, strings + length)), batch.column("text_key").take(pa.array(rows)),
                                              pa.array(strings - found.offsets[rows])], ["hash", "text_key", "place"])

    return texts.mapInArrow(make, "hash long, text_key long, place long")


def _removed(texts: DataFrame, length: int) -> DataFrame:
    """text_key and what is left of each text: spans removed (starts, ends), n_removed, n_spans, kept_sha256."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=_SLICE):
            found = Anchors(batch.column("text"), length)
            hit = (_states(found, batch.column("codes")) & 1).astype(bool)
            hit |= _flagged_strings(found, batch.column("places"))
            marks = np.zeros(len(found.data) + 1, np.int32)
            np.add.at(marks, found.strings[hit], 1)
            np.add.at(marks, found.strings[hit] + length, -1)
            gone = np.cumsum(marks[:-1]) > 0
            keys, out = batch.column("text_key").to_pylist(), []
            for i, (a, b) in enumerate(zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist())):
                own = gone[a:b]
                edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                out.append((keys[i], edges[::2].tolist(), edges[1::2].tolist(), int(own.sum()), len(edges) // 2,
                            hashlib.sha256(found.data[a:b][~own].tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()))],
                                             ["text_key", "starts", "ends", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(make, "text_key long, starts array<long>, ends array<long>, n_removed long, n_spans long, kept_sha256 string")


def _flagged_strings(found: Anchors, places: pa.ListArray) -> np.ndarray:
    flag = np.zeros(len(found.data) + 1, bool)
    bounds = places.offsets.to_numpy()
    flag[places.values.to_numpy()[bounds[0]:bounds[-1]] + np.repeat(found.offsets[:-1], np.diff(bounds))] = True
    return flag[found.strings]


def _repeated(facts: DataFrame, key: str, occurrence: Column) -> DataFrame:
    """Keys with more than one occurrence, and the least one."""
    return facts.groupBy(key).agg(F.min(occurrence).alias("lo"), F.max(occurrence).alias("hi")).where("lo <> hi")


def remove_repeats(docs: DataFrame, length: int = 200, batches: int = 3) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (the removed byte spans; null: the whole text).

    Of three batches the first two are merged into one level, which the third is scanned against.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    known = store(texts.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    classes = known.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))

    entries = store(suffixes(texts, length), "suffixes")
    index, repeated = SuffixIndex(), None
    for i in range(batches):
        found = store(index.add(entries.where(F.pmod("text_key", F.lit(batches)) == i)), "repeated")
        repeated = found if repeated is None else repeated.unionByName(found)
    places = entries.join(repeated.distinct(), "key", "left_semi").groupBy("text_key").agg(F.collect_set("place").alias("places"))  # of one text
    wanted = places.join(classes.select("text_key", "first"), "text_key")
    some = store(texts.join(wanted, "text_key").where("doc_id <=> first").select("text_key", "text", "places"), "candidates")
    drop(entries)
    for _, level in index.levels:
        drop(level)

    blocks = store(_core_blocks(some, length), "blocks")
    cores = blocks.groupBy("core").agg(F.min(_block_occurrence()).alias("lo"), F.max(_block_occurrence()).alias("hi"), F.min("super").alias("s0"), F.max("super").alias("s1"),
                                       (F.count("super") < F.count("*")).alias("open")).where("lo <> hi")
    cores = cores.select("core", (F.col("open") | (F.col("s0") != F.col("s1"))).alias("mixed"))
    cored = store(blocks.join(cores, "core").select("text_key", "place", "super", "mixed"), "cored")
    mixed = cored.where("mixed")
    state = F.when(F.col("lo").isNull(), 2).when(F.col("lo") == _block_occurrence(), 3).otherwise(1)
    settled = mixed.join(_repeated(mixed.where("super is not null"), "super", _block_occurrence()), "super", "left").select("text_key", (F.col("place") * 4 + state).alias("code"))
    codes = settled.unionByName(cored.where("not mixed").select("text_key", (F.col("place") * 4 + 1).alias("code"))).groupBy("text_key").agg(F.collect_set("code").alias("codes"))
    coded = store(some.select("text_key", "text").join(codes, "text_key"), "coded")
    for used in (some, blocks, cored):
        drop(used)

    strings = store(_strings(coded, length), "strings")
    again = strings.join(_repeated(strings, "hash", _occurrence()).select("hash"), "hash", "left_semi").groupBy("text_key").agg(F.collect_set("place").alias("places"))
    cut = store(_removed(coded.join(again, "text_key", "left").withColumn("places", F.coalesce("places", F.array().cast("array<long>"))), length), "removed")
    for used in (coded, strings):
        drop(used)

    rows = known.join(classes.select("text_key", "copies"), "text_key").join(cut.dropDuplicates(["text_key"]), "text_key", "left")
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return rows.select(
        "doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *[F.when(~all_gone, F.coalesce(c, F.array().cast("array<long>"))).alias(c) for c in ("starts", "ends")])
