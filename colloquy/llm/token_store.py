"""Token ids in binary files with access to any token without decoding a block.

Directly addressable codes: an id is cut into chunks, lowest bits first; level l holds
chunk l of every id that has one, a bitmap says whether the id goes on, and a rank
directory (one count for 512 bits) leads to its place on the next level.  A shard file is
a run of segments of at most ``SEGMENT`` ids, then the lengths of its documents.

Edge cases: a null text has only the end id; a null doc_id sorts first and stays null;
repeated rows are all stored; an empty table gives an empty store; other columns are
ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import shared_path, ship, slices, store
from .tokens import encoder, vocabulary

SEGMENT = 1 << 20
RANK_BITS = 512
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"
_COUNTS = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def chunk_widths(ids: np.ndarray) -> list[int]:
    """Widths of 4 or 8 bits, lowest first, with the least total size for these ids."""
    need = np.ones(len(ids), np.int64)
    for bits in range(4, 32, 4):
        need += ids >= np.uint64(1) << np.uint64(bits)
    left = np.array([(need > k).sum() for k in range(9)])  # ids with more than k half bytes
    best: dict[int, tuple[int, list[int]]] = {8: (0, [])}
    for k in range(7, -1, -1):
        best[k] = min(((best[min(8, k + n)][0] + int(left[k]) * (4 * n + 1), [4 * n, *best[min(8, k + n)][1]]) if left[k] else (0, []))
                      for n in (1, 2))
    return best[0][1] or [4]


class Codes:
    """One segment: the encoded ids and access to any of them."""

    def __init__(self, raw: bytes):
        size = int.from_bytes(raw[:4], "little")
        head = json.loads(raw[4:4 + size])
        self.n, self.levels, at = head["n"], [], 4 + size
        for width, n in zip(head["widths"], head["counts"]):
            parts = []
            for length, kind in (((n * width + 7) // 8, np.uint8), ((n + 7) // 8, np.uint8), (4 * (n // RANK_BITS + 1), np.uint32)):
                parts.append(np.frombuffer(raw, kind, length // np.dtype(kind).itemsize, at))
                at += length
            self.levels.append((width, n, *parts))

    @staticmethod
    def encode(ids: np.ndarray) -> bytes:
        ids = ids.astype(np.uint64)
        widths, counts, parts, rest, shift = chunk_widths(ids), [], [], ids, 0
        for width in widths:
            counts.append(len(rest))
            chunk = (rest & np.uint64((1 << width) - 1)).astype(np.uint8)
            if width == 4:
                chunk = np.append(chunk, np.zeros(len(chunk) % 2, np.uint8))
                chunk = chunk[::2] | chunk[1::2] << 4
            rest = rest >> np.uint64(width)
            more = rest > 0
            bitmap = np.packbits(more, bitorder="little")
            padded = np.append(bitmap, np.zeros(-len(bitmap) % (RANK_BITS // 8), np.uint8))
            ranks = np.concatenate([[0], np.cumsum(_COUNTS[padded].reshape(-1, RANK_BITS // 8).sum(1, dtype=np.int64))])
            parts += [chunk.tobytes(), bitmap.tobytes(), ranks[:len(chunk if width == 8 else more) // RANK_BITS + 1].astype("<u4").tobytes()]
            rest, shift = rest[more], shift + width
        head = json.dumps({"n": len(ids), "widths": widths, "counts": counts}).encode()
        return b"".join([len(head).to_bytes(4, "little"), head, *parts])

    def _rank(self, level: int, i: int) -> int:
        """Ids before place ``i`` of ``level`` that go on."""
        _, _, _, bitmap, ranks = self.levels[level]
        block, at = i // RANK_BITS, i // 8
        if block >= len(ranks):
            block = len(ranks) - 1
        count = int(ranks[block]) + int(_COUNTS[bitmap[block * RANK_BITS // 8:at]].sum(dtype=np.int64))
        return count + (int(_COUNTS[int(bitmap[at]) & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop), read level by level; nothing outside the range is touched."""
        out = np.zeros(stop - start, np.uint32)
        places, shift = None, 0
        for level, (width, _, chunks, bitmap, _) in enumerate(self.levels):
            if width == 8:
                chunk = chunks[start:stop]
            else:
                pair = chunks[start // 2:(stop + 1) // 2]
                chunk = np.stack([pair & 15, pair >> 4], 1).ravel()[start % 2:start % 2 + stop - start]
            value = chunk.astype(np.uint32) << np.uint32(shift)
            if places is None:
                out |= value
            else:
                out[places] |= value
            bits = np.unpackbits(bitmap[start // 8:(stop + 7) // 8], bitorder="little")[start % 8:start % 8 + stop - start]
            on = np.flatnonzero(bits)
            if not len(on):
                break
            places = on if places is None else places[on]
            begin = self._rank(level, start)
            start, stop, shift = begin, begin + len(on), shift + width
        return out

    def __getitem__(self, i: int) -> int:
        return int(self.ids(i, i + 1)[0])


class Shard:
    """An opened shard file; segments are read when they are needed, one at a time."""

    def __init__(self, uri: str):
        from pyarrow import fs
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 8)
        length = int.from_bytes(self.file.read(8), "little")
        self.file.seek(size - 8 - length)
        self.footer = json.loads(self.file.read(length))
        self.file.seek(self.footer["documents_at"])
        n = self.footer["documents"]
        self.doc_id = np.frombuffer(self.file.read(8 * n), "<i8")
        self.known = np.frombuffer(self.file.read(n), np.uint8)
        self.n_tokens = np.frombuffer(self.file.read(8 * n), "<i8")
        self._segment: tuple[int, Codes] | None = None

    def segment(self, k: int) -> Codes:
        if self._segment is None or self._segment[0] != k:
            at, size = self.footer["segments"][k]
            self.file.seek(at)
            self._segment = k, Codes(self.file.read(size))
        return self._segment[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        parts = [self.segment(k).ids(max(start - k * SEGMENT, 0), min(stop - k * SEGMENT, SEGMENT)) for k in range(start // SEGMENT, -(-stop // SEGMENT))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_store(docs: DataFrame, path: str, vocab: str, end: int = 2) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; returns one row per shard file.

    The rows are range-partitioned by doc_id, each task writes one file under a name of
    its attempt and moves it in place when it is whole, so a task that runs again does no harm.
    """
    ship(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        task = TaskContext.get()
        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        name, begun = f"{root}/part-{task.partitionId():06d}.dac", f"{root}/.{task.partitionId()}-{task.taskAttemptId()}"
        wait, held, segments, at, total = [], 0, [], 0, 0
        doc_ids, known, lengths = [], [], []
        with files.open_output_stream(begun) as out:
            def flush(all_of_it: bool) -> None:
                nonlocal wait, held, at
                ids = np.concatenate(wait) if wait else np.zeros(0, np.uint32)
                while len(ids) >= SEGMENT or all_of_it and len(ids):
                    raw = Codes.encode(ids[:SEGMENT])
                    out.write(raw)
                    segments.append((at, len(raw)))
                    at, ids = at + len(raw), ids[SEGMENT:]
                wait, held = [ids], len(ids)

            for batch in slices(batches, most=4 << 20, encoding=True):
                ids, offsets = encoder(vocab).encode(batch.column("text"), end)
                column = batch.column("doc_id")
                doc_ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
                known.append(column.is_valid().to_numpy(zero_copy_only=False))
                lengths.append(np.diff(offsets))
                wait.append(ids)
                held, total = held + len(ids), total + len(ids)
                if held >= SEGMENT:
                    flush(False)
            flush(True)
            n = sum(map(len, lengths))
            for parts, kind in ((doc_ids, "<i8"), (known, np.uint8), (lengths, "<i8")):
                out.write(np.concatenate([np.zeros(0, kind), *parts]).astype(kind).tobytes())
            footer = json.dumps({"segments": segments, "documents": n, "documents_at": at, "tokens": total}).encode()
            out.write(footer + len(footer).to_bytes(8, "little"))
        if not n:
            files.delete_file(begun)
            return
        files.move(begun, name)
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "file": [f"{path}/{name.rpartition('/')[2]}"], "documents": [n], "tokens": [total]})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return store(ordered.mapInArrow(write, "shard long, file string, documents long, tokens long"), "shards")


def read_store(shards: DataFrame) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"])
                ends = np.cumsum(shard.n_tokens)
                starts = ends - shard.n_tokens
                crc = [zlib.crc32(shard.ids(a, b).astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.doc_id, mask=shard.known == 0), pa.array(starts + row["first"]), pa.array(shard.n_tokens), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.withColumn("first", F.coalesce(before, F.lit(0)))
    tasks = max(1, shards.sparkSession.sparkContext.defaultParallelism, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(tasks, "shard").mapInArrow(read, DOCUMENTS)


def token_store(spark: SparkSession, docs: DataFrame, vocab: str | None = None, end: int = 2, path: str | None = None) -> DataFrame:
    """Write the store in the shared folder (or ``path``) and read it back."""
    return read_store(write_store(docs, path or shared_path(spark, "tokens"), vocab or vocabulary(), end))
