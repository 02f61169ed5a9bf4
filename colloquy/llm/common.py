"""Helpers shared by the corpus operators: stored stages, Arrow batches, vectorised hashing."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from colloquy.session import ensure_checkpoint_dir

_STORED: list[str] = []


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; it is deleted by :func:`drop_stored`."""
    ensure_checkpoint_dir(spark)
    ship(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"
    _STORED.append(path)
    return path


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once, as ``--py-files`` would, and keep the batches of texts they get small."""
    import shutil
    import tempfile
    from pathlib import Path
    context = spark.sparkContext
    if getattr(context, "_colloquy_shipped", False):
        return
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root = Path(__file__).resolve().parents[2]
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/colloquy", "zip", root, "colloquy")
    context.addPyFile(archive)
    context._colloquy_shipped = True


def store(df: DataFrame, what: str = "stage") -> DataFrame:
    """Write ``df`` in the shared folder and continue from there, so that lost executors cost only their own tasks."""
    path = shared_path(df.sparkSession, what)
    _free_shuffles(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of earlier stages now; it does so when the driver collects garbage.

    The scheduler holds on to its last job, so that one is made a small one first.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`store` that no later plan reads."""
    delete(df.sparkSession, df._stored_at)


def drop_stored(spark: SparkSession) -> None:
    """Delete every stage stored so far; call it only when the results made from them have been written."""
    while _STORED:
        delete(spark, _STORED[-1])


def stored_paths() -> set[str]:
    return set(_STORED)


def delete(spark: SparkSession, path: str) -> None:
    """Delete one path made by :func:`shared_path`."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    if path in _STORED:
        _STORED.remove(path)


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what earlier tasks of this Python worker left: encoded pieces, Arrow buffers and freed heap."""
    if tokens := sys.modules.get("colloquy.llm.tokens"):
        tokens.encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20, encoding: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of at most ``most`` text bytes (always one row at least)."""
    if not encoding:
        give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_lengths(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and the n+1 offsets of the texts in it; null is empty."""
    lengths = text_lengths(column)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    wide = pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null("")
    _, where, data = column.buffers()
    bounds = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(bounds):
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], offsets


#: An odd multiplier, so that powers can be inverted modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """The first n powers of ``base``; the longest table made so far is kept in the worker."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _POWERS[int(base)] = known
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``(byte + 1) * base**position`` before each position, and the powers of the inverse base."""
    sums = np.zeros(len(data) + 1, np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(len(data))
    np.cumsum(terms, out=sums[1:])
    return sums, powers(len(data) + 1, _INVERSE)


def span_hashes(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), equal for equal bytes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * inverse[starts])


#: Positions of a word whose values of all bytes are kept in a table.
_PLACES = 64
_VALUES = mix((np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(1)) * _BASE)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end), which do not overlap: the sum of one value for each byte at each place in its span.

    The values of different places have nothing to do with each other, so no pattern of
    repeated letters makes differences cancel out, as it does with powers of one base.
    """
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint64)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths)
    code = place * 256 + data[place + np.repeat(starts, lengths)]
    far = code >= _PLACES * 256
    if far.any():
        values = _VALUES[np.where(far, 0, code)]
        values[far] = mix((code[far].astype(np.uint64) + np.uint64(1)) * _BASE)
    else:
        values = _VALUES[code]
    return mix(np.add.reduceat(values, bounds[:-1]))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts: spans in the joined bytes, A-Z lower-cased, and their hashes.

    ``first`` has n+1 entries: text i has the words first[i] to first[i + 1].  With
    ``plain`` ASCII signs part words like white space, and Latin-1 letters are lower-cased too.
    """

    def __init__(self, column: pa.Array, plain: bool = False):
        data, self.offsets = text_bytes(column)
        self.raw = data
        data = _LOWER[data]
        word = ~_SPACE[data]
        if plain:
            word &= ~_SIGN[data]
            high = np.flatnonzero(data[:-1] == 0xC3) + 1
            high = high[(data[high] >= 0x80) & (data[high] <= 0x9E) & (data[high] != 0x97)]
            data[high] += 0x20
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        inner = self.offsets[:-1][(np.diff(self.offsets) > 0)]
        begins[inner] = word[inner]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        last = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        ends[last] = word[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = word_hashes(data, self.starts, self.ends)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the word shingles of every text, in order, and their n+1 offsets.

        A text with fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
        """
        counts = np.diff(self.first)
        made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        offsets = np.concatenate([[0], np.cumsum(made)])
        place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], made) + np.repeat(self.first[:-1], made)
        end = np.repeat(self.first[1:], made)
        out = np.repeat(np.minimum(counts, width), made).astype(np.uint64)
        for k in range(width):
            at = place + k
            inside = at < end
            if inside.all():
                out = out * _BASE + self.hashes[at]
            else:
                out[inside] = out[inside] * _BASE + self.hashes[at[inside]]
        return mix(out), offsets


def window_argmins(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values, the position of its least value, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(1, int(len(values) - 1).bit_length()))
    least = ((values >> bits) << bits) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:n], least[width - span:width - span + n])
    return (least[:n] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def binary_list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A list column of longs from joined values and n+1 offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64)))
