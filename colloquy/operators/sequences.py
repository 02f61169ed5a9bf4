"""Order-dependent operators over timestamped rows: progress, pauses, levels, stages, numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..session import cut
from .blocks import block_scan, index_block, row_index


def day_block(ts: str) -> Column:
    """Order-preserving block for timestamped rows."""
    return F.unix_date(F.to_date(F.col(ts))).cast("long")


def carry_forward_progress(events: DataFrame, key: str = "meeting_id", ts: str = "event_time", tie: str = "event_id") -> DataFrame:
    """A null progress keeps the previous value while the status stays the same."""
    tagged = block_scan(events, [key], day_block(ts), [ts, tie],
                        lags={"__prev": F.col("status")})
    changed = ~F.col("__prev").eqNullSafe(F.col("status"))
    mark = F.when(changed | F.col("progress").isNotNull(), F.struct(F.col("progress").alias("p")))
    carried = block_scan(tagged, [key], day_block(ts), [ts, tie], lasts={"__carried": mark})
    return carried.withColumn("progress", F.col("__carried.p")).drop("__prev", "__carried")


# Allowed moves between processing stages.
STAGE_MOVES = {
    "queued": ["transcribing", "error"], "transcribing": ["structuring", "error"],
    "structuring": ["done", "error"], "done": [], "error": [],
}


def stage_transitions(events: DataFrame, key: str = "meeting_id", ts: str = "event_time", tie: str = "event_id") -> DataFrame:
    """Previous status, seconds spent in it and whether the move is allowed; repeats are not moves."""
    prev = block_scan(events, [key], day_block(ts), [ts, tie],
                      lags={"__p": F.struct(F.col("status").alias("s"), F.col(ts).alias("t"))})
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("__p.t").cast("timestamp"))) / 1e6
    moves = F.create_map(*[x for a, bs in STAGE_MOVES.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in bs]).cast("array<string>"))])
    allowed = F.when(F.col("__p").isNull(), F.col("status") == "queued").otherwise(
        (F.col("__p.s") == F.col("status")) | F.array_contains(moves[F.col("__p.s")], F.col("status")))
    return (prev.withColumn("previous_status", F.col("__p.s")).withColumn("seconds_in_previous", seconds)
            .withColumn("allowed", F.coalesce(allowed, F.lit(False))).drop("__p"))


def pause_sections(df: DataFrame, key: str, ts: str, tie: str, gap_s: float, out: str = "section") -> DataFrame:
    """Number runs of rows separated by at least ``gap_s`` seconds."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    lagged = block_scan(df, [key], day_block(ts), [ts, tie], lags={"__prev": micros})
    starts = (F.col("__prev").isNull() | (micros - F.col("__prev") >= int(gap_s * 1e6))).cast("int")
    return block_scan(lagged.withColumn("__start", starts), [key], day_block(ts), [ts, tie],
                      sums={out: F.col("__start").cast("long")}).drop("__prev", "__start")


def pause_chunks(df: DataFrame, key: str, ts: str, tie: str, gap_s: float = V.PAUSE_SECONDS,
                 min_len_s: float = V.CHUNK_MIN_SECONDS, max_len_s: float = V.CHUNK_MAX_SECONDS) -> DataFrame:
    """Cut each key's rows into chunks; adds ``chunk_start`` (micros of the chunk's first row).

    A row opens a chunk when it follows a pause of ``gap_s`` and the open chunk is at
    least ``min_len_s`` long, or when the open chunk would reach ``max_len_s``.

    Where the next chunk starts depends only on where this one started, so every
    row first learns its successor (the row that would open the next chunk) from
    two reverse scans.  The real chunk starts are the rows reachable from the first
    row of the key; they are found by doubling the step length, which takes
    log2(chunks) joins and never gathers a key into one task.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.select(key, ts, tie).withColumn("t", micros)
    rows = block_scan(rows, [key], day_block(ts), [ts, tie], lags={"prev_t": F.col("t")})
    numbered = cut(row_index(rows, [key], day_block(ts), [ts, tie], "n"))

    def later(offset_s: float, eligible: Column, out: str) -> DataFrame:
        """Smallest position n at or after t + offset_s among eligible rows."""
        shift = int(offset_s * 1e6)
        probes = numbered.select(key, "n", (F.col("t") + shift).alias("at"), F.lit(0).alias("kind"),
                                 F.lit(None).cast("long").alias("hit"))
        targets = numbered.filter(eligible).select(key, "n", F.col("t").alias("at"), F.lit(1).alias("kind"),
                                                   F.col("n").alias("hit"))
        block = F.floor(F.col("at") / 86400000000).cast("long")
        scanned = block_scan(probes.unionByName(targets), [key], block, ["at", "kind", "n"],
                             lasts={out: F.col("hit")}, descending=True)
        return scanned.filter("kind = 0").select(key, "n", out)

    paused = F.col("prev_t").isNotNull() & (F.col("t") - F.col("prev_t") >= int(gap_s * 1e6))
    step = (later(max_len_s, F.lit(True), "full").join(later(min_len_s, paused, "quiet"), [key, "n"])
            .select(key, "n", F.least("full", "quiet").alias("next")))
    # A pause row may share its time with the start itself; the successor must lie ahead.
    step = cut(step.filter(F.col("next") > F.col("n")))
    starts = reachable(numbered.filter("n = 0").select(key, "n"), step, key).withColumn("__opens", F.lit(True))
    tagged = numbered.join(starts, [key, "n"], "left")
    filled = block_scan(tagged, [key], index_block("n"), ["n"],
                        lasts={"chunk_start": F.when(F.col("__opens"), F.col("t"))})
    return filled.select(key, ts, tie, "n", "chunk_start")


def reachable(first: DataFrame, step: DataFrame, key: str) -> DataFrame:
    """(key, n) of all rows that steps (key, n, next > n) lead to from ``first``, those included; step lengths double."""
    reached = cut(first)
    size = reached.count()
    while True:
        hop = reached.join(step, [key, "n"]).select(key, F.col("next").alias("n"))
        grown = cut(reached.unionByName(hop).distinct())
        grown_size = grown.count()
        if grown_size == size:
            return reached
        reached, size = grown, grown_size
        onward = step.select(key, F.col("n").alias("next"), F.col("next").alias("after"))
        step = cut(step.join(onward, [key, "next"]).select(key, "n", F.col("after").alias("next")))


def quiet_chunks(df: DataFrame, key: str, ts: str, tie: str, value: str, quiet_below: float = V.PAUSE_RMS,
                 window: int = 4, least: int = 6, most: int = 20) -> DataFrame:
    """Chunks of a measured signal, cut in quiet places: key, first, rows, chunk_start, chunk_end, ended_by.

    Lengths are in rows.  A window of ``window`` rows is quiet when the root mean square of
    ``value`` in it is below ``quiet_below``.  A chunk ends in the middle of the latest quiet
    window that begins ``least`` rows or more after the chunk's first row and lies within
    ``most`` rows of it (``quiet``); without one it ends after ``most`` rows (``full``) or with
    the signal (``end``: the flushed tail).  ``first`` is the chunk's first row, counted from 0.

    Squares are rounded to millionths and summed as whole numbers, so running energies give
    the exact energy of a window; a null value is silence.  Windows and the latest quiet one
    are two ordered scans, chunks are followed by doubling steps (:func:`reachable`), and a
    key is never in one task.  Rows are in order of ``ts`` and ``tie``, which together are unique.
    """
    if not 1 <= least or not 1 <= window <= most - least:
        raise ValueError("a quiet window must fit between the least and the longest chunk")
    energy = F.coalesce(F.round(F.col(value) * F.col(value) * 1e6).cast("long"), F.lit(0).cast("long"))
    rows = df.select(key, ts, tie, energy.alias("energy"))
    rows = cut(row_index(rows, [key], day_block(ts), [ts, tie], "n"))
    summed = cut(block_scan(rows, [key], index_block("n"), ["n"], sums={"upto": F.col("energy")}))
    closes = summed.select(key, (F.col("n") - (window - 1)).alias("n"), F.col("upto").alias("through"))
    held = F.col("through") - F.col("upto") + F.col("energy")
    quiet = F.when(held < F.lit(quiet_below * quiet_below * 1e6 * window), F.col("n"))
    marked = summed.join(closes, [key, "n"], "left").select(key, "n", quiet.alias("quiet"))
    latest = block_scan(marked, [key], index_block("n"), ["n"], lasts={"latest": F.col("quiet")}).select(key, "n", "latest")
    sizes = rows.groupBy(key).agg(F.count("*").alias("size"))
    reach = rows.select(key, "n").join(sizes, key).withColumn("at", F.least(F.col("n") + (most - window), F.col("size") - 1))
    known = reach.join(latest.withColumnRenamed("n", "at"), [key, "at"])
    in_quiet = F.col("latest") >= F.col("n") + least
    ahead = F.when(in_quiet, F.col("latest") + window // 2).when(F.col("n") + most < F.col("size"), F.col("n") + most)
    ends = cut(known.select(key, "n", F.coalesce(in_quiet, F.lit(False)).alias("in_quiet"), ahead.alias("next"), "size"))
    starts = reachable(rows.filter("n = 0").select(key, "n"), ends.filter("next < size").select(key, "n", "next"), key)
    chunks = starts.join(ends, [key, "n"]).withColumn("final", F.coalesce("next", "size") - 1)
    times = rows.select(key, "n", ts)
    chunks = chunks.join(times.withColumnRenamed(ts, "chunk_start"), [key, "n"]).join(
        times.select(key, F.col("n").alias("final"), F.col(ts).alias("chunk_end")), [key, "final"])
    return chunks.select(key, F.col("n").alias("first"), (F.col("final") - F.col("n") + 1).alias("rows"), "chunk_start", "chunk_end",
                         F.when(F.col("in_quiet"), "quiet").when(F.col("next").isNotNull(), "full").otherwise("end").alias("ended_by"))


def level_windows(df: DataFrame, keys: Sequence[str], ts: str, value: str, size: str, hop: str,
                  quiet_below: float = V.PAUSE_RMS) -> DataFrame:
    """Root mean square per window and whether it counts as quiet."""
    return (df.groupBy(*keys, F.window(ts, size, hop).alias("w"))
            .agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count("*").alias("samples"))
            .select(*keys, F.col("w.start").alias("window_start"), "rms", "samples",
                    (F.col("rms") < quiet_below).alias("quiet")))


def item_register(items: DataFrame, page_rows: int = 7) -> DataFrame:
    """1-based number inside the meeting and the slide page it falls on."""
    numbered = row_index(items, ["meeting_id"], index_block("segment_index"), ["segment_index", "item_id"],
                         "number", start=1)
    return numbered.withColumn("page", F.floor((F.col("number") - 1) / page_rows).cast("int"))


def topic_timeline(spans: DataFrame) -> DataFrame:
    """Start, end, drawn width (at least one percent) and share of the meeting per topic."""
    length = F.greatest(F.col("span_end") - F.col("span_start"), F.col("duration") * 0.01)
    share = F.when(F.col("duration") > 0, (F.col("span_end") - F.col("span_start")) / F.col("duration")).otherwise(0.0)
    return spans.filter("duration > 0").select(
        "meeting_id", "topic_id", "span_no", "title", "span_start", "span_end",
        length.alias("drawn_width"), share.alias("share"))


def dedupe_by_id(segments: DataFrame, key: str = "segment_id") -> DataFrame:
    """Drop re-delivered rows; the lowest segment_index of an id is kept."""
    others = [c for c in segments.columns if c != key]
    kept = segments.groupBy(key).agg(F.min_by(F.struct(*others), F.struct("segment_index", "arrival")).alias("r"))
    return kept.select(key, "r.*")
