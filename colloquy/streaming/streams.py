"""Structured Streaming counterparts of the batch operators.

Every ``start_*`` takes a streaming DataFrame, a checkpoint folder and a target and
returns the running query.  ``once=True`` processes what is available and stops.
Event time is part of the rows; rows later than ``WATERMARK`` are left to the batch
operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import labels as L
from ..functions import values as V
from ..operators import joins as C
from ..operators.sequences import STAGE_MOVES
from ..sources.sinks import write_context

WATERMARK = "30 seconds"
STAGES = list(STAGE_MOVES)


def _start(writer, once: bool) -> StreamingQuery:
    trigger = {"availableNow": True} if once else {"processingTime": f"{V.FLUSH_SECONDS} seconds"}
    return writer.trigger(**trigger).start()


def _files(df: DataFrame, checkpoint: str, target: str, once: bool) -> StreamingQuery:
    writer = df.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return _start(writer, once)


def start_segments(stream: DataFrame, checkpoint: str, target: str, once: bool = False) -> StreamingQuery:
    """Append arriving segments; the file sink's commit log makes a restart write nothing twice."""
    return _files(stream.filter(F.trim("text") != ""), checkpoint, target, once)


def deduplicated(stream: DataFrame, key: str = "segment_id", ts: str = "event_time", watermark: str = WATERMARK) -> DataFrame:
    """Re-delivered rows dropped by id; an id is remembered for the watermark delay."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def start_dedupe(stream: DataFrame, checkpoint: str, target: str, key: str = "segment_id", ts: str = "event_time",
                 watermark: str = WATERMARK, once: bool = False) -> StreamingQuery:
    return _files(deduplicated(stream, key, ts, watermark), checkpoint, target, once)


def latest_status(events: DataFrame) -> DataFrame:
    """Latest status per meeting with the progress carried forward inside it.

    The state is a few maxima per stage, so it merges in any order and is combined
    before the shuffle.  The current stage began after the last event of any other
    stage; its progress is the latest one reported since then.
    """
    at = F.struct("event_time", "event_id")
    aggs = [F.max_by("status", at).alias("status"), F.max("event_time").alias("event_time")]
    for s in STAGES:
        mine = F.col("status") == s
        aggs += [F.max(F.when(mine, at)).alias(f"seen_{s}"),
                 F.max(F.when(mine & F.col("progress").isNotNull(), F.struct(at.alias("at"), F.col("progress").alias("p")))).alias(f"told_{s}")]
    merged = events.groupBy("meeting_id").agg(*aggs)
    progress = F.coalesce(*[
        F.when((F.col("status") == s) & (F.col(f"told_{s}.at") > F.coalesce(F.greatest(
            *[F.col(f"seen_{o}") for o in STAGES if o != s]), F.struct(F.lit("1900-01-01").cast("timestamp").cast(
                events.schema["event_time"].dataType).alias("event_time"), F.lit(-1).cast("long").alias("event_id")))), F.col(f"told_{s}.p"))
        for s in STAGES])
    return merged.select("meeting_id", "status", "event_time", progress.alias("progress"),
                         F.col("status").isin("done", "error").alias("finished"))


FINISHED = ("done", "error")
STATUS_SCHEMA = "meeting_id string, status string, event_time timestamp, progress double, finished boolean"
#: For every stage, in the order of STAGES: the last event, and the last one that told a progress.
STATUS_STATE = "seen_at array<long>, seen_id array<long>, told_at array<long>, told_id array<long>, told array<double>"
#: Before every event.
NEVER = (-(1 << 62), -1)


def newest_of_stages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch the rows that can matter to a status: the last of a meeting and stage, and the last with a progress."""
    for frame in frames:
        rows = frame.sort_values(["event_time", "event_id"], kind="stable")
        last = rows.groupby(["meeting_id", "status"], dropna=False).tail(1)
        told = rows[rows["progress"].notna()].groupby(["meeting_id", "status"], dropna=False).tail(1)
        yield pd.concat([last, told.loc[told.index.difference(last.index)]]) if len(told) else last


def open_status(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """The rows of :func:`latest_status` as they change, with state for meetings that can still change only.

    Batches are reduced before the shuffle.  The state of a meeting is two events for each
    stage; it goes once its stage is a final one and the watermark has passed its last event:
    rows before the watermark are left out from then on, and what a later row begins depends
    on nothing before a final stage.  Rows without a time or of an unknown status are left out.
    """
    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, told = dict.fromkeys(STAGES, NEVER), dict.fromkeys(STAGES, (*NEVER, None))
        if state.exists:
            seen_at, seen_id, told_at, told_id, values = state.get
            seen = dict(zip(STAGES, zip(seen_at, seen_id)))
            told = dict(zip(STAGES, zip(told_at, told_id, values)))
        for frame in frames:
            times = frame["event_time"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            for at, number, status, progress in zip(times, frame["event_id"].tolist(), frame["status"], frame["progress"].tolist()):
                seen[status] = max(seen[status], (at, number))
                if progress == progress and progress is not None:
                    told[status] = max(told[status], (at, number, progress))
        status = max(STAGES, key=seen.get)
        began = max(seen[s] for s in STAGES if s != status)
        at, progress = seen[status][0], told[status][2] if told[status][:2] > began else None
        state.update((*map(list, zip(*seen.values())), *map(list, zip(*told.values()))))
        if status in FINISHED:
            state.setTimeoutTimestamp(max(at // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"meeting_id": [group[0]], "status": [status], "event_time": pd.to_datetime([at], unit="us"),
                            "progress": pd.Series([progress], dtype="float64"), "finished": [status in FINISHED]})

    rows = stream.select(F.col("meeting_id").cast("string").alias("meeting_id"), F.col("event_id").cast("long").alias("event_id"),
                         F.col("event_time").cast("timestamp").alias("event_time"), "status", F.col("progress").cast("double").alias("progress"))
    rows = rows.where(F.col("event_time").isNotNull() & F.col("event_id").isNotNull() & F.col("status").isin(*STAGES))
    reduced = rows.mapInPandas(newest_of_stages, rows.schema).withWatermark("event_time", watermark)
    return reduced.groupBy("meeting_id").applyInPandasWithState(step, STATUS_SCHEMA, STATUS_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def start_status(stream: DataFrame, checkpoint: str, target: str, once: bool = False, watermark: str = WATERMARK) -> StreamingQuery:
    """Upsert log of changed statuses; ``version`` is the micro-batch that wrote the row."""
    def write(batch: DataFrame, version: int) -> None:
        batch.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{target}/version={version}")

    writer = open_status(stream, watermark).writeStream.outputMode("update").foreachBatch(
        lambda b, v: write(b, v)).option("checkpointLocation", checkpoint)
    return _start(writer, once)


def newest_versions(stored: DataFrame, key: str = "meeting_id") -> DataFrame:
    others = [c for c in stored.columns if c not in (key, "version")]
    return stored.groupBy(key).agg(F.max_by(F.struct(*others), "version").alias("r")).select(key, "r.*")


def start_relabel(turns: DataFrame, segments_path: str, checkpoint: str, target: str, once: bool = False) -> StreamingQuery:
    """Late speaker turns relabel the stored segments of the meetings they touch.

    Arriving turns are kept next to the result, because a meeting's turns may come in
    several batches and each relabelling needs all of them.
    """
    def relabel(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{target}/turns/batch={number}")
        touched = spark.read.parquet(f"{target}/turns/batch={number}").select("meeting_id").distinct()
        known = spark.read.parquet(f"{target}/turns").drop("batch").join(touched, "meeting_id", "left_semi")
        stored = spark.read.parquet(segments_path).join(touched, "meeting_id", "left_semi")
        write_context({"segments": C.assign_speakers(stored, known)}, target)

    writer = turns.writeStream.foreachBatch(relabel).option("checkpointLocation", checkpoint)
    return _start(writer, once)


def pause_windows(stream: DataFrame, key: str, ts: str, gap: str, watermark: str = WATERMARK) -> DataFrame:
    """Chunks ended by a pause: start, end and number of rows per chunk."""
    return (stream.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("w"))
            .agg(F.count("*").alias("rows"))
            .select(key, F.col("w.start").alias("chunk_start"), F.col("w.end").alias("chunk_end"), "rows"))


CHUNK_SCHEMA = "key string, chunk_start timestamp, last_row timestamp, rows long"
#: The open chunk, then the rows that the watermark has not passed.
CHUNK_STATE = "start long, last long, rows long, waiting array<long>"


def cut_chunks(times: list[int], opened: tuple[int | None, int | None, int], gap: int, least: int, most: int) -> tuple[list[tuple], tuple]:
    """Finished chunks (start, last, rows) of ascending times that follow an open chunk, and the chunk then open."""
    start, last, rows = opened
    done = []
    for t in times:
        if rows and (t - start >= most or (t - last >= gap and t - start >= least)):
            done.append((start, last, rows))
            rows = 0
        start, last, rows = (start if rows else t), t, rows + 1
    return done, (start, last, rows)


def bounded_chunks(stream: DataFrame, key: str, ts: str, gap_s: float = V.PAUSE_SECONDS, min_len_s: float = V.CHUNK_MIN_SECONDS,
                   max_len_s: float = V.CHUNK_MAX_SECONDS, watermark: str = WATERMARK, ended: str | None = None) -> DataFrame:
    """Chunks with the batch rule: a pause once long enough, or the maximum length.

    Rows wait in the state until the watermark has passed them and are then taken in order
    of time, so rows out of order within the watermark's delay are cut as if they had come
    in order, over batches too.  The state of a key is its open chunk and the rows of one delay.

    ``ended`` names a boolean column that marks the row telling that a key has stopped; it
    is no row of a chunk.  Everything waiting is then cut at once, the last chunk is written
    and the state goes.  A key that never stops has its last chunk written when the
    watermark is ``max_len_s`` past its last row, when no row could lengthen it any more.
    """
    gap, least, most = (int(s * 1e6) for s in (gap_s, min_len_s, max_len_s))

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, rows, waiting = state.get if state.exists else (None, None, 0, [])
        waiting, stopped = list(waiting), False
        for frame in frames:
            times = frame["t"].to_numpy().astype("datetime64[us]").astype("int64")
            marks = frame["ended"].to_numpy(dtype=bool)
            waiting += times[~marks].tolist()
            stopped = stopped or bool(marks.any())
        passed = state.getCurrentWatermarkMs() * 1000
        ready = sorted(t for t in waiting if stopped or t <= passed)
        done, (start, last, rows) = cut_chunks(ready, (start, last, rows), gap, least, most)
        waiting = [] if stopped else [t for t in waiting if t > passed]
        if rows and not waiting and (stopped or passed >= last + most):
            done.append((start, last, rows))
            rows = 0
        if rows or waiting:
            state.update((start, last, rows, waiting))
            due = min(waiting) if waiting else last + most
            state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        out = pd.DataFrame([(group[0], *c) for c in done], columns=["key", "chunk_start", "last_row", "rows"])
        for c in ("chunk_start", "last_row"):
            out[c] = pd.to_datetime(out[c].astype("int64"), unit="us")
        yield out

    mark = F.coalesce(F.col(ended), F.lit(False)) if ended else F.lit(False)
    slim = stream.withWatermark(ts, watermark).where(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(ts).alias("t"), mark.alias("ended"))
    return slim.groupBy("key").applyInPandasWithState(step, CHUNK_SCHEMA, CHUNK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start_chunks(chunks: DataFrame, checkpoint: str, target: str, once: bool = False) -> StreamingQuery:
    return _files(chunks, checkpoint, target, once)


def start_tail(stored: DataFrame, stream: DataFrame, checkpoint: str, target: str, key: str = "segment_id", ts: str = "event_time",
               watermark: str = WATERMARK, once: bool = False) -> StreamingQuery:
    """A late subscriber's view: the stored rows first, then every live row not among them, once.

    Rows delivered again, in the same batch or a later one, are dropped by id as in
    :func:`deduplicated`.
    """
    columns = stored.columns

    def follow(batch: DataFrame, number: int) -> None:
        fresh = batch.join(stored.select(key), key, "left_anti").select(*columns)
        rows = fresh.withColumn("live", F.lit(True))
        if number == 0:
            rows = stored.select(*columns).withColumn("live", F.lit(False)).unionByName(rows)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = deduplicated(stream, key, ts, watermark).writeStream.foreachBatch(follow).option("checkpointLocation", checkpoint)
    return _start(writer, once)


def urgent_items(stream: DataFrame, text: str = "text") -> DataFrame:
    """Segments with an urgency above low; stateless, so it works on batch and stream alike."""
    return stream.withColumn("urgency", L.score_urgency(F.col(text))).filter(F.col("urgency") != "low")


def start_urgent_items(stream: DataFrame, checkpoint: str, target: str, once: bool = False) -> StreamingQuery:
    return _files(urgent_items(stream), checkpoint, target, once)
