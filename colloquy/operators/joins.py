"""Equi, interval and nearest joins between segments, turns, items and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..session import cut
from .blocks import block_scan, index_block, row_index


def items_with_meeting(items: DataFrame, meetings: DataFrame, projects: DataFrame) -> DataFrame:
    """Items with meeting title/date and, where the meeting has one, the project name."""
    m = meetings.select("meeting_id", "title", "date", "project_id", "user_id")
    p = projects.select("project_id", F.col("name").alias("project_name"), F.col("user_id").alias("project_owner"))
    return items.join(m, "meeting_id").join(p, "project_id", "left")


def recurring_topics(topics: DataFrame, meetings: DataFrame, projects: DataFrame) -> DataFrame:
    """Recurring topics with meeting, project and the earlier topic they link to."""
    previous = topics.select(F.col("topic_id").alias("previous_topic_id"), F.col("title").alias("previous_title"),
                             F.col("meeting_id").alias("previous_meeting_id"))
    hits = topics.filter("is_recurring").withColumnRenamed("title", "topic_title")
    return items_with_meeting(hits, meetings, projects).join(previous, "previous_topic_id", "left")


def assign_speakers(segments: DataFrame, turns: DataFrame, bucket_s: float = 30.0,
                    default: str = V.DEFAULT_SPEAKER) -> DataFrame:
    """Label each segment with the turn it overlaps most; earlier turns win ties.

    Both sides are spread over fixed time buckets so the join is an equi-join.  A
    pair sharing several buckets is evaluated only in the first one they share.
    """
    def buckets(start: str, end: str):
        return F.sequence(F.floor(F.col(start) / bucket_s), F.floor(F.greatest(F.col(start), F.col(end)) / bucket_s))

    seg = segments.select(
        "meeting_id", "segment_index", F.col("start_time").alias("s0"), F.col("end_time").alias("s1"),
        F.explode(buckets("start_time", "end_time")).alias("bucket"))
    turn = turns.select(
        "meeting_id", "turn_idx", F.col("speaker").alias("turn_speaker"), F.col("start_time").alias("t0"),
        F.col("end_time").alias("t1"), F.explode(buckets("start_time", "end_time")).alias("bucket"))
    overlap = F.least("s1", "t1") - F.greatest("s0", "t0")
    first_shared = F.greatest(F.floor(F.col("s0") / bucket_s), F.floor(F.col("t0") / bucket_s))
    best = (seg.join(turn, ["meeting_id", "bucket"])
            .filter((F.col("bucket") == first_shared) & (overlap > 0))
            .groupBy("meeting_id", "segment_index")
            .agg(F.max_by("turn_speaker", F.struct(overlap.alias("o"), (-F.col("turn_idx")).alias("i"))).alias("__best"),
                 F.max(overlap).alias("overlap")))
    return (segments.drop("speaker").join(best, ["meeting_id", "segment_index"], "left")
            .withColumn("speaker", F.coalesce("__best", F.lit(default)))
            .withColumn("overlap", F.coalesce("overlap", F.lit(0.0))).drop("__best"))


def relabel_segments(segments: DataFrame, speakers: DataFrame, turns: DataFrame,
                     provisional: str = V.DEFAULT_SPEAKER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relabel segments from turns.

    Returns segments, speakers (new labels added, unused provisional one dropped)
    and the rows whose label changed.  Meetings without turns keep their labels.
    """
    has_turns = turns.select("meeting_id").distinct().withColumn("__turns", F.lit(True))
    fresh = assign_speakers(segments, turns, default=provisional).select(
        "meeting_id", "segment_index", F.col("speaker").alias("__new"))
    joined = (segments.join(fresh, ["meeting_id", "segment_index"], "left").join(has_turns, "meeting_id", "left")
              .withColumn("__old", F.col("speaker"))
              .withColumn("speaker", F.when(F.col("__turns"), F.col("__new")).otherwise(F.col("speaker"))))
    out = joined.drop("__new", "__turns", "__old")
    changed = joined.filter(~F.col("__old").eqNullSafe(F.col("speaker"))).select(
        "meeting_id", "segment_index", F.col("__old").alias("old_speaker"), F.col("speaker").alias("new_speaker"))
    used = out.select("meeting_id", F.col("speaker").alias("label")).distinct()
    added = used.join(speakers, ["meeting_id", "label"], "left_anti").withColumn("name", F.lit(None).cast("string"))
    unused = (speakers.filter(F.col("label") == provisional).join(has_turns, "meeting_id", "left_semi")
              .join(used, ["meeting_id", "label"], "left_anti").select("meeting_id", "label"))
    kept = speakers.select("meeting_id", "label", "name").join(unused, ["meeting_id", "label"], "left_anti")
    return out, kept.unionByName(added.select("meeting_id", "label", "name")), changed


def item_source_lookup(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Start time and speaker of the segment an item came from; null where out of range."""
    src = segments.select("meeting_id", "segment_index", F.col("start_time").alias("source_time"),
                          F.col("speaker").alias("source_speaker"))
    return items.join(src, ["meeting_id", "segment_index"], "left")


def topic_spans(topics: DataFrame, segments: DataFrame, duration: DataFrame | None = None) -> DataFrame:
    """Stored times where every topic of a meeting has both, else equal shares of the duration.

    ``duration`` (meeting_id, duration) saves reading ``segments`` where it is known.
    """
    if duration is None:
        duration = segments.groupBy("meeting_id").agg(
            F.greatest(F.max("end_time") - F.min("start_time"), F.lit(0.0)).alias("duration"))
    per_meeting = topics.groupBy("meeting_id").agg(
        F.count("*").alias("n_topics"),
        F.bool_and(F.col("start_time").isNotNull() & F.col("end_time").isNotNull()).alias("timed"))
    numbered = row_index(topics, ["meeting_id"], index_block("topic_no"), ["topic_no", "topic_id"], "span_no")
    width = F.coalesce("duration", F.lit(0.0)) / F.col("n_topics")
    return (numbered.join(per_meeting, "meeting_id").join(duration, "meeting_id", "left")
            .withColumn("span_start", F.when(F.col("timed"), F.col("start_time")).otherwise(F.col("span_no") * width))
            .withColumn("span_end", F.when(F.col("timed"), F.col("end_time")).otherwise((F.col("span_no") + 1) * width))
            .withColumn("duration", F.coalesce("duration", F.lit(0.0)))
            .drop("timed"))


def attach_points(points: DataFrame, spans: DataFrame, key: str, value: Column, bucket_s: float = 60.0) -> DataFrame:
    """``points`` (meeting_id, at, ``key``, ...) with ``found``: least ``value`` of the spans holding ``at``, else that of the span starting nearest.

    ``value`` is an expression over ``spans`` that begins with the span's number; rows of ``points`` are distinct.
    Containment is an equi-join on time buckets, reduced where the join left it.  Only points outside all
    spans go on to the fallback, which merges them with the span starts of their meetings into one ordered
    scan, so it never pairs all points of a meeting with all its spans.
    """
    slim = cut(spans.select("meeting_id", value.alias("__value"), "span_start", "span_end"))
    spread = slim.filter(F.col("span_start") <= F.col("span_end")).withColumn("__bucket", F.explode(F.sequence(
        F.floor(F.col("span_start") / bucket_s), F.floor(F.col("span_end") / bucket_s))))
    p, s = points.withColumn("__bucket", F.floor(F.col("at") / bucket_s)).alias("p"), spread.alias("s")
    holds = ((F.col("p.meeting_id") == F.col("s.meeting_id")) & (F.col("p.__bucket") == F.col("s.__bucket"))
             & (F.col("s.span_start") <= F.col("p.at")) & (F.col("p.at") <= F.col("s.span_end")))
    held = cut(p.join(s, holds, "left").groupBy("p.__bucket", *[F.col(f"p.{c}") for c in points.columns])
               .agg(F.min("s.__value").alias("found")).drop("__bucket"))
    settled = F.col("found").isNotNull() | F.col("at").isNull()
    outside = held.filter(~settled).drop("found")

    starts = (slim.join(outside.select("meeting_id").distinct(), "meeting_id", "left_semi").groupBy("meeting_id", "span_start")
              .agg(F.min("__value").alias("v")).select("meeting_id", F.col("span_start").alias("at"), F.struct(
                  F.col("span_start").alias("start"), "v").alias("__span"), F.lit(0).alias("__is_point")))
    merged = (outside.withColumn("__span", F.lit(None).cast(starts.schema["__span"].dataType)).withColumn("__is_point", F.lit(1))
              .unionByName(starts, allowMissingColumns=True))
    both = block_scan(merged, ["meeting_id"], F.floor(F.col("at") / 600).cast("long"), ["at", "__is_point", key],
                      lasts={"__before": F.col("__span")}, nexts={"__after": F.col("__span")})

    def distance(c: str):
        return F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.start") - F.col("at")).alias("d"), F.col(f"{c}.v").alias("v")))

    nearest = both.filter("__is_point = 1").withColumn("found", F.least(distance("__before"), distance("__after"))["v"])
    return held.filter(settled).unionByName(nearest.select(*held.columns))


def attach_items_to_topics(items: DataFrame, spans: DataFrame, segments: DataFrame, key: str = "item_id",
                           bucket_s: float = 60.0) -> DataFrame:
    """Topic an item was raised in: first span containing its time, else the span starting nearest."""
    timed = item_source_lookup(items, segments).select("meeting_id", key, F.col("source_time").alias("at"))
    found = attach_points(timed, spans, key, F.struct("span_no", "topic_id"), bucket_s)
    return items.join(found.select("meeting_id", key, F.col("found.topic_id").alias("topic_id")), ["meeting_id", key], "left")
