"""Queries over segments, meetings, projects and items."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import values as V
from ..operators import filters as B
from ..operators import joins as C
from ..operators import maintenance as M
from ..operators import rollups as D
from ..operators import sequences as E
from ..session import ensure_checkpoint_dir
from ..sources import orders_world as O
from ..sources import sinks as S
from ..sources import transcripts as X
from .registry import query
from .sql import strip, with_


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def sql6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


# -- sources -----------------------------------------------------------------

@query("read_utterances", with_("ord", """SELECT meeting_id, segment_index,
  CASE WHEN k % 7 = 0 THEN 'SPEAKER_00' ELSE speaker END AS speaker,
  CASE WHEN k % 7 <> 0 AND speaker = 'SPEAKER_01' THEN 'Ines' END AS speaker_name, text,
  round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM ord"""))
def _(spark, path):
    rows = X.orders_as_utterances(X.table(spark, path, "orders"))
    segments = rows.withColumn("speaker_id", F.when(
        F.col("order_key") % 7 != 0, F.concat_ws(":", "meeting_id", "speaker"))).drop("speaker")
    who = O.speakers(spark, path).withColumn("speaker_id", F.concat_ws(":", "meeting_id", "label"))
    return X.read_utterances(segments, who).select(
        "meeting_id", "segment_index", "speaker", "speaker_name", "text", r6("start_time"), r6("end_time"))


@query("conversations_as_utterances", with_("conv", """SELECT meeting_id, segment_index, speaker, text,
  round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM conv"""))
def _(spark, path):
    return X.conversations_as_utterances(X.table(spark, path, "conversations")).select(
        "meeting_id", "segment_index", "speaker", "text", r6("start_time"), r6("end_time"))


@query("documents_as_utterances", with_("doc", """SELECT meeting_id, segment_index, speaker, text,
  round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM doc"""))
def _(spark, path):
    return X.documents_as_utterances(X.table(spark, path, "documents")).select(
        "meeting_id", "segment_index", "speaker", "text", r6("start_time"), r6("end_time"))


@query("orders_as_utterances", with_("ord", """SELECT meeting_id, segment_index, speaker, text,
  round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM ord"""))
def _(spark, path):
    return X.orders_as_utterances(X.table(spark, path, "orders")).select(
        "meeting_id", "segment_index", "speaker", "text", r6("start_time"), r6("end_time"))


def _raw_chunks(spark, path):
    c = X.table(spark, path, "conversations")
    seconds = F.length("text") / 15.0
    return c.select(
        F.col("conv_id").cast("string").alias("meeting_id"), F.col("turn").cast("int").alias("segment_index"),
        F.when(F.col("turn") % 4 == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\n"))).alias("text"),
        (F.col("turn") % 3).cast("double").alias("start_time"), seconds.alias("end_time"),
        (F.col("turn") * 10).cast("double").alias("chunk_offset"),
        F.when(F.col("turn") % 2 == 0, F.lit(8.0)).alias("chunk_seconds"))


@query("normalise_segments", rf"""WITH raw AS (SELECT CAST(conv_id AS VARCHAR) AS meeting_id, CAST(turn AS INTEGER) AS segment_index,
  {strip('text')} AS text, CAST(turn % 3 AS DOUBLE) + turn * 10 AS s,
  CASE WHEN turn % 2 = 0 THEN least(length(text) / 15.0::DOUBLE + turn * 10, turn * 10 + 8.0) ELSE length(text) / 15.0::DOUBLE + turn * 10 END AS e
  FROM conversations WHERE turn % 4 <> 3)
SELECT meeting_id, segment_index, text, round(least(s, e), 6) AS start_time, round(e, 6) AS end_time FROM raw WHERE text <> ''""")
def _(spark, path):
    return X.normalise_segments(_raw_chunks(spark, path)).select(
        "meeting_id", "segment_index", "text", r6("start_time"), r6("end_time"))


@query("append_segments", with_("ord", """, old AS (SELECT * FROM ord WHERE o_orderstatus = 'F'), last AS (
  SELECT meeting_id, max(segment_index) + 1 AS nxt FROM old GROUP BY 1)
SELECT n.meeting_id, n.k AS arrival, CAST(coalesce(l.nxt, 0) + ROW_NUMBER() OVER (PARTITION BY n.meeting_id ORDER BY n.k) - 1 AS INTEGER) AS segment_index
FROM ord n LEFT JOIN last l USING (meeting_id) WHERE n.o_orderstatus <> 'F'"""))
def _(spark, path):
    rows = X.orders_as_utterances(X.table(spark, path, "orders"), keep=("o_orderstatus",))
    new = rows.filter(F.col("o_orderstatus") != "F").select("meeting_id", F.col("order_key").alias("arrival"))
    return X.append_segments(rows.filter(F.col("o_orderstatus") == "F"), new)


@query("json_columns", """SELECT o_custkey AS meeting, CASE WHEN n > 0 THEN n ELSE 0 END AS stored, n AS read_back FROM (
  SELECT o_custkey, count(*) FILTER (o_orderkey % 3 = 0) AS n FROM orders GROUP BY 1)""")
def _(spark, path):
    o = X.table(spark, path, "orders")
    tagged = o.select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.array(F.struct(
        F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p")))).alias("tags"))
    text = S.encode_json(tagged, ["tags"])
    back = S.decode_json(text, {"tags": "array<struct<k:bigint,p:string>>"})
    return back.groupBy(F.col("o_custkey").alias("meeting")).agg(
        F.sum(F.size("tags")).cast("long").alias("stored"), F.count_if(F.size("tags") > 0).alias("read_back"))


@query("align_schema", with_("items", """SELECT item_id, meeting_id, description, CAST(NULL AS VARCHAR) AS owner,
  1.0::DOUBLE AS confidence, segment_index FROM items"""))
def _(spark, path):
    from ..schemas import ACTION_ITEMS
    old = O.action_items(spark, path).select("item_id", "meeting_id", "description", "segment_index")
    return S.align_schema(old, ACTION_ITEMS).select(
        "item_id", "meeting_id", "description", "owner", "confidence", "segment_index")


@query("document_stems", """SELECT page_id, CASE WHEN s = '' THEN 'meeting' ELSE s END AS stem FROM (
  SELECT page_id, substr(replace(trim(regexp_replace(url, '[^A-Za-z0-9._ -]+', '', 'g')), ' ', '_'), 1, 60) AS s FROM pages)""")
def _(spark, path):
    return X.table(spark, path, "pages").select("page_id", L.doc_stem(F.col("url")).alias("stem"))


@query("rewrite_context", """SELECT 'items' AS name, CAST(o_custkey AS VARCHAR) AS meeting_id, o_orderkey AS k, o_custkey % 3 = 1 AS again FROM orders WHERE o_custkey % 3 <> 0
UNION ALL SELECT 'notes', CAST(o_custkey AS VARCHAR), max(o_orderkey), o_custkey % 3 = 1 FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey""")
def _(spark, path):
    """Written, then recomputed: a third of the meetings to nothing, a third to new rows, the rest left alone."""
    ensure_checkpoint_dir(spark)
    target = f"{spark.sparkContext.getCheckpointDir()}/context-{uuid.uuid4().hex}"
    key = F.col("o_custkey") % 3
    items = X.table(spark, path, "orders").select("o_custkey", F.col("o_custkey").cast("string").alias("meeting_id"), F.col("o_orderkey").alias("k"))

    def tables(rows, again):
        rows = rows.withColumn("again", F.lit(again))
        return {"items": rows.drop("o_custkey"), "notes": rows.groupBy("meeting_id", "again").agg(F.max("k").alias("k"))}

    S.write_context(tables(items, False), target, buckets=16)
    S.write_context(tables(items.where(key == 1), True), target, buckets=16, recomputed=items.where(key < 2).select("meeting_id"))
    columns = ["name", "meeting_id", "k", "again"]
    back = [spark.read.parquet(f"{target}/{name}").withColumn("name", F.lit(name)).select(*columns) for name in ("items", "notes")]
    return back[0].unionByName(back[1])


# -- visibility, search and views ----------------------------------------------

def _world(spark, path):
    return O.meetings(spark, path), O.projects(spark, path)


@query("visible_to_user", with_(["meetings", "projects"], """SELECT m.meeting_id, m.title FROM meetings m LEFT JOIN projects p USING (project_id)
  WHERE m.user_id = 'u3' OR p.user_id = 'u3'"""))
def _(spark, path):
    return B.visible_to(*_world(spark, path), "u3").select("meeting_id", "title")


@query("access_flags", with_(["meetings", "projects"], """SELECT m.meeting_id,
  NOT coalesce(m.user_id IS NOT NULL AND m.user_id <> 'u2' AND NOT coalesce(p.user_id = 'u2', false), false) AS can_access
  FROM meetings m LEFT JOIN projects p USING (project_id)"""))
def _(spark, path):
    return B.access_flags(*_world(spark, path), "u2").select("meeting_id", "can_access")


@query("recent_meetings", with_("meetings", "SELECT meeting_id, title, date FROM meetings ORDER BY date DESC, meeting_id LIMIT 50 OFFSET 10"))
def _(spark, path):
    return B.recent_meetings(O.meetings(spark, path), 10, 50).select("meeting_id", "title", "date")


@query("search_meetings", with_("meetings", "SELECT meeting_id, title, status FROM meetings WHERE contains(lower(title), 'build') AND status = 'done'"))
def _(spark, path):
    return B.search_meetings(O.meetings(spark, path), "BUILD", "done").select("meeting_id", "title", "status")


@query("filter_action_items", with_("items", """SELECT item_id, urgency, resolved, CASE lower(coalesce(urgency, 'low')) WHEN 'critical' THEN 0 WHEN 'high' THEN 1
  WHEN 'medium' THEN 2 ELSE 3 END AS priority_rank FROM items WHERE NOT resolved"""))
def _(spark, path):
    return B.filter_action_items(O.action_items(spark, path), "open").select(
        "item_id", "urgency", "resolved", "priority_rank")


@query("open_action_items", with_(["items", "meetings", "projects"], """SELECT i.item_id, m.title, p.name AS project_name FROM items i
  JOIN meetings m USING (meeting_id) LEFT JOIN projects p ON m.project_id = p.project_id WHERE NOT i.resolved"""))
def _(spark, path):
    return C.items_with_meeting(B.open_action_items(O.action_items(spark, path)), *_world(spark, path)).select(
        "item_id", "title", "project_name")


@query("split_items", with_("glance_items", """SELECT item_id, NOT resolved AS is_open, resolved AS is_done, is_question, NOT is_question AS is_task FROM glance_items"""))
def _(spark, path):
    return B.split_items(O.action_items(spark, path)).select("item_id", "is_open", "is_done", "is_question", "is_task")


@query("min_confidence", with_("items", "SELECT item_id, confidence FROM items WHERE confidence >= 0.45"))
def _(spark, path):
    return B.min_confidence(O.action_items(spark, path)).select("item_id", "confidence")


@query("display_names", with_("speakers", """SELECT meeting_id, label, coalesce(name, inferred, 'Speaker ' ||
  CAST(CAST(substr(label, 9) AS INTEGER) + 1 AS VARCHAR)) AS display_name FROM speakers"""))
def _(spark, path):
    return O.speakers(spark, path).select(
        "meeting_id", "label", L.display_name(F.col("name"), F.col("inferred"), F.col("label")).alias("display_name"))


@query("needs_review", with_("items", """SELECT item_id, CASE WHEN confidence < 0.75 THEN CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '% sure' END AS note FROM items"""))
def _(spark, path):
    return O.action_items(spark, path).select("item_id", L.needs_review(F.col("confidence")).alias("note"))


@query("formats", """SELECT o_orderkey, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || ' s'
    WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ' h ' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ' min'
    ELSE CAST(s // 60 AS VARCHAR) || ' min ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ' s' END AS duration,
  CASE WHEN s // 60 < 100 THEN lpad(CAST(s // 60 AS VARCHAR), 2, '0') ELSE CAST(s // 60 AS VARCHAR) END || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock,
  strftime(o_orderdate, '%d %B %Y') AS day FROM (SELECT *, CAST(floor(o_totalprice / 60) AS BIGINT) AS s FROM orders)""")
def _(spark, path):
    s = F.col("o_totalprice") / 60
    return X.table(spark, path, "orders").select(
        "o_orderkey", L.format_duration(s).alias("duration"), L.format_clock(s).alias("clock"),
        L.format_date(F.col("o_orderdate")).alias("day"))


@query("label_maps", with_("items", """SELECT item_id, CASE coalesce(urgency, 'low') WHEN 'critical' THEN '🚨 Critical' WHEN 'high' THEN '🔴 High Priority'
  WHEN 'medium' THEN '🟡 Medium Priority' ELSE '🟢 Low Priority' END AS label FROM items"""))
def _(spark, path):
    return O.action_items(spark, path).select("item_id", L.urgency_label(F.col("urgency")).alias("label"))


@query("source_labels", with_("meetings", """SELECT meeting_id, CASE source WHEN 'live' THEN 'Live recording (microphone)' ELSE 'Uploaded recording' END AS label FROM meetings"""))
def _(spark, path):
    return O.meetings(spark, path).select("meeting_id", L.source_label(F.col("source")).alias("label"))


def status_events(spark, path):
    """Event rows as status messages: one meeting per user, progress missing on every third row."""
    e = X.table(spark, path, "events")
    status = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "transcribing")
              .when(F.col("event_type") == "click", "structuring").when(F.col("event_type") == "purchase", "done")
              .otherwise("error"))
    return e.select(
        F.col("user_id").cast("string").alias("meeting_id"), "event_id", F.col("ts").alias("event_time"),
        status.alias("status"),
        F.when(F.col("event_id") % 3 != 0, F.least(F.col("value") / 100.0, F.lit(1.0))).alias("progress"))


STATUS_SQL = """status_events AS (SELECT CAST(user_id AS VARCHAR) AS meeting_id, event_id, ts AS event_time, CASE event_type WHEN 'signup' THEN 'queued'
  WHEN 'view' THEN 'transcribing' WHEN 'click' THEN 'structuring' WHEN 'purchase' THEN 'done' ELSE 'error' END AS status,
  CASE WHEN event_id % 3 <> 0 THEN least(value / 100.0::DOUBLE, 1.0) END AS progress FROM events)"""


@query("stage_progress", f"""WITH {STATUS_SQL}, e AS (SELECT *, CASE WHEN status = 'structuring' AND progress >= 0.85 THEN 'summarising' ELSE status END AS shown,
  least(greatest(coalesce(progress, 0), 0), 1) AS p FROM status_events)
SELECT event_id, shown, round(CASE shown WHEN 'queued' THEN 5.0 WHEN 'transcribing' THEN 10 + p * 50 WHEN 'structuring' THEN 60 + p * 35
  WHEN 'summarising' THEN 95.0 WHEN 'done' THEN 100.0 ELSE 0.0 END::DOUBLE, 6) AS percent FROM e""")
def _(spark, path):
    shown = L.effective_status(F.col("status"), F.col("progress"))
    return status_events(spark, path).withColumn("shown", shown).select(
        "event_id", "shown", F.round(L.stage_progress_pct(F.col("shown"), F.col("progress")), 6).alias("percent"))


@query("relative_age", """WITH e AS (SELECT event_id, ts, floor(epoch_us(TIMESTAMP '2024-01-20 12:00:00') / 60000000.0::DOUBLE - epoch_us(ts) / 60000000.0::DOUBLE) AS m FROM events)
SELECT event_id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN CAST(CAST(m AS BIGINT) AS VARCHAR) || 'm ago'
  WHEN floor(m / 60) < 24 THEN CAST(CAST(floor(m / 60) AS BIGINT) AS VARCHAR) || 'h ago'
  WHEN floor(m / 1440) < 7 THEN CAST(CAST(floor(m / 1440) AS BIGINT) AS VARCHAR) || 'd ago' ELSE strftime(ts, '%d %b %Y') END AS age FROM e""")
def _(spark, path):
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return X.table(spark, path, "events").select("event_id", L.relative_age(F.col("ts"), as_of).alias("age"))


# -- joins --------------------------------------------------------------------------

@query("items_with_meeting", with_(["items", "meetings", "projects"], """SELECT i.item_id, m.title, m.date, p.name AS project_name FROM items i
  JOIN meetings m USING (meeting_id) LEFT JOIN projects p ON m.project_id = p.project_id"""))
def _(spark, path):
    return C.items_with_meeting(O.action_items(spark, path), *_world(spark, path)).select(
        "item_id", "title", "date", "project_name")


@query("recurring_topics", with_(["topics", "meetings", "projects"], """SELECT t.topic_id, t.title AS topic_title, m.title, p.name AS project_name,
  v.title AS previous_title, v.meeting_id AS previous_meeting_id FROM topics t JOIN meetings m USING (meeting_id)
  LEFT JOIN projects p ON m.project_id = p.project_id LEFT JOIN topics v ON t.previous_topic_id = v.topic_id WHERE t.is_recurring"""))
def _(spark, path):
    return C.recurring_topics(O.topics(spark, path), *_world(spark, path)).select(
        "topic_id", "topic_title", "title", "project_name", "previous_title", "previous_meeting_id")


ASSIGNED = """, pairs AS (SELECT s.meeting_id, s.segment_index, t.speaker, t.turn_idx, least(s.end_time, t.end_time) - greatest(s.start_time, t.start_time) AS ov
  FROM segs s JOIN turns t USING (meeting_id) WHERE least(s.end_time, t.end_time) > greatest(s.start_time, t.start_time)),
best AS (SELECT * FROM pairs QUALIFY ROW_NUMBER() OVER (PARTITION BY meeting_id, segment_index ORDER BY ov DESC, turn_idx) = 1),
assigned AS (SELECT s.*, coalesce(b.speaker, 'SPEAKER_00') AS new_speaker, coalesce(b.ov, 0) AS overlap FROM segs s
  LEFT JOIN best b ON s.meeting_id = b.meeting_id AND s.segment_index = b.segment_index)
"""


@query("assign_speakers", with_(["segs", "turns"], ASSIGNED + """SELECT meeting_id, segment_index, new_speaker AS speaker,
  round(overlap, 6) AS overlap FROM assigned"""))
def _(spark, path):
    return C.assign_speakers(O.segments(spark, path), O.speaker_turns(spark, path)).select(
        "meeting_id", "segment_index", "speaker", r6("overlap"))


@query("relabel_changes", with_(["segs", "turns"], ASSIGNED + """SELECT meeting_id, segment_index, speaker AS old_speaker, new_speaker FROM assigned WHERE speaker <> new_speaker"""))
def _(spark, path):
    seg, who = O.segments(spark, path), O.speakers(spark, path).select("meeting_id", "label", "name")
    return C.relabel_segments(seg, who, O.speaker_turns(spark, path))[2]


@query("relabel_speakers", with_(["segs", "turns", "speakers"], ASSIGNED + """, used AS (SELECT DISTINCT meeting_id, new_speaker AS label FROM assigned)
SELECT meeting_id, label, name FROM speakers s WHERE NOT (label = 'SPEAKER_00' AND NOT EXISTS (SELECT 1 FROM used u WHERE u.meeting_id = s.meeting_id AND u.label = s.label))
UNION ALL SELECT u.meeting_id, u.label, NULL FROM used u ANTI JOIN speakers s ON u.meeting_id = s.meeting_id AND u.label = s.label"""))
def _(spark, path):
    seg, who = O.segments(spark, path), O.speakers(spark, path).select("meeting_id", "label", "name")
    return C.relabel_segments(seg, who, O.speaker_turns(spark, path))[1]


SPANS = """, flagged AS (SELECT *, bool_and(start_time IS NOT NULL AND end_time IS NOT NULL) OVER p AS timed, count(*) OVER p AS n,
  CAST(ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY topic_no, topic_id) - 1 AS BIGINT) AS span_no FROM topics WINDOW p AS (PARTITION BY meeting_id)),
spans AS (SELECT f.meeting_id, f.topic_id, f.title, f.span_no, CASE WHEN timed THEN f.start_time ELSE span_no * (d.duration / n) END AS span_start,
  CASE WHEN timed THEN f.end_time ELSE (span_no + 1) * (d.duration / n) END AS span_end, d.duration FROM flagged f LEFT JOIN durations d USING (meeting_id))
"""


def _spans(spark, path):
    return C.topic_spans(O.topics(spark, path), O.segments(spark, path))


@query("topic_spans", with_(["topics", "durations"], SPANS + "SELECT topic_id, span_no, round(span_start, 6) AS span_start, round(span_end, 6) AS span_end FROM spans"))
def _(spark, path):
    return _spans(spark, path).select("topic_id", "span_no", r6("span_start"), r6("span_end"))


@query("attach_items_to_topics", with_(["topics", "durations", "items", "segs"], SPANS + """, placed AS (SELECT i.item_id, i.meeting_id, s.start_time AS t FROM items i
  LEFT JOIN segs s ON i.meeting_id = s.meeting_id AND i.segment_index = s.segment_index)
SELECT item_id, topic_id FROM (SELECT a.item_id, p.topic_id, ROW_NUMBER() OVER (PARTITION BY a.item_id ORDER BY
  CASE WHEN p.span_start <= a.t AND a.t <= p.span_end THEN 0 ELSE 1 END, CASE WHEN p.span_start <= a.t AND a.t <= p.span_end THEN p.span_no ELSE abs(p.span_start - a.t) END,
  p.span_no) AS rn FROM placed a LEFT JOIN spans p USING (meeting_id)) WHERE rn = 1"""))
def _(spark, path):
    return C.attach_items_to_topics(O.action_items(spark, path), _spans(spark, path), O.segments(spark, path)).select(
        "item_id", "topic_id")


@query("item_source_lookup", with_(["items", "segs"], """SELECT i.item_id, round(s.start_time, 6) AS source_time, s.speaker AS source_speaker FROM (
  SELECT *, CASE WHEN item_id LIKE '%7' THEN segment_index + 1000 ELSE segment_index END AS idx FROM items) i
  LEFT JOIN segs s ON i.meeting_id = s.meeting_id AND i.idx = s.segment_index"""))
def _(spark, path):
    items = O.action_items(spark, path).withColumn("segment_index", F.when(
        F.col("item_id").endswith("7"), F.col("segment_index") + 1000).otherwise(F.col("segment_index")))
    return C.item_source_lookup(items, O.segments(spark, path)).select("item_id", r6("source_time"), "source_speaker")


# -- aggregates ----------------------------------------------------------------------

def _named(spark, path):
    return D.named_segments(O.segments(spark, path), O.speakers(spark, path))


@query("talk_time_by_role", with_("conv", """, per AS (SELECT meeting_id, speaker, sum(greatest(end_time - start_time, 0)) AS seconds, count(*) AS turns FROM conv GROUP BY 1, 2)
SELECT meeting_id, speaker, round(seconds, 6) AS seconds, turns, round(seconds / CASE WHEN sum(seconds) OVER p = 0 THEN 1 ELSE sum(seconds) OVER p END, 6) AS share
FROM per WINDOW p AS (PARTITION BY meeting_id)"""))
def _(spark, path):
    seg = X.conversations_as_utterances(X.table(spark, path, "conversations"))
    return D.talk_time(seg, "speaker").select("meeting_id", "speaker", r6("seconds"), "turns", r6("share"))


@query("talk_time", with_(["segs", "speakers"], """, per AS (SELECT s.meeting_id, coalesce(p.name, s.speaker) AS display_name, sum(greatest(end_time - start_time, 0)) AS seconds, count(*) AS turns
  FROM segs s LEFT JOIN speakers p ON s.meeting_id = p.meeting_id AND s.speaker = p.label GROUP BY 1, 2)
SELECT meeting_id, display_name, round(seconds, 6) AS seconds, turns, round(seconds / sum(seconds) OVER (PARTITION BY meeting_id), 6) AS share FROM per"""))
def _(spark, path):
    return D.talk_time(_named(spark, path)).select("meeting_id", "display_name", r6("seconds"), "turns", r6("share"))


@query("top_speakers", with_(["segs"], """, per AS (SELECT meeting_id, speaker, sum(end_time - start_time) AS seconds FROM segs GROUP BY 1, 2)
SELECT * FROM (SELECT meeting_id, speaker, round(seconds, 6) AS seconds, CAST(ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY round(seconds, 6) DESC, speaker) AS INTEGER) AS rank FROM per) WHERE rank <= 2"""))
def _(spark, path):
    talk = D.talk_time(O.segments(spark, path), "speaker").withColumn("seconds", F.round("seconds", 6))
    return B.top_k(talk, ["meeting_id"], [F.col("seconds").desc(), F.col("speaker")], 2).select(
        "meeting_id", "speaker", "seconds", "rank")


@query("meeting_duration", with_("durations", "SELECT meeting_id, round(duration, 6) AS duration FROM durations"))
def _(spark, path):
    return D.meeting_duration(O.segments(spark, path)).select("meeting_id", r6("duration"))


@query("speaker_count", with_("segs", "SELECT meeting_id, greatest(count(DISTINCT speaker), 1) AS speakers FROM segs GROUP BY 1"))
def _(spark, path):
    return D.speaker_count(O.segments(spark, path))


@query("meeting_glance", with_(["meetings", "topics", "decisions", "glance_items", "segs", "speakers"], """SELECT m.meeting_id, coalesce(t.n, 0) AS topics, coalesce(d.n, 0) AS decisions, coalesce(i.tasks, 0) AS tasks,
  coalesce(i.open_tasks, 0) AS open_tasks, coalesce(i.completed, 0) AS completed, coalesce(i.open_questions, 0) AS open_questions, coalesce(s.n, 0) AS participants FROM meetings m
  LEFT JOIN (SELECT meeting_id, count(*) AS n FROM topics GROUP BY 1) t USING (meeting_id)
  LEFT JOIN (SELECT meeting_id, count(*) AS n FROM decisions GROUP BY 1) d USING (meeting_id)
  LEFT JOIN (SELECT meeting_id, count(*) FILTER (NOT is_question) AS tasks, count(*) FILTER (NOT is_question AND NOT resolved) AS open_tasks,
    count(*) FILTER (resolved) AS completed, count(*) FILTER (is_question) AS open_questions FROM glance_items GROUP BY 1) i USING (meeting_id)
  LEFT JOIN (SELECT s.meeting_id, count(DISTINCT coalesce(p.name, s.speaker)) AS n FROM segs s LEFT JOIN speakers p ON s.meeting_id = p.meeting_id AND s.speaker = p.label GROUP BY 1) s USING (meeting_id)"""))
def _(spark, path):
    return D.meeting_glance(O.meetings(spark, path), O.topics(spark, path), O.action_items(spark, path),
                            O.decisions(spark, path), _named(spark, path))


@query("items_by_priority", with_("items", """SELECT meeting_id, lower(coalesce(urgency, 'low')) AS urgency, count(*) AS items,
  CASE lower(coalesce(urgency, 'low')) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority_rank FROM items GROUP BY 1, 2"""))
def _(spark, path):
    return D.items_by_priority(O.action_items(spark, path))


@query("items_by_owner", with_(["items", "meetings"], """SELECT * FROM (SELECT project_id, owner, items, CAST(ROW_NUMBER() OVER (PARTITION BY project_id ORDER BY owner = 'Unassigned', items DESC, owner) AS INTEGER) AS rank
  FROM (SELECT m.project_id, coalesce(i.owner, 'Unassigned') AS owner, count(*) AS items FROM items i JOIN meetings m USING (meeting_id) GROUP BY 1, 2)) WHERE rank <= 10"""))
def _(spark, path):
    joined = O.action_items(spark, path).join(O.meetings(spark, path).select("meeting_id", "project_id"), "meeting_id")
    return D.items_by_owner(joined, ["project_id"], 10)


@query("items_by_status", with_("items", "SELECT meeting_id, count(*) FILTER (NOT resolved) AS open, count(*) FILTER (resolved) AS done FROM items GROUP BY 1"))
def _(spark, path):
    return D.items_by_status(O.action_items(spark, path))


def _counts(spark, path):
    return D.meeting_counts(O.meetings(spark, path), O.action_items(spark, path), O.decisions(spark, path),
                            O.segments(spark, path), O.topics(spark, path))


def _rollup(spark, path):
    return D.project_rollup(O.projects(spark, path), _counts(spark, path))


@query("project_rollup", with_("rollup", "SELECT project_id, name, company, meeting_count, round(total_duration_seconds, 6) AS total_duration_seconds, decisions, items, resolved FROM rollup"))
def _(spark, path):
    return _rollup(spark, path).select("project_id", "name", "company", "meeting_count", r6("total_duration_seconds"),
                                       "decisions", "items", "resolved")


@query("project_highlights", with_("rollup", """SELECT project_id, CAST(i AS INTEGER) AS line_no, CASE WHEN meeting_count = 0 THEN 'Project initialized.' WHEN i = 0 THEN 'Processed ' || CAST(meeting_count AS VARCHAR) || ' meeting sessions under ' || coalesce(company, 'Project Agenda') || '.'
  WHEN i = 1 THEN 'Extracted ' || CAST(decisions AS VARCHAR) || ' key organizational decisions.' ELSE 'Identified ' || CAST(items AS VARCHAR) || ' action items (' || CAST(resolved AS VARCHAR) || ' completed).' END AS line
  FROM rollup, range(3) r(i) WHERE meeting_count > 0 OR i = 0"""))
def _(spark, path):
    return D.project_highlights(_rollup(spark, path))


THEMES = """, named AS (SELECT m.project_id, trim(t.title) AS theme, t.meeting_id, m.date, t.topic_no, m.title AS meeting_title FROM topics t JOIN meetings m USING (meeting_id)
  WHERE m.status IN ('done', 'completed') AND m.project_id IS NOT NULL)
"""


@query("project_themes", with_(["topics", "meetings"], THEMES + """SELECT project_id, theme, count(DISTINCT meeting_id) AS frequency, min(date) AS first_seen,
  arg_min(meeting_id, (date, meeting_id, topic_no)) AS first_meeting, arg_min(topic_no, (date, meeting_id, topic_no)) AS first_topic_no FROM named GROUP BY 1, 2"""))
def _(spark, path):
    return D.project_themes(O.topics(spark, path), O.meetings(spark, path))


@query("theme_meetings", with_(["topics", "meetings"], THEMES + "SELECT DISTINCT project_id, theme, meeting_id, meeting_title FROM named"))
def _(spark, path):
    return D.theme_meetings(O.topics(spark, path), O.meetings(spark, path))


@query("project_consolidated_items", with_(["items", "meetings"], """SELECT m.project_id, m.date, i.meeting_id, i.segment_index, i.item_id, m.title AS meeting_title, strftime(m.date, '%b %d, %Y') AS meeting_date,
  i.description, coalesce(i.owner, 'Unassigned') AS owner, i.urgency, i.resolved FROM items i JOIN meetings m USING (meeting_id) WHERE m.status IN ('done', 'completed') AND m.project_id IS NOT NULL"""))
def _(spark, path):
    return D.project_consolidated_items(O.action_items(spark, path), O.meetings(spark, path))


@query("project_narrative", with_(["rollup", "meetings", "topics", "decisions"], """, done AS (SELECT *, strftime(date, '%b %d, %Y') AS shown FROM meetings WHERE status IN ('done', 'completed') AND project_id IS NOT NULL)
SELECT project_id, 0 AS part, NULL::TIMESTAMP AS date, '' AS meeting_id, 0 AS line_no, CASE WHEN meeting_count = 0 THEN 'Project ''' || name || ''' initialized. No completed meeting transcriptions recorded yet. Upload meeting audio recordings to automatically generate multi-meeting intelligence.'
  ELSE 'Cumulative intelligence for ''' || name || ''' across ' || CAST(meeting_count AS VARCHAR) || ' meeting(s). Total recorded discussion time: ' ||
  CAST(CAST(floor(total_duration_seconds) AS BIGINT) // 60 AS VARCHAR) || 'm ' || CAST(CAST(floor(total_duration_seconds) AS BIGINT) % 60 AS VARCHAR) || 's.' END AS line FROM rollup
UNION ALL SELECT d.project_id, 1, d.date, d.meeting_id, 0, '• Meeting ''' || d.title || ''' (' || d.shown || '): Covered topics [' || coalesce(t.covered, 'General discussion') || '].' FROM done d
  LEFT JOIN (SELECT meeting_id, string_agg(title, ', ' ORDER BY topic_no) AS covered FROM topics GROUP BY 1) t USING (meeting_id)
UNION ALL SELECT project_id, 2, NULL, '', 0, 'Key Decisions Made Across Meetings (' || CAST(decisions AS VARCHAR) || '):' FROM rollup WHERE meeting_count > 0 AND decisions > 0
UNION ALL SELECT project_id, 3, date, meeting_id, rn, '- [' || shown || '] ' || description || ' (' || title || ')' FROM (
  SELECT d.*, m.project_id, m.date, m.title, m.shown, CAST(ROW_NUMBER() OVER (PARTITION BY m.project_id ORDER BY m.date, d.meeting_id, d.segment_index, d.decision_id) AS INTEGER) AS rn FROM decisions d JOIN done m USING (meeting_id)) WHERE rn <= 5"""))
def _(spark, path):
    return D.project_narrative(O.projects(spark, path), _rollup(spark, path), O.meetings(spark, path),
                               O.topics(spark, path), O.decisions(spark, path))


@query("project_listing", with_(["rollup", "meetings"], """SELECT r.project_id, r.name, r.company, coalesce(c.n, 0) AS meeting_count, round(r.total_duration_seconds / 60.0::DOUBLE, 1) AS total_duration_minutes,
  CASE WHEN r.meeting_count > 0 THEN 'summarised' ELSE 'No summary available.' END AS summary FROM rollup r LEFT JOIN (SELECT project_id, count(*) AS n FROM meetings GROUP BY 1) c USING (project_id)"""))
def _(spark, path):
    return D.project_listing(O.projects(spark, path), O.meetings(spark, path), _rollup(spark, path))


@query("project_meetings", with_("counts", """SELECT project_id, meeting_id, title, date, status, round(duration, 1) AS duration_seconds, topics AS topics_count, items AS action_items_count FROM counts WHERE project_id IS NOT NULL"""))
def _(spark, path):
    return D.project_meetings(_counts(spark, path))


REPORT = """, rep AS (SELECT p.project_id, p.name, coalesce(p.company, '—') AS company, coalesce(c.n, 0) AS meetings, coalesce(c.s, 0) AS total_seconds, CAST(coalesce(c.o, 0) AS BIGINT) AS open_items,
  CAST(coalesce(c.d, 0) AS BIGINT) AS decisions, CAST(coalesce(c.r, 0) AS BIGINT) AS recurring_topics FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n, sum(duration) AS s,
  sum(items - resolved) AS o, sum(decisions) AS d, sum(recurring) AS r FROM counts WHERE status = 'done' GROUP BY 1) c USING (project_id))
"""


@query("project_report_header", with_(["projects", "counts"], REPORT + """SELECT project_id, name, company, meetings, open_items, decisions, recurring_topics,
  CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || ' s' WHEN s >= 3600 THEN CAST(s // 3600 AS VARCHAR) || ' h ' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ' min'
  ELSE CAST(s // 60 AS VARCHAR) || ' min ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || ' s' END AS total_time FROM (SELECT *, CAST(floor(round(total_seconds, 6)) AS BIGINT) AS s FROM rep)"""))
def _(spark, path):
    return D.project_report_tables(O.projects(spark, path), _counts(spark, path))[0].drop("total_seconds")


@query("project_report_meetings", with_("counts", """SELECT project_id, meeting_id, strftime(date, '%d %B %Y') AS date, title, decisions, items AS actions, items - resolved AS open FROM counts WHERE status = 'done' AND project_id IS NOT NULL"""))
def _(spark, path):
    return D.project_report_tables(O.projects(spark, path), _counts(spark, path))[1]


@query("dashboard_stats", with_(["items", "meetings"], """SELECT * FROM (SELECT count(*) FILTER (NOT resolved) AS open_items, count(*) FILTER (resolved) AS resolved_items,
  count(*) FILTER (NOT resolved AND urgency IN ('critical', 'high')) AS urgent_open FROM items), (SELECT count(*) AS meetings_total, count(*) FILTER (status = 'done') AS meetings_done,
  count(*) FILTER (status IN ('queued', 'transcribing', 'structuring')) AS meetings_processing, count(*) FILTER (status = 'error') AS meetings_error FROM meetings)"""))
def _(spark, path):
    return D.dashboard_stats(O.action_items(spark, path), O.meetings(spark, path))


@query("most_urgent_open", with_("items", """SELECT item_id, meeting_id, urgency FROM items WHERE NOT resolved AND urgency IN ('critical', 'high')
  ORDER BY CASE urgency WHEN 'critical' THEN 0 ELSE 1 END, meeting_id, segment_index LIMIT 5"""))
def _(spark, path):
    return D.most_urgent_open(O.action_items(spark, path)).select("item_id", "meeting_id", "urgency")


# -- sequences -------------------------------------------------------------------------

@query("topic_timeline", with_(["topics", "durations"], SPANS + """SELECT topic_id, span_no, round(greatest(span_end - span_start, duration * 0.01), 6) AS drawn_width,
  round((span_end - span_start) / duration, 6) AS share FROM spans WHERE duration > 0"""))
def _(spark, path):
    return E.topic_timeline(_spans(spark, path)).select("topic_id", "span_no", r6("drawn_width"), r6("share"))


@query("item_register", with_("items", """SELECT item_id, n AS number, CAST((n - 1) // 7 AS INTEGER) AS page FROM (SELECT item_id, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY segment_index, item_id) AS n FROM items)"""))
def _(spark, path):
    return E.item_register(O.action_items(spark, path)).select("item_id", "number", "page")


@query("carry_forward_progress", f"""WITH {STATUS_SQL}, a AS (SELECT *, CASE WHEN lag(status) OVER w = status THEN 0 ELSE 1 END AS fresh FROM status_events WINDOW w AS (PARTITION BY meeting_id ORDER BY event_time, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY meeting_id ORDER BY event_time, event_id) AS island FROM a)
SELECT event_id, status, round(last_value(progress IGNORE NULLS) OVER (PARTITION BY meeting_id, island ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING), 6) AS progress FROM b""")
def _(spark, path):
    return E.carry_forward_progress(status_events(spark, path)).select("event_id", "status", r6("progress"))


@query("stage_transitions", f"""WITH {STATUS_SQL}, a AS (SELECT *, lag(status) OVER w AS p, lag(event_time) OVER w AS pt FROM status_events WINDOW w AS (PARTITION BY meeting_id ORDER BY event_time, event_id))
SELECT event_id, status, p AS previous_status, round((epoch_us(event_time) - epoch_us(pt)) / 1000000.0::DOUBLE, 6) AS seconds_in_previous,
  CASE WHEN p IS NULL THEN status = 'queued' ELSE p = status OR (p || '>' || status) IN ('queued>transcribing', 'queued>error', 'transcribing>structuring',
  'transcribing>error', 'structuring>done', 'structuring>error') END AS allowed FROM a""")
def _(spark, path):
    return E.stage_transitions(status_events(spark, path)).select(
        "event_id", "status", "previous_status", r6("seconds_in_previous"), "allowed")


@query("pause_sections", """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS section FROM g""")
def _(spark, path):
    e = X.table(spark, path, "events").select("user_id", "event_id", "ts")
    return E.pause_sections(e, "user_id", "ts", "event_id", 6 * 3600.0).select("event_id", "section")


@query("pause_chunks", """WITH RECURSIVE g AS (SELECT user_id, event_id, ts, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER w AS p, ROW_NUMBER() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
walk AS (SELECT user_id, n, event_id, t, t AS start FROM g WHERE n = 1
  UNION ALL SELECT g.user_id, g.n, g.event_id, g.t, CASE WHEN g.t - w.start >= 172800000000 OR (g.t - g.p >= 21600000000 AND g.t - w.start >= 43200000000) THEN g.t ELSE w.start END
  FROM walk w JOIN g ON g.user_id = w.user_id AND g.n = w.n + 1)
SELECT event_id, start AS chunk_start FROM walk""")
def _(spark, path):
    e = X.table(spark, path, "events").select("user_id", "event_id", "ts")
    return E.pause_chunks(e, "user_id", "ts", "event_id", 6 * 3600.0, 12 * 3600.0, 48 * 3600.0).select(
        "event_id", "chunk_start")


@query("quiet_chunks", """WITH RECURSIVE g AS (SELECT user_id, ts, coalesce(CAST(round(value * value * 1e6) AS BIGINT), 0) AS e, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS size FROM events),
q AS (SELECT *, CASE WHEN n + 4 <= size AND sum(e) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) < 40.0 * 40.0 * 1e6 * 4 THEN n END AS quiet FROM g),
l AS (SELECT *, max(quiet) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 6 FOLLOWING AND 16 FOLLOWING) AS latest FROM q),
s AS (SELECT *, CASE WHEN latest IS NOT NULL THEN latest + 2 WHEN n + 20 < size THEN n + 20 END AS next FROM l),
walk AS (SELECT user_id, n, next FROM s WHERE n = 0 UNION ALL SELECT s.user_id, s.n, s.next FROM walk w JOIN s ON s.user_id = w.user_id AND s.n = w.next)
SELECT user_id, s.n AS first, coalesce(s.next, s.size) - s.n AS rows, s.ts AS chunk_start, z.ts AS chunk_end, CASE WHEN s.latest IS NOT NULL THEN 'quiet' WHEN s.next IS NOT NULL THEN 'full' ELSE 'end' END AS ended_by
FROM walk JOIN s USING (user_id, n) JOIN (SELECT user_id, n AS final, ts FROM g) z USING (user_id) WHERE z.final = coalesce(s.next, s.size) - 1""")
def _(spark, path):
    e = X.table(spark, path, "events").select("user_id", "event_id", "ts", "value")
    return E.quiet_chunks(e, "user_id", "ts", "event_id", "value", 40.0, 4, 6, 20)


@query("level_windows", """WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events)
SELECT event_type, window_start, round(sqrt(avg(value * value)), 6) AS rms, count(*) AS samples, sqrt(avg(value * value)) < 5 AS quiet FROM w GROUP BY 1, 2""")
def _(spark, path):
    e = X.table(spark, path, "events")
    return E.level_windows(e, ["event_type"], "ts", "value", "60 minutes", "30 minutes", 5.0).select(
        "event_type", "window_start", r6("rms"), "samples", "quiet")


@query("dedupe_by_id", """SELECT 's' || CAST(o_orderkey AS VARCHAR) AS segment_id, o_orderkey AS segment_index FROM orders""")
def _(spark, path):
    o = X.table(spark, path, "orders").select(
        F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("segment_id"),
        F.col("o_orderkey").alias("segment_index"), F.lit(0).alias("arrival"))
    again = o.filter(F.col("segment_index") % 4 == 0).withColumn("arrival", F.lit(1))
    return E.dedupe_by_id(o.unionByName(again)).select("segment_id", "segment_index")


@query("next_agenda", with_(["meetings", "glance_items", "decisions"], """, lines AS (
  SELECT meeting_id, 0 AS part, rn, 'Settle: ' || description AS line FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY segment_index, item_id) AS rn FROM glance_items WHERE is_question)
  UNION ALL SELECT meeting_id, 1, rn, 'Status of: ' || description || CASE WHEN owner IS NULL THEN '' ELSE ' (' || owner || ')' END FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY segment_index, item_id) AS rn FROM glance_items WHERE NOT is_question AND NOT resolved) WHERE rn <= 6
  UNION ALL SELECT meeting_id, 2, rn, 'Review decision: ' || description FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY segment_index, decision_id) AS rn FROM decisions) WHERE rn <= 2),
 numbered AS (SELECT meeting_id, CAST(ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY part, rn) AS INTEGER) AS line_no, line FROM lines)
SELECT m.meeting_id, coalesce(n.line_no, 1) AS line_no, coalesce(n.line, 'Review progress on the items above.') AS line FROM meetings m LEFT JOIN (SELECT * FROM numbered WHERE line_no <= 8) n USING (meeting_id)"""))
def _(spark, path):
    return B.next_agenda(O.action_items(spark, path), O.decisions(spark, path), O.meetings(spark, path))


# -- maintenance ---------------------------------------------------------------------------

def item_patches(spark, path):
    """Event rows as item patches: two events address one item, the event type names the field."""
    e = X.table(spark, path, "events")
    kind = F.col("event_type")
    fields = (F.when(kind == "click", F.array(F.lit("owner"))).when(kind == "view", F.array(F.lit("urgency")))
              .when(kind == "signup", F.array(F.lit("resolved"))).when(kind == "purchase", F.array(F.lit("due")))
              .otherwise(F.array(F.lit("description"), F.lit("owner"))))
    return e.select(
        F.concat(F.lit("a"), F.floor(F.col("event_id") / 2).cast("string")).alias("item_id"),
        F.col("event_id").alias("patch_id"), F.col("ts").alias("patch_time"), fields.alias("set_fields"),
        F.when(kind == "click", F.lit("Zoe")).alias("owner"), F.when(kind == "view", F.lit("high")).alias("urgency"),
        F.when(kind == "signup", F.col("event_id") % 2 == 0).alias("resolved"),
        F.when(kind == "purchase", F.lit("by noon")).alias("due"),
        F.when(kind == "error", F.concat(F.lit("Patched "), F.col("event_id").cast("string"))).alias("description"))


def _patched(kind: str, value: str, types: str) -> str:
    return f"""LEFT JOIN (SELECT event_id // 2 AS k, arg_max(event_id, (ts, event_id)) AS e, arg_max({value}, (ts, event_id)) AS v FROM
  (SELECT *, CASE event_type WHEN 'click' THEN 'Zoe' ELSE '' END AS new_owner FROM events) WHERE event_type IN ({types}) GROUP BY 1) {kind} ON 'a' || CAST({kind}.k AS VARCHAR) = i.item_id"""


@query("apply_item_updates", with_("items", f"""SELECT i.item_id, CASE WHEN o.e IS NULL THEN i.owner ELSE nullif(o.v, '') END AS owner, CASE WHEN u.e IS NULL THEN i.urgency ELSE 'high' END AS urgency,
  CASE WHEN r.e IS NULL THEN i.resolved ELSE r.e % 2 = 0 END AS resolved, CASE WHEN d.e IS NULL THEN i.due ELSE 'by noon' END AS due,
  CASE WHEN x.e IS NULL THEN i.description ELSE 'Patched ' || CAST(x.e AS VARCHAR) END AS description FROM items i
  {_patched('o', 'new_owner', "'click', 'error'")} {_patched('u', 'event_id', "'view'")} {_patched('r', 'event_id', "'signup'")}
  {_patched('d', 'event_id', "'purchase'")} {_patched('x', 'event_id', "'error'")}"""))
def _(spark, path):
    return M.apply_item_updates(O.action_items(spark, path), item_patches(spark, path)).select(
        "item_id", "owner", "urgency", "resolved", "due", "description")


def transcript_edits(spark, path):
    e = X.table(spark, path, "events")
    return e.select(
        F.floor(F.col("user_id") / 2).cast("string").alias("meeting_id"), (F.col("event_id") % 8).cast("int").alias("segment_index"),
        F.col("event_id").alias("edit_id"),
        F.concat(F.lit(" fixed "), F.floor(F.col("value") / 10).cast("string"), F.lit(" ")).alias("new_text"),
        F.col("event_type").alias("edited_by"), F.col("ts").alias("edited_at"))


EDITED = """, edits AS (SELECT e.event_id AS edit_id, c.meeting_id, c.segment_index, c.speaker, c.text AS original, 'fixed ' || CAST(CAST(floor(e.value / 10) AS BIGINT) AS VARCHAR) AS new_text, e.event_type AS edited_by, e.ts AS edited_at
  FROM events e JOIN conv c ON c.meeting_id = CAST(e.user_id // 2 AS VARCHAR) AND c.segment_index = e.event_id % 8)
"""


def _edited(spark, path):
    return M.apply_transcript_edits(X.conversations_as_utterances(X.table(spark, path, "conversations")), transcript_edits(spark, path))


@query("transcript_edit_audit", with_("conv", EDITED + """SELECT edit_id, meeting_id, segment_index, speaker, old_text, new_text, edited_by, edited_at FROM (
  SELECT *, coalesce(lag(new_text) OVER (PARTITION BY meeting_id, segment_index ORDER BY edited_at, edit_id), original) AS old_text FROM edits) WHERE old_text <> new_text"""))
def _(spark, path):
    return M.edit_history(_edited(spark, path)[1])


@query("apply_transcript_edits", with_("conv", EDITED + """SELECT c.meeting_id, c.segment_index, coalesce(e.t, c.text) AS text FROM conv c LEFT JOIN (
  SELECT meeting_id, segment_index, arg_max(new_text, (edited_at, edit_id)) AS t FROM edits GROUP BY 1, 2) e USING (meeting_id, segment_index)"""))
def _(spark, path):
    return _edited(spark, path)[0].select("meeting_id", "segment_index", "text")


def _failed(spark, path):
    return O.meetings(spark, path).filter(F.col("status") == "error")


@query("purge_meetings", with_(["items", "meetings"], "SELECT item_id FROM items WHERE meeting_id NOT IN (SELECT meeting_id FROM meetings WHERE status = 'error')"))
def _(spark, path):
    return M.purge({"items": O.action_items(spark, path)}, _failed(spark, path))["items"].select("item_id")


@query("purge_projects", with_(["decisions", "meetings", "projects"], """SELECT decision_id FROM decisions WHERE meeting_id NOT IN (SELECT m.meeting_id FROM meetings m JOIN projects p USING (project_id) WHERE p.company IS NULL)"""))
def _(spark, path):
    m, p = _world(spark, path)
    return M.purge_projects({"decisions": O.decisions(spark, path)}, m, p.filter(F.col("company").isNull()))["decisions"].select("decision_id")


@query("touched_projects", with_("meetings", "SELECT DISTINCT project_id FROM meetings WHERE status = 'error' AND project_id IS NOT NULL"))
def _(spark, path):
    return M.touched_projects(O.meetings(spark, path), _failed(spark, path))


def _manual(spark, path):
    contexts = O.topics(spark, path).select("meeting_id").distinct()
    new = O.meetings(spark, path).filter(F.col("status") == "queued").select(
        "meeting_id", F.concat(F.lit("m"), F.col("meeting_id")).alias("item_id"), F.lit("Call back").alias("description"),
        F.lit(None).cast("string").alias("urgency"), F.lit(False).alias("resolved"))
    return M.add_manual_items(O.action_items(spark, path), contexts, new)


@query("add_manual_items", with_(["items", "meetings"], """SELECT item_id, meeting_id, description, urgency, confidence FROM items
  UNION ALL SELECT 'm' || meeting_id, meeting_id, 'Call back', 'medium', 1.0 FROM meetings WHERE status = 'queued'"""))
def _(spark, path):
    return _manual(spark, path)[0].select("item_id", "meeting_id", "description", "urgency", "confidence")


@query("contexts_after_manual_items", with_(["topics", "meetings"], "SELECT meeting_id FROM topics UNION SELECT meeting_id FROM meetings WHERE status = 'queued'"))
def _(spark, path):
    return _manual(spark, path)[1]


@query("meetings_without_segments", with_(["meetings", "ord"], "SELECT meeting_id, title, 'error' AS status FROM meetings WHERE meeting_id NOT IN (SELECT meeting_id FROM ord WHERE o_orderstatus = 'P')"))
def _(spark, path):
    heard = X.orders_as_utterances(X.table(spark, path, "orders").filter("o_orderstatus = 'P'"))
    return M.meetings_without_segments(O.meetings(spark, path), heard).select("meeting_id", "title", "status")


def payloads(spark, path):
    """A JSON result per order of every fourth customer; some texts are cut and do not parse."""
    o = X.table(spark, path, "orders").filter(F.col("o_custkey") % 4 == 0)
    k = F.col("o_orderkey")
    item = F.struct(F.concat(F.lit(" Pay order "), k.cast("string")).alias("description"), F.lit("Ana").alias("owner"),
                    F.when(k % 2 == 0, "today").alias("due"), F.when(k % 3 == 0, "high").otherwise("whenever").alias("urgency"),
                    F.lit("").alias("evidence"), ((k % 10) / 10.0).alias("confidence"), F.lit(0).alias("segment_index"))
    text = F.to_json(F.struct(F.lit("s").alias("summary"), F.array(item).alias("action_items")))
    return o.select(F.col("o_custkey").cast("string").alias("meeting_id"),
                    F.when(k % 97 == 0, F.lit("{oops")).otherwise(text).alias("payload"))


@query("merge_extraction_sources", with_(["items"], """, ext AS (SELECT CAST(o_custkey AS VARCHAR) AS meeting_id, o_orderkey AS k FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey % 97 <> 0)
SELECT meeting_id, 'Pay order ' || CAST(k AS VARCHAR) AS description, CASE WHEN k % 3 = 0 THEN 'high' WHEN k % 2 = 0 THEN 'critical' ELSE 'low' END AS urgency, (k % 10) / 10.0::DOUBLE AS confidence, 'external' AS origin
  FROM ext WHERE (k % 10) / 10.0::DOUBLE >= 0.45
UNION ALL SELECT meeting_id, description, urgency, confidence, 'local' FROM items WHERE meeting_id NOT IN (SELECT meeting_id FROM ext)"""))
def _(spark, path):
    merged, _ = M.merge_extraction_sources(payloads(spark, path), O.action_items(spark, path), O.decisions(spark, path))
    return merged.select("meeting_id", "description", "urgency", "confidence", "origin")


@query("merge_summaries", with_(["meetings"], """, ext AS (SELECT CAST(o_custkey AS VARCHAR) AS meeting_id, count(*) AS n, max(o_orderkey) AS k FROM orders WHERE o_custkey % 4 = 0 GROUP BY 1),
own AS (SELECT meeting_id, n, k FROM ext WHERE n % 5 <> 0)
SELECT meeting_id, 0 AS part, 0 AS n, 'Orders: ' || CAST(n AS VARCHAR) AS line FROM own UNION ALL SELECT meeting_id, 0, 1, '- last is ' || CAST(k AS VARCHAR) FROM own
UNION ALL SELECT meeting_id, 1, 0, title FROM meetings WHERE meeting_id NOT IN (SELECT meeting_id FROM own)"""))
def _(spark, path):
    held = X.table(spark, path, "orders").where("o_custkey % 4 = 0").groupBy(F.col("o_custkey").cast("string").alias("meeting_id")).agg(
        F.count("*").alias("n"), F.max("o_orderkey").alias("k"))
    said = F.when(F.col("n") % 5 == 0, " \n").otherwise(F.concat(F.lit("Orders: "), F.col("n").cast("string"), F.lit("\n- last is "), F.col("k").cast("string"), F.lit("\n")))
    texts = held.select("meeting_id", F.to_json(F.struct(said.alias("summary"))).alias("payload"))
    local = O.meetings(spark, path).select("meeting_id", F.lit(1).alias("part"), F.lit(0).alias("n"), F.col("title").alias("line"))
    return M.merge_summaries(texts, local)


@query("merge_topics", with_(["topics"], """, ext AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS meeting_id, o_orderkey AS k FROM orders WHERE o_custkey % 4 = 0 AND o_orderkey % 97 <> 0)
SELECT meeting_id, 0 AS topic_no, 'Order ' || CAST(k AS VARCHAR) AS title, NULL::DOUBLE AS start_time FROM ext UNION ALL SELECT meeting_id, 1, 'Payment', NULL FROM ext
UNION ALL SELECT meeting_id, topic_no, title, start_time FROM topics WHERE meeting_id NOT IN (SELECT meeting_id FROM ext)"""))
def _(spark, path):
    o = X.table(spark, path, "orders").where("o_custkey % 4 = 0")
    topic = lambda title: F.struct(title.alias("title"), F.lit("s").alias("summary"))
    named = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    text = F.to_json(F.struct(F.array(topic(named), topic(F.lit("Payment"))).alias("topics")))
    texts = o.select(F.col("o_custkey").cast("string").alias("meeting_id"), F.when(F.col("o_orderkey") % 97 == 0, F.lit("{oops")).otherwise(text).alias("payload"))
    return M.merge_topics(texts, O.topics(spark, path)).select("meeting_id", F.col("topic_no").cast("int").alias("topic_no"), "title", "start_time")
