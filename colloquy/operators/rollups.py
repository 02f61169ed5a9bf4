"""Per-meeting, per-project and dashboard aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.text import strip
from .blocks import index_block, row_index
from .filters import split_items, top_k

TITLES_PER_LINE = 100


def is_done() -> Column:
    return F.col("status").isin("done", "completed")


def meeting_duration(segments: DataFrame) -> DataFrame:
    return segments.groupBy("meeting_id").agg(
        F.greatest(F.max("end_time") - F.min("start_time"), F.lit(0.0)).alias("duration"))


def named_segments(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Segments with the display name of their speaker."""
    names = speakers.select("meeting_id", F.col("label").alias("speaker"), "name")
    return segments.join(names, ["meeting_id", "speaker"], "left").withColumn(
        "display_name", F.coalesce(F.nullif("name", F.lit("")), "speaker")).drop("name")


def talk_time(segments: DataFrame, by: str = "display_name") -> DataFrame:
    """Seconds, share of the meeting and number of turns per speaker."""
    per = segments.groupBy("meeting_id", by).agg(
        F.sum(F.greatest(F.col("end_time") - F.col("start_time"), F.lit(0.0))).alias("seconds"),
        F.count("*").alias("turns"))
    total = per.groupBy("meeting_id").agg(F.sum("seconds").alias("__total"))
    share = F.col("seconds") / F.when(F.col("__total") == 0, F.lit(1.0)).otherwise(F.col("__total"))
    return per.join(total, "meeting_id").withColumn("share", share).drop("__total")


def speaker_count(segments: DataFrame) -> DataFrame:
    return segments.groupBy("meeting_id").agg(
        F.greatest(F.count_distinct("speaker"), F.lit(1)).alias("speakers"))


def meeting_glance(meetings: DataFrame, topics: DataFrame, items: DataFrame, decisions: DataFrame,
                   segments: DataFrame) -> DataFrame:
    """Counts shown at the top of the minutes.  ``completed`` counts all items, ``open_tasks`` tasks only."""
    t = topics.groupBy("meeting_id").agg(F.count("*").alias("topics"))
    d = decisions.groupBy("meeting_id").agg(F.count("*").alias("decisions"))
    a = split_items(items).groupBy("meeting_id").agg(
        F.count_if("is_task").alias("tasks"), F.count_if(F.col("is_task") & F.col("is_open")).alias("open_tasks"),
        F.count_if("is_done").alias("completed"), F.count_if("is_question").alias("open_questions"))
    s = segments.groupBy("meeting_id").agg(F.count_distinct("display_name").alias("participants"))
    out = meetings.select("meeting_id")
    for part in (t, d, a, s):
        out = out.join(part, "meeting_id", "left")
    return out.fillna(0)


def items_by_priority(items: DataFrame, by: Sequence[str] = ("meeting_id",)) -> DataFrame:
    return (items.groupBy(*by, F.lower(F.coalesce("urgency", F.lit("low"))).alias("urgency"))
            .agg(F.count("*").alias("items")).withColumn("priority_rank", L.urgency_rank(F.col("urgency"))))


def items_by_owner(items: DataFrame, by: Sequence[str] = ("meeting_id",), k: int = 10) -> DataFrame:
    counted = items.groupBy(*by, F.coalesce(F.nullif("owner", F.lit("")), F.lit("Unassigned")).alias("owner")).agg(
        F.count("*").alias("items"))
    order = [(F.col("owner") == "Unassigned").cast("int"), F.col("items").desc(), F.col("owner")]
    return top_k(counted, by, order, k)


def items_by_status(items: DataFrame, by: Sequence[str] = ("meeting_id",)) -> DataFrame:
    return items.groupBy(*by).agg(F.count_if(~F.col("resolved")).alias("open"), F.count_if("resolved").alias("done"))


def _per_meeting_counts(items: DataFrame, decisions: DataFrame, segments: DataFrame, topics: DataFrame) -> list[DataFrame]:
    return [
        meeting_duration(segments),
        decisions.groupBy("meeting_id").agg(F.count("*").alias("decisions")),
        items.groupBy("meeting_id").agg(F.count("*").alias("items"), F.count_if("resolved").alias("resolved")),
        topics.groupBy("meeting_id").agg(F.count("*").alias("topics"), F.count_if("is_recurring").alias("recurring")),
    ]


def meeting_counts(meetings: DataFrame, items: DataFrame, decisions: DataFrame, segments: DataFrame,
                   topics: DataFrame) -> DataFrame:
    """One row per meeting with child counts; children are reduced before they are joined."""
    out = meetings
    for part in _per_meeting_counts(items, decisions, segments, topics):
        out = out.join(part, "meeting_id", "left")
    return out.fillna(0, ["decisions", "items", "resolved", "topics", "recurring"]).fillna(0.0, ["duration"])


def project_rollup(projects: DataFrame, counts: DataFrame) -> DataFrame:
    """Totals over finished meetings of every project, empty projects included."""
    per = counts.filter(is_done()).groupBy("project_id").agg(
        F.count("*").alias("meeting_count"), F.sum("duration").alias("total_duration_seconds"),
        F.sum("decisions").alias("decisions"), F.sum("items").alias("items"), F.sum("resolved").alias("resolved"))
    return (projects.select("project_id", "name", "company").join(per, "project_id", "left")
            .fillna(0, ["meeting_count", "decisions", "items", "resolved"])
            .fillna(0.0, ["total_duration_seconds"]))


def empty_project_text(name: Column) -> Column:
    return F.concat(
        F.lit("Project '"), name, F.lit("' initialized. No completed meeting transcriptions recorded yet. "),
        F.lit("Upload meeting audio recordings to automatically generate multi-meeting intelligence."))


def project_highlights(rollup: DataFrame) -> DataFrame:
    """Highlight lines per project."""
    lines = [
        F.concat(F.lit("Processed "), F.col("meeting_count").cast("string"), F.lit(" meeting sessions under "),
                 F.coalesce(F.nullif("company", F.lit("")), F.lit("Project Agenda")), F.lit(".")),
        F.concat(F.lit("Extracted "), F.col("decisions").cast("string"), F.lit(" key organizational decisions.")),
        F.concat(F.lit("Identified "), F.col("items").cast("string"), F.lit(" action items ("),
                 F.col("resolved").cast("string"), F.lit(" completed).")),
    ]
    texts = F.when(F.col("meeting_count") == 0, F.array(F.lit("Project initialized."))).otherwise(F.array(*lines))
    return rollup.select("project_id", F.posexplode(texts).alias("line_no", "line"))


def project_themes(topics: DataFrame, meetings: DataFrame) -> DataFrame:
    """Topic title -> number of distinct finished meetings; ``first_seen`` breaks ties.

    Members are not gathered into a list: join ``theme_meetings`` where they are needed.
    """
    m = meetings.filter(is_done() & F.col("project_id").isNotNull()).select("meeting_id", "project_id", "date")
    named = topics.join(m, "meeting_id").withColumn("theme", strip(F.col("title")))
    first = F.struct("date", "meeting_id", "topic_no")
    return (named.groupBy("project_id", "theme", "meeting_id").agg(F.min(first).alias("f"))
            .groupBy("project_id", "theme").agg(F.count("*").alias("frequency"), F.min("f").alias("f"))
            .select("project_id", "theme", "frequency", F.col("f.date").alias("first_seen"),
                    F.col("f.meeting_id").alias("first_meeting"), F.col("f.topic_no").alias("first_topic_no")))


def theme_meetings(topics: DataFrame, meetings: DataFrame) -> DataFrame:
    m = meetings.filter(is_done() & F.col("project_id").isNotNull()).select(
        "meeting_id", "project_id", F.col("title").alias("meeting_title"))
    return (topics.join(m, "meeting_id").select(
        "project_id", strip(F.col("title")).alias("theme"), "meeting_id", "meeting_title").distinct())


def project_consolidated_items(items: DataFrame, meetings: DataFrame) -> DataFrame:
    """All items of finished meetings; order by (project_id, date, meeting_id, segment_index)."""
    m = meetings.filter(is_done() & F.col("project_id").isNotNull()).select(
        "meeting_id", "project_id", F.col("title").alias("meeting_title"), "date",
        F.coalesce(F.date_format("date", "MMM dd, yyyy"), F.lit("Unknown Date")).alias("meeting_date"))
    return items.join(m, "meeting_id").select(
        "project_id", "date", "meeting_id", "segment_index", "item_id", "meeting_title", "meeting_date", "description",
        F.coalesce(F.nullif("owner", F.lit("")), F.lit("Unassigned")).alias("owner"), "urgency", "resolved")


def project_narrative(projects: DataFrame, rollup: DataFrame, meetings: DataFrame, topics: DataFrame,
                      decisions: DataFrame) -> DataFrame:
    """Narrative as ordered lines: (project_id, part, date, meeting_id, line_no, line).

    Lines instead of one string keep a project with very many meetings spread out;
    a text sink writes them in (part, date, meeting_id, line_no) order.
    """
    total = F.floor("total_duration_seconds").cast("long")
    blank_date, blank_meeting = F.lit(None).cast("timestamp"), F.lit("")
    head = rollup.select(
        "project_id", F.lit(0).alias("part"), blank_date.alias("date"), blank_meeting.alias("meeting_id"),
        F.lit(0).alias("line_no"),
        F.when(F.col("meeting_count") == 0, empty_project_text(F.col("name"))).otherwise(F.concat(
            F.lit("Cumulative intelligence for '"), F.col("name"), F.lit("' across "),
            F.col("meeting_count").cast("string"), F.lit(" meeting(s). Total recorded discussion time: "),
            F.floor(total / 60).cast("string"), F.lit("m "), (total % 60).cast("string"), F.lit("s."))).alias("line"))
    done = meetings.filter(is_done() & F.col("project_id").isNotNull()).withColumn(
        "shown_date", F.coalesce(F.date_format("date", "MMM dd, yyyy"), F.lit("Unknown Date")))
    numbered = row_index(topics, ["meeting_id"], index_block("topic_no"), ["topic_no", "topic_id"], "n")
    pages = numbered.groupBy("meeting_id", F.floor(F.col("n") / TITLES_PER_LINE).cast("int").alias("page")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "title"))), lambda t: t["title"]), ", ")
        .alias("covered"))
    last = pages.groupBy("meeting_id").agg(F.max("page").alias("last_page"))
    prefix = F.concat(F.lit("• Meeting '"), F.col("title"), F.lit("' ("), F.col("shown_date"),
                      F.lit("): Covered topics ["))
    page = F.coalesce("page", F.lit(0))
    snippets = done.join(pages.join(last, "meeting_id"), "meeting_id", "left").select(
        "project_id", F.lit(1).alias("part"), "date", "meeting_id", page.alias("line_no"),
        F.concat(F.when(page == 0, prefix).otherwise(""),
                 F.coalesce(F.nullif("covered", F.lit("")), F.lit("General discussion")),
                 F.when(page == F.coalesce("last_page", F.lit(0)), "].").otherwise(",")).alias("line"))
    heading = rollup.filter("meeting_count > 0 and decisions > 0").select(
        "project_id", F.lit(2).alias("part"), blank_date.alias("date"), blank_meeting.alias("meeting_id"),
        F.lit(0).alias("line_no"),
        F.concat(F.lit("Key Decisions Made Across Meetings ("), F.col("decisions").cast("string"), F.lit("):")).alias("line"))
    first = top_k(decisions.join(done.select("meeting_id", "project_id", "date", "title", "shown_date"), "meeting_id"),
                  ["project_id"], [F.col("date"), F.col("meeting_id"), F.col("segment_index"), F.col("decision_id")], 5)
    listed = first.select(
        "project_id", F.lit(3).alias("part"), "date", "meeting_id", F.col("rank").alias("line_no"),
        F.concat(F.lit("- ["), F.col("shown_date"), F.lit("] "), F.col("description"), F.lit(" ("), F.col("title"),
                 F.lit(")")).alias("line"))
    return head.unionByName(snippets).unionByName(heading).unionByName(listed)


def project_listing(projects: DataFrame, meetings: DataFrame, rollup: DataFrame) -> DataFrame:
    counts = meetings.groupBy("project_id").agg(F.count("*").alias("meeting_count"))
    stored = rollup.select(
        "project_id", F.round(F.col("total_duration_seconds") / 60.0, 1).alias("total_duration_minutes"),
        F.when(F.col("meeting_count") > 0, F.lit("summarised")).alias("__summary"))
    return (projects.select("project_id", "name", "company").join(counts, "project_id", "left")
            .join(stored, "project_id", "left")
            .select("project_id", "name", "company", F.coalesce("meeting_count", F.lit(0)).alias("meeting_count"),
                    F.coalesce("total_duration_minutes", F.lit(0.0)).alias("total_duration_minutes"),
                    F.coalesce("__summary", F.lit("No summary available.")).alias("summary")))


def project_meetings(counts: DataFrame) -> DataFrame:
    """Meetings per project; order by (project_id, date desc)."""
    return counts.filter(F.col("project_id").isNotNull()).select(
        "project_id", "meeting_id", "title", "date", "status", F.round("duration", 1).alias("duration_seconds"),
        F.col("topics").alias("topics_count"), F.col("items").alias("action_items_count"))


def project_report_tables(projects: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Report header per project and the table of finished meetings."""
    done = counts.filter(F.col("status") == "done")
    per = done.groupBy("project_id").agg(
        F.count("*").alias("meetings"), F.sum("duration").alias("total_seconds"),
        F.sum(F.col("items") - F.col("resolved")).alias("open_items"), F.sum("decisions").alias("decisions"),
        F.sum("recurring").alias("recurring_topics"))
    header = projects.select("project_id", "name", F.coalesce(F.nullif("company", F.lit("")), F.lit("—")).alias("company")).join(
        per, "project_id", "left").fillna(0, ["meetings", "open_items", "decisions", "recurring_topics"]).fillna(
        0.0, ["total_seconds"]).withColumn("total_time", L.format_duration(F.round("total_seconds", 6)))
    table = done.filter(F.col("project_id").isNotNull()).select(
        "project_id", "meeting_id", L.format_date(F.col("date")).alias("date"), "title", "decisions",
        F.col("items").alias("actions"), (F.col("items") - F.col("resolved")).alias("open"))
    return header, table


def dashboard_stats(items: DataFrame, meetings: DataFrame) -> DataFrame:
    """One row of totals over all items and meetings."""
    urgent = F.col("urgency").isin("critical", "high")
    a = items.agg(
        F.count_if(~F.col("resolved")).alias("open_items"), F.count_if("resolved").alias("resolved_items"),
        F.count_if(~F.col("resolved") & urgent).alias("urgent_open"))
    m = meetings.agg(
        F.count("*").alias("meetings_total"), F.count_if(F.col("status") == "done").alias("meetings_done"),
        F.count_if(F.col("status").isin("queued", "transcribing", "structuring")).alias("meetings_processing"),
        F.count_if(F.col("status") == "error").alias("meetings_error"))
    return a.withColumn("__one", F.lit(1)).join(m.withColumn("__one", F.lit(1)), "__one").drop("__one")


def most_urgent_open(items: DataFrame, k: int = 5) -> DataFrame:
    return (items.filter(~F.col("resolved") & F.col("urgency").isin("critical", "high"))
            .withColumn("priority_rank", L.urgency_rank(F.col("urgency")))
            .orderBy("priority_rank", "meeting_id", "segment_index").limit(k))
