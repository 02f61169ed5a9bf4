"""Visibility, search, item views and top-k selections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import values as V


NOTHING_NEXT = "Review progress on the items above."


def with_project_owner(meetings: DataFrame, projects: DataFrame) -> DataFrame:
    owners = projects.select("project_id", F.col("user_id").alias("project_owner"))
    return meetings.join(owners, "project_id", "left")


def visible_to(meetings: DataFrame, projects: DataFrame, user_id: str | None) -> DataFrame:
    """Meetings a user owns directly or through the project; no user sees nothing."""
    user = F.lit(user_id).cast("string")
    return (with_project_owner(meetings, projects)
            .filter((F.col("user_id") == user) | (F.col("project_owner") == user)).drop("project_owner"))


def access_flags(meetings: DataFrame, projects: DataFrame, user_id: str | None) -> DataFrame:
    return with_project_owner(meetings, projects).withColumn(
        "can_access", L.can_access(F.col("user_id"), F.col("project_owner"), F.lit(user_id).cast("string")))


def recent_meetings(meetings: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return meetings.orderBy(F.col("date").desc(), F.col("meeting_id")).offset(offset).limit(limit)


def search_meetings(meetings: DataFrame, query: str = "", status: str = "all") -> DataFrame:
    hit = F.lower("title").contains(query.strip().lower())
    return meetings.filter(hit if status == "all" else hit & (F.col("status") == status))


def filter_action_items(items: DataFrame, state: str = "all", urgency: str = "all") -> DataFrame:
    """Open, resolved or all items of one or all urgencies, with ``priority_rank`` for display order."""
    out = items
    if state != "all":
        out = out.filter(F.col("resolved") == F.lit(state == "resolved"))
    if urgency != "all":
        out = out.filter(F.col("urgency") == urgency)
    return out.withColumn("priority_rank", L.urgency_rank(F.col("urgency")))


def open_action_items(items: DataFrame) -> DataFrame:
    return items.filter(~F.col("resolved"))


def split_items(items: DataFrame) -> DataFrame:
    question = L.is_open_question(F.col("owner"), F.col("description"))
    return (items.withColumn("is_open", ~F.col("resolved")).withColumn("is_done", F.col("resolved"))
            .withColumn("is_question", question).withColumn("is_task", ~question))


def min_confidence(items: DataFrame, threshold: float = V.MIN_CONFIDENCE, drop_blank: bool = False) -> DataFrame:
    keep = F.col("confidence") >= threshold
    if drop_blank:
        keep = keep & (F.trim("description") != "")
    return items.filter(keep)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def agenda_texts() -> tuple[Column, Column, Column]:
    """Line of an open question, of an open task and of a decision."""
    owner = F.when(F.coalesce(F.col("owner"), F.lit("")) != "", F.concat(F.lit(" ("), F.col("owner"), F.lit(")"))).otherwise("")
    return (F.concat(F.lit("Settle: "), F.col("description")), F.concat(F.lit("Status of: "), F.col("description"), owner),
            F.concat(F.lit("Review decision: "), F.col("description")))


def next_agenda(items: DataFrame, decisions: DataFrame, meetings: DataFrame, cap: int = 8) -> DataFrame:
    """Open questions, then up to six open tasks, then two decisions; at most ``cap`` lines per meeting."""
    flagged = split_items(items)
    order = [F.col("segment_index"), F.col("item_id")]
    question, task, decision = agenda_texts()
    settle = top_k(flagged.filter("is_question"), ["meeting_id"], order, cap, "n").select(
        "meeting_id", F.lit(0).alias("part"), "n", question.alias("line"))
    status = top_k(flagged.filter("is_open and not is_question"), ["meeting_id"], order, 6, "n").select(
        "meeting_id", F.lit(1).alias("part"), "n", task.alias("line"))
    review = top_k(decisions, ["meeting_id"], [F.col("segment_index"), F.col("decision_id")], 2, "n").select(
        "meeting_id", F.lit(2).alias("part"), "n", decision.alias("line"))
    lines = top_k(settle.unionByName(status).unionByName(review), ["meeting_id"],
                  [F.col("part"), F.col("n")], cap, "line_no").select("meeting_id", "line_no", "line")
    return meetings.select("meeting_id").join(lines, "meeting_id", "left").select(
        "meeting_id", F.coalesce("line_no", F.lit(1)).alias("line_no"),
        F.coalesce("line", F.lit(NOTHING_NEXT)).alias("line"))
