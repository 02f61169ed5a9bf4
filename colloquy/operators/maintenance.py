"""Edits, patches, manual additions, deletes and merging of extraction results."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import values as V
from ..functions.text import strip
from ..schemas import EXTRACTION_RESULT
from .blocks import block_scan
from .sequences import day_block

PATCH_FIELDS = ["resolved", "owner", "urgency", "description", "due"]


def apply_item_updates(items: DataFrame, patches: DataFrame, tie: str = "patch_id") -> DataFrame:
    """Latest supplied value per field; a field that was never supplied keeps its value."""
    latest = patches.groupBy("item_id").agg(*[
        F.max_by(F.struct(F.col(f).alias("v")),
                 F.when(F.array_contains("set_fields", f), F.struct("patch_time", tie))).alias(f"__{f}")
        for f in PATCH_FIELDS])
    out = items.join(latest, "item_id", "left")
    for f in PATCH_FIELDS:
        out = out.withColumn(f, F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}.v")).otherwise(F.col(f)))
    return out.select(*items.columns)


def apply_transcript_edits(segments: DataFrame, edits: DataFrame, tie: str = "edit_id") -> tuple[DataFrame, DataFrame]:
    """Segments with the last edit applied, and an audit row per edit that changed the text."""
    key = ["meeting_id", "segment_index"]
    known = edits.withColumn("new_text", strip(F.col("new_text"))).join(
        segments.select(*key, F.col("text").alias("__original"), "speaker"), key)
    ordered = block_scan(known, key, day_block("edited_at"), ["edited_at", tie],
                         lags={"__before": F.col("new_text")})
    audit = (ordered.withColumn("old_text", F.coalesce("__before", "__original"))
             .filter(F.col("old_text") != F.col("new_text"))
             .select(*key, tie, "speaker", "old_text", "new_text", "edited_by", "edited_at"))
    last = known.groupBy(*key).agg(F.max_by("new_text", F.struct("edited_at", tie)).alias("__last"))
    edited = segments.join(last, key, "left").withColumn("text", F.coalesce("__last", "text")).drop("__last")
    return edited, audit


def edit_history(audit: DataFrame, meeting_id: str | None = None) -> DataFrame:
    """Audit rows, newest first within the whole result."""
    rows = audit if meeting_id is None else audit.filter(F.col("meeting_id") == meeting_id)
    return rows.orderBy(F.col("edited_at").desc(), F.col("edit_id").desc())


def purge(tables: Mapping[str, DataFrame], meeting_ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given meetings."""
    gone = meeting_ids.select("meeting_id").distinct()
    return {name: df.join(gone, "meeting_id", "left_anti") for name, df in tables.items()}


def purge_projects(tables: Mapping[str, DataFrame], meetings: DataFrame, project_ids: DataFrame) -> dict[str, DataFrame]:
    """Delete projects together with their meetings and all rows below them."""
    gone = meetings.join(project_ids.select("project_id").distinct(), "project_id", "left_semi")
    return purge({**tables, "meetings": meetings}, gone)


def touched_projects(meetings: DataFrame, meeting_ids: DataFrame) -> DataFrame:
    """Projects to re-synthesise after a change in some meetings."""
    return (meetings.join(meeting_ids.select("meeting_id").distinct(), "meeting_id", "left_semi")
            .filter(F.col("project_id").isNotNull()).select("project_id").distinct())


def add_manual_items(items: DataFrame, contexts: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append manual items at full confidence and create missing context rows."""
    manual = new.withColumn("confidence", F.lit(1.0)).withColumn("urgency", F.coalesce("urgency", F.lit("medium"))) \
        if "urgency" in new.columns else new.withColumn("confidence", F.lit(1.0))
    missing = new.select("meeting_id").distinct().join(contexts, "meeting_id", "left_anti")
    return (items.unionByName(manual, allowMissingColumns=True),
            contexts.unionByName(missing, allowMissingColumns=True))


def meetings_without_segments(meetings: DataFrame, segments: DataFrame) -> DataFrame:
    """Meetings that cannot be structured; their status becomes ``error``."""
    have = segments.select("meeting_id").distinct()
    return meetings.join(have, "meeting_id", "left_anti").withColumn("status", F.lit("error"))


def parse_extraction(payloads: DataFrame) -> DataFrame:
    """External results as a struct; malformed JSON gives a null result."""
    parsed = F.from_json("payload", EXTRACTION_RESULT, {"mode": "PERMISSIVE"})
    usable = parsed.isNotNull() & (parsed["summary"].isNotNull() | parsed["topics"].isNotNull()
                                   | parsed["decisions"].isNotNull() | parsed["action_items"].isNotNull())
    return payloads.select("meeting_id", F.when(usable, parsed).alias("result"))


def merge_extraction_sources(payloads: DataFrame, local_items: DataFrame, local_decisions: DataFrame,
                             min_conf: float = V.MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Items and decisions: external rows where a meeting has a usable result, local rows elsewhere."""
    parsed = parse_extraction(payloads).filter(F.col("result").isNotNull())
    covered = parsed.select("meeting_id").distinct()

    def rows(field: str) -> DataFrame:
        return (parsed.select("meeting_id", F.explode(f"result.{field}").alias("r")).select("meeting_id", "r.*")
                .withColumn("description", strip(F.col("description")))
                .filter((F.col("confidence") >= min_conf) & (F.col("description") != "")))

    rescored = L.score_urgency(F.concat_ws(" ", "description", F.coalesce("due", F.lit(""))))
    items = rows("action_items").withColumn(
        "urgency", F.when(F.col("urgency").isin(*V.URGENCY_ORDER), F.col("urgency")).otherwise(rescored))
    cols = ["meeting_id", "description", "owner", "due", "urgency", "evidence", "confidence", "segment_index"]
    dcols = ["meeting_id", "description", "rationale", "evidence", "confidence", "segment_index"]

    def merged(external: DataFrame, local: DataFrame, keep: list[str]) -> DataFrame:
        rest = local.join(covered, "meeting_id", "left_anti")
        return (external.select(*keep, F.lit("external").alias("origin"))
                .unionByName(rest.select(*keep, F.lit("local").alias("origin"))))

    return merged(items, local_items, cols), merged(rows("decisions"), local_decisions, dcols)


def merge_topics(payloads: DataFrame, local_topics: DataFrame) -> DataFrame:
    """External topics (without times) where a result lists any, local topics elsewhere."""
    parsed = parse_extraction(payloads).filter(F.size(F.coalesce("result.topics", F.array())) > 0)
    external = parsed.select("meeting_id", F.posexplode("result.topics").alias("topic_no", "t")).select(
        "meeting_id", "topic_no", "t.title", "t.summary")
    rest = local_topics.join(parsed.select("meeting_id").distinct(), "meeting_id", "left_anti")
    return external.unionByName(rest, allowMissingColumns=True)


def merge_summaries(payloads: DataFrame, local: DataFrame) -> DataFrame:
    """Summary lines (meeting_id, part, n, line): those of an external result where it has a summary that is not blank, local lines elsewhere.

    Of several results of a meeting the smallest summary counts.
    """
    own = parse_extraction(payloads).select("meeting_id", F.col("result.summary").alias("summary")).where(strip(F.col("summary")) != "")
    one = own.groupBy("meeting_id").agg(F.min("summary").alias("summary"))
    external = one.select("meeting_id", F.lit(0).alias("part"), F.posexplode(F.split(strip(F.col("summary")), "\r?\n")).alias("n", "line"))
    return external.unionByName(local.select("meeting_id", "part", "n", "line").join(one.select("meeting_id"), "meeting_id", "left_anti"))
