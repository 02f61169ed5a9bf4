"""Minutes and transcripts as ordered lines.

A document is rows ``(meeting_id, part, a, b, line)`` in (part, a, b) order.  Keeping
lines as rows lets one very long meeting be produced and written by many tasks;
``pages`` joins a fixed number of lines into text where whole pages are wanted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from ..operators import filters as B
from ..operators import joins as C
from ..operators import rollups as D
from ..operators.blocks import block_scan, index_block
from ..session import cut

PAGE_LINES = 500
PREPARED_BY = "colloquy"
AGENDA_CAP = 8


def render_transcript(named: DataFrame, appendix: bool = False) -> DataFrame:
    """One line per segment: ``[index] name: text``, or the minutes' appendix form with the clock time."""
    name = F.col("display_name")
    plain = F.concat(F.lit("["), F.col("segment_index").cast("string"), F.lit("] "), name, F.lit(": "), T.strip(F.col("text")))
    timed = F.concat(F.lit("- `"), L.format_clock(F.col("start_time")), F.lit("` **"), name, F.lit(":** "), F.col("text"))
    return named.select("meeting_id", "segment_index", (timed if appendix else plain).alias("line"))


def pages(lines: DataFrame, index: str = "segment_index", page_lines: int = PAGE_LINES) -> DataFrame:
    """Text of ``page_lines`` consecutive lines each; the page number keeps very long documents in pieces."""
    return (lines.groupBy("meeting_id", F.floor(F.col(index) / page_lines).cast("int").alias("page"))
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(index, "line"))), lambda x: x["line"]), "\n").alias("body")))


Entry = tuple[int, Column | int, Column | int, Column | str, Column | None]
LAST = 2 ** 40


def _lines(df: DataFrame, entries: list[Entry]) -> DataFrame:
    """Rows of lines that every row of ``df`` gives: (part, a, b, line, condition), None standing for "not null".

    What is computed becomes a column first, so that it is computed once and the rows are only dealt out here.
    """
    columns: list[Column] = []

    def held(x: Column) -> Column:
        columns.append(x.alias(f"__{len(columns)}"))
        return F.col(f"__{len(columns) - 1}")

    def number(x: Column | int) -> Column:
        return F.lit(x).cast("long") if isinstance(x, int) else held(x.cast("long"))

    made = []
    for part, a, b, line, keep in entries:
        line = F.lit(line) if isinstance(line, str) else held(line)
        entry = F.struct(F.lit(part).alias("part"), number(a).alias("a"), number(b).alias("b"), line.alias("line"))
        made.append(F.when(line.isNotNull() if keep is None else held(keep), entry))
    return (df.select("meeting_id", *columns).select("meeting_id", F.explode(F.array(*made)).alias("e"))
            .filter(F.col("e").isNotNull()).select("meeting_id", "e.*"))


def _part(part: int, lines: list[Column | str], a: Column | int = 0, keep: Column | None = None) -> list[Entry]:
    """Consecutive lines at one position; a null line is left out but keeps its number."""
    return [(part, a, b, x, keep if keep is None or isinstance(x, str) else keep & x.isNotNull()) for b, x in enumerate(lines)]


def _cells(*cells: Column) -> Column:
    out = [F.lit("| ")]
    for i, cell in enumerate(cells):
        out += ([F.lit(" | ")] if i else []) + [cell.cast("string")]
    return F.concat(*out, F.lit(" |"))


def _or(col: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(default))


def minutes_lines(meetings: DataFrame, segments: DataFrame, speakers: DataFrame, topics: DataFrame, items: DataFrame,
                  decisions: DataFrame, summary_lines: DataFrame, generated_at: str, include_transcript: bool = False) -> DataFrame:
    """Minutes of every finished meeting.

    ``summary_lines``: meeting_id, part, n, line (see ``summaries.summarise``).  Segments, topics and the items and
    decisions (together) are each prepared once and stored; a stored row then gives all its lines at one reading.
    """
    done = meetings.filter(F.col("status") == "done")
    mine = done.select("meeting_id")

    def only(df: DataFrame) -> DataFrame:
        return df.join(mine, "meeting_id", "left_semi")

    named = cut(D.named_segments(only(segments), speakers).select("meeting_id", "segment_index", "display_name", "text", "start_time", "end_time"))
    heard = cut(_heard(named))
    spans = cut(C.topic_spans(only(topics), named, heard.select("meeting_id", "duration")))
    raised = _raised(items, decisions, only, named, spans)
    stamp = F.lit(f"{PREPARED_BY}, {generated_at} UTC")
    own_summary = only(summary_lines)

    told = (done.select("meeting_id", "title", "date", "source").join(heard, "meeting_id", "left").join(spans.groupBy("meeting_id").agg(F.count("*").alias("topics")), "meeting_id", "left")
            .join(_raised_counts(raised), "meeting_id", "left")
            .join(own_summary.select("meeting_id").distinct().withColumn("summarised", F.lit(True)), "meeting_id", "left")
            .withColumn("spoken", F.col("people").isNotNull())
            .fillna(0, ["topics", "decisions", "tasks", "open_tasks", "completed", "open_questions", "participants"])
            .fillna(False, ["summarised"]))
    with_topics = F.col("topics") > 0

    def framed(part: int, title: str, table: list[str], none: str, rows: str) -> list[Entry]:
        """Title, then the heading of a table of the meeting's rows or a line saying there are none."""
        return (_part(part, [title, ""], -2) + _part(part, table, -1, F.col(rows) > 0) + _part(part, [none], -1, F.col(rows) == 0)
                + _part(part, [""], LAST))

    whole = (
        _part(0, [
            F.concat(F.lit("# Minutes of Meeting — "), F.col("title")), "", "| | |", "|---|---|",
            _cells(F.lit("**Date**"), L.format_datetime(F.col("date"))),
            _cells(F.lit("**Duration**"), L.format_duration(F.round(F.coalesce("duration", F.lit(0.0)), 6))),
            _cells(F.lit("**Participants**"), F.coalesce(F.array_join("people.display_name", ", "), F.lit("—"))),
            _cells(F.lit("**Source**"), L.source_label(F.col("source"))),
            _cells(F.lit("**Prepared by**"), stamp), ""])
        + _part(1, [
            "## Meeting at a glance", "",
            "| Topics | Decisions | Action items | Open | Completed | Open questions | Participants |", "|---|---|---|---|---|---|---|",
            _cells(*[F.col(c) for c in ("topics", "decisions", "tasks", "open_tasks", "completed", "open_questions", "participants")]), ""])
        + _part(2, ["## Agenda / topics covered", ""], -1, with_topics) + _part(2, [""], LAST, with_topics)
        + _part(3, ["## Executive summary", ""], -1, F.col("summarised")) + _part(3, [""], LAST, F.col("summarised"))
        + _part(4, ["## Discussion by topic", ""], -1, with_topics)
        + framed(5, "## Decisions", ["| # | Decision | Rationale | Raised at | By |", "|---|---|---|---|---|"],
                 "_No decisions were recorded._", "decisions")
        + framed(6, "## Action items", ["| # | Task | Owner | Due | Priority | Status |", "|---|---|---|---|---|---|"],
                 "_No action items were recorded._", "tasks")
        + framed(7, "## Open questions & follow-ups", [], "_Nothing left open._", "open_questions")
        + _part(8, ["**Proposed agenda for the next meeting**", ""], -1) + _part(8, [""], LAST)
        + [entry for i in range(AGENDA_CAP) for entry in _next_line(i)]
        + _part(9, ["## Participation", "", "| Participant | Speaking time | Share |", "|---|---|---|"], -1, F.col("spoken"))
        + _part(9, [""], LAST, F.col("spoken"))
        + _part(11, [f"_Generated by {PREPARED_BY} on {generated_at} UTC. Automatically extracted items should be verified by the meeting owner._"], -1))
    if include_transcript:
        whole += _part(10, ["## Appendix — Transcript", ""], -1, F.col("spoken")) + _part(10, [""], LAST, F.col("spoken"))

    ranked = heard.select("meeting_id", "total", F.posexplode("people").alias("rank", "who")).select("meeting_id", "total", "rank", "who.*")
    share = F.col("seconds") / F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("total"))
    participation = _lines(ranked, _part(9, [_cells(F.col("display_name"), L.format_clock(F.round("seconds", 6)), F.concat(
        F.bround(F.round(share * 100, 6), 0).cast("int").cast("string"), F.lit("%")))], F.col("rank") + 1))
    summary = own_summary.select("meeting_id", F.lit(3).alias("part"), F.col("part").cast("long").alias("a"), F.col("n").cast("long").alias("b"), "line")
    parts = [_lines(told, whole), participation, summary, _lines(spans, _topic_entries()), _lines(raised, _raised_entries())]
    if include_transcript:
        parts.append(render_transcript(named, appendix=True).select(
            "meeting_id", F.lit(10).alias("part"), F.col("segment_index").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "line"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _heard(named: DataFrame) -> DataFrame:
    """Per meeting with segments: duration, seconds in all, number of names, and the speakers by speaking time."""
    spoken = named.groupBy("meeting_id", "display_name").agg(
        F.sum(F.greatest(F.col("end_time") - F.col("start_time"), F.lit(0.0))).alias("seconds"),
        F.min("start_time").alias("first"), F.max("end_time").alias("last"))
    return spoken.groupBy("meeting_id").agg(
        F.greatest(F.max("last") - F.min("first"), F.lit(0.0)).alias("duration"), F.sum("seconds").alias("total"),
        F.count("display_name").alias("participants"),
        F.sort_array(F.collect_list(F.struct((-F.round("seconds", 6)).alias("s"), "display_name", "seconds"))).alias("people"))


def _raised(items: DataFrame, decisions: DataFrame, only: Callable[[DataFrame], DataFrame], named: DataFrame, spans: DataFrame) -> DataFrame:
    """Items and decisions in one table with their number among their kind, the segment they came from and ``found``, their topic's number."""
    null = F.lit(None).cast("string")
    rows = items.select("meeting_id", "segment_index", F.col("item_id").alias("id"), "description", "owner", "due", "urgency", "resolved",
                        null.alias("rationale"), F.lit(False).alias("is_decision")).unionByName(decisions.select(
                            "meeting_id", "segment_index", F.col("decision_id").alias("id"), "description", null.alias("owner"), null.alias("due"),
                            null.alias("urgency"), F.lit(None).cast("boolean").alias("resolved"), "rationale", F.lit(True).alias("is_decision")))
    flagged = B.split_items(only(rows)).withColumn("is_question", F.col("is_question") & ~F.col("is_decision")).withColumn(
        "is_task", F.col("is_task") & ~F.col("is_decision"))

    def count(flag: Column) -> Column:
        return F.coalesce(flag, F.lit(False)).cast("long")

    numbered = block_scan(flagged, ["meeting_id"], index_block("segment_index"), ["segment_index", "is_decision", "id"], sums={
        "decision_no": count(F.col("is_decision")), "task_no": count(F.col("is_task")), "question_no": count(F.col("is_question")),
        "open_no": count(F.col("is_task") & F.col("is_open"))})
    sourced = C.item_source_lookup(numbered, named.withColumnRenamed("display_name", "speaker")).withColumnRenamed("source_time", "at")
    return cut(C.attach_points(sourced, spans, "id", F.col("span_no")))


def _raised_counts(raised: DataFrame) -> DataFrame:
    """Counts per meeting and the lines of the next agenda: the first questions, open tasks and decisions."""
    question, task, decision = B.agenda_texts()

    def first(part: int, flag: Column, no: str, k: int, line: Column) -> Column:
        return F.when(flag & (F.col(no) <= k), F.struct(F.lit(part).alias("part"), F.col(no).alias("n"), line.alias("line")))

    proposed = F.coalesce(
        first(0, F.col("is_question"), "question_no", AGENDA_CAP, question),
        first(1, F.col("is_task") & F.col("is_open"), "open_no", 6, task), first(2, F.col("is_decision"), "decision_no", 2, decision))
    return raised.groupBy("meeting_id").agg(
        F.count_if("is_decision").alias("decisions"), F.count_if("is_task").alias("tasks"),
        F.count_if(F.col("is_task") & F.col("is_open")).alias("open_tasks"), F.count_if("is_done").alias("completed"),
        F.count_if("is_question").alias("open_questions"), F.sort_array(F.collect_list(proposed)).alias("proposed"))


def _next_line(i: int) -> list[Entry]:
    """Line ``i`` of the next agenda, if there is one; a meeting without any has one that says so."""
    line = F.concat(F.lit("- "), F.coalesce(F.get("proposed", F.lit(i))["line"], F.lit(B.NOTHING_NEXT)))
    return [(8, i + 1, 0, line, F.lit(True) if i == 0 else F.coalesce(F.size("proposed"), F.lit(0)) > i)]


def _topic_entries() -> list[Entry]:
    number, base = (F.col("span_no") + 1).cast("string"), F.col("span_no") * 4
    clock = F.concat(L.format_clock(F.round("span_start", 6)), F.lit("–"), L.format_clock(F.round("span_end", 6)))
    has_summary = F.coalesce("summary", F.lit("")) != ""
    return (_part(2, [F.concat(
        number, F.lit(". **"), F.col("title"), F.lit("**"), F.when(F.coalesce("is_recurring", F.lit(False)), " *(recurring)*").otherwise(""),
        F.lit(" — "), clock)], F.col("span_no"))
        + _part(4, [F.concat(F.lit("### "), number, F.lit(". "), F.col("title"), F.lit("  ")), F.concat(F.lit("*"), clock, F.lit("*")), "",
                    F.when(has_summary, F.col("summary")), F.when(has_summary, F.lit(""))], base)
        + _part(4, [""], base + 3))


def _raised_entries() -> list[Entry]:
    """Under its topic, decisions before actions, and in the table of its kind."""
    def suffix(col: str, lead: str) -> Column:
        return F.when(F.coalesce(F.col(col), F.lit("")) != "", F.concat(F.lit(lead), F.col(col))).otherwise("")

    decided = F.concat(F.lit("- **Decision:** "), F.col("description"), suffix("rationale", " — "))
    acted = F.concat(F.lit("- **Action:** "), F.col("description"), suffix("owner", " — "), suffix("due", ", "))
    at = F.col("found") * 4 + F.when(F.col("is_decision"), 1).otherwise(2)
    return ([(4, at, F.col("segment_index"), F.when(F.col("is_decision"), decided).otherwise(acted), F.col("found").isNotNull())]
            + _part(5, [_cells(F.col("decision_no"), F.col("description"), _or("rationale", "—"), L.format_clock(F.round("at", 6)),
                               _or("source_speaker", "—"))], F.col("decision_no"), F.col("is_decision"))
            + _part(6, [_cells(F.col("task_no"), F.col("description"), _or("owner", "Unassigned"), _or("due", "—"),
                               F.initcap(F.coalesce(F.nullif("urgency", F.lit("")), F.lit("low"))),
                               F.when(F.col("resolved"), "Done").otherwise("Open"))], F.col("task_no"), F.col("is_task"))
            + _part(7, [F.concat(F.lit("- "), F.col("description"))], F.col("question_no"), F.col("is_question")))
