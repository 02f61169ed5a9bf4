"""Display labels, formats and flags as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import phrases as P
from . import values as V
from .text import extract, matches, strip


def display_name(user_name: Column, inferred: Column, label: Column) -> Column:
    number = F.regexp_extract(label, "(?i)^SPEAKER_([0-9]+)", 1)
    pretty = F.when(number != "", F.concat(F.lit("Speaker "), (number.cast("int") + 1).cast("string"))).otherwise(label)
    return F.coalesce(F.nullif(user_name, F.lit("")), F.nullif(inferred, F.lit("")), pretty)


def needs_review(confidence: Column) -> Column:
    return F.when(confidence.isNotNull() & (confidence < V.REVIEW_CONFIDENCE),
                  F.concat(F.round(confidence * 100, 0).cast("int").cast("string"), F.lit("% sure")))


def _two(col: Column) -> Column:
    return F.lpad(col.cast("string"), 2, "0")


def format_duration(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    minutes, hours = F.floor(s / 60).cast("long"), F.floor(s / 3600).cast("long")
    return (F.when(s < 60, F.concat(s.cast("string"), F.lit(" s")))
            .when(hours > 0, F.concat(hours.cast("string"), F.lit(" h "), _two(minutes % 60), F.lit(" min")))
            .otherwise(F.concat(minutes.cast("string"), F.lit(" min "), _two(s % 60), F.lit(" s"))))


def format_clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    minutes = F.floor(s / 60).cast("long")
    shown = F.when(minutes < 100, _two(minutes)).otherwise(minutes.cast("string"))
    return F.when(seconds.isNull(), F.lit("—")).otherwise(F.concat(shown, F.lit(":"), _two(s % 60)))


def format_date(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd MMMM yyyy"), F.lit("—"))


def format_datetime(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "dd MMM yyyy, HH:mm"), F.lit("—"))


def urgency_label(urgency: Column) -> Column:
    label = F.create_map(*[F.lit(x) for kv in V.URGENCY_LABELS.items() for x in kv])
    return F.coalesce(label[F.lower(F.coalesce(F.nullif(urgency, F.lit("")), F.lit("low")))],
                      F.lit(V.URGENCY_LABELS["low"]))


def urgency_rank(urgency: Column) -> Column:
    u = F.lower(F.coalesce(urgency, F.lit("low")))
    return F.when(u == "critical", 0).when(u == "high", 1).when(u == "medium", 2).otherwise(3)


def source_label(source: Column) -> Column:
    return F.when(source == "live", "Live recording (microphone)").otherwise("Uploaded recording")


def effective_status(status: Column, progress: Column) -> Column:
    return F.when((status == "structuring") & (progress >= 0.85), "summarising").otherwise(status)


def stage_progress_pct(status: Column, progress: Column) -> Column:
    p = F.least(F.greatest(F.coalesce(progress, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return (F.when(status == "queued", F.lit(5.0)).when(status == "transcribing", 10 + p * 50)
            .when(status == "structuring", 60 + p * 35).when(status == "summarising", F.lit(95.0))
            .when(status == "done", F.lit(100.0)).otherwise(F.lit(0.0)))


def relative_age(ts: Column, as_of: Column) -> Column:
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    minutes = F.floor(seconds / 60000000).cast("long")
    hours, days = F.floor(minutes / 60).cast("long"), F.floor(minutes / 1440).cast("long")
    return (F.when(ts.isNull(), "Unknown date").when(minutes < 1, "Just now")
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
            .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
            .when(days < 7, F.concat(days.cast("string"), F.lit("d ago")))
            .otherwise(F.date_format(ts, "dd MMM yyyy")))


def can_access(owner: Column, project_owner: Column, user: Column) -> Column:
    denied = (user.isNotNull() & owner.isNotNull() & (owner != user)
              & ~F.coalesce(project_owner == user, F.lit(False)))
    return ~F.coalesce(denied, F.lit(False))


def is_open_question(owner: Column, description: Column) -> Column:
    return (F.coalesce(owner, F.lit("")) == "") & matches(F.coalesce(description, F.lit("")), P.OPEN_ITEM_OPENING)


def score_urgency(text: Column, signals: dict[str, list[tuple[str, int]]] | None = None) -> Column:
    """Urgency level from weighted patterns; ``signals`` replaces the default lists."""
    signals = signals or P.URGENCY_SIGNALS
    t = F.coalesce(text, F.lit(""))

    def total(level: str) -> Column:
        parts = [F.when(t.rlike("(?iUd)" + p), F.lit(w)).otherwise(F.lit(0)) for p, w in signals[level]]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    critical, high, medium = total("critical"), total("high"), total("medium")
    return (F.when(critical >= 4, "critical")
            .when((high >= 3) | ((critical >= 2) & (high >= 1)), "high")
            .when((medium >= 2) | (high >= 1), "medium").otherwise("low"))


def doc_stem(title: Column) -> Column:
    kept = F.translate(strip(F.regexp_replace(title, "[^A-Za-z0-9._ -]+", "")), " ", "_")
    return F.coalesce(F.nullif(F.substring(kept, 1, 60), F.lit("")), F.lit("meeting"))


def find_person(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, P.OWNER_VERB, 1), F.lit(""))
