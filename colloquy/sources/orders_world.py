"""Meeting tables derived from the order tables.

customer -> meetings, nation -> projects, orders -> segments, topics, action
items and decisions.  Meetings, projects, segments, items and decisions cover their whole
source table; one order in four opens a topic.  The work of all queries grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .transcripts import orders_as_utterances, table

TOPIC_TITLES = ["Pricing", " Freight", "Customs ", "Returns", "Storage", "Packaging"]


def pick(index: Column, options: list[str | None]) -> Column:
    out = None
    for n, option in enumerate(options):
        value = F.lit(option).cast("string")
        out = F.when(index == n, value) if out is None else out.when(index == n, value)
    return out


def projects(spark: SparkSession, path: str) -> DataFrame:
    n = table(spark, path, "nation")
    return n.select(
        F.col("n_nationkey").cast("string").alias("project_id"),
        F.concat(F.lit("u"), F.col("n_regionkey").cast("string")).alias("user_id"),
        F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lit("Company "), F.col("n_regionkey").cast("string"))).alias("company"))


def meetings(spark: SparkSession, path: str) -> DataFrame:
    c = table(spark, path, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.cast("string").alias("meeting_id"),
        pick(key % 7, ["u0", "u1", "u2", "u3", "u4", "u5", None]).alias("user_id"),
        F.when(key % 11 != 0, F.col("c_nationkey").cast("string")).alias("project_id"),
        F.concat(F.col("c_name"), F.lit(" / "), F.col("c_mktsegment")).alias("title"),
        F.timestamp_seconds(F.lit(1704067200) + key * 3600).alias("date"),
        pick(key % 5, ["done", "done", "transcribing", "error", "queued"]).alias("status"),
        pick(key % 3, ["brief", "balanced", "comprehensive"]).alias("summary_type"),
        pick(key % 2, ["upload", "live"]).alias("source"))


def segments(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    """``rows``, here and below: the table of ``order_rows`` where several readers share one."""
    rows = orders_as_utterances(table(spark, path, "orders")) if rows is None else rows
    return rows.select("meeting_id", "segment_index", "speaker", "text", "start_time", "end_time")


def speakers(spark: SparkSession, path: str) -> DataFrame:
    """Distinct labels per meeting; label 1 carries a user-given name, label 2 an inferred one."""
    o = table(spark, path, "orders")
    label = F.concat(F.lit("SPEAKER_0"), (F.col("o_orderkey") % 3).cast("string"))
    return (o.select(F.col("o_custkey").cast("string").alias("meeting_id"), label.alias("label")).distinct()
            .select("meeting_id", "label",
                    F.when(F.col("label") == "SPEAKER_01", F.lit("Ines")).alias("name"),
                    F.when(F.col("label") == "SPEAKER_02", F.lit("Omar")).alias("inferred")))


def order_rows(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """Utterances with the order columns that items, decisions and topics are made of; ``only`` names the meetings wanted."""
    o = table(spark, path, "orders")
    if only is not None:
        wanted = only.select("meeting_id")
        o = o.join(wanted, F.col("o_custkey").cast("string") == wanted["meeting_id"], "left_semi")
    return orders_as_utterances(o, keep=("o_orderstatus", "o_orderpriority", "o_totalprice"))


def urgency_from_priority() -> Column:
    p = F.substring("o_orderpriority", 1, 1)
    return (F.when(p == "1", "critical").when(p == "2", "high").when(p == "3", "medium").when(p == "4", "low"))


def action_items(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    """An item per order whose key is not a multiple of five; some have no owner, some no urgency."""
    k = F.col("order_key")
    return (order_rows(spark, path) if rows is None else rows).filter(k % 5 != 0).select(
        F.concat(F.lit("a"), k.cast("string")).alias("item_id"), "meeting_id",
        F.when(k % 4 == 0, F.concat(F.lit("Decide on order "), k.cast("string")))
        .otherwise(F.concat(F.lit("Pack order "), k.cast("string"))).alias("description"),
        pick(k % 4, [None, "Ines", "Omar", "Ana"]).alias("owner"),
        urgency_from_priority().alias("urgency"),
        (F.col("o_orderstatus") == "F").alias("resolved"),
        F.when(k % 3 == 0, "by Friday").alias("due"),
        F.col("text").alias("evidence"),
        ((k % 10) / 10.0).alias("confidence"), "segment_index")


def decisions(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    k = F.col("order_key")
    return (order_rows(spark, path) if rows is None else rows).filter(k % 5 == 0).select(
        F.concat(F.lit("d"), k.cast("string")).alias("decision_id"), "meeting_id",
        F.concat(F.lit("Ship order "), k.cast("string")).alias("description"),
        F.when(k % 2 == 0, "Stock is low").alias("rationale"),
        F.col("text").alias("evidence"), ((k % 10) / 10.0).alias("confidence"), "segment_index",
        F.col("order_date").alias("decided_on"))


def topics(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    """A topic per order; a few lack times, which switches their meeting to equal spans."""
    k = F.col("order_key")
    return (order_rows(spark, path) if rows is None else rows).select(
        F.concat(F.lit("t"), k.cast("string")).alias("topic_id"), "meeting_id",
        F.col("segment_index").alias("topic_no"), pick(k % 6, TOPIC_TITLES).alias("title"),
        F.concat(F.lit("About order "), k.cast("string")).alias("summary"),
        (k % 3 == 0).alias("is_recurring"),
        F.when(k % 3 == 0, F.concat(F.lit("t"), (k - 12).cast("string"))).alias("previous_topic_id"),
        F.when(k % 50 != 1, F.col("start_time")).alias("start_time"),
        F.when(k % 50 != 1, F.col("start_time") + 20).alias("end_time"))


def speaker_turns(spark: SparkSession, path: str, step: int = 7) -> DataFrame:
    """A fixed grid of turns over every meeting, cutting across segment borders on purpose."""
    s = segments(spark, path)
    first, last = F.floor(F.col("start_time") / step), F.floor(F.col("end_time") / step)
    grid = s.select("meeting_id", F.explode(F.sequence(first, last)).alias("turn_idx")).distinct()
    return grid.select(
        "meeting_id", F.col("turn_idx").cast("int").alias("turn_idx"),
        F.concat(F.lit("SPEAKER_0"), (F.col("turn_idx") % 3).cast("string")).alias("speaker"),
        (F.col("turn_idx") * step).cast("double").alias("start_time"),
        (F.col("turn_idx") * step + F.when(F.col("turn_idx") % 5 == 4, 3).otherwise(step)).cast("double").alias("end_time"))
