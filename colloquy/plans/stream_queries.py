"""Streams run once over the given tables; results are read back from the sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..session import ensure_checkpoint_dir
from ..sources import orders_world as O
from ..sources import transcripts as X
from ..streaming import streams as J
from . import sql as Q
from .core_queries import ASSIGNED, STATUS_SQL, r6
from .registry import query
from .sql import with_


def places(spark: SparkSession) -> tuple[str, str]:
    """Checkpoint and target folders for one run, below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    return f"{base}/checkpoint", f"{base}/target"


def stream_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    schema = X.table(spark, path, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(path)


def finish(running) -> None:
    running.awaitTermination()


def order_segments(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("segment_id"), F.col("o_orderkey").alias("k"),
        F.col("o_custkey").cast("string").alias("meeting_id"), X.order_sentence(F.col("o_orderkey")).alias("text"),
        F.col("o_orderdate").cast("timestamp").alias("event_time"))


@query("stream_segments", f"SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS meeting_id, {Q.order_sentence('o_orderkey')} AS text FROM orders")
def _(spark, path):
    checkpoint, target = places(spark)
    finish(J.start_segments(order_segments(stream_of(spark, path, "orders")), checkpoint, target, once=True))
    return spark.read.parquet(target).select("k", "meeting_id", "text")


@query("stream_dedupe", "SELECT DISTINCT o_orderkey AS k FROM orders")
def _(spark, path):
    checkpoint, target = places(spark)
    rows = order_segments(stream_of(spark, path, "orders"))
    again = rows.withColumn("copy", F.explode(F.when(F.col("k") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    finish(J.start_dedupe(again, checkpoint, target, watermark="5000 days", once=True))
    return spark.read.parquet(target).select("k")


@query("stream_status", f"""WITH {STATUS_SQL}, a AS (SELECT *, CASE WHEN lag(status) OVER w = status THEN 0 ELSE 1 END AS fresh FROM status_events WINDOW w AS (PARTITION BY meeting_id ORDER BY event_time, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY meeting_id ORDER BY event_time, event_id) AS island FROM a),
c AS (SELECT *, last_value(progress IGNORE NULLS) OVER (PARTITION BY meeting_id, island ORDER BY event_time, event_id ROWS UNBOUNDED PRECEDING) AS carried,
  ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY event_time DESC, event_id DESC) AS rn FROM b)
SELECT meeting_id, status, round(carried, 6) AS progress, status IN ('done', 'error') AS finished FROM c WHERE rn = 1""")
def _(spark, path):
    checkpoint, target = places(spark)
    events = stream_of(spark, path, "events")
    finish(J.start_status(_status(events), checkpoint, target, once=True))
    return J.newest_versions(spark.read.parquet(target)).select("meeting_id", "status", r6("progress"), "finished")


def _status(events: DataFrame) -> DataFrame:
    status = (F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "transcribing")
              .when(F.col("event_type") == "click", "structuring").when(F.col("event_type") == "purchase", "done").otherwise("error"))
    return events.select(
        F.col("user_id").cast("string").alias("meeting_id"), "event_id", F.col("ts").alias("event_time"), status.alias("status"),
        F.when(F.col("event_id") % 3 != 0, F.least(F.col("value") / 100.0, F.lit(1.0))).alias("progress"))


@query("stream_relabel", with_(["segs", "turns"], ASSIGNED + "SELECT meeting_id, segment_index, new_speaker AS speaker FROM assigned"))
def _(spark, path):
    checkpoint, target = places(spark)
    stored, turns = f"{target}-stored", f"{target}-turns"
    O.segments(spark, path).write.parquet(stored)
    O.speaker_turns(spark, path).write.parquet(turns)
    arriving = spark.readStream.schema(spark.read.parquet(turns).schema).parquet(turns)
    finish(J.start_relabel(arriving, stored, checkpoint, target, once=True))
    return spark.read.parquet(f"{target}/segments").select("meeting_id", "segment_index", "speaker")


@query("stream_pause_windows", """WITH g AS (SELECT event_type, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts) AS section FROM g),
c AS (SELECT event_type, min(ts) AS chunk_start, max(ts) + INTERVAL 20 MINUTE AS chunk_end, count(*) AS rows FROM s GROUP BY event_type, section)
SELECT event_type, chunk_start, chunk_end, rows FROM c WHERE chunk_end <= (SELECT max(ts) - INTERVAL 30 SECOND FROM events)""")
def _(spark, path):
    checkpoint, target = places(spark)
    events = stream_of(spark, path, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    chunks = J.pause_windows(events, "event_type", "ts", "20 minutes")
    finish(J.start_chunks(chunks, checkpoint, target, once=True))
    return spark.read.parquet(target).select("event_type", "chunk_start", "chunk_end", "rows")


@query("stream_bounded_chunks", """WITH RECURSIVE g AS (SELECT user_id, ts, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER w AS p, ROW_NUMBER() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
walk AS (SELECT user_id, n, ts, t, t AS start FROM g WHERE n = 1
  UNION ALL SELECT g.user_id, g.n, g.ts, g.t, CASE WHEN g.t - w.start >= 172800000000 OR (g.t - g.p >= 21600000000 AND g.t - w.start >= 43200000000) THEN g.t ELSE w.start END
  FROM walk w JOIN g ON g.user_id = w.user_id AND g.n = w.n + 1)
SELECT CAST(user_id AS VARCHAR) AS key, min(ts) AS chunk_start, max(ts) AS last_row, count(*) AS rows FROM walk GROUP BY user_id, start""")
def _(spark, path):
    """Chunks of the log, each user's rows followed by the mark that the user has stopped."""
    checkpoint, target = places(spark)
    log = X.table(spark, path, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(False).alias("ended"))
    stops = log.groupBy("user_id").agg(F.max("ts").alias("ts"), F.lit(True).alias("ended"))
    log.unionByName(stops).write.parquet(f"{target}-log")
    arriving = spark.readStream.schema(log.schema).parquet(f"{target}-log")
    chunks = J.bounded_chunks(arriving, "user_id", "ts", 6 * 3600.0, 12 * 3600.0, 48 * 3600.0, ended="ended")
    finish(J.start_chunks(chunks, checkpoint, target, once=True))
    return spark.read.parquet(target).select("key", "chunk_start", "last_row", "rows")


@query("stream_tail_with_backfill", "SELECT o_orderkey AS k, o_orderstatus <> 'F' AS live FROM orders")
def _(spark, path):
    checkpoint, target = places(spark)
    stored = order_segments(X.table(spark, path, "orders").filter("o_orderstatus = 'F'")).select("segment_id", "k")
    live = order_segments(stream_of(spark, path, "orders"))
    finish(J.start_tail(stored, live, checkpoint, target, once=True))
    return spark.read.parquet(target).select("k", "live")


@query("stream_urgent_items", f"""SELECT k, urgency FROM (SELECT k, CASE WHEN critical >= 4 THEN 'critical' WHEN high >= 3 OR (critical >= 2 AND high >= 1) THEN 'high' WHEN medium >= 2 OR high >= 1 THEN 'medium' ELSE 'low' END AS urgency FROM (SELECT k,
  {", ".join("(" + " + ".join(f"CASE WHEN {Q.matches('text', p)} THEN {w} ELSE 0 END" for p, w in P.URGENCY_SIGNALS[level]) + f") AS {level}" for level in ("critical", "high", "medium"))} FROM (SELECT o_orderkey AS k, {Q.order_sentence('o_orderkey')} AS text FROM orders))) WHERE urgency <> 'low'""")
def _(spark, path):
    checkpoint, target = places(spark)
    finish(J.start_urgent_items(order_segments(stream_of(spark, path, "orders")), checkpoint, target, once=True))
    return spark.read.parquet(target).select("k", "urgency")
