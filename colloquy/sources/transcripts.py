"""Readers and adapters that produce the canonical utterance table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.text import split_sentences_strict, strip
from ..operators.blocks import BLOCK_ROWS, block_scan, index_block, row_index
from ..session import spread


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def text_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table whose rows are expensive to process, spread over all cores."""
    return spread(table(spark, path, name))


def read_utterances(segments: DataFrame, speakers: DataFrame) -> DataFrame:
    """Segments with their speaker label; rows without a speaker get the default label.

    Row order is carried by ``segment_index``; nothing is sorted globally.
    """
    who = speakers.select("speaker_id", F.col("label").alias("__label"), F.col("name").alias("speaker_name"))
    return segments.join(who, "speaker_id", "left").select(
        "meeting_id", "segment_index",
        F.coalesce("__label", F.lit(V.DEFAULT_SPEAKER)).alias("speaker"), "speaker_name",
        "text", "start_time", "end_time")


def conversations_as_utterances(conversations: DataFrame, chars_per_second: float = V.CHARS_PER_SECOND) -> DataFrame:
    """Chat turns as utterances; times follow from the characters spoken so far."""
    turns = conversations.select(
        F.col("conv_id").cast("string").alias("meeting_id"), F.col("turn").cast("int").alias("segment_index"),
        F.col("role").alias("speaker"), "text", F.length("text").cast("long").alias("__chars"))
    timed = block_scan(turns, ["meeting_id"], index_block("segment_index"), ["segment_index"],
                       sums={"__upto": F.col("__chars")})
    return _with_times(timed, chars_per_second)


def _with_times(df: DataFrame, chars_per_second: float = V.CHARS_PER_SECOND) -> DataFrame:
    rate = F.lit(float(chars_per_second))
    return (df.withColumn("start_time", (F.col("__upto") - F.col("__chars")) / rate)
            .withColumn("end_time", F.col("__upto") / rate).drop("__upto", "__chars"))


def document_sentences(documents: DataFrame) -> DataFrame:
    """One row per sentence of a document, without times: meeting_id, speaker, segment_index, text; nothing is shuffled."""
    return documents.select(
        F.col("doc_id").cast("string").alias("meeting_id"), F.col("source").alias("speaker"),
        F.posexplode(split_sentences_strict(F.col("text"))).alias("segment_index", "text"))


def documents_as_utterances(documents: DataFrame, chars_per_second: float = V.CHARS_PER_SECOND) -> DataFrame:
    """One utterance per sentence of a document; times follow from the characters before it."""
    pieces = document_sentences(documents)
    counted = pieces.withColumn("__chars", F.length("text").cast("long"))
    timed = block_scan(counted, ["meeting_id"], index_block("segment_index"), ["segment_index"], sums={"__upto": F.col("__chars")})
    return _with_times(timed, chars_per_second).select("meeting_id", "segment_index", "speaker", "text", "start_time", "end_time")


# Sentences for transcripts derived from orders, one per speech act.  {k} is the order key.
ORDER_SENTENCES = [
    "I will send the invoice for order {k} to the carrier by Friday.",
    "Sure, I'll take care of it.",
    "Maria will book the freight slot for order {k} next week.",
    "Tomas, can you check the customs papers for order {k}?",
    "We need to update the delivery plan for order {k}.",
    "We still need to decide on the refund for order {k}.",
    "We decided to cancel order {k} because the stock is gone.",
    "The discount for order {k} is approved.",
    "Should we ship order {k} in two parcels?",
    "Sounds good.",
    "No, I don't think so.",
    "When does order {k} leave the warehouse?",
    "If the carrier agrees, I will change the route of order {k}.",
    "I already sent the receipt for order {k} yesterday.",
    "Hi, this is Lena.",
    "Thanks everyone, have a great evening.",
    "I'll fix the outage on lane {k} right now.",
    "Please confirm the pickup window for order {k} today.",
    "Let's go with the night train for order {k}.",
    "We need approval from finance for order {k}.",
]


def order_sentence(key: Column, sentences: list[str] | None = None) -> Column:
    sentences = sentences or ORDER_SENTENCES
    out = None
    for n, text in enumerate(sentences):
        head, _, tail = text.partition("{k}")
        value = F.concat(F.lit(head), key.cast("string"), F.lit(tail)) if "{k}" in text else F.lit(text)
        hit = (key % len(sentences)) == n
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def orders_as_utterances(orders: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Transcripts derived from orders: a meeting per customer, a segment per order.

    Positions come from a two-level scan over calendar months, so one customer with
    very many orders is numbered by many tasks.
    """
    base = orders.select(
        F.col("o_custkey").cast("string").alias("meeting_id"), F.col("o_orderkey").alias("order_key"),
        F.concat(F.lit("SPEAKER_0"), (F.col("o_orderkey") % 3).cast("string")).alias("speaker"),
        order_sentence(F.col("o_orderkey")).alias("text"),
        F.col("o_orderdate").alias("order_date"), *[c for c in keep if c not in ("o_orderdate",)])
    base = base.withColumn("__chars", F.length("text").cast("long"))
    month = (F.year("order_date") * 12 + F.month("order_date")).cast("long")
    scanned = block_scan(base, ["meeting_id"], month, ["order_date", "order_key"],
                         sums={"segment_index": F.lit(1).cast("long"), "__upto": F.col("__chars")})
    return _with_times(scanned).withColumn("segment_index", (F.col("segment_index") - 1).cast("int"))


def normalise_segments(raw: DataFrame) -> DataFrame:
    """Strip text, drop blanks, shift by the chunk offset and clamp to the chunk length.

    ``raw``: meeting_id, chunk_offset, chunk_seconds (nullable), start_time, end_time, text, ...
    """
    limit = F.col("chunk_offset") + F.col("chunk_seconds")
    end = F.coalesce(F.least(F.col("end_time") + F.col("chunk_offset"), limit), F.col("end_time") + F.col("chunk_offset"))
    return (raw.withColumn("text", strip(F.col("text"))).filter(F.col("text") != "")
            .withColumn("__end", end)
            .withColumn("start_time", F.least(F.col("start_time") + F.col("chunk_offset"), F.col("__end")))
            .withColumn("end_time", F.col("__end"))
            .drop("__end", "chunk_offset", "chunk_seconds"))


def append_segments(existing: DataFrame, new: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Give new rows consecutive positions after the last stored one of their meeting.

    ``new`` carries ``arrival`` (position inside the delivery), which orders the rows.
    """
    numbered = row_index(new, ["meeting_id"], index_block("arrival", block_rows), ["arrival"], "__n")
    last = existing.groupBy("meeting_id").agg((F.max("segment_index") + 1).alias("__next"))
    return (numbered.join(last, "meeting_id", "left")
            .withColumn("segment_index", (F.coalesce("__next", F.lit(0)) + F.col("__n")).cast("int"))
            .drop("__n", "__next"))
