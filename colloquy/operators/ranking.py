"""Extractive ranking of sentences and keywords."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import text as T
from ..session import cut, free_shuffles
from .blocks import block_scan, index_block
from .filters import top_k

SENTENCE = ["meeting_id", "segment_index", "piece_no"]


def summary_sentences(utterances: DataFrame) -> DataFrame:
    """Sentences of the whole transcript: meeting_id, segment_index, piece_no, sentence.

    Segments are cleaned and read as one running text, so a sentence may continue
    over several segments.  A segment's first piece opens a sentence only when the
    text before it ends with a sentence mark and it starts with a capital letter;
    the running count of openings numbers the sentences.  A sentence is identified
    by the position of its first piece.  Small talk and fragments under four words
    are dropped; a meeting with nothing left keeps its whole text as one sentence.  The rows
    are stored.
    """
    clean = utterances.select("meeting_id", "segment_index", T.clean_text(F.col("text")).alias("clean")).filter("clean <> ''")
    shaped = clean.withColumn("pieces", T.split_sentences_strict(F.col("clean")))
    # Cleaning and splitting happen once; the scans, which move no texts, the sentences and the fallback read the
    # stored rows, in which a text stands beside its pieces only where they do not give it back.
    joint = F.array_join("pieces", " ")
    edges = cut(shaped.withColumn("opens", F.col("clean").rlike("^[A-Z]")).withColumn("ends", F.col("clean").rlike("[.!?]$"))
                .withColumn("clean", F.when(joint != F.col("clean"), F.col("clean"))).withColumn("row", F.monotonically_increasing_id()))
    block = index_block("segment_index")
    linked = block_scan(edges.select("meeting_id", "segment_index", "row", "opens", "ends", F.size("pieces").alias("many")), ["meeting_id"], block, ["segment_index"], lags={"prev_ends": F.col("ends")})
    joined = linked.withColumn("continues", F.col("prev_ends").isNotNull() & ~(F.col("prev_ends") & F.col("opens")))
    # A segment holds ``many`` pieces; the first one may belong to the sentence before.
    own = F.col("many") - F.col("continues").cast("int")
    counted = block_scan(joined.select("meeting_id", "segment_index", "row", "continues", own.cast("long").alias("own")),
                         ["meeting_id"], block, ["segment_index"], sums={"upto": F.col("own")})
    before = counted.select("row", (F.col("upto") - F.col("own")).alias("__before"), "continues")
    pieces = edges.select("meeting_id", "segment_index", "pieces", "row").join(before, "row").select(
        "meeting_id", "segment_index", F.posexplode("pieces").alias("piece_no", "piece"), "__before", "continues").withColumn(
        "sentence_no", F.col("__before") + F.col("piece_no") + F.when(F.col("continues"), 0).otherwise(1))
    whole = pieces.groupBy("meeting_id", "sentence_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment_index", "piece_no", "piece"))),
                                 lambda p: p["piece"]), " ").alias("sentence"),
        F.min(F.struct("segment_index", "piece_no")).alias("at"))
    placed = whole.select("meeting_id", F.col("at.segment_index"), F.col("at.piece_no"), "sentence")
    kept = cut(placed.filter(T.keeps_in_summary(F.col("sentence"))))
    free_shuffles(kept.sparkSession)
    empty = edges.select("meeting_id", "segment_index", F.coalesce("clean", joint).alias("clean")).join(
        kept.select("meeting_id").distinct(), "meeting_id", "left_anti")
    fallback = empty.groupBy("meeting_id").agg(
        F.min("segment_index").alias("segment_index"), F.lit(0).alias("piece_no"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment_index", "clean"))), lambda s: s["clean"]),
                     " ").alias("sentence"))
    return kept.unionByName(cut(fallback))


#: Segments whose sentences are scored in one row.
SCORE_BLOCK = 256


def _block_scores(blocks: DataFrame) -> DataFrame:
    """``blocks`` (rows, each with its words, and dfs) with ``scores``, one for each of the rows."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for held, known in zip(batch.column("rows"), batch.column("dfs")):
                held, known = held.values, known.values
                n = len(held)
                lists = pc.split_pattern(held.field("words"), " ")
                words = lists.flatten()
                some = pc.not_equal(words, "")  # what a sentence without words is split into
                row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))[some.to_numpy(zero_copy_only=False)]
                coded = words.filter(some).dictionary_encode()
                many = max(len(coded.dictionary), 1)
                pairs, tf = np.unique(row * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                row, term = pairs // many, pairs % many
                if len(known):
                    at = pc.index_in(coded.dictionary, known.field("term"))
                    df, n_all = (known.field(c).take(at).to_numpy(zero_copy_only=False) for c in ("df", "n"))
                else:
                    df, n_all = np.bincount(term, minlength=many), n
                idf = np.log((1 + n_all) / (1 + df))
                most, length = np.ones(n), np.bincount(row, tf, n)
                np.maximum.at(most, row, tf)
                sums = np.bincount(row, tf * (tf / most[row] * idf[term]), n)
                found.append(np.where(length > 0, sums / np.maximum(length, 1), 0.0))
            scores = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), pa.array(np.concatenate([np.zeros(0), *found])))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "scores"])

    return blocks.mapInArrow(make, StructType([*blocks.schema.fields, StructField("scores", ArrayType(DoubleType()))]))


def tfidf_scores(sentences: DataFrame, keys: tuple[str, ...] = ("meeting_id",), size: int = SCORE_BLOCK) -> DataFrame:
    """Score of a sentence: sum over token occurrences of tf/max_tf * idf, divided by its length.

    Sentences are grouped by key and block of ``size`` segments and shuffled once.  The
    sentences that hold a term are counted inside the block where that is the whole key;
    terms of longer keys are counted over their blocks and sent to each block that holds them.
    """
    keys = list(keys)
    own = [c for c in sentences.columns if c not in keys]
    at = index_block("segment_index", size)
    words = T.tokens_summary(F.col("sentence"))
    spans = cut(sentences.groupBy(*keys).agg(F.min(at).alias("__low"), F.max(at).alias("__high"), F.count("*").alias("__n")).filter("__low < __high").drop("__low", "__high"))
    held = (sentences.join(spans, keys).select(*keys, "__n", at.alias("__block"), F.explode(F.array_distinct(words)).alias("term"))
            .groupBy(*keys, "__n", "term", "__block").agg(F.count("*").alias("own")))
    df = held.groupBy(*keys, "term").agg(F.sum("own").alias("df"))
    row = F.struct(*own, F.array_join(words, " ").alias("words"))
    placed = sentences.select(*keys, at.alias("__block"), row.alias("row"))
    no_row = F.lit(None).cast(placed.schema["row"].dataType)
    parts = placed.withColumn("df", F.lit(None).cast("struct<term:string,df:bigint,n:bigint>")).unionByName(
        held.join(df, [*keys, "term"]).select(*keys, "__block", no_row.alias("row"), F.struct("term", "df", F.col("__n").alias("n")).alias("df")))
    blocks = parts.groupBy(*keys, "__block").agg(F.collect_list("row").alias("rows"), F.collect_list("df").alias("dfs"))
    scored = _block_scores(blocks.select(*keys, "rows", "dfs")).select(*keys, F.explode(F.arrays_zip("rows", "scores")).alias("x"))
    columns = {c: F.col(f"x.rows.{c}") for c in own}
    return scored.select(*[(columns[c] if c in columns else F.col(c)).alias(c) for c in sentences.columns], F.round("x.scores", 9).alias("score"))


def best_texts(scored: DataFrame, k: int, keys: tuple[str, ...] = ("meeting_id",)) -> DataFrame:
    """Top ``k`` sentences, earlier ones first on ties; repeats of a winner's text come along.

    Equal texts of a key have equal scores, so repeats lie among the rows whose score is one
    of the best ``k``; only those are stored and compared.
    """
    order = [F.col("score").desc(), F.col("segment_index"), F.col("piece_no")]
    place = F.rank().over(Window.partitionBy(*keys).orderBy(F.col("score").desc()))
    near = cut(scored.withColumn("__place", place).filter(F.col("__place") <= k).drop("__place"))
    winners = top_k(near, keys, order, k).select(*keys, "sentence").distinct()
    return near.join(winners, [*keys, "sentence"], "left_semi")


def tfidf_rank(sentences: DataFrame, k: int = 5, keys: tuple[str, ...] = ("meeting_id",)) -> DataFrame:
    return best_texts(tfidf_scores(sentences, keys), k, keys)


def term_counts(utterances: DataFrame, keys: tuple[str, ...] = ("meeting_id",)) -> DataFrame:
    """``n``, the count of each term, and ``first_at``, its first appearance."""
    # Words are sifted as rows, which Spark compiles; ``token_no`` counts the others too.
    words = utterances.select(*keys, "segment_index", F.posexplode(T.words_summary(T.clean_text(F.col("text")))).alias("token_no", "term"))
    toks = words.filter(T.counts_in_summary(F.col("term")))
    # Both places as one number: a minimum of numbers is kept in a hash table, one of structs needs the tokens in order.
    at = F.shiftleft(F.col("segment_index").cast("long"), 32).bitwiseOR(F.col("token_no").cast("long"))
    counts = toks.groupBy(*keys, "term").agg(F.count("*").alias("n"), F.min(at).alias("at"))
    return counts.select(*keys, "term", "n", F.struct(
        F.shiftright("at", 32).cast(utterances.schema["segment_index"].dataType).alias("segment_index"),
        F.col("at").bitwiseAND(0xFFFFFFFF).cast("int").alias("token_no")).alias("first_at"))


def term_frequencies(utterances: DataFrame, keys: tuple[str, ...] = ("meeting_id",)) -> DataFrame:
    """:func:`term_counts`, stored, and counts relative to the most frequent term."""
    counts = cut(term_counts(utterances, keys))
    top = counts.groupBy(*keys).agg(F.max("n").alias("top"))
    return counts.join(top, list(keys)).select(*keys, "term", "n", (F.col("n") / F.col("top")).alias("freq"), "first_at")


def freq_scores(sentences: DataFrame, frequencies: DataFrame, keys: tuple[str, ...] = ("meeting_id",)) -> DataFrame:
    """Mean relative term frequency of the words of a sentence; sentences without words score 0.

    Words meet their frequency one by one, so they are shuffled by term and then by sentence and not counted before.
    """
    own = [*keys, "segment_index", "piece_no"]
    words = sentences.select(*own, F.explode(T.words_summary(F.col("sentence"))).alias("term")).filter(T.counts_in_summary(F.col("term")))
    weighted = words.join(frequencies.select(*keys, "term", "freq"), [*keys, "term"], "left")
    score = weighted.groupBy(*own).agg(F.round(F.sum(F.coalesce("freq", F.lit(0.0))) / F.count("*"), 9).alias("score"))
    return sentences.join(score, own, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def freq_rank(sentences: DataFrame, frequencies: DataFrame, k: int = 5) -> DataFrame:
    order = [F.col("score").desc(), F.col("segment_index"), F.col("piece_no")]
    return top_k(freq_scores(sentences, frequencies), ["meeting_id"], order, k)


def keywords(counts: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent terms; ``counts``: meeting_id, term, n, first_at.  The first of them has the count that ``freq`` is relative to."""
    best = top_k(counts, ["meeting_id"], [F.col("n").desc(), F.col("first_at")], k)
    return best.select("meeting_id", "rank", "term", "n", (F.col("n") / F.max("n").over(Window.partitionBy("meeting_id"))).alias("freq"))


def meeting_theme(meetings: DataFrame, top_words: DataFrame, topics: DataFrame) -> DataFrame:
    """First three topic titles, else the four leading words, else a default."""
    titled = top_k(topics.filter(F.coalesce("title", F.lit("")) != ""), ["meeting_id"], [F.col("topic_no")], 3)
    by_title = titled.groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("rank", T.strip(F.col("title")).alias("t")))), lambda x: x["t"]), ", ").alias("titles"))
    by_word = top_words.filter("rank <= 4").groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("words"))
    return (meetings.select("meeting_id").join(by_title, "meeting_id", "left").join(by_word, "meeting_id", "left")
            .select("meeting_id", F.coalesce("titles", "words", F.lit("organizational discussion")).alias("theme")))
