"""Queries over transcript text: functions, ranking and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar as WG
from ..functions import phrases as P
from ..functions import sentence_rules as SR
from ..functions import text as T
from ..functions import values as V
from ..operators import ranking as R
from ..operators import topics as G
from ..session import cut
from ..sources import orders_world as O
from ..sources import transcripts as X
from . import sql as Q
from .core_queries import r6
from .registry import query
from .sql import with_


def docs(spark, path):
    return X.documents_as_utterances(X.text_table(spark, path, "documents"))


def convs(spark, path):
    return X.conversations_as_utterances(X.text_table(spark, path, "conversations"))


def orders(spark, path):
    return X.orders_as_utterances(X.table(spark, path, "orders"))


def order_texts(spark, path):
    """Order sentences without positions, for row-wise functions."""
    o = X.text_table(spark, path, "orders")
    return o.select(F.col("o_orderkey").alias("order_key"), X.order_sentence(F.col("o_orderkey")).alias("text"))


# -- functions over documents and conversations ---------------------------------

@query("clean_text", f"SELECT doc_id, {Q.clean('text')} AS clean FROM documents")
def _(spark, path):
    return X.text_table(spark, path, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("split_sentences", f"SELECT doc_id, CAST(generate_subscripts({Q.sentences('text')}, 1) - 1 AS INTEGER) AS pos, unnest({Q.sentences('text')}) AS sentence FROM documents")
def _(spark, path):
    return X.text_table(spark, path, "documents").select(
        "doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


@query("split_sentences_strict", f"SELECT conv_id, turn, array_to_string({Q.strict_pieces('text')}, '|') AS pieces FROM conversations")
def _(spark, path):
    return X.text_table(spark, path, "conversations").select(
        "conv_id", "turn", F.array_join(T.split_sentences_strict(F.col("text")), "|").alias("pieces"))


@query("summary_sentences_of_text", f"""SELECT conv_id, turn, array_to_string(CASE WHEN len(kept) = 0 THEN [text] ELSE kept END, '|') AS kept FROM (
  SELECT *, list_filter({Q.strict_pieces('text')}, lambda s: {Q.keeps_in_summary('s')}) AS kept FROM conversations)""")
def _(spark, path):
    return X.text_table(spark, path, "conversations").select(
        "conv_id", "turn", F.array_join(T.summary_sentences(F.col("text")), "|").alias("kept"))


@query("tokens_basic", "SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ') AS tokens FROM conversations")
def _(spark, path):
    return X.text_table(spark, path, "conversations").select(
        "conv_id", "turn", F.array_join(T.tokens_basic(F.col("text")), " ").alias("tokens"))


@query("tokens_topic", f"SELECT doc_id, array_to_string({Q.topic_tokens('text')}, ' ') AS tokens FROM documents")
def _(spark, path):
    return X.text_table(spark, path, "documents").select(
        "doc_id", F.array_join(T.tokens_topic(F.col("text")), " ").alias("tokens"))


@query("tokens_summary", f"SELECT doc_id, array_to_string({Q.summary_tokens('text')}, ' ') AS tokens FROM documents")
def _(spark, path):
    return X.text_table(spark, path, "documents").select(
        "doc_id", F.array_join(T.tokens_summary(F.col("text")), " ").alias("tokens"))


@query("tokens_norm", rf"""SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '),
  lambda t: t <> '' AND NOT list_contains({Q.words(V.NORM_STOP)}, t)), ' ') AS tokens FROM documents""")
def _(spark, path):
    return X.text_table(spark, path, "documents").select(
        "doc_id", F.array_join(T.tokens_norm(F.col("text")), " ").alias("tokens"))


@query("jaccard", f"""SELECT conv_id, turn, round({Q.jaccard("regexp_extract_all(lower(text), '[a-z0-9'']+')", "regexp_extract_all(lower(prev), '[a-z0-9'']+')")}, 6) AS jaccard FROM (
  SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL""")
def _(spark, path):
    c = X.text_table(spark, path, "conversations")
    prev = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prev"))
    a, b = F.array_distinct(T.tokens_basic(F.col("text"))), F.array_distinct(T.tokens_basic(F.col("prev")))
    return c.join(prev, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.jaccard(a, b), 6).alias("jaccard"))


@query("truncate_words", """SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(substr(text, 1, 200), '(?s) [^ ]*$', '') || '…' END AS short FROM documents""")
def _(spark, path):
    return X.text_table(spark, path, "documents").select("doc_id", T.truncate_words(F.col("text")).alias("short"))


#: Letters whose capital is several letters; upper of the SQL engine has a single one for them, or none.
SEVERAL_CAPITALS = {chr(c): chr(c).upper() for c in range(0x10000) if len(chr(c).upper()) > 1}


def capitalised(x: str) -> str:
    """The first letter in capitals, with every letter of its full mapping."""
    several = " ".join(f"WHEN {Q.lit(c)} THEN {Q.lit(u)}" for c, u in SEVERAL_CAPITALS.items())
    return f"(CASE substr({x}, 1, 1) {several} ELSE upper(substr({x}, 1, 1)) END || substr({x}, 2))"


#: White space of all scripts is stripped, as the query does.
BARE = r"regexp_replace(text, '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g')"


@query("casing", f"""SELECT doc_id, CASE WHEN bare = '' THEN '' ELSE {capitalised('bare')} END AS capitalised,
  array_to_string(list_transform(string_split(source, ' '), lambda w: CASE WHEN list_contains({Q.words(V.KEEP_UPPER)}, w) THEN upper(w) ELSE {capitalised('w')} END), ' ') AS titled
  FROM (SELECT *, {BARE} AS bare FROM documents)""")
def _(spark, path):
    return X.text_table(spark, path, "documents").select(
        "doc_id", T.capitalize_first(F.col("text")).alias("capitalised"), T.title_case_terms(F.col("source")).alias("titled"))


@query("strip_terminal", f"SELECT conv_id, turn, {Q.strip_terminal('text')} AS bare FROM conversations")
def _(spark, path):
    return X.text_table(spark, path, "conversations").select("conv_id", "turn", T.strip_terminal(F.col("text")).alias("bare"))


@query("bigrams", f"""SELECT conv_id, turn, array_to_string({Q.bigrams("toks")}, '|') AS bigrams FROM (SELECT *, {Q.topic_tokens('text')} AS toks FROM conversations)""")
def _(spark, path):
    return X.text_table(spark, path, "conversations").select(
        "conv_id", "turn", F.array_join(T.ngrams(T.tokens_topic(F.col("text")), 2), "|").alias("bigrams"))


LINE = "regexp_replace(line, '\\s+$', '')"


@query("summary_blocks", rf"""WITH marked AS (SELECT page_id, generate_subscripts(string_split(md, chr(10)), 1) AS i, unnest(string_split(md, chr(10))) AS line FROM (
  SELECT page_id, replace(replace(replace(replace(html, '<p>', chr(10)), '<li>', chr(10) || '- '), '<h1>', chr(10) || '# '), '<h2>', chr(10) || '> ') AS md FROM pages)),
kinds AS (SELECT page_id, i, line, CASE WHEN trim(regexp_replace(line, '^\s+|\s+$', '', 'g')) IN ('', '---') THEN NULL WHEN starts_with(line, '#') THEN 'heading'
  WHEN regexp_matches(line, '^\s*[•\-]\s+') OR regexp_matches(line, '^\s*\d+\.\s+') THEN 'bullet' WHEN starts_with(line, '>') THEN 'quote' WHEN starts_with(line, '|') THEN NULL ELSE 'para' END AS kind FROM marked)
SELECT page_id, kind, count(*) AS lines FROM kinds WHERE kind IS NOT NULL GROUP BY 1, 2""")
def _(spark, path):
    page = X.text_table(spark, path, "pages")
    md = F.col("html")
    for tag, mark in (("<p>", "\n"), ("<li>", "\n- "), ("<h1>", "\n# "), ("<h2>", "\n> ")):
        md = F.replace(md, F.lit(tag), F.lit(mark))
    lines = page.select("page_id", F.explode(F.split(md, "\n")).alias("line"))
    return (lines.select("page_id", T.summary_line_kind(F.col("line")).alias("kind")).filter("kind is not null")
            .groupBy("page_id", "kind").agg(F.count("*").alias("lines")))


PAGE_LINES = r"""WITH marked AS (SELECT page_id, url, unnest(range(0, len(string_split(md, chr(10))))) AS n, unnest(string_split(md, chr(10))) AS line FROM (
  SELECT page_id, url, replace(replace(replace(replace(html, '<p>', chr(10)), '<li>', chr(10) || '- '), '<h1>', chr(10) || '# '), '<h2>', chr(10) || '> ') AS md FROM pages)),
kinds AS (SELECT page_id, url, n, line, CASE WHEN trim(regexp_replace(line, '^\s+|\s+$', '', 'g')) IN ('', '---') THEN NULL WHEN starts_with(line, '#') THEN 'heading'
  WHEN regexp_matches(line, '^\s*[•\-]\s+') OR regexp_matches(line, '^\s*\d+\.\s+') THEN 'bullet' WHEN starts_with(line, '>') THEN 'quote' WHEN starts_with(line, '|') THEN NULL ELSE 'para' END AS kind FROM marked),
plain AS (SELECT *, regexp_replace(regexp_replace(CASE kind WHEN 'heading' THEN regexp_replace(regexp_replace(line, '^[# ]+', ''), '^\s+', '')
  WHEN 'bullet' THEN regexp_replace(line, '^\s*(?:[•\-]|\d+\.)\s+', '') WHEN 'quote' THEN regexp_replace(regexp_replace(line, '^[> ]+', ''), '^\s+', '') ELSE regexp_replace(line, '^\s+', '') END, '\s+$', ''), '\*\*([^*]+)\*\*', '\1', 'g') AS t1 FROM kinds),
blocks AS (SELECT page_id, url, n, kind, regexp_replace(regexp_replace(t1, '\*([^*]+)\*', '\1', 'g'), '`([^`]+)`', '\1', 'g') AS text FROM plain WHERE kind IS NOT NULL)
"""


def page_lines(spark, path):
    """The pages as lines of Markdown."""
    md = F.col("html")
    for tag, mark in (("<p>", "\n"), ("<li>", "\n- "), ("<h1>", "\n# "), ("<h2>", "\n> ")):
        md = F.replace(md, F.lit(tag), F.lit(mark))
    return X.text_table(spark, path, "pages").select(F.col("page_id").alias("meeting_id"), F.posexplode(F.split(md, "\n")).alias("n", "line"))


@query("summary_block_text", PAGE_LINES + "SELECT page_id, n, kind, text FROM blocks QUALIFY NOT (kind = 'heading' AND n = min(n) OVER (PARTITION BY page_id))")
def _(spark, path):
    return T.summary_blocks(page_lines(spark, path)).select(F.col("meeting_id").alias("page_id"), F.col("n").cast("long").alias("n"), "kind", "text")


@query("summary_points", PAGE_LINES + """, own AS (SELECT page_id, n, text FROM blocks WHERE kind IN ('para', 'bullet') AND length(text) > 20 AND page_id % 3 <> 0),
points AS (SELECT * FROM own UNION ALL SELECT page_id, 1, 'See ' || url FROM pages WHERE page_id NOT IN (SELECT page_id FROM own))
SELECT page_id, place, text AS point FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n, text) AS place, text FROM points) WHERE place <= 6""")
def _(spark, path):
    # of every third page only the short lines are a summary, so it falls back on its address
    lines = page_lines(spark, path).withColumn("line", F.when((F.col("meeting_id") % 3 != 0) | T.summary_line_kind(F.col("line")).isin("heading", "quote"), F.col("line")).otherwise(""))
    other = X.text_table(spark, path, "pages").select(F.col("page_id").alias("meeting_id"), F.lit(1).alias("n"), F.concat(F.lit("See "), "url").alias("point"))
    return T.summary_points(lines, other).select(F.col("meeting_id").alias("page_id"), F.col("place").cast("long").alias("place"), "point")


# -- phrase functions over order transcripts ---------------------------------------

#: Name of a flag: (its part, whether it must stand at the start).
FLAGS = {"wh_question": (SR.WH_QUESTION, True), "condition_start": (SR.CONDITION_START, True), "condition": (SR.CONDITION, False), "hedge": (SR.HEDGE, False),
         "done": (SR.DONE, False), "proposal": (SR.PROPOSAL, True), "agreement": (SR.AGREEMENT, True), "disagreement": (SR.DISAGREEMENT, True),
         "vague": (SR.VAGUE, True), "meeting_flow": (SR.MEETING_FLOW, True), "negated": (SR.NEGATION, False)}
PLAIN = {n: ("^" if start else "") + f"(?:{p.plain})" for n, (p, start) in FLAGS.items()}


def flagged(table: str, key: str) -> str:
    return f"SELECT {key}, " + ", ".join(f"{Q.matches(Q.clean('text'), p)} AS {n}" for n, p in {"question": P.QUESTION, **PLAIN}.items()) + f" FROM {table}"


def _flags(df, key):
    clean = df.withColumn("clean", T.clean_text(F.col("text"))).withColumn("signs", F.expr(WG.signs(WG.pieces("clean"))))
    found = [F.expr((WG.starts if start else WG.holds)("signs", p)).alias(n) for n, (p, start) in FLAGS.items()]
    return clean.select(key, T.matches(F.col("clean"), P.QUESTION).alias("question"), *found)


@query("sentence_flags", with_("ord", flagged("ord", "k")))
def _(spark, path):
    return _flags(order_texts(spark, path).withColumn("k", F.col("order_key")), "k")


@query("find_due", with_("ord", f"""SELECT k, coalesce(nullif(rtrim(regexp_extract(text, {Q.lit('(?i)' + SR.DUE_PHRASE.plain)})), ''), nullif(rtrim(regexp_extract(text, {Q.lit('(?i)' + SR.DUE_WORD.plain)})), '')) AS due FROM ord"""))
def _(spark, path):
    return order_texts(spark, path).select(F.col("order_key").alias("k"), T.find_due("text").alias("due"))


@query("split_rationale", with_("ord", """SELECT k, CASE k % 20 WHEN 6 THEN 'We decided to cancel order ' || CAST(k AS VARCHAR) ELSE text END AS head, CASE k % 20 WHEN 6 THEN 'The stock is gone' END AS rationale FROM ord"""))
def _(spark, path):
    parts = order_texts(spark, path).select(F.col("order_key").alias("k"), T.split_rationale(F.col("text")).alias("r"))
    return parts.select("k", "r.head", "r.rationale")


@query("addressee", with_("ord", "SELECT k, CASE WHEN k % 20 = 3 THEN 'Tomas' END AS name FROM ord"))
def _(spark, path):
    return order_texts(spark, path).select(F.col("order_key").alias("k"), T.addressee(F.col("text")).alias("name"))


@query("starts_with_action_verb", with_("items", "SELECT item_id, true AS verb_first FROM items"))
def _(spark, path):
    packed = O.action_items(spark, path).withColumn("description", F.regexp_replace("description", "^Pack", "Packing, prepare"))
    bare = packed.withColumn("bare", F.regexp_replace(F.col("description"), "^Packing, ", ""))
    bare = bare.withColumn("signs", F.expr(WG.signs(WG.pieces("bare"))))
    return bare.selectExpr("item_id", f"{T.starts_with_action_verb('bare', 'signs')} AS verb_first")


@query("resolve_pronouns", with_("items", """SELECT item_id, CASE WHEN owner IS NULL THEN 'Send me ' || description || ' for my desk and your file'
  ELSE 'Send ' || owner || ' ' || description || ' for ' || owner || '''s desk and Zoe''s file' END AS resolved FROM items"""))
def _(spark, path):
    items = O.action_items(spark, path)
    text = F.concat(F.lit("Send me "), F.col("description"), F.lit(" for my desk and your file"))
    known = F.col("owner").isNotNull()
    speaker = F.coalesce("owner", F.lit("SPEAKER_00"))
    return items.select("item_id", T.resolve_pronouns(
        text, speaker, F.when(known, F.lit("Zoe")).otherwise(F.lit("SPEAKER_01"))).alias("resolved"))


# -- ranking ----------------------------------------------------------------------

def _placed(scored):
    return scored.select("meeting_id", "sentence", "score")


@query("summary_sentences", with_("conv_sents", "SELECT meeting_id, sentence FROM conv_sents"))
def _(spark, path):
    return R.summary_sentences(convs(spark, path)).select("meeting_id", "sentence")


@query("summary_sentences_across_segments", with_("ord_sents", "SELECT meeting_id, sentence FROM ord_sents"))
def _(spark, path):
    return R.summary_sentences(O.segments(spark, path)).select("meeting_id", "sentence")


@query("tfidf_rank", with_("doc_tfidf", """, top AS (SELECT DISTINCT meeting_id, sentence FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY score DESC, i) AS rn FROM doc_tfidf) WHERE rn <= 5)
SELECT d.meeting_id, d.sentence, d.score FROM doc_tfidf d SEMI JOIN top t ON d.meeting_id = t.meeting_id AND d.sentence = t.sentence"""))
def _(spark, path):
    return _placed(R.tfidf_rank(R.summary_sentences(X.document_sentences(X.text_table(spark, path, "documents"))), 5))


@query("freq_rank", with_("conv_fscore", "SELECT meeting_id, sentence, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY score DESC, i) AS rn FROM conv_fscore) WHERE rn <= 5"))
def _(spark, path):
    u = convs(spark, path)
    return _placed(R.freq_rank(cut(R.summary_sentences(u)), R.term_frequencies(u), 5))


@query("keywords", with_("doc_freq", "SELECT meeting_id, rank, term, n, round(freq, 6) AS freq FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY n DESC, first_at) AS INTEGER) AS rank FROM doc_freq) WHERE rank <= 10"))
def _(spark, path):
    return R.keywords(R.term_counts(docs(spark, path))).select("meeting_id", "rank", "term", "n", r6("freq"))


@query("meeting_theme", with_(["meetings", "topics", "ord_freq"], """SELECT m.meeting_id, coalesce(t.titles, w.words, 'organizational discussion') AS theme FROM meetings m
  LEFT JOIN (SELECT meeting_id, string_agg(trim(title), ', ' ORDER BY rn) AS titles FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY topic_no) AS rn FROM topics) WHERE rn <= 3 GROUP BY 1) t USING (meeting_id)
  LEFT JOIN (SELECT meeting_id, string_agg(term, ', ' ORDER BY rn) AS words FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY n DESC, first_at) AS rn FROM ord_freq) WHERE rn <= 4 GROUP BY 1) w USING (meeting_id)"""))
def _(spark, path):
    words = R.keywords(R.term_counts(O.segments(spark, path)))
    return R.meeting_theme(O.meetings(spark, path), words, O.topics(spark, path))


# -- topics -------------------------------------------------------------------------

@query("block_similarity", with_("doc_sims", "SELECT meeting_id, CAST(gap AS INTEGER) AS gap, sim FROM doc_sims"))
def _(spark, path):
    return G.block_similarity(cut(G.topic_tokens(docs(spark, path)))).select("meeting_id", "gap", "sim")


@query("smoothed_similarity", with_("doc_smooth", "SELECT meeting_id, CAST(gap AS INTEGER) AS gap, sim FROM doc_smooth"))
def _(spark, path):
    return G.smooth(cut(G.block_similarity(cut(G.topic_tokens(docs(spark, path)))))).select("meeting_id", "gap", "sim")


@query("depth_score", with_("doc_depth", "SELECT meeting_id, CAST(gap AS INTEGER) AS gap, depth FROM doc_depth"))
def _(spark, path):
    sims = cut(G.block_similarity(cut(G.topic_tokens(docs(spark, path)))))
    return G.depth_score(cut(G.smooth(sims))).select("meeting_id", "gap", "depth")


@query("choose_cuts", with_("doc_cuts", "SELECT meeting_id, array_to_string(cuts, ',') AS cuts FROM doc_cuts"))
def _(spark, path):
    return G.find_cuts(cut(G.topic_tokens(docs(spark, path)))).select(
        "meeting_id", F.concat_ws(",", F.col("cuts").cast("array<string>")).alias("cuts"))


@query("segment_topics", with_(["doc_blocks", "doc_titles", "doc_summaries"], """SELECT b.meeting_id, b.block_no, t.title, s.summary, b.first_segment, b.last_segment, round(b.start_time, 6) AS start_time, round(b.end_time, 6) AS end_time FROM
  (SELECT meeting_id, block_no, min(segment_index) AS first_segment, max(segment_index) AS last_segment, arg_min(start_time, segment_index) AS start_time, arg_max(end_time, segment_index) AS end_time FROM doc_blocks GROUP BY 1, 2) b
  JOIN doc_titles t USING (meeting_id, block_no) JOIN doc_summaries s USING (meeting_id, block_no)"""))
def _(spark, path):
    return G.segment_topics(docs(spark, path)).select(
        "meeting_id", "block_no", "title", "summary", "first_segment", "last_segment", r6("start_time"), r6("end_time"))
