"""Queries over extraction, recurring topics, summaries and minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases as P
from ..operators import dedupe as DD
from ..operators import intent as I
from ..operators import learning as ML
from ..operators import similarity as SM
from ..operators import rollups as D
from ..session import cut
from ..sources import orders_world as O
from ..sources import transcripts as X
from . import minutes as MI
from . import sql as Q
from . import structure as ST
from . import summaries as SU
from .core_queries import r6
from .registry import query
from .sql import with_
from .text_queries import order_texts, orders

# Expected reading of every order sentence, by key % 20: intent, confidence, description, owner, due, rationale.
READING = {
    0: ("commitment", 0.88, "Send the invoice for order {k} to the carrier by Friday", None, "by Friday", None),
    1: ("commitment", 0.7, "", None, None, None),
    2: ("assignment", 0.98, "Book the freight slot for order {k} next week", "Maria", "next week", None),
    3: ("request", 0.8, "Check the customs papers for order {k}", "Tomas", None, None),
    # "We" has the shape of a name, so the assignment rule comes first; it is not kept as an owner.
    4: ("assignment", 0.85, "Update the delivery plan for order {k}", None, None, None),
    5: ("open_item", 0.62, "Decide on the refund for order {k}", None, None, None),
    6: ("decision", 0.9, "Cancel order {k}", None, None, "The stock is gone"),
    7: ("decision", 0.75, "The discount for order {k} is approved", None, None, None),
    8: ("proposal", 0.5, "Ship order {k} in two parcels", None, None, None),
    9: ("agreement", 0.6, "Sounds good.", None, None, None),
    10: ("disagreement", 0.6, "No, I don't think so.", None, None, None),
    11: ("question", 0.5, "When does order {k} leave the warehouse?", None, None, None),
    12: ("general", 0.0, "If the carrier agrees, I will change the route of order {k}.", None, None, None),
    13: ("done", 0.5, "I already sent the receipt for order {k} yesterday.", None, None, None),
    14: ("general", 0.0, "Hi, this is Lena.", None, None, None),
    15: ("general", 0.0, "everyone, have a great evening.", None, None, None),
    16: ("commitment", 0.8, "Fix the outage on lane {k} right now", None, None, None),
    17: ("request", 0.8, "Confirm the pickup window for order {k} today", None, "today", None),
    18: ("decision", 0.72, "Go with the night train for order {k}", None, None, None),
    19: ("collective", 0.6, "Obtain approval from finance for order {k}", None, None, None),
}


def reading(field: int, key: str = "k") -> str:
    def value(v):
        if v is None:
            return "NULL"
        if isinstance(v, float):
            return f"{v}::DOUBLE"
        head, _, tail = v.partition("{k}")
        return f"{Q.lit(head)} || CAST({key} AS VARCHAR) || {Q.lit(tail)}" if "{k}" in v else Q.lit(v)
    return f"CASE {key} % 20 " + " ".join(f"WHEN {n} THEN {value(r[field])}" for n, r in READING.items()) + " END"


@query("classify_intent", with_("ord", f"""SELECT k, {reading(0)} AS intent, {reading(1)} AS confidence, {reading(2)} AS description, {reading(3)} AS owner,
  {reading(4)} AS due, {reading(5)} AS rationale FROM ord"""))
def _(spark, path):
    seen = I.analyse(order_texts(spark, path).select(F.col("order_key").alias("k"), "text"), "text", "a")
    return seen.select("k", "a.intent", "a.confidence", "a.description", "a.owner", "a.due", "a.rationale")


@query("classify_segment", with_("ord", """SELECT k, CASE WHEN k % 20 IN (0, 1, 2, 3, 4, 5, 16, 17, 19) THEN 'action_item' WHEN k % 20 IN (6, 7, 18) THEN 'decision' ELSE 'general' END AS label FROM ord"""))
def _(spark, path):
    return I.classify_segment(order_texts(spark, path).select(F.col("order_key").alias("k"), "text")).select("k", "label")


@query("score_urgency", with_("ord", f"""SELECT k, CASE WHEN critical >= 4 THEN 'critical' WHEN high >= 3 OR (critical >= 2 AND high >= 1) THEN 'high' WHEN medium >= 2 OR high >= 1 THEN 'medium' ELSE 'low' END AS urgency FROM (SELECT k,
  {", ".join("(" + " + ".join(f"CASE WHEN {Q.matches('text', p)} THEN {w} ELSE 0 END" for p, w in P.URGENCY_SIGNALS[level]) + f") AS {level}" for level in ("critical", "high", "medium"))} FROM ord)"""))
def _(spark, path):
    return I.urgency(order_texts(spark, path).select(F.col("order_key").alias("k"), "text"), F.col("text")).select("k", "urgency")


@query("extract_owner", with_("ord", """, p AS (SELECT *, CASE WHEN k % 20 = 2 THEN 'Maria' END AS own FROM ord)
SELECT k, coalesce(own, lag(own) OVER w, lead(own) OVER w, speaker) AS owner FROM p WINDOW w AS (PARTITION BY meeting_id ORDER BY segment_index)"""))
def _(spark, path):
    return I.extract_owner(orders(spark, path)).select(F.col("order_key").alias("k"), "owner")


NAMES = """, said AS (SELECT DISTINCT meeting_id, speaker FROM ord WHERE k % 20 = 14),
names AS (SELECT DISTINCT o.meeting_id, o.speaker, CASE WHEN s.speaker IS NULL THEN o.speaker ELSE 'Lena' END AS display FROM ord o LEFT JOIN said s ON o.meeting_id = s.meeting_id AND o.speaker = s.speaker)
"""


@query("infer_speaker_names", with_("ord", NAMES + "SELECT meeting_id, speaker, 'Lena' AS name FROM said"))
def _(spark, path):
    return I.infer_speaker_names(orders(spark, path))


def _context(spark, path):
    return I.context_rows(cut(orders(spark, path)))


CONTEXT = NAMES + f""", facts AS (SELECT meeting_id, count(*) AS n_speakers FROM names GROUP BY 1),
a AS (SELECT o.*, n.display, f.n_speakers, k % 20 AS t, {reading(0)} AS intent, {reading(1)} AS conf, {reading(2)} AS description, {reading(3)} AS owner, {reading(4)} AS due, {reading(5)} AS rationale,
  CASE WHEN k % 20 IN (0, 2, 3, 4, 5, 8, 16, 17, 19) THEN k END AS task FROM ord o JOIN names n USING (meeting_id, speaker) JOIN facts f USING (meeting_id)),
w AS (SELECT *, last_value(task IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY segment_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS p2,
  last_value(task IGNORE NULLS) OVER (PARTITION BY meeting_id ORDER BY segment_index ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS p3,
  lead(intent) OVER m AS nx_intent, lead(speaker) OVER m AS nx_speaker, lead(display) OVER m AS nx_display FROM a WINDOW m AS (PARTITION BY meeting_id ORDER BY segment_index)),
agreed AS (SELECT w.meeting_id, w.display, w.text, b.segment_index, b.t, b.description, b.owner, b.due, b.conf, b.text AS before FROM w JOIN a b ON w.p2 = b.k WHERE w.intent = 'agreement' AND (b.speaker <> w.speaker OR w.n_speakers = 1)),
others AS (SELECT x.meeting_id, x.speaker, y.display AS other FROM names x JOIN names y ON x.meeting_id = y.meeting_id AND x.speaker <> y.speaker JOIN facts f ON f.meeting_id = x.meeting_id AND f.n_speakers = 2)
"""


@query("extract_decisions", with_("ord", CONTEXT + """SELECT meeting_id, segment_index, description, rationale, conf AS confidence, text AS evidence, display AS speaker FROM w WHERE t IN (6, 7, 18)
UNION ALL SELECT meeting_id, segment_index, description, NULL, 0.75::DOUBLE, before || ' — ' || text, display FROM agreed WHERE t IN (8, 19)"""))
def _(spark, path):
    return I.extract_decisions(_context(spark, path)).select(
        "meeting_id", "segment_index", "description", "rationale", "confidence", "evidence", "speaker")


ACTIONS = CONTEXT + """, found AS (SELECT meeting_id, segment_index, description, coalesce(owner, display) AS owner, due, round(conf + 0.1, 4) AS confidence, before || ' — ' || text AS evidence, display AS speaker, 'task' AS kind FROM agreed WHERE t IN (3, 17)
UNION ALL SELECT meeting_id, segment_index, description, NULL, due, conf, text, display, 'open_item' FROM w WHERE t = 5
UNION ALL SELECT meeting_id, segment_index, description, CASE WHEN t IN (0, 16) THEN display ELSE owner END, due, conf, text, display, 'task' FROM w WHERE t IN (0, 2, 3, 4, 16, 19)
UNION ALL SELECT w.meeting_id, w.segment_index, b.description, w.display, b.due, round(least(1.0::DOUBLE, greatest(w.conf, b.conf) + 0.05), 2), b.text || ' — ' || w.text, w.display, 'task' FROM w JOIN a b ON w.p3 = b.k WHERE w.t = 1
UNION ALL SELECT w.meeting_id, w.segment_index, description, CASE WHEN nx_speaker <> w.speaker AND nx_intent = 'agreement' THEN nx_display ELSE o.other END, due, conf, text, display, 'task'
  FROM w LEFT JOIN others o ON o.meeting_id = w.meeting_id AND o.speaker = w.speaker WHERE t = 17 AND NOT coalesce(nx_speaker <> w.speaker AND nx_intent = 'commitment', false))
"""


@query("extract_action_items", with_("ord", ACTIONS + "SELECT * FROM found"))
def _(spark, path):
    return I.extract_action_items(_context(spark, path)).select(
        "meeting_id", "segment_index", "description", "owner", "due", "confidence", "evidence", "speaker", "kind")


@query("dedupe_actions")
def _(spark, path):
    return DD.dedupe_actions(cut(I.extract_action_items(_context(spark, path)))).select(
        "meeting_id", "segment_index", "description", "owner", "due", "confidence")


@query("dedupe_decisions")
def _(spark, path):
    return DD.dedupe_decisions(cut(I.extract_decisions(_context(spark, path)))).select(
        "meeting_id", "segment_index", "description", "confidence")


@query("second_opinion")
def _(spark, path):
    seen = cut(I.classify_segment(order_texts(spark, path).select(F.col("order_key").alias("k"), "text")))
    model = ML.train_classifier(seen.filter("label_confidence >= 0.5"), iterations=50)
    return ML.second_opinion(seen, model).select("k", "label")


def doc_topics(spark, path):
    """A topic per document: leading words as title, leading sentences as summary; a document is a meeting."""
    d = X.text_table(spark, path, "documents")
    topics = d.select(
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("topic_id"), F.col("doc_id").cast("string").alias("meeting_id"),
        F.substring("text", 1, 30).alias("title"), F.col("text").alias("summary"))
    meetings = d.select(F.col("doc_id").cast("string").alias("meeting_id"),
                        F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("doc_id") / 3) * 86400).alias("date"))
    return topics, meetings


@query("detect_recurring", """WITH t AS (SELECT 't' || CAST(doc_id AS VARCHAR) AS topic_id, doc_id // 3 AS day, list_distinct(list_filter(regexp_split_to_array(lower(substr(text, 1, 30) || ' ' || text), '\\s+'), lambda w: w <> '')) AS tokens FROM documents),
terms AS (SELECT topic_id, day, len(tokens) AS n, unnest(tokens) AS term FROM t),
pairs AS (SELECT a.topic_id, b.topic_id AS other, b.day, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS sim FROM terms a JOIN terms b ON a.term = b.term AND b.day < a.day GROUP BY 1, 2, 3),
best AS (SELECT * FROM pairs WHERE sim >= 0.4 QUALIFY ROW_NUMBER() OVER (PARTITION BY topic_id ORDER BY day DESC, sim DESC, other) = 1)
SELECT t.topic_id, b.other IS NOT NULL AS is_recurring, b.other AS previous_topic_id, round(b.sim, 6) AS similarity FROM t LEFT JOIN best b USING (topic_id)""")
def _(spark, path):
    return SM.detect_recurring(*doc_topics(spark, path)).select("topic_id", "is_recurring", "previous_topic_id", r6("similarity"))


@query("minhash_signature")
def _(spark, path):
    topics, _ = doc_topics(spark, path)
    rows = topics.withColumn("row", F.monotonically_increasing_id())
    return SM.signatures(rows, ["row", "topic_id"], SM.topic_token_set(F.col("title"), F.col("summary")), "signature").select("topic_id", "signature")


# -- summaries and minutes ---------------------------------------------------------------

URGENT = """CASE coalesce(urgency, 'low') WHEN 'critical' THEN '🚨 Critical' WHEN 'high' THEN '🔴 High Priority' WHEN 'medium' THEN '🟡 Medium Priority' ELSE '🟢 Low Priority' END"""
TOPS = """, pos AS (SELECT s.*, count(*) OVER (PARTITION BY s.meeting_id) AS total, f.score AS fscore, ROW_NUMBER() OVER (PARTITION BY s.meeting_id ORDER BY s.score DESC, s.i) AS rk,
  m.summary_type FROM ord_tfidf s JOIN ord_fscore f USING (meeting_id, i) JOIN meetings m USING (meeting_id)),
win AS (SELECT DISTINCT meeting_id, sentence FROM pos WHERE rk <= CASE summary_type WHEN 'brief' THEN 3 WHEN 'balanced' THEN 5 ELSE 6 END),
shown AS (SELECT p.meeting_id, p.sentence, ROW_NUMBER() OVER (PARTITION BY p.meeting_id ORDER BY p.i) AS rn FROM pos p SEMI JOIN win w ON p.meeting_id = w.meeting_id AND p.sentence = w.sentence),
top AS (SELECT meeting_id, max(CASE WHEN rn = 1 THEN sentence END) AS s0, max(CASE WHEN rn = 2 THEN sentence END) AS s1, max(CASE WHEN rn = 3 THEN sentence END) AS s2 FROM shown GROUP BY 1),
opener AS (SELECT meeting_id, arg_min(sentence, (-fscore, i)) AS opener FROM pos WHERE i <= greatest(total // 3, 1) GROUP BY 1),
closer AS (SELECT meeting_id, arg_min(sentence, (-fscore, i)) AS closer FROM pos WHERE i > total - (total // 3 + 1) GROUP BY 1),
kw AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY n DESC, first_at) AS rn FROM ord_freq),
tt AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY topic_no) AS rn FROM topics),
dd AS (SELECT *, description || CASE WHEN rationale IS NULL THEN '' ELSE ' — *' || rationale || '*' END AS shown, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY segment_index, decision_id) AS rn FROM decisions),
aa AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY segment_index, item_id) AS rn FROM items),
feat AS (SELECT m.meeting_id, m.summary_type, top.s0, top.s1, top.s2, o.opener, c.closer, t.titles, coalesce(t.theme, k.theme, 'organizational discussion') AS theme, k.words5, k.words6, seg.n, seg.sp FROM meetings m
  JOIN (SELECT meeting_id, count(*) AS n, count(DISTINCT speaker) AS sp FROM segs GROUP BY 1) seg USING (meeting_id) LEFT JOIN top USING (meeting_id) LEFT JOIN opener o USING (meeting_id) LEFT JOIN closer c USING (meeting_id)
  LEFT JOIN (SELECT meeting_id, string_agg(title, '§' ORDER BY rn) FILTER (rn <= 5) AS titles, string_agg(trim(title), ', ' ORDER BY rn) FILTER (rn <= 3) AS theme FROM tt GROUP BY 1) t USING (meeting_id)
  LEFT JOIN (SELECT meeting_id, string_agg(term, ', ' ORDER BY rn) FILTER (rn <= 5) AS words5, string_agg(term, ', ' ORDER BY rn) FILTER (rn <= 6) AS words6, string_agg(term, ', ' ORDER BY rn) FILTER (rn <= 4) AS theme FROM kw GROUP BY 1) k USING (meeting_id))
"""
_NEED = ["ord_tfidf", "ord_fscore", "ord_freq", "meetings", "topics", "decisions", "items", "segs"]


def _text_of(lines):
    """Summaries of bounded depth as one string per meeting."""
    return lines.groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "n", "line"))), lambda x: x["line"]), "\n").alias("summary"))


def _features(spark, path):
    return cut(SU.features(O.meetings(spark, path), O.segments(spark, path), O.topics(spark, path), O.action_items(spark, path), O.decisions(spark, path)))


@query("summary_brief", with_(_NEED, TOPS + f"""SELECT f.meeting_id, '## Executive Briefing' || chr(10) || chr(10) || coalesce('**Meeting Core Insight:**  ' || chr(10) || s0 || chr(10) || chr(10), '') || '---' || chr(10) || chr(10) || '**Key Highlights:**' || chr(10) || chr(10)
  || CASE WHEN titles IS NOT NULL THEN '• 📌 **Agenda Areas:** ' || replace(titles, '§', ' | ') ELSE '• 📌 **Central Themes:** ' || words5 END || chr(10) || coalesce(d.txt, '') || coalesce(a.txt, '')
  || coalesce('• 💡 **Notable Point:** ' || s1 || chr(10), '') || chr(10) || '*Analysed ' || CAST(f.n AS VARCHAR) || ' transcript segments | Themes: ' || theme || '*' AS summary FROM feat f
  LEFT JOIN (SELECT meeting_id, string_agg(CASE WHEN rn = 1 THEN '• ✅ **Key Decision:** ' ELSE '• ✅ ' END || shown || chr(10), '' ORDER BY rn) AS txt FROM dd WHERE rn <= 3 GROUP BY 1) d USING (meeting_id)
  LEFT JOIN (SELECT meeting_id, '• 🎯 **Immediate Action:** ' || description || coalesce(' *(' || due || ')*', '') || coalesce(' — *Owner: ' || owner || '*', '') || ' [' || {URGENT} || ']' || chr(10) AS txt FROM aa WHERE rn = 1) a USING (meeting_id)
  WHERE f.summary_type = 'brief'"""))
def _(spark, path):
    return _text_of(SU.brief(_features(spark, path)))


@query("summary_balanced", with_(_NEED, TOPS + """SELECT f.meeting_id, '## Meeting Overview' || chr(10) || chr(10) || 'This meeting centred around ' || theme || CASE WHEN sp > 1 THEN ', involving ' || CAST(sp AS VARCHAR) || ' speakers' ELSE '' END || '. ' || coalesce(opener, s0, '') || ' '
  || CASE WHEN titles IS NOT NULL THEN 'Discussion spanned the following agenda areas: **' || replace(titles, '§', ', ') || '**.' ELSE 'Core discussion themes included: *' || words6 || '*.' END || chr(10) || chr(10)
  || CASE WHEN d.txt IS NOT NULL OR s1 IS NOT NULL THEN '### Decisions & Key Outcomes' || chr(10) || chr(10) || coalesce(d.txt, '- ' || s1 || chr(10) || coalesce('- ' || s2 || chr(10), '')) || chr(10) ELSE '' END
  || coalesce('### Next Steps & Commitments' || chr(10) || chr(10) || a.txt || chr(10), '') || '> 💬 *' || closer || '*' || chr(10) AS summary FROM feat f
  LEFT JOIN (SELECT meeting_id, string_agg('- **Agreed:** ' || shown || chr(10), '' ORDER BY rn) AS txt FROM dd WHERE rn <= 4 GROUP BY 1) d USING (meeting_id)
  LEFT JOIN (SELECT meeting_id, string_agg('- ' || coalesce('**' || owner || '**', 'Unassigned') || ': ' || description || coalesce(' — ' || due, '') || ' *(Priority: ' || upper(substr(coalesce(urgency, 'low'), 1, 1)) || substr(coalesce(urgency, 'low'), 2) || ')*' || chr(10), '' ORDER BY rn) AS txt FROM aa WHERE rn <= 6 GROUP BY 1) a USING (meeting_id)
  WHERE f.summary_type = 'balanced'"""))
def _(spark, path):
    return _text_of(SU.balanced(_features(spark, path)))


@query("summary_comprehensive")
def _(spark, path):
    return SU.comprehensive(_features(spark, path), O.topics(spark, path), O.action_items(spark, path), O.decisions(spark, path)).select(
        "meeting_id", "part", F.col("n").cast("long").alias("n"), "line")


@query("render_transcript", with_(["segs", "speakers"], """SELECT s.meeting_id, CAST(segment_index // 500 AS INTEGER) AS page, string_agg('[' || CAST(segment_index AS VARCHAR) || '] ' || coalesce(p.name, s.speaker) || ': ' || s.text, chr(10) ORDER BY segment_index) AS body
  FROM segs s LEFT JOIN speakers p ON s.meeting_id = p.meeting_id AND s.speaker = p.label GROUP BY 1, 2"""))
def _(spark, path):
    return MI.pages(MI.render_transcript(D.named_segments(O.segments(spark, path), O.speakers(spark, path))))


@query("render_transcript_appendix", with_(["segs", "speakers"], """SELECT s.meeting_id, segment_index, '- `' || lpad(CAST(CAST(floor(start_time) AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(start_time) AS BIGINT) % 60 AS VARCHAR), 2, '0') || '` **' || coalesce(p.name, s.speaker) || ':** ' || s.text AS line
  FROM segs s LEFT JOIN speakers p ON s.meeting_id = p.meeting_id AND s.speaker = p.label"""))
def _(spark, path):
    return MI.render_transcript(D.named_segments(O.segments(spark, path), O.speakers(spark, path)), appendix=True)


@query("minutes_markdown")
def _(spark, path):
    m = O.meetings(spark, path)
    summary = m.select("meeting_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"), F.concat(F.lit("About "), F.col("title")).alias("line"))
    rows = cut(O.order_rows(spark, path, only=m.filter("status = 'done'")))
    return MI.minutes_lines(m, O.segments(spark, path, rows), O.speakers(spark, path), O.topics(spark, path, rows), O.action_items(spark, path, rows),
                            O.decisions(spark, path, rows), summary, "01 Jan 2026, 00:00", include_transcript=True)


def _structured(spark, path):
    return ST.structure_meetings(cut(O.segments(spark, path)), O.meetings(spark, path), O.speakers(spark, path))


@query("structure_meetings")
def _(spark, path):
    c = _structured(spark, path)
    counts = c.meetings.select("meeting_id", "status")
    for name, df in (("topics", c.topics), ("items", c.action_items), ("decisions", c.decisions), ("summary_lines", c.summary_lines)):
        counts = counts.join(df.groupBy("meeting_id").agg(F.count("*").alias(name)), "meeting_id", "left")
    return counts.fillna(0)
