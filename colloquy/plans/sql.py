"""SQL fragments for the reference results that queries are compared with.

Plain window functions are fine here: this SQL only states the expected result.
"""

from __future__ import annotations

from ..functions import values as V
from ..sources.orders_world import TOPIC_TITLES
from ..sources.transcripts import ORDER_SENTENCES

MARK = "\x1f"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(ws: list[str]) -> str:
    return "[" + ", ".join(lit(w) for w in ws) + "]"


def order_sentence(key: str) -> str:
    arms = []
    for n, text in enumerate(ORDER_SENTENCES):
        head, _, tail = text.partition("{k}")
        value = f"{lit(head)} || CAST({key} AS VARCHAR) || {lit(tail)}" if "{k}" in text else lit(text)
        arms.append(f"WHEN {n} THEN {value}")
    return f"CASE {key} % {len(ORDER_SENTENCES)} " + " ".join(arms) + " END"


def pick(index: str, options: list[str | None]) -> str:
    return f"CASE {index} " + " ".join(
        f"WHEN {n} THEN {'NULL' if o is None else lit(o)}" for n, o in enumerate(options)) + " END"


def strict_pieces(x: str) -> str:
    """Trimmed non-blank pieces split after a sentence mark before a capital letter."""
    return (rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+([A-Z])', '\1{MARK}\2', 'g'), "
            rf"'{MARK}'), lambda p: {strip('p')}), lambda p: p <> '')")


def jaccard(a: str, b: str) -> str:
    return (f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE "
            f"len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / "
            f"len(list_distinct(list_concat({a}, {b}))) END)")


def topic_tokens(x: str) -> str:
    bare = f"replace(replace(lower({x}), '’', ''), '''', '')"
    return (rf"list_filter(list_transform(regexp_extract_all({bare}, '[a-z][a-z0-9''+\-]+'), lambda w: trim(w, '-')), "
            f"lambda w: length(w) > 2 AND NOT list_contains({words(V.TOPIC_STOP)}, w))")


def summary_tokens(x: str) -> str:
    punctuation = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
    bare = f"regexp_replace(lower({x}), '{punctuation}', '', 'g')"
    return (rf"list_filter(regexp_split_to_array({strip(bare)}, '\s+'), "
            f"lambda w: length(w) > 2 AND NOT list_contains({words(V.SUMMARY_STOP)}, w))")


CTE: dict[str, tuple[list[str], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTE[name] = (list(needs), body)


def with_(names: list[str] | str, body: str) -> str:
    """``WITH`` clause holding the named fragments and everything they need."""
    done: list[str] = []

    def add(n: str) -> None:
        for d in CTE[n][0]:
            add(d)
        if n not in done:
            done.append(n)

    for n in ([names] if isinstance(names, str) else names):
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1]})" for n in done) + "\n" + body.lstrip()


RATE = f"{V.CHARS_PER_SECOND}::DOUBLE"

cte("conv", f"""SELECT CAST(conv_id AS VARCHAR) AS meeting_id, CAST(turn AS INTEGER) AS segment_index, role AS speaker, text,
  CAST(SUM(length(text)) OVER w - length(text) AS DOUBLE) / {RATE} AS start_time,
  CAST(SUM(length(text)) OVER w AS DOUBLE) / {RATE} AS end_time
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")

cte("doc_pieces", f"""SELECT doc_id, source, unnest({strict_pieces('text')}) AS text,
  generate_subscripts({strict_pieces('text')}, 1) AS i FROM documents""")
cte("doc", f"""SELECT CAST(doc_id AS VARCHAR) AS meeting_id, CAST(i - 1 AS INTEGER) AS segment_index, source AS speaker, text,
  CAST(SUM(length(text)) OVER w - length(text) AS DOUBLE) / {RATE} AS start_time,
  CAST(SUM(length(text)) OVER w AS DOUBLE) / {RATE} AS end_time
  FROM doc_pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)""", "doc_pieces")

cte("ord_text", f"""SELECT CAST(o_custkey AS VARCHAR) AS meeting_id, o_orderkey AS k,
  'SPEAKER_0' || CAST(o_orderkey % 3 AS VARCHAR) AS speaker, {order_sentence('o_orderkey')} AS text,
  o_orderdate AS order_date, o_orderstatus, o_orderpriority, o_totalprice FROM orders""")
cte("ord", f"""SELECT *, CAST(ROW_NUMBER() OVER w - 1 AS INTEGER) AS segment_index,
  CAST(SUM(length(text)) OVER w - length(text) AS DOUBLE) / {RATE} AS start_time,
  CAST(SUM(length(text)) OVER w AS DOUBLE) / {RATE} AS end_time
  FROM ord_text WINDOW w AS (PARTITION BY meeting_id ORDER BY order_date, k)""", "ord_text")
cte("segs", "SELECT meeting_id, segment_index, speaker, text, start_time, end_time FROM ord", "ord")
cte("meetings", f"""SELECT CAST(c_custkey AS VARCHAR) AS meeting_id,
  {pick('c_custkey % 7', ['u0', 'u1', 'u2', 'u3', 'u4', 'u5', None])} AS user_id,
  CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS project_id,
  c_name || ' / ' || c_mktsegment AS title,
  TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey AS INTEGER)) AS date,
  {pick('c_custkey % 5', ['done', 'done', 'transcribing', 'error', 'queued'])} AS status,
  {pick('c_custkey % 3', ['brief', 'balanced', 'comprehensive'])} AS summary_type,
  {pick('c_custkey % 2', ['upload', 'live'])} AS source FROM customer""")
cte("projects", """SELECT CAST(n_nationkey AS VARCHAR) AS project_id, 'u' || CAST(n_regionkey AS VARCHAR) AS user_id,
  n_name AS name, CASE WHEN n_nationkey % 3 <> 0 THEN 'Company ' || CAST(n_regionkey AS VARCHAR) END AS company FROM nation""")
cte("speakers", """SELECT DISTINCT meeting_id, speaker AS label,
  CASE WHEN speaker = 'SPEAKER_01' THEN 'Ines' END AS name,
  CASE WHEN speaker = 'SPEAKER_02' THEN 'Omar' END AS inferred FROM ord_text""", "ord_text")
cte("items", f"""SELECT 'a' || CAST(k AS VARCHAR) AS item_id, meeting_id,
  CASE WHEN k % 4 = 0 THEN 'Decide on order ' ELSE 'Pack order ' END || CAST(k AS VARCHAR) AS description,
  {pick('k % 4', [None, 'Ines', 'Omar', 'Ana'])} AS owner,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' END AS urgency,
  o_orderstatus = 'F' AS resolved, CASE WHEN k % 3 = 0 THEN 'by Friday' END AS due, text AS evidence,
  (k % 10) / 10.0::DOUBLE AS confidence, segment_index FROM ord WHERE k % 5 <> 0""", "ord")
cte("decisions", """SELECT 'd' || CAST(k AS VARCHAR) AS decision_id, meeting_id, 'Ship order ' || CAST(k AS VARCHAR) AS description,
  CASE WHEN k % 2 = 0 THEN 'Stock is low' END AS rationale, text AS evidence,
  (k % 10) / 10.0::DOUBLE AS confidence, segment_index, order_date AS decided_on FROM ord WHERE k % 5 = 0""", "ord")
cte("topics", f"""SELECT 't' || CAST(k AS VARCHAR) AS topic_id, meeting_id, segment_index AS topic_no,
  {pick('k % 6', TOPIC_TITLES)} AS title, 'About order ' || CAST(k AS VARCHAR) AS summary, k % 3 = 0 AS is_recurring,
  CASE WHEN k % 3 = 0 THEN 't' || CAST(k - 12 AS VARCHAR) END AS previous_topic_id,
  CASE WHEN k % 50 <> 1 THEN start_time END AS start_time,
  CASE WHEN k % 50 <> 1 THEN start_time + 20 END AS end_time FROM ord""", "ord")
cte("turn_grid", """SELECT DISTINCT meeting_id, unnest(range(CAST(floor(start_time / 7) AS BIGINT), CAST(floor(end_time / 7) AS BIGINT) + 1)) AS i
  FROM segs""", "segs")
cte("turns", """SELECT meeting_id, CAST(i AS INTEGER) AS turn_idx, 'SPEAKER_0' || CAST(i % 3 AS VARCHAR) AS speaker,
  CAST(i * 7 AS DOUBLE) AS start_time, CAST(i * 7 + CASE WHEN i % 5 = 4 THEN 3 ELSE 7 END AS DOUBLE) AS end_time FROM turn_grid""", "turn_grid")
cte("glance_items", """SELECT *, coalesce(owner, '') = '' AND regexp_matches(description,
  '(?i)^(?:decide|agree|align|settle|finali[sz]e|figure out|work out|sort out|nail down|pin down|lock down|discuss|resolve|confirm|pick|choose|clarify)\\b') AS is_question
  FROM items""", "items")
cte("durations", """SELECT meeting_id, greatest(max(end_time) - min(start_time), 0) AS duration FROM segs GROUP BY meeting_id""", "segs")
cte("counts", """SELECT m.*, coalesce(u.duration, 0) AS duration, coalesce(d.n, 0) AS decisions, coalesce(i.n, 0) AS items,
  coalesce(i.r, 0) AS resolved, coalesce(t.n, 0) AS topics, coalesce(t.r, 0) AS recurring FROM meetings m
  LEFT JOIN durations u USING (meeting_id)
  LEFT JOIN (SELECT meeting_id, count(*) AS n FROM decisions GROUP BY 1) d USING (meeting_id)
  LEFT JOIN (SELECT meeting_id, count(*) AS n, count(*) FILTER (resolved) AS r FROM items GROUP BY 1) i USING (meeting_id)
  LEFT JOIN (SELECT meeting_id, count(*) AS n, count(*) FILTER (is_recurring) AS r FROM topics GROUP BY 1) t USING (meeting_id)""",
    "meetings", "durations", "decisions", "items", "topics")
cte("rollup", """SELECT p.project_id, p.name, p.company, coalesce(c.n, 0) AS meeting_count,
  coalesce(c.s, 0) AS total_duration_seconds, CAST(coalesce(c.d, 0) AS BIGINT) AS decisions,
  CAST(coalesce(c.i, 0) AS BIGINT) AS items, CAST(coalesce(c.r, 0) AS BIGINT) AS resolved
  FROM projects p LEFT JOIN (SELECT project_id, count(*) AS n, sum(duration) AS s, sum(decisions) AS d, sum(items) AS i,
    sum(resolved) AS r FROM counts WHERE status IN ('done', 'completed') GROUP BY project_id) c USING (project_id)""",
    "projects", "counts")


# -- text ---------------------------------------------------------------------
from ..functions import phrases as P  # noqa: E402


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit('(?i)' + pattern)})"


def clean(x: str) -> str:
    t = f"regexp_replace({strip(x)}, {lit(P.INLINE_FILLER)}, '', 'gi')"
    t = f"regexp_replace({t}, {lit(P.LEADING_FILLER)}, '', 'i')"
    t = rf"regexp_replace({t}, '\s+', ' ', 'g')"
    t = rf"regexp_replace({t}, '\s+([,.!?;:])', '\1', 'g')"
    t = rf"regexp_replace({t}, '(,\s*){{2,}}', ', ', 'g')"
    return f"trim({t}, {lit(P.EDGE_PUNCTUATION)})"


def _pieces(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, '{MARK}'), lambda p: {strip('p')}), lambda p: p <> '')"


def sentences(x: str) -> str:
    gap = lit(r"""([.!?])\s+([A-Za-z"'(])""")
    first = _pieces(f"regexp_replace({strip(x)}, {gap}, '\\1{MARK}\\2', 'g')")
    clause = lit(P.CLAUSE_LEAD + "(" + P.CLAUSE_SUBJECT + r"\b)")
    marked = f"list_transform({first}, lambda s: regexp_replace(s, {clause}, '{MARK}\\1', 'gi'))"
    return _pieces(f"array_to_string({marked}, '{MARK}')")


def word_count(x: str) -> str:
    return rf"(CASE WHEN {strip(x)} = '' THEN 0 ELSE len(regexp_split_to_array({strip(x)}, '\s+')) END)"


def keeps_in_summary(x: str) -> str:
    return f"({word_count(x)} >= 4 AND NOT {matches(x, P.SMALL_TALK)})"


def upper_first(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


def strip_terminal(x: str) -> str:
    bare = strip(f"regexp_replace({strip(x)}, '[.!?;:, ]+$', '')")
    return strip(f"regexp_replace({bare}, {lit(P.TRAILING_DISCOURSE)}, '', 'i')")


def title_terms(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ' '), lambda w: CASE WHEN list_contains({words(V.KEEP_UPPER)}, w) "
            f"THEN upper(w) ELSE {upper_first('w')} END), ' ')")


def bigrams(toks: str) -> str:
    return f"list_transform(range(1, len({toks})), lambda i: {toks}[i] || ' ' || {toks}[i + 1])"


def ranked(score: str) -> str:
    return f"round({score}, 9)"


cte("doc_clean", f"SELECT *, {clean('text')} AS clean FROM doc", "doc")
cte("doc_tokens", f"SELECT meeting_id, segment_index, {topic_tokens('clean')} AS tokens FROM doc_clean", "doc_clean")
cte("doc_size", """SELECT meeting_id, count(*) AS n, CAST(greatest(2, least(8, count(*) // 10)) AS INTEGER) AS w,
  CAST(greatest(3, least(12, greatest(count(*) // 8, 1))) AS INTEGER) AS min_block FROM doc_tokens GROUP BY 1""", "doc_tokens")
cte("doc_terms", """SELECT t.meeting_id, segment_index AS s, n, w, min_block, unnest(tokens) AS term FROM doc_tokens t
  JOIN doc_size z ON t.meeting_id = z.meeting_id AND n >= 6 AND n >= 2 * min_block""", "doc_tokens", "doc_size")
cte("doc_tf", "SELECT meeting_id, s, n, w, min_block, term, count(*) AS tf FROM doc_terms GROUP BY ALL", "doc_terms")
cte("doc_bags", """SELECT meeting_id, gap, term, n, sum(CASE WHEN gap >= s THEN tf ELSE 0 END) AS a, sum(CASE WHEN gap < s THEN tf ELSE 0 END) AS b FROM
  (SELECT *, unnest(range(greatest(s - w, 0), least(s + w - 1, n - 2) + 1)) AS gap FROM doc_tf) GROUP BY ALL""", "doc_tf")
cte("doc_idf", """SELECT meeting_id, term, ln((1 + n)::DOUBLE / (1 + count(*))) + 0.1 AS idf FROM doc_tf GROUP BY meeting_id, term, n""", "doc_tf")
cte("doc_gap_sums", """SELECT meeting_id, gap, sum(a * b * idf * idf) AS ab, sum(a * a * idf * idf) AS aa, sum(b * b * idf * idf) AS bb
  FROM doc_bags JOIN doc_idf USING (meeting_id, term) GROUP BY 1, 2""", "doc_bags", "doc_idf")
cte("doc_sims", """SELECT t.meeting_id, t.segment_index AS gap, z.n, z.min_block,
  round(coalesce(CASE WHEN aa > 0 AND bb > 0 THEN ab / (sqrt(aa) * sqrt(bb)) ELSE 0.0::DOUBLE END, 0), 9) AS sim FROM doc_tokens t
  JOIN doc_size z ON t.meeting_id = z.meeting_id AND n >= 6 AND n >= 2 * min_block
  LEFT JOIN doc_gap_sums g ON g.meeting_id = t.meeting_id AND g.gap = t.segment_index WHERE t.segment_index <= n - 2""",
    "doc_tokens", "doc_size", "doc_gap_sums")
cte("doc_smooth", """SELECT meeting_id, gap, n, min_block, round(CASE WHEN n - 1 >= 3 THEN 0.25::DOUBLE * coalesce(lag(sim) OVER w, sim) + 0.5::DOUBLE * sim
  + 0.25::DOUBLE * coalesce(lead(sim) OVER w, sim) ELSE sim END, 12) AS sim FROM doc_sims WINDOW w AS (PARTITION BY meeting_id ORDER BY gap)""", "doc_sims")
cte("doc_islands", """SELECT *, sum(CASE WHEN p >= sim THEN 0 ELSE 1 END) OVER w AS left_run, sum(CASE WHEN q >= sim THEN 0 ELSE 1 END) OVER v AS right_run FROM
  (SELECT *, lag(sim) OVER (PARTITION BY meeting_id ORDER BY gap) AS p, lead(sim) OVER (PARTITION BY meeting_id ORDER BY gap) AS q FROM doc_smooth)
  WINDOW w AS (PARTITION BY meeting_id ORDER BY gap), v AS (PARTITION BY meeting_id ORDER BY gap DESC)""", "doc_smooth")
cte("doc_depth", """SELECT meeting_id, gap, n, min_block, sim, round((first_value(sim) OVER (PARTITION BY meeting_id, left_run ORDER BY gap) - sim) +
  (first_value(sim) OVER (PARTITION BY meeting_id, right_run ORDER BY gap DESC) - sim), 12) AS depth FROM doc_islands""", "doc_islands")
cte("doc_cands", """SELECT meeting_id, min_block, CAST(gap + 1 AS INTEGER) AS pos, CAST(ROW_NUMBER() OVER (PARTITION BY meeting_id ORDER BY depth DESC, gap) AS INTEGER) AS rn FROM
  (SELECT *, round(avg(depth) OVER p + 0.5::DOUBLE * stddev_pop(depth) OVER p, 9) AS threshold FROM doc_depth WINDOW p AS (PARTITION BY meeting_id))
  WHERE depth >= threshold AND depth > 0.05 AND gap + 1 >= min_block AND n - gap - 1 >= min_block""", "doc_depth")
cte("doc_cuts", """SELECT meeting_id, list_sort(list_reduce(list_prepend([]::INTEGER[], list_transform(list(pos ORDER BY rn), lambda x: [x])),
  lambda acc, x: CASE WHEN len(acc) < 7 AND len(list_filter(acc, lambda c: abs(c - x[1]) < any_block)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS cuts
  FROM (SELECT *, min_block AS any_block FROM doc_cands) GROUP BY meeting_id, any_block""", "doc_cands")
cte("doc_blocks", """SELECT d.meeting_id, d.segment_index, d.text, d.clean, d.start_time, d.end_time, t.tokens,
  CAST(len(list_filter(coalesce(c.cuts, []::INTEGER[]), lambda x: x <= d.segment_index)) AS INTEGER) AS block_no FROM doc_clean d
  JOIN doc_tokens t ON d.meeting_id = t.meeting_id AND d.segment_index = t.segment_index LEFT JOIN doc_cuts c ON d.meeting_id = c.meeting_id""",
    "doc_clean", "doc_tokens", "doc_cuts")
cte("block_terms", f"""SELECT meeting_id, block_no, term, size, count(*) AS tf FROM (
  SELECT meeting_id, block_no, unnest(tokens) AS term, 1 AS size FROM doc_blocks UNION ALL
  SELECT meeting_id, block_no, unnest({bigrams('tokens')}), 2 FROM doc_blocks) GROUP BY ALL""", "doc_blocks")
cte("block_scored", """SELECT meeting_id, block_no, term, round(tf * (ln((1 + nb)::DOUBLE / (1 + df)) + 0.3) * CASE WHEN size = 2 THEN 1.6::DOUBLE ELSE 1.0 END, 9) AS score FROM (
  SELECT *, count(*) OVER (PARTITION BY meeting_id, term) AS df, sum(CASE WHEN size = 1 THEN tf END) OVER (PARTITION BY meeting_id, block_no) AS flat FROM block_terms)
  JOIN (SELECT meeting_id, count(DISTINCT block_no) AS nb FROM doc_blocks GROUP BY 1) USING (meeting_id) WHERE size = 1 OR tf >= 2 OR nb = 1 OR flat < 25""",
    "block_terms", "doc_blocks")
cte("block_first", "SELECT meeting_id, block_no, max((score, term)).term AS t1 FROM (SELECT meeting_id, block_no, {'score': score, 'term': term} AS r, score, term FROM block_scored) GROUP BY 1, 2".replace(
    "max((score, term)).term", "max(r).term"), "block_scored")
cte("block_second", """SELECT meeting_id, block_no, max({'score': score, 'term': term}).term AS t2 FROM block_scored JOIN block_first USING (meeting_id, block_no)
  WHERE NOT list_has_any(string_split(term, ' '), string_split(t1, ' ')) GROUP BY 1, 2""", "block_scored", "block_first")
cte("doc_titles", f"""SELECT b.meeting_id, b.block_no, CASE WHEN t1 IS NULL THEN 'General discussion' ELSE {title_terms('t1')} || coalesce(' & ' || {title_terms('t2')}, '') END AS title
  FROM (SELECT DISTINCT meeting_id, block_no FROM doc_blocks) b LEFT JOIN block_first USING (meeting_id, block_no) LEFT JOIN block_second USING (meeting_id, block_no)""",
    "doc_blocks", "block_first", "block_second")
cte("block_sents", f"""SELECT *, {topic_tokens('sentence')} AS stoks FROM (SELECT meeting_id, block_no, segment_index, unnest({sentences('clean')}) AS sentence,
  generate_subscripts({sentences('clean')}, 1) AS sent_no FROM doc_blocks) WHERE {word_count('sentence')} >= 5 AND NOT ends_with(sentence, '?')""", "doc_blocks")
cte("sent_tf", """SELECT meeting_id, block_no, segment_index, sent_no, term, count(*) AS tf FROM
  (SELECT meeting_id, block_no, segment_index, sent_no, unnest(stoks) AS term FROM block_sents) GROUP BY ALL""", "block_sents")
cte("sent_terms", """SELECT t.*, ln((1 + n)::DOUBLE / (1 + df)) + 0.1 AS idf FROM (SELECT meeting_id, block_no, term, count(*) AS df, sum(tf) AS total FROM sent_tf GROUP BY 1, 2, 3) t
  JOIN (SELECT meeting_id, block_no, count(*) AS n FROM block_sents GROUP BY 1, 2) USING (meeting_id, block_no)""", "sent_tf", "block_sents")
cte("sent_scores", """SELECT meeting_id, block_no, segment_index, sent_no, round(sum(tf * total * idf * idf) / (sqrt(sum(pow(tf * idf, 2))) * any_value(norm)) *
  (0.6::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, sum(tf)::DOUBLE / 8)), 9) AS score FROM sent_tf JOIN sent_terms USING (meeting_id, block_no, term)
  JOIN (SELECT meeting_id, block_no, sqrt(sum(pow(total * idf, 2))) AS norm FROM sent_terms GROUP BY 1, 2) USING (meeting_id, block_no) GROUP BY 1, 2, 3, 4""",
    "sent_tf", "sent_terms")
cte("doc_summaries", f"""SELECT b.meeting_id, b.block_no, coalesce(c.summary, f.plain, '') AS summary FROM (SELECT DISTINCT meeting_id, block_no FROM doc_blocks) b
  LEFT JOIN (SELECT meeting_id, block_no, string_agg({upper_first('sentence')}, ' ' ORDER BY segment_index, sent_no) AS summary FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY meeting_id, block_no ORDER BY coalesce(score, 0) DESC, segment_index DESC, sent_no DESC) AS rn
    FROM block_sents LEFT JOIN sent_scores USING (meeting_id, block_no, segment_index, sent_no)) WHERE rn <= 2 GROUP BY 1, 2) c USING (meeting_id, block_no)
  LEFT JOIN (SELECT meeting_id, block_no, substr({strip("string_agg(clean, ' ' ORDER BY segment_index)")}, 1, 300) AS plain FROM doc_blocks GROUP BY 1, 2) f USING (meeting_id, block_no)""",
    "doc_blocks", "block_sents", "sent_scores")

# Summary sentences and ranking over conversations and order transcripts.
for _name, _src in (("conv", "conv"), ("ord", "segs"), ("doc", "doc")):
    cte(f"{_name}_body", f"""SELECT meeting_id, array_to_string(list(clean ORDER BY segment_index), ' ') AS body FROM
      (SELECT meeting_id, segment_index, {clean('text')} AS clean FROM {_src}) WHERE clean <> '' GROUP BY 1""", _src)
    cte(f"{_name}_split", f"SELECT meeting_id, body, list_filter({strict_pieces('body')}, lambda s: {keeps_in_summary('s')}) AS kept FROM {_name}_body", f"{_name}_body")
    cte(f"{_name}_sents", f"""SELECT meeting_id, unnest(CASE WHEN len(kept) = 0 THEN [body] ELSE kept END) AS sentence,
      generate_subscripts(CASE WHEN len(kept) = 0 THEN [body] ELSE kept END, 1) AS i FROM {_name}_split""", f"{_name}_split")
    cte(f"{_name}_stf", f"""SELECT meeting_id, i, term, count(*) AS tf FROM (SELECT meeting_id, i, unnest({summary_tokens('sentence')}) AS term FROM {_name}_sents) GROUP BY ALL""", f"{_name}_sents")
    cte(f"{_name}_sidf", f"""SELECT meeting_id, term, ln((1 + any_value(n))::DOUBLE / (1 + count(*))) AS idf FROM {_name}_stf
      JOIN (SELECT meeting_id, count(*) AS n FROM {_name}_sents GROUP BY 1) USING (meeting_id) GROUP BY 1, 2""", f"{_name}_stf", f"{_name}_sents")
    cte(f"{_name}_tfidf", f"""SELECT s.meeting_id, s.i, s.sentence, coalesce(v.score, 0) AS score FROM {_name}_sents s LEFT JOIN (
      SELECT meeting_id, i, round(sum(tf * tf::DOUBLE / max_tf * idf) / any_value(len), 9) AS score FROM (
        SELECT *, max(tf) OVER (PARTITION BY meeting_id, i) AS max_tf, sum(tf) OVER (PARTITION BY meeting_id, i) AS len FROM {_name}_stf) JOIN {_name}_sidf USING (meeting_id, term) GROUP BY 1, 2) v
      USING (meeting_id, i)""", f"{_name}_sents", f"{_name}_stf", f"{_name}_sidf")
    cte(f"{_name}_freq", f"""SELECT meeting_id, term, n, n::DOUBLE / max(n) OVER (PARTITION BY meeting_id) AS freq, first_at FROM (SELECT meeting_id, term, count(*) AS n, min(pos) AS first_at FROM (
      SELECT meeting_id, unnest({summary_tokens('body')}) AS term, generate_subscripts({summary_tokens('body')}, 1) AS pos FROM {_name}_body) GROUP BY 1, 2)""", f"{_name}_body")
    cte(f"{_name}_fscore", f"""SELECT s.meeting_id, s.i, s.sentence, coalesce(v.score, 0) AS score FROM {_name}_sents s LEFT JOIN (
      SELECT meeting_id, i, round(sum(tf * coalesce(freq, 0)) / sum(tf), 9) AS score FROM {_name}_stf LEFT JOIN {_name}_freq USING (meeting_id, term) GROUP BY 1, 2) v USING (meeting_id, i)""",
        f"{_name}_sents", f"{_name}_stf", f"{_name}_freq")
