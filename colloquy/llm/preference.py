"""Preference formatting: one prompt and paired, masked completions from two conversations.

The prompt of a pair is its longest common turn prefix, rendered once; what follows on
either side is that side's completion, in which assistant turns are marked for training,
from the character after the turn's header on.  The result has one row for each turn, so a
conversation of any length is never gathered: turns are compared by aggregates of
(pair, turn), the first difference of a pair is one row, and it is carried back to the
turns by pair and salt.

``stale_pairs`` makes pairs from single conversations: the chosen side is the
conversation, the rejected side stops at its last answer and gives the answer before that
one once more (nothing, if there is none).  ``consecutive_pairs`` takes two conversations.

Edge cases: turns without pair, side or number take no part; a null role is ``unknown``,
a null text empty; repeated rows are one; two different rows of one turn number are kept
in order of role and text and agree only with the same two rows; a pair with one side has
an empty prompt; equal conversations are all prompt, so in ``stale_pairs`` those without an
answer; several answers of one turn number count as that with the least text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A conversation's turns are dealt to so many tasks where a value of the conversation is joined to them.
SALTS = 8


def _with_value(turns: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``turns`` with the one row that ``values`` may have for their key, whatever share of the turns one key holds."""
    salted = values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return turns.withColumn("salt", F.pmod(F.xxhash64("turn", "role", "text"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"], "left").drop("salt")


def preference_rows(turns: DataFrame) -> DataFrame:
    """From (pair_id, side: chosen or rejected, turn, role, text): pair_id, part, turn, role, rendered, train, train_from (characters before it are masked), differs (the first turn that is not common)."""
    kept = turns.where("pair_id is not null and turn is not null and side in ('chosen', 'rejected')").select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    side = lambda name: F.when(F.col("side") == name, F.struct("role", "text"))
    seen = kept.groupBy("pair_id", "turn").agg(
        F.count(side("chosen")).alias("n1"), F.count(side("rejected")).alias("n2"), F.min(side("chosen")).alias("a1"), F.min(side("rejected")).alias("a2"),
        F.max(side("chosen")).alias("z1"), F.max(side("rejected")).alias("z2"))
    same = F.coalesce((F.col("n1") == F.col("n2")) & (F.col("a1") == F.col("a2")) & (F.col("z1") == F.col("z2")), F.lit(False))
    pairs = seen.groupBy("pair_id").agg(F.min(F.when(~same, F.col("turn"))).alias("differs"))
    rows = _with_value(kept, pairs, "pair_id")
    in_prompt: Column = F.col("differs").isNull() | (F.col("turn") < F.col("differs"))
    rows = rows.where(~in_prompt | (F.col("side") == "chosen"))  # once
    header = F.concat(F.lit("<|"), "role", F.lit("|>\n"))
    rendered, train = F.concat(header, "text", F.lit("\n")), ~in_prompt & (F.col("role") == "assistant")
    return rows.select(
        "pair_id", F.when(in_prompt, "prompt").otherwise(F.col("side")).alias("part"), "turn", "role",
        rendered.alias("rendered"), train.alias("train"), F.length(F.when(train, header).otherwise(rendered)).cast("long").alias("train_from"), "differs")


def stale_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs of every conversation (chosen) and itself up to its last answer, which repeats the one before (rejected)."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).where("pair_id is not null and turn is not null")
    answers = turns.where("role = 'assistant'").groupBy("pair_id", "turn").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("turn")))
    last = answers.withColumn("nth", nth).where("nth <= 2").groupBy("pair_id").agg(
        F.max("turn").alias("last"), F.coalesce(F.max(F.when(F.col("nth") == 2, F.col("text"))), F.lit("")).alias("text"))
    side = lambda name: F.lit(name).alias("side")
    before = _with_value(turns, last.select("pair_id", "last"), "pair_id").where("last is null or turn < last or turn = last and role != 'assistant'")
    again = last.select("pair_id", side("rejected"), F.col("last").alias("turn"), F.lit("assistant").alias("role"), "text")
    return turns.select("pair_id", side("chosen"), "turn", "role", "text").unionByName(
        before.select("pair_id", side("rejected"), "turn", "role", "text")).unionByName(again)


def consecutive_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations 2p (chosen) and 2p + 1 (rejected) of a table (conv_id, turn, role, text)."""
    return conversations.select(
        F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"), F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected").alias("side"),
        F.col("turn").cast("long").alias("turn"), "role", "text").where("pair_id is not null")


_RENDERED = """
unmatched AS (
  SELECT a.pair_id, a.turn FROM kept a LEFT JOIN kept b
    ON a.pair_id = b.pair_id AND a.turn = b.turn AND a.role = b.role AND a.text = b.text AND a.side <> b.side
  WHERE b.pair_id IS NULL),
pairs AS (SELECT k.pair_id, min(u.turn) AS differs FROM (SELECT DISTINCT pair_id FROM kept) k LEFT JOIN unmatched u USING (pair_id) GROUP BY 1),
placed AS (
  SELECT pair_id, CASE WHEN differs IS NULL OR turn < differs THEN 'prompt' ELSE side END AS part, turn, role, '<|' || role || '|>' || chr(10) AS header,
         text, NOT (differs IS NULL OR turn < differs) AND role = 'assistant' AS train, differs
  FROM kept JOIN pairs USING (pair_id)
  WHERE NOT (differs IS NULL OR turn < differs) OR side = 'chosen')
SELECT pair_id, part, turn, role, header || text || chr(10) AS rendered, train,
       CASE WHEN train THEN length(header) ELSE length(header) + length(text) + 1 END AS train_from, differs
FROM placed
"""

CONSECUTIVE_SQL = """
WITH kept AS (
  SELECT DISTINCT conv_id >> 1 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, turn,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),""" + _RENDERED

ORACLE = """
WITH turns AS (
  SELECT conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
answers AS (
  SELECT pair_id, turn, min(text) AS text, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC) AS nth
  FROM turns WHERE role = 'assistant' GROUP BY pair_id, turn),
last AS (
  SELECT a.pair_id, a.turn AS last, coalesce(b.text, '') AS text
  FROM answers a LEFT JOIN answers b ON a.pair_id = b.pair_id AND b.nth = 2 WHERE a.nth = 1),
kept AS (
  SELECT pair_id, 'chosen' AS side, turn, role, text FROM turns
  UNION SELECT t.pair_id, 'rejected', t.turn, t.role, t.text FROM turns t LEFT JOIN last l ON t.pair_id = l.pair_id
        WHERE l.last IS NULL OR t.turn < l.last OR (t.turn = l.last AND t.role <> 'assistant')
  UNION SELECT pair_id, 'rejected', last, 'assistant', text FROM last),""" + _RENDERED
