"""How filters overlap: which documents fail which filters, and what every order of the filters removes.

Each filter is a condition on one row; one more, of existence, asks the table itself: a
document that is identical to one of a smaller doc_id fails it.  That one is a left-semi join
on hash, exact text and smaller doc_id, whose right side holds one row a text (the least
doc_id, aggregated before the shuffle), so a group of copies of any size makes no pairs and its
left rows can be split.  The failures of both kinds are united and summed to one mask a
document; only counts by mask go on.  Orders, Shapley sums and losses all follow from
at most 2**filters counts a part.

Results in odd cases.  A null text is empty, a null lang the part ''.  Rows with a null
doc_id are identical to no smaller one and make no other row fail; rows of equal doc_id
are separate documents and don't make each other fail.  A document is good or
toxic if any of its labels says so; labels of no document count nothing.  Texts of any
length are split inside one row.  Empty documents give no part and so no row.  Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F


def document_filters(text: Column) -> dict[str, Column]:
    """A: under 100 words, B: distinct words under 80 %, C: capitals over 10 % of the code points, D: a sign of ``#$%&*|``."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, filters: Mapping[str, Column], copies: str) -> DataFrame:
    """doc_id, part, mask and rows: the filters every document fails, as bits in the order of ``filters`` and then ``copies``.

    Rows equal in doc_id, part and text stand in one row with their number.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.sha2("text", 256))
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    failed = rows.select("doc_id", "part", "hash", bits.alias("mask"), F.lit(1).cast("long").alias("rows"))
    first = rows.where("doc_id is not null").groupBy("hash", "text").agg(F.min("doc_id").alias("first"))
    first = first.select(F.col("hash").alias("same_hash"), F.col("text").alias("same_text"), "first")
    copied = rows.join(first, (F.col("hash") == F.col("same_hash")) & (F.col("text") == F.col("same_text")) & (F.col("first") < F.col("doc_id")), "left_semi")
    copied = copied.select("doc_id", "part", "hash", F.lit(1 << len(filters)).alias("mask"), F.lit(0).cast("long").alias("rows"))
    return failed.unionByName(copied).groupBy("doc_id", "part", "hash").agg(F.bit_or("mask").alias("mask"), F.sum("rows").alias("rows")).drop("hash")


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each combination of failed filters."""
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = failed.join(marks, "doc_id", "left")
    return marked.groupBy("part", "mask").agg(
        F.sum("rows").alias("n"), F.sum(F.col("rows") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("rows") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def every_order(counts: DataFrame, letters: str) -> DataFrame:
    """What each step of every order of the filters keeps and removes, from :func:`combinations`."""
    orders = [F.lit("".join(o)) for o in permutations(letters)]
    # at most 2**len(letters) combinations a part
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("seen"))
    steps = parts.select("part", "seen", F.explode(F.array(*orders)).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    weight = F.create_map(*[x for k, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << k))])
    chosen = F.col("filter_order").substr(F.col("step"), F.lit(1))
    bit = weight[chosen]
    before = sum((F.when(F.instr("filter_order", c) < F.col("step"), 1 << k).otherwise(0) for k, c in enumerate(letters)), F.lit(0))
    steps = steps.withColumn("bit", bit).withColumn("before", before)

    def total(condition, value=lambda c: c["n"]) -> Column:
        return F.aggregate("seen", F.lit(0).cast("long"), lambda s, c: s + F.when(condition(c), value(c)).otherwise(0))

    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) != 0
    earlier = lambda c: c["mask"].bitwiseAND(F.col("before")) != 0
    # of k failed filters each comes first in one k-th of all orders
    share = lambda c: c["n"] * F.element_at(F.array(*[F.lit(factorial(len(letters)) // k) for k in range(1, len(letters) + 1)]), F.bit_count(c["mask"]))
    return steps.select(
        "part", "filter_order", "step",
        total(lambda c: ~fails(c) & ~earlier(c)).alias("kept"), total(lambda c: fails(c) & ~earlier(c)).alias("removed"),
        total(lambda c: fails(c) & earlier(c)).alias("redundant"), total(lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda c: fails(c) & ~earlier(c), lambda c: c["good"]).alias("good_lost"),
        total(lambda c: fails(c) & ~earlier(c), lambda c: c["toxic"]).alias("toxic_lost"),
        F.aggregate("seen", F.lit(0).cast("long"), lambda s, c: s + F.when(fails(c), share(c)).otherwise(0)).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E over whole texts, one row a part, order and step."""
    filters = document_filters(F.col("text"))
    return every_order(combinations(failures(docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")), filters, "E"), labels), "ABCDE")


ORACLE = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM docs),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
flags AS (
  SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(first < doc_id, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words LEFT JOIN marks USING (doc_id)),
fails AS (SELECT *, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS f, a::int + b::int + c::int + d::int + e::int AS n_failed FROM flags),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT l1.x || l2.x || l3.x || l4.x || l5.x AS filter_order FROM letters l1, letters l2, letters l3, letters l4, letters l5
  WHERE len(list_distinct([l1.x, l2.x, l3.x, l4.x, l5.x])) = 5),
seen AS (SELECT part, f, n_failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY 1, 2, 3),
stepped AS (
  SELECT seen.*, filter_order, step, f[substr(filter_order, step, 1)] AS failing,
         coalesce(list_bool_or(list_transform(range(1, step), lambda k: f[substr(filter_order, k, 1)])), false) AS earlier
  FROM seen, orders, range(1, 6) s(step))
SELECT part, filter_order, step::int AS step,
       coalesce(sum(n) FILTER (NOT failing AND NOT earlier), 0)::bigint AS kept, coalesce(sum(n) FILTER (failing AND NOT earlier), 0)::bigint AS removed,
       coalesce(sum(n) FILTER (failing AND earlier), 0)::bigint AS redundant, coalesce(sum(n) FILTER (failing AND n_failed = 1), 0)::bigint AS unique_fails,
       coalesce(sum(good) FILTER (failing AND NOT earlier), 0)::bigint AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT earlier), 0)::bigint AS toxic_lost,
       coalesce(sum(n * (120 // greatest(n_failed, 1))) FILTER (failing), 0)::bigint AS shapley
FROM stepped GROUP BY 1, 2, 3
"""
