"""URL rules: the longest rule of a host and its subdomains decides; a range join of sorted keys.

A host is written as its labels in reverse order, each closed by ``/`` (no host holds that
sign): ``www.example.com`` becomes ``com/example/www/``.  The subdomains of a host are then one
interval of keys, and two intervals are nested or apart.  Pages and rule hosts are sorted
together by key over ranges of about equal size.  The sweep in that order keeps the stack
of nested rule hosts as one slot a depth: the last rule host of d labels is the only one of that
depth that can hold the present key, and it is open while it is a prefix of the key.  What is
open where a range begins is carried from one summary row a range, so no range needs the
ones before it, and one host with any share of the pages is dealt over several ranges.
Paths are compared with the few open hosts only.

Results in odd cases.  Null urls and such without ``://`` have empty host and path and get the
default verdict; so does a url whose path does not start with the rule's (``http://a.com`` has an
empty path, which no rule with a path of ``/`` fits).  The longest rule is that of the longest
host and path together, then the longer host, then the smaller verdict; repeated rules are one.
Rules with null host, null path or empty host fit nothing.  Ties, repeated and null
page_ids are kept as rows of their own.  Texts of any length are only cut and
compared.  An empty table of pages gives no rows, one of rules the default for all;
other columns of either table are ignored.  The rules of one host stand in one row:
a rule table is a configuration, its size is not that of the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colloquy.operators.blocks import block_scan
from colloquy.session import cut

Rule = tuple[str, str, str]
#: Host, path and verdict.
RULES: list[Rule] = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, in small letters, and what follows that up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """A literal list of rules as a table (host, path, verdict)."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    made = F.inline(F.array(*rows)) if rows else F.inline(F.expr("cast(array() as array<struct<host:string,path:string,verdict:string>>)"))
    return spark.range(1).select(made)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the one that decides, or null) and verdict for every row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.select("*", host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.xxhash64("page_id", "path").alias("deal"))
    known = rules.where("host <> '' and path is not null and verdict is not null").select(
        F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").distinct()
    held = cut(known.groupBy("host").agg(F.collect_list(F.struct("path", "verdict")).alias("rules")).select(
        host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), F.struct(host_key(F.col("host")).alias("key"), "host", "rules").alias("open"),
        F.size(F.split("host", r"\.")).alias("depth")))
    depth = held.agg(F.max("depth")).head()[0] or 0
    # once stored, the number of a range stays with its rows whatever is computed again
    swept = cut(rows.unionByName(held, allowMissingColumns=True).repartitionByRange("key", "kind", "deal").withColumn("range", F.spark_partition_id()))
    slots = {f"open_{d}": F.when(F.col("depth") == d, F.col("open")) for d in range(1, depth + 1)}
    swept = block_scan(swept, [], F.col("range"), ["key", "kind", "deal"], lasts=slots) if slots else swept
    swept = swept.where("kind = 1")

    def fitting(slot: Column) -> Column:
        """The rules of an open host whose path the page's path starts with, best first when sorted."""
        inside = F.coalesce(F.startswith(F.col("key"), slot["key"]), F.lit(False))
        fits = F.filter(slot["rules"], lambda r: F.startswith(F.col("path"), r["path"]))
        ranked = F.transform(fits, lambda r: F.struct(
            (-F.length(slot["host"]) - F.length(r["path"])).alias("size"), (-F.length(slot["host"])).alias("host"), r["verdict"].alias("verdict"),
            F.concat(slot["host"], r["path"]).alias("rule")))
        return F.when(inside, ranked)

    nothing = F.expr("cast(array() as array<struct<size:int,host:int,verdict:string,rule:string>>)")
    best = F.array_min(F.flatten(F.array(nothing, *[F.coalesce(fitting(F.col(s)), nothing) for s in slots])))
    return swept.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rests AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)
SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY n, page_id, host, path
"""
