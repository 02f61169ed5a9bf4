"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, preference, turn_repair, url_rules
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op6_chat_format": preference.ORACLE, "op11_filter_interactions": filter_audit.ORACLE, "op12_url_filters": url_rules.ORACLE,
    "op13_turn_repair": turn_repair.ORACLE}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_store
    return token_store(spark, table(spark, sf_dir, "documents"))


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    return pack(table(spark, sf_dir, "documents"), capacity=1024)


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similar_classes
    return similar_classes(table(spark, sf_dir, "documents"), words=4, num=85, den=100).drop("text_key")


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"), length=200).drop("starts", "ends")


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify
    return identify(table(spark, sf_dir, "documents"))


@query
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .neighbours import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_rows(preference.stale_pairs(table(spark, sf_dir, "conversations")))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages
    return repeated_passages(table(spark, sf_dir, "documents"), passage=50, least=0.8)


@query
def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, url_rules.RULES))


@query
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.audit(table(spark, sf_dir, "conversations"))
