import random

import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontamination, jaccard_join, language, passages

INNER = ["_lettered", "_lang_pred", "_lang_score", "_key", "_id", "_text_key", "_first", "_copies", "_spans", "_copy", "_info", "_found", "text_key", "spans", "node"]


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(5)
    new = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, item = new(60), new(40)
    texts = [f"{new(80)} {passage} {new(50)}", f"{new(30)} {passage} {new(90)}", new(120), f"{new(50)} {item} {new(50)}", "", None]
    texts.append(texts[2])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    names = INNER
    table = table.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    return table, names, spark.createDataFrame([(1, item)], "item_id long, text string")


def intact(out, table, names):
    """Every row of ``out`` holds the further columns as they were."""
    assert out.columns == table.columns
    rows = out.collect()
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    return {r["doc_id"]: r["text"] for r in rows}


def test_further_columns_named_like_inner_ones_stay(clashing):
    table, names, bench = clashing
    rows = {r["doc_id"]: r["text"] for r in table.collect()}
    assert set(intact(language.in_a_language(table, least=0.0, docs_per_lang=5), table, names)) == {0, 1, 2, 3, 6}
    assert set(intact(jaccard_join.one_of_each(table), table, names)) == {0, 1, 2, 3, 4, 5}
    cut = intact(passages.without_repeats(table), table, names)
    assert cut[0] == rows[0] and cut[2] == rows[2] and not cut[6].split() and len(cut[1].split()) < len(rows[1].split()) - 50
    assert set(intact(decontamination.without_benchmark(table, bench), table, names)) == {0, 1, 2, 4, 5, 6}
