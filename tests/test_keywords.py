import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import ranking as R


@pytest.fixture()
def said(spark):
    rows = [("m", 0, " the Crane, crane lifts THE beam "), ("m", 1, "beam holds; crane's beam rests"), ("n", 70000, "zebra apple"), ("n", 2, "mango zebra apple"), ("o", 0, "of it")]
    return spark.createDataFrame(rows, "meeting_id string, segment_index int, text string")


def test_counts_and_order_of_first_appearance(said):
    got = [(r.meeting_id, r.rank, r.term, r.n, round(r.freq, 6)) for r in R.keywords(R.term_counts(said), 3).orderBy("meeting_id", "rank").collect()]
    assert got == [("m", 1, "beam", 3, 1.0), ("m", 2, "crane", 2, round(2 / 3, 6)), ("m", 3, "lifts", 1, round(1 / 3, 6)),
                   ("n", 1, "zebra", 2, 1.0), ("n", 2, "apple", 2, 1.0), ("n", 3, "mango", 1, 0.5)]
    assert {(r.meeting_id, r.term): r.freq for r in R.term_frequencies(said).collect()}["m", "holds"] == pytest.approx(1 / 3)


def test_texts_are_cut_into_words_once_and_counted_without_sorting(said):
    plan = R.keywords(R.term_counts(said))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 1 and "SortAggregate" not in plan


def test_tokens_of_blank_edges(spark):
    row = spark.sql("select ' the  Crane\\u00a0beam. ' as t").select(T.tokens_summary(F.col("t")).alias("x")).first()
    assert row.x == ["crane", "beam"]


def test_frequency_scores_are_means_over_words(spark, said):
    sentences = spark.createDataFrame([("m", 0, 0, "the crane crane beam"), ("m", 1, 0, "of it"), ("n", 2, 0, "unheard mango")],
                                      "meeting_id string, segment_index int, piece_no int, sentence string")
    scored = R.freq_scores(sentences, R.term_frequencies(said))
    assert {(r.meeting_id, r.segment_index): r.score for r in scored.collect()} == {("m", 0): round((2 / 3 + 2 / 3 + 1) / 3, 9), ("m", 1): 0.0, ("n", 2): 0.25}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 2 and plan.count("Join") == 3  # of these one each tells the most frequent count


def test_best_lines_of_topics_need_no_shuffle(spark):
    from colloquy.plans import summaries as SU
    rows = [("m", 0, "We talked about lunch today. The budget covers the budget review. Lunch was served late."), ("m", 1, None), ("n", 0, "Hi.")]
    best = SU.topic_best_lines(spark.createDataFrame(rows, "meeting_id string, topic_no int, summary string"))
    assert [tuple(r) for r in best.select("meeting_id", "topic_no", "best_line").orderBy("meeting_id", "topic_no").collect()] == [
        ("m", 0, "The budget covers the budget review."), ("m", 1, ""), ("n", 0, "Hi.")]
    assert "Exchange" not in best._jdf.queryExecution().executedPlan().toString()
