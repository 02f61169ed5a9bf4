from colloquy.operators import maintenance as M


def test_external_summaries(spark):
    texts = [("a", '{"summary": " First\\n- second \\n"}'), ("a", '{"summary": "Zweite"}'), ("b", '{"summary": "  "}'), ("c", "{oops"), ("d", None), (None, '{"summary": "x"}')]
    payloads = spark.createDataFrame(texts, "meeting_id string, payload string")
    local = spark.createDataFrame([(m, 2, 0, f"local {m}", 1) for m in "abcde"], "meeting_id string, part int, n int, line string, extra int")
    got = sorted(tuple(r) for r in M.merge_summaries(payloads, local).where("meeting_id is not null").collect())
    assert got == [("a", 0, 0, "First"), ("a", 0, 1, "- second"), *[(m, 2, 0, f"local {m}") for m in "bcde"]]
    assert M.merge_summaries(payloads.limit(0), local).count() == 5 and M.merge_summaries(payloads, local.limit(0)).count() == 3


def test_topics_of_results_that_list_none_stay_local(spark):
    texts = [("a", '{"topics": [{"title": "T", "summary": "s"}]}'), ("b", '{"topics": []}'), ("c", "{oops")]
    local = spark.createDataFrame([(m, 0, f"local {m}", "s", 1.0) for m in "abc"], "meeting_id string, topic_no int, title string, summary string, start_time double")
    got = M.merge_topics(spark.createDataFrame(texts, "meeting_id string, payload string"), local)
    assert sorted((r["meeting_id"], r["title"], r["start_time"]) for r in got.collect()) == [("a", "T", None), ("b", "local b", 1.0), ("c", "local c", 1.0)]
