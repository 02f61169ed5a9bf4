from colloquy.operators import joins as C
from colloquy.operators import maintenance as M

SEG = "meeting_id string, segment_index int, speaker string, text string, start_time double, end_time double"
TURN = "meeting_id string, turn_idx int, speaker string, start_time double, end_time double"


def test_overlap_ties_defaults_and_odd_intervals(spark):
    seg = spark.createDataFrame([("m", 0, "x", "", 0.0, 4.0), ("m", 1, "x", "", 100.0, 101.0), ("m", 2, "x", "", 5.0, 5.0),
                                 ("m", 3, "x", "", 9.0, 8.0), ("m", 4, "x", "", 25.0, 95.0)], SEG)
    turns = spark.createDataFrame([("m", 0, "A", 0.0, 2.0), ("m", 1, "B", 2.0, 4.0), ("m", 2, "C", 20.0, 50.0), ("m", 3, "D", 50.0, 96.0)], TURN)
    got = {r.segment_index: r.speaker for r in C.assign_speakers(seg, turns).collect()}
    assert got == {0: "A", 1: "SPEAKER_00", 2: "SPEAKER_00", 3: "SPEAKER_00", 4: "D"}


def test_relabel_adds_and_drops_speakers(spark):
    seg = spark.createDataFrame([("m", i, "SPEAKER_00", "", i + 0.0, i + 0.9) for i in range(7)], SEG)
    turns = spark.createDataFrame([("m", 0, "SPEAKER_01", 0.0, 3.5), ("m", 1, "SPEAKER_02", 3.5, 8.0)], TURN)
    who = spark.createDataFrame([("m", "SPEAKER_00", None)], "meeting_id string, label string, name string")
    segments, speakers, changed = C.relabel_segments(seg, who, turns)
    assert [r.speaker for r in segments.orderBy("segment_index").collect()] == ["SPEAKER_01"] * 4 + ["SPEAKER_02"] * 3
    assert sorted(r.label for r in speakers.collect()) == ["SPEAKER_01", "SPEAKER_02"]
    assert changed.count() == 7


def test_items_attach_inside_first_else_nearest(spark):
    seg = spark.createDataFrame([("m", i, "x", "", t, t + 1) for i, t in enumerate([5.0, 35.0, 500.0, 20.0])], SEG)
    spans = spark.createDataFrame([("m", "t0", 0, 0.0, 20.0), ("m", "t1", 1, 20.0, 25.0), ("m", "t2", 2, 60.0, 70.0)],
                                  "meeting_id string, topic_id string, span_no long, span_start double, span_end double")
    items = spark.createDataFrame([("m", f"i{k}", k) for k in (0, 1, 2, 3, 9)], "meeting_id string, item_id string, segment_index int")
    got = {r.item_id: r.topic_id for r in C.attach_items_to_topics(items, spans, seg).collect()}
    assert got == {"i0": "t0", "i1": "t1", "i2": "t2", "i3": "t0", "i9": None}


def test_external_results_with_bad_json(spark):
    good = '{"summary":"s","action_items":[{"description":" Call ","owner":null,"due":"today","urgency":"odd","confidence":0.9},{"description":" ","confidence":0.9}]}'
    payloads = spark.createDataFrame([("a", good), ("b", "{broken"), ("c", None)], "meeting_id string, payload string")
    local = spark.createDataFrame([(m, "Local", None, None, "low", "", 0.5, 0) for m in "abc"],
                                  "meeting_id string, description string, owner string, due string, urgency string, evidence string, confidence double, segment_index int")
    ldec = spark.createDataFrame([("a", "D", None, "", 0.5, 0)], "meeting_id string, description string, rationale string, evidence string, confidence double, segment_index int")
    items, decisions = M.merge_extraction_sources(payloads, local, ldec)
    assert sorted((r.meeting_id, r.description, r.urgency) for r in items.collect()) == [("a", "Call", "critical"), ("b", "Local", "low"), ("c", "Local", "low")]
    assert decisions.count() == 0
