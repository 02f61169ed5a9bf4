import pytest
from pyspark.sql import functions as F

from colloquy.plans import minutes as MI
from colloquy.plans import structure as ST
from colloquy.sources import sinks as S


def test_rewriting_some_meetings_keeps_the_others(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.createDataFrame([(f"m{i}", i, "old") for i in range(20)], "meeting_id string, n int, v string")
    S.write_context({"items": rows}, path, buckets=4)
    again = spark.createDataFrame([("m3", 3, "new"), ("m3", 4, "new"), ("m7", 7, "new")], "meeting_id string, n int, v string")
    for _ in range(2):
        S.write_context({"items": again}, path, buckets=4)
    got = spark.read.parquet(f"{path}/items")
    assert got.count() == 21 and got.filter("v = 'new'").count() == 3 and got.filter("meeting_id = 'm3'").count() == 2


def test_manifest_reads_names_only(spark, tmp_path):
    for name in ("a.MP3", "b.mp4", "c.txt"):
        (tmp_path / name).write_bytes(b"1234")
    ok, bad = S.media_manifest(spark, str(tmp_path))
    assert {(r.extension, r.is_video, r.length) for r in ok.collect()} == {("mp3", False, 4), ("mp4", True, 4)}
    assert [r.extension for r in bad.collect()] == ["txt"]
    assert "content" not in ok._jdf.queryExecution().executedPlan().toString().lower().split("output")[0]


def test_text_documents_keep_line_order(spark, tmp_path):
    lines = spark.range(3000).select(F.lit("doc").alias("doc_stem"), F.col("id").alias("n"), F.concat(F.lit("line "), F.col("id")).alias("line"))
    S.write_minutes_text(lines.repartition(7), str(tmp_path / "out"), ["n"])
    files = sorted((tmp_path / "out" / "doc_stem=doc").glob("*.txt"))
    text = "".join(f.read_text() for f in files).splitlines()
    assert text == [f"line {i}" for i in range(3000)]


def test_json_columns_survive_bad_text(spark):
    df = spark.createDataFrame([("[1,2]",), (None,), ("{x",)], "a string")
    assert [r.a for r in S.decode_json(df, {"a": "array<int>"}).collect()] == [[1, 2], [], []]


def test_whole_flow_from_talk_to_minutes(spark, talk):
    u = talk(("SPEAKER_00", "Hi, this is Elena. I'll order the lamps by Friday."), ("SPEAKER_01", "We decided to paint the hall because guests are coming."),
             ("SPEAKER_01", "We still need to decide on the carpet for the lobby."))
    meetings = spark.createDataFrame([("m", "u", "p", "Hall", "balanced", "upload", "queued"), ("x", "u", "p", "Empty", "brief", "live", "queued")],
                                     "meeting_id string, user_id string, project_id string, title string, summary_type string, source string, status string"
                                     ).withColumn("date", F.lit("2024-02-01 09:30:00").cast("timestamp"))
    c = ST.structure_meetings(u, meetings)
    assert {r.meeting_id: r.status for r in c.meetings.collect()} == {"m": "done", "x": "error"}
    owners = {r.description: (r.owner, r.urgency) for r in c.action_items.collect()}
    assert owners["Order the lamps by Friday"] == ("Elena", "high")
    assert owners["Decide on the carpet for the lobby"][0] is None
    assert [d.rationale for d in c.decisions.collect()] == ["Guests are coming"]
    who = spark.createDataFrame([("m", "SPEAKER_00", "Elena")], "meeting_id string, label string, name string")
    lines = MI.minutes_lines(c.meetings, u, who, c.topics, c.action_items, c.decisions, c.summary_lines, "01 Feb 2024, 10:00", True)
    text = [r.line for r in lines.orderBy("part", "a", "b").collect()]
    assert text[0] == "# Minutes of Meeting — Hall"
    assert "| 1 | Order the lamps by Friday | Elena | by Friday | High | Open |" in text
    assert "- Settle: Decide on the carpet for the lobby" in text
    assert "## Appendix — Transcript" in text and text[-1].startswith("_Generated by")
    again = ST.structure_meetings(u, meetings)
    assert {r.item_id for r in again.action_items.collect()} == {r.item_id for r in c.action_items.collect()}


def test_recomputed_meetings_without_rows_leave_none_behind(spark, tmp_path):
    path, schema = str(tmp_path), "meeting_id string, n int"
    S.write_context({"items": spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], schema), "notes": spark.createDataFrame([("a", 1), ("b", 2)], schema)}, path, buckets=3)
    ids = spark.createDataFrame([("a",), ("c",)], "meeting_id string")
    for _ in range(2):
        S.write_context({"items": spark.createDataFrame([("c", 9)], schema), "notes": spark.createDataFrame([], schema)}, path, buckets=3, recomputed=ids)
    rows = {n: sorted(tuple(r) for r in spark.read.parquet(f"{path}/{n}").select("meeting_id", "n").collect()) for n in ("items", "notes")}
    assert rows == {"items": [("b", 2), ("c", 9)], "notes": [("b", 2)]}


def test_equal_titles_are_different_documents(spark, tmp_path):
    lines = spark.createDataFrame([("x", "Plan", 0, "one"), ("y/1", "Plan", 0, "two")], "meeting_id string, doc_stem string, n int, line string")
    S.write_minutes_text(lines, str(tmp_path / "out"), ["n"])
    assert sorted(p.name for p in (tmp_path / "out").glob("doc_stem=*")) == ["doc_stem=Plan-x", "doc_stem=Plan-y_1"]


def finished_talk(spark, step=0.7):
    """Two meetings with the same topic ids, with items inside, outside and beyond the topics; one finished without any, one unfinished."""
    seg = [(m, i, "A" if i < 3 else "B", f"line {i}", round(i * step, 10), round(i * step + step, 10)) for m in "xy" for i in range(24)]
    segments = spark.createDataFrame(seg, "meeting_id string, segment_index int, speaker string, text string, start_time double, end_time double")
    meetings = spark.createDataFrame([(m, f"Talk {m}", "done" if m in "xyz" else "queued", "live") for m in "xyzq"], "meeting_id string, title string, status string, source string"
                                     ).withColumn("date", F.lit("2024-02-01 09:30:00").cast("timestamp"))
    topics = spark.createDataFrame([(f"t{n}", m, n, f"Part {n}", None, None, 5.0 * n, 5.0 * n + 3) for m in "xyq" for n in range(2)],
                                   "topic_id string, meeting_id string, topic_no int, title string, summary string, is_recurring boolean, start_time double, end_time double")
    items = spark.createDataFrame([(f"a{n}", m, d, o, "low", n == 1, None, s) for m in "xyq" for n, (d, o, s) in enumerate(
        [("Pack", "Ana", 2), ("Ship", None, 9), ("Decide on price", None, 20), ("Late", "Ana", 99), (None, "Ana", 3)])],
        "item_id string, meeting_id string, description string, owner string, urgency string, resolved boolean, due string, segment_index int")
    decisions = spark.createDataFrame([("d0", "x", "Stop", "Rain", 8)], "decision_id string, meeting_id string, description string, rationale string, segment_index int")
    summary = spark.createDataFrame([("x", 0, 0, "Short."), ("q", 0, 0, "None.")], "meeting_id string, part int, n long, line string")
    who = spark.createDataFrame([("x", "A", "Ines")], "meeting_id string, label string, name string")
    return meetings, segments, who, topics, items, decisions, summary


@pytest.fixture(scope="module")
def finished(spark):
    return MI.minutes_lines(*finished_talk(spark), "01 Feb 2024, 10:00", True)


def test_minutes_prepare_each_table_once(finished):
    assert finished._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 15


def test_minutes_keep_meetings_with_equal_topic_ids_apart(finished):
    rows = finished.orderBy("meeting_id", "part", "a", "b").collect()
    assert {r.meeting_id for r in rows} == set("xyz")
    text = {m: [r.line for r in rows if r.meeting_id == m] for m in "xyz"}
    section = {m: [r.line for r in rows if r.meeting_id == m and r.part == 4 and (r.line or "").startswith(("###", "- "))] for m in "xy"}
    assert section["y"] == ["### 1. Part 0  ", "- **Action:** Pack — Ana", "### 2. Part 1  ", "- **Action:** Ship", "- **Action:** Decide on price"]
    assert section["x"] == [*section["y"][:3], "- **Decision:** Stop — Rain", *section["y"][3:]]
    assert "| 1 | Stop | Rain | 00:05 | B |" in text["x"] and "_No decisions were recorded._" in text["y"]
    assert [r.line for r in rows if r.meeting_id == "y" and r.part == 6 and r.a > 0 and r.line] == [
        "| 1 | Pack | Ana | — | Low | Open |", "| 3 | Ship | Unassigned | — | Low | Done |", "| 4 | Late | Ana | — | Low | Open |"]
    assert [r.line for r in rows if r.meeting_id == "x" and r.part == 8] == [
        "**Proposed agenda for the next meeting**", "", "- Settle: Decide on price", "- Status of: Pack (Ana)", "- Review progress on the items above.",
        "- Status of: Late (Ana)", "- Review decision: Stop", ""]
    assert [r.line for r in rows if r.meeting_id == "z" and r.part == 8][2] == "- Review progress on the items above."
    assert "| **Participants** | B, Ines |" in text["x"] and "| **Participants** | — |" in text["z"] and "## Participation" not in text["z"]


def test_shares_at_a_half_do_not_follow_the_order_of_the_sums(spark):
    lines = MI.minutes_lines(*finished_talk(spark, 0.1), "01 Feb 2024, 10:00")
    assert [r.line for r in lines.filter("meeting_id = 'x' and part = 9 and a > 0 and line <> ''").orderBy("a").collect()] == [
        "| B | 00:02 | 88% |", "| Ines | 00:00 | 12% |"]
