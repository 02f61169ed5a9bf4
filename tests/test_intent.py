import pytest
from pyspark.sql import functions as F

from colloquy.functions import labels as L
from colloquy.operators import dedupe as DD
from colloquy.operators import intent as I

CASES = [
    ("We still have to choose the paint for the hall.", "open_item", "Choose the paint for the hall"),
    ("Nobody has decided who runs the night shift.", "open_item", "Decide who runs the night shift"),
    ("Did we settle anything about the roof?", "question", None),
    ("The decision log is very long.", "general", None),
    ("So we agreed to close the north gate because the road is wet.", "decision", "Close the north gate"),
    ("Okay, let's go with steel for the frame.", "decision", "Go with steel for the frame"),
    ("It was decided that the shop stays open late.", "decision", "The shop stays open late"),
    ("We're not going ahead with the second tower.", "decision", "Not going ahead with the second tower"),
    ("Let's move on to the next point.", "general", None),
    ("Okay, so the paint order is approved then.", "decision", "The paint order is approved"),
    ("Yeah, I'll mail the plans to the builder by Monday.", "commitment", "Mail the plans to the builder by Monday"),
    ("I'll be brief, the week was hard.", "general", None),
    ("Ravi, could you measure the door before lunch?", "request", "Measure the door before lunch"),
    ("Could you explain the drawing?", "question", None),
    ("Elena will order the tiles next week.", "assignment", "Order the tiles next week"),
    ("I already paid the invoice yesterday.", "done", None),
    ("Action item for Hugo: build the ramp by Thursday.", "assignment", "Build the ramp by Thursday"),
    ("We need quotes from suppliers before we pick one.", "collective", "Obtain quotes from suppliers before we pick one"),
    ("How about we rent a crane?", "proposal", "Rent a crane"),
    ("Sounds good.", "agreement", None), ("Nope, that won't work.", "disagreement", None),
    ("I will, I'll call the plumber.", "commitment", "Call the plumber"),
]


@pytest.fixture(scope="module")
def seen(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "t string")
    return {r.t: r.a for r in I.analyse(df, "t", "a").collect()}


@pytest.mark.parametrize("text, intent, description", CASES)
def test_single_sentences(seen, text, intent, description):
    assert seen[text].intent == intent
    if description is not None:
        assert seen[text].description == description


def test_owner_due_and_rationale(seen):
    assert seen["Ravi, could you measure the door before lunch?"].owner == "Ravi"
    assert seen["Elena will order the tiles next week."].due == "next week"
    assert seen["So we agreed to close the north gate because the road is wet."].rationale == "The road is wet"


def items(utterances):
    return DD.dedupe_actions(I.extract_action_items(I.context_rows(utterances))).orderBy("segment_index").collect()


def decisions(utterances):
    return DD.dedupe_decisions(I.extract_decisions(I.context_rows(utterances))).collect()


def test_proposal_needs_another_speaker(talk):
    yes = talk(("Ana", "Should we rent the small hall?"), ("Bo", "Yeah, sounds good."))
    assert [d.description for d in decisions(yes)] == ["Rent the small hall"]
    no = talk(("Ana", "Should we rent the small hall?"), ("Bo", "No, I don't think so."))
    assert decisions(no) == []


def test_vague_acceptance_takes_over_the_request(talk):
    got = items(talk(("Ana", "Can you print the floor plan by Tuesday?"), ("Bo", "Sure, I'll do it.")))
    assert [(i.description, i.owner, i.due) for i in got] == [("Print the floor plan by Tuesday", "Bo", "by Tuesday")]


def test_request_goes_to_the_only_other_speaker_and_pronouns_resolve(talk):
    got = items(talk(("Ana", "Please send me the key list today."), ("Bo", "The lamp is green by the way.")))
    assert [(i.owner, i.description) for i in got] == [("Bo", "Send Ana the key list today")]


def test_introduced_names_own_their_promises(talk):
    got = items(talk(("SPEAKER_00", "Hi, this is Elena. I'll order the lamps tomorrow.")))
    assert got[0].owner == "Elena" and got[0].due == "tomorrow"


def test_repeated_promise_is_one_item_with_its_evidence(talk):
    got = items(talk(("Bo", "Hello."), ("Bo", "I'll fix the west door tonight."), ("Bo", "So yeah, I will fix the west door tonight.")))
    assert len(got) == 1 and got[0].segment_index == 1 and got[0].evidence == "I'll fix the west door tonight."


def test_small_talk_gives_nothing(talk):
    quiet = talk(("Bo", "The rain was loud yesterday."), ("Ana", "Yeah, honestly the show went great."))
    assert items(quiet) == [] and decisions(quiet) == []


def test_labels(spark):
    df = spark.createDataFrame([("I'll patch the wall by noon.",), ("We decided to sell the van.",), ("Blue is a colour.",), ("",)], "text string")
    assert [r.label for r in I.classify_segment(df).collect()] == ["action_item", "decision", "general", "general"]


def test_user_rules(spark):
    df = spark.createDataFrame([("the gate is red",), ("nothing",)], "t string")
    rule = I.match_first_rule(F.col("t"), [("gate", r"\bgate\b"), ("red", r"\bred\b")])
    assert [r.r for r in df.select(rule.alias("r")).collect()] == ["gate", None]


def test_each_form_of_a_text_is_analysed_once(spark):
    texts = ["I will send order 12345 to Ana by Friday.", "I will send order 67890 to Ana by Friday.", "I will send order 123 to Ana by Friday.", "Sounds good.", "Sounds good.",
             "I will pack 12345 and 12399 by Friday.", "I will pack 12345 and 12300 by Friday.", "I will send 1234 by 12 May.", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    met = []

    def work(forms):
        met.extend(r["__form"] for r in forms.collect())
        return forms.withColumn("__seen", F.col("__form"))

    I.by_form(df, F.col("t"), work)
    assert sorted(met) == sorted(["", "I will send order 00000 to Ana by Friday.", "I will send order 000 to Ana by Friday.", "Sounds good.", *texts[5:8]])
    found = {r["n"]: r["a"] for r in I.analyse(df, "t", "a").collect()}
    assert [found[n]["description"] for n in (0, 1, 2, 5, 7)] == [
        "Send order 12345 to Ana by Friday", "Send order 67890 to Ana by Friday", "Send order 123 to Ana by Friday", "Pack 12345 and 12399 by Friday", "Send 1234 by 12 May"]
    assert found[8] is None and found[9]["intent"] == "general"
    assert {r["n"]: r["urgency"] for r in I.urgency(df, F.col("t")).collect()} == {r["n"]: r["u"] for r in df.select("n", L.score_urgency(F.col("t")).alias("u")).collect()}
