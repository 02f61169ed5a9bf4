"""Two sentences for each of the 21 rules, and the guards that turn a rule down."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import grammar as G
from colloquy.functions import sentence_rules as R
from colloquy.operators import intent as I

RULES = [
    (1, "Action item for Nadia: rent the second van.", "assignment"), (1, "Follow-up: call the harbour office.", "assignment"),
    (2, "We still need to settle the parking fees.", "open_item"), (2, "Nobody has figured out where the cables go.", "open_item"),
    (3, "The venue is still undecided for the spring party.", "open_item"), (3, "That's up in the air for now.", "open_item"),
    (4, "The panel has approved the new uniforms.", "decision"), (4, "They finally agreed on the larger tent.", "decision"),
    (5, "It was decided that the gate stays shut.", "decision"), (5, "This is now official: the pier closes in autumn.", "decision"),
    (6, "Our verdict is that the bridge stays.", "decision"), (6, "The final call was to rent both halls.", "decision"),
    (7, "Let's postpone the boat trip.", "decision"), (7, "We're planning to launch the ferry in May.", "decision"),
    (8, "The second boat order is cancelled.", "decision"), (8, "So our winter schedule has been finalized.", "decision"),
    (9, "Going ahead with the blue paint.", "decision"), (9, "So moving forward with the old ticket machine.", "decision"),
    (10, "Could you please water the plants?", "request"), (10, "Nadia, can you quickly count the chairs?", "request"),
    (11, "Please collect the keys tonight.", "request"), (11, "Kindly update the guest list.", "request"),
    (12, "I'd like someone to repair the fence.", "request"), (12, "You need to book the ferry by Friday.", "request"),
    (13, "Nadia will repaint the pier.", "assignment"), (13, "Omar and Nadia should order new ropes.", "assignment"),
    (14, "Let's give the inspection to Omar.", "assignment"), (14, "Hand it to Nadia.", "assignment"),
    (15, "Omar, you take the tickets to the office.", "assignment"), (15, "Nadia take the measurements of the deck.", "assignment"),
    (16, "The owner for the north pier is Omar.", "assignment"), (16, "That falls to Nadia.", "assignment"),
    (17, "I'll sweep the deck tomorrow.", "commitment"), (17, "Let me order the lifebelts.", "commitment"),
    (18, "All of us have to sign the safety form.", "collective"), (18, "The design team needs to draw a new sign.", "collective"),
    (19, "Let's clean the cabins.", "collective"), (19, "Let us paint the railing.", "collective"),
    (20, "We need two quotes from suppliers.", "collective"), (20, "I require permits from the harbour office.", "collective"),
    (21, "The first thing to do is check the engine.", "collective"), (21, "The west railing needs to be fixed.", "collective"),
]
GUARDS = [
    ("We haven't approved the new uniforms.", "general"), ("The decision making process is slow.", "general"), ("It is approved.", "general"),
    ("Have we decided on the tent?", "question"), ("Can you tell me more?", "question"), ("I'll be brief.", "general"), ("Let's get started.", "general"),
    ("Let's move on to the next point.", "general"), ("I won't sweep the deck.", "general"), ("Sounds good.", "agreement"), ("Nope.", "disagreement"),
    ("I will, I'll sweep the deck.", "commitment"), ("", "general"), ("Fog.", "general"),
]


@pytest.fixture(scope="module")
def seen(spark):
    texts = [t for _, t, _ in RULES] + [t for t, _ in GUARDS]
    return {r.t: r.a for r in I.analyse(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "a").collect()}


@pytest.mark.parametrize("number, text, intent", RULES)
def test_rule(seen, spark, number, text, intent):
    assert seen[text].intent == intent and seen[text].confidence > 0


def test_each_sentence_fits_its_rule(spark):
    rows = spark.createDataFrame([(n, t) for n, t, _ in RULES], "n int, t string")
    rows = rows.withColumn("p", F.expr(G.pieces("t"))).withColumn("s", F.expr(G.signs("p")))
    fits = [F.expr(G.taken("s", r.takes, r.then)).isNotNull().alias(f"r{r.number}") for r in R.SENTENCE_RULES]
    missing = [(r["n"], r["t"]) for r in rows.select("n", "t", *fits).collect() if not r[f"r{r['n']}"]]
    assert not missing


@pytest.mark.parametrize("text, intent", GUARDS)
def test_guard(seen, text, intent):
    assert seen[text].intent == intent


def test_pieces_and_signs(spark):
    texts = ["Don't we'll go now: 3rd, 12 2024 5pm…", "", "\U0001f600 x", "'' 'tis", None, "word " * 20_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", F.expr(G.pieces("t"))).withColumn("s", F.expr(G.signs("p")))
    got = rows.collect()
    for r in got:
        if r.t is not None:
            assert len(r.s) == 2 * len(r.p) and "".join(r.p) == r.t.lstrip()
    assert got[0].p[0] == "Don't " and got[0].p[2] == "'ll "
    assert rows.where("t is null and s is null").count() == 1


def test_parts_read_back(spark):
    rule = next(r for r in R.SENTENCE_RULES if r.number == 13)
    rows = spark.createDataFrame([("So, Omar and Nadia should order ropes",)], "t string").withColumn("p", F.expr(G.pieces("t"))).withColumn("s", F.expr(G.signs("p")))
    rows = rows.withColumn("u", F.expr(G.taken("s", rule.takes, rule.then))).withColumn("n", F.expr(G.noted("p", "u")))
    got = rows.select(F.expr(G.part_of("n", rule.takes, "owner")).alias("owner"), F.expr(G.after("p", "u")).alias("rest")).head()
    assert (got.owner, got.rest) == ("Omar and Nadia", "order ropes")
