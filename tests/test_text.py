import pytest
from pyspark.sql import functions as F

from colloquy.functions import labels as L
from colloquy.functions import text as T


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first().r


@pytest.mark.parametrize("raw, clean", [
    ("So, um, the parcel , you know, left", "the parcel, left"),
    ("Okay then, yes", "yes"), ("  ", ""), ("a  b ;", "a b"), ("well, well, fine", "fine"),
])
def test_clean_text(spark, raw, clean):
    assert one(spark, T.clean_text, raw) == clean


def test_sentences_and_clauses(spark):
    got = one(spark, T.split_sentences, "The dock is full. Ana moves crates, so she needs time; then we load.")
    assert got == ["The dock is full.", "Ana moves crates", "she needs time", "we load."]
    assert one(spark, T.split_sentences, " ") == []


def test_tokens(spark):
    assert one(spark, T.tokens_topic, "I'll re-route the A4 trucks' cargo") == ["re-route", "trucks", "cargo"]
    assert one(spark, T.tokens_norm, "Çà et là, déjà-vu") == ["ca", "et", "la", "deja", "vu"]
    assert one(spark, lambda c: T.ngrams(T.tokens_basic(c), 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda c: T.ngrams(T.tokens_basic(c), 2), "a") == []


def test_names_and_due(spark):
    assert one(spark, T.addressee, "Ravi, please look") == "Ravi"
    assert one(spark, T.addressee, "Please look, Ravi?") == "Ravi"
    assert one(spark, T.addressee, "Monday, please look") is None
    find_due = lambda _: T.find_due("c0")
    assert one(spark, find_due, "send it by the end of the month, not today") == "by the end of the month"
    assert one(spark, find_due, "nothing here") is None


def test_pronouns_keep_labels_and_special_characters(spark):
    assert one(spark, T.resolve_pronouns, "Send me your file", "SPEAKER_00", "Ana") == "Send me Ana's file"
    assert one(spark, T.resolve_pronouns, "Send me my file", "A$1", "SPEAKER_01") == "Send A$1 A$1's file"


def test_formats(spark):
    def at(f, x):
        return spark.range(1).select(f(F.lit(x)).alias("r")).first().r
    assert [at(L.format_duration, x) for x in (45.0, 185.0, 3900.0)] == ["45 s", "3 min 05 s", "1 h 05 min"]
    assert at(L.format_clock, 7260.0) == "121:00"
    assert spark.range(1).select(L.format_clock(F.lit(None).cast("double")).alias("r")).first().r == "—"


@pytest.mark.parametrize("text, level", [
    ("Fix the outage on dock two", "critical"), ("Ship it before the launch", "high"), ("This one is important", "medium"),
    ("Paint the fence some day", "low"), ("", "low"), ("Finish this by end of day", "high"), ("Review this", "low"),
])
def test_urgency(spark, text, level):
    assert one(spark, L.score_urgency, text) == level


def test_accents_of_all_scripts(spark):
    import unicodedata
    texts = ["Tiếng Việt ﬁle ＡＢ", "ÅNGSTRÖM ½ ™", "plain", "ẞ ǆ ﷺ", "한국 é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.x for r in df.select(T.fold_accents(F.lower("t")).alias("x")).collect()]
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert got[:4] == [fold(t.lower()) for t in texts[:4]] and got[4] == "한국 e"


def test_summary_blocks_and_points(spark):
    long = "a point that is long enough"
    rows = [("m", 0, "## Meeting Overview"), ("m", 1, ""), ("m", 2, f"- **{long}**"), ("m", 3, "short"), ("m", 4, "> quoted words, not a point at all"), ("m", 5, "### Part"),
            ("m", 6, f"1. {long} too"), ("m", 7, "| a | b |"), ("x", 0, "tiny"), ("x", 1, "---")]
    lines = spark.createDataFrame(rows, "meeting_id string, n int, line string")
    more = spark.createDataFrame([("m", 0, "unused"), ("x", 0, "decided"), ("x", 1, "to do")], "meeting_id string, n int, point string")
    assert [tuple(r)[2:] for r in T.summary_blocks(lines).where("meeting_id = 'm'").orderBy("n").collect()] == [
        ("bullet", long), ("para", "short"), ("quote", "quoted words, not a point at all"), ("heading", "Part"), ("bullet", f"{long} too")]
    assert sorted(map(tuple, T.summary_points(lines, more).collect())) == [("m", 1, long), ("m", 2, f"{long} too"), ("x", 1, "decided"), ("x", 2, "to do")]


def test_rare_letters_in_a_long_text_are_folded_in_seconds(spark):
    import time
    df = spark.createDataFrame([("plain words of some length " * 40_000 + "½ ﬁn… é́\U0001d400",)], "t string")
    begun = time.time()
    got = df.select(T.fold_accents(F.col("t")).alias("x")).first().x
    assert got == "plain words of some length " * 40_000 + "1⁄2 fin... eA" and time.time() - begun < 12
