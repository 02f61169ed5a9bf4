import math
from collections import Counter

from colloquy.operators import ranking as R


def test_scores_in_blocks_equal_plain_ones(spark):
    words = ["cement", "gravel", "trench", "violin", "orchestra", "the", "stage"]
    rows = [(m, i * step, 0, " ".join(words[(i * i + j * (i % 4) + len(m)) % 7] for j in range(i % 5)), i) for m, n, step in (("long", 40, 3), ("b", 6, 1)) for i in range(n)]
    rows.append(("long", 0, 1, "", 99))
    sentences = spark.createDataFrame(rows, "meeting_id string, segment_index int, piece_no int, sentence string, i int")
    plain = {}
    for m in ("long", "b"):
        own = [(r, [w for w in r[3].split() if w != "the"]) for r in rows if r[0] == m]
        df = Counter(t for _, s in own for t in set(s))
        for r, s in own:
            tf = Counter(s)
            plain[r] = sum(tf[t] * tf[t] / max(tf.values()) * math.log((1 + len(own)) / (1 + df[t])) for t in tf) / len(s) if s else 0.0
    for size in (4, 256):
        got = R.tfidf_scores(sentences, size=size).collect()
        assert len(got) == len(rows) and all(abs(plain[tuple(r)[:5]] - r.score) < 2e-9 for r in got)


def test_repeats_of_a_winner_come_along(spark):
    scored = spark.createDataFrame([("m", i, 0, t, s) for i, (t, s) in enumerate([("a", 3.0), ("b", 2.0), ("c", 2.0), ("a", 3.0), ("b", 2.0), ("d", 1.0)])],
                                   "meeting_id string, segment_index int, piece_no int, sentence string, score double")
    assert sorted(r.segment_index for r in R.best_texts(scored, 3).collect()) == [0, 1, 3, 4]


def test_texts_are_stored_once_and_rows_that_come_twice_stay_apart(spark, talk, monkeypatch):
    u = talk(("a", "We moved the whole plan to Friday. It is ready now for all of us."), ("b", "we agreed on the smaller budget yesterday. And so on"), ("a", "Hm ?"))
    stored, store = [], R.cut

    def kept(df, wide=False):
        out = store(df, wide)
        if "clean" in out.columns:
            stored.extend(out.select("clean").collect())
        return out

    monkeypatch.setattr(R, "cut", kept)
    once = sorted(r.sentence for r in R.summary_sentences(u).collect())
    assert stored and all(r.clean is None for r in stored)
    first = u.filter("segment_index = 0")
    twice = sorted(r.sentence for r in R.summary_sentences(first.unionByName(first)).collect())
    assert len(once) >= 2 and len(twice) in (2, 4) and all("Friday" in s or "ready" in s for s in twice)
