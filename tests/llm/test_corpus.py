import random

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from colloquy.llm import decontamination, preference
from colloquy.llm.queries import ORACLES, QUERIES
from tools.check import rows_of

PATH = "/root/testdata/sf0.001"


def test_registered():
    names = entry_point.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n.split("_")[0][2:].isdigit()} and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES)


def test_preference_edge_cases(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", "hi"), (1, 1, "assistant", "b"), (1, 2, None, None),
             (2, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "user", "alone"), (6, 0, "user", "x"), (6, 0, "user", "y"), (7, 0, "user", "x"),
             (8, 0, "user", "q"), (8, 2, "assistant", "r"), (9, 0, "user", "q"), (9, 1, "assistant", "r"), (None, 0, "user", "z"), (10, None, "user", "z")]
    turns += [(20, 0, "user", "q"), (20, 1, "assistant", "old"), (20, 2, "user", "q2"), (20, 3, "assistant", "new"), (20, 3, "assistant", "another"), (20, 3, "user", "too"),
              (20, 4, "user", "bye"), (22, 0, "assistant", "a" * 200_000), (22, 1, "assistant", "a" * 200_000), (24, 0, "assistant", None), (26, 0, "assistant", "only"), (28, 0, "user", "")]
    table = spark.createDataFrame([(*t, "x", 1, "y") for t in turns], "conv_id long, turn long, role string, text string, part string, salt int, last string")
    con = duckdb.connect()
    con.register("conversations", table.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    for pairs, sql in ((preference.stale_pairs, preference.ORACLE), (preference.consecutive_pairs, preference.CONSECUTIVE_SQL)):
        got = preference.preference_rows(pairs(table))
        want = con.execute(sql)
        assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in want.description], want.fetchall())
        assert preference.preference_rows(pairs(table.limit(0))).count() == 0
    first = [r for r in got.collect() if r["pair_id"] == 0]
    assert sorted((r["part"], r["turn"], r["train"]) for r in first) == [("chosen", 1, True), ("prompt", 0, False), ("rejected", 1, True), ("rejected", 2, False)]


def test_stale_answers(spark):
    turns = [(0, "user", "q"), (1, "assistant", "old"), (2, "user", "q2"), (3, "assistant", "new"), (4, "user", "bye")]
    table = spark.createDataFrame([(5, *t) for t in turns], "conv_id long, turn long, role string, text string")
    got = preference.preference_rows(preference.stale_pairs(table)).orderBy("part", "turn").collect()
    assert [(r["part"], r["turn"], r["rendered"][r["train_from"]:]) for r in got] == [
        ("chosen", 3, "new\n"), ("chosen", 4, ""), ("prompt", 0, ""), ("prompt", 1, ""), ("prompt", 2, ""), ("rejected", 3, "old\n")]


def test_prompts_on_the_given_table(spark):
    rows = QUERIES["op6_chat_format"](spark, PATH)
    parts = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    assert set(parts) == {"prompt", "chosen", "rejected"} and parts["prompt"] > parts["rejected"] > 0


def sentences(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(4)
    items = [sentences(rng, n) for n in (15, 30, 45, 58)]
    held = {}
    texts = {i: " ".join(sentences(rng, rng.randrange(20, 400))) for i in range(60)}
    for i, item in enumerate(items):
        texts[100 + i] = " ".join([*sentences(rng, 50 + 7 * i), *item, *sentences(rng, 90)])
        texts[200 + i] = " ".join([*sentences(rng, 31), *[w.upper() + "!" for w in item]])
        held[100 + i] = held[200 + i] = i
    changed = [w if k % 5 else f"other{k}" for k, w in enumerate(items[2])]
    texts[300] = " ".join([*sentences(rng, 120), *changed, *sentences(rng, 40)])
    held[300] = 2
    docs = spark.createDataFrame([(d, t, "k") for d, t in texts.items()] + [(400, None, "k"), (401, "", "k"), (None, texts[100], "k")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(9, None, 1), (8, "", 1), (7, " ".join(items[0]), 1)], "item_id long, text string, doc_id int")
    return docs, bench, held


def test_leaks_are_found_and_clean_texts_left(leaks):
    docs, bench, held = leaks
    got = {r["doc_id"]: r["item_id"] for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {**held, None: 0}
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0 and decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_leaks_are_removed(leaks):
    docs, bench, held = leaks
    kept = decontamination.without_benchmark(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(60), 400, 401}


def test_blocks_of_items_agree(leaks, monkeypatch):
    docs, bench, held = leaks
    monkeypatch.setattr(decontamination, "ITEMS", 2)
    assert {r["doc_id"]: r["item_id"] for r in decontamination.contaminated(docs, bench).collect()} == {**held, None: 0}


def test_lcs_against_plain_recursion():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 15))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        masks = {}
        for i, w in enumerate(a.tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        assert decontamination.lcs(a, masks, b).bit_count() == table[-1, -1]


def plain_matches(items, idf, words, start, known):
    """Items that the text around the passage at ``start`` of one text holds: all of them compared."""
    import numpy as np
    for k, (item, answer) in enumerate(zip(items.words, items.answers)):
        about = len(item) // 2
        text = words[max(0, start - about):start + decontamination.PASSAGE + about]
        masks = {word: sum(1 << i for i in np.flatnonzero(item == word).tolist()) for word in item.tolist()} if k not in known else known[k]
        known[k] = masks
        share = decontamination.lcs(item, masks, text).bit_count() / len(item)
        there = np.isin(answer, text)
        if share >= decontamination.LIKELY:
            sure = share >= decontamination.SURE or (there.mean() >= decontamination.ANSWER and idf[answer[there]].max(initial=0) > np.median(idf[item]))
            yield k, bool(sure)


def test_bound_loses_no_match_and_op9_finds_what_all_comparisons_find(spark):
    import numpy as np
    import pyarrow as pa
    docs = spark.read.parquet(f"{PATH}/documents.parquet").orderBy("doc_id").collect()
    bench = [r for r in spark.read.parquet(f"{PATH}/benchmark.parquet").orderBy("item_id").collect() if r["text"]]
    items = decontamination.Items.of([(r["item_id"], r["text"], None) for r in bench])
    own = decontamination.Words(pa.array([r["text"] for r in docs], pa.string()), plain=True)
    at = np.minimum(np.searchsorted(items.terms, own.hashes), len(items.terms) - 1)
    words, bounds = np.where(items.terms[at] == own.hashes, at, -1), own.first.astype(np.int64)
    idf = np.append(np.log1p(len(words) / (np.bincount(words + 1, minlength=len(items.terms) + 1)[1:] + 1)), 0.0)
    near, known = set(), {}
    for rows, starts, passage, item in decontamination.Bound.of(items, idf).near(words, bounds):
        near |= {(int(rows[p]), int(starts[p]), int(k)) for p, k in zip(passage, item)}
    sure = set()
    for i, row in enumerate(docs):
        for start in range(bounds[i], max(bounds[i] + 1, bounds[i + 1] - decontamination.PASSAGE + decontamination.STRIDE) if bounds[i + 1] > bounds[i] else bounds[i], decontamination.STRIDE):
            for k, certain in plain_matches(items, idf, words[bounds[i]:bounds[i + 1]], start - bounds[i], known):
                assert (i, start, k) in near
                if certain:
                    sure.add(row["doc_id"])
    got = {r["doc_id"] for r in QUERIES["op9_decontamination"](spark, PATH).collect()}
    assert sure and got <= sure and len(got) >= 0.9 * len(sure)


def test_passages_in_pieces_agree(monkeypatch):
    import numpy as np
    monkeypatch.setattr(decontamination, "MANY", 3)
    rng = np.random.default_rng(2)
    words = np.concatenate([rng.integers(-1, 12, n) for n in (0, 100, 1, 0, 37, 24, 25, 0)])
    bounds = np.cumsum([0, 0, 100, 1, 0, 37, 24, 25, 0])
    items = decontamination.Items([5, 6], [np.array([1, 2, 3, 4, 5, 6]), np.array([7, 8, 9, 10])], [np.array([1]), np.array([7])], np.arange(12))
    bound = decontamination.Bound.of(items, np.append(np.ones(12), 0.0))
    pairs = lambda: [(int(r[p]), int(s[p]), int(k)) for r, s, pp, kk in bound.near(words, bounds) for p, k in zip(pp, kk)]
    small = pairs()
    monkeypatch.setattr(decontamination, "MANY", 10_000)
    assert small == pairs() and len(small) == len(set(small)) > 0


def test_op9_finds_every_exact_holder(spark):
    bench = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    docs = {r["doc_id"]: " ".join(r["text"].split()) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()}
    got = {r["doc_id"] for r in QUERIES["op9_decontamination"](spark, PATH).collect()}
    assert {d for d, t in docs.items() if any(b in t for b in bench)} <= got


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "12 34"), (10**6 + 3, "again and again the same"), (10**6 + 4, "Again and again the same")],
                                "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "cast(length(text) as long) n_chars")
    now, counts = docs.unionByName(odd), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, PATH)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        counts.append((now.count(), {r[0] for r in now.select("doc_id").distinct().collect()}))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "decontamination", "packing"]
    assert counts[0][0] == docs.count() + 2 and not {10**6, 10**6 + 1, 10**6 + 2} & counts[0][1]
    assert {10**6 + 3} == counts[1][1] & {10**6 + 3, 10**6 + 4}
    assert all(b[1] <= a[1] for a, b in zip(counts, counts[1:])) and counts[3][1] == counts[4][1]


def test_pipeline_query_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, PATH)
    assert got.columns[:3] == ["doc_id", "piece", "start"] and got.count() > 200
    room = got.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in room) <= 1024


def test_short_items_with_words_changed_are_found_at_every_offset(spark):
    rng = random.Random(11)
    items = [sentences(rng, n) for n in (15, 18, 21, 25)]
    texts = {}
    for i, item in enumerate(items):
        for offset in range(0, 24, 3):
            # four of five words kept, among words of no item
            held = [w if k % 5 != 2 else f"other{k}" for k, w in enumerate(item)]
            texts[100 * i + offset] = " ".join([*(f"x{rng.randrange(10**6)}" for _ in range(48 + offset)), *held, *(f"x{rng.randrange(10**6)}" for _ in range(60))])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {r["doc_id"]: r["item_id"] for r in decontamination.contaminated(docs, bench).collect()} == {d: d // 100 for d in texts}
