import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from colloquy.llm import passages
from colloquy.llm.components import components
from colloquy.llm.jaccard_join import one_of_each, similar_classes
from colloquy.llm.queries import QUERIES
from colloquy.llm.suffix_dedup import SuffixIndex, remove_repeats, suffixes

PATH = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, width):
    w = words_of(text)
    return frozenset(tuple(w[i:i + width]) for i in range(max(len(w) - width + 1, 1))) if w else frozenset()


def classes(rows, width, num, den):
    sets = [(d, shingles(t, width)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            inter = len(a & b)
            if a and b and den * inter >= num * (len(a) + len(b) - inter):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))


def noisy(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def near_copies(seed=3, base=8, copies=12):
    rng = random.Random(seed)
    texts = [None, "", " \n", "one", "one", "One two", "a b c d", "A b c d e"]
    passage = [f"p{i}" for i in range(60)]
    for k in range(base):
        words = [f"w{k}x{rng.randrange(400)}" for _ in range(rng.randrange(30, 300))]
        texts += [noisy(rng, words, rng.randrange(0, max(2, len(words) // 25))) for _ in range(copies)]
        texts.append(" ".join([*words[:40], *passage, *[f"r{k}{i}" for i in range(60)]]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("width,num", [(4, 85), (5, 80)])
def test_classes_equal_brute_force(documents, width, num):
    texts = near_copies()
    ids = [i * 3 for i in range(len(texts))]
    ids[4], ids[9] = None, None
    got = similar_classes(documents(*texts, ids=ids), width, num, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == classes(list(zip(ids, texts)), width, num, 100)


def test_words_built_to_collide(documents):
    a = "a"
    while len(a) < 1024:
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    got = similar_classes(documents(a, b, a), 4, 85, 100).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 1), (2, 0)]


def test_op3_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op3_jaccard_join"](spark, PATH).collect())) == classes(rows, 4, 85, 100)


def test_one_of_each(documents):
    docs = documents("a b c d e f g", "A b c d e f g", "a b c d e f g", None, "", "z y x", "z y x", ids=[4, 2, 2, 1, 1, None, None])
    got = one_of_each(docs)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) in (
        Counter([(2, "A b c d e f g"), (1, None), (1, ""), (None, "z y x")]), Counter([(2, "a b c d e f g"), (1, None), (1, ""), (None, "z y x")]))
    assert one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (None, 3)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 200, 300)}


def removed(rows, length):
    seen = Counter(t[i:i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = Counter()
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return out


def byte_texts(seed=1):
    rng = random.Random(seed)
    new = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, texts = [new(n) for n in (20, 35, 41, 60, 150)], [None, "", "short", "a" * 300, "ab" * 200, "a" * 100]
    for _ in range(60):
        texts.append("".join(rng.choice([new(rng.randrange(60)), rng.choice(shared), rng.choice(shared)[:rng.randrange(10, 60)]]) for _ in range(5)))
    return texts + texts[6:9] + [texts[10] + texts[11], texts[12] * 2]


@pytest.mark.parametrize("length,batches", [(40, 1), (40, 5), (41, 2), (33, 2)])
def test_removal_equals_brute_force(documents, length, batches):
    texts = byte_texts()
    ids = [*range(len(texts) - 2), None, None]
    got = remove_repeats(documents(*texts, ids=ids), length, batches).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == removed([(d, (t or "").encode()) for d, t in zip(ids, texts)], length)


def test_op7_equals_brute_force(spark):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op7_suffix_dedup"](spark, PATH).collect())) == removed(rows, 200)


def test_removal_of_empty_table(documents):
    assert remove_repeats(documents("x").limit(0)).count() == 0


def test_levels_merge_geometrically(spark, documents):
    from pyspark.sql import functions as F

    from colloquy.llm.common import ship
    ship(spark)
    texts = documents(*byte_texts()).where("text is not null").withColumn("text_key", F.col("doc_id"))
    index = SuffixIndex()
    for i in range(6):
        index.add(suffixes(texts.where(F.col("doc_id") % 6 == i), 40))
    assert [rank for rank, _ in index.levels] == [2, 0, 0]


def test_compact_windows_are_those_of_every_subsequence():
    rng = np.random.default_rng(2)
    for width in (1, 3, 6):
        sizes = rng.integers(0, 25, 6)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        values = rng.permutation(int(bounds[-1])).astype(np.uint64) << np.uint64(40)
        row, left, c, right = passages.compact_windows(values, bounds, width)
        found = {(int(a), int(b)): int(m) for a0, b0, m in zip(left, right, c) for a in range(a0, m + 1) for b in range(m, b0 + 1) if b - a + 1 >= width}
        want = {(a, b): a + int(values[a:b + 1].argmin()) for i in range(len(sizes)) for a in range(bounds[i], bounds[i + 1]) for b in range(a + width - 1, bounds[i + 1])}
        assert found == want


def repeat_texts(seed=5):
    rng = random.Random(seed)
    new = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    passage, other = new(70), new(55)
    texts = [" ".join([*new(rng.randrange(5, 90)), *passage, *new(30)]) for _ in range(20)]
    near = list(other)
    near[27] = "changed"
    texts += [" ".join([*new(40), *other, *new(40)]), " ".join([*new(10), *near, *new(200)])]
    clean = [" ".join(new(150)) for _ in range(10)]
    return texts, clean, passage


def test_passages_are_found_and_clean_texts_left(documents):
    texts, clean, passage = repeat_texts()
    docs = documents(*texts, *clean, None, "", "few words", clean[0])
    got = passages.repeated_passages(docs).collect()
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["last_word"] + 1))
    for i in range(1, 20):
        start = texts[i].split().index(passage[0])
        assert set(range(start, start + 70)) <= found[i] and len(found[i]) < 90
    assert 21 in found and not any(i in found for i in (0, 20, *range(22, 32)))
    assert found[35] == set(range(150))  # a copy of a clean text
    assert {r["source_doc_id"] for r in got if r["doc_id"] in range(1, 20)} == {0}


def test_passages_are_cut(documents):
    texts, clean, passage = repeat_texts()
    docs = documents(*texts, *clean, None, "", clean[0])
    got = {r["doc_id"]: r["text"] for r in passages.without_repeats(docs).collect()}
    assert sum(passage[30] in (t or "").split() for t in got.values()) == 1 and passage[30] in got[0]
    assert [got[i] for i in range(22, 34)] == [*clean, None, ""] and words_of(got[34]) == []
    assert all(w in got[i].split() for i in range(1, 20) for w in texts[i].split()[:3] if w not in passage)
    assert passages.without_repeats(docs.limit(0)).count() == 0 and passages.without_repeats(docs).columns == docs.columns


def test_similar_places_of_many_pairs_are_those_of_each():
    rng = np.random.default_rng(3)
    xs, ps = [], []
    for _ in range(60):
        p = rng.integers(0, 60 if rng.random() < 0.3 else 10**6, rng.integers(0, 160)).astype("<u4")
        x = np.concatenate([rng.integers(10**6, 10**7, rng.integers(0, 40)), p[rng.integers(0, 30):], rng.integers(10**6, 10**7, rng.integers(0, 9))]).astype("<u4")
        x[rng.random(len(x)) < 0.03] = 5
        xs.append(x)
        ps.append(p)
    covered, starts = passages.similar_places_of(xs, ps, 46, 0.8)
    assert covered.any() and all(covered[a:a + len(x)].tolist() == passages.similar_places(x, p, 46, 0.8).tolist() for a, x, p in zip(starts, xs, ps))
    assert len(covered) == sum(len(x) + 1 for x in xs) and not covered[starts + [len(x) for x in xs]].any()


def test_a_span_inside_one_of_an_earlier_source_is_left_out(spark):
    spans = spark.createDataFrame([(1, 0, 5, 70), (1, 3, 5, 60), (1, 3, 8, 71), (2, 3, 5, 60), (1, 4, 8, 71)], "text_key long, p long, first long, last long")
    assert sorted(map(tuple, passages._first_sources(spans).collect())) == [(1, 0, 5, 70), (1, 3, 8, 71), (2, 3, 5, 60)]


def test_similar_places():
    p = np.arange(100, dtype="<u4")
    x = np.concatenate([np.arange(1000, 1020), np.arange(20, 80), np.arange(2000, 2030)]).astype("<u4")
    assert set(range(20, 80)) <= set(np.flatnonzero(passages.similar_places(x, p, 46, 0.8)))
    assert not passages.similar_places(x[:60], p, 46, 0.8).any()


def partial_holders(seed=8, groups=40):
    """Documents that hold the first 40 words of a passage of 55, then two that hold it whole."""
    rng = random.Random(seed)
    new = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    parts, first, second, places = [], [], [], []
    for _ in range(groups):
        passage = new(55)
        parts.append(" ".join([*new(60), *passage[:40], *new(60)]))
        first.append(" ".join([*new(30), *passage, *new(30)]))
        places.append(rng.randrange(20, 70))
        second.append(" ".join([*new(places[-1]), *passage, *new(30)]))
    return parts, first, second, places


def test_verbatim_passages_behind_a_partial_holder(documents):
    parts, first, second, places = partial_holders()
    n, found = len(parts), {}
    for r in passages.repeated_passages(documents(*parts, *first, *second)).collect():
        found.setdefault((r["doc_id"], r["source_doc_id"]), set()).update(range(r["first_word"], r["last_word"] + 1))
    for i, at in enumerate(places):
        assert set(range(at, at + 55)) <= found.get((2 * n + i, n + i), set())
    assert not any(d < 2 * n for d, _ in found)


def test_similar_places_with_shingles_that_stand_twice():
    rng = np.random.default_rng(6)
    for gap in (0, 20, 40):
        passage = rng.integers(0, 2**32, 46, np.uint32)
        p = np.concatenate([passage[20:21], rng.integers(0, 2**32, gap, np.uint32), passage, rng.integers(0, 2**32, 30, np.uint32)])
        x = np.concatenate([rng.integers(0, 2**32, 40, np.uint32), passage, rng.integers(0, 2**32, 40, np.uint32)])
        assert passages.similar_places(x, p, 46, 0.8)[40:86].all()
    run = np.tile(rng.integers(0, 2**32, 10, np.uint32), 12)
    assert not passages.similar_places(run, run, 46, 0.8).any()


def test_best_stretches_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        width, least = 12, 0.7
        x = rng.integers(0, 40, 30).astype("<u4")
        p = np.concatenate([rng.integers(0, 40, rng.integers(1, 12)), np.delete(x, rng.integers(0, 30, 2)), rng.integers(0, 40, 5)])[:rng.integers(8, 45)].astype("<u4")
        starts = np.arange(len(x) - width + 1)
        sets = [set(p[b:b + w]) for w in range(min(width, len(p)), min(int(width / least), len(p)) + 1) for b in range(len(p) - w + 1)]
        want = [any(len(a & b) >= least * len(a | b) for b in sets) and 2 * len(a) >= width for a in (set(x[s:s + width]) for s in starts)]
        assert passages._best_stretches(x, p, starts, width, least).tolist() == want


def test_the_last_batch_meets_a_merged_level(documents, monkeypatch):
    ranks, add = [], SuffixIndex.add

    def told(self, batch):
        out = add(self, batch)
        ranks.append([rank for rank, _ in self.levels])
        return out

    monkeypatch.setattr(SuffixIndex, "add", told)
    same = "".join(chr(97 + i * i % 23) for i in range(230))
    got = remove_repeats(documents(*(f"{i}" * 7 + same + f"{i}" * 9 for i in range(12)))).select("n_bytes", "n_removed").collect()
    assert ranks == [[0], [0, 0], [1, 0]] and all(r.n_removed >= 230 for r in got)


def test_matches_of_other_places_of_the_pivot_are_verified():
    def rows(c, pc):
        return [(k, 7, c - 45, c, c + 45, pc - 45, pc, pc + 45) for k in range(2)]

    found = np.array(sorted(rows(100, 100) + rows(110, 900) + rows(105, 106) + rows(139, 139), key=lambda r: (r[1], r[3])))
    taken = {(int(found[i, 3]), int(found[i, 6])) for i in passages.agreed(found, 46)}
    assert taken == {(100, 100), (110, 900), (139, 139)}  # 105 is covered by the texts around 100
    crowd = np.array([(0, 7, 55, 100, 145, 55, 100, 145)] + [(0, 7, 100 + i, 100 + i, 101 + i, 0, 0, 1) for i in range(1, 30)] + [(1, 7, 60, 131, 150, 60, 131, 150)])
    assert 0 in passages.agreed(crowd, 46)


def similar_words(rows, passage, least):
    """Words of every text that lie between the first and last shared shingle of a stretch similar to one of an earlier text, by comparing all stretches."""
    width, kept = passage - 4, {}
    sets = {d: shingles_of(t) for d, t in rows}
    for d, x in sets.items():
        kept[d] = set()
        for s in range(len(x) - width + 1):
            a = set(x[s:s + width])
            for e, p in sets.items():
                if e >= d or 2 * len(a) < width:
                    continue
                for w in range(width, min(int(width / least), len(p)) + 1):
                    for b in (set(p[k:k + w]) for k in range(len(p) - w + 1)):
                        if len(a & b) >= least * len(a | b):
                            held = [i for i in range(s, s + width) if x[i] in b]
                            kept[d].update(range(held[0], held[-1] + 5))
    return kept


def shingles_of(text):
    w = words_of(text)
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]


def mixed_texts(seed, n=26):
    """Short texts of shared passages, changed here and there, and of words that come again."""
    rng = random.Random(seed)
    new = lambda k: [f"v{rng.randrange(10**6)}" for _ in range(k)]
    shared, texts = [new(22), new(30), [*new(3), *(["again", "and"] * 6), *new(8)]], []
    for _ in range(n):
        words = new(rng.randrange(6))
        for part in rng.sample(shared, rng.randrange(1, 3)):
            part = list(part)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                part[rng.randrange(len(part))] = rng.choice(["x", "y", f"c{rng.randrange(99)}"])
            words += part[rng.randrange(4):] + new(rng.randrange(5))
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_no_similar_passage_is_lost(documents, seed):
    texts = mixed_texts(seed)
    found = {}
    for r in passages.repeated_passages(documents(*texts), passage=20, least=0.8).collect():
        found.setdefault(r["doc_id"], set()).update(range(r["first_word"], r["last_word"] + 1))
    want = similar_words(list(enumerate(texts)), 20, 0.8)
    assert sum(map(len, want.values())) > 200
    assert {d: sorted(w - found.get(d, set())) for d, w in want.items() if w - found.get(d, set())} == {}


def near_partial_holders(seed=9, groups=30):
    """As :func:`partial_holders`, but the later copy of each passage has a word changed."""
    parts, first, second, places = partial_holders(seed, groups)
    for i, at in enumerate(places):
        words = second[i].split()
        words[at + 28] = "changed"
        second[i] = " ".join(words)
    return parts, first, second, places


def test_near_copies_behind_a_partial_holder(documents):
    parts, first, second, places = near_partial_holders()
    n, found = len(parts), {}
    for r in passages.repeated_passages(documents(*parts, *first, *second)).collect():
        found.setdefault((r["doc_id"], r["source_doc_id"]), set()).update(range(r["first_word"], r["last_word"] + 1))
    for i, at in enumerate(places):
        assert set(range(at, at + 55)) <= found.get((2 * n + i, n + i), set())
    assert not any(d < 2 * n for d, _ in found)


def test_different_shingles_of_every_stretch():
    rng = np.random.default_rng(7)
    sizes = [0, 30, 3, 25, 1]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    values = rng.integers(0, 12, bounds[-1]).astype(np.uint64)
    count = np.where(values % 3 == 0, 0, 2 + values).astype(np.int64)
    held = passages._Held(values, bounds, count, passages._apart(values, bounds, 12))
    for w in (1, 5, 11):
        different, shared = held.sets(w)
        for s in range(bounds[-1] - w + 1):
            one = held.row[s] == held.row[s + w - 1]
            own = set(values[s:s + w].tolist())
            assert (different[s], shared[s]) == ((len(own), len([v for v in own if v % 3])) if one else (0, 0))


def test_near_copies_behind_a_partial_holder_are_cut(documents):
    parts, first, second, places = near_partial_holders(12, 12)
    n, got = len(parts), {r["doc_id"]: r["text"].split() for r in passages.without_repeats(documents(*parts, *first, *second)).collect()}
    for i, at in enumerate(places):
        words = second[i].split()
        assert got[2 * n + i] == words[:at] + words[at + 55:] and got[n + i] == first[i].split()
