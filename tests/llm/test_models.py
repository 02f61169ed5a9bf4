import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import language, neighbours, quality
from colloquy.llm.queries import QUERIES

PATH = "/root/testdata/sf0.01"


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = language.Network.start(["a", "b", "c"])
    for name in ("inputs", "recurrent", "bias"):
        setattr(net, name, [rng.standard_normal(w.shape) * 0.3 for w in getattr(net, name)])
    net.out = net.out.astype(float)
    x, label = rng.integers(0, 5, (6, 4)).astype(np.uint8), np.array([0, 1, 2, 0])
    loss = lambda: -np.log(net.probabilities(x)[:, label, np.arange(4)]).mean()
    for w, g in zip(net.weights(), net.gradients(x, label, np.ones((6, 4), np.float32))):
        at = tuple(rng.integers(0, min(s, 5)) for s in w.shape)
        kept = w[at]
        w[at] = kept + 1e-2
        up = loss()
        w[at] = kept - 1e-2
        down = loss()
        w[at] = kept
        assert abs((up - down) / 2e-2 - g[at]) < 1e-3


def test_pooling_covers_every_byte():
    net = language.Network.start(["a", "b"])
    texts = [b"", b"x", b"y" * 64, b"z" * 65, b"w" * 1000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = language.pooled(net, data, offsets)
    assert np.allclose(got.sum(1), [0, 1, 1, 1, 1], atol=1e-5)
    assert np.allclose(language.pooled(net, np.frombuffer(texts[3], np.uint8), np.array([0, 65])), got[3], atol=1e-6)


def test_op8_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    got = QUERIES["op8_language_id"](spark, PATH).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_language_edge_cases(spark, documents):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").limit(120)
    odd = documents(None, "", " 12 !? ", "the", ids=[10**6, 10**6 + 1, None, 10**6 + 3]).withColumn("n_chars", F.lit(0).cast("long"))
    got = {r["doc_id"]: r for r in language.identify(docs.unionByName(odd)).collect()}
    assert [got[i]["lang_pred"] for i in (10**6, 10**6 + 1, None)] == ["und"] * 3 and got[None]["held_out"]
    assert got[10**6 + 3]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0
    kept = language.in_a_language(docs.unionByName(odd))
    assert kept.columns == docs.columns and not {10**6, 10**6 + 1, None} & {r["doc_id"] for r in kept.collect()} and kept.count() >= 119


def test_op10_held_out_ranking(spark):
    labels = spark.read.parquet(f"{PATH}/labels.parquet")
    every = QUERIES["op10_quality"](spark, PATH).collect()
    assert len(every) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in every)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in every)
    score = {r["doc_id"]: r["score"] for r in every if r["held_out"]}
    good, bad = ([score[r["doc_id"]] for r in labels.where(F.col("quality") == q).collect() if r["doc_id"] in score] for q in (1, 0))
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.97


def test_quality_edge_cases(spark, documents):
    docs = documents(None, "", "fine words here", "fine words here", "### $$$", ids=[1, 2, 3, None, 5])
    labels = spark.createDataFrame([(1, 0, 9), (3, 1, 9), (3, None, 9), (5, 0, 9)], "doc_id long, quality int, text int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score_quality(docs, labels.limit(0)).collect()
    assert all(abs(r["score"] - 0.5) < 0.02 for r in none)
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_isotonic_is_the_nearest_rising_line():
    assert np.allclose(quality.isotonic(np.array([1, 3, 2, 4, 0.0]), np.ones(5)), [1, 2.25, 2.25, 2.25, 2.25])


def test_chi_square():
    assert abs(neighbours.chi_square(neighbours.stop_ratio()) - (1 - neighbours.MISS)) < 1e-6
    assert abs(neighbours.chi_square(7.344) - 0.5) < 1e-3


def brute_nearest(rows, k):
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for q, v in rows:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in rows if i != q)
            out[q] = near[:k]
    return out


def test_op2_recall(spark):
    table = spark.read.parquet(f"{PATH}/embeddings.parquet").collect()
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in table], 10)
    got = {}
    for r in QUERIES["op2_nearest_neighbours"](spark, PATH).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == set(want)
    hits = sum(len({r["vec_id"] for r in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, rows in got.items():
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and [(r["score"], r["vec_id"]) for r in rows] == sorted((r["score"], r["vec_id"]) for r in rows)


def test_neighbour_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (100, [0.0, 2.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [math.nan, 1.0]), (7, [None, 1.0]),
            (8, [math.inf, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0])]
    table = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in neighbours.nearest(table, F.col("vec_id") % 100 == 0, 3).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got if r[0] == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 2)]
    assert [r[1:3] for r in got if r[0] == 100] == [(1, 0), (2, 1), (3, 2)] and abs(got[-1][3] - 5 ** 0.5) < 1e-15
    assert neighbours.nearest(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_equal_vectors_go_by_vec_id():
    rng = np.random.default_rng(7)
    ids = rng.permutation(400)
    vectors = np.vstack([np.tile(rng.standard_normal(16), (200, 1)), rng.standard_normal((200, 16))])
    for q in (0, 57, 199):
        got = sorted(v for _, v, _ in neighbours.search(ids, vectors, ids[q:q + 1], vectors[q:q + 1], 10))
        assert got == sorted(set(ids[:200].tolist()) - {int(ids[q])})[:10]
