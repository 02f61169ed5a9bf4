import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from colloquy.llm import packing, tokens
from colloquy.llm.queries import QUERIES
from colloquy.llm.token_store import Codes, Shard, token_store, write_store
from colloquy.llm.common import shared_path
from colloquy.llm.tokens import Encoder, vocabulary

PATH = "/root/testdata/sf0.001"
TEXTS = [None, "", "  \n ", "plain text, twice. plain text, twice.", "é中😀 <|endoftext|> x", "word " * 3000, "plain text, twice. plain text, twice."]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer
    made = Tokenizer.from_file(vocabulary())
    return lambda text: np.array([*made.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list(" \n\t\rabcÉé'st.!1 ́　​日<|")), max_size=30)), max_size=4))
def test_encoder_equals_plain_tokenizer(encode, texts):
    ids, bounds = Encoder(vocabulary()).encode(pa.array(texts, pa.string()), 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [encode(t).tolist() for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=2000), st.integers(0, 2000), st.integers(0, 2000))
def test_codes_give_any_range(ids, a, b):
    codes = Codes(Codes.encode(np.array(ids, np.uint32)))
    assert codes.n == len(ids)
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert codes.ids(a, b).tolist() == ids[a:b]
    if a < len(ids):
        assert codes[a] == ids[a]


def expected_store(rows, encode):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or "")):
        ids = encode(text)
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("ids", [list(range(7)), [5, None, 3, 3, -1, None, 9]])
def test_store_edge_cases(documents, encode, ids):
    got = [tuple(r) for r in token_store(documents(*TEXTS, ids=ids).sparkSession, documents(*TEXTS, ids=ids)).collect()]
    want = expected_store(list(zip(ids, TEXTS)), encode)
    assert sorted(got, key=lambda r: r[1]) == want


def test_store_files_hold_every_token(spark, documents, encode):
    shards = write_store(documents(*TEXTS), shared_path(spark, "tokens"), vocabulary()).collect()
    found = np.concatenate([Shard(r["file"]).ids(0, r["tokens"]) for r in sorted(shards, key=lambda r: r["shard"])])
    assert found.tolist() == np.concatenate([encode(t) for t in TEXTS]).tolist()


def test_empty_tables(spark, documents):
    empty = documents("x").limit(0)
    assert token_store(spark, empty).count() == 0
    assert packing.pack(empty).count() == 0


def test_op1_against_brute_force(spark, encode):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op1_token_store"](spark, PATH).collect())) == sorted(expected_store(rows, encode))


def check_packing(rows, got, encode, capacity):
    cut = Counter()
    for doc_id, text in rows:
        ids = encode(text)
        first = len(ids) - (-(-len(ids) // capacity) - 1) * capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            cut[doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == cut
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_packing_edge_cases(documents, encode):
    ids = [5, None, 3, 3, -1, None, 9]
    check_packing(list(zip(ids, TEXTS)), packing.pack(documents(*TEXTS, ids=ids), capacity=128).collect(), encode, 128)


def test_op4_against_brute_force(spark, encode):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    got = QUERIES["op4_packing"](spark, PATH).collect()
    used = check_packing(rows, got, encode, 1024)
    least = -(-sum(r["length"] for r in got) // 1024)
    assert used <= 1.06 * least + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plan_holds_every_piece(counts):
    held = Counter()
    for times, pieces in packing.plan(counts, 64, groups=4):
        assert sum(length * n for length, n in pieces) <= 64
        for length, n in pieces:
            held[length] += times * n
    assert held == Counter(counts)


def doubled(length=1024):
    """Two different texts of two letters whose hashes by powers of an odd base modulo 2**64 are equal."""
    s = "a"
    while len(s) < length:
        s += s.translate({97: 98, 98: 97})
    return s, s.translate({97: 98, 98: 97})


def test_texts_built_to_collide(encode):
    texts = [*doubled(), "plain", " ".join(doubled()), doubled()[0]]
    ids, bounds = Encoder(vocabulary()).encode(pa.array(texts, pa.string()), 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [encode(t).tolist() for t in texts]


def test_equal_hashes_of_different_pieces(encode, monkeypatch):
    monkeypatch.setattr(tokens, "word_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % 3)
    texts = ["plain text, twice. plain text, twice.", "other words here", None, "x"]
    ids, bounds = Encoder(vocabulary()).encode(pa.array(texts, pa.string()), 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [encode(t).tolist() for t in texts]
