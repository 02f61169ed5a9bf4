"""Token ids of whole texts with a public byte-level BPE vocabulary.

The vocabulary's splitter always starts a new piece at a space that follows a character
other than a space and stands before a character that is no white space, and between an
ASCII letter and a sentence mark.  A text may be cut there, so every different piece of a
batch is encoded once; the pieces seen last are kept in the Python worker, a bounded
number of them.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import text_bytes, word_hashes

#: Pieces kept at most in each of two generations.
KEPT = 400_000
#: First bytes of characters that are surely no white space.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xF5] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One span for each different content, and for every span the place of its content among them.

    Spans are grouped by hash and every span is compared byte by byte with the one that
    stands for it; where that fails, contents are told apart by themselves.
    """
    _, first, which = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lengths = ends - starts
    stand = starts[first][which]
    if (lengths[first][which] == lengths).all() and np.array_equal(data[starts[0]:ends[-1]], data[np.repeat(stand - starts, lengths) + np.arange(starts[0], ends[-1])]):
        return first, which
    seen: dict[bytes, int] = {}
    raw, named = data.tobytes(), []
    for a, b in zip(starts.tolist(), ends.tolist()):
        named.append(seen.setdefault(raw[a:b], len(seen)))
    which = np.array(named)
    return np.unique(which, return_index=True)[1], which


class Encoder:
    """``tokenizers`` with a bounded memory of encoded pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.symbols = _byte_symbols()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def piece(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if _WORD.fullmatch(text):  # one word of the splitter: no need to split it again
            return array("I", [t.id for t in self.model.tokenize(raw.decode("latin-1").translate(self.symbols))]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined, and n+1 offsets; null is empty.  ``end`` is appended to every text."""
        data, offsets = text_bytes(texts)
        if not len(data):
            return self._with_end(np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), end)
        cut = np.zeros(len(data), bool)
        cut[1:-1] = (data[1:-1] == 32) & (data[:-2] != 32) & _SOLID[data[2:]]
        cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        filled = offsets[:-1][np.diff(offsets) > 0]
        cut[filled] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        first, which = distinct_spans(data, starts, ends)
        codes = self._codes(data.tobytes(), starts[first].tolist(), ends[first].tolist())
        flat = np.frombuffer(b"".join(codes), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(c) >> 2 for c in codes])])
        sizes = np.diff(bounds)[which]
        at = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(bounds[:-1][which] - at[:-1], sizes) + np.arange(at[-1])]
        return self._with_end(ids, at[np.searchsorted(starts, offsets)], end)

    def _codes(self, data: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        known, older, out = self.known, self.older, []
        for a, b in zip(starts, ends):
            raw = data[a:b]
            code = known.get(raw)
            if code is None:
                code = older.get(raw)
                known[raw] = code = self.piece(raw) if code is None else code
            out.append(code)
        return out

    @staticmethod
    def _with_end(ids: np.ndarray, offsets: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if end is None:
            return ids, offsets
        return np.insert(ids, offsets[1:], end).astype(np.uint32), offsets + np.arange(len(offsets))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
