"""Byte-level BPE through the tokenizers library, by pieces.

The pre-tokeniser of a byte-level model never lets a token cross a single space or line end between two characters that are not
blank, nor run from a letter into a mark, so a text may be cut there and each distinct piece encoded once per worker by the
library's own pre-tokeniser and model. Where a space or line end meets another blank, or a character of which the bytes alone do
not tell whether it is one, the text is not cut. Models of another make are encoded whole.
"""

from __future__ import annotations

import json
import struct
from functools import cache

import numpy as np
import pyarrow as pa

from tarnbeck.llm.pieces import Cache, buffer_of, encoded

#: Below it, all versions of Unicode agree which characters are letters.
LATIN_END = "ɐ"
PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
# Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others for the characters from 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(PLAIN))}
# Kinds of bytes: ASCII letters, ASCII marks, and first bytes of two-byte characters none of which is a blank.
ASCII = [chr(b) for b in range(33, 127)]
LETTER = np.isin(np.arange(256), [ord(c) for c in ASCII if c.isalpha()])
MARK = np.isin(np.arange(256), [ord(c) for c in ASCII if not c.isalnum()])
LEAD = (np.arange(256) >= 0xC3) & (np.arange(256) <= 0xDF)
SOLID = np.isin(np.arange(256), list(map(ord, ASCII)))
TRAIL = (np.arange(256) >= 0x80) & (np.arange(256) <= 0xBF)


def pad(data: np.ndarray) -> np.ndarray:
    """The bytes with two before and one after, so that every byte has neighbours; none of them is a blank."""
    return np.concatenate((np.full(2, 33, np.uint8), data, np.full(1, 33, np.uint8)))


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Marks the bytes before which the pre-tokeniser always cuts."""
    cut, wide = np.zeros(len(data) + 1, bool), pad(data)

    def after_solid(at: np.ndarray) -> np.ndarray:
        one, two = wide[at + 1], wide[at]
        return SOLID[one] | TRAIL[one] & LEAD[two]

    for blank in (0x20, 0x0A):
        at = np.flatnonzero(data == blank)
        following = wide[at + 3]
        at = at[after_solid(at) & (SOLID[following] | LEAD[following])]
        cut[at] = True
        if blank == 0x0A:
            cut[at + 1] = True
    at = np.flatnonzero(MARK[data])
    one, two = wide[at + 1], wide[at]
    # the letters from U+00C0 to U+00FF, but for the signs of multiplication and division
    latin = (two == 0xC3) & TRAIL[one] & (one != 0x97) & (one != 0xB7)
    cut[at[LETTER[one] | latin]] = True
    return cut[:-1]


class Coder:
    """Encodes whole texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # special strings in a text are ordinary text
        self.model, self.splitter = self.tokenizer.model, self.tokenizer.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.cut = not made.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and made["model"]["type"] == "BPE" and not made["model"].get("dropout")
        if self.cut:
            self.model._resize_cache(0)  # each piece comes here once; the cache of pieces remembers it
        self.known = Cache(lambda pieces: list(map(self._piece, pieces)))

    def _word(self, mapped: str) -> bytes:
        ids = [x.id for x in self.model.tokenize(mapped)]
        return PACK[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        word = text.removeprefix(" ")
        if word.isalpha() and max(word) < LATIN_END:  # one word: what the pre-tokeniser would do to it is known
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(SHOWN)
            return self._word("Ġ" + shown if len(text) > len(word) else shown)
        return b"".join([self._word(mapped) for mapped, _ in self.splitter.pre_tokenize_str(text)])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids start (and the last one's end); null is empty."""
        if self.cut:
            data, starts = buffer_of(texts)
            return encoded(data, starts, safe_cuts(data), self.known)
        some = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.concatenate(some) if some else np.empty(0, np.uint32), np.concatenate(([0], np.cumsum(list(map(len, some))))).astype(np.int64)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        ids, at = self.encode_column(pa.array(texts, pa.large_string()))
        return np.split(ids, at[1:-1]) if texts else []


@cache
def coder(path: str) -> Coder:
    """One for each worker process and file."""
    return Coder(path)


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and starts of texts (of ``encode_column``) with ``end_id`` put after each text."""
    return np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(len(at))
