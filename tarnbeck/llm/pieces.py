"""Encoding by pieces: a batch's texts are cut at bytes where no token can reach across, and each distinct piece is encoded once.

The cuts are found on the batch's own text buffer, so no string is made for a piece that occurs again: Arrow numbers the distinct
pieces, a bounded cache remembers the ids of those that were met before, and the ids of all texts are gathered by those numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker's cache holds at most (about 200 bytes each), and the longest that it takes, in bytes.
CACHED, LONGEST = 400_000, 64


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, one after the other, and where each starts (and the last one ends); null is empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, pa.scalar(b"").cast(texts.type))
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
    return own, at - at[0]


def gathered(lists: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``lists[k]`` for each k of ``order``, one after the other; and how many stand before each."""
    return buffer_of(pa.array(lists, pa.large_binary()).take(pa.array(order)))


class Cache(dict):
    """Ids of pieces as little-endian unsigned 32-bit integers; ``encode`` gives those of pieces not met before."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]]):
        self.encode = encode

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """Of distinct pieces."""
        out = list(map(self.get, pieces))
        at = [k for k, x in enumerate(out) if x is None]
        room = CACHED - len(self)
        for k, x in zip(at, self.encode([pieces[k] for k in at]), strict=True):
            out[k] = x
            if room > 0 and len(pieces[k]) <= LONGEST:
                self[pieces[k]] = x
                room -= 1
        return out


def as_bytes(column: pa.Array) -> list[bytes]:
    """An Arrow array's values, without the detour over one Arrow scalar each."""
    data, at = buffer_of(column)
    blob, ends = data.tobytes(), at.tolist()
    return [blob[a:z] for a, z in zip(ends, ends[1:], strict=False)]


def encoded(data: np.ndarray, starts: np.ndarray, cut: np.ndarray, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a buffer, one after the other, and where each text's ids start (and the last one's end). ``cut``
    marks bytes before which a text may be cut; texts themselves are always apart."""
    cut[starts[:-1][starts[:-1] < len(data)]] = True
    at = np.append(np.flatnonzero(cut), len(data)).astype(np.int64)
    if len(data) < 1 << 31:
        kind, offsets = pa.binary(), at.astype(np.int32)
    else:
        kind, offsets = pa.large_binary(), at
    pieces = pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    ids, ends = gathered(cache.ids(as_bytes(pieces.dictionary)), pieces.indices.to_numpy())
    return ids.view("<u4"), ends[np.searchsorted(at, starts)] // 4
