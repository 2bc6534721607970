"""Packing of token sequences by best fit decreasing.

A document's ids, then the end id, are cut into full windows first; what is left over goes, longest first, into the open
window with the least room that still takes it. A segment tree over the remaining capacities finds that window in
log2(size) steps. Every task packs the documents it reads, a few million tokens at a time, into windows that stay open
until the task ends: no shuffle, no group that grows with the data, and the room that is lost is that of each task's last
windows. A window's id is the task's number and a count, so a task that is run again gives the same ids.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm.bpe import coder, with_end
from tarnbeck.llm.common import bounded_batches, table

SIZE, END_ID = 2048, 1
#: Tokens of left-over pieces that a task gathers before it packs them.
GATHER = 1 << 22
#: Pieces that are passed on at a time.
PASSED = 512
#: Windows of one task at most.
PER_TASK = 1 << 40


class OpenWindows:
    """Windows by remaining capacity 1 .. size; ``tree`` counts them below each node of a segment tree."""

    def __init__(self, size: int):
        self.leaves = 1 << (size).bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, n: int) -> None:
        k = room + self.leaves
        while k:
            self.tree[k] += n
            k >>= 1

    def put(self, room: int, window: int) -> None:
        self.at[room].append(window)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window that has room for ``length``; it is no longer open."""
        k, tree = length + self.leaves, self.tree
        if not tree[k]:
            while k > 1 and (k & 1 or not tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if tree[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._add(room, -1)
        return room, self.at[room].pop()


class Packer:
    """Places pieces into windows of ``size`` tokens; ids of windows count from ``first``."""

    def __init__(self, size: int, first: int):
        self.size, self.next, self.open = size, first, OpenWindows(size)

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) for a piece."""
        found = self.open.take(length) if length < self.size else None
        if found is None:
            room, window = self.size, self.next
            self.next += 1
        else:
            room, window = found
        if room > length:
            self.open.put(room - length, window)
        return window, self.size - room


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id_col, start, length, doc_tokens, sequence_id, offset and ids, the piece's ids as
    little-endian unsigned 32-bit integers."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer = coder(tokenizer), Packer(size, TaskContext.get().partitionId() * PER_TASK)
        rest: list[tuple] = []
        held = 0

        def out(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            """The pieces with their places, a small batch at a time; they are taken out of the list."""
            pieces.reverse()  # equal lengths keep their order
            pieces.sort(key=lambda p: p[2])
            long = lambda x: pa.array(x, pa.int64())
            while pieces:
                some = pieces[-PASSED:][::-1]
                del pieces[-PASSED:]
                places = [packer.place(p[2]) for p in some]
                ids, start, length, total, data = (list(x) for x in zip(*some, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), long(start), long(length), long(total), long([w for w, _ in places]), long([o for _, o in places]), pa.array(data, pa.binary())], names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        kind = pa.int64()
        for b in batches:
            kind = b.column(0).type
            full: list[tuple] = []
            flat, at = with_end(*code.encode_column(b.column(1)), end_id)
            for doc, a, z in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                total = z - a
                whole = total - total % size
                for k in range(0, whole, size):
                    full.append((doc, k, size, total, flat[a + k : a + k + size].tobytes()))
                    if len(full) == 512:
                        yield from out(full)
                if whole < total:
                    rest.append((doc, whole, total - whole, total, flat[a + whole : z].tobytes()))
                    held += total - whole
            yield from out(full)
            if held >= GATHER:
                yield from out(rest)
                held = 0
        yield from out(rest)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return rows.withColumnRenamed("id", id_col)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def brute_fit(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """What Packer gives, by a plain search: for tests."""
    rooms: list[int] = []
    out = []
    for n in lengths:
        fits = [(r, w) for w, r in enumerate(rooms) if r >= n]
        best = min((r for r, _ in fits), default=None)
        w = max((w for r, w in fits if r == best), default=None) if best else None
        if w is None or n == size:
            rooms.append(size)
            w = len(rooms) - 1
        out.append((w, size - rooms[w]))
        rooms[w] -= n
    return out
