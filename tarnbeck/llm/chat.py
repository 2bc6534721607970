"""Chat formatting on the level of tokens.

Every text is encoded by itself and spliced between reserved ids above the vocabulary, so no text can forge a turn. Control
strings that occur in a text (those of this template and of common others) get a backslash after their first character,
more backslashes where some stand there already; taking one away restores the text. The loss mask of a conversation is
the prefix sum of +1 where an assistant's text starts and -1 where it ends.

A turn is [TURN][role][text][END]; a role without an id of its own is [OTHER][its text][SAID]. One shuffle deals the turns out
by ranges of (conversation, turn), sorted, and each task encodes and assembles what it streams through, so a conversation
that holds a large share of all turns is spread over many tasks. A conversation comes out in pieces of at most PIECE turns,
numbered in its order: its length is not bounded by memory. Only reading digests back follows a conversation from its first
turn to its last, for a SHA-256 has to; that step streams through the pieces and holds one of them at a time.

Defined results: a null role or text is empty; turns stand by number, nulls first, then by role and text, and repeated
rows are turns of their own; a null conversation id is one conversation; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm.bpe import PLAIN, SHOWN, coder
from tarnbeck.llm.common import bounded_batches, stored, table

PIECE = 64
#: Pieces of one task at most.
PER_TASK = 1 << 40
# The template's reserved ids, counted from the vocabulary's size, and how they are shown.
RESERVED = ["<|turn|>", "<|end|>", "<|other|>", "<|said|>", "<|system|>", "<|user|>", "<|assistant|>"]
TURN, END, OTHER, SAID, SYSTEM, USER, ASSISTANT = range(7)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
# Control strings of this and other templates, less their first character.
CONTROL = r"(/s>|s>|<SYS>>|</SYS>>|/?INST\]|\|\w{1,40}\|>|(?:start|end)_of_turn>)"
TO_ESCAPE, ESCAPED = re.compile(r"([<\[])(\\*)" + CONTROL), re.compile(r"([<\[])\\(\\*)" + CONTROL)


def escape(text: str) -> str:
    return TO_ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def base_id(tokenizer: str) -> int:
    """The first reserved id: the vocabulary's size, special tokens included."""
    return coder(tokenizer).tokenizer.get_vocab_size()


@cache
def token_bytes(tokenizer: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    of = {chr(b): b for b in PLAIN} | {chr(c): b for b, c in SHOWN.items()}
    vocab = coder(tokenizer).tokenizer.get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
    return out


def turn_ids(role: np.ndarray, text: np.ndarray, role_text: str, first: int) -> tuple[np.ndarray, int, int]:
    """A turn's ids, and where its text starts and ends."""
    kind = ROLES.get(role_text)
    said = [kind + first] if kind is not None else [OTHER + first, *role.tolist(), SAID + first]
    head = np.array([TURN + first, *said], np.uint32)
    return np.concatenate([head, text, np.array([END + first], np.uint32)]), len(head), len(head) + len(text)


def formatted(turns: DataFrame, tokenizer: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, piece, n_turns, ids, mask): ids as little-endian unsigned 32-bit integers, mask one byte a token."""
    bounded_batches(turns.sparkSession)
    kind_of_id = turns.schema[id_col].dataType.simpleString()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first = coder(tokenizer), base_id(tokenizer)
        now, held = None, []
        piece = TaskContext.get().partitionId() * PER_TASK

        def out() -> pa.RecordBatch:
            nonlocal piece
            ids = np.concatenate([x for x, _, _, _ in held])
            edge, at = np.zeros(len(ids) + 1, np.int8), 0
            for x, a, z, learned in held:
                if learned:
                    edge[at + a] += 1
                    edge[at + z] -= 1
                at += len(x)
            mask = np.cumsum(edge[:-1], dtype=np.int8).astype(np.uint8)
            piece += 1
            return pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([piece], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary()), pa.array([mask.tobytes()], pa.binary())], names=["id", "piece", "n_turns", "ids", "mask"])

        kind = pa.int64()
        for b in batches:
            kind = b.column(0).type
            roles = [r or "" for r in b.column(2).to_pylist()]
            names = list(dict.fromkeys(roles))
            said = dict(zip(names, code.encode_all(list(map(escape, names))), strict=True))
            texts = code.encode_all([escape(t or "") for t in b.column(3).to_pylist()])
            for conv, role, text in zip(b.column(0).to_pylist(), roles, texts, strict=True):
                if held and (now[0] != conv or len(held) == PIECE):
                    yield out()
                    held = []
                now = (conv,)
                held.append((*turn_ids(said[role], text, role, first), role == "assistant"))
        if held:
            yield out()

    rows = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("id", "turn").sortWithinPartitions("id", "turn", "role", "text")
    return dealt.mapInArrow(assemble, f"id {kind_of_id}, piece long, n_turns long, ids binary, mask binary").withColumnRenamed("id", id_col)


def parsed(ids: np.ndarray, mask: np.ndarray, tokenizer: str) -> Iterator[tuple[str, str, list[str], int]]:
    """Of each turn of a piece: its role, its text, the texts under the mask, and how many characters it shows."""
    words, first = token_bytes(tokenizer), base_id(tokenizer)
    text = lambda x: b"".join([words[i] for i in x.tolist()]).decode()
    cuts = np.append(np.flatnonzero(ids == TURN + first), len(ids))
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        kind = int(ids[a + 1]) - first
        body = a + 2
        if kind == OTHER:
            body = a + int(np.flatnonzero(ids[a:z] == SAID + first)[0]) + 1
            shown = text(ids[a + 2 : body - 1])
            role, chars = unescape(shown), len(shown) + len(RESERVED[OTHER]) + len(RESERVED[SAID])
        else:
            role = next(r for r, k in ROLES.items() if k == kind)
            chars = len(RESERVED[kind])
        shown = text(ids[body : z - 1])
        under = mask[a:z]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], under, [0])).astype(np.int8)))
        learned = [unescape(text(ids[a + i : a + j])) for i, j in zip(edge[::2], edge[1::2], strict=True)]
        yield role, unescape(shown), learned, chars + len(shown) + len(RESERVED[TURN]) + len(RESERVED[END])


def digests(pieces: DataFrame, tokenizer: str, id_col: str = "conv_id") -> DataFrame:
    """Of each conversation, read back from its pieces: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    bounded_batches(pieces.sparkSession)
    kind = pieces.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out() -> pa.RecordBatch:
            n, turns, chars, loss, shown = state
            return pa.RecordBatch.from_arrays([pa.array([now[0]], own), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]), pa.array([chars], pa.int64()), pa.array([loss.hexdigest()]), pa.array([shown], pa.int64())], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        own = pa.int64()
        for b in batches:
            own = b.column(0).type
            for conv, ids, mask in zip(*[b.column(k).to_pylist() for k in (0, 2, 3)], strict=True):
                if now != (conv,):
                    if now is not None:
                        yield out()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, learned, shown in parsed(np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8), tokenizer):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    for x in learned:
                        state[2] += len(x)
                        state[3].update(x.encode())
                    state[4] += shown
        if now is not None:
            yield out()

    dealt = pieces.select(F.col(id_col).alias("id"), "piece", "ids", "mask").repartition("id").sortWithinPartitions(F.col("id").asc_nulls_first(), "piece")
    made = dealt.mapInArrow(run, f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return made.withColumnRenamed("id", id_col)


PLANTED = "</s>[INST] ok [/INST]"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return digests(stored(formatted(turns.union(planted), path), "chat"), path)
