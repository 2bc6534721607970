"""SentencePiece models through the tokenizers library.

The model's protobuf is parsed here; from its pieces, scores and normaliser settings a tokenizer is rebuilt: precompiled
normaliser, marker for spaces, unigram scores or, for a BPE model, merges ranked by score, and byte fallback. Where no
piece has the marker inside, a text may be cut before each marker, and with byte fallback also between any two characters
that stand side by side in no piece. A worker encodes each distinct cut once: what an Arrow batch has that its bounded cache
lacks goes to the library as one batch, which it spreads over its threads.

Parity is verified row by row against the sentencepiece library: ids, and the text decoded from them.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows are encoded each; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarnbeck.llm.columns import free_names, with_python_columns
from tarnbeck.llm.common import bounded_batches, table
from tarnbeck.llm.pieces import Cache, buffer_of, encoded, gathered

MARK = "▁"
# Kinds of pieces and models in the protobuf.
UNKNOWN, CONTROL, USER, BYTE = 2, 3, 4, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """What a model file says."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, value in fields(data):
            if number == 1:
                x = dict(fields(value))
                self.pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, 1)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown = next((k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.unknown_shown = trainer.get(44, " ⁇ ".encode()).decode()
        self.charsmap = normaliser.get(2, b"")
        self.prefix, self.trim, self.marks = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Of a BPE model: every pair of pieces that makes a piece, the best score of what it makes first."""
    vocab = {p: k for k, (p, _, kind) in enumerate(pieces) if kind in (1, USER)}
    out = []
    for whole, score, kind in pieces:
        if kind == 1:
            own = [(vocab[whole[:k]], vocab[whole[k:]], whole[:k], whole[k:]) for k in range(1, len(whole)) if whole[:k] in vocab and whole[k:] in vocab]
            out += [(-score, *x) for x in sorted(own)]
    return [(a, b) for _, _, _, a, b in sorted(out, key=lambda x: x[0])]


class Coder:
    def __init__(self, path: str):
        from tokenizers import AddedToken, Regex, Tokenizer, models, normalizers

        self.model = m = Model(path)
        vocab = [p for p, _, _ in m.pieces]
        if m.kind == BPE:
            core = models.BPE({p: k for k, p in enumerate(vocab)}, merges(m.pieces), unk_token=vocab[m.unknown], fuse_unk=True, byte_fallback=m.byte_fallback)
        elif m.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unknown, m.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are supported")
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.trim:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normaliser = normalizers.Sequence(steps) if steps else None
        own = [AddedToken(p, normalized=False) for p, _, kind in m.pieces if kind == USER]
        if own:
            self.tokenizer.add_tokens(own)
        # a text may be cut before a marker if no piece reaches over it
        self.cut = m.marks and not own and not any(MARK in p.lstrip(MARK) for p in vocab)
        self.apart = self._apart(vocab) if m.byte_fallback else np.zeros((256, 256), bool)
        self.known = Cache(self._pieces)
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode() for p, _, kind in m.pieces]
        self.bytes[m.unknown] = m.unknown_shown.encode()

    def prepared(self, text: str) -> str:
        """The text as the model's pieces spell it."""
        if self.normaliser:
            text = self.normaliser.normalize_str(text)
        if not text:
            return ""
        text = (" " if self.model.prefix else "") + text
        return text.replace(" ", MARK) if self.model.marks else text

    @staticmethod
    def _apart(vocab: list[str]) -> np.ndarray:
        """[a, b]: no piece has byte a right before byte b, and b can start a character."""
        apart = np.ones((256, 256), bool)
        for p in vocab:
            x = np.frombuffer(p.encode(), np.uint8)
            apart[x[:-1], x[1:]] = False
        apart[:, 0x80:0xC0] = False
        return apart

    def _pieces(self, cuts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([c.decode() for c in cuts], add_special_tokens=False)
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in found]

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Marks the bytes before which a prepared text may be cut."""
        cut = np.zeros(len(data), bool)
        if not self.cut or len(data) < 3:
            return cut
        cut[1:] = self.apart[data[:-1], data[1:]]
        marks = np.flatnonzero(data == 0xE2)
        marks = marks[marks < len(data) - 2]
        at = np.zeros(len(data) + 3, bool)
        at[marks[(data[marks + 1] == 0x96) & (data[marks + 2] == 0x81)] + 3] = True
        first = at[3:] & ~at[:-3]  # several markers on end stay together
        return (cut | first) & ~(at[3:] & at[:-3])

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids start (and the last one's end)."""
        data, starts = buffer_of(pa.array([self.prepared(t or "") for t in texts.to_pylist()], pa.large_string()))
        return encoded(data, starts, self._cuts(data), self.known)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, at = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:z].tobytes() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def decode_column(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The texts' bytes, from ids and starts as ``encode_column`` gives them."""
        shown, ends = gathered(self.bytes, ids)
        blob, edges = shown.tobytes(), ends[at].tolist()
        skip = [1 if self.model.prefix and blob[a : min(a + 1, z)] == b" " else 0 for a, z in zip(edges, edges[1:], strict=False)]
        return [blob[a + k : z] for k, a, z in zip(skip, edges, edges[1:], strict=False)]

    def decode(self, ids: bytes) -> str:
        own = np.frombuffer(ids, "<u4")
        return self.decode_column(own, np.array([0, len(own)]))[0].decode(errors="replace")


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def encoded_texts(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> tuple[DataFrame, str]:
    """``df`` with the ids of a text column by the model at ``path``, and that column's name, which clashes with none. A null or
    empty text has no ids. Nothing is shuffled; a worker reads the model once, so ``path`` has to be readable there."""
    name = free_names(df, [ids_col])[0]

    def work():
        own = coder(path)

        def made(texts: list[str]) -> list[pa.Array]:
            ids, at = own.encode_column(pa.array(texts, pa.large_string()))
            return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))]

        return made

    return with_python_columns(df, text_col, [(name, T.ArrayType(T.IntegerType()))], work), name


def decoded_texts(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` with the text of a column of ids, and that column's name, which clashes with none. Null ids and none give an empty
    text; an id that the model doesn't have reads as an unknown piece, bytes that are no UTF-8 as replacement characters."""
    name = free_names(df, [text_col])[0]

    def work():
        own = coder(path)

        def made(lists: list[list[int]]) -> list[pa.Array]:
            ids = np.array([-1 if x is None else x for xs in lists for x in xs or ()], np.int64)
            ids = np.where((ids >= 0) & (ids < len(own.bytes)), ids, own.model.unknown)
            at = np.concatenate(([0], np.cumsum([len(xs or ()) for xs in lists]))).astype(np.int64)
            return [pa.array([x.decode(errors="replace") for x in own.decode_column(ids, at)], pa.string())]

        return made

    return with_python_columns(df, ids_col, [(name, T.StringType())], work), name


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: n_ids, ids_crc32, whether the text decoded from the ids is the text, and parity with sentencepiece."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        own, theirs = coder(path), sentencepiece.SentencePieceProcessor(model_file=path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids, at = own.encode_column(b.column(1))
            each = [ids[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            parity = [np.array_equal(x, theirs.encode_as_numpy(t)) for x, t in zip(each, texts, strict=True)]
            back = [x == t.encode() for x, t in zip(own.decode_column(ids, at), texts, strict=True)]
            crc = pa.array([zlib.crc32(x) for x in each], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at)), crc, pa.array(back, pa.bool_()), pa.array(parity, pa.bool_())], names=["doc_id", "n_ids", "ids_crc32", "round_trip", "parity"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean, parity boolean")
