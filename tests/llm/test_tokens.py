import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnbeck.llm import packing as P
from tarnbeck.llm import sentencepieces as S
from tarnbeck.llm import token_files as F
from tarnbeck.llm.bpe import coder
from tarnbeck.llm.queries import QUERIES
from tests.llm.data import BPE, ODD, PIECES, awkward, empty
from tests.oracle import SF

TEXT = st.text(st.sampled_from("aB .,!?é'\n\t  \x1c\x85　漢字٣½²x1<|>▁🙂") | st.characters(exclude_categories=["Cs"]), max_size=60)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXT)
def test_cut_encoding_equals_the_library(library, text):
    assert coder(BPE).encode_all([text])[0].tolist() == library(text)


@pytest.mark.parametrize("text", [x for x in ODD if x is not None] + ["don't  stop", " lead", "trail ", "a\n b", "  ", "x!!! y.", "ﬁn. ℌ. ʰx."])
def test_cut_encoding_of_odd_texts(library, text):
    assert coder(BPE).encode_all([text])[0].tolist() == library(text)


def pieces_of(rows):
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.start, r.length, bytes(r.ids)))
    return by


def test_packing_holds_every_id_once(spark, library):
    docs = awkward(spark)
    rows = P.packed(docs, BPE, size=64).collect()
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append([*library(r.text or ""), 1])
    got = pieces_of(rows)
    for doc, each in want.items():
        ids = b"".join(np.array(x, "<u4").tobytes() for x in sorted(each, key=len))
        assert sum(n for _, n, _ in got[doc]) * 4 == len(ids)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 64
    assert P.packed(empty(spark), BPE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_equals_a_plain_search(lengths):
    lengths = sorted(lengths, reverse=True)
    packer = P.Packer(30, 0)
    got = [packer.place(n) for n in lengths]
    rooms = {}
    for n, (w, offset) in zip(lengths, got, strict=True):
        room = rooms.get(w, 30)
        open_ = [r for r in rooms.values() if r >= n]
        assert offset == 30 - room and (room == min(open_) if open_ and n < 30 else w not in rooms)
        rooms[w] = room - n


def test_packing_query_pads_little(spark):
    rows = QUERIES["op6_packing"](spark, SF).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert sum(fill.values()) > 0.98 * 2048 * len(fill)
    assert all(r.start + r.length <= r.doc_tokens for r in rows)


def test_token_files_round_trip(spark, library, tmp_path):
    docs = awkward(spark)
    for encoding in F.ENCODINGS:
        path = f"file://{tmp_path}/{encoding}"
        F.write_tokens(docs, path, BPE, encoding=encoding, row_group_bytes=1 << 16, page_bytes=1 << 12)
        rows = F.read_tokens(spark, path).orderBy("start").collect()
        ids = [r.doc_id for r in rows]
        assert ids == sorted(ids, key=lambda x: (x is not None, x))
        at = 0
        for r in rows:
            assert (r.start, r.n_tokens) == (at, len(r.ids))
            at += r.n_tokens
        assert sorted(map(tuple, (r.ids for r in rows))) == sorted((*library(r.text or ""), 0) for r in docs.collect())
        assert F.read_index(spark, path).count() == len(rows)
        meta = pq.ParquetFile(next((tmp_path / encoding).glob("*.parquet"))).metadata.row_group(0)
        column = next(meta.column(k) for k in range(meta.num_columns) if "ids" in meta.column(k).path_in_schema)
        assert any("DICTIONARY" in e for e in column.encodings) == (encoding == "dictionary")
        assert (encoding == "delta") == ("DELTA_BINARY_PACKED" in column.encodings)
        assert column.has_offset_index
    F.write_tokens(empty(spark), f"file://{tmp_path}/none", BPE)
    assert F.read_tokens(spark, f"file://{tmp_path}/none").count() == 0


def test_token_files_query(spark, library):
    rows = QUERIES["op10_token_files"](spark, SF).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    at = 0
    for r, d in zip(rows, docs, strict=True):
        ids = [*library(d.text), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.fixture(scope="module")
def theirs():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=600, deadline=None, suppress_health_check=list(HealthCheck))
@given(TEXT.filter(lambda t: "\x00" not in t))
def test_sentencepiece_parity(theirs, text):
    own = S.coder(PIECES)
    ids = own.encode_batch([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text)
    assert own.decode(ids) == theirs.decode(theirs.encode(text))


def test_sentencepiece_query(spark):
    rows = QUERIES["op7_sentencepiece"](spark, SF).collect()
    assert rows and all(r.parity and r.round_trip for r in rows)


def test_sentencepiece_columns_of_awkward_rows(spark, theirs):
    docs = awkward(spark, ["long word " * 30_000, "x" * 20_000]).filter("text IS NULL OR NOT contains(text, char(0))").selectExpr("*", "'taken' AS ids")
    out, ids = S.encoded_texts(docs, PIECES)
    back, text = S.decoded_texts(out, PIECES, ids)
    assert (ids, text) == ("_ids", "_text") and back.columns == [*docs.columns, "_ids", "_text"]
    rows = back.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["_ids"] == theirs.encode(r.text or "") and r["_text"] == theirs.decode(r["_ids"])
    assert {r.ids for r in rows} == {"taken"} and {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    none, ids = S.encoded_texts(empty(spark), PIECES)
    assert S.decoded_texts(none, PIECES, ids)[0].count() == 0


def test_sentencepiece_of_odd_ids(spark, theirs):
    df = spark.createDataFrame([(1, None), (2, []), (3, [-5, 10**6, None]), (4, theirs.encode("a ß"))], "doc_id long, ids array<int>")
    out, text = S.decoded_texts(df, PIECES)
    got = {r.doc_id: r[text] for r in out.collect()}
    assert text == "text" and (got[1], got[2], got[4]) == ("", "", "a ß") and got[3].count("⁇") == 3


def field(number: int, value) -> bytes:
    if isinstance(value, int):
        return bytes([number << 3, value])
    if isinstance(value, float):
        import struct

        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return bytes([number << 3 | 2, len(value)]) + value


def test_unigram_models(tmp_path, theirs):
    """A unigram model made by hand: the best-scored split, byte fallback, and spaces trimmed by its normaliser."""
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁ab", -4.0, 1), ("ba", -3.2, 1), *[(f"<0x{k:02X}>", -9.0, 6) for k in range(256)]]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    trainer = field(3, 1) + bytes([0x98, 0x02, 1])  # byte_fallback is field 35
    normaliser = field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1)
    path = tmp_path / "unigram.model"
    path.write_bytes(data + field(2, trainer) + field(3, normaliser))
    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
    own = S.coder(str(path))
    assert own.model.kind == S.UNIGRAM and own.model.byte_fallback
    for text in ("ab", "abab  ba ", "aba b", "é", "a é b", ""):
        assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == lib.encode(text), text
