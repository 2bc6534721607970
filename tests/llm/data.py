"""Small tables with every awkward row: nulls, empty and long texts, repeated rows, clashing columns."""

import public_tokenizers

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, row long, id string, fp string, vector string, cost string, license string"
ODD = [None, "", " ", "\n\t ", "x", "Ünïcödé ß 你好 🙂", "a  b   c\n\nd \t e", "<|endoftext|> </s>[INST] ok", "word " * 3000, "same text", "same text", "Same  TEXT", "\x1c\x85  a", "ends with space ", "one\x00two"]


def awkward(spark, more=()):
    texts = [*ODD, *more]
    rows = [(k if k != 4 else None, t, "en" if k % 3 else None, "s", None if t is None else len(t), 0.5, "k", 1, "i", "f", "v", "c", "l") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[9], rows[0]], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
