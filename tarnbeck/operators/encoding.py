"""Lossless compact encoding of JSON documents, and its sizes.

Key order is part of a document, so documents stay raw JSON strings (a map or variant column would sort the keys) and are
encoded one by one over Arrow batches; each row stands alone, so nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the formats, of the envelope and of the directives, and the sections whose records name a file.
PLAIN, COMPACT = "canonical-json-v1", "compact-v2"
FORMAT_FIELD, DATA_FIELD = "contextArtifactFormat", "artifact"
TABLE, SEGMENTS, ITEMS, RUNS, ESCAPED = "$t", "$l", "$i", "$r", "$o"
DIRECTIVES = (TABLE, SEGMENTS, ITEMS, RUNS, ESCAPED)
FILE_SECTIONS = ("calls", "comments", "contracts", "freeFunctions", "imports", "signals")


class Malformed(ValueError):
    """The text is no encoding of its format."""


def _mark(record) -> tuple[str, int] | None:
    """What a record shares with its neighbours in a run of a file: the file, and the place of that key."""
    path = record.get("file") if isinstance(record, dict) else None
    return (path, [*record].index("file")) if isinstance(path, str) else None


def packed(value, sections: tuple[str, ...] = (), in_runs: bool = False):
    """A JSON value in the compact form. A list is a sequence of runs of neighbours: with ``in_runs`` of one file, if each item
    names one, else of the same keys, where two or more are a table and all else loose items. ``sections``: keys of this object
    whose lists go by file."""
    if isinstance(value, dict):
        out = {k: packed(v, in_runs=k in sections) for k, v in value.items()}
        return {ESCAPED: out} if out and set(out).issubset(DIRECTIVES) and len(out) == 1 else out
    if not isinstance(value, list) or not value:
        return value
    marks = [_mark(x) for x in value] if in_runs else [None]
    if None not in marks:
        bare = ((m, {k: v for k, v in x.items() if k != "file"}) for m, x in zip(marks, value, strict=True))
        return {RUNS: [[*mark, packed([x for _, x in run])] for mark, run in groupby(bare, lambda p: p[0])]}
    parts: list[tuple[str, list]] = []
    for keys, run in groupby(value, lambda x: (*x,) if isinstance(x, dict) else ()):
        rows = [*run]
        table = bool(keys) and len(rows) > 1
        if table or not parts or parts[-1][0] == TABLE:
            parts.append((TABLE, [[*keys]]) if table else (ITEMS, []))
        parts[-1][1].extend([packed(v) for v in x.values()] if table else packed(x) for x in rows)
    if len(parts) > 1:
        return {SEGMENTS: [dict([part]) for part in parts]}
    return parts[0][1] if parts[0][0] == ITEMS else dict(parts)


def _placed(record: dict, path: str, place: int) -> dict:
    """The record with its file put back where it stood."""
    keys = list(record)
    return {k: path if k == "file" else record[k] for k in [*keys[:place], "file", *keys[place:]]}


#: What each directive stands for.
MEANING: dict[str, Callable] = {
    TABLE: lambda b: [dict(zip(b[0], map(unpacked, row), strict=True)) for row in b[1:]],
    SEGMENTS: lambda b: [x for part in b for x in unpacked(part)],
    ITEMS: lambda b: list(map(unpacked, b)),
    RUNS: lambda b: [_placed(r, path, place) for path, place, part in b for r in unpacked(part)],
    ESCAPED: lambda b: {k: unpacked(v) for k, v in b.items()},
}


def unpacked(value):
    """What an encoded value stands for; anything may happen to what is no encoding."""
    if isinstance(value, list):
        return list(map(unpacked, value))
    if not isinstance(value, dict):
        return value
    if len(value) == 1 and (name := next(iter(value))) in MEANING:
        return MEANING[name](value[name])
    return {k: unpacked(v) for k, v in value.items()}


def strictly_unpacked(value, sections: tuple[str, ...]):
    """A document has one encoding, so a value is an encoding when encoding what it stands for gives the same text again."""
    try:
        out = unpacked(value)
        same = json.dumps(packed(out, sections)) == json.dumps(value)
    except (TypeError, ValueError, KeyError, IndexError, AttributeError) as e:
        raise Malformed(str(e)) from e
    if not same:
        raise Malformed("not the encoding of what it stands for")
    return out


def compact_text(text: str) -> str:
    """A value as it stands in the compact form, without the envelope."""
    return json.dumps(packed(json.loads(text)), ensure_ascii=False, separators=(",", ":"))


def encode(text: str, form: str = COMPACT, sections: tuple[str, ...] = FILE_SECTIONS) -> str:
    value = json.loads(text)
    if form == PLAIN:
        return json.dumps(value, ensure_ascii=False)
    if form != COMPACT:
        raise ValueError(f"unknown format {form!r}")
    return json.dumps({FORMAT_FIELD: COMPACT, DATA_FIELD: packed(value, sections)}, ensure_ascii=False, separators=(",", ":"))


def decode(text: str, form: str = COMPACT, sections: tuple[str, ...] = FILE_SECTIONS) -> str:
    """Back to canonical JSON."""
    value = json.loads(text)
    if form == COMPACT:
        if not isinstance(value, dict) or value.get(FORMAT_FIELD) != COMPACT or len(value) != 2 or DATA_FIELD not in value:
            raise Malformed("envelope")
        value = strictly_unpacked(value[DATA_FIELD], sections)
    elif form != PLAIN:
        raise ValueError(f"unknown format {form!r}")
    return json.dumps(value, ensure_ascii=False)


def encoded(df: DataFrame, id_col: str, json_col: str, form: str = COMPACT) -> DataFrame:
    """(id_col, encoded, bytes, error): null and its reason where the text is no JSON."""
    return _each(df, id_col, json_col, lambda x: encode(x, form), "encoded")


def decoded(df: DataFrame, id_col: str, json_col: str, form: str = COMPACT) -> DataFrame:
    return _each(df, id_col, json_col, lambda x: decode(x, form), "decoded")


def _each(df: DataFrame, id_col: str, json_col: str, work: Callable[[str], str], name: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def one(x: str | None) -> tuple[str | None, str | None]:
        try:
            return (None, "null") if x is None else (work(x), None)
        except ValueError as e:
            return None, type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [one(x) for x in b[json_col]]
            yield pd.DataFrame({id_col: b[id_col], name: [x for x, _ in found], "error": [e for _, e in found]})

    out = df.select(id_col, json_col).mapInPandas(run, f"{id_col} {kind}, {name} string, error string")
    return out.withColumn("bytes", F.octet_length(name).cast("long"))


def compact_table_bytes(key_bytes: Column, value_bytes: Column, keys: int, n: Column) -> Column:
    """Bytes of a compact table of ``n`` records, 2 or more, of the same ``keys`` keys: ``key_bytes`` of the quoted keys, ``value_bytes``
    of all records' values. Around them stand the directive and, for the head and each record, brackets and commas."""
    return key_bytes + value_bytes + (n + 1) * (keys + 1) + n + len('{"$t":[') + len("]}")


def plain_list_bytes(record_bytes: Column, n: Column) -> Column:
    """Bytes of a canonical list: the records and ", " between them, in brackets."""
    return record_bytes + F.greatest(n - 1, F.lit(0)) * 2 + 2
