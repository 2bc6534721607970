"""Scanners of text, code and bytecode. Line and phrase rules are JVM expressions over exploded lines; what needs a state
machine (comments and strings, opcode data) is a small function over Arrow batches, row by row apart."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases, by language, that try to steer a reader, and shapes of secrets.
INJECTION_PHRASES = [
    ("en", "ignore previous instructions"), ("en", "ignore all previous"), ("en", "disregard the above"), ("es", "ignora las instrucciones anteriores"), ("fr", "ignorez les instructions"),
    ("de", "ignoriere alle vorherigen"), ("pt", "ignore as instruções anteriores"), ("pt", "ignore as instrucoes anteriores"), ("it", "ignora le istruzioni precedenti"), ("it", "ignora questo commento"),
]
SECRET_SHAPES = {"hex64-possible-private-key": r"(?i)(?:private[_ -]?key|secret|mnemonic|seed)[^\n]{0,60}?\b(?:0x)?[0-9a-f]{64}\b", "aws_key": r"AKIA[0-9A-Z]{16}", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][a-z]+"}
LANGUAGE_MARKS = [("solidity", r"pragma\s+solidity|contract\s+\w+\s*\{"), ("vyper", r"@external|# @version"), ("rust", r"fn\s+\w+\s*\(|use\s+\w+::")]


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, line, text): lines from 1; a null text has none."""
    return df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def language_of(path: Column, text: Column) -> Column:
    """By extension, else by content, else unknown."""
    out = F.when(path.endswith(".sol"), "solidity").when(path.endswith(".vy"), "vyper").when(path.endswith(".rs"), "rust")
    for name, pattern in LANGUAGE_MARKS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("unknown")


def secret_count(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(SECRET_SHAPES[kind]))


def redacted(text: Column, kinds: Sequence[str]) -> Column:
    """Each secret as [kind]; its value is never echoed."""
    for kind in kinds:
        text = F.regexp_replace(text, SECRET_SHAPES[kind], f"[{kind}]")
    return text


def phrase_hits(df: DataFrame, id_col: str, text_col: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(id_col, rule, n): how often each phrase of ``rules`` (rule, phrase) occurs, in any case."""
    low = F.lower(text_col)
    n = lambda p: ((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("long")
    hits = F.array(*[F.struct(F.lit(r).alias("rule"), n(p.lower()).alias("n")) for r, p in rules])
    return df.select(id_col, F.explode(F.filter(hits, lambda h: h["n"] > 0)).alias("h")).select(id_col, "h.rule", "h.n")


def injection_signals(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, language, phrase, n, weight, informational): the phrases of INJECTION_PHRASES. They weigh nothing and only inform."""
    hits = phrase_hits(df, id_col, text_col, [(f"{lang}:{phrase}", phrase) for lang, phrase in INJECTION_PHRASES])
    return hits.select(id_col, F.substring("rule", 1, 2).alias("language"), F.substring("rule", 4, 200).alias("phrase"), "n", F.lit(0).alias("weight"), F.lit(True).alias("informational"))


def input_hash(files: DataFrame, group: str, text: Column) -> DataFrame:
    """Of each group, one hash of its files that neither line ends nor the files' order change; a null text is an empty one. The
    files' hashes, sorted, are hashed by their first three digits, and those 4,096 hashes or fewer again, so no row holds a
    whole group."""
    each = F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), 256)
    joined = lambda xs: F.sha2(F.concat_ws("\n", xs), 256)
    parts = files.select(group, each.alias("h")).groupBy(group, F.substring("h", 1, 3).alias("b")).agg(joined(F.sort_array(F.collect_list("h"))).alias("h"))
    return parts.groupBy(group).agg(joined(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])).alias("input_hash"))


def calls_of(df: DataFrame, id_col: str, text_col: str, keywords: Sequence[str]) -> DataFrame:
    """(id_col, name): names that stand before an opening bracket, keywords left out."""
    names = F.array_distinct(F.regexp_extract_all(text_col, F.lit(r"([A-Za-z_]\w*)\s*\("), 1))
    return df.select(id_col, F.explode(names).alias("name")).filter(~F.col("name").isin(*keywords))


def resolved_imports(imports: DataFrame, files: DataFrame, id_col: str) -> DataFrame:
    """Each import (id_col, file, path) with the bundle's file that it means and a status: relative paths against the file's
    folder, others by the only file that ends so; none is missing, several are ambiguous and never guessed."""
    folder = F.regexp_replace("file", r"[^/]*$", "")
    plain = F.regexp_replace(F.concat(folder, F.regexp_replace("path", r"^\./", "")), r"[^/]+/\.\./", "")
    rel = imports.withColumn("_want", F.when(F.col("path").rlike(r"^\.\.?/"), plain).otherwise(F.col("path")))
    names = files.select(F.col("path").alias("found")).withColumn("_tail", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("found", "/"))), lambda k: F.array_join(F.slice(F.split("found", "/"), k, F.size(F.split("found", "/"))), "/"))))
    hits = rel.join(names, rel["_want"] == names["_tail"], "left").filter(F.col("found").isNull() | ~F.col("path").rlike(r"^\.\.?/") | (F.col("found") == F.col("_want")))
    out = hits.groupBy(id_col).agg(F.countDistinct("found").alias("n"), F.min("found").alias("resolved_to"))
    status = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return imports.join(out, id_col, "left").select(id_col, status.alias("status"), F.when(F.col("n") == 1, F.col("resolved_to")).alias("resolved_to"))


TOKENS = re.compile(r"//[^\n]*|/\*.*?\*/|/\*.*\Z|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL)


def masked(text: str) -> tuple[str, bool]:
    """The text with comments as blanks, line by line, and whether a comment is left open. Strings open no comment."""
    open_ = False

    def blank(m: re.Match) -> str:
        nonlocal open_
        x = m.group()
        if x[0] in "\"'":
            return x
        open_ |= x.startswith("/*") and (len(x) < 4 or not x.endswith("*/"))
        return re.sub(r"[^\n]", " ", x)

    return TOKENS.sub(blank, text), open_


def code_lines(text: str) -> int:
    """Lines that hold something once comments are gone."""
    return sum(bool(x.strip()) for x in masked(text)[0].split("\n"))


# Opcodes that carry data or matter to the advisories.
PUSH1, PUSH32, CREATE2, SELFDESTRUCT, DELEGATECALL, CALLCODE = 0x60, 0x7F, 0xF5, 0xFF, 0xF4, 0xF2


def opcodes(code: str) -> dict[int, int]:
    """How often each opcode occurs; the data of a push is never taken for code."""
    data, at, out = bytes.fromhex(code), 0, {}
    while at < len(data):
        op = data[at]
        out[op] = out.get(op, 0) + 1
        at += 1 + (op - PUSH1 + 1 if PUSH1 <= op <= PUSH32 else 0)
    return out


def mapped(df: DataFrame, id_col: str, value_col: str, schema: str, work: Callable[[str], Sequence]) -> DataFrame:
    """(id_col, fields of schema): ``work`` on each value, null as an empty text, in Arrow batches."""
    names = [x.split()[0] for x in schema.split(",")]
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [work(x or "") for x in b[value_col]]
            yield pd.DataFrame({id_col: b[id_col], **{n: [x[k] for x in found] for k, n in enumerate(names)}})

    return df.select(id_col, value_col).mapInPandas(run, f"{id_col} {kind}, {schema}")


STRUCTURE = re.compile(r"\b(pragma|contract|interface|library|function|modifier|event|struct)\s+(solidity[^;]*|[A-Za-z_]\w*)")


def structure(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, kind, name, line): declarations outside comments."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text in zip(b[id_col], b[text_col], strict=True):
                code = masked(text or "")[0]
                out += [(i, m[1], m[2].strip(), code.count("\n", 0, m.start()) + 1) for m in STRUCTURE.finditer(code)]
            yield pd.DataFrame(out, columns=[id_col, "kind", "name", "line"])

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, kind string, name string, line long")


QUOTED = re.compile(r"\"([^\"]*)\"|(?<!\w)'([^']*)'(?!\w)")
NEGATION = re.compile(r"\b(?:no|not|never|without|cannot|isn't|doesn't)\b[^.!?]{0,40}$", re.IGNORECASE)


def bare_claims(text: str, claims: Sequence[str]) -> list[str]:
    """Claims that the text makes itself: neither inside quotes nor negated in the 40 characters before."""
    spans = [m.span() for m in QUOTED.finditer(text)]
    out = []
    for claim in claims:
        for m in re.finditer(re.escape(claim), text, re.IGNORECASE):
            if not any(a <= m.start() < z for a, z in spans) and not NEGATION.search(text[max(0, m.start() - 48) : m.start()]):
                out.append(claim)
    return out


def neutralised(text: str, patterns: Sequence[str]) -> str:
    """Matches of the patterns as x's, line ends kept; of overlapping matches the first, longest holds."""
    found = sorted((m.start(), -m.end()) for p in patterns for m in re.finditer(p, text, re.IGNORECASE))
    out, at = [], 0
    for start, end in ((a, -z) for a, z in found):
        if start >= at:
            out += [text[at:start], re.sub(r"[^\n]", "x", text[start:end])]
            at = end
    return "".join([*out, text[at:]])


def elided_bytes(text: str, most: int) -> str:
    """At most ``most`` bytes of UTF-8: head and tail around a mark, no character split."""
    data = text.encode()
    if len(data) <= most:
        return text
    mark = "\n[...]\n"
    room = max(0, most - len(mark))
    head, tail = (room + 1) // 2, room // 2
    return data[:head].decode(errors="ignore") + mark + (data[-tail:].decode(errors="ignore") if tail else "")
