"""Declarations of Solidity sources, with their scopes, as windows over tokens.

A source becomes rows of tokens; running counts of braces and brackets over their order give each token its line and its level, so
statements are groups of tokens, a statement's scope is the last one before it that opened its level, and a brace's partner is the
next one of its level. So members are told from locals without a parser, and nothing leaves the JVM. A source is a group of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.sources.folders import stored

#: Names in braces that open no scope, comments, strings (one without its end stops at its line's), words with their dots, numbers,
#: arrows, line ends, and any other sign.
TOKEN = r"""(?<![\w$.])(?:import|using)\s*+\{[^{}]*+\}|//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?|[A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+|\d[\w.]*+|=>|\n|\S"""
# Fixed values of the language: what opens a scope of members, and words that stand between a declaration's type and name or behind its brackets.
HOLDERS = ("contract", "interface", "library")
VISIBILITY, MUTABILITY = ("public", "private", "internal", "external"), ("pure", "view", "payable")
MARKS = (*VISIBILITY, "constant", "immutable", "transient", "override", "virtual")
NAMED = ("pragma", "import", *HOLDERS, "function", "modifier", "event", "error", "struct", "enum", "using", "type")


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n, token, line, comment): all tokens but line ends, in order; the line is that of a token's start."""
    # dealt out as texts: few tasks may read many sources, and what follows keeps to a source, so that no token is shuffled
    rows = df.select(id_col, text_col).repartition(id_col).select(id_col, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(TOKEN), F.lit(0))).alias("n", "token"))
    ends = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    before = Window.partitionBy(id_col).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("line", 1 + F.coalesce(F.sum(ends).over(before), F.lit(0)))
    return rows.filter("token <> '\n'").withColumn("comment", F.col("token").startswith("//") | F.col("token").startswith("/*"))


def code_line_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n): lines that hold something besides comments."""
    held = tokens(df, id_col, text_col).filter("NOT comment").groupBy(id_col).agg(F.countDistinct("line").alias("n"))
    return df.select(id_col).join(held, id_col, "left").select(id_col, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def open_comments(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, line, issue): comments and strings without their end."""
    t = F.col("token")
    comment = t.startswith("/*") & ((F.length("token") < 4) | ~t.endswith("*/"))
    string = t.rlike("^[\"']") & ((F.length("token") < 2) | ~t.rlike(r"(?s)^([\"'])(?:[^\\]|\\.)*\1$"))
    issue = F.when(comment, "unterminated comment").when(string, "unterminated string")
    return tokens(df, id_col, text_col).select(id_col, "line", issue.alias("issue")).filter("issue IS NOT NULL")


def _statements(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, stmt, line, end, level, last, last_line, toks, text): runs of tokens up to a semicolon or brace outside brackets."""
    t = F.col("token")
    w = Window.partitionBy(id_col).orderBy("n")
    step = lambda up, down: F.when(t.isin(*up), 1).when(t.isin(*down), -1).otherwise(0)
    rows = tokens(df, id_col, text_col).filter("NOT comment").withColumns({"level": F.sum(step("{", "}")).over(w) - step("{", "}"), "depth": F.sum(step(("(", "["), (")", "]"))).over(w)})
    ends = t.isin(";", "{", "}") & (F.col("depth") == 0)
    rows = rows.withColumn("stmt", F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    toks = F.sort_array(F.collect_list(F.struct("n", "token", "depth")))
    out = rows.groupBy(id_col, "stmt").agg(F.min("line").alias("line"), F.max("line").alias("last_line"), F.max("n").alias("end"), F.min_by("level", "n").alias("level"), F.max_by("token", "n").alias("last"), toks.alias("toks"))
    return out.withColumn("text", F.array_join(F.transform("toks", lambda x: x["token"]), " "))


def _type(text: Column) -> Column:
    """A type as written, with no spaces but those between words."""
    return F.regexp_replace(F.trim(text), r" ?([\[\]().,]|=>) ?", "$1")


def _parameter_types(toks: Column) -> Column:
    """The types of the first brackets' parts, without names and places."""
    opens = F.array_position(F.transform(toks, lambda x: x["token"]), "(").cast("int")
    behind = F.slice(toks, opens + 1, F.size(toks))
    closes = F.array_position(F.transform(behind, lambda x: x["depth"]), 0).cast("int")
    inner = F.when(closes > 1, F.slice(behind, F.lit(1), closes - 1)).otherwise(F.slice(behind, 1, 0))
    parts = F.split(F.array_join(F.transform(inner, lambda x: F.when((x["token"] == ",") & (x["depth"] == 1), "\n").otherwise(x["token"])), " "), " \n ")
    plain = lambda p: F.regexp_replace(F.regexp_replace(p, r"\b(?:memory|calldata|storage|indexed)\b", " "), r" +", " ")
    typed = F.transform(parts, lambda p: _type(F.regexp_replace(F.trim(plain(p)), r"^((?:address payable|\S+|mapping .*\))(?: \[ ?\S* ?\])*) [A-Za-z_$][\w$]*$", "$1")))
    return F.when((opens > 0) & (closes > 1), F.concat(F.lit("("), F.array_join(typed, ","), F.lit(")"))).when(opens > 0, "()")


def declarations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, holder, kind, name, line, line_end, truncated, type, visibility, mutability, marks, modifiers, signature): what a source
    declares at its top and as members of its contracts, interfaces and libraries. Variables inside functions, and the fields of
    structs, are no members. A body without its closing brace is truncated and ends with the source. A null text declares
    nothing; text that is no code gives what it happens to look like, and never an error."""
    s = _statements(df, id_col, text_col)
    text = F.regexp_replace("text", r" [;{}]$", "")
    word = F.regexp_extract(text, r"^(?:abstract )?([a-z]+)\b", 1)
    special = F.regexp_extract(text, r"^(constructor|receive|fallback) \(", 1)
    kind = F.when(special != "", special).when(word.isin(*NAMED) & text.rlike(r"^(?:abstract )?[a-z]+(?: [\w$\"'*.]|\s*\{)"), word)
    # read four times below: without this, every reading makes all tokens anew
    s = stored(s.withColumns({"text": text, "kind": kind}), "statements")

    opened = s.filter("last = '{'")
    name = F.regexp_extract("text", r"^(?:abstract )?[a-z]+ ([A-Za-z_$][\w$]*)", 1)
    child = s.select(id_col, "stmt", F.col("level").alias("body"), F.lit(None).cast("struct<kind:string,name:string>").alias("scope"), F.lit(False).alias("opens"))
    both = child.union(opened.select(id_col, "stmt", F.col("level") + 1, F.struct(F.coalesce("kind", F.lit("block")).alias("kind"), name.alias("name")), F.lit(True)))
    scope = F.last("scope", ignorenulls=True).over(Window.partitionBy(id_col, "body").orderBy("stmt"))
    scopes = both.withColumn("scope", scope).filter("NOT opens").select(id_col, "stmt", F.when(F.col("body") > 0, F.col("scope")).alias("scope"))

    brace = s.filter("last IN ('{', '}')").select(id_col, "stmt", "last", "last_line", F.when(F.col("last") == "{", F.col("level")).otherwise(F.col("level") - 1).alias("own"))
    w = Window.partitionBy(id_col, "own").orderBy("stmt")
    closed = brace.withColumn("closes", F.when(F.lead("last").over(w) == "}", F.lead("last_line").over(w))).filter("last = '{'").select(id_col, "stmt", "closes")
    length = df.select(id_col, (F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1 - F.col(text_col).endswith("\n").cast("int")).alias("lines"))
    rows = s.join(scopes, [id_col, "stmt"]).join(closed, [id_col, "stmt"], "left").join(length, id_col)

    member = F.coalesce(F.col("scope.kind").isin(*HOLDERS), F.lit(False))
    head = F.regexp_replace("text", r" = .*$", "")
    variable = member & F.col("kind").isNull() & (F.col("last") == ";") & head.rlike(r"^[A-Za-z_$].*[\w\])] [A-Za-z_$][\w$]*$")
    rows = rows.withColumn("kind", F.coalesce("kind", F.when(variable, "variable"))).filter(F.col("kind").isNotNull() & (F.col("scope").isNull() | member))

    named = F.when(F.col("kind") == "variable", F.regexp_extract(head, r"([A-Za-z_$][\w$]*)$", 1)).when(F.col("kind") == "pragma", F.regexp_replace(F.regexp_extract("text", "^pragma (.*)$", 1), r"(?<![a-z]) ", ""))
    named = named.when(F.col("kind") == "import", F.regexp_extract("text", "[\"']([^\"']*)[\"']", 1)).when(F.col("kind").isin("constructor", "receive", "fallback"), F.col("kind")).otherwise(name)
    before_name = F.regexp_replace(head, r" ?[A-Za-z_$][\w$]*$", "")
    own_type = _type(F.regexp_replace(F.regexp_replace(before_name, rf"\b(?:override \( [^)]* \)|{'|'.join(MARKS)})(?= |$)", " "), " +", " "))
    # words outside brackets, behind the first of them
    outer = F.transform(F.filter("toks", lambda x: (x["depth"] == 0) & x["token"].rlike(r"^[A-Za-z_$]")), lambda x: x["token"])
    callable_ = F.col("kind").isin("function", "constructor", "receive", "fallback", "modifier")
    behind = F.when(F.col("kind").isin("function", "modifier"), F.slice(outer, 3, F.size(outer))).otherwise(F.slice(outer, 2, F.size(outer)))
    known = F.array(*map(F.lit, (*MARKS, *MUTABILITY, "returns")))
    marks = F.when(F.col("kind") == "variable", F.filter(outer, lambda x: x.isin(*MARKS))).when(callable_, F.filter(behind, lambda x: x.isin(*MARKS)))
    pick = lambda words: F.get(F.filter(F.when(callable_, behind).otherwise(outer), lambda x: x.isin(*words)), F.lit(0))
    applies = F.col("kind").isin("function", "constructor", "receive", "fallback")
    bodied = F.col("last") == "{"
    return rows.select(
        id_col, F.col("scope.name").alias("holder"), "kind", named.alias("name"), "line", F.when(bodied, F.coalesce("closes", "lines")).otherwise(F.col("last_line")).alias("line_end"), (bodied & F.col("closes").isNull()).alias("truncated"),
        F.when(F.col("kind") == "variable", own_type).alias("type"), F.when(callable_ | (F.col("kind") == "variable"), pick(VISIBILITY)).alias("visibility"),
        F.when(applies, F.coalesce(pick(MUTABILITY), F.lit("nonpayable"))).alias("mutability"), marks.alias("marks"),
        F.when(applies, F.array_except(behind, known)).alias("modifiers"), F.when(callable_ | F.col("kind").isin("event", "error"), _parameter_types(F.col("toks"))).alias("signature"),
    )
