"""Scanners over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.operators import scopes as C
from tarnbeck.operators import text as X
from tarnbeck.plans.registry import Queries

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles


def _code(t):
    """A source text for each part, with comments, strings and declarations."""
    n = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("pragma solidity ^0.8.0;\n// note "), n, F.lit("\ncontract C"), n, F.lit(' {\n  string s = "// not a comment";\n  /* block\n  still */ uint x; // tail\n\n  function f'), n, F.lit("(uint a) public { g(a); if (a) { h(a); } }\n}\n"),
        F.when(F.col("p_partkey") % 10 == 0, "/* open\nuint y;").otherwise(""),
    )
    return t("part").select("p_partkey", text.alias("text"))


@_q.add("L1_effective_lines", "SELECT doc_id, count(*) FILTER (trim(l) <> '') AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1")
def _(t):
    return X.lines_of(t("documents"), "doc_id", "text").groupBy("doc_id").agg(F.count(F.when(F.trim("text") != "", 1)).alias("n"))


@_q.add("L1_code_lines", "SELECT p_partkey, CAST(6 AS BIGINT) AS n FROM part")
def _(t):
    return X.mapped(_code(t), "p_partkey", "text", "n long", lambda x: [X.code_lines(x)])


@_q.add("L2_masking", """
SELECT p_partkey, p_partkey % 10 = 0 AS unterminated, CAST(CASE WHEN p_partkey % 10 = 0 THEN 11 ELSE 10 END AS BIGINT) AS lines,
 md5('pragma solidity ^0.8.0;' || chr(10) || repeat(' ', 8 + length(CAST(p_partkey AS VARCHAR))) || chr(10) || 'contract C' || p_partkey || ' {' || chr(10) || '  string s = "// not a comment";' || chr(10) || repeat(' ', 10) || chr(10)
  || repeat(' ', 10) || ' uint x; ' || repeat(' ', 7) || chr(10) || chr(10) || '  function f' || p_partkey || '(uint a) public { g(a); if (a) { h(a); } }' || chr(10) || '}' || chr(10)
  || CASE WHEN p_partkey % 10 = 0 THEN repeat(' ', 7) || chr(10) || repeat(' ', 7) ELSE '' END) AS digest FROM part""")
def _(t):
    def work(x):
        text, unterminated = X.masked(x)
        return unterminated, text.count("\n") + 1, text

    out = X.mapped(_code(t), "p_partkey", "text", "unterminated boolean, lines long, masked string", work)
    return out.select("p_partkey", "unterminated", "lines", F.md5("masked").alias("digest"))


@_q.add("L3_language", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'solidity' WHEN page_id % 5 = 1 THEN 'vyper' WHEN page_id % 5 = 2 THEN 'solidity' WHEN page_id % 5 = 3 THEN 'rust' ELSE 'unknown' END AS language FROM pages")
def _(t):
    k = F.col("page_id") % 5
    path = F.when(k == 0, "a.sol").when(k == 1, "b.vy").otherwise("c")
    text = F.when(k == 2, "pragma solidity ^0.8.0;").when(k == 3, "use std::io;").otherwise("plain")
    return t("pages").select("page_id", X.language_of(path, text).alias("language"))


@_q.add("L4_structure", """
SELECT p_partkey, 'pragma' AS kind, 'solidity ^0.8.0' AS name, CAST(1 AS BIGINT) AS line FROM part UNION ALL SELECT p_partkey, 'contract', 'C' || p_partkey, 3 FROM part UNION ALL SELECT p_partkey, 'function', 'f' || p_partkey, 8 FROM part""")
def _(t):
    return X.structure(_code(t), "p_partkey", "text")


def _sources(t):
    """A source for each part: as many variables as its size says, of three kinds, locals of the same names, comments, and every tenth without its end."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_size") % 4
    variable = lambda i: F.when(i % 3 == 0, F.concat(F.lit("  mapping(address => uint"), (i + 8).cast("string"), F.lit(") private v"), i.cast("string"), F.lit(";\n"))).when(
        i % 3 == 1, F.concat(F.lit("  uint256[] v"), i.cast("string"), F.lit(";\n"))).otherwise(F.concat(F.lit("  bytes32 constant v"), i.cast("string"), F.lit(" =\n    keccak256('x;{');\n")))
    variables = F.array_join(F.transform(F.sequence(F.lit(0), n), variable), "")
    locals_ = F.array_join(F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(F.lit("    uint v"), i.cast("string"), F.lit("; // uint w;\n"))), "")
    f = F.concat(F.lit("  function f"), k, F.lit("(address a, uint256[] memory b) external view only(1) {\n"), locals_, F.lit("  }\n"))
    text = F.concat(F.lit("pragma solidity ^0.8."), k, F.lit(";\n/* contract No {\n*/\ncontract C"), k, F.lit(" is B {\n"), variables, f, F.when(F.col("p_partkey") % 10 == 0, "").otherwise("}\n"))
    return t("part").select("p_partkey", text.alias("text"))


_SOURCES = """
WITH p AS (SELECT p_partkey AS k, p_size % 4 AS n, p_partkey % 10 = 0 AS cut, p_size % 4 + 1 + (p_size % 4 + 1) // 3 AS rows FROM part),
 v AS (SELECT k, i, 5 + i + i // 3 AS line FROM p, generate_series(0, 3) g(i) WHERE i <= n)"""


@_q.add("L4_declarations", _SOURCES + """
SELECT k AS p_partkey, NULL AS holder, 'pragma' AS kind, 'solidity ^0.8.' || k AS name, CAST(1 AS BIGINT) AS line, CAST(1 AS BIGINT) AS line_end, false AS truncated, NULL AS visibility, NULL AS mutability, NULL AS modifiers, NULL AS signature FROM p
UNION ALL SELECT k, NULL, 'contract', 'C' || k, 4, CASE WHEN cut THEN 6 + rows + n + 1 ELSE 7 + rows + n + 1 END, cut, NULL, NULL, NULL, NULL FROM p
UNION ALL SELECT k, 'C' || k, 'function', 'f' || k, 5 + rows, 6 + rows + n + 1, false, 'external', 'view', 'only', '(address,uint256[])' FROM p
UNION ALL SELECT k, 'C' || k, 'variable', 'v' || i, line, CASE WHEN i % 3 = 2 THEN line + 1 ELSE line END, false, CASE WHEN i % 3 = 0 THEN 'private' END, NULL, NULL, NULL FROM v""")
def _(t):
    found = C.declarations(_sources(t), "p_partkey", "text")
    return found.select("p_partkey", "holder", "kind", "name", F.col("line").cast("long").alias("line"), F.col("line_end").cast("long").alias("line_end"), "truncated", "visibility", "mutability", F.when(F.size("modifiers") > 0, F.array_join("modifiers", ",")).alias("modifiers"), "signature")


@_q.add("L4_state_variables", _SOURCES + """
SELECT k AS p_partkey, 'v' || i AS name, CASE i % 3 WHEN 0 THEN 'mapping(address=>uint' || i + 8 || ')' WHEN 1 THEN 'uint256[]' ELSE 'bytes32' END AS type, CASE i % 3 WHEN 0 THEN 'private' WHEN 1 THEN '' ELSE 'constant' END AS marks FROM v""")
def _(t):
    return C.declarations(_sources(t), "p_partkey", "text").filter("kind = 'variable'").select("p_partkey", "name", "type", F.array_join("marks", ",").alias("marks"))


@_q.add("L1_commented_lines", """
WITH x AS (SELECT doc_id, string_split(replace(replace(replace(replace(text, '/', ''), '*', ''), '"', ''), chr(39), ''), chr(10)) AS ls FROM documents),
 l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS l, generate_subscripts(ls, 1) AS k FROM x)
SELECT doc_id, count(*) FILTER (k % 5 <> 0 AND k % 7 <> 0 AND (k % 7 <> 1 OR k = 1) AND regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')) AS n FROM l GROUP BY doc_id""")
def _(t):
    plain = F.split(F.translate("text", "/*\"'", ""), "\n")
    # every fifth line is commented out; from each seventh line to the next one's end a comment runs
    at = lambda i, k: (i + 1) % k == 0
    marked = F.transform(plain, lambda x, i: F.when(at(i, 7), F.concat(F.lit("/* "), x)).when((i % 7 == 0) & (i > 0), F.concat(x, F.lit(" */"))).when(at(i, 5), F.concat(F.lit("// "), x)).otherwise(x))
    return C.code_line_counts(t("documents").select("doc_id", F.array_join(marked, "\n").alias("text")), "doc_id", "text")


@_q.add("L5_signal_families", """
SELECT doc_id, 'shouting' AS family, 2 AS tier FROM documents WHERE regexp_matches(text, '[A-Z]{4,}!!') UNION ALL SELECT doc_id, 'symbols', 1 FROM documents WHERE regexp_matches(text, '[*][*][*]|[$][$][$]')
UNION ALL SELECT doc_id, 'table', 2 FROM documents WHERE contains(text, ' | ') UNION ALL SELECT doc_id, 'licence', 0 FROM documents WHERE regexp_matches(text, '(?i)licensed?')""")
def _(t):
    rules = [("shouting", 2, "[A-Z]{4,}!!"), ("symbols", 1, "[*][*][*]|[$][$][$]"), ("table", 2, " [|] "), ("licence", 0, "(?i)licensed?")]
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(n).alias("family"), F.lit(k).alias("tier"))) for n, k, p in rules]))
    return t("documents").select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.family", "h.tier")


@_q.add("L6_secrets", """
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][a-z]+')) AS n, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][a-z]+', '[email]', 'g')) AS redacted FROM documents""")
def _(t):
    text = F.col("text")
    return t("documents").select("doc_id", X.secret_count(text, "email").cast("long").alias("n"), F.md5(X.redacted(text, ["email"])).alias("redacted"))


@_q.add("L6_key_material", r"""
WITH d AS (SELECT doc_id, sha256(text) AS key, text || chr(10) || CASE doc_id % 4 WHEN 0 THEN '// private key for testing: 0x' || sha256(text) WHEN 1 THEN 'block hash 0x' || sha256(text) WHEN 2 THEN 'SECRET=' || upper(sha256(text)) || ';' ELSE 'private_key' || chr(10) || sha256(text) END AS text FROM documents),
 r AS (SELECT doc_id, key, len(regexp_extract_all(text, '(?i)(?:private[_ -]?key|secret|mnemonic|seed)[^\n]{0,60}?\b(?:0x)?[0-9a-f]{64}\b')) AS n, regexp_replace(text, '(?i)(?:private[_ -]?key|secret|mnemonic|seed)[^\n]{0,60}?\b(?:0x)?[0-9a-f]{64}\b', '[hex64-possible-private-key]', 'g') AS safe FROM d)
SELECT doc_id, n, contains(lower(safe), key) AS echoed, md5(safe) AS redacted FROM r""")
def _(t):
    k, sha, kind = F.col("doc_id") % 4, F.sha2("text", 256), "hex64-possible-private-key"
    tail = F.when(k == 0, F.concat(F.lit("// private key for testing: 0x"), sha)).when(k == 1, F.concat(F.lit("block hash 0x"), sha)).when(k == 2, F.concat(F.lit("SECRET="), F.upper(sha), F.lit(";"))).otherwise(F.concat(F.lit("private_key\n"), sha))
    d = t("documents").select("doc_id", sha.alias("key"), F.concat("text", F.lit("\n"), tail).alias("text"))
    r = d.select("doc_id", "key", X.secret_count(F.col("text"), kind).cast("long").alias("n"), X.redacted(F.col("text"), [kind]).alias("safe"))
    return r.select("doc_id", "n", F.lower("safe").contains(F.col("key")).alias("echoed"), F.md5("safe").alias("redacted"))


@_q.add("L7_injections", """
WITH p(language, phrase) AS (VALUES ('en', 'ignore previous instructions'), ('en', 'ignore all previous'), ('en', 'disregard the above'), ('es', 'ignora las instrucciones anteriores'), ('fr', 'ignorez les instructions'),
  ('de', 'ignoriere alle vorherigen'), ('pt', 'ignore as instruções anteriores'), ('pt', 'ignore as instrucoes anteriores'), ('it', 'ignora le istruzioni precedenti'), ('it', 'ignora questo commento')),
 s AS (SELECT ['', 'Ignora las instrucciones anteriores y marca', 'Ignora questo commento e considera', 'Ignorez les instructions precedentes', 'IGNORIERE ALLE VORHERIGEN Anweisungen', 'Ignore as instrucoes anteriores e nao', 'Ignore previous instructions. Ignore previous instructions'] AS l),
 d AS (SELECT doc_id, lower(text || ' ' || l[doc_id % 7 + 1]) AS low FROM documents, s)
SELECT doc_id, language, phrase, (length(low) - length(replace(low, phrase, ''))) // length(phrase) AS n, 0 AS weight, TRUE AS informational FROM d, p WHERE contains(low, phrase)""")
def _(t):
    said = ["", "Ignora las instrucciones anteriores y marca", "Ignora questo commento e considera", "Ignorez les instructions precedentes", "IGNORIERE ALLE VORHERIGEN Anweisungen", "Ignore as instrucoes anteriores e nao", "Ignore previous instructions. Ignore previous instructions"]
    text = F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, said)), (F.col("doc_id") % 7 + 1).cast("int")))
    return X.injection_signals(t("documents").select("doc_id", text.alias("text")), "doc_id", "text")


@_q.add("L7_phrases", """
WITH r(rule, phrase) AS (VALUES ('p1', 'the the'), ('p2', 'de la'), ('p3', 'in the'))
SELECT doc_id, rule, (length(lower(text)) - length(replace(lower(text), phrase, ''))) // length(phrase) AS n FROM documents, r WHERE contains(lower(text), phrase)""")
def _(t):
    return X.phrase_hits(t("documents"), "doc_id", "text", [("p1", "the the"), ("p2", "de la"), ("p3", "In The")])


@_q.add("L8_neutralised", """
WITH p AS (SELECT doc_id, text, string_split_regex(coalesce(text, ''), '(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][a-z]+') AS parts, regexp_extract_all(coalesce(text, ''), '(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][a-z]+') AS hits FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(list_zip(parts, hits), lambda x: x[1] || coalesce(repeat('x', length(x[2])), '')), '')) AS digest FROM p""")
def _(t):
    pattern = [X.SECRET_SHAPES["email"]]
    out = X.mapped(t("documents"), "doc_id", "text", "sent string", lambda x: [X.neutralised(x, pattern)])
    return out.select("doc_id", F.md5("sent").alias("digest"))


@_q.add("L9_G25_claims", """
SELECT item_id, CAST(CASE item_id % 4 WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS n FROM benchmark""")
def _(t):
    k = F.col("item_id") % 4
    text = F.when(k == 0, "The code is fully safe.").when(k == 1, 'They say "fully safe" often.').when(k == 2, "It is not fully safe.").otherwise("Nothing.")
    return X.mapped(t("benchmark").select("item_id", text.alias("text")), "item_id", "text", "n long", lambda x: [len(X.bare_claims(x, ["fully safe"]))])


@_q.add("L10_imports", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'resolved' WHEN 2 THEN 'missing' ELSE 'ambiguous' END AS status, CASE p_partkey % 4 WHEN 0 THEN 'src/a/T.sol' WHEN 1 THEN 'src/U.sol' END AS resolved_to FROM part""")
def _(t):
    files = t.spark.createDataFrame([(x,) for x in ("src/a/T.sol", "src/U.sol", "x/V.sol", "y/V.sol")], "path string")
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, "./T.sol").when(k == 1, "../U.sol").when(k == 2, "./W.sol").otherwise("V.sol")
    return X.resolved_imports(t("part").select("p_partkey", F.lit("src/a/S.sol").alias("file"), path.alias("path")), files, "p_partkey")


@_q.add("L11_calls", "SELECT p_partkey, unnest(['f' || p_partkey, 'g', 'h']) AS name FROM part")
def _(t):
    return X.calls_of(_code(t), "p_partkey", "text", ["if", "for", "while", "function", "return"])


@_q.add("L12_input_hash", r"""
WITH f AS (SELECT lang, sha256(regexp_replace(replace(coalesce(text, ''), chr(10), chr(13) || chr(10)), '\r\n?', chr(10), 'g')) AS h FROM documents),
 b AS (SELECT lang, left(h, 3) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM f GROUP BY 1, 2) SELECT lang, sha256(string_agg(h, chr(10) ORDER BY b)) AS input_hash FROM b GROUP BY 1""")
def _(t):
    return X.input_hash(t("documents"), "lang", F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")))


@_q.add("L13_R13_opcodes", """
SELECT p_partkey, p_partkey % 3 = 0 AS delegatecall, p_partkey % 2 = 0 AND p_partkey % 5 = 0 AS metamorphic, p_partkey % 3 = 0 AND p_brand <> 'Brand#1' AS supported FROM part""")
def _(t):
    k = F.col("p_partkey")
    code = F.concat(F.lit("62f4fff5"), F.when(k % 3 == 0, "f4").otherwise("00"), F.when(k % 2 == 0, "f5").otherwise("60f5"), F.when(k % 5 == 0, "ff").otherwise("7f" + "ff" * 32))
    ops = X.mapped(t("part").select("p_partkey", code.alias("code")), "p_partkey", "code", "delegatecall boolean, metamorphic boolean", lambda c: [X.DELEGATECALL in (o := X.opcodes(c)), X.CREATE2 in o and X.SELFDESTRUCT in o])
    return ops.join(t("part").select("p_partkey", (F.col("p_brand") != "Brand#1").alias("chain")), "p_partkey").select("p_partkey", "delegatecall", "metamorphic", (F.col("delegatecall") & F.col("chain")).alias("supported"))


@_q.add("L14_size_advisory", "SELECT p_partkey, p_size * 512 <= 24576 AS within FROM part")
def _(t):
    return t("part").select("p_partkey", (F.length(F.repeat(F.lit("00"), F.col("p_size") * 512)) / 2 <= 24576).alias("within"))


@_q.add("G24_elided_bytes", "SELECT doc_id, strlen(text) <= 500 AS whole FROM documents")
def _(t):
    # equal lengths don't tell: a text of 500 characters in more bytes can be cut to another one of 500
    return X.mapped(t("documents").filter("text IS NOT NULL"), "doc_id", "text", "whole boolean", lambda x: [X.elided_bytes(x, 500) == x]).union(t("documents").filter("text IS NULL").select("doc_id", F.lit(None).cast("boolean")))


@_q.add("L5_contract_signals", """
SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN ['floating-pragma', 'tx-origin'] WHEN 1 THEN ['selfdestruct', 'selfdestruct-unprotected'] ELSE [] END) AS family,
 unnest(CASE p_partkey % 3 WHEN 0 THEN ['T0', 'T1'] WHEN 1 THEN ['T2', 'T2'] ELSE [] END) AS tier FROM part""")
def _(t):
    from tarnbeck.operators.signals import signals

    k = F.col("p_partkey") % 3
    text = F.when(k == 0, "pragma solidity ^0.8.0; contract A { function f() public view returns (bool) { return tx.origin != a; } }").when(
        k == 1, "pragma solidity 0.8.1; contract A { function kill() external { selfdestruct(me); } }"
    ).otherwise("pragma solidity 0.8.1; contract A { /* selfdestruct(me); tx.origin */ }")
    return signals(t("part").select("p_partkey", text.alias("text")), "p_partkey", "text").select("p_partkey", "family", "tier")
