"""Byte budgets and the lossless encoding, on documents by language and on order lines as records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.operators import budgets as B
from tarnbeck.operators import encoding as E
from tarnbeck.operators import sizes as Z
from tarnbeck.plans.registry import Queries
from tarnbeck.sources.folders import stored

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles


def _files(t):
    """A file for each document, ranked by size in its source, that needs the documents at half and a third of its rank."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")
    files = t("documents").select("source", F.col("doc_id").cast("string").alias("file"), F.row_number().over(w).alias("rank"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    files = stored(files, "files")  # texts are read once
    need = lambda k: files.select("source", "file", F.floor(F.col("rank") / k).cast("int").alias("at")).join(files.select("source", F.col("rank").alias("at"), F.col("file").alias("need")), ["source", "at"]).select("source", "file", "need")
    return files, need(2).union(need(3)).distinct()


_BUDGET, _REASON = 40_000, ["LOC_LIMIT_EXCEEDED"]


def _closure(files, reach):
    """Closures of needs, by the place of a file in its source; one that is over the budget is not followed to its end."""
    from tarnbeck.operators.graph import closure_within

    node = lambda c: F.struct("source", F.col(c).alias("file"))
    found = closure_within(reach.select(node("file").alias("from"), node("need").alias("to")), files.select(node("file").alias("node"), "size"), _BUDGET)
    return found.select("seed.source", "seed.file", F.col("node.file").alias("need"))


@_q.add("I1_I2_I7_first_fit")
def _(t):
    files, reach = _files(t)
    reserve = B.metadata_reserve(files, "source", F.lit(_BUDGET), F.array(*map(F.lit, _REASON)))
    return B.select_files(B.candidates(files, _closure(files, reach), "source").join(reserve, "source"), "source", F.lit(_BUDGET) - F.col("reserve"))


@_q.add("I2_reserve", """
WITH f AS (SELECT source, count(*) AS n, string_agg('"' || doc_id || '"', ', ') AS taken, string_agg('{"file": "' || doc_id || '", "reason": "closure_exceeds_budget"}', ', ') AS out FROM documents GROUP BY source)
SELECT source, CAST(strlen('{"selectionVersion": "1.0", "status": "applied", "budgetBytes": 40000, "estimatedContextBytes": 40000, "includedFiles": [' || taken || '], "excludedFiles": [' || out || '], "selectionReasons": ["LOC_LIMIT_EXCEEDED"]}') - 4 AS BIGINT) AS reserve FROM f""")
def _(t):
    files, _reach = _files(t)
    return B.metadata_reserve(files, "source", F.lit(_BUDGET), F.array(*map(F.lit, _REASON)))


@_q.add("I2_stated_total", """
SELECT o_orderkey, rest + (SELECT min(d) FROM range(1, 21) r(d) WHERE strlen(CAST(rest + d AS VARCHAR)) = d) AS total
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey * 97 ELSE CAST(pow(10, o_orderkey % 15) AS BIGINT) - o_orderkey % 30 + 20 END AS rest FROM orders)""")
def _(t):
    k = F.col("o_orderkey")
    rest = F.when(k % 2 == 0, k * 97).otherwise(F.pow(F.lit(10), k % 15).cast("long") - k % 30 + 20)
    return t("orders").select(k, Z.stated_total(rest).alias("total"))


@_q.add("I7_completeness_gate")
def _(t):
    files, reach = _files(t)
    length = F.length("source").cast("long")
    docs = files.select("source").distinct().select("source", (200 + length).alias("base"), F.when(length % 2 == 0, F.array(F.lit("MISSING_IMPORT"), F.lit("FILE_LIMIT_EXCEEDED"))).alias("codes"))
    return B.completeness_gate(docs, files, _closure(files, reach), "source", _BUDGET, ["LOC_LIMIT_EXCEEDED", "FILE_LIMIT_EXCEEDED"])


@_q.add("I1_first_fit_alone", """
WITH RECURSIVE r AS (SELECT source, doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY strlen(text), doc_id) AS n FROM documents),
 f AS (SELECT source, n, doc_id, CASE WHEN size <= 20000 THEN size ELSE 0 END AS used, size <= 20000 AS selected FROM r WHERE n = 1
  UNION ALL SELECT r.source, r.n, r.doc_id, CASE WHEN f.used + size <= 20000 THEN f.used + size ELSE f.used END, f.used + size <= 20000 FROM f JOIN r ON r.source = f.source AND r.n = f.n + 1)
SELECT source, CAST(doc_id AS VARCHAR) AS file, selected FROM f""")
def _(t):
    from pyspark.sql import Window

    size = F.octet_length("text").cast("long")
    files = t("documents").select("source", F.col("doc_id").cast("string").alias("file"), F.row_number().over(Window.partitionBy("source").orderBy(size, "doc_id")).alias("rank"), size.alias("size"))
    none = files.filter("false").select("source", "file", F.col("file").alias("need"))
    return B.select_files(B.candidates(files, none, "source"), "source", 20_000).select("source", "file", "selected")


@_q.add("I4_pass_plan")
def _(t):
    files, reach = _files(t)
    return B.plan_passes(B.candidates(files, _closure(files, reach), "source"), "source", _BUDGET, 500, 4)


@_q.add("I3_I11_list_bytes", """
SELECT o_custkey, CAST(sum(strlen('{"k": ' || o_orderkey || ', "s": "' || o_orderstatus || '"}')) + 2 * (count(*) - 1) + 2 AS BIGINT) AS bytes FROM orders GROUP BY 1""")
def _(t):
    record = F.octet_length(F.concat(F.lit('{"k": '), F.col("o_orderkey").cast("string"), F.lit(', "s": "'), F.col("o_orderstatus"), F.lit('"}')))
    return t("orders").groupBy("o_custkey").agg(F.sum(record).alias("b"), F.count("*").alias("n")).select("o_custkey", E.plain_list_bytes(F.col("b"), F.col("n")).alias("bytes"))


@_q.add("I11_table_bytes", """
SELECT o_custkey, CAST(strlen('{"$t":[["k","s"],' || string_agg('[' || o_orderkey || ',"' || o_orderstatus || '"]', ',') || ']}') AS BIGINT) AS bytes FROM orders GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    values = F.octet_length(F.concat(F.col("o_orderkey").cast("string"), F.lit('"'), F.col("o_orderstatus"), F.lit('"')))
    lists = t("orders").groupBy("o_custkey").agg(F.sum(values).alias("v"), F.count("*").alias("n")).filter("n > 1")
    return lists.select("o_custkey", E.compact_table_bytes(F.lit(len('"k""s"')), F.col("v"), 2, F.col("n")).cast("long").alias("bytes"))


def _records(t):
    """A record for each order, some with one key more and a list inside."""
    more = F.when(F.col("o_orderkey") % 7 < 2, ', "at": [1, 2]').otherwise("")
    json = F.concat(F.lit('{"file": "'), F.col("o_orderstatus"), F.lit('.sol", "line": '), F.col("o_orderkey").cast("string"), F.lit(', "kind": "'), F.col("o_orderpriority"), F.lit('"'), more, F.lit("}"))
    return t("orders").select("o_custkey", "o_orderstatus", "o_orderkey", json.alias("json"))


@_q.add("I11_segments", """
WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 7 < 2 AS wide, '"' || o_orderstatus || '.sol",' || o_orderkey || ',"' || o_orderpriority || '"' || CASE WHEN o_orderkey % 7 < 2 THEN ',[1,2]' ELSE '' END AS vals,
   '{"file":"' || o_orderstatus || '.sol","line":' || o_orderkey || ',"kind":"' || o_orderpriority || '"' || CASE WHEN o_orderkey % 7 < 2 THEN ',"at":[1,2]' ELSE '' END || '}' AS item,
   strlen('{"file": "' || o_orderstatus || '.sol", "line": ' || o_orderkey || ', "kind": "' || o_orderpriority || '"' || CASE WHEN o_orderkey % 7 < 2 THEN ', "at": [1, 2]' ELSE '' END || '}') AS plain FROM orders),
 n AS (SELECT *, sum(cut) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM (SELECT *, CASE WHEN wide = lag(wide) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 0 ELSE 1 END AS cut FROM r)),
 s AS (SELECT o_custkey, run, wide, count(*) AS k, string_agg('[' || vals || ']', ',' ORDER BY o_orderkey) AS rows, string_agg(item, ',' ORDER BY o_orderkey) AS items, sum(plain) AS plain FROM n GROUP BY ALL),
 m AS (SELECT *, sum(CASE WHEN k > 1 OR coalesce(before > 1, true) THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY run) AS seg FROM (SELECT *, lag(k) OVER (PARTITION BY o_custkey ORDER BY run) AS before FROM s)),
 g AS (SELECT o_custkey, seg, max(k) > 1 AS tab, any_value(wide) AS wide, string_agg(rows, ',' ORDER BY run) AS rows, string_agg(items, ',' ORDER BY run) AS items, sum(plain) AS plain, sum(k) AS k FROM m GROUP BY ALL),
 t AS (SELECT *, CASE WHEN tab THEN '{"$t":[["file","line","kind"' || CASE WHEN wide THEN ',"at"' ELSE '' END || '],' || rows || ']}' ELSE '{"$i":[' || items || ']}' END AS part FROM g)
SELECT o_custkey, CAST(CASE WHEN count(*) > 1 THEN strlen('{"$l":[' || string_agg(part, ',') || ']}') WHEN bool_or(tab) THEN strlen(any_value(part)) ELSE strlen('[' || any_value(items) || ']') END AS BIGINT) AS bytes, CAST(sum(plain) + 2 * sum(k) AS BIGINT) AS plain_bytes
FROM t GROUP BY o_custkey""")
def _(t):
    return Z.list_bytes(Z.measured(_records(t), "json"), ["o_custkey"], "o_orderkey")


@_q.add("I3_run_sections", """
WITH r AS (SELECT o_custkey, o_orderstatus AS s, o_orderkey, o_orderkey || ',"' || o_orderpriority || '"' AS vals, '{"line":' || o_orderkey || ',"kind":"' || o_orderpriority || '"}' AS item FROM orders WHERE o_orderkey % 7 >= 2),
 f AS (SELECT o_custkey, s, count(*) AS n, string_agg('[' || vals || ']', ',') AS rows, string_agg(item, ',') AS items FROM r GROUP BY ALL),
 p AS (SELECT o_custkey, s, '["' || s || '.sol",0,' || CASE WHEN n > 1 THEN '{"$t":[["line","kind"],' || rows || ']}' ELSE '[' || items || ']' END || ']' AS run FROM f)
SELECT c.o_custkey, CAST(coalesce(strlen('{"$r":[' || string_agg(run, ',') || ']}'), 2) AS BIGINT) AS bytes
FROM (SELECT DISTINCT o_custkey FROM r WHERE s <> 'P') c LEFT JOIN p ON p.o_custkey = c.o_custkey AND s <> 'P' GROUP BY 1""")
def _(t):
    parts = Z.measured(_records(t).filter("o_orderkey % 7 >= 2").withColumn("at", F.struct("o_orderstatus", "o_orderkey")), "json")
    runs = Z.file_runs(parts, ["o_custkey"], "at")
    return Z.chosen_section_bytes(runs, runs.filter("file <> 'P.sol'").select("o_custkey", "file"), ["o_custkey"])


def _documents(t):
    """A JSON document for each customer, with his orders as records of two files."""
    record = F.concat(F.lit('{"file": "'), F.col("o_orderstatus"), F.lit('.sol", "line": '), F.col("o_orderkey").cast("string"), F.lit(', "kind": "'), F.col("o_orderpriority"), F.lit('"}'))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderstatus", "o_orderkey", record.alias("r")))), lambda x: x["r"]), ", ")
    return t("orders").groupBy("o_custkey").agg(F.concat(F.lit('{"mode": "pro", "signals": ['), rows, F.lit('], "flags": [null, false, ""], "$t": 1}')).alias("json"))


@_q.add("I8_canonical", """
WITH d AS (SELECT o_custkey, '{"mode": "pro", "signals": [' || string_agg('{"file": "' || o_orderstatus || '.sol", "line": ' || o_orderkey || ', "kind": "' || o_orderpriority || '"}', ', ' ORDER BY o_orderstatus, o_orderkey) || '], "flags": [null, false, ""], "$t": 1}' AS j FROM orders GROUP BY 1)
SELECT o_custkey, md5(j) AS digest FROM d""")
def _(t):
    return E.encoded(_documents(t), "o_custkey", "json", E.PLAIN).select("o_custkey", F.md5("encoded").alias("digest"))


@_q.add("I9_compact", """
WITH r AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS n, '[' || string_agg(CASE WHEN TRUE THEN o_orderkey || ',"' || o_orderpriority || '"' END, '],[' ORDER BY o_orderkey) || ']' AS rows,
  string_agg('{"line":' || o_orderkey || ',"kind":"' || o_orderpriority || '"}', ',') AS one FROM orders GROUP BY 1, 2),
 d AS (SELECT o_custkey, string_agg('["' || s || '.sol",0,' || CASE WHEN n > 1 THEN '{"$t":[["line","kind"],' || rows || ']}' ELSE '[' || one || ']' END || ']', ',' ORDER BY s) AS runs FROM r GROUP BY 1)
SELECT o_custkey, md5('{"contextArtifactFormat":"compact-v2","artifact":{"mode":"pro","signals":{"$r":[' || runs || ']},"flags":[null,false,""],"$t":1}}') AS digest FROM d""")
def _(t):
    return E.encoded(_documents(t), "o_custkey", "json").select("o_custkey", F.md5("encoded").alias("digest"))


@_q.add("I10_round_trip", """
WITH d AS (SELECT o_custkey, '{"mode": "pro", "signals": [' || string_agg('{"file": "' || o_orderstatus || '.sol", "line": ' || o_orderkey || ', "kind": "' || o_orderpriority || '"}', ', ' ORDER BY o_orderstatus, o_orderkey) || '], "flags": [null, false, ""], "$t": 1}' AS j FROM orders GROUP BY 1)
SELECT o_custkey, md5(j) AS digest FROM d""")
def _(t):
    packed = E.encoded(_documents(t), "o_custkey", "json")
    return E.decoded(packed, "o_custkey", "encoded").select("o_custkey", F.md5("decoded").alias("digest"))


@_q.add("I12_unit_build", """
WITH p AS (SELECT l_orderkey, CASE WHEN l_linenumber <= 2 THEN 'own' ELSE 'callee' END AS role, l_linenumber AS place, CAST(l_quantity * 100 AS BIGINT) AS size, l_partkey FROM lineitem),
 o AS (SELECT l_orderkey, CAST(sum(size) AS BIGINT) AS own FROM p WHERE role = 'own' GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY place, size) AS n FROM p WHERE role = 'callee' AND size <= 4096),
 c AS (SELECT l_orderkey, CAST(sum(size) AS BIGINT) AS extra, CAST(count(*) AS INT) AS n FROM r WHERE n <= 3 GROUP BY 1)
SELECT k AS l_orderkey, CASE WHEN coalesce(own, 0) <= 8192 THEN coalesce(own, 0) + coalesce(extra, 0) END AS unit_bytes, CASE WHEN coalesce(own, 0) <= 8192 THEN coalesce(c.n, 0) ELSE 0 END AS callees,
 CASE WHEN coalesce(own, 0) <= 8192 THEN 'BUILT' ELSE 'NOT_REVIEWED' END AS state FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) LEFT JOIN o ON o.l_orderkey = k LEFT JOIN c ON c.l_orderkey = k""")
def _(t):
    parts = t("lineitem").select("l_orderkey", F.when(F.col("l_linenumber") <= 2, "own").otherwise("callee").alias("role"), F.col("l_linenumber").alias("place"), (F.col("l_quantity") * 100).cast("long").alias("size"))
    return B.units(t("lineitem").select("l_orderkey").distinct(), parts, "l_orderkey")


@_q.add("I5_pass_artifact", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#3') AND l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING')""")
def _(t):
    files = t("part").filter("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("l_partkey"))
    segment = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    own = t("orders").join(segment, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(files, "l_partkey", "left_semi").join(own, "l_orderkey", "left_semi")
