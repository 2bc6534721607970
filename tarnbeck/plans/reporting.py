"""Report algebra, validation, coverage and evaluation metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.operators import aggregates as A
from tarnbeck.operators import reports as P
from tarnbeck.plans.registry import Queries

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles


@_q.add("D12_coverage_merge", """
WITH c AS (SELECT DISTINCT n_name AS category FROM nation), p AS (SELECT n_name AS category, CASE o_orderstatus WHEN 'F' THEN 'DETECTED' WHEN 'O' THEN 'NOT_DETECTED' ELSE CASE WHEN o_orderkey % 400 = 0 THEN 'NOT_ASSESSED' ELSE 'NOT_DETECTED' END END AS status
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey <> 7 AND (o_orderstatus <> 'F' OR n_nationkey % 3 = 0)),
 s AS (SELECT category, bool_or(status = 'DETECTED') AS hit, bool_or(status = 'NOT_ASSESSED') AS gap FROM p GROUP BY 1), b AS (SELECT n_name FROM nation WHERE n_nationkey % 2 = 0)
SELECT c.category, CASE WHEN hit AND c.category IN (SELECT n_name FROM b) THEN 'DETECTED' WHEN hit OR gap OR hit IS NULL THEN 'NOT_ASSESSED' ELSE 'NOT_DETECTED' END AS status FROM c LEFT JOIN s USING (category)""")
def _(t):
    n = t("nation").select("n_nationkey", F.col("n_name").alias("category"))
    status = F.when(F.col("o_orderstatus") == "F", "DETECTED").when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 400 == 0), "NOT_ASSESSED").otherwise("NOT_DETECTED")
    rows = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    passes = rows.filter("n_nationkey <> 7 AND (o_orderstatus <> 'F' OR n_nationkey % 3 = 0)").select("category", status.alias("status"))
    return A.coverage(n.select("category"), passes, n.filter("n_nationkey % 2 = 0"), "category", "status", True)


@_q.add("D14_global_scope", """
WITH p AS (SELECT o_custkey, bool_or(o_orderstatus = 'P') AS unassigned, bool_or(o_orderpriority = '1-URGENT') AS failed, count(*) < 5 AS few FROM orders GROUP BY 1)
SELECT o_custkey, NOT unassigned AND NOT failed AND NOT few AS complete, concat_ws(';', CASE WHEN failed THEN 'pass_failed' END, CASE WHEN unassigned THEN 'files_unassigned' END, CASE WHEN few THEN 'files_not_analyzed' END) AS reasons FROM p""")
def _(t):
    p = t("orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("unassigned"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("failed"), (F.count("*") < 5).alias("few"))
    reasons = F.concat_ws(";", F.when(F.col("failed"), "pass_failed"), F.when(F.col("unassigned"), "files_unassigned"), F.when(F.col("few"), "files_not_analyzed"))
    return p.select("o_custkey", (reasons == "").alias("complete"), reasons.alias("reasons"))


@_q.add("D15_discard_record", """
WITH l AS (SELECT p_brand, p_type, l_quantity > 45 AS dropped FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 48)
SELECT p_type, count(*) FILTER (dropped) AS dropped, (SELECT count(*) FROM (SELECT p_brand FROM l x WHERE x.p_type = y.p_type AND dropped EXCEPT SELECT p_brand FROM l x WHERE x.p_type = y.p_type AND NOT dropped)) AS lost FROM l y GROUP BY 1""")
def _(t):
    rows = t("lineitem").join(t("part").filter("p_size > 48"), F.col("p_partkey") == F.col("l_partkey")).select("p_brand", "p_type", (F.col("l_quantity") > 45).alias("dropped"))
    by = rows.groupBy("p_type", "p_brand").agg(F.count(F.when(F.col("dropped"), 1)).alias("n"), F.bool_and("dropped").alias("gone"))
    return by.groupBy("p_type").agg(F.sum("n").alias("dropped"), F.count(F.when(F.col("gone"), 1)).alias("lost"))


@_q.add("C12_D16_R11_eval_metrics", """
SELECT lang, count(*) AS cases, count(*) FILTER (quality IS NULL) AS missing, count(*) FILTER (toxic = 1 AND n_chars > 500) AS detected, count(*) FILTER (toxic = 1) AS expected, count(*) FILTER (toxic = 0 AND quality = 0) AS false_positives,
 count(*) FILTER (quality = 1) AS valid, coalesce(bool_and(toxic = 0) FILTER (n_chars > 10000), false) AS injection_ok FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def _(t):
    rows = t("documents").join(t("labels"), "doc_id", "left")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    q, x, size = F.col("quality"), F.col("toxic"), F.col("n_chars")
    return rows.groupBy("lang").agg(
        F.count("*").alias("cases"), n(q.isNull(), "missing"), n((x == 1) & (size > 500), "detected"), n(x == 1, "expected"), n((x == 0) & (q == 0), "false_positives"), n(q == 1, "valid"),
        F.coalesce(F.bool_and(F.when(size > 10000, x == 0)), F.lit(False)).alias("injection_ok"),
    )


@_q.add("D17_plan_weights", "SELECT o_custkey % 50 AS plan, o_orderpriority AS pass, CAST(sum(l_linenumber) AS BIGINT) AS weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def _(t):
    weights = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_linenumber").alias("w"))
    return t("orders").join(weights, "o_orderkey").groupBy((F.col("o_custkey") % 50).alias("plan"), F.col("o_orderpriority").alias("pass")).agg(F.sum("w").alias("weight"))


@_q.add("D19_R1_merged_findings", """
WITH f AS (SELECT l_partkey AS k, l_orderkey * 100 + l_linenumber AS o, CASE WHEN l_quantity > 45 THEN 4 WHEN l_quantity > 30 THEN 3 ELSE 1 END AS s, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 1 ELSE 0 END AS c, l_suppkey AS loc, l_linestatus || l_linenumber AS e FROM lineitem),
 u AS (SELECT k, e, min(o) AS o, min(e) AS m FROM f GROUP BY 1, 2), r AS (SELECT k, e, o, row_number() OVER (PARTITION BY k ORDER BY o, e) AS n FROM u),
 v AS (SELECT k, list(e ORDER BY n) AS evidence FROM r WHERE n <= 5 GROUP BY 1)
SELECT f.k AS stable_key, max(s) AS severity_rank, max(c) AS confidence_rank, list_sort(list(DISTINCT loc)) AS locations, any_value(evidence) AS evidence, count(*) AS merged_count, min(o) AS first_order FROM f JOIN v ON v.k = f.k GROUP BY 1""")
def _(t):
    q = F.col("l_quantity")
    rows = t("lineitem").select(
        F.col("l_partkey").alias("stable_key"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("o"), F.when(q > 45, "CRITICAL").when(q > 30, "HIGH").otherwise("LOW").alias("severity"),
        F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low").alias("confidence"), F.col("l_suppkey").alias("loc"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("e"),
    )
    return A.merged_findings(rows, "stable_key", "o", "severity", "confidence", "loc", "e")


@_q.add("F4_R6_ordered_dedupe", "SELECT min(doc_id) AS doc_id, sha256(text) AS identity FROM documents GROUP BY sha256(text)")
def _(t):
    rows = P.merged(t("documents").select("doc_id", F.sha2("text", 256).alias("sha")), F.col("sha"), [F.col("doc_id")])
    return rows.select("doc_id", F.col("sha").alias("identity"))


@_q.add("R3_rule_rows", """
WITH f AS (SELECT l_orderkey AS k, l_quantity AS q, l_discount AS d, l_returnflag AS rf, l_linestatus AS ls, l_tax AS x, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT k || '/' || n || '/' || p || '/' || s AS key, 'R-02' AS rule FROM f WHERE q > 49 UNION ALL SELECT k || '/' || n || '/' || p || '/' || s, 'R-04' FROM f WHERE rf = 'R' AND d > 0.09
UNION ALL SELECT k || '/' || n || '/' || p || '/' || s, 'R-08' FROM f WHERE (ls = 'O') <> (nullif(x, 0) IS NOT NULL)""")
def _(t):
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    rules = {"R-02": F.col("l_quantity") <= 49, "R-04": ~((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09)), "R-08": (F.col("l_linestatus") == "O") == (F.nullif(F.col("l_tax"), F.lit(0.0)).isNotNull())}
    return P.violations(t("lineitem"), key, rules)


_REPORTS = """
WITH r AS (SELECT o_orderkey AS report, CASE o_orderstatus WHEN 'F' THEN 'quick' WHEN 'P' THEN 'pro' WHEN 'O' THEN CASE WHEN o_orderkey % 40 = 7 THEN 'ultra' ELSE 'standard' END END AS mode,
  CASE o_orderkey % 5 WHEN 0 THEN 'partial' WHEN 1 THEN 'failed' WHEN 2 THEN CASE WHEN o_orderkey % 9 = 0 THEN 'almost' ELSE 'complete' END ELSE 'complete' END AS completeness,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 101 END AS score, o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 0 AS scored, o_orderkey % 11 = 0 AS wrong_band, o_orderpriority = '1-URGENT' AS summary, o_custkey % 10 = 0 AS gas FROM orders),
 c AS (SELECT o_orderkey AS report, n, CASE WHEN o_orderkey % 17 = 0 AND n = 10 THEN 1 ELSE n END AS category, CASE WHEN o_orderkey % 3 = 0 OR (o_orderkey + n) % 4 = 0 THEN 'DETECTED' WHEN o_orderkey % 4 = 1 AND n = 6 THEN 'NOT_ASSESSED' ELSE 'NOT_DETECTED' END AS status FROM orders, range(1, 11) v(n)),
 k AS (SELECT report, category, bool_and(status = 'DETECTED') AS hit FROM c GROUP BY 1, 2),
 f AS (SELECT l_orderkey AS report, CAST(l_linenumber AS VARCHAR) AS id, l_partkey % 11 + 1 AS category, l_returnflag = 'R' AS informational, l_returnflag = 'R' AND l_suppkey % 6 <> 0 AS so, l_partkey % 50 = 0 AS tampered, l_tax < 0.02 AS patch, l_linenumber AS evidence, l_suppkey % 9 AS locations FROM lineitem),
 b AS (SELECT report, count(DISTINCT category) AS backed FROM f WHERE NOT so AND category <= 10 GROUP BY 1),
 w AS (SELECT r.*, gap, kinds, coalesce(backed, 0) AS backed, detected FROM r JOIN (SELECT report, bool_or(status = 'NOT_ASSESSED') AS gap, count(DISTINCT category) AS kinds, count(DISTINCT category) FILTER (status = 'DETECTED') AS detected FROM c GROUP BY 1) USING (report) LEFT JOIN b USING (report)),
 x AS (SELECT f.*, mode, hit FROM f LEFT JOIN r USING (report) LEFT JOIN k USING (report, category))
SELECT report, CAST(NULL AS VARCHAR) AS key, 'R-05' AS rule FROM w WHERE completeness IN ('partial', 'failed') AND NOT gap AND NOT (completeness = 'partial' AND detected = 10 AND backed = 10)
UNION ALL SELECT report, NULL, 'R-06' FROM w WHERE mode = 'quick' AND gas
UNION ALL SELECT report, NULL, 'R-08' FROM w WHERE scored <> (score IS NOT NULL) OR (scored AND wrong_band)
UNION ALL SELECT report, NULL, 'R-09' FROM w WHERE mode <> 'pro' AND summary
UNION ALL SELECT report, NULL, 'categories' FROM w WHERE kinds < 10 UNION ALL SELECT report, NULL, 'mode' FROM w WHERE mode = 'ultra' UNION ALL SELECT report, NULL, 'completeness' FROM w WHERE completeness = 'almost'
UNION ALL SELECT report, id, 'R-02' FROM x WHERE tampered UNION ALL SELECT report, id, 'R-04' FROM x WHERE category <= 10 AND hit IS DISTINCT FROM TRUE
UNION ALL SELECT report, id, 'R-06' FROM x WHERE (mode = 'quick' AND patch) OR (mode IS NULL AND patch) UNION ALL SELECT report, id, 'R-07' FROM x WHERE informational <> so
UNION ALL SELECT report, id, 'evidence' FROM x WHERE evidence > 5 UNION ALL SELECT report, id, 'locations' FROM x WHERE locations = 0
UNION ALL SELECT report, id, 'repeated_id' FROM f GROUP BY 1, 2 HAVING count(*) > 1"""


@_q.add("R3_validate", _REPORTS)
def _(t):
    o, p, s = F.col("o_orderkey"), F.col("l_partkey"), F.col("o_orderstatus")
    named = lambda n: F.concat(F.lit("SC"), F.lpad(n.cast("string"), 2, "0"))
    mode = F.when(s == "F", "quick").when(s == "P", "pro").when((s == "O") & (o % 40 == 7), "ultra").when(s == "O", "standard")
    state = F.when(o % 5 == 0, "partial").when(o % 5 == 1, "failed").when((o % 5 == 2) & (o % 9 == 0), "almost").otherwise("complete")
    score = F.when(o % 7 != 0, F.col("o_custkey") % 101)
    reports = t("orders").select(
        o.alias("report"), mode.alias("mode"), state.alias("completeness"), score.alias("score"), F.when((o % 13 != 0) & (o % 7 != 0), "computed").otherwise("not_computed").alias("score_status"),
        F.when(o % 11 == 0, "NONE").otherwise(A.score_band(score)).alias("band"), F.when(F.col("o_orderpriority") == "1-URGENT", "text").alias("summary"), F.lit(0).alias("notes"), (F.col("o_custkey") % 10 == 0).cast("int").alias("gas"),
    )
    n = F.col("n")
    status = F.when((o % 3 == 0) | ((o + n) % 4 == 0), "DETECTED").when((o % 4 == 1) & (n == 6), "NOT_ASSESSED").otherwise("NOT_DETECTED")
    coverage = t("orders").select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("n")).select(o.alias("report"), named(F.when((o % 17 == 0) & (n == 10), 1).otherwise(n)).alias("category"), status.alias("status"))
    number, flag = F.col("l_linenumber").cast("string"), F.col("l_returnflag") == "R"
    key = F.sha2(p.cast("string"), 256)
    findings = t("lineitem").select(
        F.col("l_orderkey").alias("report"), number.alias("id"), number.alias("want_id"), F.when(p % 50 == 0, "other").otherwise(key).alias("stable_key"), key.alias("want_key"), named(p % 11 + 1).alias("category"),
        F.when(flag & (F.col("l_suppkey") % 6 != 0), "INFORMATIONAL").otherwise("LOW").alias("severity"), F.when(flag, "informational").otherwise("open").alias("status"), F.when(F.col("l_tax") < 0.02, "diff").alias("patch"),
        F.col("l_linenumber").alias("evidence"), (F.col("l_suppkey") % 9).alias("locations"),
    )
    return P.report_errors(reports, findings, coverage, forced_partial=True)


@_q.add("V1_constraints", """
SELECT CAST(o_orderkey AS VARCHAR) AS key, 'status_known' AS rule FROM orders WHERE o_orderstatus NOT IN ('P', 'F') UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'price_with_priority' FROM orders WHERE nullif(o_orderpriority, '5-LOW') <> '1-URGENT' AND o_totalprice > 450000
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'customer_exists' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT l_orderkey || ':' || l_linenumber, 'line_unique' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def _(t):
    from tarnbeck.operators.relational import orphans

    # a CHECK passes on null: only a false condition is a violation
    rules = {"status_known": F.col("o_orderstatus").isin("P", "F"), "price_with_priority": (F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")) == "1-URGENT") | (F.col("o_totalprice") <= 450000)}
    checks = P.violations(t("orders"), F.col("o_orderkey").cast("string"), rules)
    lost = orphans(t("orders"), t("customer").filter("c_custkey % 10 <> 0"), "o_custkey", "c_custkey").select(F.col("o_orderkey").cast("string").alias("key"), F.lit("customer_exists").alias("rule"))
    return checks.unionByName(lost).unionByName(P.repeated(t("lineitem"), ["l_orderkey", "l_linenumber"], "line_unique"))


@_q.add("R4_R5_R7_scope", """
WITH k AS (SELECT p_partkey, CASE WHEN p_size < 20 THEN 'primary' WHEN p_size < 40 THEN 'context' WHEN p_size < 48 THEN 'excluded' ELSE 'unknown' END AS kind FROM part)
SELECT l_orderkey, bool_and(kind IN ('primary', 'context')) AS kept FROM lineitem JOIN k ON p_partkey = l_partkey GROUP BY 1""")
def _(t):
    files = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    kinds = P.in_scope(t("lineitem").select("l_orderkey", "l_partkey"), files.filter("p_size < 20"), files.filter("p_size < 40"), files.filter("p_size < 48"), "l_partkey")
    return P.discarded(kinds, "l_orderkey", ["primary", "context"])


@_q.add("R8_verdict_parse", """
SELECT event_id, CASE WHEN NOT regexp_matches(props, '^\\{"k": \\d+\\}$') THEN 'malformed' WHEN CAST(json_extract(props, '$.k') AS INT) > 95 THEN 'unknown_target' WHEN event_type = 'view' AND value > 90 THEN 'bad_verdict' ELSE 'ok' END AS outcome FROM events""")
def _(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t("events").select("event_id", P.first_failure([("malformed", ~F.col("props").rlike(r'^\{"k": \d+\}$')), ("unknown_target", k > 95), ("bad_verdict", (F.col("event_type") == "view") & (F.col("value") > 90))]).alias("outcome"))


@_q.add("R9_final_verdict", """
WITH e AS (SELECT l_orderkey, list(CASE WHEN l_returnflag = 'R' AND l_quantity > 20 THEN 'fabricated' ELSE 'verified' END) AS ev FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') AND NOT coalesce(len(ev) > 0 AND NOT list_contains(ev, 'fabricated'), false) THEN 'UNVERIFIABLE' WHEN o_orderstatus = 'O' THEN 'SUPPORTED' WHEN o_orderstatus = 'F' THEN 'CONTRADICTED' ELSE 'INSUFFICIENT' END AS verdict
FROM orders LEFT JOIN e ON l_orderkey = o_orderkey""")
def _(t):
    e = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 20), "fabricated").otherwise("verified")).alias("ev"))
    verdict = F.when(F.col("o_orderstatus") == "O", "SUPPORTED").when(F.col("o_orderstatus") == "F", "CONTRADICTED").otherwise("INSUFFICIENT")
    rows = t("orders").join(e, "o_orderkey", "left").withColumn("ev", F.coalesce("ev", F.array().cast("array<string>")))
    return rows.select("o_orderkey", P.final_verdict(verdict, F.col("ev")).alias("verdict"))


@_q.add("R10_evidence_locality", """
WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
 n AS (SELECT file, line, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS text FROM l),
 q AS (SELECT item_id, item_id * 7 AS file, 1 + item_id % 5 AS line, trim(regexp_replace(CASE WHEN item_id % 4 = 0 THEN text ELSE (SELECT left(n.text, 30) FROM n WHERE n.file = item_id * 7 AND n.line = 1) END, '\\s+', ' ', 'g')) AS quote FROM benchmark),
 h AS (SELECT item_id, min(abs(n.line - q.line)) AS gap FROM q JOIN n ON n.file = q.file AND contains(n.text, q.quote) GROUP BY 1)
SELECT q.item_id, CASE WHEN q.file NOT IN (SELECT file FROM l) OR q.quote = '' THEN 'unverifiable' WHEN gap IS NULL THEN 'fabricated' WHEN gap <= 3 THEN 'verified' ELSE 'location_mismatch' END AS status FROM q LEFT JOIN h USING (item_id) WHERE q.quote IS NOT NULL""")
def _(t):
    docs = t("documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    first = docs.filter("line = 1").select("file", F.left(P.plain_spaces(F.col("text")), F.lit(30)).alias("start"))
    q = t("benchmark").select("item_id", (F.col("item_id") * 7).alias("file"), (F.col("item_id") % 5 + 1).alias("line"), "text").join(first, "file", "left")
    q = q.select("item_id", "file", "line", F.when(F.col("item_id") % 4 == 0, F.col("text")).otherwise(F.col("start")).alias("quote")).filter("quote is not null")
    return P.evidence_status(q, docs, "item_id")


@_q.add("R10_finding_evidence", """
WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
 n AS (SELECT file, line, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS text FROM l),
 q AS (SELECT item_id // 3 AS finding, trim(regexp_replace(CASE WHEN item_id % 9 = 0 THEN text ELSE (SELECT left(n.text, CAST(item_id % 40 AS INT)) FROM n WHERE n.file = item_id // 3 * 7 AND n.line = 1 + item_id % 2 * 6) END, '\\s+', ' ', 'g')) AS quote FROM benchmark),
 p AS (SELECT DISTINCT item_id // 3 AS finding, item_id // 3 * 7 AS file, 2 AS line, 4 AS z FROM benchmark UNION SELECT item_id // 3, item_id // 3 * 11, 1, 3 FROM benchmark WHERE item_id // 3 % 4 = 1),
 s AS (SELECT DISTINCT q.finding, quote, p.file, p.line, p.z, p.file IN (SELECT file FROM l) AS there FROM q JOIN p USING (finding) WHERE quote IS NOT NULL),
 g AS (SELECT finding, quote, there, (SELECT min(greatest(s.line - n.line, n.line - s.z, 0)) FROM n WHERE n.file = s.file AND s.quote <> '' AND contains(n.text, s.quote)) AS gap FROM s),
 e AS (SELECT finding, quote, CASE WHEN bool_or(gap <= 3) THEN 1 WHEN bool_or(gap IS NOT NULL) THEN 3 WHEN bool_or(there AND quote <> '') THEN 4 ELSE 2 END AS s FROM g GROUP BY ALL)
SELECT f.finding, ['verified', 'unverifiable', 'location_mismatch', 'fabricated'][coalesce(max(s), 2)] AS status FROM (SELECT DISTINCT finding FROM q) f LEFT JOIN e USING (finding) GROUP BY f.finding""")
def _(t):
    docs = t("documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    item, finding = F.col("item_id"), F.floor(F.col("item_id") / 3)
    near = docs.filter("line IN (1, 7)").select("file", F.col("line").alias("_line"), P.plain_spaces(F.col("text")).alias("start"))
    b = t("benchmark").withColumns({"finding": finding, "file": finding * 7, "_line": (item % 2 * 6 + 1).cast("int")}).join(near, ["file", "_line"], "left")
    quotes = b.select("finding", F.when(item % 9 == 0, F.col("text")).otherwise(F.left("start", (item % 40).cast("int"))).alias("quote"))
    places = b.select("finding", (F.col("finding") * 7).alias("file"), F.lit(2).alias("line"), F.lit(4).alias("end")).union(b.filter("finding % 4 = 1").select("finding", F.col("finding") * 11, F.lit(1), F.lit(3)))
    return P.finding_evidence(b, quotes.filter("quote IS NOT NULL"), places, docs, "finding")


@_q.add("R12_bytecode_verdicts", """
SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'UNRESOLVED' WHEN p_type = 'SMALL' OR p_size % 10 = 1 THEN 'UNAVAILABLE' WHEN p_size % 10 = 2 THEN 'INCOMPLETE' WHEN p_partkey % 2 = 0 THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM part""")
def _(t):
    size = F.col("p_size") % 10
    source = F.when(size != 1, F.md5("p_brand"))
    runtime = F.when(F.col("p_partkey") % 2 == 0, F.md5("p_brand")).otherwise("00")
    return t("part").select("p_partkey", P.bytecode_verdict(F.col("p_type") != "SMALL", source, runtime, size == 2, size == 0).alias("verdict"))
