"""Files arrays, archives, bundles, manifests, listings and records made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.plans.registry import Queries
from tarnbeck.sources import files as X

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles


@_q.add("A1_catalog", "SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def _(t):
    from tarnbeck.sources.tables import register

    register(t.spark, t.sf_dir, ["nation", "customer"])
    return t.spark.sql("SELECT n_name, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")


@_q.add("A2_database_files", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey > 100 AND c_nationkey IN (3, 7, 11) AND c_acctbal >= 0")
def _(t):
    from tarnbeck.sources.folders import new_folder, stored
    from tarnbeck.sources.readers import register, write_sqlite_files

    register(t.spark)
    folder = new_folder(t.spark, "database")
    stored(write_sqlite_files(t("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").repartition(3, "c_custkey"), folder, "customer"), "database-files")
    rows = t.spark.read.format("sqlite_files").option("path", folder).option("table", "customer").option("key", "c_custkey").load()
    return rows.filter("c_custkey > 100 AND c_nationkey IN (3, 7, 11) AND c_acctbal >= 0").select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal")


@_q.add("A10_paged_listing", """
WITH n AS (SELECT DISTINCT c_custkey, c_name FROM customer WHERE c_nationkey < 20),
     r AS (SELECT *, row_number() OVER (ORDER BY lower(c_name), c_custkey) AS k, count(*) OVER () AS n FROM n)
SELECT c_custkey, c_name, n > 80 AS truncated FROM r WHERE k <= 80""")
def _(t):
    from pyspark.sql import Window

    from tarnbeck.operators.relational import capped
    from tarnbeck.sources.folders import new_folder
    from tarnbeck.sources.readers import register

    register(t.spark)
    folder, own = new_folder(t.spark, "pages"), Window.partitionBy("c_nationkey")
    # each nation is a source of pages of ten; customers of the next key's nation are listed twice
    c = t("customer").select("c_nationkey", "c_custkey", "c_name")
    c = c.union(c.filter("c_custkey % 9 = 0").withColumn("c_nationkey", (F.col("c_nationkey") + 1) % 25)).dropDuplicates(["c_nationkey", "c_custkey"])
    c = c.withColumns({"page": F.floor((F.row_number().over(own.orderBy("c_custkey")) - 1) / 10).cast("int") + 1, "total": F.count("*").over(own)})
    item = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    pages = c.groupBy(F.col("c_nationkey").alias("source"), "page").agg(F.max("total").alias("total"), F.collect_list(item).alias("items"))
    text = F.to_json(F.struct(F.col("total").alias("total_count"), "items"))
    # a file holds 256 pages of a source, a line each
    pages = pages.select(text.alias("value"), "source", F.floor((F.col("page") - 1) / 256).cast("int").alias("block"), "page")
    pages.repartition("source", "block").sortWithinPartitions("source", "block", "page").drop("page").write.partitionBy("source", "block").text(folder)
    rows = t.spark.read.format("paged_listing").option("path", folder).option("page_size", 10).option("pages", 4).option("file_pages", 256).load()
    found = rows.select(F.from_json("item", "id long, name string, nation int").alias("x")).select("x.*").join(t("customer").filter("c_nationkey < 20").select(F.col("c_custkey").alias("id")), "id", "left_semi")
    found = found.select(F.col("id").alias("c_custkey"), F.col("name").alias("c_name"))
    return capped(found, "c_custkey", [F.lower("c_name"), F.col("c_custkey")], 80)


@_q.add("A6_listing", "SELECT 'nation.parquet' AS name UNION ALL SELECT 'region.parquet'")
def _(t):
    return X.listed(t.spark, t.sf_dir, "{nation,region}.parquet").select("name")


@_q.add("A7_files_array", """
SELECT s_suppkey, p AS place, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'f' || p || '.sol' END AS path, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown_key' END AS error
FROM supplier, (VALUES (0), (1)) v(p) WHERE s_suppkey % 5 <> 0 AND (s_suppkey % 3 <> 0 OR p = 0) AND NOT (s_suppkey % 3 = 0) UNION ALL SELECT s_suppkey, NULL, NULL, CASE WHEN s_suppkey % 5 = 0 THEN 'malformed' ELSE 'unknown_key' END FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 = 0""")
def _(t):
    k = F.col("s_suppkey")
    own = F.lit('[{"path":"f0.sol","content":"a"},{"path":"f1.sol","content":"b"}]')
    bad = F.lit('[{"path":"f0.sol","content":"a","mode":"x"}]')
    rows = t("supplier").select("s_suppkey", F.when(k % 5 == 0, "{no json").when(k % 3 == 0, bad).otherwise(own).alias("json"))
    return X.files_array(rows, "s_suppkey", "json").select("s_suppkey", "place", "path", "error")


@_q.add("A8_archive")
def _(t):
    import base64
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr(zipfile.ZipInfo("a.sol"), "contract A {}")
        z.writestr(zipfile.ZipInfo("docs/b.md"), "text")
    good = base64.b64encode(buffer.getvalue()).decode()
    k = F.col("s_suppkey")
    rows = t("supplier").select("s_suppkey", F.when(k % 4 == 0, "!").when(k % 4 == 1, F.base64(F.lit(b"none"))).otherwise(good).alias("data"))
    return X.archive_entries(rows, "s_suppkey", "data").select("s_suppkey", "path", F.length("content").alias("size"), "error")


@_q.add("A8_varied_archives", """
WITH f AS (SELECT p_partkey // 30 AS g, p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'a' || chr(92) || p_partkey || '.sol' ELSE 'é/' || p_partkey || '.sol' END AS path, repeat(p_name, CAST(p_size % 5 AS INT)) AS content, p_partkey % 13 = 0 AS link FROM part WHERE p_partkey // 30 % 4 <> 3),
 e AS (SELECT g, path, CASE WHEN link THEN 'link' WHEN k % 11 = 0 THEN 'backslash' END AS error, content FROM f)
SELECT g, path, CASE WHEN error IS NULL THEN sha256(content) END AS digest, error FROM e UNION ALL SELECT DISTINCT p_partkey // 30, NULL, NULL, 'not_an_archive' FROM part WHERE p_partkey // 30 % 4 = 3""")
def _(t):
    k = F.col("p_partkey")
    path = F.when(k % 11 == 0, F.concat(F.lit("a\\"), k.cast("string"), F.lit(".sol"))).otherwise(F.concat(F.lit("é/"), k.cast("string"), F.lit(".sol")))
    files = t("part").select(F.floor(k / 30).alias("g"), path.alias("path"), F.expr("repeat(p_name, p_size % 5)").alias("content"), (k % 13 == 0).alias("link"))
    # every fourth archive lost its head
    cut = F.when(F.col("g") % 4 == 3, F.base64(F.lit(b"PK no more"))).otherwise(F.col("data"))
    rows = X.zipped(files, "g", link="link").select("g", cut.alias("data"))
    return X.archive_entries(rows, "g", "data").select("g", "path", F.sha2("content", 256).alias("digest"), "error")


@_q.add("A9_blob_hashes", "SELECT doc_id, sha1('blob ' || strlen(text) || chr(0) || text) AS sha, strlen(text) > 20000 AS over_limit FROM documents")
def _(t):
    from tarnbeck.functions.scalars import git_blob_sha

    return t("documents").select("doc_id", git_blob_sha(F.col("text")).alias("sha"), (F.octet_length("text") > 20000).alias("over_limit"))


_MANIFEST = r"""WITH f AS (SELECT doc_id, lang, CASE WHEN doc_id % 50 = 1 THEN 'Src/' || (doc_id - 1) || '.SOL' WHEN doc_id % 50 = 2 THEN '/abs.sol' ELSE 'src/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.sol' ELSE '.txt' END END AS path, regexp_replace(regexp_replace(text, '^\x{feff}', ''), '\r\n?', chr(10), 'g') AS text FROM documents)"""


def _sources(t):
    i = F.col("doc_id")
    path = F.when(i % 50 == 1, F.concat(F.lit("Src/"), (i - 1).cast("string"), F.lit(".SOL"))).when(i % 50 == 2, "/abs.sol").otherwise(F.concat(F.lit("src/"), i.cast("string"), F.when(i % 3 == 0, ".sol").otherwise(".txt")))
    return t("documents").select("doc_id", "lang", path.alias("path"), F.col("text").alias("content"))


@_q.add("A14_A29_manifest", _MANIFEST + """
SELECT lang, path, CASE WHEN lower(path) LIKE '%.sol' THEN 'source' ELSE 'document' END AS kind, strlen(text) AS size, sha256(text) AS sha256,
 CASE WHEN path = '/abs.sol' THEN 'absolute' WHEN count(*) OVER (PARTITION BY lang, lower(path)) > 1 THEN 'duplicate' END AS error FROM f""")
def _(t):
    return X.manifest(_sources(t), "lang").select("lang", "path", "kind", "size", "sha256", "error")


@_q.add("A15_bundle", """
WITH f AS (SELECT source, 'd' || doc_id || '.sol' AS path, regexp_replace(text, '\n$', '') AS text FROM documents)
SELECT source, sha256(string_agg('=== FILE: ' || path || ' ===' || chr(10) || text || chr(10) || '=== END FILE ===' || chr(10), '' ORDER BY path)) AS digest FROM f GROUP BY 1""")
def _(t):
    files = t("documents").select("source", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".sol")).alias("path"), F.col("text").alias("content"))
    return X.bundle(files, "source").select("source", F.sha2("bundle", 256).alias("digest"))


@_q.add("A16_unbundled", r"""
SELECT source, 'd' || doc_id || '.sol' AS path, md5(regexp_replace(text, '\n$', '')) AS digest, CAST(NULL AS VARCHAR) AS issue FROM documents""")
def _(t):
    files = t("documents").select("source", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".sol")).alias("path"), F.col("text").alias("content"))
    return X.unbundled(X.bundle(files, "source"), "source", "bundle").select("source", "path", F.md5("content").alias("digest"), "issue")


@_q.add("A15_A16_bundle_files", """
WITH f AS (SELECT lang, 'd/' || doc_id || '.txt' AS path, regexp_replace(text, '\\n$', '') AS content FROM documents WHERE lang IS NOT NULL AND doc_id IS NOT NULL AND text NOT LIKE '%=== %')
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY path) - 1 AS INTEGER) AS place, path, sha256(content) AS digest FROM f""")
def _(t):
    from tarnbeck.sources.folders import new_folder

    folder = new_folder(t.spark, "bundles")
    files = t("documents").filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text NOT LIKE '%=== %'").select("lang", F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    X.write_bundles(files, "lang", folder)
    return X.read_bundles(t.spark, folder, "lang").select("lang", "place", "path", F.sha2("content", 256).alias("digest"))


@_q.add("A17_marker_guard", "SELECT doc_id, doc_id % 7 = 0 AS refused FROM documents")
def _(t):
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("\n=== END FILE ===\n"))).otherwise(F.col("text"))
    return t("documents").select("doc_id", X.has_marker(text).alias("refused"))


@_q.add("A22_expired_dumps", "SELECT 'dump-' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || '.sql' AS name FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01' UNION ALL SELECT 'dump-' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || '.sql' FROM orders WHERE false")
def _(t):
    rows = t("orders").select(F.concat(F.lit("dump-"), F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss"), F.lit(".sql")).alias("name"))
    notes = t("region").select(F.concat(F.lit("note-"), F.col("r_name")).alias("name"))
    return X.expired(rows.union(notes), "name", F.expr("TIMESTAMP_NTZ '1995-03-01 00:00:00'"))


@_q.add("A24_schema_checks", "SELECT 'o_custkey:int' AS gap UNION ALL SELECT 'o_gone:string'")
def _(t):
    gaps = X.schema_gaps(t("orders"), {"o_orderkey": "bigint", "o_custkey": "int", "o_gone": "string", "o_orderdate": "timestamp_ntz"})
    return t.spark.createDataFrame([(g,) for g in gaps], "gap string")


@_q.add("A27_rendered", """
WITH f AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'P' THEN 'MEDIUM' ELSE 'LOW' END AS s, replace(o_orderpriority, '-', '<_') AS title FROM orders)
SELECT o_custkey, md5('# Report' || chr(10) || chr(10) || string_agg('- **' || s || '** ' || replace(replace(title, '<', '&lt;'), '_', '\\_'), chr(10) ORDER BY s, o_orderkey)) AS digest FROM f GROUP BY 1""".replace("'\\\\_'", "'\\_'"))
def _(t):
    s = F.when(F.col("o_orderstatus") == "F", "HIGH").when(F.col("o_orderstatus") == "P", "MEDIUM").otherwise("LOW")
    out = X.rendered(t("orders"), "o_custkey", F.replace("o_orderpriority", F.lit("-"), F.lit("<_")), s, [s, F.col("o_orderkey")])
    return out.select("o_custkey", F.md5("markdown").alias("digest"))


@_q.add("A27_reports", r"""
WITH f AS (SELECT o_custkey AS report, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'P' THEN 'LOW' ELSE 'INFORMATIONAL' END AS s, CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'P' THEN 2 ELSE 1 END AS k, replace(replace(o_orderpriority, '-', '<_'), '<', '&lt;') AS h FROM orders),
 g AS (SELECT report, coalesce(string_agg('- **' || s || '** ' || replace(h, '_', '\_') || chr(10), '' ORDER BY k DESC, id) FILTER (k > 1), 'No finding in the analysed scope.' || chr(10)) AS m, coalesce(string_agg('- ' || replace(h, '_', '\_') || chr(10), '' ORDER BY id) FILTER (k = 1), '') AS mi,
  coalesce(string_agg('<p><b>' || s || '</b> ' || h || '</p>', '' ORDER BY k DESC, id) FILTER (k > 1), '<p>No finding in the analysed scope.</p>') AS w, coalesce(string_agg('<p>' || h || '</p>', '' ORDER BY id) FILTER (k = 1), '') AS wi FROM f GROUP BY 1),
 a AS (SELECT c_custkey AS report, c_mktsegment = 'BUILDING' AS pro, coalesce('Score: ' || CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 101 END, 'Score unavailable') AS score, coalesce(m, 'No finding in the analysed scope.' || chr(10)) AS m, coalesce(mi, '') AS mi, coalesce(w, '<p>No finding in the analysed scope.</p>') AS w, coalesce(wi, '') AS wi,
  'An automated check of what was sent, not a formal security audit. Without a finding there may still be faults.' AS notice, CASE WHEN c_nationkey % 2 = 0 THEN 'DETECTED' ELSE 'NOT_ASSESSED' END AS one FROM customer LEFT JOIN g ON report = c_custkey)
SELECT report, md5('# Report' || chr(10) || chr(10) || notice || chr(10) || chr(10) || score || chr(10) || chr(10) || '| Category | Status |' || chr(10) || '|-|-|' || chr(10) || '| SC01 | ' || one || ' |' || chr(10) || '| SC02 | NOT_DETECTED |' || chr(10) || chr(10) || '## Findings' || chr(10) || chr(10) || m
  || CASE WHEN mi = '' THEN '' ELSE chr(10) || '## Informational Notices' || chr(10) || chr(10) || mi END) AS markdown,
 CASE WHEN pro THEN md5('<h1>Report</h1><p>' || notice || '</p><p>' || score || '</p><table><tr><td>SC01</td><td>' || one || '</td></tr><tr><td>SC02</td><td>NOT_DETECTED</td></tr></table><h2>Findings</h2>' || w || CASE WHEN wi = '' THEN '' ELSE '<h2>Informational Notices</h2>' || wi END) END AS html FROM a""")
def _(t):
    s, c = F.col("o_orderstatus"), t("customer")
    severity = F.when(s == "F", "HIGH").when(s == "P", "LOW").otherwise("INFORMATIONAL")
    rank = F.when(s == "F", 4).when(s == "P", 2).otherwise(1)
    findings = t("orders").select(F.col("o_custkey").alias("report"), F.col("o_orderkey").alias("id"), rank.alias("severity_rank"), severity.alias("severity"), F.replace("o_orderpriority", F.lit("-"), F.lit("<_")).alias("title"), (rank == 1).alias("informational"))
    k = F.col("c_custkey")
    reports = c.select(k.alias("report"), F.when(F.col("c_mktsegment") == "BUILDING", "pro").otherwise("quick").alias("mode"), F.when(k % 5 > 0, k % 101).alias("score"))
    one = F.when(F.col("c_nationkey") % 2 == 0, "DETECTED").otherwise("NOT_ASSESSED")
    coverage = c.select(k.alias("report"), F.lit("SC02").alias("category"), F.lit("NOT_DETECTED").alias("status")).union(c.select(k, F.lit("SC01"), one))
    return X.rendered_reports(reports, findings, coverage).select("report", F.md5("markdown").alias("markdown"), F.md5("html").alias("html"))


@_q.add("A28_chain_records", """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 3 THEN '0x' || left(sha1(s_name), 40) END AS address, s_suppkey % 4 = 0 AS verified, CASE s_suppkey % 4 WHEN 0 THEN 'complete' WHEN 3 THEN 'failed' ELSE 'partial' END AS completeness FROM supplier""")
def _(t):
    k = F.col("s_suppkey") % 4
    sha = F.upper(F.sha1(F.col("s_name").cast("binary")))
    raw = F.when(k == 0, '{"verified": true}').when(k == 1, '{"verified": "true"}').otherwise('{"verified": 1}')
    return X.ingested_record(t("supplier").select("s_suppkey", F.when(k == 3, "0x12").otherwise(sha).alias("address"), raw.alias("raw")), "s_suppkey")


@_q.add("A18_object_store", """
SELECT doc_id, md5(CASE WHEN doc_id % 8 = 0 THEN 'again' ELSE text END) AS digest FROM documents WHERE lang = 'de' AND source = 'src3' AND (doc_id % 4 <> 0 OR doc_id % 8 = 0)""")
def _(t):
    from tarnbeck.streaming.limits import new_folder

    top = new_folder(t.spark, "objects")
    rows = t("documents").select(F.col("lang").alias("category"), F.col("source").alias("workspace"), F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"), "doc_id")
    X.put_objects(rows, top)
    X.delete_objects(rows.filter("doc_id % 4 = 0"), top)
    X.put_objects(rows.filter("doc_id % 8 = 0").withColumn("content", F.lit("again")), top)
    return X.get_objects(t.spark, top, "de", "src3").select(F.col("name").cast("long").alias("doc_id"), F.md5("content").alias("digest"))


@_q.add("A18_existing", "SELECT doc_id, doc_id % 4 <> 0 AS there FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT -doc_id, FALSE FROM documents")
def _(t):
    from tarnbeck.sources.folders import new_folder

    top = new_folder(t.spark, "objects")
    rows = t("documents").select(F.lit("c").alias("category"), F.col("lang").alias("workspace"), F.col("doc_id").cast("string").alias("name"), F.lit("x").alias("content"), "doc_id").fillna({"workspace": "none"})
    X.put_objects(rows, top)
    X.delete_objects(rows.filter("doc_id % 4 = 0"), top)
    never = rows.withColumn("name", (-F.col("doc_id")).cast("string"))
    found = X.existing_objects(t.spark, top, rows.filter("doc_id % 3 > 0").union(never).select("category", "workspace", "name"))
    return found.select(F.col("name").cast("long").alias("doc_id"), "there")


@_q.add("A20_word_list", "SELECT DISTINCT lower(p_brand) AS word FROM part")
def _(t):
    from tarnbeck.streaming.limits import new_folder

    path = new_folder(t.spark, "words")
    lines = t("part").select(F.concat(F.lit("  ."), F.upper("p_brand"), F.lit(". "))).distinct().union(t("region").select(F.concat(F.lit("# "), "r_name")))
    lines.toDF("value").write.text(path)
    return X.word_list(t.spark, path)


@_q.add("A21_eval_cases", "SELECT 'case' || n_nationkey AS \"case\", n_name AS target FROM nation")
def _(t):
    from tarnbeck.streaming.limits import new_folder

    # a case is a file: its stem names it. Spark names part files itself, so the stem stands in the document's folder here
    path = new_folder(t.spark, "cases")
    rows = t("nation").select(F.concat(F.lit("case"), F.col("n_nationkey").cast("string")).alias("stem"), F.col("n_name").alias("target"))
    rows.write.partitionBy("stem").json(path)
    return X.json_cases(t.spark, path, "target string").select(F.col("stem").alias("case"), "target")


@_q.add("C6_update_from", """
WITH c AS (SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT o_orderkey, o_orderkey IN (SELECT k FROM c) AS changed, CASE WHEN o_orderkey IN (SELECT k FROM c) THEN 'claimed' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def _(t):
    from tarnbeck.operators.ranking import first_by
    from tarnbeck.operators.state import set_if

    queued = t("orders").filter("o_orderstatus = 'O'")
    found = first_by(queued, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", F.lit(True).alias("hit"))
    rows = t("orders").select("o_orderkey", "o_orderstatus").join(found, "o_orderkey", "left")
    return set_if(rows, F.col("hit"), o_orderstatus=F.lit("claimed")).select("o_orderkey", "changed", "o_orderstatus")
