"""Scalar functions and text rules on parts, pages, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.functions import scalars as S
from tarnbeck.operators import aggregates as A
from tarnbeck.plans.registry import Queries

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles
MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][a-z]+"


def _paths(t):
    """A path for each part, with the faults that a path check must find."""
    p = F.col("p_partkey")
    return t("part").select(
        "p_partkey",
        F.when(p % 11 == 0, F.concat(F.lit("./src/"), F.col("p_brand"), F.lit(".sol"))).when(p % 11 == 1, F.concat(F.lit("a/../"), F.col("p_name"))).when(p % 11 == 2, F.concat(F.lit("/abs/"), F.col("p_name")))
        .when(p % 11 == 3, F.concat(F.lit("C:/x/"), F.col("p_name"))).when(p % 11 == 4, F.lit("")).when(p % 11 == 5, F.concat(F.lit("lib/"), F.col("p_name"), F.lit(".vy")))
        .when(p % 11 == 6, F.lit("a\\b.sol")).when(p % 11 == 7, F.repeat(F.lit("d/"), 33)).when(p % 11 == 8, F.repeat(F.lit("x"), 401)).otherwise(F.concat(F.lit("docs/"), F.col("p_brand"), F.lit(".MD"))).alias("path"),
    )


_PATHS = r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN './src/' || p_brand || '.sol' WHEN 1 THEN 'a/../' || p_name WHEN 2 THEN '/abs/' || p_name WHEN 3 THEN 'C:/x/' || p_name WHEN 4 THEN ''
 WHEN 5 THEN 'lib/' || p_name || '.vy' WHEN 6 THEN 'a\b.sol' WHEN 7 THEN repeat('d/', 33) WHEN 8 THEN repeat('x', 401) ELSE 'docs/' || p_brand || '.MD' END AS path FROM part)"""


@_q.add("A11_path_check", _PATHS + r"""
SELECT p_partkey, CASE WHEN path = '' THEN 'empty' WHEN length(path) > 400 THEN 'too_long' WHEN contains(path, '\') THEN 'backslash' WHEN path LIKE '/%' OR regexp_matches(path, '^[A-Za-z]:') THEN 'absolute'
 WHEN len(string_split(path, '/')) > 32 THEN 'too_deep' WHEN list_has_any(string_split(path, '/'), ['', '.', '..']) THEN 'bad_segment' END AS error FROM p""")
def _(t):
    return _paths(t).select("p_partkey", S.path_error(F.col("path")).alias("error"))


@_q.add("A12_G4_path_kind", _PATHS + """
SELECT p_partkey, CASE WHEN path LIKE 'lib/%' THEN 'ignored' WHEN path LIKE '%.sol' OR path LIKE '%.vy' THEN 'source' WHEN lower(path) LIKE '%.md' THEN 'document' ELSE 'ignored' END AS kind,
 CASE WHEN path LIKE 'docs/%' THEN replace(replace(path, 'docs/', ''), '.MD', '') END AS stem FROM p""")
def _(t):
    return _paths(t).select("p_partkey", S.path_kind(F.col("path")).alias("kind"), F.when(F.col("path").startswith("docs/"), S.file_stem(F.col("path"))).alias("stem"))


@_q.add("A13_decoded", r"SELECT doc_id, md5(regexp_replace(replace(text, 'e', chr(13) || chr(10)), '\r\n?', chr(10), 'g')) AS digest FROM documents")
def _(t):
    raw = F.concat(F.lit("\ufeff"), F.replace(F.col("text"), F.lit("e"), F.lit("\r\n"))).cast("binary")
    return t("documents").select("doc_id", F.md5(S.decoded(raw)).alias("digest"))


@_q.add("G1_G2_emails", f"""
WITH m AS (SELECT doc_id, regexp_extract(text, '{MAIL}') AS mail FROM documents)
SELECT doc_id, lower(mail) AS email, split_part(lower(mail), '@', 2) AS domain FROM m WHERE mail <> ''""")
def _(t):
    m = t("documents").select("doc_id", F.regexp_extract("text", MAIL, 0).alias("mail")).filter("mail <> ''")
    mail = F.upper(F.concat(F.lit("  "), F.col("mail"), F.lit(" ")))
    return m.select("doc_id", S.normalised_email(mail).alias("email"), S.email_domain(F.col("mail")).alias("domain"))


@_q.add("B18_disposable_domains", f"""
WITH m AS (SELECT doc_id, lower(split_part(regexp_extract(text, '{MAIL}'), '@', 2)) AS domain FROM documents)
SELECT doc_id, domain IN ('mail1.example.com', 'mail3.example.com') OR domain LIKE '%.mail3.example.com' AS disposable FROM m WHERE domain <> ''""")
def _(t):
    listed = t.spark.createDataFrame([("mail1.example.com",), ("mail3.example.com",)], "listed string")
    m = t("documents").select("doc_id", S.email_domain(F.regexp_extract("text", MAIL, 0)).alias("domain")).filter("domain <> ''")
    hit = m.select("doc_id", F.explode(S.domain_suffixes(F.col("domain"))).alias("listed")).join(listed, "listed", "left_semi").select("doc_id").distinct()
    return m.join(hit.withColumn("hit", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("disposable"))


@_q.add("G3_normalised_path", _PATHS + r" SELECT p_partkey, regexp_replace(replace(path, '\', '/'), '^(\./)+', '') AS path FROM p")
def _(t):
    return _paths(t).select("p_partkey", S.normalised_path(F.col("path")).alias("path"))


@_q.add("G5_G6_G35_keys", "SELECT s_suppkey, 'reports/' || s_nationkey || '/' || s_suppkey AS object_key, CAST(NULL AS VARCHAR) AS bad, s_nationkey || ':' || s_name AS scoped, 'reports/' || s_nationkey || '/' || s_suppkey || '.json' AS companion FROM supplier")
def _(t):
    nation, key = F.col("s_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    own = S.workspace_key(F.lit("reports"), nation, key)
    return t("supplier").select("s_suppkey", own.alias("object_key"), S.workspace_key(F.lit("a/b"), nation, key).alias("bad"), S.scoped_key(nation, F.col("s_name")).alias("scoped"), F.concat(own, F.lit(".json")).alias("companion"))


@_q.add("G7_G8_redacted", "SELECT page_id, regexp_replace(url, '\\?.*$', '') AS url, 'key abc_***' AS masked FROM pages")
def _(t):
    return t("pages").select("page_id", S.without_query(F.col("url")).alias("url"), S.masked_keys(F.concat(F.lit("key abc_x"), F.col("page_id"), F.lit("_s3cret")), "abc").alias("masked"))


@_q.add("G9_metadata_check", """
SELECT event_id, regexp_matches(props, '^\\{"k": [0-9]+\\}$') AND CAST(json_extract(props, '$.k') AS INT) BETWEEN 10 AND 90 AND (event_type = 'purchase') = (value > 50) AS valid FROM events""")
def _(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t("events").select("event_id", (F.col("props").rlike(r'^\{"k": [0-9]+\}$') & k.between(10, 90) & ((F.col("event_type") == "purchase") == (F.col("value") > 50))).alias("valid"))


@_q.add("G10_fingerprint", """
SELECT c_custkey, sha256('{"balance":null,"key":' || c_custkey || ',"segment":"' || c_mktsegment || '"}') AS fingerprint FROM customer""")
def _(t):
    return t("customer").select("c_custkey", S.fingerprint(segment=F.col("c_mktsegment"), key=F.col("c_custkey"), balance=F.lit(None).cast("int")).alias("fingerprint"))


@_q.add("G11_G12_G13_hashes", """
SELECT p_partkey, sha256(p_brand || '|' || coalesce(nullif(p_type, 'SMALL'), '') || '|' || p_size) AS id, left(sha256(p_brand || '|' || coalesce(nullif(p_type, 'SMALL'), '') || '|' || p_size), 32) AS target,
 'F-' || left(sha256(p_brand || '|' || p_name), 8) AS short_id, sha1('blob ' || strlen(p_name) || chr(0) || p_name) AS blob FROM part""")
def _(t):
    own = S.joined_hash(F.col("p_brand"), F.nullif(F.col("p_type"), F.lit("SMALL")), F.col("p_size"))
    return t("part").select("p_partkey", own.alias("id"), F.left(own, F.lit(32)).alias("target"), F.concat(F.lit("F-"), F.left(S.joined_hash(F.col("p_brand"), F.col("p_name")), F.lit(8))).alias("short_id"), S.git_blob_sha(F.col("p_name")).alias("blob"))


@_q.add("G14_parsed_time", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch(date_trunc('second', ts)) END AS seconds FROM events")
def _(t):
    text = F.when(F.col("event_id") % 3 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t("events").select("event_id", F.unix_seconds(S.parsed_time(text)).cast("double").alias("seconds"))


@_q.add("G15_G17_G18_waits", """
SELECT o_orderkey, greatest(1, least(60, CAST(ceil(o_totalprice / 5000) AS BIGINT))) AS retry_after, least(5 * CAST(pow(2, o_orderkey % 6) AS BIGINT), 60) AS backoff, o_orderdate + INTERVAL 900 SECOND AS lease FROM orders""")
def _(t):
    return t("orders").select("o_orderkey", S.retry_after(F.col("o_totalprice") / 5000, 60).alias("retry_after"), S.backoff_seconds((F.col("o_orderkey") % 6).cast("int")).alias("backoff"), S.plus_seconds(F.col("o_orderdate"), F.lit(900)).alias("lease"))


@_q.add("G16_usage_state", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_linenumber = 1 THEN 'unlimited' WHEN l_quantity >= 40 THEN 'blocked' WHEN l_quantity * 100 >= 40 * 90 THEN 'danger' WHEN l_quantity * 100 >= 40 * 80 THEN 'warning' ELSE 'ok' END AS state FROM lineitem""")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", A.usage_state(F.col("l_quantity"), F.when(F.col("l_linenumber") != 1, 40)).alias("state"))


@_q.add("G19_G29_defaults", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), o_orderstatus) AS kept, coalesce(nullif(CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderstatus = 'F' THEN 'es' END, ''), 'en') AS language FROM orders")
def _(t):
    lang = F.when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") == "F", "es")
    return t("orders").select("o_orderkey", S.kept_if_null(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.col("o_orderstatus")).alias("kept"), S.language(lang).alias("language"))


@_q.add("G20_G34_service_month", """
WITH a AS (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) + INTERVAL 28 DAY AS anchor FROM orders),
     m AS (SELECT *, (year(o_orderdate) - year(anchor)) * 12 + month(o_orderdate) - month(anchor) AS k0 FROM a),
     k AS (SELECT *, greatest(0, k0 - CASE WHEN anchor + to_months(CAST(k0 AS INT)) > o_orderdate THEN 1 ELSE 0 END) AS k FROM m)
SELECT o_orderkey, anchor + to_months(CAST(k AS INT)) AS period_start, anchor + to_months(CAST(k + 1 AS INT)) AS period_end FROM k""")
def _(t):
    from pyspark.sql import Window

    anchor = F.min("o_orderdate").over(Window.partitionBy("o_custkey")) + F.expr("INTERVAL 28 DAYS")
    rows = t("orders").select("o_orderkey", "o_orderdate", anchor.alias("anchor")).withColumn("m", S.service_month(F.col("anchor"), F.col("o_orderdate")))
    return rows.select("o_orderkey", F.col("m.start").alias("period_start"), F.col("m.end").alias("period_end"))


@_q.add("G21_cutoff", "SELECT o_orderkey, o_orderdate - INTERVAL 90 DAY AS cutoff FROM orders")
def _(t):
    return t("orders").select("o_orderkey", (F.col("o_orderdate") - F.make_dt_interval(days=F.lit(90))).alias("cutoff"))


@_q.add("G22_R2_score", """
WITH p AS (SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 0 ELSE (CASE WHEN l_quantity >= 48 THEN 25 WHEN l_quantity >= 40 THEN 15 WHEN l_quantity >= 25 THEN 7 ELSE 3 END)
  * (CASE l_returnflag WHEN 'A' THEN 10 WHEN 'N' THEN 7 ELSE 4 END) END) AS p10, bool_or(NOT (l_linestatus = 'O' AND l_linenumber = 7) AND l_quantity >= 48 AND l_returnflag = 'A') AS capped FROM lineitem GROUP BY 1),
     s AS (SELECT l_orderkey, capped, greatest(0, 100 - CAST(round_even(CAST(p10 AS DECIMAL(20, 1)) / 10, 0) AS INT)) AS v FROM p),
     c AS (SELECT l_orderkey, CASE WHEN capped THEN least(v, 40) ELSE v END AS score FROM s)
SELECT l_orderkey, score, CASE WHEN score >= 85 THEN 'LOW' WHEN score >= 60 THEN 'MODERATE' WHEN score >= 40 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM c""")
def _(t):
    q = F.col("l_quantity")
    rows = t("lineitem").select(
        "l_orderkey", F.when(q >= 48, "CRITICAL").when(q >= 40, "HIGH").when(q >= 25, "MEDIUM").otherwise("LOW").alias("severity"),
        F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "N", "medium").otherwise("low").alias("confidence"), ((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7)).alias("informational"),
    )
    sums = rows.groupBy("l_orderkey").agg(*A.score(F.col("severity"), F.col("confidence"), F.col("informational")))
    scored = sums.select("l_orderkey", A.score_value(F.col("penalty10"), F.col("capped")).alias("score"))
    return scored.withColumn("band", A.score_band(F.col("score")))


@_q.add("G23_bytes", "SELECT doc_id, strlen(text) AS bytes, strlen(text) > 3000 AS over_budget FROM documents")
def _(t):
    return t("documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), (F.octet_length("text") > 3000).alias("over_budget"))


@_q.add("G24_elided", "SELECT doc_id, CASE WHEN length(text) <= 150 THEN text ELSE left(text, 100) || '…' || right(text, 50) END AS shown FROM documents")
def _(t):
    return t("documents").select("doc_id", S.elided(F.col("text"), 100, 50).alias("shown"))


@_q.add("G26_patch_pattern", "SELECT doc_id, regexp_matches(text, '(?is)license.*version') AS hit FROM documents")
def _(t):
    return t("documents").select("doc_id", F.col("text").rlike("(?is)license.*version").alias("hit"))


@_q.add("G27_json_shapes", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'p' || user_id ELSE 'q' || user_id END AS price FROM events")
def _(t):
    user = F.col("user_id").cast("string")
    one = F.concat(F.lit('{"items":{"data":[{"price":{"id":"p'), user, F.lit('"}}]}}'))
    two = F.concat(F.lit('{"price":"q'), user, F.lit('"}'))
    return t("events").select("event_id", S.first_item(F.when(F.col("event_id") % 2 == 0, one).otherwise(two), "price").alias("price"))


@_q.add("G28_status_alias", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'unpaid' END AS status FROM orders")
def _(t):
    known = F.create_map(F.lit("O"), F.lit("active"), F.lit("P"), F.lit("unpaid"))
    return t("orders").select("o_orderkey", F.try_element_at(known, F.col("o_orderstatus")).alias("status"))


@_q.add("G30_C17_version_ranges", """
WITH b(name, introduced, fixed) AS (VALUES ('a', 5000010, 5000020), ('b', 4000000, 6000003), ('c', 7000002, 7000010)),
     v AS (SELECT p_partkey, (p_partkey % 9) * 1000000 + p_size AS n FROM part)
SELECT p_partkey, name FROM v JOIN b ON introduced <= n AND n < fixed""")
def _(t):
    from tarnbeck.operators.ranges import affected_versions

    bugs = t.spark.createDataFrame([("a", "0.5.10", "0.5.20"), ("b", "0.4.0", "0.6.3"), ("c", "0.7.2", "0.7.10"), ("d", "bad", "0.9.0")], "name string, introduced string, fixed string")
    own = t("part").select("p_partkey", F.concat(F.lit("0."), (F.col("p_partkey") % 9).cast("string"), F.lit("."), F.col("p_size").cast("string")).alias("version"))
    return affected_versions(own, bugs, "version").select("p_partkey", "name")


@_q.add("G31_array_length", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size END AS n FROM part")
def _(t):
    kind = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("uint256["), F.col("p_size"), F.lit("]"))).otherwise("uint256[]")
    return t("part").select("p_partkey", S.array_length(kind).alias("n"))


@_q.add("G32_bytecode_metadata", "SELECT p_partkey, left(sha256(p_name), 40) AS stripped, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE md5(p_brand) END AS hex FROM part")
def _(t):
    code = F.concat(F.left(F.sha2("p_name", 256), F.lit(40)), F.lit("a2"), F.repeat(F.lit("00"), 50), F.lit("0033"))
    own = F.when(F.col("p_partkey") % 3 == 0, "0xabc").otherwise(F.concat(F.lit("0X"), F.upper(F.md5("p_brand"))))
    return t("part").select("p_partkey", S.without_metadata(code).alias("stripped"), S.normalised_hex(own).alias("hex"))


@_q.add("G33_G36_chains", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 137 WHEN 2 THEN 777 WHEN 3 THEN 10 END AS chain_id,
 CASE c_custkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN false END AS consistent FROM customer""")
def _(t):
    from tarnbeck.operators.ranges import resolved_chain

    chains = t.spark.createDataFrame([(1, "mainnet"), (1, "eth"), (10, "optimism"), (137, "polygon")], "chain_id int, alias string")
    k = F.col("c_custkey") % 5
    own = t("customer").select("c_custkey", F.when(k == 0, "Mainnet").when(k == 1, "137").when(k == 2, "777").when(k == 3, "OPTIMISM").otherwise("nowhere").alias("chain"), F.lit("ETH").alias("declared"))
    return resolved_chain(own, chains, "chain", "declared").select("c_custkey", "chain_id", "consistent")


@_q.add("G37_compiler_consistency", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'UNAVAILABLE' WHEN p_size % 4 = 1 THEN 'INCOMPLETE' WHEN p_partkey % 2 = 0 THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM part")
def _(t):
    from tarnbeck.operators.reports import first_failure

    reported = F.when(F.col("p_size") % 4 != 0, "0.8.1")
    decoded = F.when(F.col("p_size") % 4 != 1, F.when(F.col("p_partkey") % 2 == 0, "0.8.1").otherwise("0.8.2"))
    return t("part").select("p_partkey", first_failure([("UNAVAILABLE", reported.isNull()), ("INCOMPLETE", decoded.isNull()), ("MATCH", reported == decoded)], "MISMATCH").alias("status"))


@_q.add("G38_mode_limits", "SELECT doc_id, CASE WHEN lang = 'en' THEN coalesce(CASE WHEN doc_id % 10 = 0 THEN 9000 END, 2000) ELSE coalesce(CASE WHEN doc_id % 10 = 0 THEN 9000 END, 500) END < n_chars AS exceeded FROM documents")
def _(t):
    modes = t.spark.createDataFrame([("en", 2000), ("fr", 500), ("de", 500), ("es", 500)], "lang string, most int")
    override = F.when(F.col("doc_id") % 10 == 0, 9000)
    return t("documents").join(modes, "lang", "left").select("doc_id", (F.coalesce(override, F.col("most")) < F.col("n_chars")).alias("exceeded"))


@_q.add("I6_selection_trigger", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'blocking_reason' WHEN strlen(text) > 4000 THEN 'over_budget' END AS why FROM documents")
def _(t):
    return t("documents").select("doc_id", S.selection_trigger(F.col("lang") == "de", F.octet_length("text"), F.lit(4000)).alias("why"))


@_q.add("I14_deadline_share", "SELECT o_orderkey, round(least(30, 600.0 / n) + (600.0 - least(30, 600.0 / n) * n) * o_totalprice / w, 4) AS seconds FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS w FROM orders)")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    return t("orders").select("o_orderkey", F.round(S.deadline_share(F.lit(600.0), F.count("*").over(w), F.col("o_totalprice"), F.sum("o_totalprice").over(w)), 4).alias("seconds"))


@_q.add("L15_minimal_proxy", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN left(sha1(s_name), 40) END AS target FROM supplier")
def _(t):
    code = F.concat(F.lit("363d3d373d3d3d363d73"), F.sha1(F.col("s_name").cast("binary")), F.when(F.col("s_suppkey") % 2 == 0, "5af43d82803e903d91602b57fd5bf3").otherwise("5af4"))
    return t("supplier").select("s_suppkey", S.minimal_proxy_target(code).alias("target"))
