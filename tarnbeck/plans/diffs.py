"""Version comparisons, groups of equal identity, drift and gates. The second version of a table is the first one with
some rows gone, some new and some changed, by the key's remainder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.operators import reports as P
from tarnbeck.operators import versions as V
from tarnbeck.plans.registry import Queries

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles

_AB = """a AS (SELECT p_partkey AS k, p_brand, p_type, p_size, p_name FROM part WHERE p_partkey % 7 <> 0),
     b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'Brand#X' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS p_type, p_size + CAST(p_partkey % 17 = 0 AS INT) AS p_size, p_name FROM part WHERE p_partkey % 5 <> 0)"""
_CHANGED = "[x for x in [CASE WHEN a.p_brand IS DISTINCT FROM b.p_brand THEN 'p_brand' END, CASE WHEN a.p_type IS DISTINCT FROM b.p_type THEN 'p_type' END, CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'p_size' END] if x IS NOT NULL]"
COMPARED = ["p_brand", "p_type", "p_size"]


def _sides(t):
    k = F.col("p_partkey")
    p = t("part").withColumn("k", k)
    a = p.filter("k % 7 <> 0").select("k", *COMPARED, "p_name")
    b = p.filter("k % 5 <> 0").select("k", F.when(k % 11 == 0, "Brand#X").otherwise(F.col("p_brand")).alias("p_brand"), F.when(k % 13 != 0, F.col("p_type")).alias("p_type"), (F.col("p_size") + (k % 17 == 0).cast("int")).alias("p_size"), "p_name")
    return a, b


@_q.add("C14_N2_structural_diff", f"""
WITH {_AB} SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN len({_CHANGED}) > 0 THEN 'modified' ELSE 'matched' END AS status,
 CASE WHEN a.k IS NULL OR b.k IS NULL THEN [] ELSE {_CHANGED} END AS changed FROM a FULL JOIN b ON a.k = b.k""")
def _(t):
    return V.key_status(*_sides(t), ["k"], COMPARED).select("k", "status", "changed")


_DIFF = """
WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS severity, o_custkey || '/' || o_totalprice AS second FROM orders),
     a AS (SELECT id, severity, second FROM o WHERE id % 7 <> 0),
     b AS (SELECT CASE WHEN id % 10 = 3 THEN id + 1000000 ELSE id END AS id, CASE WHEN id % 11 = 0 THEN 'X' ELSE severity END AS severity, second FROM o WHERE id % 9 <> 0),
     m AS (SELECT a.id, b.id AS after_id, CASE WHEN a.severity IS DISTINCT FROM b.severity THEN 'modified' ELSE 'matched' END AS status, 'key' AS matched_by FROM a JOIN b ON a.id = b.id),
     l AS (SELECT *, count(*) OVER (PARTITION BY second) AS n FROM a WHERE id NOT IN (SELECT id FROM m)), r AS (SELECT *, count(*) OVER (PARTITION BY second) AS n FROM b WHERE id NOT IN (SELECT id FROM m)),
     s AS (SELECT l.id, r.id AS after_id, 'modified' AS status, 'secondary' AS matched_by FROM l JOIN r ON l.second = r.second AND l.n = 1 AND r.n = 1),
     d AS (SELECT * FROM m UNION ALL SELECT * FROM s UNION ALL SELECT id, NULL, 'resolved', NULL FROM l WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT NULL, id, 'new', NULL FROM r WHERE id NOT IN (SELECT after_id FROM s))"""


def _diffed(t):
    """(id, after_id, status, matched_by) of two snapshots of the orders, as findings."""
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("severity"), F.concat_ws("/", F.col("o_custkey").cast("string"), F.col("o_totalprice").cast("string")).alias("second"))
    i = F.col("id")
    b = o.filter("id % 9 <> 0").select(F.when(i % 10 == 3, i + 1000000).otherwise(i).alias("id"), F.when(i % 11 == 0, "X").otherwise(F.col("severity")).alias("severity"), "second")
    return V.matched_findings(o.filter("id % 7 <> 0"), b, "id", "second", ["severity"]).select("id", F.col("after_key").alias("after_id"), "status", "matched_by")


@_q.add("C13_N1_finding_diff", _DIFF + " SELECT * FROM d")
def _(t):
    return _diffed(t)


@_q.add("C15_duplicate_identities", """
SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n, list_sort(list(o_orderkey)) AS records, [x for x in [CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'status' END, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'priority' END] if x IS NOT NULL] AS disagree
FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    g = t("orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list("o_orderkey")).alias("records"),
        F.array_compact(F.array(F.when(F.countDistinct("o_orderstatus") > 1, F.lit("status")), F.when(F.countDistinct("o_orderpriority") > 1, F.lit("priority")))).alias("disagree"),
    )
    return g.filter("n > 1")


@_q.add("C16_cross_chain_identity", "SELECT p_name, count(DISTINCT p_brand) AS chains, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def _(t):
    return t("part").filter("p_size > 25").groupBy("p_name").agg(F.countDistinct("p_brand").alias("chains"), F.count("*").alias("n")).filter("chains >= 2")


@_q.add("C20_chains_agree", """
SELECT p_brand, CASE WHEN count(nullif(p_type, 'SMALL')) = 0 THEN 'UNAVAILABLE' WHEN count(DISTINCT nullif(p_type, 'SMALL')) = 1 THEN 'MATCH' ELSE 'MISMATCH' END AS status, count(*) FILTER (p_size > 20) AS resolved FROM part WHERE p_size > 44 GROUP BY 1""")
def _(t):
    kind = F.nullif(F.col("p_type"), F.lit("SMALL"))
    status = F.when(F.count(kind) == 0, "UNAVAILABLE").when(F.countDistinct(kind) == 1, "MATCH").otherwise("MISMATCH")
    return t("part").filter("p_size > 44").groupBy("p_brand").agg(status.alias("status"), F.count(F.when(F.col("p_size") > 20, 1)).alias("resolved"))


@_q.add("N3_chain_context", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 1) AS host, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 2) AS lang FROM pages")
def _(t):
    pattern = "^https?://([^/]+)/([a-z]+)/([0-9]+)"
    return t("pages").select("page_id", F.regexp_extract("url", pattern, 1).alias("host"), F.regexp_extract("url", pattern, 2).alias("lang"))


@_q.add("N4_change_impact", f"""
WITH {_AB}, d AS (SELECT coalesce(a.p_name, b.p_name) AS owner, a.k AS ak, b.k AS bk, a.p_type AS a_t, b.p_type AS b_t, a.k IS NULL OR b.k IS NULL OR len({_CHANGED}) > 0 AS real FROM a FULL JOIN b ON a.k = b.k AND a.p_name = b.p_name),
     g AS (SELECT owner, bool_or(real) AS any_, list_sort([x for x in [CASE WHEN bool_or(bk IS NULL) THEN 'removed' END, CASE WHEN bool_or(ak IS NOT NULL AND bk IS NOT NULL AND a_t IS DISTINCT FROM b_t) THEN 'type_changed' END] if x IS NOT NULL]) AS reasons FROM d GROUP BY 1)
SELECT owner, CASE WHEN len(reasons) > 0 THEN 'REVIEW_RECOMMENDED' WHEN any_ THEN 'SAFE' ELSE 'NO_CHANGE' END AS verdict, reasons FROM g""")
def _(t):
    changes = V.key_status(*_sides(t), ["p_name", "k"], COMPARED)
    rules = {"removed": F.col("status") == "removed", "type_changed": (F.col("status") == "modified") & F.array_contains("changed", "p_type")}
    return V.change_impact(changes, "p_name", rules).withColumnRenamed("p_name", "owner")


@_q.add("N5_storage_layout", """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus AS t FROM orders WHERE o_orderpriority <> '5-LOW'),
     a AS (SELECT o_custkey, t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM o WHERE o_orderkey % 9 <> 0),
     b AS (SELECT o_custkey, t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM o WHERE o_orderkey < 14000 OR o_orderkey % 9 <> 0),
     j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS c, coalesce(a.pos, b.pos) AS pos, a.t AS a_t, b.t AS b_t, a.pos IS NULL AS grown FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.pos = b.pos),
     g AS (SELECT c AS o_custkey, min(pos) FILTER (NOT grown AND a_t IS DISTINCT FROM b_t) AS first_divergence, bool_or(grown) AS grown FROM j GROUP BY 1)
SELECT o_custkey, CASE WHEN first_divergence IS NOT NULL THEN 'collision_risk' WHEN grown THEN 'safe_append' ELSE 'unchanged' END AS status, first_divergence FROM g""")
def _(t):
    o = t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    out = V.layout_change(o.filter("o_orderkey % 9 <> 0"), o.filter("o_orderkey < 14000 OR o_orderkey % 9 <> 0"), "o_custkey", ["o_orderkey"], ["o_orderstatus"], F.col("o_orderpriority") == "5-LOW")
    return out.select("o_custkey", "status", F.col("first_divergence").cast("long").alias("first_divergence"))


_GAPS = f"""WITH {_AB}, g AS (SELECT coalesce(a.p_brand || a.k, b.p_brand || b.k) AS x, coalesce(a.k, b.k) AS k, coalesce(a.k, b.k) % 100 AS owner, a.p_size AS size_before, b.p_size - CAST(b.k % 19 = 0 AS INT) AS size_after FROM a FULL JOIN b ON a.k = b.k),
 s AS (SELECT k, owner, size_before, size_after, CASE WHEN size_before IS NULL THEN 'added' WHEN size_after IS NULL THEN 'removed' WHEN size_after < size_before THEN 'shrunk' WHEN size_after > size_before THEN 'expanded' ELSE 'unchanged' END AS status FROM g)"""


def _gaps(t):
    a, b = _sides(t)
    return V.gap_change(a, b.withColumn("p_size", F.col("p_size") - (F.col("k") % 19 == 0).cast("int")), ["k"], "p_size")


@_q.add("N6a_upgrade_gap", _GAPS + " SELECT k, status, size_before, size_after FROM s")
def _(t):
    return _gaps(t).select("k", "status", "size_before", "size_after")


@_q.add("N6a_upgrade_gap_overall", _GAPS + " SELECT owner, CASE max(CASE status WHEN 'removed' THEN 4 WHEN 'shrunk' THEN 3 WHEN 'expanded' THEN 2 WHEN 'added' THEN 2 ELSE 1 END) WHEN 4 THEN 'removed' WHEN 3 THEN 'shrunk' WHEN 2 THEN 'expanded' ELSE 'unchanged' END AS overall FROM s GROUP BY 1")
def _(t):
    return V.gap_overall(_gaps(t).withColumn("owner", F.col("k") % 100), "owner")


@_q.add("N6b_initializer_safety", """
WITH f AS (SELECT p_partkey AS k, p_brand AS c, p_size AS v, p_partkey % 6 = 0 AS guarded_before, p_partkey % 4 = 0 AS guarded_after, p_partkey % 3 <> 0 AS in_before, p_partkey % 10 <> 0 AS in_after FROM part),
     g AS (SELECT k, 'guard_removed' AS issue FROM f WHERE in_before AND in_after AND (k % 6 = 2) AND NOT guarded_after),
     n AS (SELECT *, row_number() OVER (PARTITION BY c, v ORDER BY k) AS nth FROM f WHERE NOT in_before AND in_after)
SELECT * FROM g UNION ALL SELECT k, 'version_reused' FROM n WHERE nth > 1 OR EXISTS (SELECT 1 FROM f WHERE in_before AND f.c = n.c AND f.v = n.v)""")
def _(t):
    from pyspark.sql import Window

    k = F.col("p_partkey")
    f = t("part").select(k.alias("k"), F.col("p_brand").alias("c"), F.col("p_size").alias("v"), (k % 6 == 2).alias("before"), (k % 4 == 0).alias("after"), (k % 3 != 0).alias("in_before"), (k % 10 != 0).alias("in_after"))
    old, new = f.filter("in_before").select("k", "before"), f.filter("in_after").select("k", "after")
    lost = old.join(new, "k").filter("before AND NOT after").select("k", F.lit("guard_removed").alias("issue"))
    fresh = f.filter("in_after AND NOT in_before").withColumn("nth", F.row_number().over(Window.partitionBy("c", "v").orderBy("k")))
    claimed = f.filter("in_before").select("c", "v", F.lit(True).alias("claimed")).distinct()
    reused = fresh.join(claimed, ["c", "v"], "left").filter("nth > 1 OR claimed").select("k", F.lit("version_reused").alias("issue"))
    return lost.union(reused)


@_q.add("N6c_upgrade_guard", """
SELECT p_partkey FROM part WHERE p_partkey % 4 < 3 AND p_size % 2 = 0 AND p_type <> 'SMALL'""")
def _(t):
    k = F.col("p_partkey")
    signature = F.when(k % 4 == 0, "_authorizeUpgrade(address)").when(k % 4 == 1, "upgradeTo(address)").when(k % 4 == 2, "upgradeToAndCall(address,bytes)").otherwise("upgradeTo(uint256)")
    rows = t("part").withColumns({"signature": signature, "modifiers": F.when(F.col("p_size") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("onlyOwner")))})
    watched = ["_authorizeUpgrade(address)", "upgradeTo(address)", "upgradeToAndCall(address,bytes)"]
    return rows.filter(F.col("signature").isin(watched) & (F.size("modifiers") == 0) & (F.col("p_type") != "SMALL")).select("p_partkey")


@_q.add("N6d_zero_address", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 'no_constructor' WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN 'flagged' ELSE 'clean' END AS status FROM part""")
def _(t):
    k = F.col("p_partkey")
    params = F.when(k % 5 != 4, F.array(F.lit("uint256"), F.when(F.col("p_size") % 2 == 0, "address").otherwise("uint256")))
    args = F.when(k % 3 == 0, F.array(F.lit("0x0"), F.lit("0x" + "0" * 40))).when(k % 3 == 1, F.array(F.lit("0x0"))).otherwise(F.array(F.lit("7"), F.lit("0x12")))
    rows = t("part").select("p_partkey", params.alias("params"), args.alias("args"))
    zero = F.exists(F.arrays_zip("params", "args"), lambda x: (x["params"] == "address") & F.coalesce(x["args"].rlike("^0x0+$"), F.lit(False)))
    return rows.select("p_partkey", F.when(F.col("params").isNull(), "no_constructor").when(zero, "flagged").otherwise("clean").alias("status"))


@_q.add("N6e_implementation_constructor", "SELECT l_suppkey AS proxy, count(DISTINCT l_partkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size >= 45 GROUP BY 1")
def _(t):
    implementations = t("part").filter("p_size >= 45").select(F.col("p_partkey").alias("l_partkey"))
    return t("lineitem").join(implementations, "l_partkey").groupBy(F.col("l_suppkey").alias("proxy")).agg(F.countDistinct("l_partkey").alias("n"))


@_q.add("N7_pr_gate", _DIFF + """, n AS (SELECT CASE WHEN after_id % 10 = 3 THEN after_id - 1000000 ELSE after_id END AS o_orderkey FROM d WHERE status = 'new')
SELECT o_custkey, CASE WHEN bool_or(o_orderstatus IN ('F', 'P') AND coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 1 END >= 2, true) AND o_orderkey % 10 IN (1, 2)) THEN 'FAIL' ELSE 'PASS' END AS gate
FROM orders JOIN n USING (o_orderkey) GROUP BY 1""")
def _(t):
    p = F.col("o_orderpriority")
    after = F.col("after_id")
    new = _diffed(t).filter("status = 'new'").select(F.when(after % 10 == 3, after - 1000000).otherwise(after).alias("o_orderkey"))
    rows = t("orders").join(new, "o_orderkey").withColumns({"confidence": F.when(p == "1-URGENT", "high").when(p == "2-HIGH", "medium").when(p == "3-MEDIUM", "low").when(p == "5-LOW", "strange"), "category": F.concat(F.lit("c"), (F.col("o_orderkey") % 10).cast("string"))})
    blocks = P.gate(rows, "o_orderstatus", "confidence", "category", ["F", "P"], "medium", ["c1", "c2"])
    return rows.groupBy("o_custkey").agg(F.when(F.bool_or(blocks), "FAIL").otherwise("PASS").alias("gate"))


@_q.add("N8_advisory_gate", """
WITH m AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'FLAG' WHEN 'view' THEN 'OK' ELSE 'NOT_ASSESSED' END AS mark FROM events WHERE value > 75)
SELECT user_id, CASE WHEN bool_or(mark = 'FLAG') THEN 'FAIL' WHEN bool_or(mark = 'OK') THEN 'PASS' ELSE 'INCOMPLETE' END AS overall FROM m GROUP BY 1""")
def _(t):
    marks = t("events").filter("value > 75").select("user_id", P.advisory(F.col("event_type"), ["error"], ["view"]).alias("mark"))
    return P.advisory_overall(marks, "user_id", "mark")


@_q.add("K8_snapshot_drift", """
WITH e AS (SELECT user_id, event_id, ts, event_type, CASE WHEN value < 90 THEN CAST(floor(value) AS INT) END AS code, CASE WHEN event_id % 6 <> 0 THEN event_type END AS owner FROM events),
     l AS (SELECT *, lag(owner) OVER w AS lo, lag(code) OVER w AS lc, lag(event_type) OVER w AS le, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, [x for x in [CASE WHEN lo <> owner THEN 'owner' END, CASE WHEN le <> event_type THEN 'event_type' END] if x IS NOT NULL] AS changed,
 CASE WHEN lc IS NULL OR code IS NULL THEN 'UNAVAILABLE' WHEN lc = code THEN 'MATCH' ELSE 'MISMATCH' END AS code_status FROM l WHERE n > 1""")
def _(t):
    e = t("events").select("user_id", "event_id", "ts", "event_type", F.when(F.col("value") < 90, F.floor("value").cast("int")).alias("code"), F.when(F.col("event_id") % 6 != 0, F.col("event_type")).alias("owner"))
    return V.drift(e, ["user_id"], [F.col("ts"), F.col("event_id")], ["owner", "event_type"], "code").select("event_id", "changed", "code_status")


@_q.add("K9_snapshot_hash", """
WITH h AS (SELECT event_id, sha256('{"event_type":"' || event_type || '","k":' || CAST(floor(value) AS INT) % 3 || '}') AS hash, user_id, ts FROM events)
SELECT event_id, hash, coalesce(hash = lag(hash) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS identical_to_last FROM h""")
def _(t):
    from pyspark.sql import Window

    from tarnbeck.functions.scalars import fingerprint

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t("events").withColumn("hash", fingerprint(event_type=F.col("event_type"), k=F.floor("value").cast("int") % 3))
    return e.select("event_id", "hash", F.coalesce(F.col("hash") == F.lag("hash").over(w), F.lit(False)).alias("identical_to_last"))
