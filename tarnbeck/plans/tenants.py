"""Tenant lookups, predicates, joins, counts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.operators import aggregates as A
from tarnbeck.operators import relational as R
from tarnbeck.operators.ranking import placed
from tarnbeck.plans.registry import Queries

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles
NOW = "TIMESTAMP_NTZ '1998-01-01 00:00:00'"


def now():
    return F.expr(NOW)

JOB = "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END"


@_q.add("A3_parameterised", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 400000")
def _(t):
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = :status AND o_totalprice >= :least", args={"status": "F", "least": 400000}, orders=t("orders"))


@_q.add("A4_normalised_row", "SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS ts FROM events")
def _(t):
    return t("events").select(F.col("event_id").cast("string").alias("event_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("ts"))


@_q.add("A5_F3_pending_migrations", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS step FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) ORDER BY 1")
def _(t):
    applied = t("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return placed(R.pending(t("part").select("p_partkey"), applied, "p_partkey"), [F.col("p_partkey")], "step").select("p_partkey", F.col("step").cast("long").alias("step"))


@_q.add("A10_capped_listing", """
WITH n AS (SELECT DISTINCT c_name, c_custkey FROM customer WHERE c_acctbal > 5000),
     r AS (SELECT *, row_number() OVER (ORDER BY lower(c_name), c_custkey) AS k, count(*) OVER () AS n FROM n)
SELECT c_custkey, c_name, n > 50 AS truncated FROM r WHERE k <= 50""")
def _(t):
    rows = t("customer").filter("c_acctbal > 5000").select("c_custkey", "c_name")
    return R.capped(rows, "c_custkey", [F.lower("c_name"), F.col("c_custkey")], 50)


@_q.add("A23_restore_checks", """
SELECT 'orders' AS table_name, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer
UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'orphans', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def _(t):
    lost = R.orphans(t("orders"), t("customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey")
    return R.table_counts({"orders": t("orders"), "customer": t("customer"), "lineitem": t("lineitem"), "orphans": lost})


@_q.add("B1_point_lookup", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42")
def _(t):
    return R.lookup(t("customer").select("c_custkey", "c_name", "c_nationkey"), "c_custkey", 42)


@_q.add("B2_tenant_lookup", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 77 AND o_orderstatus = 'F'")
def _(t):
    return R.scoped(t("orders"), "o_custkey", 77).filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus")


@_q.add("B3_B4_public_fields", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(t):
    return t("supplier").drop("s_acctbal")


@_q.add("B5_live_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE nullif(o_orderstatus, 'O') IS NULL")
def _(t):
    return R.live(t("orders").withColumn("deleted_at", F.nullif(F.col("o_orderstatus"), F.lit("O"))), "deleted_at").select("o_orderkey", "o_custkey")


@_q.add("B6_older", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 730 DAY AND o_orderstatus <> 'P'")
def _(t):
    return R.older(t("orders"), "o_orderdate", now() - F.expr("INTERVAL 730 DAYS")).filter("o_orderstatus <> 'P'").select("o_orderkey")


@_q.add("B7_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(t):
    return t("orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@_q.add("B8_optional_predicates", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def _(t):
    rows = R.optional(t("orders"), {"o_orderstatus": "P", "o_orderpriority": None}, {"o_orderstatus": {"P", "O", "F"}})
    return R.page(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 30).select("o_orderkey", "o_custkey")


@_q.add("B9_unless_trial", "SELECT o_orderkey FROM orders WHERE NOT (coalesce(nullif(o_orderpriority, '5-LOW'), '') = '1-URGENT' AND o_orderdate < TIMESTAMP '1998-01-01')")
def _(t):
    plan = F.nullif(F.col("o_orderpriority"), F.lit("5-LOW"))
    return t("orders").filter(R.unless_trial_history(plan, F.col("o_orderdate"), now(), "1-URGENT")).select("o_orderkey")


_gate = "CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END"


@_q.add("B10_eligible", f"SELECT o_orderkey FROM (SELECT *, {_gate} AS gate FROM orders) WHERE o_orderstatus = 'O' AND (gate IS NULL OR gate <= TIMESTAMP '1998-01-01')")
def _(t):
    return t("orders").filter(R.eligible(F.col("o_orderstatus"), F.expr(_gate), now(), "O")).select("o_orderkey")


@_q.add("B11_lease_expired", f"SELECT o_orderkey FROM (SELECT *, {_gate} AS lease FROM orders) WHERE o_orderstatus = 'P' AND lease IS NOT NULL AND lease < TIMESTAMP '1998-01-01'")
def _(t):
    return t("orders").filter((F.col("o_orderstatus") == "P") & R.lease_expired(F.expr(_gate), now())).select("o_orderkey")


@_q.add("B12_B13_valid_tokens", "SELECT o_orderkey, o_orderdate > TIMESTAMP '1998-01-01' AND nullif(o_orderstatus, 'O') IS NULL AS valid FROM orders")
def _(t):
    return t("orders").select("o_orderkey", R.valid_until(F.nullif(F.col("o_orderstatus"), F.lit("O")), F.col("o_orderdate"), now()).alias("valid"))


@_q.add("B14_roles", """
SELECT o.o_orderkey, c.c_mktsegment, coalesce(c.c_mktsegment IN ('BUILDING', 'MACHINERY'), false) AS permitted
FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey""")
def _(t):
    members = t("customer").filter("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    return R.roles(t("orders").select("o_orderkey", "o_custkey"), members, ["o_custkey"], "c_mktsegment", ["BUILDING", "MACHINERY"]).drop("o_custkey")


@_q.add("B15_H3_induced", """
WITH f AS (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 2000)
SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_suppkey IN (SELECT k FROM f) AND l_partkey % 100 IN (SELECT k FROM f)""")
def _(t):
    keep = t("supplier").filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("k"))
    edges = t("lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")).distinct()
    return edges.join(keep.withColumnRenamed("k", "a"), "a", "left_semi").join(keep.withColumnRenamed("k", "b"), "b", "left_semi").select("a", "b")


@_q.add("B16_promotion_window", "SELECT o_orderkey, CASE WHEN o_orderdate BETWEEN TIMESTAMP '1997-11-01' AND TIMESTAMP '1997-11-30' AND o_orderpriority = '2-HIGH' THEN 'PROMO' END AS code FROM orders")
def _(t):
    inside = F.col("o_orderdate").between(F.expr("TIMESTAMP_NTZ '1997-11-01 00:00:00'"), F.expr("TIMESTAMP_NTZ '1997-11-30 00:00:00'"))
    return t("orders").select("o_orderkey", F.when(inside & (F.col("o_orderpriority") == "2-HIGH"), "PROMO").alias("code"))


@_q.add("B17_plan_features", """
SELECT c_custkey, coalesce(c_mktsegment IN ('BUILDING', 'HOUSEHOLD'), false) AS has_feature FROM
(SELECT c_custkey, nullif(c_mktsegment, 'FURNITURE') AS c_mktsegment FROM customer)""")
def _(t):
    plans = t.spark.createDataFrame([("BUILDING", True), ("HOUSEHOLD", True), ("MACHINERY", False)], "plan string, has boolean")
    own = t("customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("plan"))
    return own.join(plans, "plan", "left").select("c_custkey", F.coalesce("has", F.lit(False)).alias("has_feature"))


@_q.add("B19_touch_if_stale", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') IS NULL OR o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 86400 SECOND AS touch FROM orders")
def _(t):
    last = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))
    return t("orders").select("o_orderkey", R.stale(last, now(), 86400).alias("touch"))


@_q.add("B20_trial_status", """
WITH g AS (SELECT o_custkey, max(o_orderdate) > TIMESTAMP '2001-01-01' AS active FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_custkey, CASE WHEN g.active THEN 'active' WHEN g.o_custkey IS NOT NULL THEN 'used' WHEN c_nationkey < 5 THEN 'not_eligible'
  WHEN c_acctbal < 3000 THEN 'verification_required' ELSE 'available' END AS status FROM customer LEFT JOIN g ON o_custkey = c_custkey""")
def _(t):
    grants = t("orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("o_orderdate") > F.expr("TIMESTAMP_NTZ '2001-01-01 00:00:00'")).alias("active"))
    own = t("customer").join(grants, "c_custkey", "left")
    return own.select("c_custkey", R.trial_status(F.col("active").isNotNull(), F.col("active"), F.col("c_nationkey") < 5, F.col("c_acctbal") >= 3000).alias("status"))


@_q.add("C1_memberships", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' ORDER BY c_nationkey, c_custkey")
def _(t):
    return R.star(R.scoped(t("customer"), "c_mktsegment", "MACHINERY").withColumnRenamed("c_nationkey", "n_nationkey"), [(t("nation"), "n_nationkey")]).orderBy("n_nationkey", "c_custkey").select("c_custkey", "n_name")


@_q.add("C2_by_project", "SELECT o_orderkey, l_linenumber, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = 77 AND l_quantity > 10")
def _(t):
    return R.scoped(t("orders"), "o_custkey", 77).join(t("lineitem").filter("l_quantity > 10"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_suppkey")


@_q.add("C5_expired_results", """
SELECT o_orderkey, count(l_orderkey) AS lines FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'
WHERE o_orderstatus <> 'O' AND o_orderdate < TIMESTAMP '1996-01-01' AND c_acctbal > 0 GROUP BY o_orderkey""")
def _(t):
    old = t("orders").filter("o_orderstatus <> 'O' AND o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    paid = old.join(t("customer").filter("c_acctbal > 0").select("c_custkey"), "c_custkey")
    lines = t("lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return paid.join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"))


@_q.add("C18_without_credit", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _(t):
    return t("customer").join(t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@_q.add("C19_members_left_alone", """
SELECT o_custkey AS c FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderpriority <> '1-URGENT') = 0""")
def _(t):
    gone = t("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c")).distinct()
    return gone.join(t("orders").filter("o_orderpriority <> '1-URGENT'").select(F.col("o_custkey").alias("c")), "c", "left_anti")


@_q.add("C21_D21_missing_names", "SELECT list(n ORDER BY n) AS missing FROM (SELECT unnest(['ASIA', 'REGION_0', 'EUROPE', 'REGION_1']) AS n) WHERE n NOT IN (SELECT r_name FROM region)")
def _(t):
    names = t.spark.createDataFrame([(x,) for x in ("ASIA", "REGION_0", "EUROPE", "REGION_1")], "r_name string")
    return R.missing_names(names, t("region"), "r_name")


@_q.add("D1_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P'")
def _(t):
    return t("orders").filter("o_orderstatus = 'P'").agg(F.count("*").alias("n"))


@_q.add("D2_count_and_oldest", "SELECT user_id, count(*) AS n, min(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id")
def _(t):
    return t("events").filter("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@_q.add("D3_status_counts", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS queued, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'F') AS succeeded FROM orders GROUP BY 1")
def _(t):
    return A.status_counts(t("orders").withColumn("job", F.expr(JOB)), ["o_custkey"], "job", ["queued", "running", "succeeded"])


@_q.add("D4_usage_summary", """
WITH u AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS reserved, count(*) FILTER (o_orderstatus = 'F') AS consumed FROM orders GROUP BY 1),
     v AS (SELECT c_custkey, coalesce(reserved, 0) + coalesce(consumed, 0) AS used, CASE WHEN c_nationkey > 2 THEN c_nationkey - 3 END AS lim FROM customer LEFT JOIN u ON o_custkey = c_custkey)
SELECT c_custkey, used, CASE WHEN lim IS NULL THEN 0 ELSE greatest(0, lim - used) END AS remaining, CASE WHEN lim IS NULL THEN 'unlimited' WHEN lim <= 0 OR used >= lim THEN 'blocked'
  WHEN used * 100 >= lim * 90 THEN 'danger' WHEN used * 100 >= lim * 80 THEN 'warning' ELSE 'ok' END AS state FROM v""")
def _(t):
    counts = A.status_counts(t("orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], "o_orderstatus", ["P", "F"])
    limit = F.when(F.col("c_nationkey") > 2, F.col("c_nationkey") - 3).cast("long")
    return t("customer").join(counts, "c_custkey", "left").select("c_custkey", *A.usage(F.col("P"), F.col("F"), limit))


@_q.add("D5_technical_budget", "SELECT p_partkey, CAST((p_size * 13 // 20) * 7 AS BIGINT) AS units FROM part")
def _(t):
    return t("part").select("p_partkey", A.technical_limit(F.col("p_size") * 13, 7).alias("units"))


@_q.add("D6_D20_totals", "SELECT o_custkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS loc, bool_or(l_returnflag = 'R') AS partial FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.bool_or(F.col("l_returnflag") == "R").alias("p"))
    return t("orders").join(lines, "o_orderkey").groupBy("o_custkey").agg(F.sum("q").alias("loc"), F.bool_or("p").alias("partial"))


@_q.add("D9_reasons", "SELECT l_returnflag || l_linestatus AS reason, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1")
def _(t):
    return t("lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("reason")).agg(F.count("*").alias("n")).orderBy("reason")


@_q.add("D10_ordinal", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence FROM events")
def _(t):
    return t("events").select("event_id", A.ordinal(["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).cast("long").alias("occurrence"))


@_q.add("D11_section_summary", "SELECT event_type, count(*) FILTER (value > 50) AS supported, count(*) FILTER (value <= 50 AND value > 10) AS contradicted, count(*) FILTER (value <= 10) AS unverifiable FROM events GROUP BY 1")
def _(t):
    v = F.col("value")
    return t("events").groupBy("event_type").agg(A.count_if(v > 50).alias("supported"), A.count_if((v <= 50) & (v > 10)).alias("contradicted"), A.count_if(v <= 10).alias("unverifiable"))


@_q.add("D13_backed", "SELECT DISTINCT p_brand FROM part WHERE p_size > 45")
def _(t):
    return t("part").filter("p_size > 45").select("p_brand").distinct()


@_q.add("D18_fan_out", "SELECT l_partkey, count(DISTINCT l_suppkey) AS proxies FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 2")
def _(t):
    return t("lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("proxies")).filter("proxies >= 2")


@_q.add("F1_union", "SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity > 48 UNION SELECT p_partkey, p_size FROM part")
def _(t):
    return t("lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).union(t("part").select("p_partkey", F.col("p_size").cast("long"))).distinct()


@_q.add("F2_difference", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def _(t):
    return t("lineitem").filter("l_returnflag = 'R'").select("l_suppkey").distinct().join(t("supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_anti")


@_q.add("F5_id_sets", """
WITH e AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), x AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0)
SELECT (SELECT count(*) FROM e) <> (SELECT count(*) FROM x) AS length_differs, (SELECT count(*) - count(DISTINCT k) FROM e) AS duplicates,
       (SELECT count(DISTINCT k) FROM e WHERE k NOT IN (SELECT k FROM x)) AS unknown, (SELECT count(*) FROM x WHERE k NOT IN (SELECT k FROM e)) AS missing""")
def _(t):
    from tarnbeck.operators.reports import id_set_errors

    got = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return id_set_errors(got, t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@_q.add("F6_F7_arrays", """
WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS have FROM lineitem GROUP BY 1)
SELECT l_orderkey, [x for x in ['A', 'N', 'R'] if NOT list_contains(have, x)] AS missing, list_has_any(have, ['R']) AS hit FROM a""")
def _(t):
    have = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("have"))
    want = F.array(*map(F.lit, "ANR"))
    return have.select("l_orderkey", F.array_except(want, F.col("have")).alias("missing"), F.arrays_overlap("have", F.array(F.lit("R"))).alias("hit"))


@_q.add("F8_keys_matched", """
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'matched' END AS status
FROM (SELECT p_partkey AS k FROM part WHERE p_partkey % 7 <> 0) a FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_partkey % 5 <> 0) b ON a.k = b.k""")
def _(t):
    from tarnbeck.operators.versions import key_status

    k = t("part").select(F.col("p_partkey").alias("k"))
    return key_status(k.filter("k % 7 <> 0"), k.filter("k % 5 <> 0"), ["k"]).select("k", "status")


@_q.add("F9_coverage_delta", """
SELECT a.p_brand AS category, a.s AS before, b.s AS after FROM (SELECT p_brand, CASE WHEN max(p_size) > 49 THEN 'DETECTED' ELSE 'NOT_DETECTED' END AS s FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) a
JOIN (SELECT p_brand, CASE WHEN max(p_size) > 49 THEN 'DETECTED' ELSE 'NOT_DETECTED' END AS s FROM part WHERE p_partkey % 2 = 1 GROUP BY 1) b ON a.p_brand = b.p_brand WHERE a.s <> b.s""")
def _(t):
    side = lambda r, name: t("part").filter(F.col("p_partkey") % 2 == r).groupBy(F.col("p_brand").alias("category")).agg(F.when(F.max("p_size") > 49, "DETECTED").otherwise("NOT_DETECTED").alias(name))
    return side(0, "before").join(side(1, "after"), "category").filter("before <> after")
