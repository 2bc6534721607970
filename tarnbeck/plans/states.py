"""Queue, ledger and account states: orders as jobs, customers as tenants, events as requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.operators import state as S
from tarnbeck.plans.registry import Queries

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles


def now():
    return F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00'")



@_q.add("J1_insert_or_ignore", """
WITH o AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT o_custkey AS k, 'order ' || min(o_orderkey) AS v FROM orders GROUP BY 1)
SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)""")
def _(t):
    old = t("customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    new = t("orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("v"), "o_orderkey")
    return S.insert_or_ignore(old, new, ["k"], [F.col("o_orderkey")])


@_q.add("J2_conditional_update", "SELECT o_orderkey, o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' AS changed, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(t):
    out = S.set_if(t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < now()), o_orderstatus=F.lit("F"))
    return out.select("o_orderkey", "changed", "o_orderstatus")


@_q.add("J3_live_name_unique", "SELECT p_brand, p_name, count(*) AS n FROM part WHERE p_type <> 'SMALL' GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    from tarnbeck.operators.versions import duplicate_keys

    return duplicate_keys(t("part").filter("p_type <> 'SMALL'"), ["p_brand", "p_name"])


@_q.add("J4_admission", """
WITH p AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'plan_unknown' WHEN o_totalprice < 20000 THEN 'no_source_code' WHEN o_totalprice > 450000 THEN 'loc_per_scan_limit_exceeded' WHEN pending >= 5 THEN 'too_many_pending_jobs' ELSE 'admitted' END AS code
FROM orders JOIN p USING (o_custkey)""")
def _(t):
    pending = t("orders").groupBy("o_custkey").agg(F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("pending"))
    price = F.col("o_totalprice")
    checks = [("plan_unknown", F.col("o_orderpriority") == "5-LOW"), ("no_source_code", price < 20000), ("loc_per_scan_limit_exceeded", price > 450000), ("too_many_pending_jobs", F.col("pending") >= 5)]
    return t("orders").join(pending, "o_custkey").select("o_orderkey", S.admission(F.lit("admitted"), checks).alias("code"))


@_q.add("J5_quota_reserve", """
WITH RECURSIVE r AS (SELECT user_id, event_id, CAST(value * 100 AS BIGINT) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 f AS (SELECT user_id, event_id, n, CASE WHEN x <= 30000 THEN x ELSE 0 END AS used, x <= 30000 AS granted FROM r WHERE n = 1
  UNION ALL SELECT r.user_id, r.event_id, r.n, CASE WHEN f.used + x <= 30000 THEN f.used + x ELSE f.used END, f.used + x <= 30000 FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
SELECT event_id, granted FROM f""")
def _(t):
    e = t("events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("at"), F.bround(F.col("value") * 100).cast("long").alias("x"), F.lit(30000).cast("long").alias("most"))
    return S.reserve(e, "user_id", ["at", "event_id"], "x", "most", "event_id")


@_q.add("J6_settle", """
WITH f AS (SELECT l_orderkey, arg_min(CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'succeeded' END, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS outcome FROM lineitem WHERE l_quantity > 25 GROUP BY 1)
SELECT o_custkey, CAST(coalesce(sum(o_orderkey % 7) FILTER (outcome IS NULL), 0) AS BIGINT) AS reserved, CAST(coalesce(sum(o_orderkey % 7) FILTER (outcome = 'succeeded'), 0) AS BIGINT) AS consumed, CAST(coalesce(sum(o_orderkey % 7) FILTER (outcome = 'failed'), 0) AS BIGINT) AS released
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1""")
def _(t):
    ends = t("lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("succeeded").alias("outcome"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    return S.settle(t("orders").withColumn("units", F.col("o_orderkey") % 7), ends, "o_orderkey", "o_custkey", "units")


_REAP = """WITH j AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'running' ELSE 'queued' END AS status, CAST(o_orderkey % 3 AS INT) AS attempts, o_orderdate AS lease FROM orders),
 r AS (SELECT *, status = 'running' AND lease < TIMESTAMP '1998-01-01' AS reaped FROM j)"""


@_q.add("J8_K3_reap", _REAP + """
SELECT o_orderkey, reaped, CASE WHEN NOT reaped THEN status WHEN attempts + 1 < 3 THEN 'queued' ELSE 'failed' END AS next_status, attempts + CAST(reaped AS INT) AS next_attempts,
 CASE WHEN reaped AND attempts + 1 < 3 THEN TIMESTAMP '1998-01-01' + to_seconds(least(60, 5 * CAST(pow(2, attempts) AS INT))) END AS next_eligible_at FROM r""")
def _(t):
    jobs = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "running").otherwise("queued").alias("status"), (F.col("o_orderkey") % 3).cast("int").alias("attempts"), F.col("o_orderdate").alias("lease"))
    return S.reap(jobs, now(), "status", "attempts", "lease").select("o_orderkey", "reaped", "next_status", "next_attempts", "next_eligible_at")


@_q.add("J9_J12_transitions", """
SELECT o_orderkey, (o_orderstatus, o_orderpriority) IN (('O', '1-URGENT'), ('P', '2-HIGH'), ('P', '1-URGENT')) AS applied,
 CASE WHEN (o_orderstatus, o_orderpriority) IN (('O', '1-URGENT'), ('P', '2-HIGH'), ('P', '1-URGENT')) THEN o_orderpriority ELSE o_orderstatus END AS next_state FROM orders""")
def _(t):
    edges = t.spark.createDataFrame([("O", "1-URGENT"), ("P", "2-HIGH"), ("P", "1-URGENT")], "`from` string, `to` string")
    return S.transition(t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), edges, "o_orderstatus", "o_orderpriority").select("o_orderkey", "applied", "next_state")


@_q.add("J10_fenced", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 7 + 1 = l_linenumber AND o_orderstatus = l_linestatus) AS applied FROM lineitem""")
def _(t):
    jobs = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("l_linenumber"), F.col("o_orderstatus").alias("l_linestatus"))
    return S.fenced(t("lineitem"), jobs, ["l_orderkey", "l_linenumber", "l_linestatus"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "applied")


@_q.add("J11_first_grant", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS granted FROM events WHERE event_type = 'signup' GROUP BY 1")
def _(t):
    return t("events").filter("event_type = 'signup'").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("granted"))


@_q.add("J13_J15_upsert", """
WITH o AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS k, 'new' AS v, c_acctbal > 2000 AS g FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.g THEN n.v ELSE o.v END AS v, CASE WHEN n.k IS NULL THEN 'unchanged' WHEN NOT n.g THEN 'ignored' WHEN o.k IS NULL THEN 'created' ELSE 'updated' END AS outcome FROM o FULL JOIN n ON o.k = n.k""")
def _(t):
    c = t("customer").withColumn("k", F.col("c_custkey"))
    return S.upsert(c.filter("k % 2 = 0").withColumn("v", F.col("c_mktsegment")), c.filter("k % 3 = 0").withColumns({"v": F.lit("new"), "g": F.col("c_acctbal") > 2000}), "k", "v", "g")


@_q.add("J14_K6_newest_event", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def _(t):
    return S.newest(t("events"), "user_id", "event_type", "ts", "event_id")


@_q.add("J16_K5_idempotent", """
WITH d AS (SELECT event_id, user_id % 50 AS key, md5(event_type) AS fp, ts FROM events)
SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN first_value(fp) OVER w = fp THEN 'replay' ELSE 'conflict' END AS outcome FROM d WINDOW w AS (PARTITION BY key ORDER BY ts, event_id)""")
def _(t):
    d = t("events").select("event_id", (F.col("user_id") % 50).alias("key"), F.md5("event_type").alias("fp"), "ts")
    return S.idempotent(d, "key", "fp", [F.col("ts"), F.col("event_id")]).select("event_id", "outcome")


@_q.add("J17_single_use", "SELECT o_orderkey, o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1998-01-01' - INTERVAL 10 MINUTE AND o_custkey % 2 = 0 AS consumed FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 1 DAY")
def _(t):
    kept = t("orders").filter(F.col("o_orderdate") >= now() - F.expr("INTERVAL 1 DAY"))
    ok = (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") > now() - F.expr("INTERVAL 10 MINUTES")) & (F.col("o_custkey") % 2 == 0)
    return kept.select("o_orderkey", ok.alias("consumed"))


@_q.add("J18_replace_active", """
SELECT s_suppkey AS id, s_nationkey AS tenant, s_nationkey % 2 <> 0 AS active FROM supplier UNION ALL SELECT 1000000 + n_nationkey, n_nationkey, true FROM nation WHERE n_nationkey % 2 = 0""")
def _(t):
    new = t("nation").filter("n_nationkey % 2 = 0").select((F.lit(1000000).cast("long") + F.col("n_nationkey")).alias("id"), F.col("n_nationkey").alias("tenant"), F.lit(True).alias("active"))
    old = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("tenant"), F.lit(True).alias("active"))
    replaced = old.join(new.select("tenant", F.lit(True).alias("hit")), "tenant", "left")
    return S.set_if(replaced, F.col("hit"), active=F.lit(False)).select("id", "tenant", "active").unionByName(new)


@_q.add("J19_key_cap", """
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 10 AS active FROM part""")
def _(t):
    from pyspark.sql import Window

    return t("part").select("p_partkey", (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) <= 10).alias("active"))


@_q.add("J20_token_sessions", """
WITH c AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup')
SELECT user_id, count(*) FILTER (n = 1) AS sessions, count(*) FILTER (n > 1) AS refused FROM c GROUP BY 1""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    c = t("events").filter("event_type = 'signup'").withColumn("n", F.row_number().over(w))
    return c.groupBy("user_id").agg(F.count(F.when(F.col("n") == 1, 1)).alias("sessions"), F.count(F.when(F.col("n") > 1, 1)).alias("refused"))


@_q.add("J21_retention_purge", "SELECT page_id, page_id % 3 = 0 AS changed, CASE WHEN page_id % 3 <> 0 THEN md5(html) END AS html FROM pages")
def _(t):
    rows = t("pages").select("page_id", F.md5("html").alias("html"), (F.lit(2) - F.col("page_id") % 3).alias("age"))
    return S.set_if(rows, F.col("age") > 1, html=F.lit(None).cast("string")).select("page_id", "changed", "html")


@_q.add("J22_workspace_delete", """
SELECT 'orders' AS table_name, count(*) AS n FROM orders WHERE o_custkey = 42 UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 42)
UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey = 42""")
def _(t):
    from tarnbeck.operators.relational import scoped, table_counts

    own = scoped(t("orders"), "o_custkey", 42)
    return table_counts({"orders": own, "lineitem": t("lineitem").join(own.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi"), "customer": scoped(t("customer"), "c_custkey", 42)})


@_q.add("J23_J24_A19_decisions", """
SELECT event_id, CASE WHEN event_type NOT IN ('signup', 'purchase', 'error') THEN 'ignored:unhandled_event_type' WHEN user_id % 10 = 0 THEN 'rejected:unknown_customer' WHEN event_type = 'error' AND value < 20 THEN 'ignored:stale' ELSE 'applied' END AS code FROM events""")
def _(t):
    from tarnbeck.operators.reports import first_failure

    kind = F.col("event_type")
    rules = [("ignored:unhandled_event_type", ~kind.isin("signup", "purchase", "error")), ("rejected:unknown_customer", F.col("user_id") % 10 == 0), ("ignored:stale", (kind == "error") & (F.col("value") < 20))]
    return t("events").select("event_id", first_failure(rules, "applied").alias("code"))


@_q.add("K1_window_counts", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM events")
def _(t):
    rows = t("events").withColumn("second", F.unix_seconds(F.col("ts").cast("timestamp")))
    return rows.select("event_id", S.attempts_in_window(rows, "user_id", "second", 86400).alias("n"))


@_q.add("K4_backoff_gate", "SELECT o_orderkey, o_orderdate + to_seconds(least(60, 5 * CAST(pow(2, o_orderkey % 5) AS INT))) <= TIMESTAMP '1998-01-01' AS open FROM orders")
def _(t):
    from tarnbeck.functions.scalars import backoff_seconds, plus_seconds

    return t("orders").select("o_orderkey", (plus_seconds(F.col("o_orderdate"), backoff_seconds((F.col("o_orderkey") % 5).cast("int"))) <= now()).alias("open"))


@_q.add("K10_apply_grace", """
SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' - INTERVAL 600 HOUR AND TIMESTAMP '1998-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
def _(t):
    recent = t("orders").filter(F.col("o_orderdate").between(now() - F.expr("INTERVAL 600 HOURS"), now()))
    return recent.join(t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")
