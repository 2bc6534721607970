"""Rankings, picks, range joins and unique-name joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.operators import aggregates as A
from tarnbeck.operators import ranges as G
from tarnbeck.operators import ranking as K
from tarnbeck.operators import relational as R
from tarnbeck.plans.registry import Queries

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles

_QUEUE = """WITH w AS (SELECT o_custkey, max(o_orderdate) FILTER (o_orderstatus = 'F') AS last, min(o_orderdate) AS made FROM orders GROUP BY 1),
     j AS (SELECT o_orderkey, o_custkey, o_orderdate, CAST(o_orderpriority = '1-URGENT' AS INT) AS p, last, made FROM orders JOIN w USING (o_custkey) WHERE o_orderstatus = 'O')"""


def _jobs(t):
    w = t("orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("last"), F.min("o_orderdate").alias("made"))
    return t("orders").filter("o_orderstatus = 'O'").join(w, "o_custkey").withColumn("p", (F.col("o_orderpriority") == "1-URGENT").cast("int"))


@_q.add("C4_E1_fair_pick", _QUEUE + " SELECT o_orderkey, o_custkey FROM j ORDER BY last - to_seconds(300 * p) ASC NULLS FIRST, p DESC, made, o_orderdate, o_orderkey LIMIT 1")
def _(t):
    jobs = _jobs(t)
    return jobs.orderBy(*K.fair_order(jobs, "last", "p", "made", "o_orderdate", "o_orderkey")).limit(1).select("o_orderkey", "o_custkey")


@_q.add("E2_round_robin", """
WITH j AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS round, min(o_orderdate) OVER (PARTITION BY o_custkey) AS made FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, round, row_number() OVER (ORDER BY round, made, o_custkey) AS place FROM j""")
def _(t):
    jobs = t("orders").filter("o_orderstatus = 'O'")
    jobs = jobs.join(jobs.groupBy("o_custkey").agg(F.min("o_orderdate").alias("made")), "o_custkey")
    return K.round_robin(jobs, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "made").select("o_orderkey", F.col("round").cast("long").alias("round"), F.col("place").cast("long").alias("place"))


@_q.add("E2_J7_claims")
def _(t):
    epoch = lambda c: F.unix_seconds(F.col(c).cast("timestamp")).cast("double")
    jobs = _jobs(t).select((F.col("o_custkey") % 20).alias("queue"), F.col("o_custkey").alias("tenant"), F.col("o_orderkey").alias("job"), F.col("p").alias("priority"), epoch("o_orderdate").alias("created"))
    tenants = _jobs(t).select((F.col("o_custkey") % 20).alias("queue"), F.col("o_custkey").alias("tenant"), epoch("last").alias("last_claimed"), epoch("made").alias("tenant_created"), F.lit(1e9).alias("now")).distinct()
    return K.claims(jobs, tenants, "queue", 25)


@_q.add("E3_oldest_credit", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS credit FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def _(t):
    return K.first_by(t("orders").filter("o_orderstatus = 'P'"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("credit"))


@_q.add("E4_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 300")
def _(t):
    return R.page(t("orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 100, 300)


@_q.add("E5_priority_ranking", "SELECT l_suppkey, l_partkey, count(*) AS score, rank() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC) AS place FROM lineitem GROUP BY 1, 2")
def _(t):
    from pyspark.sql import Window

    sums = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("score"))
    return sums.withColumn("place", F.rank().over(Window.partitionBy("l_suppkey").orderBy(F.desc("score"))).cast("long"))


_SIG = """s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_shipdate, CASE WHEN l_tax > 0.06 THEN 'high' WHEN l_tax > 0.03 THEN 'medium' ELSE 'low' END AS risk, 'T' || (l_linenumber % 5) AS tier, l_suppkey % 10 AS family FROM lineitem)"""


def _signals(t):
    tax = F.col("l_tax")
    return t("lineitem").withColumns({"risk": F.when(tax > 0.06, "high").when(tax > 0.03, "medium").otherwise("low"), "tier": F.concat(F.lit("T"), (F.col("l_linenumber") % 5).cast("string")), "family": F.col("l_suppkey") % 10})


@_q.add("D7_signal_units", f"WITH {_SIG} SELECT l_orderkey, l_linenumber, count(*) AS n, list_sort(list(DISTINCT family)) AS families, list_sort(list(DISTINCT tier)) AS tiers FROM s GROUP BY 1, 2")
def _(t):
    return _signals(t).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("family")).alias("families"), F.sort_array(F.collect_set("tier")).alias("tiers"))


_SCORE = f"""WITH {_SIG}, sc AS (SELECT l_orderkey, 2 * sum(CASE risk WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) + 3 * count(*) FILTER (tier = 'T3') + count(DISTINCT family) + 2 * max(CAST(l_quantity > 40 AS INT)) AS score FROM s GROUP BY 1)"""


@_q.add("D8_target_score", _SCORE + " SELECT l_orderkey, CAST(score AS BIGINT) AS score FROM sc")
def _(t):
    return K.target_score(_signals(t), ["l_orderkey"], F.col("risk"), F.col("tier"), F.col("family"), F.col("l_quantity") > 40).select("l_orderkey", F.col("score").cast("long").alias("score"))


@_q.add("E6_target_ranking", _SCORE + """
, r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderstatus = 'P' AS INT) DESC, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE -score END, o_orderkey) AS rank FROM orders JOIN sc ON l_orderkey = o_orderkey)
SELECT o_orderkey, rank, CASE WHEN rank <= 5 THEN 'SELECTED' ELSE 'NOT_REVIEWED' END AS state FROM r""")
def _(t):
    scores = K.target_score(_signals(t), ["l_orderkey"], F.col("risk"), F.col("tier"), F.col("family"), F.col("l_quantity") > 40).withColumnRenamed("l_orderkey", "o_orderkey")
    rows = t("orders").join(scores, "o_orderkey")
    return K.capped_targets(rows, "o_custkey", F.col("o_orderstatus") == "P", F.col("score"), ["o_orderkey"], 5).select("o_orderkey", F.col("rank").cast("long").alias("rank"), "state")


@_q.add("E7_merged_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderstatus = 'O' AS INT) DESC, o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy((F.col("o_orderstatus") == "O").desc(), "o_orderpriority", "o_orderdate", "o_orderkey")
    return t("orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@_q.add("E8_E10_severity_order", """
SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'P' THEN 3 ELSE 1 END DESC, o_orderkey) AS place FROM orders""")
def _(t):
    severity = F.when(F.col("o_orderstatus") == "F", "CRITICAL").when(F.col("o_orderstatus") == "P", "HIGH").otherwise("LOW")
    return K.placed(t("orders").select("o_orderkey", "o_orderstatus"), [A.rank_of(severity, A.SEVERITIES).desc(), F.col("o_orderkey")]).select("o_orderkey", "place")


@_q.add("E11_lifecycle", """
WITH d AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day FROM events), p AS (SELECT DISTINCT user_id, date_trunc('day', ts) AS day, event_type FROM events),
     g AS (SELECT d.user_id, d.day, k.event_type, p.day IS NOT NULL AS now FROM d JOIN (SELECT DISTINCT user_id, event_type FROM p) k ON d.user_id = k.user_id LEFT JOIN p ON p.user_id = d.user_id AND p.day = d.day AND p.event_type = k.event_type),
     l AS (SELECT *, lag(now, 1, false) OVER w AS last, coalesce(bool_or(now) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ever FROM g WINDOW w AS (PARTITION BY user_id, event_type ORDER BY day)),
     s AS (SELECT *, CASE WHEN now AND NOT ever THEN 'new' WHEN now AND NOT last THEN 'regressed' WHEN now THEN 'open' WHEN last THEN 'resolved' WHEN ever THEN 'absent' ELSE 'unseen' END AS status FROM l)
SELECT user_id, CAST(day AS DATE) AS day, event_type, status, bool_or(status = 'regressed') OVER (PARTITION BY user_id, event_type ORDER BY day) AS ever_regressed FROM s""")
def _(t):
    rows = t("events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return K.lifecycle_grid(rows, rows, ["user_id"], "event_type", "day")


_CHANGES = """
WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), p AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events),
     g AS (SELECT d.user_id, d.day, k.event_type, p.day IS NOT NULL AS now FROM d JOIN (SELECT DISTINCT user_id, event_type FROM p) k ON d.user_id = k.user_id LEFT JOIN p ON p.user_id = d.user_id AND p.day = d.day AND p.event_type = k.event_type),
     l AS (SELECT *, lag(now, 1, false) OVER w AS last, coalesce(bool_or(now) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ever FROM g WINDOW w AS (PARTITION BY user_id, event_type ORDER BY day)),
     s AS (SELECT *, CASE WHEN now AND NOT ever THEN 'new' WHEN now AND NOT last THEN 'regressed' WHEN NOT now AND last THEN 'resolved' END AS status FROM l),
     c AS (SELECT user_id, event_type, day, status, bool_or(status = 'regressed') OVER (PARTITION BY user_id, event_type ORDER BY day) AS ever_regressed FROM s WHERE status IS NOT NULL)"""


def _changes(t):
    rows = t("events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    return K.lifecycle(rows, rows, ["user_id"], "event_type", "day")


@_q.add("E11_history", _CHANGES + " SELECT * FROM c")
def _(t):
    return _changes(t)


@_q.add("E11_current", _CHANGES + """
SELECT user_id, event_type, CASE WHEN max_by(status, day) = 'resolved' THEN 'resolved' ELSE 'present' END AS status, bool_or(ever_regressed) AS ever_regressed FROM c GROUP BY 1, 2""")
def _(t):
    return K.current_status(_changes(t), ["user_id"], "event_type", "day")


@_q.add("E11_status_at", _CHANGES + """
SELECT u.user_id, u.event_type, DATE '2024-01-15' AS day, (SELECT max_by(status, day) FROM c WHERE c.user_id = u.user_id AND c.event_type = u.event_type AND day <= DATE '2024-01-15') AS status
FROM (SELECT DISTINCT user_id, event_type FROM events) u""")
def _(t):
    asked = t("events").select("user_id", "event_type").distinct().withColumn("day", F.lit("2024-01-15").cast("date"))
    return K.status_at(_changes(t), asked, ["user_id"], "event_type", "day")


@_q.add("C9_E9_enclosing_span", """
WITH s AS (SELECT o_orderkey AS span, o_custkey % 150 AS user_id, o_orderkey % 28 AS a, o_orderkey % 28 + o_custkey % 9 AS z FROM orders),
     p AS (SELECT event_id, user_id, day(ts) - 1 AS pt FROM events),
     h AS (SELECT event_id, span, row_number() OVER (PARTITION BY event_id ORDER BY z - a, a, span) AS k FROM p JOIN s USING (user_id) WHERE pt BETWEEN a AND z)
SELECT p.event_id, h.span FROM p LEFT JOIN h ON h.event_id = p.event_id AND k = 1""")
def _(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    spans = t("orders").select(key.alias("span"), (cust % 150).alias("user_id"), (key % 28).alias("a"), (key % 28 + cust % 9).alias("z"))
    points = t("events").select("event_id", "user_id", (F.dayofmonth("ts") - 1).cast("long").alias("at"))
    return G.enclosing(points, spans, ["user_id"], "at", "a", "z", "event_id", "span", 4).select("event_id", "span")


@_q.add("C10_C11_unique_names", """
WITH c AS (SELECT p_partkey AS id, p_name || p_size AS name, p_brand AS file, p_type AS grp FROM part), r AS (SELECT p_partkey AS ref, p_name || (p_size % 10) AS name, p_brand AS file, p_type AS grp FROM part),
     a AS (SELECT name, min(id) AS id FROM c GROUP BY 1 HAVING count(*) = 1), b AS (SELECT name, file, min(id) AS id FROM c GROUP BY 1, 2 HAVING count(*) = 1), g AS (SELECT name, grp, min(id) AS id FROM c GROUP BY 1, 2 HAVING count(*) = 1)
SELECT ref, coalesce(a.id, b.id, g.id) AS target FROM r LEFT JOIN a ON a.name = r.name LEFT JOIN b ON b.name = r.name AND b.file = r.file LEFT JOIN g ON g.name = r.name AND g.grp = r.grp""")
def _(t):
    p = t("part")
    own = p.select(F.col("p_partkey").alias("target"), F.concat("p_name", F.col("p_size").cast("string")).alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("grp"))
    refs = p.select(F.col("p_partkey").alias("ref"), F.concat("p_name", (F.col("p_size") % 10).cast("string")).alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("grp"))
    return G.resolved_names(refs, own, "name", "file", "grp", "target").select("ref", "target")


@_q.add("C7_C8_H2_edge_lifting", """
WITH e AS (SELECT l_partkey AS f, l_suppkey AS t FROM lineitem WHERE l_returnflag = 'R')
SELECT DISTINCT p_brand AS from_file, n_name AS to_file FROM e JOIN part ON p_partkey = f JOIN supplier ON s_suppkey = t JOIN nation ON n_nationkey = s_nationkey
UNION SELECT p_brand, p_type FROM part WHERE p_size = 50""")
def _(t):
    from tarnbeck.operators.graph import lifted

    edges = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("from"), F.col("l_suppkey").alias("to"))
    a = t("part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("file"))
    b = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("key"), F.col("n_name").alias("file"))
    imports = t("part").filter("p_size = 50").select(F.col("p_brand").alias("from_file"), F.col("p_type").alias("to_file"))
    return lifted(edges, a, b, imports)


@_q.add("I13_prefix_budget", """
WITH r AS (SELECT doc_id, lang, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) SELECT doc_id, lang, CAST(running AS BIGINT) AS running FROM r WHERE running <= 100000""")
def _(t):
    return K.prefix_budget(t("documents").select("doc_id", "lang", "n_chars"), "lang", [F.col("n_chars").desc(), F.col("doc_id")], F.col("n_chars"), 100000).select("doc_id", "lang", "running")
