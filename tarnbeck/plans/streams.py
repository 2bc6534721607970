"""Rate limits, deduplicated ingestion, leases and alert sinks on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnbeck.plans.registry import Queries
from tarnbeck.streaming import leases as T
from tarnbeck.streaming import limits as L
from tarnbeck.streaming import sinks as K

_q = Queries()
QUERIES, ORACLES = _q.queries, _q.oracles
_FOLD = """
WITH RECURSIVE r AS (SELECT {key} AS k, event_id, epoch_us(ts) / 1000000.0 AS s, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
 f AS (SELECT k, event_id, n, [s] AS recent, true AS admitted FROM r WHERE n = 1
  UNION ALL SELECT k, event_id, n, CASE WHEN len(live) < {most} THEN list_append(live, s) ELSE live END, len(live) < {most}
  FROM (SELECT r.k, r.event_id, r.n, r.s, [x for x in f.recent if x > r.s - {window}] AS live FROM f JOIN r ON r.k = f.k AND r.n = f.n + 1))
SELECT event_id, admitted FROM f"""


def _events(t):
    return t("events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)


def _stream(t):
    rows = t("events")
    return t.spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir), rows


@_q.add("K1_sliding_limit", _FOLD.format(key="user_id", most=3, window=86400))
def _(t):
    return L.limited(_events(t), "user_id", "at", "event_id", 86400, 3).select("event_id", "admitted")


@_q.add("K2_login_limits", _FOLD.format(key="(user_id % 10)", most=20, window=43200))
def _(t):
    return L.limited(_events(t).withColumn("ip", F.col("user_id") % 10), "ip", "at", "event_id", 43200, 20).select("event_id", "admitted")


@_q.add("K1_stream_limit", _FOLD.format(key="user_id", most=3, window=86400))
def _(t):
    stream, _rows = _stream(t)
    own = stream.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return L.run_to_end(L.limited_stream(own, "user_id", "at", "event_id", 86400, 3), L.new_folder(t.spark, "limits"))


@_q.add("K5_stream_dedupe", "SELECT DISTINCT event_id, user_id, event_type FROM events")
def _(t):
    stream, _rows = _stream(t)
    twice = stream.union(_stream(t)[0]).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return L.run_to_end(L.first_deliveries(twice, ["event_id"], "ts", "60 days"), L.new_folder(t.spark, "deliveries")).select("event_id", "user_id", "event_type")


@_q.add("K3_leases", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS expires, count(*) AS beats FROM s GROUP BY user_id, n""")
def _(t):
    return L.leases(t("events"), "user_id", "ts", "6 hours")


_HOUR = 3_600_000_000
_RULES = T.Rules(lease=12 * _HOUR, base=6 * _HOUR, longest=24 * _HOUR, remembered=48 * _HOUR)
_LEASES = f"""
WITH RECURSIVE r AS (
  SELECT user_id AS k, event_type = 'purchase' AS done, epoch_us(ts) AS t, false AS last, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
  UNION ALL SELECT user_id, false, (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events), true, count(*) + 1 FROM events GROUP BY user_id),
 f AS (
  SELECT DISTINCT k, CAST(0 AS BIGINT) AS n, 0 AS a, CAST(NULL AS BIGINT) AS ex, CAST(NULL AS BIGINT) AS op, CAST(NULL AS BIGINT) AS fg, CAST([] AS STRUCT(us BIGINT, what VARCHAR, attempts INTEGER, opens BIGINT)[]) AS steps FROM r
  UNION ALL
  SELECT k, n, CASE WHEN NOT last AND done AND ex IS NOT NULL THEN 0 ELSE a END, CASE WHEN last THEN ex WHEN done THEN NULL WHEN op IS NULL THEN t + {12 * _HOUR} END, op, CASE WHEN last OR done OR op IS NOT NULL THEN fg END,
   list_concat(steps, CASE WHEN last THEN [] WHEN done AND ex IS NULL THEN [(t, 'fenced', a, op)] WHEN done THEN [(t, 'done', a, NULL)] WHEN op IS NOT NULL THEN [(t, 'refused', a, op)] WHEN ex IS NULL THEN [(t, 'claimed', a, NULL)] ELSE [] END)
  FROM (SELECT * REPLACE (CASE WHEN fg < t OR last AND fg <= t THEN 0 ELSE a END AS a, CASE WHEN fg < t OR last AND fg <= t THEN NULL ELSE fg END AS fg)
   FROM (SELECT * REPLACE (CASE WHEN op <= t THEN op + {48 * _HOUR} ELSE fg END AS fg, CASE WHEN op <= t THEN NULL ELSE op END AS op, CASE WHEN op <= t THEN list_append(steps, (op, 'eligible', a, NULL)) ELSE steps END AS steps)
    FROM (SELECT k, n, t, done, last, CASE WHEN NOT over THEN a WHEN a + 1 < 3 THEN a + 1 ELSE 0 END AS a, CASE WHEN NOT over THEN ex END AS ex, CASE WHEN over AND a + 1 < 3 THEN gate ELSE op END AS op, fg,
           CASE WHEN NOT over THEN [] WHEN a + 1 < 3 THEN [(ex, 'requeued', a + 1, gate)] ELSE [(ex, 'failed', a + 1, NULL)] END AS steps
     FROM (SELECT f.* EXCLUDE (n), r.* EXCLUDE (k), coalesce(ex < t OR last AND ex <= t, false) AS over, ex + least({24 * _HOUR}, {6 * _HOUR} * CAST(pow(2, a) AS BIGINT)) AS gate FROM f JOIN r ON r.k = f.k AND r.n = f.n + 1))))),
 s AS (SELECT k, unnest(steps) AS x FROM f)
SELECT k AS user_id, make_timestamp(x.us) AS "at", x.what, x.attempts, make_timestamp(x.opens) AS opens FROM s"""


@_q.add("K3_K4_timers", _LEASES)
def _(t):
    stream, _rows = _stream(t)
    with T.timers(t.spark):
        return L.run_to_end(T.lease_stream(stream, "user_id", "ts", "event_id", F.col("event_type") == "purchase", _RULES), L.new_folder(t.spark, "leases"))


@_q.add("K3_K4_history", _LEASES)
def _(t):
    rows = t("events")
    until = rows.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("u")).first().u or 0
    return T.lease_history(rows, "user_id", "ts", "event_id", F.col("event_type") == "purchase", _RULES, until // 1000 * 1000)


@_q.add("K7_A25_A26_alert_sink", "SELECT event_id, CASE WHEN value > 90 THEN 'error' ELSE 'warning' END AS severity FROM events WHERE event_type = 'error' AND value > 50")
def _(t):
    path = L.new_folder(t.spark, "alerts")
    stream, _rows = _stream(t)
    severity = F.when(F.col("value") > 90, "error").otherwise("warning")
    alerts = K.alerts(stream.filter("value > 50"), severity, ["error"], "event_type").select("event_id", "severity")
    work = K.ledger(path)

    def twice(batch, number):
        work(batch, number)
        work(batch, number)  # as after a failure: the second writes over the first

    L.each_batch(alerts, twice, f"{path}-state")
    return K.read_ledger(t.spark, path, alerts).select("event_id", "severity")


@_q.add("A25_audit_append", "SELECT event_id, user_id, event_type, event_type = 'click' AS refused FROM events")
def _(t):
    path = L.new_folder(t.spark, "audit")
    stream, _rows = _stream(t)
    kind = F.when(F.col("event_type") != "click", F.col("event_type")).otherwise(" ")
    rows = K.audit_rows(stream.withColumn("kind", kind), "kind").select("event_id", "user_id", "event_type", "refused")
    L.each_batch(rows, K.ledger(path), f"{path}-state")
    return K.read_ledger(t.spark, path, rows).drop("batch")
