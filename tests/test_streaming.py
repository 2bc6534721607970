"""Timers, restarts and repeated batches."""

import random

from pyspark.sql import functions as F

from tarnbeck.streaming.leases import Job, Rules, happened, lease_history, lease_stream, passed, timers
from tarnbeck.streaming.limits import each_batch, run_to_end
from tarnbeck.streaming.sinks import alerts, audit_rows, deliveries, ledger, read_ledger, whole_batches

S = 1_000_000
RULES = Rules(lease=900 * S, base=5 * S, longest=60 * S, remembered=3600 * S)
EVENT = "job string, ts timestamp, id long, done boolean"


def steps(events, until):
    job, out = Job(), []
    for at, done in events:
        out += happened(job, at * S, done, RULES)
    out += passed(job, until * S, RULES, True)
    return [(at // S, what, n, opens and opens // S) for at, what, n, opens in out], job


def test_a_job_rule_by_rule():
    # a beat at the lease's very end renews it; the end of the lease opens a gate, which opens by itself
    found, job = steps([(0, False), (900, False)], 1805)
    assert found == [(0, "claimed", 0, None), (1800, "requeued", 1, 1805), (1805, "eligible", 1, None)] and job.forgotten
    # three leases run out; back-off doubles; nothing is left
    found, job = steps([(0, False), (903, False), (1000, False), (2000, False)], 2900)
    assert [x[1] for x in found] == ["claimed", "requeued", "refused", "eligible", "claimed", "requeued", "eligible", "claimed", "failed"]
    assert [x[3] for x in found if x[1] == "requeued"] == [905, 1910] and job == Job()
    # an end by the holder, and one that comes too late
    assert steps([(0, False), (10, True)], 9999) == ([(0, "claimed", 0, None), (10, "done", 0, None)], Job())
    assert [x[1] for x in steps([(0, False), (901, True)], 902)[0]] == ["claimed", "requeued", "fenced"]
    # a job that nobody claims is forgotten, and starts anew
    found, _ = steps([(0, False), (905 + 3601, False)], 905 + 3601)
    assert found[-1] == (4506, "claimed", 0, None)
    assert steps([(0, False)], 905 + 3600)[1] == Job()


def events(spark, rows):
    return spark.createDataFrame(rows, "job string, s double, id long, done boolean").select("job", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "id", "done")


def stream(spark, folder, rules=RULES):
    return lease_stream(spark.readStream.schema(EVENT).parquet(folder), "job", "ts", "id", F.col("done"), rules)


def shown(df):
    return sorted((r.job, str(r.at), r.what, r.attempts, str(r.opens)) for r in df.collect())


def test_a_lease_ends_without_another_event_of_its_job(spark, tmp_path):
    events(spark, [("a", 0.0, 1, False), ("b", 2000.0, 2, False)]).write.parquet(f"{tmp_path}/in")
    with timers(spark):
        out = run_to_end(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out")
    assert [(r.job, r.what) for r in out.orderBy("at").collect()] == [("a", "claimed"), ("a", "requeued"), ("a", "eligible"), ("b", "claimed")]


def test_a_restart_gives_the_rows_of_one_run(spark, tmp_path):
    rng, rules = random.Random(3), Rules(lease=900 * S, base=300 * S, longest=500 * S, remembered=1800 * S)
    rows = [(rng.choice("abcdef"), at + rng.random(), k, rng.random() < 0.2) for k, at in enumerate(sorted(rng.uniform(0, 20_000) for _ in range(120)))]
    until = int((max(r[1] for r in rows) + 1_700_000_000) * 1000) * 1000
    want = shown(lease_history(events(spark, rows), "job", "ts", "id", F.col("done"), rules, until))
    assert {x[2] for x in want} == {"claimed", "requeued", "eligible", "refused", "fenced", "failed", "done"}
    for part in (rows[:50], rows[50:51], rows[51:]):
        events(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with timers(spark):
            out = run_to_end(stream(spark, f"{tmp_path}/in", rules), f"{tmp_path}/out")
    assert shown(out) == want
    assert lease_history(events(spark, []), "job", "ts", "id", F.col("done"), RULES, 0).count() == 0


def test_a_repeated_batch_replaces_its_first_attempt(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    a, b = spark.range(5), spark.range(5, 8)
    work = ledger(path)
    assert read_ledger(spark, path, a).collect() == []
    work(a, 0)
    work(b, 1)
    work(a, 0)
    assert sorted(tuple(r) for r in read_ledger(spark, path, a).collect()) == [(k, int(k > 4)) for k in range(8)]
    # a batch without its end does not count
    (tmp_path / "ledger/batch=1/_SUCCESS").unlink()
    assert whole_batches(spark, path) == [0] and read_ledger(spark, path, a).count() == 5


def test_deliveries_are_not_sent_twice_and_failures_are_tried_again(spark, tmp_path):
    (tmp_path / "box").mkdir()
    box = str(tmp_path / "box")

    def send(row):
        with open(f"{box}/{row['id']}-{row['idempotency_key'][:6]}", "a") as f:
            f.write("x")
        if row["id"] == 3 and len(open(f"{box}/3-{row['idempotency_key'][:6]}").read()) == 1:
            raise OSError("http://secret")

    work = deliveries(f"{tmp_path}/sent", send, "id")
    work(spark.range(5), 7)
    work(spark.range(5), 7)
    work(spark.range(5), 7)
    assert sorted((p.name[0], p.read_text()) for p in (tmp_path / "box").iterdir()) == [("0", "x"), ("1", "x"), ("2", "x"), ("3", "xx"), ("4", "x")]
    errors = [r.error for r in spark.read.parquet(f"{tmp_path}/sent/batch=7/attempt=0").collect() if r.error]
    assert errors == ["OSError"]


def test_a_stream_goes_on_with_its_ledger(spark, tmp_path):
    for k in range(3):
        spark.range(k * 4, k * 4 + 4).write.mode("append").parquet(f"{tmp_path}/in")
        each_batch(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), ledger(f"{tmp_path}/out"), f"{tmp_path}/state")
    assert sorted(r.id for r in read_ledger(spark, f"{tmp_path}/out", spark.range(0)).collect()) == list(range(12))


def test_severities_and_kinds(spark):
    df = spark.createDataFrame([("a", "info"), ("a", "odd"), ("a", None), ("b", "error")], "kind string, s string")
    assert sorted(r.severity for r in alerts(df, F.col("s"), ["a"], "kind").collect()) == ["info", "warning", "warning"]
    df = spark.createDataFrame([("a",), (" ",), ("",), (None,)], "kind string")
    assert [r.refused for r in audit_rows(df, "kind").collect()] == [False, True, True, True]
