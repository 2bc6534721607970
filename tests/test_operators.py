"""Boundaries, nulls, ties and empty tables of operators, on literal rows."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnbeck.functions import scalars as S
from tarnbeck.operators import aggregates as A
from tarnbeck.operators import budgets as B
from tarnbeck.operators import encoding as E
from tarnbeck.operators import graph as H
from tarnbeck.operators import ranking as K
from tarnbeck.operators import relational as R
from tarnbeck.operators import reports as P
from tarnbeck.operators import state as T
from tarnbeck.operators import text as X
from tarnbeck.operators import versions as V
from tarnbeck.sources import files as L
from tarnbeck.streaming.limits import admit, limited


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_usage_states_at_their_boundaries(spark):
    df = spark.createDataFrame([(79, 100), (80, 100), (89, 100), (90, 100), (99, 100), (100, 100), (0, 0), (5, None)], "used int, most int")
    assert [r.s for r in df.select(A.usage_state(F.col("used"), F.col("most")).alias("s")).collect()] == ["ok", "warning", "warning", "danger", "danger", "blocked", "blocked", "unlimited"]


def test_eligibility_and_leases(spark):
    df = spark.createDataFrame([("queued", None), ("queued", 5), ("queued", 6), ("running", None)], "s string, g int")
    assert [bool(r.e) for r in df.select(R.eligible(F.col("s"), F.col("g"), F.lit(5)).alias("e")).collect()] == [True, True, False, False]
    assert [bool(r.e) for r in df.select(R.lease_expired(F.col("g"), F.lit(6)).alias("e")).collect()] == [False, True, False, False]


def test_service_month_clamps_and_comes_back(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-01-31 10:00:00', TIMESTAMP_NTZ'2024-02-29 09:59:59'), (TIMESTAMP_NTZ'2024-01-31 10:00:00', TIMESTAMP_NTZ'2024-02-29 10:00:00'), (TIMESTAMP_NTZ'2024-01-31 10:00:00', TIMESTAMP_NTZ'2023-01-01 00:00:00') t(a, n)")
    out = [(str(r.m.start), str(r.m.end)) for r in df.select(S.service_month(F.col("a"), F.col("n")).alias("m")).collect()]
    assert out == [("2024-01-31 10:00:00", "2024-02-29 10:00:00"), ("2024-02-29 10:00:00", "2024-03-31 10:00:00"), ("2024-01-31 10:00:00", "2024-02-29 10:00:00")]


def test_hashes_keep_nulls_apart(spark):
    assert one(spark, S.joined_hash(F.lit(None).cast("string"), F.lit("a"))) != one(spark, S.joined_hash(F.lit("a"), F.lit(None).cast("string")))


def test_score_caps_rounds_and_ignores(spark):
    df = spark.createDataFrame([("a", "CRITICAL", "high", False), ("b", "MEDIUM", "medium", False), ("b", "HIGH", "low", None), ("c", "CRITICAL", "high", True)], "k string, s string, c string, i boolean")
    out = df.groupBy("k").agg(*A.score(F.col("s"), F.col("c"), F.col("i"))).select("k", A.score_value(F.col("penalty10"), F.col("capped")).alias("v"))
    assert values(out, "k", "v") == [("a", 40), ("b", 89), ("c", 100)]


def test_merged_findings_keep_first_evidences(spark):
    df = spark.createDataFrame([("k", i, "LOW" if i else "HIGH", "low", f"f{i % 2}", f"e{i % 7}") for i in range(9)], "k string, o int, s string, c string, l string, e string")
    r = A.merged_findings(df, "k", "o", "s", "c", "l", "e").first()
    assert (r.severity_rank, r.merged_count, r.locations, r.evidence, r.first_order) == (3, 9, ["f0", "f1"], ["e0", "e1", "e2", "e3", "e4"], 0)


def test_checks_pass_on_null(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "ok")], "k int, s string")
    assert values(P.violations(df, F.col("k"), {"known": F.col("s") == "ok"}), "key", "rule") == [(2, "known")]


def test_missing_confidence_blocks(spark):
    df = spark.createDataFrame([("HIGH", None, "c"), ("HIGH", "low", "c"), ("HIGH", "odd", "c"), ("high", "high", "c")], "s string, c string, k string")
    assert [r.b for r in df.select(P.gate(df, "s", "c", "k", ["HIGH"], "medium", ["c"]).alias("b")).collect()] == [True, False, True, False]


def test_ambiguous_second_keys_are_not_paired(spark):
    a = spark.createDataFrame([(1, "s", "x"), (2, "t", "x"), (3, "t", "x")], "k int, s string, v string")
    b = spark.createDataFrame([(10, "s", "y"), (20, "t", "x")], "k int, s string, v string")
    out = V.matched_findings(a, b, "k", "s", ["v"])
    assert sorted((r.k, r.after_key, r.status) for r in out.collect() if r.k is not None) == [(1, 10, "modified"), (2, None, "resolved"), (3, None, "resolved")]
    assert [(r.after_key, r.status) for r in out.collect() if r.k is None] == [(20, "new")]


def test_closure_on_a_cycle_and_on_nothing(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "`from` int, `to` int")
    assert values(H.closure(e, spark.createDataFrame([(1,), (4,), (9,)], "seed int")), "seed", "node") == [(1, 1), (1, 2), (1, 3), (4, 4), (9, 9)]
    assert H.closure(e, spark.createDataFrame([], "seed int")).count() == 0
    assert sorted(r.cycle for r in H.cycles(e).collect()) == [[1, 2, 3], [4, 4]]


def test_fair_claims_send_a_tenant_to_the_back(spark):
    jobs = spark.createDataFrame([("q", "a", j, 0, float(j)) for j in range(3)] + [("q", "b", 10, 0, 9.0), ("q", "b", 11, 1, 9.5)], "queue string, tenant string, job int, priority int, created double")
    tenants = spark.createDataFrame([("q", "a", None, 1.0, 1000.0), ("q", "b", 5.0, 2.0, 1000.0)], "queue string, tenant string, last_claimed double, tenant_created double, now double")
    out = K.claims(jobs, tenants, "queue", 5)
    assert [r.job for r in out.orderBy("pick").collect()] == [0, 11, 1, 10, 2]


def test_refused_requests_take_nothing(spark):
    df = spark.createDataFrame([("k", 1, 6, 10, "a"), ("k", 2, 5, 10, "b"), ("k", 3, 4, 10, "c"), ("k", 4, 1, 10, "d"), ("k", 5, 99, 10, "e")], "k string, t int, x int, m int, i string")
    assert values(T.reserve(df, "k", ["t"], "x", "m", "i"), "i", "granted") == [("a", True), ("b", False), ("c", True), ("d", False), ("e", False)]


def test_rate_limit_edge():
    recent, ok, _ = admit([0.0, 1.0], 10.0, 10.0, 2)
    assert ok and recent == [1.0, 10.0]
    assert admit([0.5, 1.0], 10.0, 10.0, 2)[1:] == (False, 1.0)


def test_limits_do_not_mix_keys(spark):
    df = spark.createDataFrame([(k, float(i), f"{k}{i}") for k in "ab" for i in range(4)], "k string, t double, i string")
    assert [r.admitted for r in limited(df, "k", "t", "i", 100, 2).orderBy("i").collect()] == [True, True, False, False] * 2


def test_first_fit_goes_on_after_a_misfit(spark):
    files = spark.createDataFrame([("g", "a", 1, 60), ("g", "b", 2, 50), ("g", "c", 3, 30), ("g", "d", 4, 200)], "g string, file string, rank int, size long")
    reach = spark.createDataFrame([("g", "a", "c")], "g string, file string, need string")
    out = B.select_files(B.candidates(files, reach, "g"), "g", 100)
    assert values(out, "file", "selected") == [("a", True), ("b", False), ("c", True), ("d", False)]
    assert {r.file: r.reason for r in out.collect()} == {"a": None, "b": B.TOO_LARGE, "c": None, "d": B.ALONE}
    plan = B.plan_passes(B.candidates(files, reach, "g"), "g", 100)
    assert values(plan, "pass_index", "file", "role") == [(0, "d", "unassigned"), (1, "a", "primary"), (1, "c", "primary"), (2, "b", "primary")]


JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=3), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["file", "a", "b", *E.DIRECTIVES]), x, max_size=3), max_leaves=20)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.sampled_from([*E.FILE_SECTIONS[:2], "x", "$t"]), JSON, max_size=3) | JSON)
def test_compact_encoding_is_lossless(value):
    text = json.dumps(value, ensure_ascii=False)
    assert E.decode(E.encode(text)) == text


def test_malformed_encodings_are_refused():
    for bad in ('{"$t":[["a"]]}', '{"$l":[1]}', '{"$i":[1]}', '{"$r":[["f",true,[]]]}', '{"$o":1}'):
        with pytest.raises(E.Malformed):
            E.decode('{"contextArtifactFormat":"compact-v2","artifact":' + bad + "}")


def test_masking_and_opcodes():
    assert X.masked('a // b\n"// c" /* d\n e */ f') == ('a     \n"// c"     \n      f', False)
    assert X.masked("x /* open")[1]
    assert X.code_lines("// a\n\nb\n/* c\nd */ e") == 2
    assert X.opcodes("60f4f4") == {0x60: 1, 0xF4: 1}
    assert X.bare_claims('He says "is safe". It is not is safe. This is safe.', ["is safe"]) == ["is safe"]


def test_bundles_with_faults(spark):
    text = "=== FILE: a ===\nx\n=== END FILE ===\n=== FILE: a ===\ny\n"
    out = L.unbundled(spark.createDataFrame([(1, text)], "i int, t string"), "i", "t").orderBy("place").collect()
    assert [(r.path, r.content, r.issue) for r in out] == [("a", "x", None), ("a#2", "y", "missing_end")]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k string, s string, v string")
    assert V.key_status(e, e, ["k"], ["v"]).count() == 0
    assert V.matched_findings(e, e, "k", "s", ["v"]).count() == 0
    assert P.violations(e, F.col("k"), {"r": F.col("v") == "x"}).count() == 0
    assert R.missing_names(e, e, "k").first().missing is None


def test_evidence_precedence(spark):
    lines = spark.createDataFrame([("f", k, f"line  {k} text") for k in range(1, 20)], "file string, line int, text string")
    q = spark.createDataFrame([(1, "f", 5, "line 5   text"), (2, "f", 5, "line 15 text"), (3, "f", 5, "nothing"), (4, "g", 5, "x"), (5, "f", 5, "line 8 text"), (6, "f", 5, "line 9 text")], "i int, file string, line int, quote string")
    assert values(P.evidence_status(q, lines, "i"), "i", "status") == [(1, "verified"), (2, "location_mismatch"), (3, "fabricated"), (4, "unverifiable"), (5, "verified"), (6, "location_mismatch")]


def test_evidence_by_index_equals_all_lines(spark):
    import random

    rng = random.Random(11)
    words = ["a", "bb", "ccc", "amount", "=", "balance;", "x.y(z)", "é"]
    texts = [("f", k, "  ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))) for k in range(1, 90)]
    texts += [("f", k, "same line of many words") for k in range(100, 130)] + [("g", 1, ""), (None, 1, "a")]
    quotes = []
    for k in range(250):
        file, _, text = rng.choice(texts)
        line, end = rng.randint(1, 140), None
        cut = sorted(rng.randint(0, len(text)) for _ in range(2))
        quotes.append((k, rng.choice([file, "f", "none"]), line, rng.choice([text, text[cut[0] : cut[1]], text + " odd", " ".join(text.split())[1:-1]]), line + rng.randint(0, 5)))
    quotes += [(900, "f", None, "a", None), (901, None, 1, "a", 1), (902, "f", 1, None, 1)]
    flat = lambda x: " ".join(x.split())

    def plain(file, line, quote, end):
        own = [(at, flat(text)) for f, at, text in texts if f == file and f]
        if not own or not quote or not flat(quote) or line is None:
            return "unverifiable"
        gaps = [max(line - at, at - end, 0) for at, text in own if flat(quote) in text]
        return "fabricated" if not gaps else "verified" if min(gaps) <= 3 else "location_mismatch"

    lines = spark.createDataFrame(texts, "file string, line int, text string")
    q = spark.createDataFrame(quotes, "i int, file string, line int, quote string, z int")
    got = {r.i: r.status for r in P.evidence_status(q, lines, "i", end="z").collect()}
    assert got == {k: plain(f, at, text, z) for k, f, at, text, z in quotes} and len(set(got.values())) == 4
    got = {r.i: r.status for r in P.evidence_status(q, lines, "i").collect()}
    assert got == {k: plain(f, at, text, at) for k, f, at, text, _ in quotes}
    assert P.evidence_status(q.limit(0), lines, "i").count() == 0 and P.evidence_status(q, lines.limit(0), "i").filter("status = 'unverifiable'").count() == len(quotes)


def test_claims_equal_a_scan_of_all_jobs_at_each_pick(spark):
    import random

    rng = random.Random(6)
    tenants = [(q, t, rng.choice([None, rng.randint(0, 900) * 1.0]), rng.randint(0, 3) * 1.0, 1000.0) for q in range(4) for t in range(9)]
    jobs = [(q, t, 1000 * q + 100 * t + k, rng.randint(0, 1), rng.randint(0, 5) * 1.0) for q, t, *_ in tenants for k in range(rng.randint(0, 5))]
    want = []
    for q in range(4):
        last, made, left = {t: x for u, t, x, *_ in tenants if u == q}, {t: m for u, t, _, m, _ in tenants if u == q}, [j for j in jobs if j[0] == q]
        for k in range(min(12, len(left))):
            job = min(left, key=lambda j: (last[j[1]] is not None, 0 if last[j[1]] is None else last[j[1]] - 300 * j[3], -j[3], made[j[1]], j[4], j[2]))
            left.remove(job)
            last[job[1]] = 1000.0 + k
            want.append((q, k, job[1], job[2]))
    j = spark.createDataFrame(jobs, "q int, tenant int, job int, priority int, created double")
    t = spark.createDataFrame(tenants, "q int, tenant int, last_claimed double, tenant_created double, now double")
    assert values(K.claims(j, t, "q", 12), "q", "pick", "tenant", "job") == sorted(want)
    assert K.claims(j.limit(0), t, "q", 12).count() == 0


def test_bundles_are_written_and_read_part_by_part(spark, tmp_path):
    rows = [("g", "b.txt", "x\n\ny\n"), ("g", "a.txt", ""), ("g", "c/d.txt", "=== not a marker\nz"), ("h", "a.txt", "é " * 5000)]
    L.write_bundles(spark.createDataFrame(rows, "k string, path string, content string"), "k", f"{tmp_path}/out")
    found = L.read_bundles(spark, f"{tmp_path}/out", "k")
    assert values(found, "k", "place", "path", "content", "issue") == [("g", 0, "a.txt", "", None), ("g", 1, "b.txt", "x\n\ny", None), ("g", 2, "c/d.txt", "=== not a marker\nz", None), ("h", 0, "a.txt", "é " * 5000, None)]
    (tmp_path / "odd/k=i").mkdir(parents=True)
    (tmp_path / "odd/k=i/x.txt").write_text("lost\n=== FILE: a ===\n1\n=== END FILE ===\nlost\n=== FILE: a ===\n2\n")
    assert values(L.read_bundles(spark, f"{tmp_path}/odd", "k"), "place", "path", "content") == [(0, "a", "1"), (1, "a#2", "2")]
    assert [r.issue for r in L.read_bundles(spark, f"{tmp_path}/odd", "k").orderBy("place").collect()] == [None, "missing_end"]


def test_two_rows_of_one_object_in_a_put_are_one(spark, tmp_path):
    L.put_objects(spark.createDataFrame([("c", "w", "n", "1"), ("c", "w", "n", "2"), ("c", "w", "m", "3")], "category string, workspace string, name string, content string"), str(tmp_path))
    assert values(L.get_objects(spark, str(tmp_path), "c", "w"), "name", "content") == [("m", "3"), ("n", "2")]


def test_a_runs_folder_goes_at_its_end(spark):
    import os

    from tarnbeck.sources.folders import run_folder, shared_folder, stored

    before = shared_folder(spark)
    with run_folder(spark) as path:
        assert stored(spark.range(3), "x").count() == 3 and any("tarnbeck-x-" in d for d in os.listdir(path.removeprefix("file:")))
    assert not os.path.exists(path.removeprefix("file:")) and shared_folder(spark) == before


def test_evidence_of_whole_findings(spark):
    lines = spark.createDataFrame([("A", k, t) for k, t in enumerate(["// x", "pragma solidity 0.8.20;", "contract A {", "", "function f() {", "uint256 amount = balance;", "balance = 0;", "}"], 1)], "file string, line int, text string")
    cases = {
        1: (["uint256 amount = balance;", "balance = 0;"], [("A", 6, 7)], "verified"), 2: (["uint256  amount   = balance;"], [("A", 8, 8)], "verified"), 3: (["uint256 amount=balance;"], [("A", 6, 6)], "fabricated"),
        4: (["pragma solidity 0.8.20;"], [("A", 6, 6)], "location_mismatch"), 5: (["pragma solidity 0.8.20;", "invented"], [("A", 6, 6)], "fabricated"), 6: (["x"], [("B", 1, 1)], "unverifiable"),
        7: ([], [("A", 1, 1)], "unverifiable"), 8: (["x"], [], "unverifiable"), 9: (["uint256 amount = balance;"], [("A", 1, 1), ("A", 6, 6)], "verified"), 10: (["balance = 0;"], [("A", 1, 1), ("A", 2, 3)], "location_mismatch"),
    }
    f = spark.createDataFrame([(k,) for k in cases], "i int")
    q = spark.createDataFrame([(k, x) for k, v in cases.items() for x in v[0]], "i int, quote string")
    p = spark.createDataFrame([(k, *x) for k, v in cases.items() for x in v[1]], "i int, file string, line int, end int")
    assert {r.i: r.status for r in P.finding_evidence(f, q, p, lines, "i").collect()} == {k: v[2] for k, v in cases.items()}


def test_lifecycle_of_changes(spark):
    import random

    rng = random.Random(2)
    scans = [(t, n) for t in "ab" for n in sorted(rng.sample(range(50), 12))]
    present = [(t, n, k) for t, n in scans for k in ("x", "y", "z", None) if rng.random() < 0.6] * 2
    want = []
    for t in "ab":
        for k in ("x", "y", "z", None):
            was, ever, regressed = False, False, False
            for n in [n for u, n in scans if u == t]:
                now = (t, n, k) in present
                if now != was:
                    regressed |= now and ever
                    want.append((t, k, n, "resolved" if was else "regressed" if ever else "new", regressed))
                was, ever = now, ever or now
    s, p = spark.createDataFrame(scans, "t string, n int"), spark.createDataFrame(present, "t string, n int, k string")
    order = lambda rows: sorted(rows, key=str)
    changes = K.lifecycle(p, s, ["t"], "k", "n")
    assert order(tuple(r) for r in changes.collect()) == order(want)
    last = {(t, k): (status, ever) for t, k, _, status, ever in want}
    assert {(r.t, r.k): (r.status, r.ever_regressed) for r in K.current_status(changes, ["t"], "k", "n").collect()} == {k: ("resolved" if v[0] == "resolved" else "present", v[1]) for k, v in last.items()}
    asked = spark.createDataFrame([("a", "x", 0), ("a", "x", 25), ("b", "y", 99), ("c", "x", 9)], "t string, k string, n int")
    upto = lambda t, k, n: ([w[3] for w in want if w[:2] == (t, k) and w[2] <= n] or [None])[-1]
    assert {tuple(r) for r in K.status_at(changes, asked, ["t"], "k", "n").select("t", "k", "n", "status").collect()} == {(*a, upto(*a)) for a in (("a", "x", 0), ("a", "x", 25), ("b", "y", 99), ("c", "x", 9))}
    assert K.lifecycle(p.limit(0), s, ["t"], "k", "n").count() == 0


def test_long_cycles_and_paths(spark):
    ring = spark.createDataFrame([(k, k % 20 + 1) for k in range(1, 21)], "from int, to int")
    assert [r.cycle for r in H.cycles(ring).collect()] == [list(range(1, 21))]
    line = spark.createDataFrame([(k, k + 1) for k in range(1, 21)], "from int, to int")
    from pyspark.sql import functions as F

    paths = H.simple_paths(line, spark.createDataFrame([(1,)], "start int"), F.lit(True)).collect()
    assert max(len(r.hops) for r in paths) == 21 and len(paths) == 20
    bases = spark.createDataFrame([(k, 0, k + 1) for k in range(1, 21)], "node int, place int, base int")
    assert H.linearised(bases).filter("node = 1").count() == 20


def diamonds(count):
    """(from, place, to): ``count`` diamonds on top of each other, 2 ** count paths from 0."""
    return [x for k in range(0, 3 * count, 3) for x in ((k, 1, k + 1), (k, 2, k + 2), (k + 1, 1, k + 3), (k + 2, 1, k + 3))]


def test_linearisation_of_stacked_diamonds(spark):
    bases = spark.createDataFrame(diamonds(30), "node int, place int, base int")
    rows = H.linearised(bases).filter("node = 0").orderBy("place").collect()
    # the first way down comes first, the second sides on the way back up
    assert [r.base for r in rows] == [x for k in range(0, 90, 3) for x in (k + 1, k + 3)] + [k + 2 for k in range(87, -1, -3)]


def test_cycles_behind_stacked_diamonds(spark):
    """The 2 ** 25 paths down to a cycle and on from it are never walked."""
    rows = [(a, b) for a, _, b in diamonds(25)] + [(75, 200), (200, 201), (201, 75), (201, 300), (300, 301), (50, 50)] + [(300 + a, 300 + b) for a, _, b in diamonds(25)]
    e = spark.createDataFrame(rows, "from int, to int")
    assert sorted(r.cycle for r in H.cycles(e).collect()) == [[50, 50], [75, 200, 201]]
    assert H.cycles(e.filter("from < to")).count() == 0 and H.cycles(e.limit(0)).count() == 0


def test_linearisation_with_a_cycle_and_a_better_longer_path(spark):
    bases = spark.createDataFrame([(1, 2, 9), (1, 1, 2), (2, 1, 3), (3, 1, 9), (3, 2, 2)], "node int, place int, base int")
    assert values(H.linearised(bases), "node", "base", "place") == [(1, 2, 0), (1, 3, 1), (1, 9, 2), (2, 3, 0), (2, 9, 1), (3, 2, 1), (3, 9, 0)]


def privilege(spark, functions, calls, delegates=()):
    """functions: contract.name(signature) and the letters g (guarded), v (only reads), i (internal)."""
    rows = []
    for x in functions:
        name, _, flags = x.partition(" ")
        contract, name = name.split(".")
        name, _, signature = name.partition("(")
        rows.append((contract, name, f"({signature}" if signature else "()", "i" not in flags, "v" in flags, "g" in flags))
    f = spark.createDataFrame(rows, "contract string, name string, signature string, exposed boolean, readonly boolean, guarded boolean")
    c = spark.createDataFrame([(*a.split("."), *(b.split(".") if "." in b else (b, None))) for a, b in calls], "`from` string, function string, to string, method string")
    d = spark.createDataFrame(list(delegates), "`from` string, to string")
    out = H.privilege_paths(f, c, d).collect()
    return sorted((f"{r.contract}.{r.function}", [f"{h.contract}.{h.name}" for h in r.hops], r.ambiguous, r.matched) for r in out)


def test_privilege_paths_rule_by_rule(spark):
    way = lambda *hops: (hops[0], list(hops), False, ["()"])
    assert privilege(spark, ["A.foo", "B.bar"], [("A.foo", "B.bar")]) == [way("A.foo", "B.bar")]
    # guarded or reading targets, guarded starts, the own contract, a call without a method
    for functions, calls in (
        (["A.foo", "B.bar g"], [("A.foo", "B.bar")]), (["A.foo", "B.bar v"], [("A.foo", "B.bar")]), (["A.foo g", "B.bar"], [("A.foo", "B.bar")]),
        (["A.foo i", "B.bar"], [("A.foo", "B.bar")]), (["A.foo", "A.bar"], [("A.foo", "A.bar")]), (["A.foo", "B.bar"], [("A.foo", "B")]), (["A.foo"], [("A.foo", "C.none")]), ([], []),
    ):
        assert privilege(spark, functions, calls) == []
    passes = [("A.foo", "B.mid"), ("B.mid", "C.baz")]
    assert privilege(spark, ["A.foo", "B.mid v", "C.baz"], passes) == [way("A.foo", "B.mid", "C.baz")]
    assert privilege(spark, ["A.foo", "B.mid g", "C.baz"], passes) == []
    # overloads are one name: any free one is found, whichever stands first
    for functions, matched in ((["B.sweep() g", "B.sweep(address)"], ["(address)"]), (["B.sweep()", "B.sweep(address) g"], ["()"])):
        assert privilege(spark, ["A.foo", *functions], [("A.foo", "B.sweep")]) == [("A.foo", ["A.foo", "B.sweep"], True, matched)]
    assert privilege(spark, ["A.foo", "B.sweep() g", "B.sweep(address) g"], [("A.foo", "B.sweep")]) == []
    assert privilege(spark, ["P.fallback", "I.drain", "I.safe g", "I.inner i", "I.read v"], [], [("P", "I")]) == [way("P.fallback", "I.drain")]
    # a cycle back to the start's contract; the shortest of several ways, ties by the least node
    assert privilege(spark, ["A.f", "A.g", "B.f"], [("A.f", "B.f"), ("B.f", "A.g"), ("A.g", "B.f")]) == [way("A.f", "B.f"), way("A.g", "B.f"), way("B.f", "A.g")]
    ties = [("A.f", "C.m"), ("A.f", "B.m"), ("B.m", "D.f"), ("C.m", "D.f"), ("A.f", "E.m"), ("E.m", "E.n"), ("E.n", "D.f")]
    assert privilege(spark, ["A.f", "B.m v", "C.m v", "E.m v", "E.n v", "D.f"], ties) == [way("A.f", "B.m", "D.f")]


def test_privilege_paths_through_stacked_diamonds(spark):
    edges = [(f"C{a}.f", f"C{b}.f") for a, _, b in diamonds(40)]
    found = privilege(spark, ["C0.f", *[f"C{k}.f v" for k in range(1, 120)], "C120.f"], edges)
    assert [(x[0], len(x[1])) for x in found] == [("C0.f", 81)]


def test_places_follow_a_total_order_over_many_ranges(spark):
    rows = [(k * 7919 % 1000, None if k % 3 else "hot") for k in range(1000)]
    df = spark.createDataFrame(rows, "k long, g string").repartition(6)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", -r[0]))
    assert [tuple(r)[:2] for r in K.placed(df, [F.col("g"), F.col("k").desc()]).orderBy("place").collect()] == want
    assert K.placed(df.limit(0), [F.col("k")]).count() == 0
    spread = K.round_robin(df.withColumn("made", F.lit(1)), "g", [F.col("k")], "made")
    turns = [(k, g) for k in range(666) for g in (None, "hot") if g is None or k < 334]
    assert [tuple(r) for r in spread.orderBy("place").select("round", "g").collect()] == turns


def test_a_budget_is_held_over_ranges_and_null_groups(spark):
    rows = [(k, None if k % 2 else "a", k % 5) for k in range(400)]
    got = K.prefix_budget(spark.createDataFrame(rows, "k long, g string, n long").repartition(5), "g", [F.col("k")], F.col("n"), 300)
    want = []
    for g in ("a", None):
        run = 0
        for k, _, n in (r for r in rows if r[1] == g):
            run += n
            want += [(k, g, n, run)] if run <= 300 else []
    assert sorted(map(tuple, got.collect())) == sorted(want)


REPORT = "report long, mode string, completeness string, score int, score_status string, band string, summary string, notes int, gas int"
FINDING = "report long, id string, stable_key string, want_id string, want_key string, category string, severity string, status string, patch string, evidence int, locations int"


def errors(spark, report=(), finding=(), statuses=None, n=1, **options):
    """The rules that one report breaks: a valid one but for the given fields."""
    r = {"mode": "standard", "completeness": "complete", "score": 85, "score_status": "computed", "band": "LOW", "summary": None, "notes": 0, "gas": 0, **dict(report)}
    f = {"id": "F-1", "stable_key": "k", "want_id": "F-1", "want_key": "k", "category": "SC01", "severity": "HIGH", "status": "open", "patch": None, "evidence": 5, "locations": 1, **dict(finding)}
    statuses = statuses or {"SC01": "DETECTED"}
    found = [(1, *f.values())] * n if n <= 1 else [(1, *{**f, "id": f"F-{k}", "want_id": f"F-{k}", "category": f"SC{k:02d}"}.values()) for k in range(1, n + 1)]
    cover = [(1, c, statuses.get(c, "NOT_DETECTED")) for c in P.CATEGORIES]
    made = (spark.createDataFrame(found, FINDING), spark.createDataFrame(cover, "report long, category string, status string"))
    return sorted(x["rule"] for x in P.report_errors(spark.createDataFrame([(1, *r.values())], REPORT), *made, **options).collect())


def test_each_rule_of_a_report(spark):
    assert errors(spark) == [] and errors(spark, n=0, statuses={"SC02": "NOT_ASSESSED"}) == []
    assert errors(spark, finding={"stable_key": "x"}) == errors(spark, finding={"id": "F-x"}) == ["R-02"]
    assert errors(spark, statuses={"SC02": "DETECTED"}) == ["R-04"] and errors(spark, finding={"category": "EXTRA-x"}) == []
    assert errors(spark, {"mode": "quick"}, {"patch": "diff"}) == errors(spark, {"mode": "quick", "gas": 1}) == ["R-06"]
    assert errors(spark, finding={"status": "informational"}) == ["R-07"]
    assert errors(spark, {"score_status": "not_computed"}) == errors(spark, {"band": "CRITICAL"}) == errors(spark, {"band": None}) == ["R-08"]
    assert errors(spark, {"score": None, "score_status": "not_computed", "band": None}) == []
    assert errors(spark, {"summary": "x"}) == errors(spark, {"notes": 1}) == ["R-09"] and errors(spark, {"mode": "pro", "summary": "x", "notes": 2}) == []
    assert errors(spark, {"mode": "ultra"}) == ["mode"] and errors(spark, {"mode": None}) == ["mode"]
    assert errors(spark, finding={"evidence": 6}) == ["evidence"] and errors(spark, finding={"locations": 0}) == ["locations"] and errors(spark, finding={"severity": "SUPER"}) == ["severity"]


def test_the_rule_of_partial_reports(spark):
    part, every = {"completeness": "partial"}, dict.fromkeys(P.CATEGORIES, "DETECTED")
    assert errors(spark, part) == ["R-05"] and errors(spark, part, partial_rule=False) == []
    assert errors(spark, part, statuses={"SC01": "DETECTED", "SC06": "NOT_ASSESSED"}) == []
    assert errors(spark, part, statuses=every, n=10) == ["R-05"] and errors(spark, part, statuses=every, n=10, forced_partial=True) == []
    assert errors(spark, {"completeness": "failed"}, statuses=every, n=10, forced_partial=True) == ["R-05"]
    assert errors(spark, part, statuses=every, n=9, forced_partial=True) == ["R-05"]
    assert errors(spark, {"completeness": "almost"}) == ["completeness"]


def test_the_size_of_a_compact_table_is_that_of_its_encoding(spark):
    for n in (2, 3, 40):
        rows = [{"a": k, "bc": "x" * k} for k in range(n)]
        values = sum(len(json.dumps(v)) for r in rows for v in r.values())
        size = spark.range(1).select(E.compact_table_bytes(F.lit(len('"a""bc"')), F.lit(values), 2, F.lit(n))).first()[0]
        assert size == len(json.dumps(E.packed(rows), separators=(",", ":")))


def test_key_material_near_its_words_is_never_echoed(spark):
    key = "4c" * 32
    texts = [f"// private key for testing: 0x{key}", f"hash 0x{key}", f"secret\n{key}", f"seed {key}00", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    kind = "hex64-possible-private-key"
    got = df.select(X.secret_count(F.col("t"), kind), X.redacted(F.col("t"), [kind]).contains(key)).collect()
    assert [tuple(r) for r in got] == [(1, False), (0, True), (0, True), (0, True), (None, None)]


def test_a_relational_table_is_read_in_ranges(spark):
    from tarnbeck.sources.tables import jdbc_table

    url, driver = "jdbc:derby:memory:tarnbeck;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).selectExpr("id AS k", "id * 2 AS v").write.jdbc(url, "T", "overwrite", {"driver": driver})
    df = jdbc_table(spark, url, "T", "K", 0, 100, 4, driver=driver)
    assert df.rdd.getNumPartitions() == 4 and sorted(map(tuple, df.collect())) == [(k, 2 * k) for k in range(100)]
    with pytest.raises(Exception, match="NONE"):
        jdbc_table(spark, url, "NONE", "K", 0, 1, 1, driver=driver).count()
