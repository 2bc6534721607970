"""Sizes against the encoder, and selections against a plain loop, on random documents."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tarnbeck.operators import budgets as B
from tarnbeck.operators import encoding as E
from tarnbeck.operators import sizes as Z

BLOCKING = ["LOC_LIMIT_EXCEEDED", "FILE_LIMIT_EXCEEDED"]


def compact(x):
    return len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode())


def plain(x):
    return len(json.dumps(x, ensure_ascii=False).encode())


def value(rng, depth=0):
    inner = [] if depth > 1 else [[value(rng, depth + 1) for _ in range(rng.randint(0, 3))], {k: value(rng, depth + 1) for k in rng.sample(["p", "$t", "q"], rng.randint(0, 2))}, [{"u": 1, "v": [2]}, {"u": 2, "v": [3]}]]
    return rng.choice([1, -2.5, 'a"b\\ é\n', None, True, "x, y: z", [], {}, *inner])


def record(rng):
    if rng.random() < 0.08:
        return value(rng)
    keys = rng.choice([["a", "b"], ["a", "b"], ["b", "a"], ["$t"], ['é"k'], [], ["a", "file", "b"], ["file"], ["file", "b"], ["file", "$i"]])
    return {k: (rng.choice(["A.sol", 'B".sol', "é"]) if k == "file" and rng.random() < 0.95 else value(rng)) for k in keys}


def lists(rng, count):
    out = []
    for _ in range(count):
        own = []
        for _ in range(rng.randint(1, 9)):
            own.append(record(rng) if rng.random() < 0.5 or not own or not isinstance(own[-1], dict) else dict(own[-1]))
        out.append(own)
    return out


def rows_of(spark, documents):
    rows = [(d, k, json.dumps(r, ensure_ascii=False), None if k % 2 else k) for d, own in enumerate(documents) for k, r in enumerate(own)]
    return spark.createDataFrame(rows, "d int, k int, j string, item_of int")


def test_sizes_of_lists_equal_the_encoder(spark):
    documents = lists(random.Random(1), 150)
    found = {r.d: (r.bytes, r.plain_bytes) for r in Z.list_bytes(Z.measured(rows_of(spark, documents), "j"), ["d"], "k").collect()}
    assert found == {d: (compact(E.packed(own)), plain(own)) for d, own in enumerate(documents)}


def test_sizes_of_file_runs_equal_the_encoder_for_any_choice(spark):
    rng = random.Random(4)
    documents = [[{"k": 1, "file": rng.choice("AB")} if not isinstance(r, dict) or not isinstance(r.get("file"), str) else r for r in own] for own in lists(rng, 120)]
    # a file's records stand together, as the encoder's callers have them
    documents = [sorted(own, key=lambda r: r["file"]) for own in documents]
    runs = Z.file_runs(Z.measured(rows_of(spark, documents), "j"), ["d"], "k").cache()
    for files in (["A.sol", 'B".sol', "é", "A", "B"], ["A.sol", "B"], ["none"]):
        chosen = spark.createDataFrame([(d, f) for d in range(len(documents)) for f in files], "d int, file string")
        found = {r.d: r.bytes for r in Z.chosen_section_bytes(runs, chosen, ["d"]).collect()}
        assert found == {d: compact(E.packed([r for r in own if r["file"] in files], in_runs=True)) for d, own in enumerate(documents)}


def test_empty_sizes(spark):
    none = rows_of(spark, []).filter("false")
    assert Z.list_bytes(Z.measured(none, "j"), ["d"], "k").count() == 0 and Z.file_runs(Z.measured(none, "j"), ["d"], "k").count() == 0


@pytest.mark.parametrize("rest", [0, 8, 9, 98, 99, 997, 9_995, 10**9 - 10, 10**15])
def test_a_document_that_states_its_own_size(spark, rest):
    total = spark.range(1).select(Z.stated_total(F.lit(rest)).alias("t")).first().t
    assert total == rest + len(str(total))


def described(status, total, budget, chosen, left, reasons):
    return {"selectionVersion": "1.0", "status": status, "budgetBytes": budget, "estimatedContextBytes": total, "includedFiles": chosen, "excludedFiles": [{"file": f, "reason": r} for f, r in left], "selectionReasons": reasons}


def one_by_one(files, reach, left):
    """files: {name: (rank, size)}; reach: {name: needs}. Sizes are added up anew for each try."""
    size = lambda names: sum(files[f][1] for f in names)
    taken, why = set(), {}
    for f in sorted(files, key=lambda f: (files[f][0], f)):
        if f in taken:
            continue
        if files[f][1] > left:
            why[f] = "file_exceeds_budget_alone"
        elif size(taken | reach[f]) <= left:
            taken |= reach[f]
        else:
            why[f] = "closure_exceeds_budget"
    return taken, {f: w for f, w in why.items() if f not in taken}


def random_groups(rng, count):
    out = {}
    for g in range(count):
        names = [f"f{k}" + '"é' * (k % 3 == 0) for k in range(rng.randint(1, 9))]
        files = {f: (rng.randint(0, 4), rng.choice([10, 50, 200, 700])) for f in names}
        reach = {f: {f} for f in names}
        for _ in range(rng.randint(0, 6)):
            reach[rng.choice(names)].add(rng.choice(names))
        for _ in names:
            for f in names:
                reach[f] = set().union(*(reach[x] for x in reach[f]))
        out[g] = files, reach
    return out


def tables(spark, groups):
    files = spark.createDataFrame([(g, f, *x) for g, (files, _) in groups.items() for f, x in files.items()], "g int, file string, rank int, size long")
    reach = spark.createDataFrame([(g, f, n) for g, (_, reach) in groups.items() for f, needs in reach.items() for n in needs], "g int, file string, need string")
    return files, reach


def test_first_fit_with_closures_equals_a_plain_loop(spark):
    groups = random_groups(random.Random(8), 120)
    files, reach = tables(spark, groups)
    found = {}
    for r in B.select_files(B.candidates(files, reach, "g"), "g", F.lit(400) + F.col("g"), 30).collect():
        found.setdefault(r.g, {})[r.file] = (r.selected, r.reason, r.status)
    for g, (own, needs) in groups.items():
        left = 370 + g
        taken, why = (set(own), {}) if sum(s for _, s in own.values()) <= left else one_by_one(own, needs, left)
        status = "not_needed" if not why and taken == set(own) and sum(s for _, s in own.values()) <= left else "applied" if taken else "failed"
        assert found[g] == {f: (f in taken, why.get(f), status) for f in own}
    assert {x[2] for own in found.values() for x in own.values()} == {"not_needed", "applied", "failed"}


def test_the_gate_states_the_exact_size_of_what_it_sends(spark):
    rng = random.Random(5)
    groups, budget = random_groups(rng, 150), 1500
    files, reach = tables(spark, groups)
    documents = {g: (rng.choice([20, 400, 1200]), rng.choice([None, [], ["MISSING_IMPORT"], BLOCKING[:1], [*BLOCKING, "X"]])) for g in [*groups, 999]}
    docs = spark.createDataFrame([(g, *x) for g, x in documents.items()], "g int, base long, codes array<string>")
    found = {r.g: r for r in B.completeness_gate(docs, files, reach, "g", budget, BLOCKING).collect()}
    seen = set()
    for g, (base, codes) in documents.items():
        own, needs = groups.get(g, ({}, {}))
        whole = base + sum(s for _, s in own.values())
        reasons = [c for c in codes or [] if c in BLOCKING] or (["PROMPT_BUDGET_EXCEEDED"] if whole > budget else None)
        if reasons is None:
            assert (found[g].action, found[g].total, found[g].reasons) == ("unchanged", whole, None)
            continue
        worst = described("applied", budget, budget, sorted(own), [(f, "closure_exceeds_budget") for f in own], reasons)
        left = budget - (plain(worst) - 4) - base
        fits = bool(own) and whole - base <= left
        taken, why = (set(own), {}) if fits else one_by_one(own, needs, left)
        status = "not_needed" if fits else "applied" if taken else "failed"
        seen.add(status)
        if status == "failed":
            assert (found[g].action, found[g].total) == ("failed", None)
            continue
        said = described(status, 0, budget, sorted(taken), sorted(why.items()), reasons)
        rest = base + sum(own[f][1] for f in taken) + plain(said) - 1 + len(', "contextSelection": ')
        assert found[g].action == status and found[g].total == rest + len(str(found[g].total)) <= budget
        assert (found[g].selected, found[g].excluded, found[g].reasons) == (len(taken), len(why), reasons)
    assert seen == {"not_needed", "applied", "failed"}


def test_passes_equal_a_plain_loop(spark):
    groups = random_groups(random.Random(12), 120)
    files, reach = tables(spark, groups)
    found = {}
    for r in B.plan_passes(B.candidates(files, reach, "g"), "g", 420, 20, 3).collect():
        found.setdefault(r.g, set()).add((r.pass_index, r.file, r.role, r.reason))
    for g, (own, needs) in groups.items():
        ranked = sorted(own, key=lambda f: (own[f][0], f))
        size = lambda names, own=own: sum(own[f][1] for f in names)
        left, never, want = set(own), {}, set()
        for k in (1, 2, 3):
            todo = [f for f in ranked if f in left and f not in never]
            while todo and size(needs[todo[0]]) > 400:
                f = todo.pop(0)
                never[f] = "file_exceeds_budget_alone" if own[f][1] > 400 else "closure_exceeds_budget"
            if not todo:
                break
            taken = set()
            for f in todo:
                if size(taken | needs[f]) <= 400:
                    taken |= needs[f]
            want |= {(k, f, "primary" if f in left else "context", None) for f in taken}
            never = {f: w for f, w in never.items() if f not in taken}
            left -= taken
        want |= {(0, f, "unassigned", never.get(f, "max_passes_reached")) for f in left}
        assert found[g] == want
