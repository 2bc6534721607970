import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnbeck.llm import licenses as L
from tarnbeck.llm import sharding as H
from tarnbeck.llm.license_texts import TEMPLATES
from tarnbeck.llm.queries import QUERIES
from tests.llm.data import awkward, empty
from tests.oracle import SF


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 12), unique=True, max_size=12))
def test_rising_run_is_longest(seconds):
    pairs = list(enumerate(seconds))
    best = [1] * len(seconds)
    for i in range(len(seconds)):
        best[i] = 1 + max((best[j] for j in range(i) if seconds[j] < seconds[i]), default=0)
    got = L.rising(pairs)
    assert len(got) == max(best, default=0)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:], strict=False))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
def test_alignment_is_a_common_subsequence(text, template):
    held = L.align(text, template)
    assert all(text[a] == template[b] for a, b in held)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(held, held[1:], strict=False))
    assert len(L.align(text, text)) == len(text)


SCANNER = L.Scanner(TEMPLATES)
BY_NAME = {t.name: t for t in SCANNER.templates}


def plain_finds(text: str, name: str) -> list[tuple]:
    """The finds of one template in a short text by aligning every passage that starts with one of its words."""
    t = BY_NAME[name]
    words = [SCANNER.number.get(w, -1) for w in L.words_of(text)]
    out, done = [], 0

    def aligned(start, end):
        own = words[start:end]
        held = L.align(own, t.words)
        if len(held) / len(t.words) >= L.COVERED - 1e-12 and t.tells(held, own):
            return len(held), start + held[0][0], start + held[-1][0], start + sorted(p - q for p, q in held)[len(held) // 2]

    for k, w in enumerate(words):
        if k < done or w not in t.words:
            continue
        found, n = aligned(k, k + t.span), len(t.words)
        if found:
            tries = [aligned(max(done, found[3] - x), found[3] + n + x) for x in (0, n // 8 + 1, n // 4 + 2)]
            found = max([found, *filter(None, tries)], key=lambda f: (f[0], f[1] - f[2]))
            out.append(found[:3])
            done = found[2] + 1
    return out


def own_finds(text: str, name: str) -> list[tuple]:
    words = np.array([SCANNER.number.get(w, -1) for w in L.words_of(text)], np.int64)
    return sorted((f.n_aligned, f.first_word, f.last_word) for f in BY_NAME[name].finds(words))


def telling(name: str) -> set[int]:
    """Places that a find of the template may not be without."""
    t = BY_NAME[name]
    return {k for group in t.naming for k in group} | {k for places, _ in t.apart for k in places}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_altered_copies_are_found_whatever_words_changed(name):
    """Of the words that don't tell the licence up to a sixth of all are changed or left out, the rarest first or at random."""
    rng = random.Random(name)
    words = L.words_of(TEMPLATES[name])
    free = [k for k in range(len(words)) if k not in telling(name)]
    rare = sorted(free, key=lambda k: (words.count(words[k]), -len(words[k])))
    lost, found_of = min(len(free), len(words) // 6), 0
    for trial in range(10):
        out = set(rare[:lost]) if trial == 0 else set(rng.sample(free, lost))
        copy = [("zzz" if trial % 2 == 0 else "") if k in out else w for k, w in enumerate(words)]
        text = " ".join(["before the license all rights of the work"] * 3 + copy + ["and the software is in all copies"] * 3)
        found = own_finds(text, name)
        found_of += bool(found) and found[0][0] >= L.COVERED * len(words) - 1e-9
        if trial == 0 and len(words) < 60:
            assert found == plain_finds(text, name)
    assert found_of == 10


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_every_pair_of_templates_is_told_apart(name):
    assert [f.license for f in SCANNER.scan(TEMPLATES[name])] == [name]
    for other, text in TEMPLATES.items():
        if other != name:
            found = SCANNER.scan(f"{TEMPLATES[name]} -- and -- {text}")
            assert {f.license for f in found} == {name, other} and all(f.coverage == 1 for f in found)


@pytest.mark.parametrize("name", [n for n in sorted(TEMPLATES) if L.is_short(n) and BY_NAME[n].naming])
def test_a_changed_name_or_number_gives_no_licence(name):
    words = L.words_of(TEMPLATES[name])
    for group in BY_NAME[name].naming:
        for new in ("acme", "9.9", "1"):
            changed = " ".join(new if k in group else w for k, w in enumerate(words))
            assert SCANNER.scan(changed) == [] or new == words[min(group)]


@pytest.mark.parametrize(
    "text",
    ["Released under the Apache License.", "Released under the BSD License.", "The car was released under the old license.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under the Apache License, Version 1.1.",
     "This work is licensed under the GNU General Public License, version 1.", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "This work is licensed under the GNU Lesser General Public License, version 2.",
     "This work is licensed under a Creative Commons Attribution 3.0 International License."],
)
def test_notices_of_licences_that_are_no_templates(text):
    assert SCANNER.scan(text) == []


def test_much_may_be_put_in_between():
    words = L.words_of(TEMPLATES["BSD-3-Clause"])
    for gap in (20, 200, 700):
        text = " ".join(["x"] * 50 + words[:100] + ["y", "of", "the", "z"] * (gap // 4) + words[100:] + ["x"] * 50)
        assert [(f.license, f.n_aligned) for f in SCANNER.scan(text)] == [("BSD-3-Clause", len(words))]
    # a short notice's words far apart are none, and two copies of one aren't one
    assert SCANNER.scan("released under" + " y" * 60 + " the mit license") == []
    assert len(SCANNER.scan("Released under the MIT License. " * 3 + "y " * 100 + "Released under the MIT License.")) == 4


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_each_template_is_found_twice_in_a_text_and_named_best(name):
    text = "some words before. " * 50 + TEMPLATES[name] + " and after " * 50 + TEMPLATES[name]
    found = L.Scanner(TEMPLATES).scan(text)
    assert [f.license for f in found] == [name, name] and all(f.coverage == 1 for f in found)


def test_a_text_of_several_licences_and_ties_by_name():
    text = TEMPLATES["MIT"] + " and then " + TEMPLATES["GPL-3.0-notice"] + " or else " + TEMPLATES["BSD-3-Clause"]
    assert {f.license for f in L.Scanner(TEMPLATES).scan(text)} == {"MIT", "GPL-3.0-notice", "BSD-3-Clause"}
    assert [f.license for f in L.Scanner({"b": "one two three", "a": "one two three"}).scan("one two three")] == ["a"]


def test_licence_query_equals_brute_force(spark):
    """On texts of up to 300 words, by templates of up to 12 words: all else is too slow to align everywhere."""
    rows = {r.doc_id: r for r in QUERIES["op5_license_scan"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    short = [n for n, t in TEMPLATES.items() if len(L.words_of(t)) <= 12]
    for d in docs:
        if len(L.words_of(d.text or "")) <= 300:
            best = max(((n, n / len(L.words_of(TEMPLATES[name])), name) for name in short for n, _, _ in plain_finds(d.text or "", name)), key=lambda x: (x[0], x[1], [-ord(c) for c in x[2]]), default=(0, 0.0, None))
            assert (rows[d.doc_id].n_aligned, rows[d.doc_id].coverage, rows[d.doc_id].license) == best


def test_awkward_licence_rows(spark):
    out, names = L.scanned(awkward(spark, ["Released under the MIT License.\n" * 5000]))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[15][names["license"]] == "MIT-notice" and len(rows[15][names["finds"]]) == 5000
    assert all(r[names["license"]] is None and r[names["finds"]] == [] for k, r in rows.items() if k != 15)
    assert L.scanned(empty(spark))[0].count() == 0


def shards_of(spark, docs, shards=8):
    rows = H.sharded(docs, shards).collect()
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    return rows


def test_shards_are_even_and_groups_stay_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = shards_of(spark, docs)
    assert len(rows) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    loads, n = Counter(), Counter()
    for r in rows:
        t = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        loads[r.shard] += r.size
        n[r.shard] += 1
    assert max(loads.values()) - min(loads.values()) <= 0.001 * sum(loads.values())
    assert max(n.values()) < 1.15 * min(n.values())
    where = {}
    for r in rows:
        where.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_a_hot_group_is_split(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('hot ', 20), concat('text ', id)) as text")
    loads = Counter()
    for r in shards_of(spark, docs):
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) <= 0.01 * sum(loads.values())


def test_awkward_shards(spark):
    assert len(shards_of(spark, awkward(spark))) == awkward(spark).count()
    assert H.sharded(empty(spark)).count() == 0


def test_placement_balances_all_dimensions():
    rng = np.random.default_rng(0)
    items = np.round(1000 * rng.lognormal(0, 1, (2000, 3)))
    where = H.place(items, 8)
    loads = np.stack([np.bincount(where, items[:, k], 8) for k in range(3)])
    assert (loads.max(1) / loads.min(1) < 1.1).all() and loads[0].max() / loads[0].min() < 1.0001


def test_many_short_copies_spread_over_the_shards(spark):
    texts = ["no"] * 1500 + [None] * 1500 + [f"{k} " * (200 + k % 77) for k in range(3000)]
    rows = H.sharded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    for value in (lambda r: r["size"], lambda r: r.tokens, lambda r: 1):
        loads = Counter()
        for r in rows:
            loads[r.shard] += value(r)
        assert len(loads) == 8 and max(loads.values()) <= 1.25 * sum(loads.values()) / 8
    assert {r.tokens for r in rows if r.doc_id >= 3000 and (r.doc_id - 3000) % 77 == 0} == {200}
    assert {r.tokens for r in rows if 1500 <= r.doc_id < 3000} == {0}
