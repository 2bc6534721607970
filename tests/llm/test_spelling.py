import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnbeck.llm.spelling import OP12_SQL, Trie, near_words, op12_spelling_variants, spelling_variants, tries
from tests.llm.data import awkward, empty
from tests.oracle import SF, check


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs, least=6, count=5, ratio=5, every=199):
    """Every pair of words, letter by letter."""
    letter = lambda c: "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ"
    n = Counter()
    for k, text in docs:
        runs = "".join((c.lower() if "A" <= c <= "Z" else c) if letter(c) else " " for c in text or "").split(" ")
        for run in filter(None, runs):
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    n = {w: c for w, c in n.items() if c >= count}
    near = {w: sorted((-n[x], x) for x in n if one_apart(w, x)) for w in n}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= ratio * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=40), st.sets(st.text("abé", min_size=1, max_size=6), min_size=1, max_size=20))
def test_automaton_and_trie_find_all_pairs(words, sought):
    words, sought = sorted(words), sorted(sought)
    trie = Trie.unpacked(Trie.of(words, np.ones(len(words), np.int64)).packed())
    assert [trie.word(k) for k in range(len(words))] == words
    found = sorted(zip(*(x.tolist() for x in near_words(trie, sought)), strict=True))
    assert found == [(i, j) for i, a in enumerate(sought) for j, b in enumerate(words) if one_apart(a, b)]


def test_query_equals_its_sql(spark):
    check(spark, op12_spelling_variants, OP12_SQL, SF)


def test_many_tries_and_rounds_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = ["colour", "color", "colours", "colouur", "cölour", "aaaaaa", "aaaaaaa", "aaaaaaaa", "Colour", "vÀlley", "valley", "valleys"]
    words += ["".join(rng.choice(list("abc"), rng.integers(5, 9))) for _ in range(60)]
    weights = 1 / np.arange(1, len(words) + 1) ** 1.6
    docs = [(k, " ".join(rng.choice(words, 90, p=weights / weights.sum()))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for nodes, size in ((1 << 20, 1 << 26), (40, 3000), (1, 1)):
        assert got(spelling_variants(df, every=7, nodes=nodes, round_bytes=size)) == plain(docs, every=7)
    want = plain(docs, 1, 2, 2, 3)
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain
    assert got(spelling_variants(df, least_points=1, least_count=2, ratio=2, every=3)) == want


def test_awkward_rows(spark):
    df = awkward(spark, ["x" * 50_000 + " same texts " * 6, "sametext sametexts " * 5])
    assert got(spelling_variants(df)) == plain([(r.doc_id, r.text) for r in df.collect()])
    none = spelling_variants(empty(spark))
    assert none.collect() == [] and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_one_long_word_has_its_own_trie(spark):
    df = spark.createDataFrame([("a" * 500, 5), ("a" * 501, 9), ("b", 7)], "word string, n long")
    rows = tries(df, 300).select("first", F.length("counts").alias("size")).collect()
    assert sorted((r["first"][:1], r.size) for r in rows) == [("a", 8), ("a", 8), ("b", 8)]
