import math
import re

import numpy as np
import pytest

from tarnbeck.llm import quality as Q
from tarnbeck.llm.queries import QUERIES
from tests.llm.data import ODD, awkward, empty
from tests.oracle import SF


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    inside = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


@pytest.mark.parametrize("text", [t or "" for t in ODD] + ["a b c d e f g h i " * 3, "x\nx\n \n \nx|y", "q " * 9])
def test_base_counts(text):
    assert Q.base_counts(text) == plain_counts(text)


def one_model(docs):
    return Q.gram_counts(docs).groupBy("key").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")


class Plain:
    """Interpolated modified Kneser-Ney from its definition, on dictionaries."""

    def __init__(self, texts):
        self.counts = [{} for _ in range(5)]
        for t in texts:
            s = "\x02\x02\x02" + t
            for i in range(3, len(s)):
                self.counts[4][s[i - 3 : i + 1]] = self.counts[4].get(s[i - 3 : i + 1], 0) + 1
        for n in (3, 2, 1):
            for g in self.counts[n + 1]:
                self.counts[n][g[1:]] = self.counts[n].get(g[1:], 0) + 1
        self.d = [None] + [self.discounts(self.counts[n]) for n in range(1, 5)]

    def discounts(self, c):
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        if not n1 or not n2:
            return [0.5, 0.75, 0.9]
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return [min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)]

    def p(self, gram):
        n = len(gram)
        c, d = self.counts[n], self.d[n]
        own = {g: v for g, v in c.items() if g[:-1] == gram[:-1]}
        less = lambda v: d[min(v, 3) - 1]
        total = sum(own.values())
        lower = 1 / (len(c) + 1) if n == 1 else self.p(gram[1:])
        if not total:
            return lower
        mass = sum(map(less, own.values())) / total
        return (max(own[gram] - less(own[gram]), 0) / total if gram in own else 0) + mass * lower

    def cost(self, t):
        s = "\x02\x02\x02" + t
        return -sum(math.log(self.p(s[i - 3 : i + 1])) for i in range(3, len(s))) / len(t)


def test_model_equals_its_definition_by_both_ways(spark):
    texts = ["abracadabra abra", "banana band", "abba 🙂 ab", "zz"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model = Q.kneser_ney(one_model(docs))
    plain = Plain([t.replace("🙂", "") for t in texts])
    others = spark.createDataFrame([(0, "abracadabra"), (1, "xyz qq"), (2, "ban zz 🙂"), (3, "é"), (4, None)], "doc_id long, text string")
    for most in (1000, 0):
        rows, names = Q.scored(others, model=model, model_rows=most)
        got = {r.doc_id: r[names["cost"]] for r in rows.collect()}
        for i, t in [(0, "abracadabra"), (1, "xyz qq"), (2, "ban zz "), (3, "é")]:
            assert got[i] == pytest.approx(plain.cost(t), rel=1e-5)
        assert got[4] is None


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat, the rat")], "doc_id long, text string")
    model = Q.kneser_ney(one_model(docs)).toPandas()
    a = Q.Arrays(model.kind.to_numpy(), model.key.to_numpy(), model.value.to_numpy())
    letters = sorted(set("the cat sat on the mat, the rat")) + ["Q"]
    context = [ord(c) for c in "the"]
    keys = np.array([context[0] << 48 | context[1] << 32 | context[2] << 16 | ord(c) for c in letters], np.uint64)
    assert np.exp(a.log_p(keys)).sum() == pytest.approx(1, abs=1e-4)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows, names = Q.judged(docs)
    got = rows.collect()
    assert len(got) == docs.count()
    for r in got:
        assert tuple(r[names[c]] for c in Q.BASE) == plain_counts(r.text or "")
        if r[names["base_failed"]]:
            assert r[names["kept"]] is False
    assert Q.keep_good(docs).columns == docs.columns
    assert Q.keep_good(empty(spark)).count() == 0


def test_query_keeps_clean_documents(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        n, chars, symbols, lines, repeated = plain_counts(docs[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
    good = [r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()]
    assert sum(not rows[i].kept and not rows[i].base_failed for i in good) <= 0.01 * len(good)


def test_gibberish_is_rejected(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "and", "river", "stone", "water", "light", "over", "under"], 60)) for _ in range(300)]
    bad = "".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, 200))
    bad = " ".join(bad[k : k + 3] for k in range(0, 200, 3))
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*good, bad])], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in Q.keep_good(docs).collect()}
    assert kept == set(range(300))
    both = [{r.doc_id: r[n["cost"]] for r in rows.collect()} for rows, n in (Q.scored(docs), Q.scored(docs, model_rows=0))]
    assert both[0] == pytest.approx(both[1], rel=1e-5)


def test_both_bands_reject_labelled_junk(spark):
    sf = "/root/testdata/sf0.1"
    rows, names = Q.scored(spark.read.parquet(f"{sf}/documents.parquet"))
    rows, low, high = Q.banded(rows.cache(), names)
    rows = rows.filter(~Q.base_failed(Q.F.col(names["n_words"]), Q.F.col(names["n_repeat_words"]))).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    cost = Q.F.col(names["cost"])
    got = {r.quality: r for r in rows.groupBy("quality").agg(Q.F.count("*").alias("n"), Q.F.count_if(cost < low).alias("low"), Q.F.count_if(cost > high).alias("high")).collect()}
    assert got[0].low >= 1 and got[0].high >= 0.2 * got[0].n
    assert got[1].low + got[1].high <= 0.01 * got[1].n


def test_gibberish_of_a_rare_language_is_rejected(spark):
    rng = np.random.default_rng(2)
    good = [" ".join(rng.choice(["the", "and", "river", "stone", "water", "light", "over", "under"], 60)) for _ in range(302)]
    bad = " ".join("".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9000, 3)) for _ in range(66))
    langs = ["en"] * 300 + ["xx", None, "xx"]
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(zip([*good, bad], langs, strict=True))], "doc_id long, text string, lang string")
    assert {r.doc_id for r in Q.keep_good(docs).collect()} == set(range(302))
