"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of a lexicon (words and word beginnings, and the same after obfuscation is undone), how near its hits
stand to words of the second person, capitals, punctuation and obfuscation rates. The lexicon is learned: the words and
beginnings of words whose document frequency leans most to toxic among the fitting rows, at most LEXICON of them. Trees and calibration are Spark
ML's. Only rows whose crc32(id as text) mod 5 is not 0 are learned from; of these at most FIT_ROWS, the first in the order
of a hash of their id, so the sample's size is bounded and does not depend on the input's order. One fold of the rest
(mod 5 = 1) fits the calibration alone. Scoring is one pass over each row, without a shuffle.

Labels, language, source and id are never inputs of a score. Defined results: a null or empty text has all features 0 and
gets the score of such texts; conflicting labels of one id count as toxic, null labels are ignored, of
several texts of one id the greatest is learned from; repeated rows are scored
each; with no labels of both kinds every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.llm.columns import free_names, with_python_columns
from tarnbeck.llm.common import stored, table

#: Labelled rows that are learned from, at most; words of the lexicon, at most; documents a word must be in.
FIT_ROWS, LEXICON, LEAST_DOCS = 12_000, 400, 4
#: A word enters the lexicon when this share of its smoothed document frequency is toxic.
LEAN = 0.9
#: Lengths of word beginnings, which catch the forms of one stem. A lexicon holds them with a "^" before.
STEMS = (4, 5, 6, 7)
TREES, DEPTH = 20, 4
NEAR = 6
# Words of the second person in four languages, and what stands for letters in obfuscated words.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen euch euer ihr sie ihnen tú ti tus usted ustedes vosotros vuestro".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t", "€": "e"})
STRIP = " .,;:!?\"'()[]{}«»“”‘’…-–—*#%&|<>_~/\\"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRETCHED = re.compile(r"(.)\1{2,}")
INNER = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]")
FEATURES = ["lexicon_rate", "lexicon_weight", "lexicon_most", "lexicon_any", "lexicon_distinct", "hidden_rate", "hidden_any", "second_person", "near_second", "nearest", "capitals", "shouted", "exclaims", "questions", "punctuation", "obfuscated", "stretched", "size"]


def plain(word: str) -> str:
    return word.lower().strip(STRIP)


def unhidden(word: str) -> str:
    """The word with look-alikes turned to letters, what else is not a letter left out and stretched letters once."""
    return STRETCHED.sub(r"\1", "".join(c for c in word.lower().translate(LOOKALIKE) if c.isalpha()))


def entries(word: str) -> list[str]:
    """The word and its beginnings, as a lexicon would hold them."""
    return [word, *["^" + word[:k] for k in STEMS if len(word) > k]]


class Lexicon:
    """Word -> log odds of toxic, of the word itself or its most telling beginning; 0 for all others."""

    def __init__(self, odds: dict[str, float]):
        self.odds = odds
        self.heads = frozenset(w.removeprefix("^")[: STEMS[0]] for w in odds)

    def __call__(self, word: str) -> float:
        if word[: STEMS[0]] not in self.heads:
            return 0.0
        return max([self.odds.get(w, 0.0) for w in entries(word)])


def features(text: str, lexicon: Lexicon) -> list[float]:
    tokens = text.split()
    if not tokens:
        return [0.0] * len(FEATURES)
    n, chars = len(tokens), len(text)
    words = [plain(w) for w in tokens]
    heads = lexicon.heads
    weight = {k: x for k, w in enumerate(words) if w[:4] in heads and (x := lexicon(w))}
    at = list(weight)
    odd = [k for k, w in enumerate(tokens) if INNER.search(w) or STRETCHED.search(w)]
    hidden = [k for k in odd if k not in weight and lexicon(unhidden(tokens[k]))]
    you = np.array([k for k, w in enumerate(words) if w in SECOND_PERSON])
    hits = np.array(sorted(at + hidden))
    near = nearest = 0.0
    if len(hits) and len(you):
        p = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(hits - you[np.minimum(p, len(you) - 1)]), np.abs(hits - you[np.maximum(p - 1, 0)]))
        near, nearest = float((gap <= NEAR).sum()), 1.0 / (1.0 + float(gap.min()))
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    return [
        (len(at) + len(hidden)) / n, sum(weight.values()) / n, max(weight.values(), default=0.0), float(len(at)), float(len({words[k] for k in at})), len(hidden) / n, float(len(hidden)),
        len(you) / n, near, nearest, upper / max(letters, 1), sum(w.isupper() and len(w) > 1 for w in tokens) / n, text.count("!") / chars, text.count("?") / chars,
        sum(map(text.count, ".,;:!?*#%&$@|")) / chars, len(odd) / n, sum(STRETCHED.search(tokens[k]) is not None for k in odd) / n, math.log1p(n),
    ]


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def fit_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int = FIT_ROWS) -> DataFrame:
    """(id, text, label, fold) of at most ``most`` labelled ids that may be learned from; of an id's texts the greatest."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    ids = ids.withColumn("fold", fold(F.col("id"))).filter("fold <> 0").orderBy(F.xxhash64("id"), "id").limit(most)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").groupBy("id", "label", "fold").agg(F.max("text").alias("text"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Word -> log odds of toxic, from document frequencies; the sample is bounded, and so are the words returned."""

    def distinct(texts: list[str]) -> list[pa.Array]:
        found = ({w for w in map(plain, t.split()) if w} | {w for x in t.split() if (INNER.search(x) or STRETCHED.search(x)) and (w := unhidden(x))} for t in texts)
        return [pa.array([sorted({e for w in words for e in entries(w)}) for words in found], pa.list_(pa.string()))]

    words = with_python_columns(rows.select("text", "label"), "text", [("words", T.ArrayType(T.StringType()))], lambda: distinct)
    sums = rows.agg(F.sum("label").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = sums.t or 0, (sums.n or 0) - (sums.t or 0)
    if not toxic or not clean:
        return Lexicon({})
    by_word = words.select(F.explode("words").alias("word"), "label").groupBy("word").agg(F.sum("label").alias("t"), F.count("*").alias("n")).filter(F.col("t") >= LEAST_DOCS)
    share = (F.col("t") + 0.5) / (toxic + 1)
    other = (F.col("n") - F.col("t") + 0.5) / (clean + 1)
    lean = by_word.select("word", "t", F.log(share / other).alias("odds")).filter(share / (share + other) >= LEAN)
    top = lean.orderBy((F.col("odds") * F.sqrt("t")).desc(), "word").limit(LEXICON).collect()
    return Lexicon({r.word: float(r.odds) for r in top})


class Scorer:
    """A fitted lexicon, trees and calibration."""

    def __init__(self, rows: DataFrame):
        rows = stored(rows, "fit")
        kinds = Counter(r[0] for r in rows.select("label").distinct().collect())
        self.lexicon = learn_lexicon(rows.filter("fold <> 1")) if len(kinds) > 1 else Lexicon({})
        self.trees = self.steps = None
        if len(kinds) < 2 or rows.filter("fold <> 1").select("label").distinct().count() < 2:
            return
        fit = stored(self._vectors(rows, "text").select("label", "fold", "vector").coalesce(4), "vectors")
        own = fit.filter("fold <> 1").cache()
        gbt = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=10, seed=7, subsamplingRate=1.0)
        self.trees = gbt.fit(own).setPredictionCol("tree_label").setProbabilityCol("tree_share").setRawPredictionCol("tree_raw")
        own.unpersist()
        held = self.trees.transform(fit.filter("fold = 1")).select("label", vector_to_array("tree_share")[1].alias("share"))
        if held.select("label").distinct().count() < 2:
            self.steps = [(0.0, 0.0), (1.0, 1.0)]  # nothing to calibrate by: the trees' own share
            return
        iso = IsotonicRegression(featuresCol="share", labelCol="label").fit(held)
        self.steps = list(zip(iso.boundaries.toArray().tolist(), iso.predictions.toArray().tolist(), strict=True))

    def _vectors(self, rows: DataFrame, text_col: str) -> DataFrame:
        lexicon = self.lexicon

        def made(texts: list[str]) -> list[pa.Array]:
            return [pa.array([features(t, lexicon) for t in texts], pa.list_(pa.float64()))]

        name = free_names(rows, ["dense"])[0]
        out = with_python_columns(rows, text_col, [(name, T.ArrayType(T.DoubleType()))], lambda: made)
        return out.withColumn(free_names(rows, ["vector"])[0], array_to_vector(name)).drop(name)

    def _calibrated(self, share: Column) -> Column:
        """The isotonic steps by linear interpolation; a thousandth of the trees' own share keeps the order within a step."""
        xs, ys = F.array(*[F.lit(x) for x, _ in self.steps]), F.array(*[F.lit(y) for _, y in self.steps])
        above = F.size(F.filter(xs, lambda x: x <= share))
        last = len(self.steps)
        x0, x1 = F.get(xs, F.greatest(above - 1, F.lit(0))), F.get(xs, F.least(above, F.lit(last - 1)))
        y0, y1 = F.get(ys, F.greatest(above - 1, F.lit(0))), F.get(ys, F.least(above, F.lit(last - 1)))
        between = y0 + (y1 - y0) * F.when(x1 > x0, (share - x0) / (x1 - x0)).otherwise(0.0)
        y = F.when(above == 0, F.lit(self.steps[0][1])).when(above >= last, F.lit(self.steps[-1][1])).otherwise(between)
        return 0.999 * y + 0.001 * share

    def score(self, docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
        """``docs`` with a score from 0 to 1, and its column's name."""
        name = free_names(docs, ["score"])[0]
        if self.trees is None:
            return docs.withColumn(name, F.lit(0.0)), name
        column = {"vector": free_names(docs, ["vector"])[0]}
        rows = self._vectors(docs, text_col)
        taken = free_names(rows, ["tree_label", "tree_share", "tree_raw"])
        trees = self.trees.copy().setFeaturesCol(column["vector"]).setPredictionCol(taken[0]).setProbabilityCol(taken[1]).setRawPredictionCol(taken[2])
        out = trees.transform(rows).withColumn(name, self._calibrated(vector_to_array(taken[1])[1]))
        return out.select(*docs.columns, name), name


def scorer(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = FIT_ROWS) -> Scorer:
    return Scorer(fit_rows(docs, labels, id_col, text_col, label_col, most))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, score = scorer(docs, table(spark, sf_dir, "labels")).score(docs)
    s = F.col(score)
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns."""
    rows, score = scorer(docs, labels, id_col, text_col).score(docs, text_col)
    return rows.filter(F.col(score) < 0.5).select(*docs.columns)
