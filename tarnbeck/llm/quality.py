"""Quality rules: plain counts of each text, and perplexity bands of a character 4-gram model.

The model is modified Kneser-Ney with interpolation. Spark counts the 4-grams of all documents (each task sums its own
before the shuffle), derives the continuation counts of the lower orders, the discounts and the interpolated
probabilities with joins, and stores the model as sorted arrays: an n-gram is hashed to a 64-bit key, 16 bits a character
(without loss for characters below U+10000), and looked up by binary search. A text would look likely to a model that has counted it, so there are two, each
of the texts of one fold (by a hash of the text, so copies stay together), and a text is scored by the other fold's. While
the models have at most MODEL_ROWS entries they are broadcast; larger ones stay a table, and the distinct 4-grams of each
document are joined to it instead.

A document's figure is its mean negative log probability a character. Each language has its own lower and upper band
around the median of its documents: a number of spreads (from the quartiles) that widens for short texts. The numbers are
set from the labelled documents: the README has the junk and the clean documents that each rejects. A language of fewer than LEAST_DOCS documents has the bands of all
languages' documents together.

Defined results: a null or empty text has no words and fails the base rules; a null language is a language of its own;
repeated rows are scored each and all count in the model; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnbeck.llm.columns import free_names, with_python_columns
from tarnbeck.llm.common import BLANKS, bounded_batches, stored, table

ORDER = 4
#: Entries of a model that is broadcast, 12 bytes each.
MODEL_ROWS = 4_000_000
#: Distinct 4-grams that a task holds before it passes their counts on, and characters it looks at together.
HELD, CHARS = 1 << 20, 1 << 20
PAD = "\x02" * (ORDER - 1)
#: Bands: spreads below and above a language's median; a spread is the quartiles' distance / 1.349, SPREAD at least, and
#: grows by SHORT / sqrt(characters).
LOWER, UPPER, SPREAD, SHORT = 3.5, 3.5, 0.02, 0.5
LEAST_DOCS = 40
#: Languages whose bands are broadcast at most.
BANDS = 10_000
FOLDS = 2
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"
MIX = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(WINDOW)], np.uint64)


# --- base rules


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a window of WINDOW words that occurs twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        x = ids[k : k + n] * MIX[k]
        h += x ^ (x >> np.uint64(29))
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, h)
    starts = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == h)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


# --- the model


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The key of the 4-gram that ends at each character of the texts, one after the other, and the texts' lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    c = np.frombuffer((PAD + PAD.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) & np.uint64(0xFFFF)
    keys = c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:] if len(c) > 3 else np.empty(0, np.uint64)
    starts = np.cumsum(sizes + 3) - (sizes + 3)
    keep = np.zeros(len(keys) + 3, bool)
    real = sizes > 0
    edge = np.zeros(len(keys) + 4, np.int64)
    np.add.at(edge, starts[real], 1)
    np.add.at(edge, (starts + sizes)[real], -1)
    keep = np.cumsum(edge)[: len(keys)] > 0
    return keys[keep], sizes


def chunks(texts: list[str], most: int = CHARS) -> Iterator[list[str]]:
    """The texts in runs of about ``most`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their counts (sums of n)."""
    if n is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def fold_of(text: str) -> int:
    return zlib.crc32(text.encode()) % FOLDS


def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(fold, key, n): the 4-grams of all texts, by fold."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(FOLDS)]
        held = [0] * FOLDS

        def merged(fold: int) -> tuple[np.ndarray, np.ndarray]:
            return counted(np.concatenate([k for k, _ in parts[fold]]), np.concatenate([n for _, n in parts[fold]]))

        def out(fold: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), fold, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["fold", "key", "n"])

        for b in batches:
            own = [t or "" for t in b.column(0).to_pylist()]
            folds = list(map(fold_of, own))
            for fold in range(FOLDS):
                for texts in chunks([t for t, f in zip(own, folds, strict=True) if f == fold]):
                    parts[fold].append(counted(grams(texts)[0]))
                    held[fold] += len(parts[fold][-1][0])
                    if held[fold] > 4 * HELD:
                        keys, n = merged(fold)
                        parts[fold], held[fold] = [(keys, n)], len(keys)
                        if held[fold] > HELD:
                            yield out(fold, keys, n)
                            parts[fold], held[fold] = [], 0
        for fold in range(FOLDS):
            if parts[fold]:
                yield out(fold, *merged(fold))

    return docs.select(text_col).mapInArrow(run, "fold int, key long, n long").groupBy("fold", "key").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of an order from its counts of counts (one row)."""
    r = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = r
    if not n1 or not n2:
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.1), k + 0.9) for k, x in enumerate(d)]


def cross_models(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(fold, kind, key, value): for the texts of each fold, the model of the other one."""
    counts = stored(gram_counts(docs, text_col), "counts")
    out = None
    for fold in range(FOLDS):
        one = kneser_ney(counts.filter(F.col("fold") == fold).select("key", "n")).select(F.lit(FOLDS - 1 - fold).alias("fold"), "kind", "key", "value")
        out = one if out is None else out.union(one)
    return out


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(kind, key, value): kind n = 1..4 has log probabilities of n-grams, kind 10 + n the log back-off weight of the
    contexts of order n (key: the n - 1 characters before), kind 0 that of a character never seen."""
    levels = {ORDER: stored(counts, "grams")}
    for n in range(ORDER - 1, 0, -1):
        cut = F.col("key").bitwiseAND((1 << 16 * n) - 1)
        levels[n] = stored(levels[n + 1].select(cut.alias("key")).groupBy("key").agg(F.count("*").alias("n")), "grams")
    total, kinds = levels[1].agg(F.sum("n"), F.count("*")).first()
    if not total:
        return counts.sparkSession.createDataFrame([(0, 0, 0.0)], "kind int, key long, value double")

    def less(d: list[float]) -> Column:
        return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])

    d = discounts(levels[1])
    mass = levels[1].agg(F.sum(less(d))).first()[0] / total
    unseen = mass / (kinds + 1)
    below = levels[1].select("key", ((F.col("n") - less(d)) / total + unseen).alias("p"))
    out = [counts.sparkSession.createDataFrame([(0, 0, math.log(unseen))], "kind int, key long, value double")]
    out.append(below.select(F.lit(1).alias("kind"), "key", F.log("p").alias("value")))
    for n in range(2, ORDER + 1):
        d = discounts(levels[n])
        own = levels[n].withColumns({"context": F.shiftrightunsigned("key", 16), "suffix": F.col("key").bitwiseAND((1 << 16 * (n - 1)) - 1)})
        context = own.groupBy("context").agg(F.sum("n").alias("all"), (F.sum(less(d)) / F.sum("n")).alias("gamma"))
        rows = own.join(context, "context").join(below.select(F.col("key").alias("suffix"), F.col("p").alias("lower")), "suffix")
        below = stored(rows.select("key", ((F.col("n") - less(d)) / F.col("all") + F.col("gamma") * F.col("lower")).alias("p")), "level")
        out += [below.select(F.lit(n).alias("kind"), "key", F.log("p").alias("value")), context.select(F.lit(10 + n).alias("kind"), F.col("context").alias("key"), F.log("gamma").alias("value"))]
    model = out[0]
    for x in out[1:]:
        model = model.union(x)
    return stored(model, "model")


class Arrays:
    """A model in sorted arrays."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, value: np.ndarray):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in np.unique(kind):
            keys, values = key[kind == k].astype(np.int64).view(np.uint64), value[kind == k].astype(np.float32)
            order = np.argsort(keys)
            self.of[int(k)] = keys[order], values[order]

    def find(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the array has, and their values (0 for others)."""
        own, values = self.of.get(kind, (np.empty(0, np.uint64), np.empty(0, np.float32)))
        if not len(own):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        hit = own[at] == keys
        return hit, np.where(hit, values[at], 0).astype(np.float64)

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """The log probability of each 4-gram's last character after the others."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            k = keys[left] & np.uint64((1 << 16 * n) - 1)
            hit, value = self.find(n, k)
            out[left] += value
            left, k = left[~hit], k[~hit]
            if n > 1 and len(left):
                out[left] += self.find(10 + n, k >> np.uint64(16))[1]
        out[left] += float(self.of[0][1][0])
        return out

    def costs(self, texts: list[str]) -> list[float | None]:
        """Each text's mean negative log probability a character; none for an empty text."""
        out: list[float | None] = []
        for some in chunks(texts):
            keys, sizes = grams(some)
            distinct, back = np.unique(keys, return_inverse=True) if len(keys) else (keys, np.empty(0, np.int64))
            p = np.append(self.log_p(distinct)[back] if len(keys) else np.empty(0), 0.0)
            starts = np.cumsum(sizes) - sizes
            sums = np.add.reduceat(p, np.minimum(starts, len(p) - 1))
            out += [-float(s) / int(n) if n else None for s, n in zip(sums, sizes, strict=True)]
        return out


def joined_costs(docs: DataFrame, row_col: str, text_col: str, model: DataFrame) -> DataFrame:
    """(row_col, cost) by joins, for models too large to broadcast: the distinct 4-grams of each text meet each level of its
    fold's model in turn. ``row_col`` must tell rows apart."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                keys, n = counted(grams([t or ""])[0])
                ids = pa.array(np.full(len(keys), b.column(0)[i].as_py()), b.column(0).type)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(keys), fold_of(t or ""), np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=[row_col, "fold", "key", "n"])

    kind = docs.schema[row_col].dataType.simpleString()
    rows = docs.select(row_col, text_col).mapInArrow(run, f"{row_col} {kind}, fold int, key long, n long").withColumns({"log_p": F.lit(0.0), "open": F.lit(True)})
    # values in single precision, as the arrays hold them, so that both ways give one figure
    level = lambda k: model.filter(F.col("kind") == k).withColumn("value", F.col("value").cast("float").cast("double"))
    for n in range(ORDER, 0, -1):
        cut = F.col("key").bitwiseAND((1 << 16 * n) - 1) if n < ORDER else F.col("key")
        rows = rows.withColumn("at", cut).join(level(n).select("fold", F.col("key").alias("at"), F.col("value").alias("v")), ["fold", "at"], "left")
        rows = rows.withColumns({"log_p": F.when(F.col("open") & F.col("v").isNotNull(), F.col("log_p") + F.col("v")).otherwise(F.col("log_p")), "open": F.col("open") & F.col("v").isNull()}).drop("v")
        if n > 1:
            rows = rows.withColumn("at", F.shiftrightunsigned("at", 16)).join(level(10 + n).select("fold", F.col("key").alias("at"), F.col("value").alias("v")), ["fold", "at"], "left")
            rows = rows.withColumn("log_p", F.when(F.col("open"), F.col("log_p") + F.coalesce("v", F.lit(0.0))).otherwise(F.col("log_p"))).drop("v")
    unseen = F.create_map(*[F.lit(x) for r in level(0).collect() for x in (r.fold, r.value)])
    p = F.when(F.col("open"), F.col("log_p") + F.try_element_at(unseen, F.col("fold"))).otherwise(F.col("log_p"))
    return rows.groupBy(row_col).agg((-F.sum(p * F.col("n")) / F.sum("n")).alias("cost"))


# --- scores and bands


def scored(docs: DataFrame, text_col: str = "text", model: DataFrame | None = None, model_rows: int = MODEL_ROWS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the base counts and ``cost``; and the new columns' names, which avoid those of ``docs``. The models are those
    of the other fold, or the one that is given (kind, key, value)."""
    spark = docs.sparkSession
    if model is None:
        model = cross_models(docs, text_col)
    else:
        model = model.withColumn("fold", F.explode(F.array(*map(F.lit, range(FOLDS)))))
    names = dict(zip([*BASE, "cost", "chars"], free_names(docs, [*BASE, "cost", "chars"]), strict=True))
    fields = [(names[c], T.LongType()) for c in BASE]
    small = model.count() <= model_rows
    arrays = None
    if small:
        got = model.toArrow()
        fold, *rest = (got.column(c).to_numpy() for c in ("fold", "kind", "key", "value"))
        arrays = spark.sparkContext.broadcast([Arrays(*[x[fold == k] for x in rest]) for k in range(FOLDS)])

    def work():
        def made(texts: list[str]) -> list[pa.Array]:
            base = list(zip(*map(base_counts, texts), strict=True)) or [[]] * len(BASE)
            out = [pa.array(x, pa.int64()) for x in base]
            out.append(pa.array(list(map(len, texts)), pa.int64()))
            if not small:
                return out
            folds, costs = list(map(fold_of, texts)), [None] * len(texts)
            for k in range(FOLDS):
                at = [i for i, f in enumerate(folds) if f == k]
                for i, x in zip(at, arrays.value[k].costs([texts[i] for i in at]), strict=True):
                    costs[i] = x
            return [*out, pa.array(costs, pa.float64())]

        return made

    fields.append((names["chars"], T.LongType()))
    if small:
        return with_python_columns(docs, text_col, [*fields, (names["cost"], T.DoubleType())], work), names
    row = free_names(docs, ["row"])[0]
    own = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    costs = joined_costs(own, row, text_col, model).withColumnRenamed("cost", names["cost"])
    return with_python_columns(own, text_col, fields, work).join(costs, row, "left").drop(row), names


def banded(rows: DataFrame, names: dict[str, str], lang_col: str = "lang") -> tuple[DataFrame, Column, Column]:
    """``rows`` with each language's median and spread; the columns lower and upper of the costs that stay."""
    lang, mid, spread = free_names(rows, ["band_lang", "band_mid", "band_spread"])
    own = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    q = F.percentile_approx(names["cost"], [0.25, 0.5, 0.75], 10_000)
    passed = rows.filter(~base_failed(F.col(names["n_words"]), F.col(names["n_repeat_words"])))
    both = [F.col("q")[1].alias(mid), F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(SPREAD)).alias(spread)]
    bands = passed.groupBy(own.alias(lang)).agg(q.alias("q"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    bands = stored(bands.select(lang, *both), "bands")
    pooled = passed.agg(q.alias("q")).select(*both).first()
    # one row a language; joined by a broadcast of a checked size, or a language of most rows would be one task's
    if bands.count() <= BANDS:
        bands = F.broadcast(bands)
    out = rows.join(bands, own == F.col(lang), "left").drop(lang)
    for c in (mid, spread):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(pooled[c]).cast("double")))
    wide = F.col(spread) + SHORT / F.sqrt(F.greatest(F.col(names["chars"]), F.lit(1)))
    return out, F.col(mid) - LOWER * wide, F.col(mid) + UPPER * wide


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` of ``docs`` (all) with base counts, cost, base_failed and kept."""
    rows, names = scored(docs, text_col)
    own = [text_col, *(keep or [])] if keep else docs.columns
    rows = stored(rows.select(*[c for c in own if not keep or c in keep or c == lang_col], *names.values()) if keep else rows, "scored")
    rows, low, high = banded(rows, names, lang_col)
    failed, kept = free_names(rows, ["base_failed", "kept"])
    rows = rows.withColumn(failed, base_failed(F.col(names["n_words"]), F.col(names["n_repeat_words"])))
    rows = rows.withColumn(kept, ~F.col(failed) & F.coalesce(F.col(names["cost"]).between(low, high), F.lit(True)))
    return rows, {**names, "base_failed": failed, "kept": kept}


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    rows, names = judged(docs, text_col, lang_col)
    return rows.filter(names["kept"]).select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id", "lang"])
    return rows.select("doc_id", *[F.col(names[c]).alias(c) for c in BASE], F.col(names["base_failed"]).alias("base_failed"), F.col(names["kept"]).alias("kept"), F.exp(names["cost"]).alias("perplexity"))
