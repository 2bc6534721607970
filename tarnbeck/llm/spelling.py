"""Spelling variants: words one edit apart, found by Levenshtein automata over compact tries.

Words are counted on the map side, document by document, and summed. The frequent ones are sorted, and every task turns its
range into tries of at most about ``SHARD_NODES`` nodes. Tries are broadcast in rounds of at most ``ROUND_BYTES``, however many
there are; in each round every word's automaton meets every trie of the round, and a word leaves with the count of its
neighbours there and the best of them. Rounds are summed word by word, so a round's rows are bounded by the words.

A trie is one sorted array of (parent << 21 | code point), in order of depth, so a child is a binary search and the children of
a node are a slice of it. The automaton of distance one has at depth i the states: nothing edited (i characters read), one
inserted (i - 1), one replaced (i), one deleted (i + 1). A set of them is four bits, so each pair of a word and a node is met at most
once, and from a node where an edit has been made at most three children are looked up. Pairs are walked depth-first, a block of
them at a time. A trie of another range of words dies after a few steps, for its first edge costs the edit.

Forms are followed to their last by doubling: counts grow at least ``ratio``-fold with each step, so few rounds are needed.

Defined results: a null text has no words, a null id is written as nothing; repeated rows count each; a word that nothing is near
to has no form and is its own root; an empty table gives an empty result; other columns are ignored; a word longer than a trie's
bound has a trie of its own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm.common import bounded_batches, stored, table

#: Nodes of a trie at most about, and bytes of the tries of one round at most (or one trie).
SHARD_NODES, ROUND_BYTES = 1 << 20, 64 << 20
#: Distinct words that a task counts before it passes them on, and pairs of a word and a node that are walked at a time.
COUNTED, WALKED = 200_000, 1 << 16
#: Words that a task searches for in a round's tries, about.
SEARCHED = 4096
#: Bits of a code point; states of the automaton.
POINT_BITS, KEPT, INSERTED, REPLACED, DELETED = 21, 1, 2, 4, 8
RUN = re.compile("[a-zÀ-ÿ]+")


class Trie:
    """Sorted words with their counts. ``keys``: each node's parent and code point, node 0 is the root; ``word_at``: the word that
    ends at a node, or -1."""

    def __init__(self, keys: np.ndarray, word_at: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.word_at, self.counts = keys, word_at, counts
        self.nodes = np.flatnonzero(word_at >= 0)[np.argsort(word_at[word_at >= 0])]

    @classmethod
    def of(cls, words: list[str], counts: np.ndarray) -> Trie:
        """The trie of distinct words in code-point order."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points, starts = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64), np.cumsum(sizes) - sizes
        node, keys, word_at, total = np.zeros(len(words), np.int64), [np.full(1, -1)], [np.full(1, -1)], 1
        at, depth = np.flatnonzero(sizes > 0), 0
        while len(at):
            key = node[at] << POINT_BITS | points[starts[at] + depth]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            node[at] = total - 1 + np.cumsum(new)
            keys.append(key[new])
            ends = np.full(len(keys[-1]), -1)
            depth += 1
            over = at[sizes[at] == depth]
            ends[node[over] - total] = over
            word_at.append(ends)
            total += len(ends)
            at = at[sizes[at] > depth]
        return cls(np.concatenate(keys), np.concatenate(word_at).astype(np.int32), counts)

    def child(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The child at the edge ``point``; 0 if there is none."""
        key = node << POINT_BITS | point
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[found] == key) & (point > 0), found, 0)

    def word(self, k: int) -> str:
        node, out = int(self.nodes[k]), []
        while node:
            key = int(self.keys[node])
            out.append(chr(key & ((1 << POINT_BITS) - 1)))
            node = key >> POINT_BITS
        return "".join(reversed(out))

    def packed(self) -> dict[str, bytes]:
        return {"keys": self.keys.tobytes(), "word_at": self.word_at.tobytes(), "counts": self.counts.tobytes()}

    @classmethod
    def unpacked(cls, row: dict) -> Trie:
        return cls(np.frombuffer(row["keys"], np.int64), np.frombuffer(row["word_at"], np.int32), np.frombuffer(row["counts"], np.int64))


def near_words(trie: Trie, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``words``, place in the trie's words) of all pairs that are exactly one edit apart."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    # a zero before each word and two behind it: no edge has it, so what lies outside a word matches nothing
    points = np.frombuffer("".join(f"\0{w}\0\0" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
    starts = np.cumsum(sizes + 3) - sizes - 2
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = np.arange(len(words))
    stack = [(at, np.zeros_like(at), np.zeros_like(at), np.where(sizes > 0, KEPT | DELETED, KEPT))]
    while stack:
        word, node, depth, states = stack.pop()
        if len(word) > WALKED:
            stack += [tuple(x[k : k + WALKED] for x in (word, node, depth, states)) for k in range(0, len(word), WALKED)]
            continue
        left = sizes[word] - depth
        end = ((states & DELETED > 0) & (left == 1)) | ((states & REPLACED > 0) & (left == 0)) | ((states & INSERTED > 0) & (left == -1))
        end &= trie.word_at[node] >= 0
        found.append((word[end], trie.word_at[node[end]].astype(np.int64)))

        own = starts[word] + depth
        before, here, after = points[own - 1], points[own], points[np.minimum(own + 1, len(points) - 1)]
        free = states & KEPT > 0
        low, high = np.searchsorted(trie.keys, node << POINT_BITS), np.searchsorted(trie.keys, (node + 1) << POINT_BITS)
        many = np.where(free, high - low, 0)
        rows = np.repeat(np.arange(len(word)), many)
        next_rows, next_nodes = [rows], [np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(rows))]
        for bit, point, taken in ((INSERTED, before, ()), (REPLACED, here, ((INSERTED, before),)), (DELETED, after, ((INSERTED, before), (REPLACED, here)))):
            some = ~free & (states & bit > 0)
            for other, theirs in taken:  # one edge that serves two states is followed once
                some &= ~((states & other > 0) & (theirs == point))
            some = np.flatnonzero(some)
            child = trie.child(node[some], point[some])
            next_rows.append(some[child > 0])
            next_nodes.append(child[child > 0])
        rows, nodes = np.concatenate(next_rows), np.concatenate(next_nodes)
        edge, was = trie.keys[nodes] & ((1 << POINT_BITS) - 1), states[rows]
        free, same = was & KEPT > 0, edge == here[rows]
        skips = edge == after[rows]
        now = np.where(free & same, KEPT, 0)
        now |= np.where(free | ((was & INSERTED > 0) & (edge == before[rows])), INSERTED, 0)
        now |= np.where((free & ~same & (left[rows] > 0)) | ((was & REPLACED > 0) & same), REPLACED, 0)
        # where nothing is edited yet the next character may be left out, if there is one
        now |= np.where(((was & DELETED > 0) & skips) | (free & same & (left[rows] > 1)), DELETED, 0)
        if len(rows):
            stack.append((word[rows], nodes, depth[rows] + 1, now))
    words_at, others = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return words_at, others


def counted_words(docs: DataFrame, id_col: str, text_col: str, least: int, every: int) -> DataFrame:
    """(word, n): the runs of letters of at least ``least`` code points. Of every run whose crc32, written behind the document's id,
    ``every`` divides, one code point is left out."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        passed = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head = zlib.crc32(f"{'' if k is None else k}:".encode())
                # bytes are lower-cased from A to Z alone
                for word, n in Counter(RUN.findall((text or "").encode().lower().decode())).items():
                    h = zlib.crc32(word.encode(), head)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= max(1, least):
                        total[word] += n
                if len(total) > COUNTED:
                    yield passed()
                    total.clear()
        yield passed()

    found = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def tries(words: DataFrame, nodes: int = SHARD_NODES) -> DataFrame:
    """(first, bytes, keys, word_at, counts): the words' tries, by ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        counts: list[int] = []
        size = 0

        def made() -> pa.RecordBatch:
            x = Trie.of(held, np.array(counts, np.int64)).packed()
            return pa.RecordBatch.from_pylist([{"first": held[0], "bytes": sum(map(len, x.values())), **x}], schema=schema)

        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and size + len(word) > nodes:
                    yield made()
                    held, counts, size = [], [], 0
                held.append(word)
                counts.append(n)
                size += len(word)
        if held:
            yield made()

    schema = pa.schema([("first", pa.string()), ("bytes", pa.int64()), *[(c, pa.binary()) for c in ("keys", "word_at", "counts")]])
    return words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(run, "first string, bytes long, keys binary, word_at binary, counts binary")


def best_near(words: DataFrame, shards: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n_near, best), best (least, near): each word's neighbours, and the most frequent of them with its count negated; none
    for a word without neighbours. ``words`` and ``shards`` are stored tables."""
    spark = words.sparkSession
    bounded_batches(spark)

    def search(broadcast) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = [Trie.unpacked(row) for row in broadcast.value]
            for b in batches:
                own = b.column(0).to_pylist()
                n_near, best = np.zeros(len(own), np.int64), [(0, "")] * len(own)
                for trie in here:
                    at, near = near_words(trie, own)
                    n_near += np.bincount(at, minlength=len(own))
                    order = np.lexsort((near, -trie.counts[near], at))
                    at, near = at[order], near[order]
                    for k in np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))[: len(at)]).tolist():
                        best[at[k]] = min(best[at[k]], (-int(trie.counts[near[k]]), trie.word(near[k])))
                some = np.flatnonzero(n_near).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([own[k] for k in some], pa.string()), pa.array(n_near[some]), pa.array([best[k][0] for k in some], pa.int64()), pa.array([best[k][1] for k in some], pa.string())], names=["word", "n_near", "least", "near"])

        return run

    rounds: list[list] = []
    size = 0
    for r in shards.select("first", "bytes").orderBy("first").collect():
        if not rounds or size + r.bytes > round_bytes:
            rounds.append([r.first, r.first])
            size = 0
        rounds[-1][1] = r.first
        size += r.bytes
    found = spark.createDataFrame([], "word string, n_near long, least long, near string")
    sought = words.select("word").repartition(1 + words.count() // SEARCHED, "word")
    for first, last in rounds:
        rows = shards.filter(F.col("first").between(first, last)).select("keys", "word_at", "counts").collect()
        sent = spark.sparkContext.broadcast([r.asDict() for r in rows])
        found = found.union(stored(sought.mapInArrow(search(sent), found.schema), "near"))
        sent.destroy()
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("least", "near")).alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where each word's chain of forms (word, form) ends."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = stored(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = then.select("word", "root")
        if then.filter("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_points: int = 6, least_count: int = 5, ratio: int = 5, every: int = 199, nodes: int = SHARD_NODES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of ``least_points`` code points or more that occur ``least_count`` times or
    more; ``form`` is a word's most frequent neighbour one edit away, if at least ``ratio`` times as frequent (at least 2), ties by code points;
    ``root`` is where its chain of forms ends."""
    words = stored(counted_words(docs, id_col, text_col, least_points, every).filter(F.col("n") >= least_count), "words")
    near = best_near(words, stored(tries(words, nodes), "tries"), round_bytes)
    form = F.when(-F.col("best.least") >= ratio * F.col("n"), F.col("best.near"))
    found = words.join(near, "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.least")).alias("best_n"))
    found = stored(found.select("word", "form", "n", "n_near", F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n")), "forms")
    roots = last_forms(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE crcs AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (
  SELECT doc_id, run, count(*) AS m
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL),
coded AS (
  SELECT run, m, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END
                          FOR c IN string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, '')]) AS bytes
  FROM runs),
hashed AS (SELECT run, m, xor(list_reduce([4294967295] || bytes, lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) AS h FROM coded, crcs),
words AS (
  SELECT word, CAST(sum(m) AS BIGINT) AS n
  FROM (SELECT m, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, 0 AS k FROM forms
  UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, max_by(root, k) AS root FROM chain GROUP BY word) USING (word)"""
