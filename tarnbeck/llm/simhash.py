"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's fingerprint has a bit set where over half the hashes of its word shingles have it. Two fingerprints
link at ``max_bits`` or fewer differing bits. The 64 bits are dealt into m parts, correlated bits together. If the parts'
thresholds add up to max_bits - m + 1, two linked fingerprints are within the threshold in at least one part, so each
fingerprint may choose its own thresholds; dynamic programming picks those with the fewest estimated candidates. It then
probes each part with all values inside that threshold and verifies what it meets. Frequent values of a part are thus
avoided instead of being paired.

Only distinct fingerprints are probed; documents that share one are joined to its component afterwards, so groups of
copies cost nothing here. Components are found by alternating large-star and small-star steps in the shared folder.

``near_duplicates`` links by one fingerprint of word shingles. ``keep_one`` means texts whose sets of five-word shingles have
a Jaccard similarity of 0.8 or more. One changed word changes five shingles, so the fingerprints of such sets are too far
apart to be probed (about ten of 64 bits at 0.8). It probes a fingerprint of the distinct words, which hardly moves, and
compares in the join a sketch of SHINGLE_BITS bits of the shingles: one bit of the least shingle under each of as many hashes, so
that (1 - similarity) / 2 of the bits are expected to differ, 0.1 of them at 0.8; the limit is wider than that. Rows that share
a part's value are first compared with a few of them, and only rows that those stars do not tie together are paired, so a large
group of near copies is not expanded into its pairs. Rows that such links lead to, alike or not, are a family. Sketches let many of its pairs
through that are not alike, so a large family meets those of its rows too that are nearest to what most of it has, and its pairs are
compared exactly where they meet, by what each row has otherwise than most: only those that are alike become rows. Links found so are verified by the sets of shingles themselves, which are
counted exactly, and only those tie a group: the closest of each text first, then round by round all others whose ends are not
tied yet. So each pair that the probes meet is in one group or was compared by its shingles; what the probes miss stays apart, and
the README has the recall.

Defined results: a null or word-less text has fingerprint zero and links like any other; a null doc_id never is a
component's id unless the component has no other (then it is null); repeated rows are all returned; an empty table gives
an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnbeck.llm.columns import free_names
from tarnbeck.llm.common import bounded_batches, stored, table, texts_of
from tarnbeck.llm.exact_dedup import BITS_PER_KEY, LEAST_BITS, MOST_BITS, survivors_bitmap

BITS, SEED = 64, 42
#: Near duplicates: words of a shingle, least similarity in percent, most differing bits of the words' fingerprint and of the shingles'
#: sketch, and its bits.
WIDTH, PERCENT, WORD_LIMIT, SHINGLE_LIMIT, SHINGLE_BITS = 5, 80, 7, 66, 512
#: Closest links of a text that are verified first; all others follow in rounds, where they are still needed.
BEST = 2
#: Shingles that are sketched at a time.
SKETCHED = 256
#: Bits of a block whose value counts are kept for the estimates: 2**11 counts for each of six blocks at most a part.
BLOCK = 11
#: What one probe, a shuffled row, costs in candidates, which are compared where they meet.
PROBE_COST = 10
#: Centres of each key that its rows are compared with before any are paired.
STARS = 4
#: Rows from which on a family is large, and those of it, nearest to what most of it has, that rows are compared with.
FAMILY, HUBS = 64, 4
#: Links that a task folds into a spanning forest before it passes them on.
FOLD = 400_000


def shingle_hashes(text: bytes, width: int = 3) -> np.ndarray:
    """XXH64 of the text's word shingles, in order, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, width: int = 3) -> int:
    """The text's 64-bit fingerprint."""
    hashes = shingle_hashes(text, width)
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long, one row for each row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t, width) for t in texts_of(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long")


def majority(digests: bytes, size: int) -> bytes:
    """Bit by bit, what over half of the digests of ``size`` bytes have."""
    rows = np.frombuffer(digests, np.uint8).reshape(-1, size)
    ones = np.zeros(8 * size, np.int64)
    for k in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[k : k + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(rows)).tobytes()


def sketch_factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``n`` hashes x -> factor * x + summand of 32 bits."""
    rule = np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little"), SEED) for k in range(n)], np.uint64)
    return (rule >> np.uint64(32)).astype(np.uint32) | np.uint32(1), rule.astype(np.uint32)


FACTORS, SUMMANDS = sketch_factors(SHINGLE_BITS)
#: Odd factor that mixes a least value before its highest bit is taken.
MIX = np.uint32(0x9E3779B1)


def sketch(hashes: np.ndarray) -> bytes:
    """A bit of the least of ``hashes`` (their upper halves) under each of SHINGLE_BITS hashes; zeros if there is none."""
    if not len(hashes):
        return bytes(SHINGLE_BITS // 8)
    upper, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(SHINGLE_BITS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(upper), SKETCHED):
        np.minimum(least, (upper[k : k + SKETCHED, None] * FACTORS + SUMMANDS).min(0), out=least)
    return np.packbits((least * MIX) >> np.uint32(31) > 0, bitorder="little").tobytes()


def near_prints(text: bytes, width: int = WIDTH) -> bytes:
    """A text's fingerprint of distinct words (8 bytes) and the sketch of its shingles (SHINGLE_BITS / 8 bytes)."""
    own = [xxhash.xxh64_digest(w, SEED) for w in set(text.lower().split())]
    return majority(b"".join(own), 8) + sketch(shingle_hashes(text, width))


NEAR = [f"near{k}" for k in range(SHINGLE_BITS // 64)]


def near_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, fp, near0, near1, ...): ``near_prints`` as signed longs, one row for each row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.frombuffer(b"".join([near_prints(t, width) for t in texts_of(b.column(1))]), "<i8").reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in found.T.copy()]], names=["id", "fp", *NEAR])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, fp long, {', '.join(f'{c} long' for c in NEAR)}")


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def co_occurrence(fps: DataFrame) -> np.ndarray:
    """How often bits i and j are both set, as a 64 x 64 matrix; each task sums before the shuffle, 2,080 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            x = bits_of(b.column(0).to_numpy()).astype(np.float32)
            total += x.T @ x
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j].astype(np.int64))], names=["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.n
    return out


def deal_bits(together: np.ndarray, rows: int, parts: int) -> list[list[int]]:
    """The bits in ``parts`` groups of nearly equal size, each grown from its most correlated free bit."""
    p = together / max(rows, 1)
    mean = np.diag(p)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs((p - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        group: list[int] = []
        while len(group) < width:
            left = sorted(free)
            gain = tie[np.ix_(left, group or left)].sum(1)
            group.append(left[int(np.argmax(gain))])
            free.remove(group[-1])
        out.append(group)
    return out


def part_values(fps: np.ndarray, groups: list[list[int]]) -> list[np.ndarray]:
    """Each fingerprint's value in each group: bit k of the value is the group's k-th bit."""
    bits = bits_of(fps).astype(np.int64)
    return [bits[:, g] @ (np.int64(1) << np.arange(len(g), dtype=np.int64)) for g in groups]


def blocks_of(width: int) -> list[tuple[int, int]]:
    """(first bit, bits) of a part's blocks."""
    n = -(-width // BLOCK)
    cuts = [round(k * width / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def block_counts(fps: DataFrame, groups: list[list[int]]) -> dict[tuple[int, int], np.ndarray]:
    """Of every block, how many fingerprints have each value: at most 64 / BLOCK + parts tables of 2**BLOCK counts."""
    names = [(g, a, w) for g, group in enumerate(groups) for a, w in blocks_of(len(group))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << w, np.int64) for _, _, w in names]
        for b in batches:
            values = part_values(b.column(0).to_numpy(), groups)
            for s, (g, a, w) in zip(sums, names, strict=True):
                s += np.bincount((values[g] >> a) & ((1 << w) - 1), minlength=1 << w)
        for k, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["k", "v", "n"])

    out = [np.zeros(1 << w, np.int64) for _, _, w in names]
    for r in fps.select("fp").mapInArrow(run, "k int, v int, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).collect():
        out[r.k][r.v] = r.n
    return {(g, a): o for (g, a, _), o in zip(names, out, strict=True)}


def masks(width: int, most: int) -> list[np.ndarray]:
    """All masks of 0, 1, ... ``most`` bits among ``width``."""
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), d)], np.int64) for d in range(min(most, width) + 1)]


def near_shares(counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """[value, d]: the share of fingerprints whose block differs from the value in exactly d bits."""
    at = np.arange(1 << width)
    out = np.zeros((1 << width, most + 1))
    for d, m in enumerate(masks(width, most)):
        for x in m:
            out[:, d] += counts[at ^ x]
    return out / max(counts.sum(), 1)


def choose_thresholds(values: list[np.ndarray], groups: list[list[int]], shares: dict, rows: int, max_bits: int) -> np.ndarray:
    """[fingerprint, part]: thresholds from -1 (no probe) that add up to max_bits - parts + 1 at the least estimated cost."""
    n, parts = len(values[0]), len(groups)
    costs = []
    for g, group in enumerate(groups):
        dist = np.zeros((n, max_bits + 1))
        dist[:, 0] = 1
        for a, w in blocks_of(len(group)):
            s = shares[g, a][(values[g] >> a) & ((1 << w) - 1)]
            dist = np.stack([(dist[:, : d + 1] * s[:, d::-1]).sum(1) for d in range(max_bits + 1)], 1)
        probes = np.cumsum([math.comb(len(group), d) for d in range(max_bits + 1)])
        costs.append(np.concatenate([np.zeros((n, 1)), np.cumsum(dist, 1) * rows + PROBE_COST * probes], 1))
    # spend[b]: least cost with b thresholds' units above -1 spent in the parts so far; a part takes 0 .. max_bits + 1 of them
    units = max_bits + 1
    spend, took = np.full((n, units + 1), np.inf), []
    spend[:, 0] = 0
    for c in costs:
        options = np.stack([np.stack([spend[:, b - t] + c[:, t] if t <= b else np.full(n, np.inf) for t in range(units + 1)], 1) for b in range(units + 1)], 1)
        took.append(options.argmin(2))
        spend = options.min(2)
    left, out = np.full(n, units), np.zeros((n, parts), np.int64)
    for g in range(parts - 1, -1, -1):
        out[:, g] = took[g][np.arange(n), left] - 1
        left = left - out[:, g] - 1
    return out


def part_count(rows: int, max_bits: int, probe_cost: int = PROBE_COST) -> int:
    """How many parts cost least for this many fingerprints, were their bits even: few wide parts need more probes and
    meet fewer candidates."""

    def cost(parts: int) -> float:
        width, extra = BITS / parts, max_bits - parts + 1
        each = [extra // parts + (k < extra % parts) for k in range(parts)]
        probes = sum(math.comb(round(width), d) for t in each for d in range(t + 1))
        return probes * (probe_cost + rows / 2**width)

    return min(range(2, max_bits + 2), key=cost)


def probing(fps: DataFrame, rows: int, max_bits: int, carried: list[str]) -> tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """(probes, index), functions of a table whose columns begin with ``carried``, ``fp`` among them: its rows with a ``key``, of each value
    that a fingerprint probes and of each part. Of two of the ``rows`` fingerprints within max_bits each probes a key of the other."""
    # a wider row costs more to shuffle
    parts = part_count(rows, max_bits, PROBE_COST * len(carried) ** 2)
    groups = deal_bits(co_occurrence(fps), rows, parts)
    shares = {(g, a): near_shares(c, len(c).bit_length() - 1, max_bits) for (g, a), c in block_counts(fps, groups).items()}
    flips = [masks(len(g), max_bits) for g in groups]
    at_fp = carried.index("fp")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = part_values(b.column(at_fp).to_numpy(), groups)
            limits = choose_thresholds(values, groups, shares, rows, max_bits)
            for g in range(parts):
                for t in range(max_bits + 1):
                    at = np.flatnonzero(limits[:, g] == t)
                    m = np.concatenate(flips[g][: t + 1])
                    for k in range(0, len(at), step := max(1, (1 << 18) // len(m))):
                        some = at[k : k + step]
                        key = (values[g][some, None] ^ m[None, :]).ravel()
                        own = np.repeat(some, len(m))
                        # numpy has no lists
                        columns = [c.take(pa.array(own)) if pa.types.is_list(c.type) else pa.array(c.to_numpy()[own]) for c in b.columns]
                        yield pa.RecordBatch.from_arrays([pa.array(key * parts + g), *columns], names=["key", *b.schema.names])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The key of each part, and the columns."""
        for b in batches:
            for g, v in enumerate(part_values(b.column(at_fp).to_numpy(), groups)):
                yield pa.RecordBatch.from_arrays([pa.array(v * parts + g), *b.columns], names=["key", *b.schema.names])

    keyed = lambda run: lambda df: df.mapInArrow(run, ", ".join(["key long", *[f"{c} {kind}" for c, kind in df.dtypes]]))
    return keyed(probe), keyed(index)


def links(fps: DataFrame, rows: int, max_bits: int = 3) -> DataFrame:
    """(u, v), u < v: a spanning forest, task by task, of all pairs of the distinct fingerprints ``fps`` within max_bits."""
    probes, index = probing(fps, rows, max_bits, ["fp"])
    q, x = probes(fps.select("fp")).alias("q"), index(fps.select("fp")).alias("x")
    linked = (F.col("q.key") == F.col("x.key")) & (F.col("q.fp") < F.col("x.fp")) & (F.bit_count(F.col("q.fp").bitwiseXOR(F.col("x.fp"))) <= max_bits)
    return q.join(x, linked).select(F.col("q.fp").alias("u"), F.col("x.fp").alias("v")).mapInArrow(folded, "u long, v long")


def stars(keyed: DataFrame, carried: list[str], close: Callable, apart: Callable) -> DataFrame:
    """(u, v, d): links of each row (key, node, ...) to those of its key's STARS centres that it is close to; the centres are the
    least by as many hashes of the node. At most STARS links a row."""
    centre = lambda k: F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), *carried)).alias(f"centre{k}")
    centres = keyed.groupBy("key").agg(F.count("*").alias("n"), *map(centre, range(STARS))).filter("n > 1")
    met = keyed.join(stored(centres, "centres"), "key")
    near_ones = F.filter(F.array(*[F.col(f"centre{k}") for k in range(STARS)]), lambda c: (c["node"] != F.col("node")) & close(F.col, lambda n: c[n]))
    ties = met.select("node", F.explode(F.array_distinct(F.transform(near_ones, lambda c: F.struct(c["node"].alias("node"), apart(F.col, lambda n: c[n]).cast("int").alias("d"))))).alias("c"))
    return ties.select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v"), "c.d").distinct()


class Forest:
    """Trees of the links seen so far."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above, top = self.above, x
        while (y := above.get(top, top)) != top:
            top = y
        while (y := above.get(x, x)) != top:
            above[x], x = top, y
        return top

    def joins(self, u: int, v: int) -> bool:
        """Whether the link joins two trees, which are one then."""
        a, z = sorted((self.root(u), self.root(v)))
        if a != z:
            self.above[z] = a
        return a != z


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's links as a forest of stars; at most FOLD links are held before they are passed on."""
    forest = Forest()

    def stars() -> pa.RecordBatch:
        nodes = list(forest.above)
        return pa.RecordBatch.from_arrays([pa.array([forest.root(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["u", "v"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forest.joins(u, v)
        if len(forest.above) > FOLD:
            yield stars()
            forest = Forest()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (u, v) reaches, by alternating star steps. Each step's tasks fold
    their links before they are written, so links that fit into one task need no step: a step is several jobs, and the driver keeps something of each."""
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    fold = lambda e: stored(e.mapInArrow(folded, "u long, v long"), "links")

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Each node's larger (large) or smaller neighbours are tied to its least neighbour instead."""
        pairs = both(e) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = pairs.join(least, "u")
        moved = tied.filter(F.col("v") > F.col("u")) if large else tied.filter(F.col("v") != F.col("m")).select("u", "v", "m")
        out = moved.select(F.col("m").alias("u"), "v")
        if not large:
            out = out.union(least.select(F.col("m").alias("u"), F.col("u").alias("v")))
        return out.filter("u <> v").distinct()

    def starry(e: DataFrame) -> bool:
        """Whether each node is the lesser end of its links (u < v) or the greater end of only one."""
        ends = e.select(F.col("u").alias("node"), F.lit(0).alias("n")).union(e.select("v", F.lit(1)))
        return ends.groupBy("node").agg(F.sum("n").alias("times"), F.min("n").alias("least")).filter("times > least").isEmpty()

    edges = fold(edges.distinct())
    while not starry(edges):
        edges = fold(star(star(edges, True), False))
    return roots_in(edges)


def roots_in(trees: DataFrame) -> DataFrame:
    """(node, root) of trees (u, v) whose links all begin at their root u."""
    return trees.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id), one row for each row of ``docs``."""
    rows = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    roots = components(links(distinct, distinct.count(), max_bits)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(F.col("id").alias(id_col), hex64("fp").alias("fingerprint"), "component_id")


def closest(edges: DataFrame, count: int = BEST) -> DataFrame:
    """(u, v): of the links (u, v, d) those that are among the ``count`` closest of either end."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other"), "d").union(edges.select("v", "u", "d"))
    first = ends.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("d", "other"))).filter(F.col("n") <= count)
    return first.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def with_bits_of(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key shares a bit with one of ``ids``: all that are among them, and few others."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * ids.count()).bit_length()))
    bit = lambda c: (F.pmod(F.xxhash64(c), F.lit(bits)) + 1).alias("bit")
    bitmap = F.broadcast(survivors_bitmap(ids.select(bit(F.col(ids.columns[0])))))
    tested = docs.withColumn("bit", bit(F.col(key))).withColumn("bucket", F.bitmap_bucket_number("bit")).join(bitmap, "bucket")
    at = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return tested.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*docs.columns)


def ends_of(pairs: DataFrame) -> DataFrame:
    """(node): the ends of the pairs (u, v), each once."""
    return pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()


def shingle_sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, hashes) of the ``wanted`` (node, id): 32 bits of each distinct shingle's hash, which two sets of a thousand mistake for each
    other once in 4,000 pairs, by one shingle. Only those texts are shuffled, and few others: a bitmap of their ids, of bounded size,
    is consulted first."""
    bounded_batches(docs.sparkSession)
    wanted = stored(wanted, "wanted")
    texts = with_bits_of(docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("t")), "doc", wanted.select("id"))
    texts = texts.join(wanted, F.col("doc").eqNullSafe(F.col("id"))).select("node", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique((shingle_hashes(t, width) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in texts_of(b.column(1))]
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.empty(0, np.int32)])))], names=["node", "hashes"])

    return stored(texts.mapInArrow(run, "node long, hashes array<int>"), "shingles")


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the ``pairs`` (u, v) whose ``sets`` have a Jaccard similarity of ``percent`` or more."""
    side = lambda end, name: sets.select(F.col("node").alias(end), F.col("hashes").alias(name))
    both = F.size(F.array_intersect("a", "b"))
    found = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    # where ids repeat, a node's text comes more than once
    return stored(found.filter(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v").distinct(), "alike")


def apart_in(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the links ``edges`` (u, v, ...) whose ends are not of one tree of ``roots`` (node, root)."""
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    both = edges.join(root("u"), "u", "left").join(root("v"), "v", "left")
    return both.filter(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select(*edges.columns)


def verified(found: DataFrame, sets: DataFrame, percent: int, firm: DataFrame | None = None) -> DataFrame:
    """(u, v), the least node of each tree and each other: the trees of ``firm`` (u, v) and of as many of the links ``found`` (u, v, d)
    that are alike as tie together all that the alike ones do. The closest few of each node go first; then, four times as many a round,
    those that are left and whose ends are not tied yet, until there are none. So each link has been tried or its ends are of one group."""
    rest, count = found, BEST
    while not rest.isEmpty():
        some = stored(closest(rest, count), "pairs")
        good = alike(some, sets, percent)
        roots = components(good if firm is None else firm.union(good))
        rest, count = stored(apart_in(rest.join(some, ["u", "v"], "left_anti"), roots), "rest"), 4 * count
        firm = roots.select(F.col("root").alias("u"), F.col("node").alias("v"))
    return found.select("u", "v").filter("false") if firm is None else firm


def large_families(links: DataFrame) -> DataFrame:
    """(node, family, n) of the components of ``links`` (u, v, ...) that have FAMILY nodes or more: the least node, and how many there are."""
    families = ends_of(links).join(components(links.select("u", "v")), "node", "left").select("node", F.coalesce("root", "node").alias("family"))
    families = stored(families, "families")
    # written first: a join right above its aggregation can't be split where a family holds many rows
    return families.join(stored(families.groupBy("family").agg(F.count("*").alias("n")).filter(F.col("n") >= FAMILY), "large"), "family")


def cores(families: DataFrame, sets: DataFrame) -> DataFrame:
    """(family, core): the hashes that more than half of the family's nodes have, twice as many as its mean node has at most."""
    hashes = families.join(sets, "node").select("family", "n", F.explode("hashes").alias("hash"))
    most = hashes.groupBy("family", "n", "hash").agg(F.count("*").alias("times")).filter(2 * F.col("times") > F.col("n"))
    return stored(most.groupBy("family").agg(F.collect_list("hash").alias("core")), "cores")


def odds(families: DataFrame, sets: DataFrame, core: DataFrame) -> DataFrame:
    """(node, family, held, odd): how many hashes each node has, and those that either it or its family's core has."""
    both = families.select("node", "family").join(sets, "node").join(core, "family", "left").withColumn("core", F.coalesce("core", F.array().cast("array<int>")))
    odd = F.array_union(F.array_except("hashes", "core"), F.array_except("core", "hashes"))
    return stored(both.select("node", "family", F.size("hashes").alias("held"), odd.alias("odd")), "odds")


def near_links(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, word_limit: int, shingle_limit: int) -> DataFrame:
    """(u, v), the least node of each tree and each other: the trees of verified links between the nodes of ``distinct`` (node, least, fp,
    near0, ...), enough to tie together whatever links within ``word_limit`` and ``shingle_limit`` that are alike do. A dense group has about the square of its size in pairs, so its rows
    meet a few centres first, in a large family its hubs too; of rows that verified links to these tie together no pair is made again. All others are paired, those of one
    large family only where they are alike."""
    nodes, carried = distinct.select("node", F.col("least.id").alias("id")), ["node", "fp", *NEAR]
    probes, index = probing(distinct, distinct.count(), word_limit, carried)

    def apart(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        return sum([F.bit_count(a(c).bitwiseXOR(b(c))) for c in NEAR], F.lit(0))

    def close(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        return (F.bit_count(a("fp").bitwiseXOR(b("fp"))) <= word_limit) & (apart(a, b) <= shingle_limit)

    def linked(q: DataFrame, x: DataFrame, where: Callable[[Callable, Callable], Column]) -> DataFrame:
        """(u, v, d) of the rows that share a key, are close and as ``where`` says."""
        a, b = (lambda c: F.col(f"q.{c}")), (lambda c: F.col(f"x.{c}"))
        met = q.alias("q").join(x.alias("x"), (a("key") == b("key")) & (a("node") != b("node")) & close(a, b) & where(a, b))
        return met.select(F.least(a("node"), b("node")).alias("u"), F.greatest(a("node"), b("node")).alias("v"), apart(a, b).cast("int").alias("d"))

    def sets_of(ends: DataFrame) -> DataFrame:
        return shingle_sets(ends.join(nodes, "node"), docs, id_col, text_col, width)

    rows = distinct.select(carried)
    keys = stored(index(rows), "keys")
    to_centres = stored(stars(keys, carried, close, apart), "stars")
    wanted = stored(ends_of(to_centres), "ends")
    sets = sets_of(wanted)
    families = stored(large_families(to_centres), "families")
    odd = None
    if not families.isEmpty():
        core = cores(families, sets)
        nearest = Window.partitionBy("family").orderBy(F.size("odd"), "node")
        hubs = odds(families, sets, core).withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= HUBS)
        to_hubs = linked(keys, keys.join(hubs.select("node").distinct(), "node", "left_semi"), lambda a, b: F.lit(True))
        to_centres = stored(to_centres.union(to_hubs).distinct(), "stars")
        more = stored(ends_of(to_centres).join(wanted, "node", "left_anti"), "ends")
        wanted, sets = wanted.union(more), sets.union(sets_of(more))
        # hubs lead to further rows, and may make one family of several: any core will do that all its rows are held against
        first, families = families.select("node", F.col("family").alias("was")), stored(large_families(to_centres), "families")
        held = core.withColumnRenamed("family", "was").join(first.join(families, "node").select("was", "family").distinct(), "was")
        odd = odds(families, sets, stored(held.groupBy("family").agg(F.min_by("core", "was").alias("core")), "cores"))
    firm = verified(to_centres, sets, percent)

    rows = rows.join(roots_in(firm), "node", "left").withColumn("tied", F.coalesce("root", "node")).select(*carried, "tied")
    # rows without a large family are a family of their own
    own = F.lit(-1) - F.col("node") if odd is None else F.coalesce("family", F.lit(-1) - F.col("node"))
    rows = stored((rows if odd is None else rows.join(families.select("node", "family"), "node", "left")).select(*carried, "tied", own.alias("family")), "tied")
    pair = lambda a, b: (a("node") < b("node")) & (a("tied") != b("tied"))
    met = stored(linked(probes(rows), index(rows), lambda a, b: pair(a, b) & (a("family") != b("family"))), "met")
    if odd is not None:

        def same(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
            """Whether two rows of a family are alike: they differ in what is odd of one of them."""
            differ, size = F.size(a("odd")) + F.size(b("odd")) - 2 * F.size(F.array_intersect(a("odd"), b("odd"))), a("held") + b("held")
            return (a("family") == b("family")) & pair(a, b) & (100 * (size - differ) >= percent * (size + differ))

        within = stored(rows.join(odd.select("node", "held", "odd"), "node"), "within")
        met = met.union(stored(linked(probes(within), index(within), same), "met"))
    # a link to a centre whose ends are not tied was tried
    met = stored(met.distinct().join(to_centres, ["u", "v"], "left_anti"), "found")
    if met.isEmpty():
        return firm
    return verified(met, sets.union(sets_of(ends_of(met).join(wanted, "node", "left_anti"))), percent, firm)


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, word_limit: int = WORD_LIMIT, shingle_limit: int = SHINGLE_LIMIT, percent: int = PERCENT,
) -> DataFrame:
    """(id_col, keep_id), one row for each row of ``docs``: the least id, nulls last, of its group of near duplicates."""
    order = lambda c: F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("id"))
    rows = stored(near_fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = rows.groupBy("fp", *NEAR).agg(F.min(order("id")).alias("least")).withColumn("node", F.monotonically_increasing_id())
    distinct = stored(distinct, "distinct")
    roots = roots_in(near_links(distinct, docs, id_col, text_col, width, percent, word_limit, shingle_limit))
    rooted = stored(distinct.join(roots, "node", "left").select("fp", *NEAR, "least", F.coalesce("root", "node").alias("root")), "rooted")
    # written first: a join right above its aggregation can't be split where a group holds many rows
    keep = stored(rooted.groupBy("root").agg(F.min("least").alias("keep")), "keep")
    of_print = stored(rooted.join(keep, "root").select("fp", *NEAR, F.col("keep.id").alias("keep_id")), "kept")
    return rows.join(of_print, ["fp", *NEAR]).select(F.col("id").alias(id_col), "keep_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, word_limit: int = WORD_LIMIT, shingle_limit: int = SHINGLE_LIMIT) -> DataFrame:
    """Of each group of near duplicates, the row of ``docs`` with the least id, nulls last, with all its columns; of repeated
    rows with that id, one."""
    key, gone_key = free_names(docs, ["row", "gone"])
    if docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        key = id_col
    else:
        # ids that repeat don't tell rows apart: a stored number does, and ranks as the id does
        order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("n"))
        docs = stored(docs.withColumn(key, order), "rows")
    found = near_groups(docs, key, text_col, width, word_limit, shingle_limit)
    # those that go are the fewer, so that often no text need be shuffled
    gone = stored(found.filter(~F.col(key).eqNullSafe(F.col("keep_id"))).select(F.col(key).alias(gone_key)), "gone")
    out = docs.join(gone, F.col(key).eqNullSafe(F.col(gone_key)), "left_anti")
    return out if key == id_col else out.drop(key)


def hex64(c: str) -> Column:
    return F.lpad(F.lower(F.hex(F.col(c))), 16, "0")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
