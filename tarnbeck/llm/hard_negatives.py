"""Hard negatives by a block matrix multiply in two dimensions, and windows of scores around each positive.

Scores of anchors against rows are a matrix product. Anchors and rows are dealt into blocks of bounded size, and vectors into
chunks of ``CHUNK`` dimensions, so a factor is a table of (block, chunk) matrices. Each anchor block meets each row block once
for every chunk and gives a partial int64 tile of scores. Partial tiles are shuffled by their place and added there, and the sum
is reduced at once to its best few rows for each anchor: no tile is stored, and what is shuffled after that is a few rows for
each anchor and tile.

Blocks are dealt by groups of labels, so the first product, which looks for positives, multiplies only blocks of the same group;
the second, which looks for negatives in each positive's window, multiplies all others, and those of the same group only if the
group has several labels. A label that holds most rows fills more blocks, none of them larger.

A partial tile travels as its least value and as many byte planes as the rest needs. Products are taken in doubles where all
sums stay below 2**53, which is exact, and in int64 otherwise.

Defined results: a row with a null id, label or vector, or with a null component, takes no part; of rows with the same id the
one with the least label, then least vector, takes part; a vector shorter than others counts as filled with zeros; scores beyond
64 bits wrap; ties go to the smaller id; an anchor without positives or a positive without negatives gives no rows; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnbeck.llm.common import bounded_batches, stored, table

#: Dimensions of a chunk, anchors of a block at most about, rows of a block at most about, numbers of a (block, chunk) at most about.
CHUNK, ANCHORS, ROWS, NUMBERS = 32, 512, 8192, 1 << 19
#: Chunks of a vector at most; wider vectors get wider chunks.
CHUNKS = 16
#: Anchors of a tile: what is added and reduced at once has TILE_ANCHORS * ROWS scores.
TILE_ANCHORS = 64
#: Groups of labels at most.
GROUPS = 64

BLOCK = "block int, chunk int, grp int, ids binary, labels binary, numbers binary, windows binary"
TILE = "left int, right int, part int, chunk int, tile binary, ids binary, labels binary, windows binary, other_ids binary, other_labels binary"


def packed_tile(scores: np.ndarray) -> bytes:
    """The int64 scores as their least value and the byte planes that the differences to it fill."""
    low = scores.min()
    rest = (scores - low).view(np.uint64)
    planes = (int(rest.max()).bit_length() + 7) // 8
    return np.int64(low).tobytes() + rest.ravel().view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpacked_tile(data: bytes, count: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8, offset=8).reshape(-1, count)
    out[:, : len(planes)] = planes.T
    return (out.view(np.uint64)[:, 0] + np.frombuffer(data, np.uint64, 1)).view(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact int64 product of ``a`` and the transpose of ``b``."""
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if most(a) * most(b) * a.shape[1] < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` by falling score, then rising id."""
    if len(scores) > count:
        floor = np.partition(scores, len(scores) - count)[len(scores) - count]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], ~scores[at]))][:count]


def matrix_blocks(rows: DataFrame, block: Column, chunk: int, chunks: int) -> DataFrame:
    """``rows`` (id, label, grp, vec, windows) as matrices, one for each block and chunk of dimensions, rows by rising id.
    Ids, labels and windows go with chunk 0 alone."""

    def pack(group: pa.Table) -> pa.Table:
        of = {c: group.column(c).combine_chunks() for c in group.column_names}
        order = np.argsort(ids := of["id"].to_numpy(), kind="stable")
        sizes, flat, cells = np.diff(of["part"].offsets.to_numpy()), of["part"].flatten().to_numpy(), np.zeros((len(ids), chunk), np.int64)
        cells[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        first = of["chunk"][0].as_py() == 0
        windows = [of["windows"][int(k)].as_py() for k in order] if first else []
        one = lambda x: pa.array([x])
        return pa.table({
            "block": of["block"][:1], "chunk": of["chunk"][:1], "grp": of["grp"][:1],
            "ids": one(ids[order].tobytes()), "labels": one(of["label"].to_numpy()[order].tobytes() if first else b""),
            "numbers": one(cells[order].tobytes()), "windows": one(b"".join(windows)),
        })

    cut = F.transform(F.sequence(F.lit(0), F.lit(chunks - 1)), lambda k: F.slice("vec", k * chunk + 1, chunk))
    # a window's bytes are needed once, so they aren't repeated for each chunk
    sliced = rows.select(block.cast("int").alias("block"), "grp", "id", "label", "windows", F.posexplode(cut).alias("chunk", "part"))
    sliced = sliced.withColumn("windows", F.when(F.col("chunk") == 0, F.col("windows")))
    return sliced.groupBy("block", "chunk").applyInArrow(pack, BLOCK)


def partial_tiles(left: DataFrame, right: DataFrame, met: Column) -> DataFrame:
    """For each block of ``left`` and those blocks of ``right`` that the array ``met`` names: their product, chunk by chunk."""
    bounded_batches(left.sparkSession)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, other_ids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["other_ids"], np.int64)
                a, z = np.frombuffer(r["numbers"], np.int64).reshape(len(ids), -1), np.frombuffer(r["other_numbers"], np.int64).reshape(len(other_ids), -1)
                labels, first = np.frombuffer(r["labels"], np.int64), r["chunk"] == 0
                width = len(r["windows"]) // len(ids)
                for part, k in enumerate(range(0, len(ids), TILE_ANCHORS)):
                    own = slice(k, k + TILE_ANCHORS)
                    yield pa.RecordBatch.from_pylist([{
                        "left": r["left"], "right": r["right"], "part": part, "chunk": r["chunk"], "tile": packed_tile(product(a[own], z)),
                        "ids": ids[own].tobytes() if first else b"", "labels": labels[own].tobytes() if first else b"",
                        "windows": r["windows"][width * own.start : width * own.stop] if first else b"",
                        "other_ids": r["other_ids"] if first else b"", "other_labels": r["other_labels"] if first else b"",
                    }], schema=arrow)

    arrow = pa.schema([(n, pa.int32() if t == "int" else pa.binary()) for n, t in (x.split() for x in TILE.split(", "))])
    a = left.select(F.col("block").alias("left"), "chunk", "ids", "labels", "numbers", "windows", F.explode(met).alias("right"))
    z = right.select(F.col("block").alias("right"), "chunk", F.col("ids").alias("other_ids"), F.col("labels").alias("other_labels"), F.col("numbers").alias("other_numbers"))
    return a.join(z, ["right", "chunk"]).select("left", "right", "chunk", "ids", "labels", "windows", "numbers", "other_ids", "other_labels", "other_numbers").mapInArrow(run, TILE)


def reduced(tiles: DataFrame, choose: Callable, schema: str) -> DataFrame:
    """Partial tiles of one place added, and what ``choose`` finds in each sum: it maps scores, ids, labels and windows of a tile
    to columns in the order of ``schema``, all of them longs."""
    names = [x.split()[0] for x in schema.split(", ")]

    def add(group: pa.Table) -> pa.Table:
        first = next(r for r in group.drop_columns(["tile"]).to_pylist() if r["chunk"] == 0)
        of = {n: np.frombuffer(first[n], np.int64) for n in ("ids", "labels", "windows", "other_ids", "other_labels")}
        total = np.zeros(len(of["ids"]) * len(of["other_ids"]), np.int64)
        for chunk in group.column("tile"):
            total += unpacked_tile(chunk.as_py(), len(total))
        found = choose(total.reshape(len(of["ids"]), -1), **of)
        return pa.table([pa.array(np.asarray(x, np.int64)) for x in found], names=names)

    return tiles.groupBy("left", "right", "part").applyInArrow(add, schema)


def first_by(df: DataFrame, keys: list[str], score: str, other: str, count: int) -> DataFrame:
    """Of each key, the first ``count`` rows by falling score, then rising id, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), other)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "id", label_col: str = "label", vec_col: str = "vec", positives: int = 5, negatives: int = 5,
    percent: int = 80, chunk: int = CHUNK, anchor_rows: int = ANCHORS, block_rows: int = ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` of integer vectors. Anchors are the
    rows where ``anchor`` holds; an anchor's positives are the other rows of its label with the highest inner products; of each
    positive, the best rows of other labels that score at most as high and at least ``percent`` of it come back."""
    spark = rows.sparkSession
    rows = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(F.forall(vec_col, lambda x: x.isNotNull()), F.lit(True)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<bigint>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    if not rows.groupBy("id").count().filter("count > 1").isEmpty():
        rows = stored(rows.groupBy("id").agg(F.min(F.struct("label", "vec", "is_anchor")).alias("x")).select("id", "x.*"), "rows")
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int"))
    stats = {r.grp: r for r in rows.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors"), (F.min("label") < F.max("label")).alias("mixed"), F.max(F.size("vec")).alias("width")).collect()}

    width = max([1, *(r.width for r in stats.values())])
    chunk = max(chunk, -(-width // CHUNKS))
    chunks = -(-width // chunk)
    most = max(TILE_ANCHORS, min(block_rows, NUMBERS // chunk))
    blocks = lambda n, size: -(-n // size)
    ends = lambda sizes: np.concatenate(([0], np.cumsum(sizes))).astype(int).tolist()
    counts, anchor_counts = ([blocks(stats[g].n, most) if g in stats else 0 for g in range(GROUPS)], [blocks(stats[g].anchors, anchor_rows) if g in stats else 0 for g in range(GROUPS)])
    starts, anchor_starts = ends(counts), ends(anchor_counts)
    of_group = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("grp") + 1)
    # of a group's blocks a row takes one by its id, so all have about as many rows
    place = lambda n, start: of_group(start[:-1]) + F.pmod(F.xxhash64("id"), F.greatest(of_group(n), F.lit(1)))

    none = F.lit(b"").alias("windows")
    right = stored(matrix_blocks(rows.withColumn("windows", none), place(counts, starts), chunk, chunks), "blocks")
    anchors = rows.filter("is_anchor")
    left = stored(matrix_blocks(anchors.withColumn("windows", none), place(anchor_counts, anchor_starts), chunk, chunks), "anchors")
    first, last = of_group(starts[:-1]), of_group(starts[1:])

    def alike(scores, ids, labels, windows, other_ids, other_labels):
        found = [[], [], []]
        for k, row in enumerate(scores):
            at = np.flatnonzero((other_labels == labels[k]) & (other_ids != ids[k]))
            at = at[best(row[at], other_ids[at], positives)]
            for out, x in zip(found, (np.full(len(at), ids[k]), other_ids[at], row[at]), strict=True):
                out.extend(x.tolist())
        return found

    near = reduced(partial_tiles(left, right, F.sequence(first, last - 1)), alike, "id long, positive_id long, positive_score long")
    near = first_by(near, ["id"], "positive_score", "positive_id", positives).select("id", F.struct("positive_id", "positive_score").alias("x"))
    # the windows of an anchor: 2 * positives longs, unused places with a window that holds nothing
    pair = lambda x: F.concat(*[F.unhex(F.lpad(F.hex(x[n]), 16, "0")) for n in ("positive_id", "positive_score")])
    windows = near.groupBy("id").agg(F.collect_list("x").alias("xs"))
    windows = windows.select("id", F.aggregate("xs", F.lit(b""), lambda out, x: F.concat(out, pair(x))).alias("found"), F.size("xs").alias("many"))
    windows = windows.select("id", F.concat(F.unhex(F.lpad(F.hex("many"), 16, "0")), "found", F.unhex(F.repeat(F.lit("0" * 32), positives - F.col("many")))).alias("windows"))
    left = stored(matrix_blocks(anchors.join(stored(windows, "windows"), "id"), place(anchor_counts, anchor_starts), chunk, chunks), "anchors")

    def unlike(scores, ids, labels, windows, other_ids, other_labels):
        found = [[], [], [], [], []]
        windows = windows.view(">i8").astype(np.int64).reshape(len(ids), 1 + 2 * positives)
        for k, row in enumerate(scores):
            at = np.flatnonzero(other_labels != labels[k])
            own, own_ids = row[at], other_ids[at]
            for positive, score in windows[k, 1 : 1 + 2 * windows[k, 0]].reshape(-1, 2).tolist():
                # 100 * negative is at least percent * positive: rounded up without leaving the integers
                inside = np.flatnonzero((own >= -(-percent * score // 100)) & (own <= score))
                inside = inside[best(own[inside], own_ids[inside], negatives)]
                n = len(inside)
                for out, x in zip(found, ([ids[k]] * n, [positive] * n, own_ids[inside].tolist(), [score] * n, own[inside].tolist()), strict=True):
                    out.extend(x)
        return found

    mixed = F.element_at(F.array(*[F.lit(bool(g in stats and stats[g].mixed)) for g in range(GROUPS)]), F.col("grp") + 1)
    every = F.sequence(F.lit(0), F.lit(max(0, starts[-1] - 1)))
    met = F.when(mixed, every).otherwise(F.filter(every, lambda j: (j < first) | (j >= last)))
    far = reduced(partial_tiles(left, right, met), unlike, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    out = first_by(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, vec): rows whose components are all finite, each component as the floor of ``scale`` times it."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(vec_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("vec"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, b.id, b.label, CAST(list_inner_product(CAST(a.vec AS DOUBLE[]), CAST(b.vec AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5"""
