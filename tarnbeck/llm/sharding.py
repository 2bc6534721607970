"""Shards of nearly equal bytes by vector bin packing: bytes, tokens and rows are balanced jointly.

Tokens are words. Rows with equal texts form a group and go to one shard, unless the group has more than 1 / GRAIN of a
shard's bytes, tokens or rows: then it is split into chunks below that. Groups are too many to place one by one on a driver, so
the light ones are first dealt by hash into BUCKETS bundles. Bundles and chunks number at most BUCKETS + 6 * shards * GRAIN,
whatever the input's size; each, largest first, goes to the shard where the dot product of its vector with the shard's residual capacity is
highest, and exchanges of two items between the fullest and the emptiest shard then even out the bytes, as far as tokens and
rows stay balanced.

Slots are numbered per task and shard in a first pass over narrow rows and moved by the sums of the tasks before, so no
shard is ever gathered in one task.

Defined results: a null text has size 1 and is grouped with the empty ones; repeated rows are placed each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnbeck.llm.common import stored, table

BUCKETS, GRAIN = 4096, 4
#: How far over the mean a shard's tokens or rows may come where bytes are evened out, tried in turn until bytes are this close.
LOOSE, CLOSE = (0.02, 0.1, 9.0), 0.002
WORD = r"[^\x20\x09-\x0D]+"


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; items: [item, dimension]. Largest first, to the highest dot product with what is left."""
    total = items.sum(0)
    share = items / np.where(total > 0, total, 1)
    left = np.full((shards, items.shape[1]), 1 / shards)
    where = np.zeros(len(items), np.int64)
    for k in np.argsort(-share.max(1), kind="stable"):
        where[k] = int(np.argmax(left @ share[k]))
        left[where[k]] -= share[k]
    return even_out(items, where, shards)


def even_out(items: np.ndarray, where: np.ndarray, shards: int) -> np.ndarray:
    """Even out the bytes (the first dimension), for they are the law: with the other dimensions at most LOOSE over their mean,
    or wider where that does not bring the bytes within CLOSE."""
    for loose in LOOSE:
        where = exchanged(items, where, shards, loose)
        loads = np.bincount(where, items[:, 0], shards)
        if loads.max() - loads.min() <= CLOSE * loads.mean():
            break
    return where


def exchanged(items: np.ndarray, where: np.ndarray, shards: int, loose: float, rounds: int = 2000) -> np.ndarray:
    """Move or exchange items between the shards with the most and the fewest bytes while that brings the two closer and leaves
    no shard with more of another dimension than the fullest has, or than ``loose`` over the mean."""
    weights = items[:, 0]
    loads = np.stack([np.bincount(where, x, shards) for x in items.T], 1)
    for _ in range(rounds):
        hi, lo = int(loads[:, 0].argmax()), int(loads[:, 0].argmin())
        gap = loads[hi, 0] - loads[lo, 0]
        a, b = np.flatnonzero(where == hi), np.flatnonzero(where == lo)
        if not len(a) or gap <= 1:
            break
        # for each item of the fullest, the two partners (or none) whose difference is nearest to half the gap
        order = b[np.argsort(weights[b], kind="stable")]
        back = np.concatenate((np.zeros((1, items.shape[1])), items[order]))
        want = weights[a] - gap / 2
        at = np.clip(np.searchsorted(back[:, 0], want), 1, len(back) - 1) if len(back) > 1 else np.zeros(len(a), np.int64)
        both = np.stack([at, np.maximum(at - 1, 0)])
        moved = items[a] - back[both]
        most = np.maximum(loads.max(0), loads.mean(0) * (1 + loose))[1:]
        good = (moved[..., 0] > 0) & (moved[..., 0] < gap) & ((loads[lo] + moved)[..., 1:] <= most).all(-1) & ((loads[hi] - moved)[..., 1:] <= most).all(-1)
        miss = np.where(good, np.abs(back[both][..., 0] - want), np.inf)
        j, i = np.unravel_index(int(miss.argmin()), miss.shape)
        if not good[j, i]:
            break
        where[a[i]] = lo
        if both[j, i]:
            where[order[both[j, i] - 1]] = hi
        loads[hi] -= moved[j, i]
        loads[lo] += moved[j, i]
    return where


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size (bytes + 1), tokens (words), text_crc32, shard and slot, one row for each row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_count(text, F.lit(WORD))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), words.cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("group"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows, "sizes")
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")]
    total = rows.agg(*sums).first()
    # how many times a group has what a chunk of it may have, by the dimension that it has most of
    times = F.greatest(*[F.col(c) / max(1, (total[c] or 0) // (shards * GRAIN)) for c in "btn"])
    # fewer than 3 * shards * GRAIN groups can have more than 1 / (shards * GRAIN) of one of three totals
    heavy = rows.groupBy("group").agg(*sums).select("group", (F.floor(times) + 1).cast("long").alias("chunks")).filter(times > 1)
    heavy = stored(heavy, "heavy")
    tag = F.when(F.col("chunks").isNull(), F.struct(F.lit(None).cast("long").alias("g"), F.pmod(F.xxhash64("group"), F.lit(BUCKETS)).alias("k")))
    tag = tag.otherwise(F.struct(F.col("group").alias("g"), F.pmod(F.xxhash64("row"), F.col("chunks")).alias("k")))
    tagged = rows.join(F.broadcast(heavy), "group", "left").withColumn("item", tag)
    items = tagged.groupBy("item").agg(*sums).orderBy("item").collect()
    where = place(np.array([[x.b, x.t, x.n] for x in items], float).reshape(-1, 3), shards)
    placed = spark.createDataFrame([(x.item.g, x.item.k, int(w)) for x, w in zip(items, where, strict=True)], "g long, k long, shard int")

    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for b in batches:
            shard = b.column(4).to_numpy()
            slot = np.empty(len(shard), np.int64)
            for s in np.unique(shard):
                at = shard == s
                slot[at] = seen[s] + np.arange(at.sum())
                seen[s] += at.sum()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(slot)], names=["id", "size", "tokens", "crc", "shard", "part", "local"])

    at = tagged.join(F.broadcast(placed), F.col("item.g").eqNullSafe(F.col("g")) & (F.col("item.k") == F.col("k")))
    local = stored(at.select("id", "size", "tokens", "crc", "shard").mapInArrow(count, f"id {kind}, size long, tokens long, crc long, shard int, part int, local long"), "local")
    counts = local.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = counts.select("part", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    out = local.join(before, ["part", "shard"])
    return out.select(F.col("id").alias(id_col), "size", "tokens", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("local")).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharded(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
