"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

Texts are equal when they agree after all blanks are deleted. A first scan counts rows by (length, hash of the first
PREFIX characters); a length or prefix that one row alone has settles that row. The surviving (length, prefix) keys go
into a bitmap of BITS_PER_KEY bits a key or more (up to MOST_BITS in all), which the second scan consults before it reads a
text's whole content, so the full SHA-256 is taken of surviving rows only, and of the few that share a survivor's bit: those
turn out to be alone. No text is shuffled: after the scans a row is its id, two lengths and a hash. Groups are summed on the
map side first, so a group may hold any share of the rows.

Defined results: a null text counts as empty, and empty texts are equal to each other; of equal texts the row with the
most code points in the original stays, then the one with the least non-null id; of repeated rows with the same id, one
is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm.columns import free_names
from tarnbeck.llm.common import BLANKS, stored, table

PREFIX = 64
#: The survivors' bitmap: bits for each surviving key, and bits at least and at most (64 MiB).
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29


def normalised(text: Column) -> Column:
    """The text without blanks; null as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def text_sha256(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def survivors_bitmap(keys: DataFrame) -> DataFrame:
    """(bucket, bits): 4 KiB for every 32,768 bits, from the hashed keys of the column ``bit``."""
    return keys.select(F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, hash_all: bool = False, bitmap_bits: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: id_col, keep_id, group_size, kept, text_sha256 and the narrow columns of ``carry``,
    which must follow from the text and the id. ``text_sha256`` is null where a row was settled before its content was
    needed; ``hash_all`` takes it of every row."""
    carry = carry or {}
    seen = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("points"), *[c.alias(n) for n, c in carry.items()])
    seen = seen.withColumns({"size": F.length("norm"), "prefix": F.xxhash64(F.left("norm", F.lit(PREFIX)))})
    # a (length, prefix) of several rows implies a length of several rows, so one aggregation takes both steps
    keys = stored(seen.groupBy("size", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("size", "prefix"), "keys")
    bits = bitmap_bits or min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    bit = (F.pmod(F.xxhash64("size", "prefix"), F.lit(bits)) + 1).alias("bit")
    bitmap = F.broadcast(survivors_bitmap(keys.select(bit)))
    tested = seen.withColumn("bit", bit).withColumn("bucket", F.bitmap_bucket_number("bit")).join(bitmap, "bucket", "left")
    at = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    sha = F.sha2("norm", 256)
    # the stored number tells repeated rows apart, so that of several with the same id exactly one is kept
    rows = tested.select("id", "points", hit.alias("hit"), (sha if hash_all else F.when(hit, sha)).alias("text_sha256"), F.monotonically_increasing_id().alias("row"), *carry)
    rows = stored(rows, "hashes")

    out = ["id", "keep_id", "group_size", "kept", "text_sha256", *carry]
    alone = rows.filter("not hit").select("*", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")).select(out)
    grouped = rows.filter("hit")
    best = grouped.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
    # written first: a join right above its aggregation can't be split where a group holds many rows
    best = stored(best, "groups")
    placed = grouped.join(best, "text_sha256").select("*", F.col("best.id").alias("keep_id"), (F.col("row") == F.col("best.row")).alias("kept")).select(out)
    return alone.union(placed).withColumnRenamed("id", id_col)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    key, gone_key = free_names(docs, ["row", "gone"])
    if docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        key = id_col
    else:
        # ids that repeat don't tell rows apart: a stored number does, and ranks as the id does
        order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("n"))
        docs = stored(docs.withColumn(key, order), "rows")
    gone = exact_groups(docs, key, text_col).filter(~F.col("kept")).select(F.col(key).alias(gone_key))
    out = docs.join(stored(gone, "gone"), F.col(key).eqNullSafe(F.col(gone_key)), "left_anti")
    return out if key == id_col else out.drop(key)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), hash_all=True)


OP2_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)"""
