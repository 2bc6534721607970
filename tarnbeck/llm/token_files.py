"""Token ids in Parquet: list columns with dictionary or delta encoding, controlled row groups and page indexes.

Documents are dealt out by ranges of their id and sorted, encoded, and written by Spark's Parquet writer with a row group
and page size set here. The writer adds column and offset indexes, so a reader that filters on doc_id skips row groups
and pages, and one that selects doc_id and n_tokens never touches the token pages. Files are named by range; each row
holds its range's number and the count of ids before it in that range, so a global position needs one sum per range.

Defined results: a null or empty text is its end id alone; rows with one id stand in the input's order and may fill several
ranges; a null id sorts first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnbeck.llm.bpe import coder, with_end
from tarnbeck.llm.common import bounded_batches, new_folder, table

END_ID = 0
#: Encodings of the ids' pages: by dictionary while its page is small, or the second format's delta encoding.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20)},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "v2"},
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 128 << 10, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write (id_col, part, start_in_part, n_tokens, ids) to ``path`` in ascending order of the id."""
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, before = coder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, at = with_end(*code.encode_column(b.column(1)), end_id)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(before + at[:-1]), pa.array(np.diff(at)), lists], names=["id", "part", "start_in_part", "n_tokens", "ids"])
            before += int(at[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    # rows of one id may be many: their place in the input breaks the tie, so that a range can end among them
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "t")
    made = dealt.mapInArrow(run, f"id {kind}, part int, start_in_part long, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)
    made.write.options(**{"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.write-checksum.enabled": "true", **ENCODINGS[encoding]}).parquet(path)


def read_index(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, part, start, n_tokens) from the metadata columns alone: start counts the ids of all documents before it."""
    rows = spark.read.parquet(path).select(id_col, "part", "start_in_part", "n_tokens")
    return rows.join(part_starts(rows), "part").select(id_col, "part", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens")


def part_starts(rows: DataFrame) -> DataFrame:
    """(part, part_start): one row for each range."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids)."""
    rows = spark.read.parquet(path)
    return rows.join(part_starts(rows), "part").select(id_col, (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def list_crc32(lists: pa.Array) -> list[int]:
    """CRC-32 of each list's ids as little-endian unsigned 32-bit integers."""
    flat, ends = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4"), lists.offsets.to_numpy()
    return [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(list_crc32(b.column(4)), pa.int64())], names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    stored = spark.read.parquet(path)
    kind = stored.schema["doc_id"].dataType.simpleString()
    read = stored.select("doc_id", "part", "start_in_part", "n_tokens", "ids").mapInArrow(digests, f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return read.join(part_starts(stored), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
