"""What the operators of this subpackage share: table reading, tables stored between steps, bounds of batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tarnbeck.sources.folders import new_folder, stored

__all__ = ["BLANKS", "bounded_batches", "new_folder", "stored", "table", "texts_of"]

#: The characters that separate words, in every operator: space and \t \n \v \f \r.
BLANKS = "\t\n\x0b\x0c\r "

#: Rows and bytes of one Arrow batch at most. A text longer than that is a batch of its own.
ROWS_PER_BATCH, BYTES_PER_BATCH = 1024, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to the bounds above, by rows and by bytes, where they are larger: a worker holds one
    batch at a time, and texts can be very long. The settings are read when a job runs, so they stay."""
    for name, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", BYTES_PER_BATCH)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The column's values as bytes, null as empty."""
    for x in column:
        yield x.as_py() or b""
