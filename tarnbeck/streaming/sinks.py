"""Sinks that a repeated micro-batch can't double: a ledger by batch number, and deliveries that it remembers.

Spark repeats a micro-batch whose end it could not record, with the same number and the same rows. So each batch has a partition
of its own, which a repetition replaces, and a batch counts once Spark's committer has marked its partition as whole. What leaves Spark (a
log, a webhook) can't be taken back: outcomes are written beside the batch, a repetition sends only what has no good outcome
yet, and every message carries a key by which the receiver can drop what it already has.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("info", "warning", "error")
_log = logging.getLogger(__name__)


def _done(spark: SparkSession, pattern: str) -> list[str]:
    """The folders of a pattern that were written to their end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return [x.getPath().getParent().getName() for x in found]


def partition_of(path: str, number: int) -> str:
    return f"{path}/batch={number}"


def ledger(path: str) -> Callable[[DataFrame, int], None]:
    """Work for ``foreachBatch``: the batch as the partition of its number, in place of what a first attempt left there."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(partition_of(path, number))

    return write


def whole_batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that were written to their end."""
    return sorted(int(x.partition("=")[2]) for x in _done(spark, f"{path}/batch=*"))


def read_ledger(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """(columns of ``like``, batch): every row once. Rows of a batch that was not written to its end don't count."""
    numbers = whole_batches(spark, path)
    schema = f"{', '.join(f'`{n}` {t}' for n, t in like.dtypes)}, batch long"
    if not numbers:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*[partition_of(path, n) for n in numbers])


def deliveries(path: str, send: Callable[[dict[str, Any]], None], id_col: str) -> Callable[[DataFrame, int], None]:
    """Work for ``foreachBatch``: each row is handed to ``send``, in the tasks, with its ``idempotency_key``. A send that fails
    never ends the query; the kind of its error is recorded, and a repetition of the batch tries those rows again."""

    def work(batch: DataFrame, number: int) -> None:
        spark, kind = batch.sparkSession, batch.schema[id_col].dataType.simpleString()
        sent = partition_of(path, number)
        before = sorted(int(x.partition("=")[2]) for x in _done(spark, f"{sent}/attempt=*"))
        left = batch
        for attempt in before:
            done = spark.read.parquet(f"{sent}/attempt={attempt}").filter("error IS NULL").select(id_col)
            left = left.join(done, id_col, "left_anti")
        rows = left.withColumn("idempotency_key", F.sha2(F.concat_ws(":", F.lit(path), F.lit(number), F.col(id_col).cast("string")), 256))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                errors = []
                for row in b.to_dict("records"):
                    try:
                        send(row)
                        errors.append(None)
                    except Exception as e:  # the kind alone: a message may hold the receiver's address
                        _log.warning("delivery failed: %s", type(e).__name__)
                        errors.append(type(e).__name__)
                yield pd.DataFrame({id_col: b[id_col], "error": pd.Series(errors, dtype=object)})

        rows.mapInPandas(run, f"{id_col} {kind}, error string").write.mode("overwrite").parquet(f"{sent}/attempt={(before or [-1])[-1] + 1}")

    return work


def alerts(events: DataFrame, severity: Column, kinds: list[str], kind_col: str) -> DataFrame:
    """Events of the alerting kinds with one of the three severities; any other severity reads as a warning."""
    own = F.when(severity.isin(*SEVERITIES), severity).otherwise("warning")
    return events.filter(F.col(kind_col).isin(*kinds)).withColumn("severity", own)


def audit_rows(events: DataFrame, kind_col: str) -> DataFrame:
    """Events as audit rows; one whose kind is null or blank is marked as refused, for an audit row needs a kind."""
    return events.withColumn("refused", F.coalesce(F.trim(F.col(kind_col)) == "", F.lit(True)))
