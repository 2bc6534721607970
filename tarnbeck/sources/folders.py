"""Fresh paths in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names, else the context's own checkpoint folder. Only a local session, where all share
    one machine, gets a temporary folder; anywhere else a missing setting is an error."""
    found = spark.conf.get(RUN, None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarnbeck-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: The session's setting that names a run's own folder.
RUN = "tarnbeck.run.folder"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """All that is stored inside goes to a folder of its own, which is removed at the end: results have to be written elsewhere, or
    collected, before that."""
    path, before = new_folder(spark, "run"), spark.conf.get(RUN, None)
    spark.conf.set(RUN, path)
    try:
        yield path
    finally:
        spark.conf.unset(RUN) if before is None else spark.conf.set(RUN, before)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/tarnbeck-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts the lineage and survives lost executors."""
    path = new_folder(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
