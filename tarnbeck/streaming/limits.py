"""Rate limits, idempotent ingestion, leases and sinks, for batches and for Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnbeck.sources.folders import new_folder


def admit(recent: list[float], at: float, window: float, most: int) -> tuple[list[float], bool, float]:
    """The attempts that still count, whether one more is admitted, and else how long to wait. A refused attempt is not
    recorded; one exactly at the window's edge no longer counts."""
    live = [x for x in recent if x > at - window]
    if len(live) < most:
        return [*live, at], True, 0.0
    return live, False, max(1.0, live[0] + window - at)


def limited(attempts: DataFrame, key: str, at: str, id_col: str, window: float, most: int) -> DataFrame:
    """(id_col, admitted, retry_after) in order of time: what is refused leaves no trace, so each outcome depends on the ones
    before. A task streams through its keys' sorted rows and holds one key's last ``most`` times."""
    kind = attempts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = object(), []
        for b in batches:
            out = []
            for k, i, x in zip(b["k"], b[id_col], b["at"], strict=True):
                if k != now:
                    now, recent = k, []
                recent, ok, wait = admit(recent, x, window, most)
                out.append((i, ok, wait))
            yield pd.DataFrame(out, columns=[id_col, "admitted", "retry_after"])

    rows = attempts.select(F.col(key).alias("k"), id_col, F.col(at).cast("double").alias("at"))
    return rows.repartition("k").sortWithinPartitions("k", "at", id_col).mapInPandas(run, f"{id_col} {kind}, admitted boolean, retry_after double")


def limited_stream(attempts: DataFrame, key: str, at: str, id_col: str, window: float, most: int) -> DataFrame:
    """``limited`` on a stream: a key's state is its last admitted times, at most ``most``."""
    kinds = {f.name: f.dataType.simpleString() for f in attempts.schema}

    def step(k: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(chunks)).sort_values(["at", id_col])
        recent = list(state.get[0]) if state.exists else []
        out = []
        for i, x in zip(rows[id_col], rows["at"], strict=True):
            recent, ok, _ = admit(recent, x, window, most)
            out.append((i, ok))
        state.update((recent,))
        yield pd.DataFrame(out, columns=[id_col, "admitted"])

    rows = attempts.select(F.col(key).alias("k"), id_col, F.col(at).cast("double").alias("at"))
    return rows.groupBy("k").applyInPandasWithState(step, f"{id_col} {kinds[id_col]}, admitted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def first_deliveries(events: DataFrame, ids: Sequence[str], at: str, late: str) -> DataFrame:
    """A stream without repeated deliveries; an id is remembered until the watermark passes it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(ids))


def leases(beats: DataFrame, key: str, at: str, lease: str) -> DataFrame:
    """(key, started, expires, beats): a lease runs on while each beat comes before it ends. Works on batches and, with a
    watermark, on streams, where a lease comes out once it is over."""
    s = F.session_window(at, lease)
    out = beats.groupBy(key, s.alias("s")).agg(F.count("*").alias("beats"))
    return out.select(key, F.col("s.start").alias("started"), F.col("s.end").alias("expires"), "beats")


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, write it to ``path`` and read that back."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], Any], state: str, once: bool = True) -> None:
    """Poll a stream: ``work`` on every micro-batch, at once to the end or every second."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", state)
    (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start().awaitTermination()
