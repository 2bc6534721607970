"""Leases and back-off gates as event-time timers: a job's state leaves when its timer is due, without another event.

A job is claimed by a beat and held by further beats, each of which renews its lease. A lease that is over counts an attempt and
puts the job back behind a gate, which opens after a back-off that doubles; at the last attempt the job fails. A beat before
the gate opens is refused; the job's end is taken from the holder of a lease only. A job that nobody claims is forgotten some
time after its gate has opened. Ended, failed and forgotten jobs leave no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What happens to a job: at (microseconds), what, attempts so far, and when its gate opens.
Step = tuple[int, str, int, int | None]


@dataclass(frozen=True)
class Rules:
    """Microseconds of a lease, of the first back-off and the longest, of what is remembered behind a gate; attempts at most."""

    lease: int
    base: int
    longest: int
    remembered: int
    most: int = 3


@dataclass
class Job:
    """``attempts`` that ran out; of ``expires``, ``opens`` and ``forgotten`` the one that is due next, others null."""

    attempts: int = 0
    expires: int | None = None
    opens: int | None = None
    forgotten: int | None = None

    def due(self) -> int | None:
        return next((x for x in (self.expires, self.opens, self.forgotten) if x is not None), None)


def passed(job: Job, until: int, rules: Rules, inclusive: bool) -> Iterator[Step]:
    """What falls due up to ``until``. A beat at the very end of a lease still renews it, so before an event ends are exclusive."""
    over = lambda x: x is not None and (x <= until if inclusive else x < until)
    if over(job.expires):
        at, job.attempts, job.expires = job.expires, job.attempts + 1, None
        if job.attempts >= rules.most:
            yield at, "failed", job.attempts, None
            job.attempts = 0
        else:
            job.opens = at + min(rules.base << (job.attempts - 1), rules.longest)
            yield at, "requeued", job.attempts, job.opens
    if job.opens is not None and job.opens <= until:
        yield job.opens, "eligible", job.attempts, None
        job.opens, job.forgotten = None, job.opens + rules.remembered
    if over(job.forgotten):
        job.attempts, job.forgotten = 0, None


def happened(job: Job, at: int, done: bool, rules: Rules) -> Iterator[Step]:
    """A beat or an end at ``at``, behind what fell due before it."""
    yield from passed(job, at, rules, False)
    if done:
        if job.expires is None:
            yield at, "fenced", job.attempts, job.opens
        else:
            yield at, "done", job.attempts, None
            job.attempts, job.expires = 0, None
    elif job.opens is not None:
        yield at, "refused", job.attempts, job.opens
    else:
        if job.expires is None:
            yield at, "claimed", job.attempts, None
        job.expires, job.forgotten = at + rules.lease, None


class LeaseTimers(StatefulProcessor):
    """State of a key: its job and the timer that stands for it."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "attempts int, expires long, opens long, forgotten long, timer long")

    def _held(self) -> tuple[Job, int | None]:
        if not self.job.exists():
            return Job(), None
        *state, timer = self.job.get()
        return Job(*state), timer

    def _hold(self, job: Job, timer: int | None) -> None:
        due = job.due()
        now = None if due is None else -(-due // 1000)  # timers have milliseconds
        if timer is not None and timer != now:
            self.handle.deleteTimer(timer)
        if now is None:
            self.job.clear()
            return
        if timer != now:
            self.handle.registerTimer(now)
        self.job.update((*astuple(job), now))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        job, timer = self._held()
        for at, _, done in sorted((r.at, r.id, r.done) for r in rows):
            for step in happened(job, at, done, self.rules):
                yield Row(k=key[0], at=step[0], what=step[1], attempts=step[2], opens=step[3])
        self._hold(job, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        job, _ = self._held()
        for step in passed(job, timerValues.getCurrentWatermarkInMs() * 1000, self.rules, True):
            yield Row(k=key[0], at=step[0], what=step[1], attempts=step[2], opens=step[3])
        self._hold(job, None)  # the timer that called is gone already

    def close(self) -> None:
        pass


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state in RocksDB, as timers ask for; the session's own setting comes back."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def _shown(steps: DataFrame, key: str, kind: str) -> DataFrame:
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return steps.select(F.col("k").cast(kind).alias(key), time(F.col("at")).alias("at"), "what", "attempts", time(F.col("opens")).alias("opens"))


def _events(events: DataFrame, key: str, at: str, id_col: str, done: str) -> DataFrame:
    return events.select(F.col(key).alias("k"), F.col(at).cast("timestamp").alias("ts"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(id_col).alias("id"), F.coalesce(done, F.lit(False)).alias("done"))


def lease_stream(events: DataFrame, key: str, at: str, id_col: str, done: str, rules: Rules, late: str = "0 seconds") -> DataFrame:
    """(key, at, what, attempts, opens) of a stream of beats and ends (column ``done``): claimed, refused, done, fenced, requeued, eligible, failed. Leases end
    and gates open by the watermark. Start it within ``timers``."""
    rows = _events(events, key, at, id_col, done).withWatermark("ts", late)
    kind = events.schema[key].dataType.simpleString()
    steps = rows.groupBy("k").transformWithState(LeaseTimers(rules), f"k {kind}, at long, what string, attempts int, opens long", "append", "eventTime")
    return _shown(steps, key, kind)


def lease_history(events: DataFrame, key: str, at: str, id_col: str, done: str, rules: Rules, until: int) -> DataFrame:
    """``lease_stream`` on a batch, as of ``until`` (microseconds). A task streams through its jobs' sorted rows."""
    kind = events.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = object()
        now, job = none, Job()
        for b in batches:
            out = []
            for k, x, end in zip(b["k"], b["at"], b["done"], strict=True):
                if k != now:
                    if now is not none:
                        out += [(now, *s) for s in passed(job, until, rules, True)]
                    now, job = k, Job()
                out += [(k, *s) for s in happened(job, x, end, rules)]
            yield _frame(out)
        if now is not none:
            yield _frame([(now, *s) for s in passed(job, until, rules, True)])

    rows = _events(events, key, at, id_col, done).filter("k IS NOT NULL AND at IS NOT NULL").drop("ts")
    steps = rows.repartition("k").sortWithinPartitions("k", "at", "id").mapInPandas(run, f"k {kind}, at long, what string, attempts int, opens long")
    return _shown(steps, key, kind)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["k", "at", "what", "attempts", "opens"]).astype({"opens": "Int64"})
