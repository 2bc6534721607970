"""Orders, picks and schedules. Every order ends in a unique column, so results don't depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.sources.folders import stored


def _in_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows with the range (``_range``) and the number there (``_nth``) of a total order. Rows are dealt out by ranges and
    sorted inside them; they are written once, so that both numbers stay what they were."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.withColumns({"_range": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}), "ranges")


def placed(df: DataFrame, order: Sequence[Column], place: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, in a total order of all rows. Only the counts of the ranges meet in one place."""
    rows = _in_ranges(df, order)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))
    before = sizes.select("_range", "_first", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return rows.join(before, "_range").withColumn(place, F.col("_before") + F.col("_nth") - F.col("_first") + 1).drop("_range", "_nth", "_first", "_before")


def fair_key(last_claimed: Column, priority: Column, bonus_seconds: int = 300) -> Column:
    """A tenant's last claim, a bonus earlier for priority jobs; null (never claimed) goes first."""
    return last_claimed - F.make_dt_interval(secs=F.lit(bonus_seconds) * priority)


def fair_order(jobs: DataFrame, last_claimed: str, priority: str, tenant_created: str, job_created: str, job_id: str) -> list[Column]:
    key = fair_key(F.col(last_claimed), F.col(priority))
    return [key.asc_nulls_first(), F.col(priority).desc(), F.col(tenant_created).asc(), F.col(job_created).asc(), F.col(job_id).asc()]


def round_robin(jobs: DataFrame, tenant: str, order: Sequence[Column], tenant_order: str) -> DataFrame:
    """The whole schedule where each claim moves its tenant to the back and no job has priority: a tenant's k-th job is in
    round k, and a round follows the tenants' order. Both numbers come from sorted ranges, so a tenant may have any number of
    jobs and a round any number of tenants."""
    rows = placed(jobs, [F.col(tenant), *order], "_at")
    first = rows.groupBy(F.col(tenant).alias("_tenant")).agg(F.min("_at").alias("_first"))
    rounds = rows.join(first, F.col(tenant).eqNullSafe(F.col("_tenant"))).withColumn("round", F.col("_at") - F.col("_first")).drop("_at", "_tenant", "_first")
    return placed(rounds, [F.col("round"), F.col(tenant_order), F.col(tenant)])


def claims(jobs: DataFrame, tenants: DataFrame, queue: str, picks: int) -> DataFrame:
    """(queue, pick, tenant, job): the first ``picks`` claims of each queue, by the fair order, where each claim takes the
    job away and sets its tenant's last claim to the pick's time. A claim depends on those before it, so a queue is replayed
    in one task, queues apart, with a heap of tenants. Only a tenant's first ``picks`` jobs by (priority, created, job) can be
    claimed, and only of the ``picks`` tenants whose first job stands first: all before it have to be claimed before another is. So
    what a queue brings to its task is bounded by ``picks``, however long it is."""
    own = Window.partitionBy(queue, "tenant").orderBy(F.col("priority").desc(), "created", "job")
    near = jobs.withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= picks).join(tenants, [queue, "tenant"])
    start = [F.col("last_claimed").isNotNull(), F.coalesce(F.col("last_claimed") - 300 * F.col("priority"), F.lit(0.0)), -F.col("priority"), F.col("tenant_created"), F.col("created"), F.col("job")]
    heads = near.filter("_n = 1").withColumn("_at", F.row_number().over(Window.partitionBy(queue).orderBy(*start))).filter(F.col("_at") <= picks)
    near = near.join(heads.select(queue, "tenant"), [queue, "tenant"], "left_semi")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        waiting: dict = {}
        for r in pdf.sort_values("_n", ascending=False).to_dict("records"):
            waiting.setdefault(r["tenant"], []).append(r)

        def entry(tenant, last) -> tuple:
            r = waiting[tenant][-1]
            return (last is not None, 0.0 if last is None else last - 300 * r["priority"], -r["priority"], r["tenant_created"], r["created"], r["job"], tenant)

        last = {t: None if pd.isna(rs[-1]["last_claimed"]) else rs[-1]["last_claimed"] for t, rs in waiting.items()}
        heap = [entry(t, x) for t, x in last.items()]
        heapify(heap)
        out = []
        while heap and len(out) < picks:
            tenant = heappop(heap)[-1]
            job = waiting[tenant].pop()
            out.append((job[queue], len(out), tenant, job["job"]))
            if waiting[tenant]:
                heappush(heap, entry(tenant, job["now"] + len(out) - 1))
        return pd.DataFrame(out, columns=[queue, "pick", "tenant", "job"])

    kind = {f.name: f.dataType.simpleString() for f in jobs.schema}
    return near.groupBy(queue).applyInPandas(replay, f"{queue} {kind[queue]}, pick long, tenant {kind['tenant']}, job {kind['job']}")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def capped_targets(targets: DataFrame, group: str, anchored: Column, score: Column, tie: Sequence[str], cap: int) -> DataFrame:
    """Rank within a group: anchored rows first (whatever their score), then by score; the first ``cap`` are selected."""
    order = [anchored.desc(), F.when(anchored, 0).otherwise(-score), *[F.col(c) for c in tie]]
    out = targets.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return out.withColumn("state", F.when(F.col("rank") <= cap, "SELECTED").otherwise("NOT_REVIEWED"))


def target_score(signals: DataFrame, keys: Sequence[str], risk: Column, tier: Column, family: Column, exposed: Column) -> DataFrame:
    """Twice the weights of false-positive risk, 3 for each signal of tier T3, 1 for each family, 2 for an exposed target."""
    weight = F.when(risk == "high", 3).when(risk == "medium", 2).otherwise(1)
    return signals.groupBy(*keys).agg((2 * F.sum(weight) + 3 * F.count(F.when(tier == "T3", 1)) + F.countDistinct(family) + 2 * F.max(exposed.cast("int"))).alias("score"))


def lifecycle(present: DataFrame, scans: DataFrame, keys: Sequence[str], key: str, order: str) -> DataFrame:
    """(keys, key, order, status, ever_regressed): each change of status and no other row: new, resolved (at the first scan without
    it), regressed (there again). ``scans``: (keys, order); ``present``: (keys, order, key). Presence falls into runs of
    consecutive scans; a run's first row is a change, and the scan behind its last one. A null key is a key."""
    by = Window.partitionBy(*keys).orderBy(order)
    numbered = scans.select(*keys, order).distinct().withColumns({"_n": F.row_number().over(by), "_next": F.lead(order).over(by)})
    rows = present.select(*keys, key, order).distinct().join(numbered, [*keys, order])
    own = Window.partitionBy(*keys, key).orderBy("_n")
    first = F.coalesce(F.lag("_n").over(own) < F.col("_n") - 1, F.lit(True))
    last = F.coalesce(F.lead("_n").over(own) > F.col("_n") + 1, F.col("_next").isNotNull())
    runs = rows.withColumns({"_first": first, "_last": last}).filter("_first OR _last").withColumn("_run", F.sum(F.col("_first").cast("int")).over(own))
    change = lambda at, status: F.struct(at.alias("at"), F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"))
    begins = F.when(F.col("_first"), change(F.col(order), F.when(F.col("_run") == 1, "new").otherwise("regressed")))
    ends = F.when(F.col("_last"), change(F.col("_next"), "resolved"))
    out = runs.withColumn("_x", F.explode(F.filter(F.array(begins, ends), lambda x: x.isNotNull())))
    return out.select(*keys, key, F.col("_x.at").alias(order), "_x.status", (F.col("_run") > 1).alias("ever_regressed"))


def current_status(changes: DataFrame, keys: Sequence[str], key: str, order: str) -> DataFrame:
    """(keys, key, status, ever_regressed) now, present or resolved, from the changes of ``lifecycle``."""
    last = changes.groupBy(*keys, key).agg(F.max_by("status", order).alias("_s"), F.bool_or("ever_regressed").alias("ever_regressed"))
    return last.select(*keys, key, F.when(F.col("_s") == "resolved", "resolved").otherwise("present").alias("status"), "ever_regressed")


def status_at(changes: DataFrame, asked: DataFrame, keys: Sequence[str], key: str, order: str) -> DataFrame:
    """(keys, key, order, status) of each row (keys, key, order) of ``asked``: the last change up to then, null before the first."""
    own = Window.partitionBy(*keys, key).orderBy(order, "_asked").rowsBetween(Window.unboundedPreceding, 0)
    both = changes.select(*keys, key, order, "status", F.lit(False).alias("_asked")).unionByName(asked.select(*keys, key, order, F.lit(None).cast("string").alias("status"), F.lit(True).alias("_asked")))
    return both.withColumn("status", F.last("status", ignorenulls=True).over(own)).filter("_asked").drop("_asked")


def lifecycle_grid(present: DataFrame, scans: DataFrame, keys: Sequence[str], key: str, order: str) -> DataFrame:
    """Where every scan is asked for: of each (keys, key) at each scan of its keys: new, open, resolved, absent, regressed (there again after it had been
    resolved), and whether it ever regressed so far. ``scans``: (keys, order); ``present``: (keys, order, key)."""
    found = present.select(*keys, key).distinct()
    grid = scans.select(*keys, order).distinct().join(found, list(keys)).join(present.select(*keys, order, key, F.lit(True).alias("_there")).distinct(), [*keys, order, key], "left")
    w = Window.partitionBy(*keys, key).orderBy(order)
    there = F.coalesce("_there", F.lit(False))
    out = grid.withColumn("_now", there).withColumns({"_last": F.lag("_now", 1, False).over(w), "_ever": F.coalesce(F.bool_or("_now").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))})
    status = F.when(F.col("_now") & ~F.col("_ever"), "new").when(F.col("_now") & ~F.col("_last"), "regressed").when(F.col("_now"), "open").when(F.col("_last"), "resolved").when(F.col("_ever"), "absent").otherwise("unseen")
    out = out.withColumn("status", status)
    return out.withColumn("ever_regressed", F.bool_or(F.col("status") == "regressed").over(w)).select(*keys, order, key, "status", "ever_regressed")


def prefix_budget(df: DataFrame, group: str, order: Sequence[Column], size: Column, budget: int) -> DataFrame:
    """Rows in rank order while their running size (none below 0) stays within the budget: the lowest ranks are popped. A group
    may be any size: its sums by ranges of the order are added up first, ranges beyond the budget go, and only inside a range
    are rows added one by one."""
    rows = _in_ranges(df.withColumn("_size", size), [F.col(group), *order])
    sums = rows.groupBy(group, "_range").agg(F.sum("_size").alias("_sum"))
    before = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy(group).orderBy("_range")) - F.col("_sum"))
    left = before.filter(F.col("_before") <= budget).select(F.col(group).alias("_group"), F.col("_range").alias("_r"), "_before")
    near = rows.join(left, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_group")))
    own = F.sum("_size").over(Window.partitionBy("_range", group).orderBy("_nth").rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("running", F.col("_before") + own).filter(F.col("running") <= budget).select(*df.columns, "running")


