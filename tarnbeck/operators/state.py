"""Next states as pure functions: current rows and events in, rows out. Spark has no row updates, so a conditional update is
a projection and its row count an aggregate. Folds whose outcome depends on earlier outcomes run per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``old`` and the first new row of each key that is not there yet."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def set_if(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """The columns' new values where the condition holds (null counts as false), and ``changed``."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumn("changed", hit).withColumns({c: F.when(F.col("changed"), v).otherwise(F.col(c)) if c in df.columns else F.when(F.col("changed"), v) for c, v in values.items()})


def admission(model: Column, checks: Sequence[tuple[str, Column]]) -> Column:
    """The code of the first check that fails, in order, or the model."""
    out = F.when(checks[0][1], checks[0][0])
    for code, failed in checks[1:]:
        out = out.when(failed, code)
    return out.otherwise(model)


def reserve(requests: DataFrame, key: str, order: Sequence[str], amount: str, limit: str, id_col: str) -> DataFrame:
    """(id_col, granted): a request is granted if it fits with those granted before; a refused one takes nothing, so this is
    no running sum but a fold in the key's order. A task streams through its keys' sorted rows and holds one sum, so a key may
    have any number of requests; one above the limit by itself never fits and is not brought there."""
    kind = requests.schema[id_col].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = object(), 0
        for b in batches:
            out = []
            for k, x, most in zip(b["_k"].tolist(), b["_x"].tolist(), b["_m"].tolist(), strict=True):
                if k != now:
                    now, used = k, 0
                out.append(used + x <= most)
                used += x if out[-1] else 0
            yield pd.DataFrame({id_col: b["_i"], "granted": out})

    rows = requests.select(F.col(key).alias("_k"), F.col(amount).alias("_x"), F.col(limit).alias("_m"), F.col(id_col).alias("_i"), *[F.col(c).alias(f"_o{n}") for n, c in enumerate(order)])
    fits = F.coalesce(F.col("_x") <= F.col("_m"), F.lit(False))
    never = rows.filter(~fits).select(F.col("_i").alias(id_col), F.lit(False).alias("granted"))
    dealt = rows.filter(fits).repartition("_k").sortWithinPartitions("_k", *[f"_o{n}" for n in range(len(order))])
    return dealt.mapInPandas(fold, f"{id_col} {kind}, granted boolean").unionByName(never)


def settle(jobs: DataFrame, terminal: DataFrame, job: str, owner: str, units: str) -> DataFrame:
    """(owner, reserved, consumed, released): each job's units count once, by its first terminal event (column outcome)."""
    first = terminal.groupBy(job).agg(F.min_by("outcome", "at").alias("outcome"))
    rows = jobs.join(first, job, "left")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col(units))), F.lit(0))
    o = F.col("outcome")
    return rows.groupBy(owner).agg(part(o.isNull()).alias("reserved"), part(o == "succeeded").alias("consumed"), part(o == "failed").alias("released"))


def reap(jobs: DataFrame, now: Column, status: str, attempts: str, lease: str, most: int = 3) -> DataFrame:
    """Running jobs whose lease is over go back to the queue with a back-off, or fail at the last attempt."""
    from tarnbeck.functions.scalars import backoff_seconds, plus_seconds

    over = (F.col(status) == "running") & F.col(lease).isNotNull() & (F.col(lease) < now)
    again = F.col(attempts) + 1 < most
    out = jobs.withColumn("reaped", F.coalesce(over, F.lit(False)))
    gate = F.when(F.col("reaped") & again, plus_seconds(now, backoff_seconds(F.col(attempts))))
    return out.withColumns({"next_status": F.when(F.col("reaped"), F.when(again, "queued").otherwise("failed")).otherwise(F.col(status)), "next_attempts": F.col(attempts) + F.col("reaped").cast("int"), "next_eligible_at": gate})


def transition(rows: DataFrame, allowed: DataFrame, state: str, wanted: str) -> DataFrame:
    """Moves along the allowed edges (from, to); any other wish changes nothing."""
    edges = allowed.select(F.col("from").alias(state), F.col("to").alias(wanted), F.lit(True).alias("_ok"))
    out = rows.join(edges, [state, wanted], "left").withColumn("applied", F.coalesce("_ok", F.lit(False))).drop("_ok")
    return out.withColumn("next_state", F.when(F.col("applied"), F.col(wanted)).otherwise(F.col(state)))


def fenced(results: DataFrame, jobs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each result and whether it is of the job's present attempt and owner: all keys must agree."""
    return results.join(jobs.select(*keys, F.lit(True).alias("applied")).distinct(), list(keys), "left").withColumn("applied", F.coalesce("applied", F.lit(False)))


def newest(events: DataFrame, key: str, value: str, at: str, tie: str) -> DataFrame:
    """The value of each key's newest event; an older event that arrives later changes nothing."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(at, tie)).alias(value), F.max(at).alias(at))


def upsert(old: DataFrame, new: DataFrame, key: str, value: str, guard: str) -> DataFrame:
    """(key, value, outcome): created, updated, or ignored where the new row does not pass its guard; unchanged without one."""
    n = new.select(key, F.col(value).alias("_v"), F.col(guard).alias("_g"), F.lit(True).alias("_new"))
    out = old.select(key, F.col(value).alias("_o"), F.lit(True).alias("_old")).join(n, key, "full")
    outcome = F.when(F.col("_new").isNull(), "unchanged").when(~F.coalesce("_g", F.lit(False)), "ignored").when(F.col("_old").isNull(), "created").otherwise("updated")
    return out.withColumn("outcome", outcome).select(key, F.when(F.col("outcome").isin("created", "updated"), F.col("_v")).otherwise(F.col("_o")).alias(value), "outcome")


def idempotent(requests: DataFrame, key: str, fingerprint: str, order: Sequence[Column]) -> DataFrame:
    """Each request: first, replay (same fingerprint as the key's first) or conflict."""
    w = Window.partitionBy(key).orderBy(*order)
    return requests.withColumn("outcome", F.when(F.row_number().over(w) == 1, "first").when(F.first(fingerprint).over(w) == F.col(fingerprint), "replay").otherwise("conflict"))


def attempts_in_window(events: DataFrame, key: str, seconds_col: str, window: int) -> Column:
    """How many attempts of the key lie in the last ``window`` seconds, this one included; the oldest edge is outside."""
    return F.count("*").over(Window.partitionBy(key).orderBy(seconds_col).rangeBetween(-window + 1, 0))


def purge(rows: DataFrame, created: str, cutoff: Column, content: Sequence[str]) -> DataFrame:
    """Content older than the cutoff becomes null, its row stays."""
    return set_if(rows, F.col(created) < cutoff, **{c: F.lit(None).cast(rows.schema[c].dataType) for c in content})
