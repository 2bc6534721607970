"""Counts, ledgers and scores. Everything is one grouped aggregation with conditional sums, combined on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ["INFORMATIONAL", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
CONFIDENCES = ["low", "medium", "high"]


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def status_counts(df: DataFrame, keys: Sequence[str], status_col: str, statuses: Sequence[str]) -> DataFrame:
    """A count column for each status, 0 where there is none."""
    return df.groupBy(*keys).agg(*[count_if(F.col(status_col) == s).alias(s) for s in statuses])


def usage_state(used: Column, limit: Column) -> Column:
    """unlimited without a limit; blocked at a limit of 0 or less, or used up; danger from 90 %, warning from 80 %."""
    return (
        F.when(limit.isNull(), "unlimited").when((limit <= 0) | (used >= limit), "blocked")
        .when(used * 100 >= limit * 90, "danger").when(used * 100 >= limit * 80, "warning").otherwise("ok")
    )


def usage(reserved: Column, consumed: Column, limit: Column) -> list[Column]:
    """used, remaining (never below 0) and state."""
    used = F.coalesce(reserved, F.lit(0)) + F.coalesce(consumed, F.lit(0))
    return [used.alias("used"), F.greatest(F.lit(0), limit - used).alias("remaining"), usage_state(used, limit).alias("state")]


def technical_limit(quota: Column, dearest: int, per: int = 20) -> Column:
    """A whole number of the dearest runs for each ``per`` units of quota."""
    return F.floor(quota / per).cast("long") * dearest


def ordinal(keys: Sequence[str], order: Sequence[Column]) -> Column:
    """0-based occurrence number within a key."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


def rank_of(value: Column, scale: Sequence[str]) -> Column:
    """Place on the scale from 0, null off it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, scale)), value), F.lit(0)).cast("int") - 1


def merged_findings(df: DataFrame, key: str, order: str, severity: str, confidence: str, location: str, evidence: str, most_evidence: int = 5) -> DataFrame:
    """One row for each key: the highest severity and confidence, distinct locations, the first few distinct evidences in
    order of arrival, how many were merged, and the first row's order."""
    by = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(evidence).alias("e"))))
    return df.groupBy(key).agg(
        F.max(rank_of(F.col(severity), SEVERITIES)).alias("severity_rank"),
        F.max(rank_of(F.col(confidence), CONFIDENCES)).alias("confidence_rank"),
        F.sort_array(F.collect_set(location)).alias("locations"),
        F.slice(F.array_distinct(F.transform(by, lambda x: x["e"])), 1, most_evidence).alias("evidence"),
        F.count("*").alias("merged_count"),
        F.min(order).alias("first_order"),
    )


def coverage(categories: DataFrame, passes: DataFrame, backed: DataFrame, category: str, status: str, complete: bool) -> DataFrame:
    """Each category once: DETECTED if a pass says so and a finding backs it; NOT_ASSESSED if detected without backing, not
    assessed somewhere, in no pass at all, or the whole is incomplete; else NOT_DETECTED."""
    seen = passes.groupBy(category).agg(F.bool_or(F.col(status) == "DETECTED").alias("hit"), F.bool_or(F.col(status) == "NOT_ASSESSED").alias("gap"))
    out = categories.join(seen, category, "left").join(backed.select(category, F.lit(True).alias("backed")).distinct(), category, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    open_ = yes("hit") | yes("gap") | F.col("hit").isNull() | F.lit(not complete)
    return out.select(category, F.when(yes("hit") & yes("backed"), "DETECTED").when(open_, "NOT_ASSESSED").otherwise("NOT_DETECTED").alias("status"))


def score(severity: Column, confidence: Column, informational: Column) -> list[Column]:
    """A total of penalties as whole tenths, and whether a cap holds: aggregate columns ``penalty10`` and ``capped``.

    Weights of severities times those of confidences, in tenths, so that sums are exact."""
    weight = F.when(severity == "CRITICAL", 25).when(severity == "HIGH", 15).when(severity == "MEDIUM", 7).when(severity == "LOW", 3).otherwise(0)
    tenths = F.when(confidence == "high", 10).when(confidence == "medium", 7).when(confidence == "low", 4).otherwise(10)
    counts = ~F.coalesce(informational, F.lit(False))
    return [F.sum(F.when(counts, weight * tenths).otherwise(0)).alias("penalty10"), F.coalesce(F.bool_or(counts & (severity == "CRITICAL") & (confidence == "high")), F.lit(False)).alias("capped")]


def score_value(penalty10: Column, capped: Column) -> Column:
    """100 less the penalties, rounded half to even, 0 at least, 40 at most with a certain critical finding."""
    value = F.greatest(F.lit(0), 100 - F.bround(penalty10.cast("decimal(20,0)") / 10, 0).cast("int"))
    return F.when(capped, F.least(value, F.lit(40))).otherwise(value)


def score_band(value: Column) -> Column:
    return F.when(value >= 85, "LOW").when(value >= 60, "MODERATE").when(value >= 40, "HIGH").otherwise("CRITICAL")
