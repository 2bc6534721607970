"""Comparison of two versions of a keyed table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_status(before: DataFrame, after: DataFrame, keys: Sequence[str], compare: Sequence[str] = ()) -> DataFrame:
    """keys, status (added, removed, modified, matched) and changed, the names of the compared columns that differ; null
    equals null. The two columns of a compared name are before_name and after_name."""
    a = before.select(*keys, *[F.col(c).alias(f"before_{c}") for c in compare], F.lit(True).alias("_a"))
    b = after.select(*keys, *[F.col(c).alias(f"after_{c}") for c in compare], F.lit(True).alias("_b"))
    out = a.join(b, list(keys), "full")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    names = [F.when(~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")), F.lit(c)) for c in compare]
    changed = F.when(both, F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("changed", changed)
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size("changed") > 0, "modified").otherwise("matched")
    return out.withColumn("status", status).drop("_a", "_b")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def matched_findings(before: DataFrame, after: DataFrame, key: str, second: str, compare: Sequence[str]) -> DataFrame:
    """(key, after_key, status, matched_by, changed): first by key, then what is left by the second key, but only where
    that names one row on each side; what is still left is resolved or new."""
    names = F.array_compact(F.array(*[F.when(~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")), F.lit(c)) for c in compare]))
    side = lambda df, name: df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in compare])
    pair = side(before, "before").join(side(after, "after"), key).withColumn("changed", names)
    paired = pair.select(key, F.col(key).alias("after_key"), F.when(F.size("changed") > 0, "modified").otherwise("matched").alias("status"), F.lit("key").alias("matched_by"), "changed")
    # what has no row of its key on the other side; only its key and what is compared goes on
    kept = list(dict.fromkeys([key, second, *compare]))
    lost, new = before.select(kept).join(after.select(key), key, "left_anti"), after.select(kept).join(before.select(key), key, "left_anti")

    def single(df: DataFrame) -> DataFrame:
        """Rows that alone have their second key: keys are counted on the map side, so no key's rows are held together."""
        once = df.filter(F.col(second).isNotNull()).groupBy(second).agg(F.count("*").alias("_n")).filter("_n = 1")
        return df.join(once.select(second), second, "left_semi")

    a = single(lost).select(F.col(second).alias("_s"), F.col(key).alias("before_key"), *[F.col(c).alias(f"before_{c}") for c in compare])
    b = single(new).select(F.col(second).alias("_s"), F.col(key).alias("after_key"), *[F.col(c).alias(f"after_{c}") for c in compare])
    again = a.join(b, "_s").select(F.col("before_key").alias(key), "after_key", F.lit("modified").alias("status"), F.lit("secondary").alias("matched_by"), names.alias("changed"))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    gone = lost.join(again.select(key), key, "left_anti").select(key, F.lit(None).cast(before.schema[key].dataType).alias("after_key"), F.lit("resolved").alias("status"), none.alias("matched_by"), empty.alias("changed"))
    come = new.join(again.select(F.col("after_key").alias(key)), key, "left_anti").select(F.lit(None).cast(before.schema[key].dataType).alias(key), F.col(key).alias("after_key"), F.lit("new").alias("status"), none.alias("matched_by"), empty.alias("changed"))
    return paired.unionByName(again).unionByName(gone).unionByName(come)


def layout_change(before: DataFrame, after: DataFrame, owner: str, order: Sequence[str], fields: Sequence[str], skip: Column | None = None) -> DataFrame:
    """Of each owner: unchanged, safe_append or collision_risk, and the first position that differs. Slots that ``skip``
    marks take no place; fewer slots than before are a risk."""

    def slots(df: DataFrame, side: str) -> DataFrame:
        own = df.filter(~skip) if skip is not None else df
        place = F.row_number().over(Window.partitionBy(owner).orderBy(*order)) - 1
        return own.select(owner, place.alias("position"), F.struct(*fields).alias(side))

    both = slots(before, "a").join(slots(after, "b"), [owner, "position"], "full")
    out = both.groupBy(owner).agg(F.min(F.when(F.col("a").isNotNull() & ~F.col("a").eqNullSafe(F.col("b")), F.col("position"))).alias("first_divergence"), F.bool_or(F.col("a").isNull()).alias("grown"))
    status = F.when(F.col("first_divergence").isNotNull(), "collision_risk").when(F.col("grown"), "safe_append").otherwise("unchanged")
    return out.select(owner, status.alias("status"), "first_divergence")


def gap_change(before: DataFrame, after: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Of each gap: unchanged, shrunk, removed, expanded or added, with both sizes."""
    out = before.select(*keys, F.col(size).alias("size_before")).join(after.select(*keys, F.col(size).alias("size_after")), list(keys), "full")
    a, b = F.col("size_before"), F.col("size_after")
    return out.withColumn("status", F.when(a.isNull(), "added").when(b.isNull(), "removed").when(b < a, "shrunk").when(b > a, "expanded").otherwise("unchanged"))


def gap_overall(gaps: DataFrame, owner: str) -> DataFrame:
    """The worst of an owner's gaps: removed, shrunk, expanded (added counts as such), unchanged."""
    worst = F.max(F.when(F.col("status") == "removed", 4).when(F.col("status") == "shrunk", 3).when(F.col("status").isin("expanded", "added"), 2).otherwise(1))
    return gaps.groupBy(owner).agg(worst.alias("w")).select(owner, F.element_at(F.array(*map(F.lit, ["unchanged", "expanded", "shrunk", "removed"])), F.col("w")).alias("overall"))


def change_impact(changes: DataFrame, owner: str, rules: dict[str, Column]) -> DataFrame:
    """Of each owner, the reasons whose rule one of its changes meets, sorted; REVIEW_RECOMMENDED with any, SAFE with changes
    and none, NO_CHANGE without changes."""
    reasons = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    real = F.col("status") != "matched"
    out = changes.groupBy(owner).agg(F.bool_or(real).alias("any"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(real, reasons))))).alias("reasons"))
    verdict = F.when(F.size("reasons") > 0, "REVIEW_RECOMMENDED").when(F.col("any"), "SAFE").otherwise("NO_CHANGE")
    return out.select(owner, verdict.alias("verdict"), "reasons")


def drift(snapshots: DataFrame, identity: Sequence[str], order: Sequence[Column], flags: Sequence[str], code: str) -> DataFrame:
    """Each snapshot against the one before it: the flags that changed (null on a side is never guessed), and whether the
    code is the same."""
    w = Window.partitionBy(*identity).orderBy(*order)
    last = lambda c: F.lag(c).over(w)
    out = snapshots.withColumn("_first", F.row_number().over(w) == 1).withColumns({f"_last_{c}": last(c) for c in [*flags, code]})
    names = F.array_compact(F.array(*[F.when(F.col(f"_last_{c}") != F.col(c), F.lit(c)) for c in flags]))
    same = F.when(F.col(f"_last_{code}").isNull() | F.col(code).isNull(), "UNAVAILABLE").when(F.col(f"_last_{code}") == F.col(code), "MATCH").otherwise("MISMATCH")
    return out.filter(~F.col("_first")).withColumn("changed", names).withColumn("code_status", same).drop("_first", *[f"_last_{c}" for c in [*flags, code]])


def unioned(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
