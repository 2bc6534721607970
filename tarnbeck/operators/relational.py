"""Lookups, predicates, star joins, pages and counts of tenant-scoped tables. All are narrow DataFrame expressions: filters
and column choices reach the scan, and whether a dimension is broadcast is left to its size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def star(fact: DataFrame, inner: Sequence[tuple[DataFrame, str | list[str]]] = (), left: Sequence[tuple[DataFrame, str | list[str]]] = ()) -> DataFrame:
    """``fact`` joined to each dimension on its keys: first the inner ones, which may drop rows, then the left ones."""
    for dim, on in inner:
        fact = fact.join(dim, on)
    for dim, on in left:
        fact = fact.join(dim, on, "left")
    return fact


def page(df: DataFrame, order: Sequence[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit of a total order; the order's last column must make it total."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset at least 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def scoped(df: DataFrame, tenant_col: str, tenant) -> DataFrame:
    """Only the tenant's rows. Every read of tenant data goes through here."""
    return df.filter(F.col(tenant_col) == F.lit(tenant))


def lookup(df: DataFrame, key_col: str, key) -> DataFrame:
    """The row with this key, or none."""
    return df.filter(F.col(key_col) == F.lit(key)).limit(1)


def live(df: DataFrame, deleted_col: str) -> DataFrame:
    return df.filter(F.col(deleted_col).isNull())


def older(df: DataFrame, ts_col: str, cutoff: Column) -> DataFrame:
    """Rows strictly older than the cutoff."""
    return df.filter(F.col(ts_col) < cutoff)


def optional(df: DataFrame, values: dict[str, object], allowed: dict[str, set] | None = None) -> DataFrame:
    """One equality for each value that is given; a value outside its column's allowed set is an error."""
    for c, v in values.items():
        if v is None:
            continue
        if allowed and c in allowed and v not in allowed[c]:
            raise ValueError(f"{v!r} is not allowed for {c}")
        df = df.filter(F.col(c) == F.lit(v))
    return df


def unless_trial_history(plan: Column, created: Column, cutoff: Column, trial: str = "trial") -> Column:
    """Everything but trial rows older than the cutoff; a row without a plan stays."""
    return ~((F.coalesce(plan, F.lit("")) == trial) & F.coalesce(created < cutoff, F.lit(False)))


def eligible(status: Column, gate: Column, now: Column, queued: str = "queued") -> Column:
    """Queued, and the gate is open: null or not after now."""
    return (status == queued) & (gate.isNull() | (gate <= now))


def lease_expired(expires: Column, now: Column) -> Column:
    return expires.isNotNull() & (expires < now)


def valid_until(used: Column, expires: Column, now: Column) -> Column:
    """A token or session that is neither used up nor expired; one that expires now is expired."""
    return used.isNull() & (expires > now)


def roles(requests: DataFrame, members: DataFrame, on: list[str], role_col: str, allowed: Sequence[str]) -> DataFrame:
    """Each request with its role (null for a non-member, as for a tenant that does not exist) and whether it may pass."""
    out = requests.join(members.select(*on, role_col), on, "left")
    return out.withColumn("permitted", F.coalesce(F.col(role_col).isin(*allowed), F.lit(False)))


def stale(last: Column, now: Column, seconds: int) -> Column:
    """Whether a last-used time is missing or older than the resolution."""
    return last.isNull() | (last < now - F.make_dt_interval(secs=F.lit(seconds)))


def pending(found: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """What was found and not applied yet."""
    return found.join(applied.select(key).distinct(), key, "left_anti")


def capped(df: DataFrame, key: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` distinct keys of an order, and whether there were more: one row beyond the cap tells."""
    rows = df.dropDuplicates([key]).orderBy(*order).limit(limit + 1)
    return rows.withColumn("truncated", F.count("*").over(_all()) > limit).orderBy(*order).limit(limit)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n): the rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    refs = child.filter(F.col(child_key).isNotNull())
    return refs.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def existing(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), on, "left_semi")


def trial_status(granted: Column, active: Column, disposable: Column, verified: Column) -> Column:
    """The first that applies: an existing grant, a disposable domain, an unverified address; else available."""
    return (
        F.when(granted & active, "active").when(granted, "used").when(disposable, "not_eligible")
        .when(~F.coalesce(verified, F.lit(False)), "verification_required").otherwise("available")
    )


def missing_names(names: DataFrame, there: DataFrame, col: str) -> DataFrame:
    """One row: the sorted names that are not there, null when none is missing."""
    lost = names.join(there.select(col), col, "left_anti").agg(F.sort_array(F.collect_list(col)).alias("missing"))
    return lost.select(F.when(F.size("missing") > 0, F.col("missing")).alias("missing"))
