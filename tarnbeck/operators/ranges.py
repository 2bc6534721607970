"""Range matching: containment of a point in the smallest interval, version ranges, names of a small dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.functions.scalars import version_parts


def enclosing(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, point_id: str, span_id: str, bucket: int) -> DataFrame:
    """Each point with the id of the narrowest span of its key that holds it (start <= at <= end), ties by start and id,
    null without one.

    Spans are cut into buckets of ``bucket`` units and met on (key, bucket), so that a hot key's spans are not all paired
    with all its points; a span costs one row for each bucket that it touches."""
    cut = lambda c: F.floor(F.col(c) / bucket)
    s = spans.filter(F.col(start) <= F.col(end)).withColumn("_b", F.explode(F.sequence(cut(start), cut(end))))
    p = points.withColumn("_b", cut(at))
    hits = p.join(s.select(*keys, "_b", span_id, start, end), [*keys, "_b"]).filter(F.col(at).between(F.col(start), F.col(end)))
    best = hits.groupBy(point_id).agg(F.min(F.struct((F.col(end) - F.col(start)).alias("w"), F.col(start).alias("s"), F.col(span_id).alias("id"))).alias("m"))
    return points.join(best.select(point_id, F.col("m.id").alias(span_id)), point_id, "left")


def unique_name(names: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Keys that name exactly one id."""
    return names.groupBy(*keys).agg(F.countDistinct(id_col).alias("_n"), F.min(id_col).alias(id_col)).filter("_n = 1").drop("_n")


def resolved_names(refs: DataFrame, targets: DataFrame, name: str, file: str, group: str, id_col: str) -> DataFrame:
    """Each reference with the target that its name means: the only one of all, else of its file, else of its group."""
    out = refs
    for k, keys in enumerate(([name], [name, file], [name, group])):
        out = out.join(unique_name(targets, keys, id_col).withColumnRenamed(id_col, f"_t{k}"), keys, "left")
    return out.withColumn(id_col, F.coalesce("_t0", "_t1", "_t2")).drop("_t0", "_t1", "_t2")


def affected_versions(own: DataFrame, bugs: DataFrame, version: str) -> DataFrame:
    """Rows whose three-part version lies in [introduced, fixed) of a bug; unparseable versions and entries match none."""
    b = bugs.select("name", version_parts(F.col("introduced")).alias("_a"), version_parts(F.col("fixed")).alias("_z")).dropna()
    v = own.withColumn("_v", version_parts(F.col(version))).filter("_v is not null")
    # the major number is an equi key: a bug is one row for each that it touches, so rows are hashed instead of all paired
    b = b.withColumn("_major", F.explode(F.sequence(F.col("_a")[0], F.greatest(F.col("_a")[0], F.col("_z")[0]))))
    return v.withColumn("_major", F.col("_v")[0]).join(b, "_major").filter((F.col("_a") <= F.col("_v")) & (F.col("_v") < F.col("_z"))).drop("_v", "_a", "_z", "_major")


def resolved_chain(own: DataFrame, chains: DataFrame, chain: str, declared: str) -> DataFrame:
    """chain_id from a number or a name in any case (an unknown number stands, an unknown name is null), and whether the
    declared name means the same chain (null if it can't be told)."""
    names = chains.select(F.lower("alias").alias("_alias"), F.col("chain_id").alias("_id"))
    out = own.withColumn("_k", F.lower(chain)).join(names.withColumnRenamed("_alias", "_k"), "_k", "left")
    out = out.withColumn("chain_id", F.coalesce(F.col(chain).try_cast("int"), F.col("_id"))).drop("_k", "_id")
    known = chains.select(F.col("chain_id"), F.lit(True).alias("_known")).distinct()
    out = out.withColumn("_k", F.lower(declared)).join(names.withColumnRenamed("_alias", "_k"), "_k", "left").join(known, "chain_id", "left")
    return out.withColumn("consistent", F.when(F.col("_known"), F.col("_id") == F.col("chain_id"))).drop("_k", "_id", "_known")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
