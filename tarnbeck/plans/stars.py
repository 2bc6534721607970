"""Star joins and pages on orders, customer, nation and region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.operators.relational import page, scoped, star
from tarnbeck.sources.tables import table


def job_summaries_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    customers = scoped(t("customer"), "c_mktsegment", "BUILDING").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nations = t("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    jobs = star(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"), [(customers, "o_custkey")], [(nations, "n_nationkey"), (t("region"), "r_regionkey")])
    rows = page(jobs, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], limit=20, offset=40)
    return rows.select("o_orderkey", "o_orderstatus", "o_orderdate", "c_name", "n_name", "r_name")


QUERIES = {"C3_E4_job_summaries": job_summaries_query}
ORACLES = {
    "C3_E4_job_summaries": """
SELECT o_orderkey, o_orderstatus, o_orderdate, c_name, n_name, r_name
FROM orders JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40""",
}
