"""A corpus in five stages: each takes what the one before kept, and its decisions take effect.

All but the last return the columns that they were given, whatever their names; a row is kept whole or goes. Every stage gives
an empty table for an empty one. Rows of one id are rows of their own: each is judged by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm.common import stored, table
from tarnbeck.llm.exact_dedup import drop_duplicates
from tarnbeck.llm.packing import packed
from tarnbeck.llm.quality import keep_good
from tarnbeck.llm.simhash import keep_one
from tarnbeck.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: score 0.5 or more. Null and empty texts have the score of a text without
    features; without labels of both kinds nothing goes."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their language's perplexity band go, so those of under 20 words, null and empty
    ones too; a null language is judged as the empty one."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, blanks aside, one stays: the longest, then the least id, nulls last, then any. Null is equal to empty."""
    return drop_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one stays: the least id, nulls last, then any. A group hangs together by texts whose
    five-word shingles are alike by 0.8 or more; texts without words are alike."""
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences; a null or empty text is one piece, its end id."""
    import public_tokenizers

    rows = packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("packing", packing),
]

#: Toxicity, perplexity, fingerprints and token ids have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
