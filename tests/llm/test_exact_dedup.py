import hashlib
import re
from collections import Counter

from tarnbeck.llm import exact_dedup as E
from tarnbeck.llm.queries import ORACLES, QUERIES
from tests.llm.data import awkward, empty
from tests.oracle import SF, check


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_query_equals_its_sql(spark):
    check(spark, QUERIES["op2_exact_dedup"], ORACLES["op2_exact_dedup"], SF)


def test_awkward_rows(spark):
    docs = awkward(spark, ["sametext ", "ab", "a b", "a  b"])
    rows = E.exact_groups(docs, hash_all=True).collect()
    groups = Counter(norm(r.text) for r in docs.collect())
    assert len(rows) == docs.count()
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(hashlib.sha256(k.encode()).hexdigest() for k in groups)
    for r in rows:
        assert groups[next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)] == r.group_size
    ab = {r.doc_id: (r.keep_id, r.kept) for r in rows if r.text_sha256 == hashlib.sha256(b"ab").hexdigest()}
    assert ab == {16: (18, False), 17: (18, False), 18: (18, True)}


def test_drop_duplicates_keeps_columns(spark):
    docs = awkward(spark)
    out = E.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(r.text) for r in docs.collect()})
    assert E.drop_duplicates(empty(spark)).count() == 0
    assert E.exact_groups(empty(spark)).count() == 0


def test_repeated_ids_and_clashing_names(spark):
    rows = [(5, "one text", 1), (1, "one text", 2), (9, "a", 3), (9, "b", 4), (9, "b", 5), (None, "b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int").withColumns({"gone": docs_col(), "row": docs_col()})
    out = E.drop_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "one text"), (9, "a"), (9, "b")]


def docs_col():
    from pyspark.sql import functions as F

    return F.lit("taken")


def test_a_tiny_bitmap_changes_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda bits: sorted(map(str, E.exact_groups(docs, hash_all=True, bitmap_bits=bits).collect()))
    assert key(1 << 10) == key(1 << 22) == key(None)


def test_same_prefix_and_length_is_no_copy(spark):
    a, b = "p" * 100 + "x", "p" * 100 + "y"
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in E.exact_groups(docs).collect()) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = E.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
