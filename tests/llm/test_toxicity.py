import zlib

import pytest
from pyspark.sql import functions as F

from tarnbeck.llm import toxicity as X
from tarnbeck.llm.queries import QUERIES
from tests.llm.data import awkward, empty

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if rows[r.doc_id].held_out]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.85


def test_features():
    lexicon = X.Lexicon({"idiot": 5.0, "^mora": 2.0})
    f = dict(zip(X.FEATURES, X.features("You IDIOT! 1d1ot moralist good", lexicon), strict=True))
    assert f["lexicon_any"] == 2 and f["hidden_any"] == 1 and f["lexicon_most"] == 5
    assert f["nearest"] == 0.5 and f["near_second"] == 3
    assert X.features("", lexicon) == [0.0] * len(X.FEATURES)
    assert len(X.features("a", lexicon)) == len(X.FEATURES)


def test_fit_rows_are_bounded_and_never_held_out(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic")).union(spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, toxic long"))
    rows = X.fit_rows(docs, labels, "doc_id", "text", "toxic", 50).collect()
    assert len(rows) == 50 and all(zlib.crc32(str(r.id).encode()) % 5 for r in rows)


@pytest.mark.parametrize("labels", ["none", "one kind"])
def test_without_labels_of_both_kinds(spark, labels):
    docs = awkward(spark)
    marks = spark.createDataFrame([] if labels == "none" else [(k, 1) for k in range(8)], "doc_id long, toxic int")
    rows, score = X.scorer(docs, marks).score(docs)
    assert [r[score] for r in rows.collect()] == [0.0] * docs.count()
    assert X.drop_toxic(empty(spark), marks).count() == 0


@pytest.mark.parametrize("held", ["no label", "one kind"])
def test_without_labels_to_calibrate_by_the_trees_share_stands(spark, held):
    docs = awkward(spark, [f"you are an idiot number {k}" if k % 2 else f"a calm day number {k}" for k in range(150)])
    marks = docs.filter("doc_id >= 15").select("doc_id", F.col("text").contains("idiot").cast("int").alias("toxic"))
    marks = marks.filter((X.fold(F.col("doc_id")) != 1) | (F.lit(held == "one kind") & (F.col("toxic") == 1)))
    fitted = X.scorer(docs, marks)
    rows, score = fitted.score(docs)
    got = {r.doc_id: r[score] for r in rows.collect()}
    assert fitted.steps == [(0.0, 0.0), (1.0, 1.0)] and got[16] > 0.5 > got[17] and all(0 <= x <= 1 for x in got.values())


def test_awkward_rows_get_scores_and_keep_their_columns(spark):
    docs = awkward(spark, [f"you are an idiot number {k}" if k % 2 else f"a calm day number {k}" for k in range(120)])
    marks = docs.filter("doc_id >= 15").select("doc_id", F.col("text").contains("idiot").cast("int").alias("toxic"))
    rows, score = X.scorer(docs, marks).score(docs)
    got = {r.doc_id: r[score] for r in rows.collect()}
    assert all(0 <= x <= 1 for x in got.values())
    assert got[16] > 0.5 > got[17]
    assert got[0] == got[1] == got[2]
    out = X.drop_toxic(docs, marks)
    assert out.columns == docs.columns and out.filter("text like '%idiot%'").count() == 0
