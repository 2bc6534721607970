import re

import corpus_pipeline as C
from tarnbeck.llm import toxicity as X
from tests.llm.data import SCHEMA, awkward, empty
from tests.llm.test_quality import plain_counts
from tests.llm.test_simhash import near_roots

SF = "/root/testdata/sf0.001"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES:
        before = docs.orderBy("doc_id").collect()
        docs = C.stored(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if name != "packing":
            assert docs.columns == columns and len(ids) == len(after)
            assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}
        if name == "toxicity":
            scores, s = X.scorer(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).score(spark.read.parquet(f"{SF}/documents.parquet"))
            assert ids == {r.doc_id for r in scores.collect() if r[s] < 0.5}
        elif name == "quality_rules":
            for r in before:
                n, _, _, _, repeated = plain_counts(r.text)
                assert not ((n < 20 or 100 * repeated > 30 * n) and r.doc_id in ids)
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best.setdefault(norm(r.text), []).append((-len(r.text), r.doc_id))
            assert ids == {min(v)[1] for v in best.values()}
        elif name == "simhash_near_dedup":
            roots = near_roots([r.text for r in before])
            assert ids == {before[k].doc_id for k in set(roots)}
        else:
            assert ids == {r.doc_id for r in before}


def test_run_and_names(spark):
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality_rules", "exact_dedup", "simhash_near_dedup", "packing"]
    assert C.run(spark, SF).count() > 0


def test_awkward_documents(spark, tmp_path):
    rows = [(1, None, None, "s", None), (2, "", "en", None, 0), (2, "", "en", None, 0), (None, "words of a null id " * 8, "en", "s", 1), (3, "long " * 40000, "en", "s", 1), (4, "a fine day by the sea with my old friend and a very large dog that barks at all the boats", "en", "s", 1)]
    rows.append((5, rows[-1][1], "en", "s", 1))
    spark.createDataFrame(rows, ", ".join(SCHEMA.split(", ")[:5])).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 0), (5, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in C.run(spark, str(tmp_path)).collect()}
    assert 4 in got and 5 not in got and 3 not in got
    assert C.STAGES[2][1](spark, empty(spark), SF).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Extra columns whose names the operators use themselves come through, row by row; empty tables stay empty."""
    texts = [f"a calm day by the {w} with my old friend number {k} and a very large dog that barks at all the boats in the bay" for k, w in enumerate(["sea", "lake", "river", "pond"])]
    docs = awkward(spark, [*texts, texts[0], texts[1] + " again"]).selectExpr("*", "'g' AS gone", "1 AS node", "doc_id AS keep_id", "'d' AS digest", "2.5 AS near0", "text AS t")
    none = docs.filter("false")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows, before = out.collect(), {str(r) for r in docs.collect()}
        assert {str(r) for r in rows} <= before and len(rows) <= docs.count()
        left = stage(spark, none, SF)
        assert left.columns == docs.columns and left.count() == 0, name
    assert C.STAGES[-1][1](spark, none, SF).count() == 0 and C.STAGES[-1][1](spark, docs, SF).count() >= docs.count()
