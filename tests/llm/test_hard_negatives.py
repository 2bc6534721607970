import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnbeck.llm.hard_negatives import OP13_SQL, best, hard_negatives, op13_hard_negatives, packed_tile, product, unpacked_tile, whole_numbers
from tests.oracle import SF, check

SCHEMA = "id long, label long, vec array<bigint>, score double, rank string, windows string, block string"


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "r", "w", "b") for r in rows], SCHEMA)


def plain(rows, anchors, positives=5, negatives=5, percent=80):
    """Every pair, one after the other."""
    once = {}
    for k, label, v in sorted((r for r in rows if None not in r and None not in r[2]), key=lambda r: (r[0], r[1], r[2])):
        once.setdefault(k, (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in (k for k in once if anchors(k)):
        label, own = once[a]
        scored = sorted((-dot(own, v), k) for k, (_, v) in once.items() if k != a)
        for s, p in [x for x in scored if once[x[1]][0] == label][:positives]:
            hard = [x for x in scored if once[x[1]][0] != label and percent * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, p, rank, k, -s, -t) for rank, (t, k) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_equals_its_sql(spark):
    check(spark, op13_hard_negatives, OP13_SQL, SF)


def test_many_blocks_and_chunks_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(k, int(rng.choice([1, 1, 1, 2, 65, 3])), rng.integers(-3, 9, 70).tolist()) for k in range(300)]
    rows += [(1000 + k, 1, rows[0][2]) for k in range(40)]  # ties
    want = plain(rows, lambda k: k % 3 == 0)
    assert want == got(hard_negatives(rows_of(spark, rows), F.col("id") % 3 == 0, chunk=7, anchor_rows=16, block_rows=20))
    assert want == got(hard_negatives(rows_of(spark, rows), F.col("id") % 3 == 0))


def test_awkward_rows(spark):
    rows = [(0, 1, [3, 1]), (None, 1, [9, 9]), (2, None, [9, 9]), (3, 1, None), (4, 1, [None, 9]), (5, 1, [2]), (6, 1, []), (7, 2, [2, 2]), (7, 2, [2, 2]), (7, 3, [9, 9]),
            (-1, 2, [2, 0]), (10, 4, [-1, -1]), (20, 4, [1, 1]), (30, 4, [1, 1]), (40, 9, [1, 2])]
    anchors = lambda k: k % 10 == 0
    want = plain(rows, anchors)
    assert want and want == got(hard_negatives(rows_of(spark, rows), F.col("id") % 10 == 0))
    assert plain(rows, anchors, 1, 2, 50) == got(hard_negatives(rows_of(spark, rows), F.col("id") % 10 == 0, positives=1, negatives=2, percent=50))
    empty = hard_negatives(rows_of(spark, []), F.col("id") % 10 == 0)
    assert empty.collect() == [] and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got(hard_negatives(rows_of(spark, [(0, 1, [1])]), F.lit(None).cast("boolean"))) == []


def test_components_that_are_not_finite(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [0.5, -0.001], 1), (2, [nan, 1.0], 1), (3, [inf, 1.0], 1), (4, [-inf], 1), (5, None, 1), (6, [None, 1.0], 1), (7, [1.0], None), (8, [], 1)], "vec_id long, embedding array<float>, label int")
    assert {r.id: r.vec for r in whole_numbers(df).collect()} == {1: [128, -1], 8: []}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=40))
def test_tiles_come_back(values):
    x = np.array(values, np.int64)
    assert (unpacked_tile(packed_tile(x), len(x)) == x).all()


@pytest.mark.parametrize("most", [3, 1 << 26, 1 << 30])
def test_products_are_exact(most):
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-most, most, (n, 6)) for n in (5, 9))
    want = [[sum(int(p) * int(q) for p, q in zip(x, y, strict=True)) for y in b] for x in a]
    assert product(a, b).tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=30), st.integers(1, 6))
def test_best_places(scores, count):
    ids = np.random.default_rng(len(scores)).permutation(len(scores))
    want = sorted(range(len(scores)), key=lambda k: (-scores[k], ids[k]))[:count]
    assert best(np.array(scores, np.int64), ids, count).tolist() == want
