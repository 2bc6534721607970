"""File databases and paged listings as data sources."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from tarnbeck.sources.readers import PagedListing, SqliteFiles, register, write_sqlite_files
from tarnbeck.streaming.limits import run_to_end


def database(path, rows, mode="CREATE TABLE t (k INTEGER, name TEXT, x REAL, b BLOB)"):
    with sqlite3.connect(path) as c:
        if mode:
            c.execute(mode)
        c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    c.close()


def listing(top, source, items, size=3):
    for k in range(max(1, -(-len(items) // size))):
        at = top / f"source={source}" / f"page={k + 1}"
        at.mkdir(parents=True, exist_ok=True)
        (at / "part.json").write_text(json.dumps({"total_count": len(items), "items": items[k * size : (k + 1) * size]}))


def options(reader, **more):
    for k, v in more.items():
        reader = reader.option(k, v)
    return reader


@pytest.fixture
def files(spark, tmp_path):
    register(spark)
    rows = [(k, None if k % 5 == 0 else f"n{k % 3}", k / 2, b"x") for k in range(-7, 40)]
    database(tmp_path / "a.db", rows[:20])
    database(tmp_path / "b.db", [*rows[20:], (None, "none", None, None)])
    return str(tmp_path), [*rows, (None, "none", None, None)]


def test_all_rows_by_ranges_of_all_files(spark, files):
    path, rows = files
    df = options(spark.read.format("sqlite_files"), path=path, table="t", key="k", parts=3).load()
    assert df.dtypes == [("k", "bigint"), ("name", "string"), ("x", "double"), ("b", "binary")]
    assert df.rdd.getNumPartitions() == 7  # three ranges of each file, and the rows without a key
    assert sorted(((r.k, r.name, r.x, r.b and bytes(r.b)) for r in df.collect()), key=str) == sorted(rows, key=str)


def test_filters_reach_the_statement(spark, files):
    path, rows = files
    df = options(spark.read.format("sqlite_files"), path=path, table="t", key="k", parts=3).load()
    conditions = {
        "k = 5": lambda k, n, x: k == 5, "k > 5 AND k <= 30": lambda k, n, x: k is not None and 5 < k <= 30, "name = 'n1' AND x >= 3.5": lambda k, n, x: n == "n1" and x >= 3.5, "name IN ('n0', 'n2')": lambda k, n, x: n in ("n0", "n2"),
        "name IS NULL": lambda k, n, x: n is None, "k IS NULL": lambda k, n, x: k is None, "name LIKE 'n%' AND k % 2 = 0": lambda k, n, x: n and n.startswith("n") and k is not None and k % 2 == 0, "k = 5 AND k = 6": lambda k, n, x: False,
    }
    for condition, holds in conditions.items():
        assert sorted(str(r.k) for r in df.filter(condition).collect()) == sorted(str(k) for k, n, x, _ in rows if holds(k, n, x)), condition
    source = SqliteFiles({"path": path, "table": "t", "key": "k", "parts": "3"})
    reader = source.reader(source.schema())
    assert list(reader.pushFilters([GreaterThan(("k",), 30), LessThanOrEqual(("k",), 33), In(("name",), ("n1", "n2")), EqualTo(("b",), b"x")])) == [EqualTo(("b",), b"x")]
    parts = reader.partitions()
    assert {p.file[-4:] for p in parts} == {"b.db"} and (min(p.low for p in parts), max(p.high for p in parts)) == (31, 34)
    assert sorted(r[0] for p in parts for r in reader.read(p)) == [k for k, n, _, _ in rows if k is not None and 30 < k <= 33 and n in ("n1", "n2")]


def test_a_database_that_is_not_there_is_an_error(spark, files, tmp_path):
    for path, table in ((str(tmp_path / "none"), "t"), (files[0], "other")):
        with pytest.raises(Exception, match="no table|unable to open|no database"):
            options(spark.read.format("sqlite_files"), path=path, table=table, key="k").load().collect()


def test_a_stream_of_keys_resumes(spark, tmp_path):
    register(spark)
    (tmp_path / "in").mkdir()
    for n, (start, end) in enumerate(((0, 5), (5, 5), (5, 12))):
        database(tmp_path / "in/a.db", [(k, "n", 0.0, None) for k in range(start, end)], None if n else "CREATE TABLE t (k INTEGER, name TEXT, x REAL, b BLOB)")
        if n == 2:
            database(tmp_path / "in/b.db", [(100, "new", 0.0, None)])
        stream = options(spark.readStream.format("sqlite_files"), path=str(tmp_path / "in"), table="t", key="k").load()
        out = run_to_end(stream, f"{tmp_path}/out")
        assert sorted(r.k for r in out.collect()) == [*range(end), *([100] if n == 2 else [])]


def test_written_files_come_back(spark, tmp_path):
    register(spark)
    df = spark.range(100).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("name"), (F.col("id") / 3).alias("x"))
    made = write_sqlite_files(df.repartition(4), f"file://{tmp_path}/db", "t").collect()
    assert sum(r.n for r in made) == 100
    assert options(spark.read.format("sqlite_files"), path=f"file://{tmp_path}/db", table="t", key="k").load().filter("k > 1000").count() == 0
    back = options(spark.read.format("sqlite_files"), path=f"file://{tmp_path}/db", table="t", key="k").load()
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()), key=lambda r: r[0])
    assert write_sqlite_files(df.limit(0), f"{tmp_path}/none", "t").collect() == []


def test_pages_in_runs_of_a_source(spark, tmp_path):
    register(spark)
    items = {"a": [{"id": k, "name": f"é{k}"} for k in range(10)], "b": [], "c": [{"id": 99}] * 3}
    for s, own in items.items():
        listing(tmp_path, s, own)
    df = options(spark.read.format("paged_listing"), path=str(tmp_path), page_size=3, pages=2).load()
    assert df.rdd.getNumPartitions() == 3
    rows = sorted(df.collect(), key=lambda r: (r.source, r.page, r.place))
    assert [(r.source, json.loads(r.item)) for r in rows] == [(s, x) for s, own in items.items() for x in own]
    assert df.filter("source = 'a' AND page > 2").count() == 4 and df.filter("source IN ('b', 'none')").count() == 0
    reader = PagedListing({"path": str(tmp_path), "page_size": "3", "pages": "2"}).reader(None)
    assert list(reader.pushFilters([EqualTo(("source",), "a"), GreaterThan(("page",), 2)])) == [GreaterThan(("page",), 2)]
    assert {p.source for p in reader.partitions()} == {"a"}


def test_a_bad_page_is_an_error(spark, tmp_path):
    register(spark)
    listing(tmp_path, "a", [1, 2])
    (tmp_path / "source=a/page=1/part.json").write_text('{"items": 1}')
    with pytest.raises(Exception, match="is no page"):
        options(spark.read.format("paged_listing"), path=str(tmp_path)).load().collect()


def test_a_stream_of_pages_resumes_within_a_short_page(spark, tmp_path):
    register(spark)
    for n in (2, 2, 7, 8):
        listing(tmp_path / "in", "a", list(range(n)))
        stream = options(spark.readStream.format("paged_listing"), path=str(tmp_path / "in"), page_size=3).load()
        assert sorted(int(r.item) for r in run_to_end(stream, f"{tmp_path}/out").collect()) == list(range(n))
