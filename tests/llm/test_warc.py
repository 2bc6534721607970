import hashlib
import io

import pytest
import zstandard
from pyarrow import fs

from tarnbeck.llm.common import new_folder
from tarnbeck.llm.warc import OP11_SQL, find_records, frames_of, op11_warc, opened, read_archives, read_seek_table, records_of, write_archives
from tests.oracle import SF, check

SCHEMA = "page_id long, url string, html string, row long, name string, payload string, archive string, record_id string"
BIG, SMALL = "<p>ünï</p>" * 40, "<p>small</p>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 7, "n", "p", "a", "r") for r in rows], SCHEMA)


def read(index):
    return {r.record_id: r for r in read_archives(index).collect()}


def test_query_equals_its_sql(spark):
    check(spark, op11_warc, OP11_SQL, SF)


def test_pages_come_back_frame_by_frame(spark):
    rows = [(k, f"http://e/{k}", [BIG, SMALL, None, "", f"{k} " * 300, "\r\n\r\nWARC/1.1\r\n" * 20, "x" * 99, "y" * 100][k % 8]) for k in range(80)]
    rows.append((200, None, "é" * 300_000))
    index = write_archives(pages(spark, rows).repartition(3), new_folder(spark, "warc"), frame=4000, archive=300)
    found = read(index)
    first = {}
    for k, url, html in rows:
        payload = (html or "").encode()
        r = found[f"urn:page:{k}"]
        again = len(payload) >= 100 and payload in first
        assert (r.payload_bytes, r.payload_digest, r.target_uri) == (len(payload), hashlib.sha256(payload).hexdigest(), url or "")
        assert (r.record_type, r.refers_to) == (("revisit", f"urn:page:{first[payload]}") if again else ("response", None))
        assert r.payload is None if again else bytes(r.payload) == payload
        first.setdefault(payload, k)
    assert len(found) == len(rows)
    assert index.select("archive").distinct().count() > 3 and index.select("archive", "frame_start").distinct().count() > 10


def test_any_zstandard_reader_reads_an_archive(spark):
    index = write_archives(pages(spark, [(k, "u v\n", f"{k} " * 400) for k in range(30)]), new_folder(spark, "warc"), frame=5000)
    for (path,) in index.select("archive").distinct().collect():
        with opened(path) as f:
            data, table = f.readall(), read_seek_table(f)
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        kinds = [fields["warc-type"] for _, fields, _ in records_of(whole)]
        assert kinds.count("warcinfo") == 1 and kinds[0] == "warcinfo"
        assert sum(x[2] for x in table) == len(whole)
        for r in index.filter(index.archive == path).collect():
            start, packed, *_ = next(x for x in table if x[0] == r.frame_start)
            own = zstandard.ZstdDecompressor().decompress(data[start : start + packed])[r.offset : r.offset + r.length]
            assert [f["warc-record-id"] for _, f, _ in records_of(own)] == [f"<{r.record_id}>"]
            assert b"WARC-Target-URI: u%20v%0A\r\n" in own


def test_records_are_found_by_their_ids(spark):
    index = write_archives(pages(spark, [(k, "u", f"{k} " * 400) for k in range(40)]), new_folder(spark, "warc"), frame=5000)
    ids = spark.createDataFrame([("urn:page:3",), ("urn:page:38",), ("urn:page:38",), ("urn:page:99",)], "record_id string")
    assert {r.record_id: bytes(r.payload).decode() for r in find_records(index, ids).collect()} == {f"urn:page:{k}": f"{k} " * 400 for k in (3, 38)}


def test_repeated_and_null_ids(spark):
    rows = [(5, "a", BIG), (5, "b", BIG), (None, "c", BIG), (9, "d", BIG), (None, "e", SMALL), (9, "f", SMALL)]
    found = read_archives(write_archives(pages(spark, rows), new_folder(spark, "warc"))).collect()
    assert len({r.record_id for r in found}) == 6
    big = [r for r in found if r.payload_bytes == len(BIG.encode())]
    (kept,) = [r for r in big if r.record_type == "response"]
    assert kept.record_id.startswith("urn:page:5:") and {r.refers_to for r in big} == {None, kept.record_id}
    assert all(r.record_type == "response" for r in found if r not in big)


def test_an_empty_table(spark):
    index = write_archives(pages(spark, []), new_folder(spark, "warc"))
    assert index.count() == 0 and read_archives(index).collect() == [] and frames_of(index).collect() == []


def test_a_changed_archive_is_refused(spark, tmp_path):
    index = write_archives(pages(spark, [(1, "u", BIG)]), f"file://{tmp_path}")
    path = index.first().archive
    with opened(path) as f:
        data = bytearray(f.readall())
    where, name = fs.FileSystem.from_uri(path)
    for at in (len(data) - 1, len(data) - 12):
        bad = bytearray(data)
        bad[at] ^= 1
        with where.open_output_stream(name, compression=None) as f:
            f.write(bytes(bad))
        with pytest.raises(Exception, match="seek table|frame isn't"):
            read_archives(index).collect()
