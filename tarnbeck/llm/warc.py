"""WARC archives as seekable Zstandard bundles.

Pages become WARC 1.1 records. Of equal payloads of ``LEAST`` bytes or more one is a response, the others are revisits of it: they
carry its id, the payload's digest and the HTTP head with the payload's length, but no payload. Which they are is settled on
digests alone; the few columns of the revisits are then joined to the pages.

A task writes the records it gets to archives of its own. Records are grouped into frames of about ``FRAME`` bytes, each an
independent Zstandard frame; behind the last stands a skippable frame with the seek table (sizes and checksums of all frames, as
in the public seekable format), so that any Zstandard reader still reads the whole. The index has a row for each record: its
id, archive, the frame's place and the record's offset in the frame, relative to its start. An archive counts only if the index,
written by Spark's own committer, names it: what a lost task had begun is never read.

Archives are opened by pyarrow's file systems, so the folder may be local, HDFS, S3 or GCS. Reading takes the frames
from the seek tables and deals them out, one frame in memory at a time; ``find_records`` reads only the frames of the ids asked for.

Defined results: a null text is an empty payload; pages without payload are responses; where ids repeat or are null, rows are told
apart by a number in the record's id, and of equal payloads with the same least id one is the response; control characters of
an address are percent-encoded, a null address is empty; an empty table gives an index without rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm.common import bounded_batches, new_folder, stored, table

#: Bytes of a frame before compression, of an archive, and of a payload from which equal ones are revisits.
FRAME, ARCHIVE, LEAST = 1 << 20, 256 << 20, 100
#: Frames that a task reads, about.
FRAMES_A_TASK = 32
#: Fixed values of the seekable format: the skippable frame's magic number, the seek table's, the flag for checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Fixed value of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "record_id string, archive string, frame_start long, frame_bytes long, offset long, length long"
RECORD = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def record(kind: str, name: str, date: str, uri: str, digest: str, payload: bytes | None, size: int, refers_to: str | None = None) -> bytes:
    """A response or revisit; a revisit's block ends behind the HTTP head."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if refers_to else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def about(date: str) -> bytes:
    """The record that an archive begins with."""
    block = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records_of(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields by lower-case name, block) of each record of a frame."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at)
        first, *lines = frame[at:end].decode().split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start, size = end + 4, int(fields["content-length"])
        if not first.startswith("WARC/1.") or frame[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"no whole record at {at}")
        yield at, fields, frame[start : start + size]
        at = start + size + 4


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The footer for frames of (compressed size, size, checksum)."""
    body = b"".join(struct.pack("<III", *x) for x in frames) + struct.pack("<IBI", len(frames), CHECKSUMS, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int, int, int]]:
    """(start, compressed size, size, checksum) of each frame, from the file's end."""
    file.seek(file.size() - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or flags != CHECKSUMS:
        raise ValueError("no seek table with checksums")
    file.seek(file.size() - 9 - 12 * count)
    out, start = [], 0
    for x in struct.iter_unpack("<III", file.read(12 * count)):
        out.append((start, *x))
        start += x[0]
    if start + 8 + 12 * count + 9 != file.size():
        raise ValueError("the seek table doesn't cover the file")
    return out


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match("[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


class Archive:
    """An archive being written."""

    def __init__(self, path: str, date: str, frame: int) -> None:
        where, name = file_system(path)
        where.create_dir(name.rpartition("/")[0], recursive=True)
        self.path, self.file, self.frame, self.written = path, where.open_output_stream(name, compression=None), frame, 0
        self.frames: list[tuple[int, int, int]] = []
        self.held, self.places = [about(date)], []
        self.size = len(self.held[0])

    def add(self, name: str, data: bytes) -> Iterator[tuple]:
        """Index rows of the frame that this record completes, if any."""
        if self.places and self.size + len(data) > self.frame:
            yield from self.flush()
        self.places.append((name, self.size, len(data)))
        self.held.append(data)
        self.size += len(data)

    def flush(self) -> Iterator[tuple]:
        data = b"".join(self.held)
        packed = zstandard.ZstdCompressor(level=3).compress(data)
        self.file.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        yield from ((name, self.path, self.written, len(packed), offset, length) for name, offset, length in self.places)
        self.written += len(packed)
        self.held, self.places, self.size = [], [], 0

    def close(self) -> Iterator[tuple]:
        if self.held:
            yield from self.flush()
        self.file.write(seek_table(self.frames))
        self.file.close()


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST, frame: int = FRAME, archive: int = ARCHIVE,
) -> DataFrame:
    """Archives in ``folder``, and their index (record_id, archive, frame_start, frame_bytes, offset, length), stored."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("payload"))
    odd = not rows.groupBy("id").count().filter("count > 1 OR id IS NULL").isEmpty()
    # a stored number tells rows apart where ids don't
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "pages") if odd else rows.withColumn("row", F.col("id"))
    name = F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.url_encode(F.col("id").cast("string")), F.lit("")), *([F.col("row").cast("string")] if odd else []))

    digest, size = F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size")
    digests = stored(rows.select("id", "row", name.alias("name"), digest, size).filter(F.col("size") >= least), "digests")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row", "name")
    first = stored(digests.groupBy("digest").agg(F.count("*").alias("n"), F.min(order).alias("first")).filter("n > 1").select("digest", "first"), "firsts")
    again = stored(digests.join(first, "digest").filter(F.col("row") != F.col("first.row")).select("row", F.col("first.name").alias("refers_to")), "revisits")
    placed = rows.join(again, "row", "left").select(name.alias("name"), "url", digest, size, F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "refers_to")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Archive | None = None
        found: list[tuple] = []
        made = lambda: pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in found], schema=schema)
        for b in batches:
            for own, url, sha, n, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = out or Archive(f"{folder}/{uuid.uuid4().hex}.warc.zst", date, frame)
                found += out.add(own, record("revisit" if refers_to else "response", own, date, url, sha, payload, n, refers_to))
                if out.written > archive:
                    found += out.close()
                    out = None
            yield made()
            found = []
        if out:
            found += out.close()
        yield made()

    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in INDEX.split(", "))])
    return stored(placed.mapInArrow(run, INDEX), "index")


def opened(path: str) -> pa.NativeFile:
    where, name = file_system(path)
    return where.open_input_file(name)


def frames_of(index: DataFrame) -> DataFrame:
    """(archive, frame_start, frame_bytes, checksum) of all frames, from the seek tables of the index's archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with opened(path) as f:
                    rows = [{"archive": path, "frame_start": start, "frame_bytes": packed, "checksum": check} for start, packed, _, check in read_seek_table(f)]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive", pa.string()), ("frame_start", pa.int64()), ("frame_bytes", pa.int64()), ("checksum", pa.int64())]))

    return index.select("archive").distinct().mapInArrow(run, "archive string, frame_start long, frame_bytes long, checksum long")


def parsed(fields: dict[str, str], block: bytes, payloads: bool) -> dict:
    """A record's row; its digest is taken of what was read, and a response whose digest is another is an error."""
    said = fields["warc-payload-digest"].partition(":")[2]
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1])
    whole = fields["warc-type"] == "response"
    if whole and (len(payload) != size or hashlib.sha256(payload).hexdigest() != said):
        raise ValueError(f"{fields['warc-record-id']}: the payload isn't what was written")
    of = lambda name: fields[name].strip("<>") if name in fields else None
    return {"record_id": of("warc-record-id"), "record_type": fields["warc-type"], "target_uri": fields["warc-target-uri"], "payload_digest": said, "payload_bytes": size, "refers_to": of("warc-refers-to"), "payload": payload if whole and payloads else None}


def _reader(choose: Callable[[dict, bytes], Iterator[tuple[dict[str, str], bytes]]], payloads: bool) -> Callable:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, path, file = zstandard.ZstdDecompressor(), None, None
        for b in batches:
            for row in b.to_pylist():
                if row["archive"] != path:
                    if file:
                        file.close()
                    path, file = row["archive"], opened(row["archive"])
                file.seek(row["frame_start"])
                frame = unpack.decompress(file.read(row["frame_bytes"]))
                yield pa.RecordBatch.from_pylist([parsed(f, x, payloads) for f, x in choose(row, frame)], schema=schema)

    return run


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the index's archives: record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to and, if
    asked for, payload (null for revisits)."""

    def choose(row: dict, frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        if xxhash.xxh64_intdigest(frame) & 0xFFFFFFFF != row["checksum"]:
            raise ValueError(f"{row['archive']}: a frame isn't what was written")
        return ((f, x) for _, f, x in records_of(frame) if f["warc-type"] != "warcinfo")

    frames = stored(frames_of(index), "frames")
    bounded_batches(index.sparkSession)
    return frames.repartition(1 + frames.count() // FRAMES_A_TASK, "archive", "frame_start").mapInArrow(_reader(choose, payloads), RECORD)


def find_records(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records named by ``ids`` (record_id), with their own payloads; only their frames are read, each once."""

    def choose(row: dict, frame: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        for place in row["places"]:
            _, fields, block = next(records_of(frame[place["offset"] : place["offset"] + place["length"]]))
            yield fields, block

    rows = index.join(ids.select("record_id").distinct(), "record_id")
    frames = rows.groupBy("archive", "frame_start", "frame_bytes").agg(F.collect_list(F.struct("offset", "length")).alias("places"))
    bounded_batches(index.sparkSession)
    return frames.mapInArrow(_reader(choose, True), RECORD)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    page = lambda c: F.nullif(F.split_part(c, F.lit(":"), F.lit(3)), F.lit("")).cast("long")
    read = read_archives(index, payloads=False)
    return read.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
r AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, row_number() OVER w > 1 AND strlen(h) >= 100 AS again, first_value(page_id) OVER w AS first_id
      FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM r"""
