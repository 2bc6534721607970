"""File databases and paged listings as Spark data sources: read in partitions, with pushed filters, and as streams that resume.

``sqlite_files`` reads a table that lies in one database file or in several. Its partitions are ranges of the integer key in
each file; comparisons of columns with values become the statement's conditions. ``paged_listing`` reads a listing in pages, as an API gives it:
pages of a source lie behind each other, the last one is short, and the first says how many rows there are. Its partitions are runs of pages of a
source; a filter on the source leaves the others' pages unread. As streams both take what came since the checkpoint: rows beyond the last key,
pages beyond the last page. A file or page that can't be read is an error, never an empty result.
"""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from pathlib import Path
from urllib.parse import quote, unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

#: How a comparison reads in a statement.
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Rows that are fetched at a time.
FETCHED = 2000
#: Partitions that runs of pages make about at most; beyond that runs are longer.
MOST_RUNS = 512


def register(spark: SparkSession) -> None:
    """Make the formats known to the session and let filters reach sources written in Python."""
    spark.dataSource.register(SqliteFiles)
    spark.dataSource.register(PagedListing)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def local_path(path: str) -> str:
    return unquote(urlsplit(path).path) if path.startswith("file:") else path


def quoted(name: str) -> str:
    """An identifier of a statement."""
    doubled = name.replace('"', '""')
    return f'"{doubled}"'


@dataclass
class KeyRange(InputPartition):
    """Keys from ``low`` to below ``high`` of a file; no ends: the rows without a key."""

    file: str
    low: int | None
    high: int | None
    where: str = ""
    values: tuple = ()


class SqliteFiles(DataSource):
    """Options: path (a file or a folder of .db files), table, key (an integer column), parts (ranges of each file)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.table, self.key, self.parts = options["table"], options["key"], int(options.get("parts", "4"))
        self.at = Path(local_path(options["path"]))

    def files(self) -> list[str]:
        found = sorted(map(str, self.at.glob("*.db"))) if self.at.is_dir() else [str(self.at)]
        if not found:
            raise FileNotFoundError(f"no database in {self.at}")
        return found

    def connected(self, file: str) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{quote(file)}?mode=ro", uri=True)

    def schema(self) -> T.StructType:
        """As the table declares it: integers are longs, reals doubles, blobs binary, all else strings."""
        with self.connected(self.files()[0]) as c:
            columns = c.execute(f"PRAGMA table_info({quoted(self.table)})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.table}")
        kind = lambda x: T.LongType() if "INT" in x else T.DoubleType() if re.search("REAL|DOUB|FLOA", x) else T.BinaryType() if "BLOB" in x else T.StringType()
        return T.StructType([T.StructField(name, kind(x.upper())) for _, name, x, *_ in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return KeyRangeReader(self, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return KeyRangeStream(self, schema)

    def bounds(self, file: str) -> tuple[int, int, bool]:
        """The first key, the one behind the last, and whether rows have none."""
        key, table = quoted(self.key), quoted(self.table)
        with self.connected(file) as c:
            low, high, none = c.execute(f"SELECT min({key}), max({key}), count(*) > count({key}) FROM {table}").fetchone()
        return (0, 0, bool(none)) if low is None else (low, high + 1, bool(none))

    def rows(self, part: KeyRange, schema: T.StructType) -> Iterator[tuple]:
        names, key = ", ".join(map(quoted, schema.names)), quoted(self.key)
        within, values = (f"{key} IS NULL", ()) if part.low is None else (f"{key} >= ? AND {key} < ?", (part.low, part.high))
        with self.connected(part.file) as c:
            found = c.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE {within}{part.where}", (*values, *part.values))
            while batch := found.fetchmany(FETCHED):
                yield from batch


class KeyRangeReader(DataSourceReader):
    def __init__(self, source: SqliteFiles, schema: T.StructType) -> None:
        self.source, self.wanted, self.where, self.values = source, schema, "", ()
        self.low = self.high = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """What compares a number or text with a value goes into the statement; the rest stays with Spark."""
        kinds = {f.name: f.dataType for f in self.wanted.fields}
        for f in filters:
            at = f.attribute if isinstance(f, (*SIGNS, In, IsNull, IsNotNull)) else ()
            # doubles and text of a database compare as Spark's do; its rules for other kinds may differ
            if len(at) != 1 or not isinstance(kinds.get(at[0]), (T.LongType, T.DoubleType, T.StringType)):
                yield f
                continue
            column = quoted(at[0])
            if isinstance(f, (IsNull, IsNotNull)):
                self.where += f" AND {column} IS {'NOT ' * isinstance(f, IsNotNull)}NULL"
            elif isinstance(f, In):
                self.where += f" AND {column} IN ({', '.join('?' * len(f.value))})"
                self.values += tuple(f.value)
            else:
                self.where += f" AND {column} {SIGNS[type(f)]} ?"
                self.values += (f.value,)
                if at[0] == self.source.key:
                    self._narrow(f)

    def _narrow(self, f: Filter) -> None:
        """Comparisons of the key leave ranges out."""
        if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
            self.low = max(x for x in (self.low, f.value + isinstance(f, GreaterThan)) if x is not None)
        if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
            self.high = min(x for x in (self.high, f.value + (not isinstance(f, LessThan))) if x is not None)

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        bounded = self.low is not None or self.high is not None
        for file in self.source.files():
            low, high, none = self.source.bounds(file)
            low, high = max(low, self.low if self.low is not None else low), min(high, self.high if self.high is not None else high)
            step = max(1, -(-(high - low) // self.source.parts))
            out += [KeyRange(file, k, min(k + step, high), self.where, self.values) for k in range(low, high, step)]
            if none and not bounded:
                out.append(KeyRange(file, None, None, self.where, self.values))
        return out

    def read(self, partition: KeyRange | None) -> Iterator[tuple]:
        # Spark asks for one partition even where there is none
        return self.source.rows(partition, self.wanted) if partition else iter(())


class KeyRangeStream(DataSourceStreamReader):
    """A file's rows in order of their keys: the offset is each file's key behind the last one read."""

    def __init__(self, source: SqliteFiles, schema: T.StructType) -> None:
        self.source, self.wanted = source, schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {file: self.source.bounds(file)[1] for file in self.source.files()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low = {file: start[file] if file in start else self.source.bounds(file)[0] for file in end}
        return [KeyRange(file, low[file], high) for file, high in end.items() if low[file] < high]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        return self.source.rows(partition, self.wanted)


def write_sqlite_files(df: DataFrame, folder: str, table: str) -> DataFrame:
    """(file, n): ``df`` as a folder of database files, one for each task that has rows, named by its partition; a task that is
    repeated writes its file anew under another name and renames it at its end. Runs when it is read."""
    names = df.columns
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    declared = ", ".join(f"{quoted(n)} {kinds.get(t, 'TEXT')}" for n, t in df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, total, c = TaskContext.get(), 0, None
        at = Path(local_path(folder)) / f"part-{task.partitionId():05d}.db"
        own = at.with_suffix(f".{task.taskAttemptId()}.tmp")
        for b in batches:
            if not len(b):
                continue
            if c is None:
                own.parent.mkdir(parents=True, exist_ok=True)
                c = sqlite3.connect(own)
                c.execute(f"CREATE TABLE {quoted(table)} ({declared})")
            rows = b.astype(object).where(b.notna(), None).itertuples(index=False, name=None)
            c.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(names))})", rows)
            total += len(b)
        if c is not None:
            c.commit()
            c.close()
            own.replace(at)
            yield pd.DataFrame({"file": [str(at)], "n": [total]})

    return df.mapInPandas(run, "file string, n long")


@dataclass
class PageRun(InputPartition):
    """Pages from ``first`` to before ``end`` of a source."""

    source: str
    first: int
    end: int


class PagedListing(DataSource):
    """Options: path (a folder source=x/page=n of one JSON file each: {"total_count", "items"}, pages from 1), page_size, pages (of a
    partition; more if there would be over MOST_RUNS of them), file_pages (1; if more, source=x/block=k, k from 0, has a file of so many pages, each
    a line, in order). Rows: source, page, place, and each item as JSON."""

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.at, self.size, self.pages = Path(local_path(options["path"])), int(options.get("page_size", "100")), int(options.get("pages", "8"))
        self.file_pages = int(options.get("file_pages", "1"))

    def schema(self) -> str:
        return "source string, page int, place int, item string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PageReader(self)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return PageStream(self)

    def sources(self) -> list[str]:
        return sorted(unquote(p.name.removeprefix("source=")) for p in self.at.glob("source=*"))

    def file(self, source: str, part: str) -> Path:
        (found,) = [f for f in (self.at / f"source={quote(source, safe='')}" / part).iterdir() if f.name[0] not in "._"]
        return found

    def read_page(self, text: str, source: str, number: int) -> dict:
        found = json.loads(text)
        if not isinstance(found, dict) or not isinstance(found.get("items"), list) or not isinstance(found.get("total_count"), int):
            raise ValueError(f"page {number} of {source} is no page")
        return found

    def texts(self, source: str, first: int, end: int) -> Iterator[tuple[int, str]]:
        """Pages from ``first`` to before ``end``, each file read once, up to the last page that is wanted."""
        if self.file_pages == 1:
            for number in range(first, end):
                yield number, self.file(source, f"page={number}").read_text()
            return
        for block in range((first - 1) // self.file_pages, (end - 2) // self.file_pages + 1):
            low, high = block * self.file_pages + 1, min(end, (block + 1) * self.file_pages + 1)
            number = low - 1
            with self.file(source, f"block={block}").open(encoding="utf-8", newline="\n") as f:
                for number, text in enumerate(islice(f, high - low), low):
                    if number >= first:
                        yield number, text
            if number < high - 1:
                raise ValueError(f"page {number + 1} of {source} is missing")

    def page(self, source: str, number: int) -> dict:
        """One page, as one request would get it."""
        ((_, text),) = self.texts(source, number, number + 1)
        return self.read_page(text, source, number)

    def page_count(self, source: str) -> int:
        return -(-self.page(source, 1)["total_count"] // self.size)

    def rows(self, part: PageRun) -> Iterator[tuple]:
        for number, text in self.texts(part.source, part.first, part.end):
            items = self.read_page(text, part.source, number)["items"]
            for place, item in enumerate(items):
                yield part.source, number, place, json.dumps(item, ensure_ascii=False)
            if len(items) < self.size:
                return


class PageReader(DataSourceReader):
    def __init__(self, listing: PagedListing) -> None:
        self.listing, self.only = listing, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("source",):
                values = set(f.value if isinstance(f, In) else [f.value])
                self.only = values if self.only is None else self.only & values
            elif not (isinstance(f, IsNotNull) and f.attribute == ("source",)):
                yield f

    def partitions(self) -> list[InputPartition]:
        own = [s for s in self.listing.sources() if self.only is None or s in self.only]
        counts = {s: self.listing.page_count(s) for s in own}
        step = max(self.listing.pages, -(-sum(counts.values()) // MOST_RUNS))
        return [PageRun(s, k, min(k + step, n + 1)) for s, n in counts.items() for k in range(1, n + 1, step)]

    def read(self, partition: PageRun | None) -> Iterator[tuple]:
        return self.listing.rows(partition) if partition else iter(())


class PageStream(DataSourceStreamReader):
    """The offset is each source's page behind the last full one read: a short page is read again once it has grown, from the place where it ended."""

    def __init__(self, listing: PagedListing) -> None:
        self.listing = listing

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {s: self.listing.page(s, 1)["total_count"] for s in self.listing.sources()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [PageRun(s, start.get(s, 0), n) for s, n in end.items() if start.get(s, 0) < n]

    def read(self, partition: PageRun) -> Iterator[tuple]:
        """Here a run is one of rows: from the ``first`` to before the ``end``."""
        size = self.listing.size
        pages = PageRun(partition.source, partition.first // size + 1, -(-partition.end // size) + 1)
        for row in self.listing.rows(pages):
            if partition.first <= (row[1] - 1) * size + row[2] < partition.end:
                yield row
