"""Exact sizes of encoded lists and of what a selection adds to a document, by sums over records; nothing is encoded for it.

A record is measured once: its bytes as an item, as a row of a table, and its keys. In the compact form neighbours of the same keys
become a table, so a list's size follows from its records' measures and from where runs begin, which ``lag`` finds in their
order. Sections whose records name a file are cut into runs of one file; a file's runs are the same in whatever set of files it
is chosen, so the section of a set is a sum over its files.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbeck.operators.encoding import DIRECTIVES, ESCAPED, ITEMS, RUNS, SEGMENTS, TABLE, compact_text, plain_list_bytes

_STRING = r'"(?:[^"\\]|\\.)*"'
#: Bytes around what a directive holds: {"$t":[...]}; around an escaped object: {"$o":...}.
AROUND, ESCAPE = len(f'{{"{TABLE}":[]}}'), len(f'{{"{ESCAPED}":}}')
assert all(len(x) == len(TABLE) for x in (SEGMENTS, ITEMS, RUNS))

#: A selection's version and the names of its own fields, in their order.
VERSION = "1.0"
FIELDS = ("selectionVersion", "status", "budgetBytes", "estimatedContextBytes", "includedFiles", "excludedFiles", "selectionReasons")


def json_bytes(text: Column) -> Column:
    """Bytes of a string in JSON, with its quotes."""
    return F.octet_length(F.to_json(F.array(text))) - 2


def measured(records: DataFrame, json_col: str) -> DataFrame:
    """``records`` and, of the JSON text of each: ``signature`` (its keys as a JSON list; null if it is no object or has none),
    ``header`` (that list's bytes), ``item`` and ``row`` (bytes in the compact form), ``plain`` (bytes as canonical text), ``file``, ``file_at`` (its
    key's place), and ``bare_signature``, ``bare_header``, ``bare_item``, ``bare_row`` without the file.

    Flat records are measured on the JVM; one with lists or objects inside goes through the encoder, alone."""
    text = F.regexp_replace(F.col(json_col), rf"({_STRING})|\s+", "$1")
    inside = F.regexp_replace(text, _STRING, "").substr(F.lit(2), F.length(text))
    rows = records.withColumns({"_text": text, "_nested": F.coalesce(inside.rlike(r"[\[{]"), F.lit(False))})
    encoded = rows.filter("_nested").mapInArrow(_compacted, rows.schema)
    rows = rows.filter(~F.col("_nested")).union(encoded)

    keys = F.json_object_keys(json_col)
    size = F.octet_length("_text")
    lone = (F.size(keys) == 1) & F.get(keys, F.lit(0)).isin(*DIRECTIVES)
    # an escaped object was encoded with its escape already
    item = F.when(lone & ~F.col("_nested"), size + ESCAPE).otherwise(size)
    bare_keys = F.array_remove(keys, "file")
    listed = lambda k: F.when(F.size(k) > 0, F.to_json(k))
    header = lambda k: F.octet_length(F.to_json(k))
    row = lambda item, k: item - header(k) + 1  # noqa: E731  of each key the quoted name and a colon go
    file = F.when(F.array_position(keys, "file") > 0, _file(F.col(json_col)))
    entry = F.lit(len('"file":')) + json_bytes(F.col("file"))
    bare = F.when(F.size(keys) == 1, 2).otherwise(size - entry - 1)
    lone_bare = (F.size(bare_keys) == 1) & F.get(bare_keys, F.lit(0)).isin(*DIRECTIVES)
    out = rows.withColumn("file", file).withColumns({
        "signature": listed(keys), "header": header(keys), "item": item, "row": row(F.when(lone & F.col("_nested"), size - ESCAPE).otherwise(size), keys), "plain": F.octet_length(json_col),
        "file_at": (F.array_position(keys, "file") - 1).cast("int"), "bare_signature": listed(bare_keys), "bare_header": header(bare_keys),
        "bare_item": F.when(lone_bare, bare + ESCAPE).otherwise(bare), "bare_row": row(bare, bare_keys),
    })
    return out.drop("_text", "_nested")


def _file(json: Column) -> Column:
    """The value of ``file`` if it is a string, read from the record itself; null otherwise."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), "$.file", "variant"))
    return F.when(kind == "STRING", F.try_variant_get(F.try_parse_json(json), "$.file", "string"))


def _compacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("_text")
        yield b.set_column(at, b.schema.field(at), pa.array([compact_text(x) for x in b.column(at).to_pylist()], b.schema.field(at).type))


def _list_sums(rows: DataFrame, by: Sequence[str], order: str, signature: str, header: str, item: str, row: str) -> DataFrame:
    """(by, bytes) of the compact list that each group's records make in their order."""
    w = Window.partitionBy(*by).orderBy(order)
    cut = F.col(signature).isNull() | ~F.col(signature).eqNullSafe(F.lag(signature).over(w))
    runs = rows.withColumn("_run", F.sum(cut.cast("int")).over(w)).groupBy(*by, "_run").agg(
        F.count("*").alias("_n"), F.first(signature, ignorenulls=True).alias("_s"), F.max(header).alias("_h"), F.sum(item).alias("_i"), F.sum(row).alias("_r"))
    table = F.col("_s").isNotNull() & (F.col("_n") >= 2)
    runs = runs.withColumn("_table", table)
    w = Window.partitionBy(*by).orderBy("_run")
    begins = F.col("_table") | F.coalesce(F.lag("_table").over(w), F.lit(True))
    sums = runs.withColumn("_begins", begins).groupBy(*by).agg(
        F.sum("_n").alias("n"), F.count_if("_begins").alias("segments"), F.count_if("_table").alias("tables"), F.coalesce(F.sum(F.when(table, F.col("_h") + F.col("_r") + F.col("_n") + AROUND)), F.lit(0)).alias("in_tables"),
        F.coalesce(F.sum(F.when(~table, F.col("_i"))), F.lit(0)).alias("items"), F.coalesce(F.sum(F.when(~table, F.col("_n"))), F.lit(0)).alias("loose"))
    # of a loose segment's records all but one have a comma before them
    loose = F.col("items") + F.col("loose") - (F.col("segments") - F.col("tables"))
    several = F.col("in_tables") + loose + AROUND * (F.col("segments") - F.col("tables")) + AROUND + F.col("segments") - 1
    size = F.when(F.col("tables") == 0, loose + 2).when(F.col("segments") == 1, F.col("in_tables")).otherwise(several)
    return sums.select(*by, size.cast("long").alias("bytes"))


def list_bytes(parts: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """(by, bytes, plain_bytes): of each group's records, ``measured``, the bytes of their list in the compact and the canonical form."""
    plain = parts.groupBy(*by).agg(plain_list_bytes(F.sum("plain"), F.count("*")).cast("long").alias("plain_bytes"))
    return _list_sums(parts, by, order, "signature", "header", "item", "row").join(plain, list(by))


def file_runs(parts: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """(by, file, runs, run_bytes): what each file's records, ``measured``, add to their section in the compact form."""
    w = Window.partitionBy(*by).orderBy(order)
    cut = ~(F.col("file").eqNullSafe(F.lag("file").over(w)) & F.col("file_at").eqNullSafe(F.lag("file_at").over(w)))
    rows = parts.withColumn("_file_run", F.sum(cut.cast("int")).over(w))
    lists = _list_sums(rows, [*by, "_file_run", "file", "file_at"], order, "bare_signature", "bare_header", "bare_item", "bare_row")
    run = F.col("bytes") + json_bytes(F.col("file")) + F.length(F.col("file_at").cast("string")) + len("[,,]")
    return lists.groupBy(*by, "file").agg(F.count("*").alias("runs"), F.sum(run).alias("run_bytes"))


def section_bytes(runs: Column, run_bytes: Column) -> Column:
    """Bytes of a section of so many runs; an empty one is a list."""
    return F.when(F.coalesce(runs, F.lit(0)) == 0, 2).otherwise(run_bytes + AROUND + runs - 1)


def chosen_section_bytes(runs: DataFrame, chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, bytes) of the section for each group's chosen files (by, file), from ``file_runs``: no record is looked at again."""
    sums = chosen.select(*by, "file").distinct().join(runs, [*by, "file"], "left").groupBy(*by).agg(F.sum("runs").alias("r"), F.sum("run_bytes").alias("b"))
    return sums.select(*by, section_bytes(F.col("r"), F.col("b")).cast("long").alias("bytes"))


def selection_bytes(status: Column, budget: Column, estimate_digits: Column, included: Column, included_bytes: Column, excluded: Column, excluded_bytes: Column, reasons: Column) -> Column:
    """Bytes of a selection's own description: the numbers of files, and the bytes of their names in JSON and, of those left out, of
    their reasons too, ``estimate_digits`` of the size that it states."""
    names = sum(len(f'"{x}": ') for x in FIELDS) + 2 * (len(FIELDS) - 1) + 2
    list_of = lambda n, size: size + 2 * F.greatest(n - 1, F.lit(0)) + 2
    said = F.octet_length(F.to_json(reasons)) + F.greatest(F.size(reasons) - 1, F.lit(0))
    left = excluded_bytes + excluded * len('{"file": , "reason": }')
    return F.lit(names + len(f'"{VERSION}"')) + json_bytes(status) + F.length(budget.cast("string")) + estimate_digits + list_of(included, included_bytes) + list_of(excluded, left) + said


def stated_total(rest: Column, rounds: int = 3) -> Column:
    """The size of a document that states its own size in decimal: the least t = rest + digits of t, or null where ``rounds`` rounds don't find it.
    ``rest`` is all but those digits."""
    digits = lambda x: F.length(x.cast("string"))
    t = rest + 1
    for _ in range(rounds):
        t = rest + digits(t)
    return F.when(t == rest + digits(t), t)
