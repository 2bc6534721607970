"""Columns computed by Python, appended to a table's own without shuffling it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnbeck.llm.common import bounded_batches


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """``names``, each with underscores put before it until it clashes with no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def with_python_columns(df: DataFrame, text_col: str, fields: list[tuple[str, T.DataType]], work: Callable[[], Callable[[list[str]], list[pa.Array]]]) -> DataFrame:
    """``df`` and the columns ``fields``. ``work()`` is called once a task; its result maps a batch's texts (null as
    empty) to one Arrow array for each field."""
    bounded_batches(df.sparkSession)
    at, names = df.columns.index(text_col), [*df.columns, *[n for n, _ in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = work()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *made([t or "" for t in b.column(at).to_pylist()])], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]]))
