"""Compares a query's rows with its SQL on DuckDB: columns by name, rows in any order, kinds of columns too."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def shown(v) -> str:
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(shown, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return repr(round(float(v), 6)).removesuffix(".0")
    return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)


def rows(df: pd.DataFrame) -> list[str]:
    cols = sorted(df.columns)
    return sorted("|".join(map(shown, r)) for r in df[cols].itertuples(index=False, name=None))


def check(spark, query, sql: str, sf_dir: str = SF) -> None:
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    got, want = query(spark, sf_dir), c.sql(sql)
    theirs = dict(zip(want.columns, map(str, want.types), strict=True))
    assert sorted(got.columns) == sorted(theirs)
    for name, kind in got.dtypes:
        assert KINDS.get(kind, theirs[name]) == theirs[name], (name, kind, theirs[name])
    assert rows(got.toPandas()) == rows(want.df())
