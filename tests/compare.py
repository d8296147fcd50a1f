"""Results of Spark and DuckDB, compared without regard to row order."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
        elif "datetime" in str(df[c].dtype):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: str(list(v)) if isinstance(v, (list, np.ndarray)) else None if v is None or v != v else str(v))
    text = df.astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"})
    text = text.map(lambda v: v[:-2] if v.endswith(".0") else v)
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    a, b = tidy(got), tidy(want)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b)
