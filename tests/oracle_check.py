"""Compare a registered query with its SQL: columns, types, row count, values."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime64"):
            df[c] = df[c].astype("datetime64[us]")
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> list[str]:
    found = []
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"]
    for c in spark_df.columns:
        a, b = spark_df[c].dtype.kind, sql_df[c].dtype.kind
        if a != b and not spark_df[c].isna().any():
            found.append(f"type of {c}: {spark_df[c].dtype} != {sql_df[c].dtype}")
    if len(spark_df) != len(sql_df):
        return [*found, f"rows {len(spark_df)} != {len(sql_df)}"]
    wrong = [(x, y) for x, y in zip(normal(spark_df), normal(sql_df)) if x != y]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {wrong[0]}")
    return found
