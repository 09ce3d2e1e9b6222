"""Comparison of a Spark result with that of SQL on the same files."""

import math
import os

import duckdb
import pandas as pd


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"create view {name.split('.')[0]} as select * from '{path}'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(_cell(v.item() if hasattr(v, "item") else v) for v in row) for row in ordered.itertuples(index=False))
