"""Run a registered query and its SQL, and compare every value."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return value + 0.0
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    cells = [tuple(_cell(v) for v in r) for r in frame.itertuples(index=False, name=None)]
    return sorted(cells, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def differences(ours: pd.DataFrame, theirs: pd.DataFrame, limit: int = 5) -> list[str]:
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} != {sorted(theirs.columns)}"]
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows != {len(theirs)} rows"]
    return [f"{a} != {b}" for a, b in zip(rows(ours), rows(theirs)) if a != b][:limit]
