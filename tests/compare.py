"""Rows of a Spark result and of DuckDB's answer, made comparable."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _said(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return repr(float(v))
    return pd.Timestamp(v).isoformat() if hasattr(v, "isoformat") else str(v)


def rows(df: pd.DataFrame) -> list[str]:
    return sorted("|".join(map(_said, r)) for r in df[sorted(df.columns)].itertuples(index=False))
