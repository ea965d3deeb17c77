"""Rows of Spark and of DuckDB side by side."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings nodes edges ingestion_log vault_files vault_file_nodes eval_items mix_targets".split()


def cell(v):
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
        return "NULL"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def database(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c
