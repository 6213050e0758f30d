"""Both sides of a query on the same tables, in a form that can be compared."""

import duckdb
import pandas as pd

from tidemark.sources.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(value) -> str:
    if not isinstance(value, (list, tuple, dict)) and pd.isna(value):
        return "null"
    value = value.item() if hasattr(value, "item") else value
    return f"{value:.6f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(pdf) -> tuple[list[str], list[tuple[str, ...]]]:
    names = sorted(pdf.columns)
    return names, sorted(tuple(cell(x) for x in r) for r in pdf[names].itertuples(index=False, name=None))
