"""Compare registered queries with their SQL on DuckDB. Also runs as a script."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if pd.api.types.is_float_dtype(frame[name]):
            frame[name] = frame[name].round(6) + 0.0
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = canonical(got), canonical(want)
    types = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got if got[c].dtype != want[c].dtype]
    try:
        pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-6, rtol=1e-9)
    except AssertionError as error:
        return str(error)
    return f"dtypes {types}" if types else None


if __name__ == "__main__":
    from conftest import build_session

    from __spark_entry__ import oracle_sql, queries

    folder = sys.argv[1]
    chosen = sys.argv[2:] or list(queries())
    session = build_session()
    con, sql = connect(folder), oracle_sql()
    for name in chosen:
        start = time.time()
        try:
            frame = queries()[name](session, folder).toPandas()
        except Exception as error:  # noqa: BLE001
            print(f"{name:24s} ERROR {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - start
        if name in sql:
            start = time.time()
            verdict = difference(frame, con.execute(sql[name]).df()) or "ok"
            print(f"{name:24s} {took:6.1f}s sql {time.time() - start:5.1f}s rows {len(frame):7d} {verdict}", flush=True)
        else:
            print(f"{name:24s} {took:6.1f}s rows {len(frame):7d} (no sql)", flush=True)
            print(frame.head(4).to_string(), flush=True)
