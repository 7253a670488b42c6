"""Compare registered queries with their SQL in DuckDB: ``python tests/check_oracle.py [sf] [key ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_bool_dtype(s):
            df[c] = s.astype(object)
        elif pd.api.types.is_numeric_dtype(s):
            df[c] = s.astype(float)
        elif pd.api.types.is_datetime64_any_dtype(s):
            df[c] = s.astype("datetime64[us]").astype(str)
        else:
            df[c] = s.map(lambda v: None if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v))
                          else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool)
                          else str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)))
    keys = [df[c].map(lambda v: "" if v is None else (f"{v:.9g}" if isinstance(v, float) else str(v))) for c in df.columns]
    if not len(df.columns):
        return df
    order = pd.DataFrame({i: k for i, k in enumerate(keys)}).sort_values(list(range(len(keys)))).index
    return df.loc[order].reset_index(drop=True)


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            ok = np.isclose(a[c], b[c], rtol=0, atol=0, equal_nan=True)
        else:
            ok = np.array([(x is None and y is None) or x == y or (x != x and y != y) for x, y in zip(a[c], b[c])], dtype=bool)
        if not ok.all():
            i = int(np.argmin(ok))
            return f"column {c}: {int((~ok).sum())} differ, first {a[c][i]!r} != {b[c][i]!r} in {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
    return None


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def main(sf: str, keys: list[str]) -> int:
    import __spark_entry__ as entry
    from millrace.session import local_session

    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in keys or list(queries):
        t0 = time.time()
        try:
            got = queries[key](spark, folder).toPandas()
            took = time.time() - t0
            if key not in oracle:
                print(f"rows  {key}: {len(got)} rows {took:.1f}s", flush=True)
                if keys:
                    print(got.head(8).to_string())
                continue
            t1 = time.time()
            want = con.sql(oracle[key]).df()
            problem = differences(got, want)
            if not len(want):
                problem = (problem or "") + " EMPTY RESULT"
        except Exception as e:  # report and go on
            problem, took, t1, got = f"{type(e).__name__}: {str(e)[:600]}", time.time() - t0, time.time(), []
        bad += problem is not None
        print(f"{'ok   ' if problem is None else 'FAIL '} {key}: {len(got)} rows {took:.1f}s sql {time.time() - t1:.1f}s {problem or ''}", flush=True)
    print("failures", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:])))
