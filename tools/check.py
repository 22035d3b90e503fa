"""Run named queries and compare them with their SQL on DuckDB.

    python tools/check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.plans import CATALOGUE  # noqa: E402
from plumbline.session import local_session  # noqa: E402


def canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: repr(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    order = df.astype(str).sort_values(list(df.columns)).index if len(df.columns) else df.index
    return df.loc[order].reset_index(drop=True)


def differ(a: pd.DataFrame, b: pd.DataFrame) -> str | None:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    a, b = canon(a), canon(b)
    for c in a.columns:
        kinds = {x[c].dtype.kind for x in (a, b)}
        if len(kinds) > 1 and not kinds <= set("iu") and not (len(a) and a[c].isna().any()):
            return f"type of {c}: {a[c].dtype} vs {b[c].dtype}"
        x, y = a[c].astype(str).str.lower(), b[c].astype(str).str.lower()
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            x, y = pd.to_numeric(a[c]).round(9), pd.to_numeric(b[c]).round(9)
            bad = ~((x == y) | (x.isna() & y.isna()))
        else:
            bad = (x != y) & ~(a[c].isna() & b[c].isna())
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} values of {c}, first {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    failed = []
    for name, q in CATALOGUE.items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        t0 = time.time()
        try:
            got = q.frame(spark, folder).toPandas()
            t1 = time.time()
            sql = q.check_sql()
            why = differ(got, con.execute(sql).fetchdf()) if sql else None
            note = ("ok" if sql else "no SQL") if why is None else f"DIFFERS: {why}"
        except Exception as e:  # noqa: BLE001
            t1, why, note = time.time(), "error", f"ERROR {type(e).__name__}: {str(e)[:600]}"
            got = []
        if why:
            failed.append(name)
        print(f"{name:36s} {t1 - t0:6.2f}s sql {time.time() - t1:5.2f}s rows {len(got):6d}  {note}", flush=True)
    print(f"failed: {failed}" if failed else "all equal")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
