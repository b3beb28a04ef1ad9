"""Compare registered queries with their oracle SQL.

    python tools/check.py [--sf DIR] [name prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402

from updraft import catalog  # noqa: E402
from updraft.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()  # fmt: skip


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (float, np.floating)):
        return repr(float(value) + 0.0)
    if isinstance(value, (int, np.integer)):
        return str(int(value))
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}={_cell(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    if isinstance(value, pd.Timestamp):
        return value.tz_localize(None).isoformat() if value.tzinfo else value.isoformat()
    if hasattr(value, "asDict"):
        return _cell(value.asDict())
    return str(value)


def canonical(rows: list[tuple], columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str, queries: dict, oracles: dict) -> tuple[str, float, int]:
    start = time.time()
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if name not in oracles:
        return "rows only", seconds, len(got)
    rel = con.execute(oracles[name])
    columns = [c[0] for c in rel.description]
    want = rel.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}", seconds, len(got)
    a, b = canonical(got, df.columns), canonical(want, columns)
    if a == b:
        types = {c[0]: str(c[1]) for c in rel.description}
        return "ok" if a else f"ok BUT EMPTY {types and ''}", seconds, len(got)
    missing, extra = [r for r in b if r not in set(a)][:2], [r for r in a if r not in set(b)][:2]
    return f"DIFF {len(a)} vs {len(b)} rows\n   oracle only {missing}\n   spark only  {extra}", seconds, len(got)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("prefixes", nargs="*")
    args = parser.parse_args()
    queries, oracles = catalog.load()
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in queries:
        if args.prefixes and not any(name == p or name.startswith(p) for p in args.prefixes):
            continue
        try:
            verdict, seconds, n = compare(spark, con, name, args.sf, queries, oracles)
        except Exception as exc:  # noqa: BLE001
            verdict, seconds, n = f"ERROR {str(exc)[:1500]}", 0.0, 0
        bad += not verdict.startswith(("ok", "rows"))
        print(f"{name:34s} {seconds:6.2f}s {n:7d}  {verdict}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
