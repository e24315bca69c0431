"""Run every named query against its SQL: python tests/compare.py [sf] [names]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_frame(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def _cell(v):
    if pd.isna(v):
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return repr(float(v))
    return str(v)


def normal_rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(_cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if both hold the same columns and rows, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for mine, theirs in zip(normal_rows(got), normal_rows(want)):
        if mine != theirs:
            return f"first difference: {mine} != {theirs}"
    return None


def main() -> int:
    from tests.conftest import make_session

    from __spark_entry__ import oracle_sql, queries

    oracles, registered = oracle_sql(), queries()
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(registered)
    sf_dir, spark, bad = f"/root/testdata/sf{sf}", make_session(), 0
    for name in names:
        start = time.time()
        try:
            got = registered[name](spark, sf_dir).toPandas()
            took = time.time() - start
            finding = differences(got, oracle_frame(oracles[name], sf_dir)) if name in oracles else "rows only"
            bad += finding not in (None, "rows only")
            print(f"{name:28s} {took:6.2f}s {len(got):7d} rows  {finding or 'ok'}", flush=True)
        except Exception as error:  # keep going, report all
            bad += 1
            print(f"{name:28s} FAILED {type(error).__name__}: {str(error)[:600]}", flush=True)
    print(f"{bad} bad of {len(names)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
