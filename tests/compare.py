"""Compare named queries with their SQL, by rows: ``python tests/compare.py <sf_dir> [names]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as spark_entry  # noqa: E402
from legajo.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
            return "∅"
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, pd.Timestamp):
            return str(v.date()) if v == v.normalize() else str(v)
        try:
            return f"{float(v):.6g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(cell(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


def difference(spark, db, sf_dir: str, name: str) -> str | None:
    """First difference between both results, None when they agree."""
    got = spark_entry.queries()[name](spark, sf_dir).toPandas()
    want = db.execute(spark_entry.oracle_sql()[name]).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return None if a else "both empty"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"rows {len(a)} != {len(b)}; only spark {only_a[:2]}; only sql {only_b[:2]}"


if __name__ == "__main__":
    sf = sys.argv[1]
    spark, db = local_session(8), connect(sf)
    bad = 0
    for n in sys.argv[2:] or list(spark_entry.queries()):
        if n not in spark_entry.oracle_sql():
            print(f"{n:30s} no SQL", flush=True)
            continue
        start = time.time()
        try:
            d = difference(spark, db, sf, n)
        except Exception as e:  # noqa: BLE001
            d = f"error {str(e)[:500]}"
        bad += d is not None
        print(f"{n:30s} {'ok' if d is None else 'DIFF'} {time.time() - start:5.1f}s {d or ''}", flush=True)
    print("different:", bad)
