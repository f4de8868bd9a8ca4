"""Compare queries with their SQL: python tests/check_queries.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback
from numbers import Real

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False, name=None):
        rows.append(tuple(None if pd.isna(v) else (round(float(v), 9) if isinstance(v, Real) else v) for v in row))
    return sorted(rows, key=repr)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, build, sql: str | None, sf_dir: str) -> str:
    """Empty if equal, else what differs."""
    got = build(spark, sf_dir).toPandas()
    if sql is None:
        return "" if len(got) else "no rows"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and "O" not in k}
    a, b = canonical(got), canonical(want)
    if a != b:
        different = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"{len(a)} rows != {len(b)} rows; first: {str(different)[:600]}"
    if not a:
        return "no rows"
    return f"types {odd}" if odd else ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    from framesift.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, queries()[name], oracle_sql().get(name), sf_dir)
        except Exception:
            problem = traceback.format_exc(limit=-3)[-1500:]
        failed += bool(problem)
        label = "ok" if name in oracle_sql() else "rows only"
        print(f"{name:28s} {time.time() - start:6.2f}s {problem or label}", flush=True)
    print(f"{len(names) - failed} of {len(names)} good")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
