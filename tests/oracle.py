"""Compare registered queries with their SQL in DuckDB: ``python -m tests.oracle [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def data_dir(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir(sf)}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value.asDict().values())
    return value if isinstance(value, (bool, int)) else str(value)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, sf: str, name: str, query, sql: str | None) -> str:
    start = time.time()
    df = query(spark, data_dir(sf))
    got = df.collect()
    spent = time.time() - start
    if sql is None:
        return f"ok    {name}: {len(got)} rows, no SQL, {spent:.1f}s"
    cur = duck(sf).execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"FAIL  {name}: columns {sorted(df.columns)} against {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        return (
            f"FAIL  {name}: {len(got)} rows against {len(want)}; only Spark {list((a - b).items())[:3]}; "
            f"only SQL {list((b - a).items())[:3]} ({sorted(names)})"
        )
    return f"ok    {name}: {len(got)} rows, {spent:.1f}s"


def main() -> int:
    import __spark_entry__ as entry
    from strandwise.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark = build_session(
        "oracle", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name in names:
        try:
            line = compare(spark, sf, name, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001
            line = f"ERROR {name}: {type(error).__name__} {str(error)[:900]}"
        bad += not line.startswith("ok")
        print(line, flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
