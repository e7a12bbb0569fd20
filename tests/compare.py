"""Run registered queries next to their SQL in DuckDB and compare all rows.

``python -m tests.compare [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[int, list[str]]:
    """Number of Spark rows, and what differs from the SQL answer."""
    df = query(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    want = _rows(names, answer.fetchall())
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        problems.append(f"extra {len(extra)} {sorted(extra, key=repr)[:3]} missing {len(missing)} {sorted(missing, key=repr)[:3]}")
    return len(got), problems


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    from skein import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark = build_session(
        "compare",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            rows, problems = compare(spark, con, query, entry.oracle_sql()[name], sf_dir)
        except Exception as error:  # keep going: one line per query
            rows, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        print(f"{'ok  ' if not problems else 'FAIL'} {name} rows={rows} {time.time() - start:.1f}s", *problems, flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
