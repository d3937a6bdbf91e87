"""Run registered queries beside their SQL twins and compare rows, columns and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(plain, key=lambda t: tuple(map(str, t)))


def difference(spark_df, con, statement) -> str | None:
    """None if both give the same rows, else a description."""
    left = _rows(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    cursor = con.execute(statement)
    right = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} against {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows against {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b or any(type(x) is not type(y) for x, y in zip(a, b)):
            wrong = [(n, x, y) for n, x, y in zip(left[0], a, b) if x != y or type(x) is not type(y)]
            return f"first difference {wrong} in {a}"
    return None


def main(argv: list[str]) -> int:
    from fleetkpi.queries import catalogue
    from fleetkpi.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark, con = local_session(8), database(sf_dir)
    failed = 0
    for name, query in catalogue().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if query.sql:
                problem = difference(query.run(spark, sf_dir), con, query.sql)
            else:
                problem = None if query.run(spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
