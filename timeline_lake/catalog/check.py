"""Compare registered queries with their SQL on one folder of tables: ``python -m timeline_lake.catalog.check [dir] [name …]``."""

from __future__ import annotations

import sys
import time

import duckdb

from timeline_lake.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(float(value)) if value == value else "nan"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, folder: str, query, sql: str, took: list[float] | None = None) -> str:
    """What differs; empty if nothing does. ``took`` gets the seconds Spark and DuckDB needed."""
    began = time.time()
    df = query(spark, folder)
    rows = df.collect()
    between = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    found = cursor.fetchall()
    if took is not None:
        took += [between - began, time.time() - between]
    mine, theirs = rows_of(df.columns, rows), rows_of(names, found)
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    if len(mine) != len(theirs):
        return f"rows differ: {len(mine)} / {len(theirs)}"
    if not mine:
        return "both empty"
    for a, b in zip(mine, theirs):
        if a != b:
            wrong = sum(x != y for x, y in zip(mine, theirs))
            return f"{wrong} of {len(mine)} rows differ, first: {a} / {b}"
    return ""


def main(argv: list[str]) -> int:
    from timeline_lake.catalog import oracle_sql, queries

    folder = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), oracle_sql(), 0
    for name, query in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        began, took = time.time(), []
        try:
            if name in oracles:
                problem = compare(spark, con, folder, query, oracles[name], took)
            else:
                n = query(spark, folder).count()
                problem = "" if n else "no rows"
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - began:.1f}s{' (DuckDB %.2fs)' % took[1] if took else '' if name in oracles else ' (rows only)'} {problem}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
