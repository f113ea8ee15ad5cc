"""Compares a query with its SQL, by sorted rows."""

from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        connection.execute(f"create view {path.stem} as select * from '{files}'")
    return connection


def in_order(rows, columns):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(row[k] for k in at) for row in rows), key=lambda r: [(v is None, repr(v)) for v in r])


def assert_same(spark_df, sql: str, sf_dir: str) -> None:
    found = views(sf_dir).execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(spark_df.columns)
    assert in_order([tuple(r) for r in spark_df.collect()], spark_df.columns) == in_order(found.fetchall(), columns)
