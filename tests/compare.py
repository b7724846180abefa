"""A Spark result against DuckDB's for the same tables."""

from pathlib import Path

import duckdb


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(None if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in (row[i] for i in order)) for row in rows), key=str)


def assert_same(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, found.fetchall())
