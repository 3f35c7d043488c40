"""Holds a query against its SQL, as the driver does: columns by name, rows in any order."""

from pathlib import Path

import duckdb


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _value(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def rows(df) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(_value, r)) for r in df.where(df.notna(), None).itertuples(index=False, name=None))


def compare(query, sql: str, spark, folder: str) -> None:
    made = query(spark, folder)
    got, want = made.toPandas(), tables(folder).execute(sql).df()
    got = got.astype({c: "Int64" for c, kind in made.dtypes if kind in ("bigint", "int")})  # integers beside nulls are floats otherwise
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
