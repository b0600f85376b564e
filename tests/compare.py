"""Holds a query's rows against its SQL in DuckDB, whatever the order of rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    def plain(x):
        if isinstance(x, float):
            return None if x != x else int(x) if x.is_integer() else round(x, 6)
        if hasattr(x, "tolist"):
            return tuple(plain(y) for y in x.tolist()) if getattr(x, "ndim", 0) else plain(x.item())
        if isinstance(x, (list, tuple)):
            return tuple(plain(y) for y in x)
        if hasattr(x, "isoformat"):
            return x.isoformat()[:19].replace("T00:00:00", "")
        return int(x) if isinstance(x, bool) else None if x is None or str(x) in ("NaT", "<NA>") else x

    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(x) for x in row) for row in frame[columns].itertuples(index=False)), key=repr)


def expected(sql, folder):
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return rows_of(con.sql(sql).df())
