"""Hold a query's rows against those of its SQL, without regard to order."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


def bag(columns: list[str], rows: list) -> Counter:
    order = [columns.index(c) for c in sorted(columns)]
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def assert_same(df, con, sql: str) -> None:
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    ours, theirs = bag(df.columns, df.collect()), bag(found.columns, found.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
