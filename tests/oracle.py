"""A query's rows against its SQL's, column by column."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return connection


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)[:19] if hasattr(value, "isoformat") else str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, sql, sf_dir):
    found = table(df.columns, df.collect())
    with connect(sf_dir) as connection:
        result = connection.execute(sql)
        wanted = table([c[0] for c in result.description], result.fetchall())
    assert found[0] == wanted[0]
    assert found[1] == wanted[1]
    return len(found[1])
