"""A query's rows beside its DuckDB SQL's rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_norm(r[k]) for k in order) for r in found), key=repr)


def same(df, con, sql):
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.sql(sql)
    theirs = rows(result.columns, result.fetchall())
    assert sorted(df.columns) == sorted(result.columns)
    assert ours == theirs
