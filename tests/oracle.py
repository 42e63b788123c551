"""Compare a query with its SQL on DuckDB: rows as sorted tuples, floats to eight digits."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    ours = table(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).sql(sql)
    theirs = table(rel.columns, rel.fetchall())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    for a, b in zip(ours[1], theirs[1], strict=True):
        assert a == b
