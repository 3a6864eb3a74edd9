"""A query's rows against its SQL in DuckDB over the same Parquet files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(cell(r[i]) for i in order) for r in data), key=str)


def same(df, sql, sf_dir):
    got = df.collect()
    rel = duck(sf_dir).execute(sql)
    want = rows([d[0] for d in rel.description], rel.fetchall())
    have = rows(df.columns, [tuple(r) for r in got])
    assert have[0] == want[0]
    assert len(have[1]) == len(want[1])
    for a, b in zip(have[1], want[1], strict=True):
        assert a == b
    return got
