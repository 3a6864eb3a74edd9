"""Every query that has SQL against DuckDB over the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from gridlake.plans import registry

QUERIES = registry.all_queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(cell(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(k for k, q in QUERIES.items() if q.sql))
def test_equals_its_sql(spark, sf_dir, name):
    df = QUERIES[name].run(spark, sf_dir)
    rel = duck(sf_dir).execute(QUERIES[name].sql)
    want = rows([d[0] for d in rel.description], rel.fetchall())
    have = rows(df.columns, [tuple(r) for r in df.collect()])
    assert have[0] == want[0] and len(have[1]) == len(want[1])
    for a, b in zip(have[1], want[1], strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) <= 1.01e-3 for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(k for k, q in QUERIES.items() if not q.sql))
def test_the_others_give_rows(spark, sf_dir, name):
    df = QUERIES[name].run(spark, sf_dir)
    assert df.columns and df.count() > 0


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["image_id", "y", "x", "v"]


def test_sql_is_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
