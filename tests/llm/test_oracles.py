"""Every query that has SQL, against it."""

import oracle
import pytest

from gridlake.llm.queries import ORACLE_SQL, QUERIES

EXACT = sorted(set(ORACLE_SQL) - {"op8_nearest"})


@pytest.mark.parametrize("name", EXACT)
def test_equals_its_sql(spark, sf_dir, name):
    assert oracle.same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_ten_operators_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
