"""Every registered query against its SQL twin on the smallest tables."""

import re

import pytest
from __spark_entry__ import entry, oracle_sql, queries
from oracle import compare, duck

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        problem, _ = compare(df, con, SQL[name])
        assert problem is None, problem
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry(spark).count() == 6


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    plain = {q for q in set(QUERIES) - set(SQL) if not re.match(r"op\d+_|pipeline$", q)}
    assert plain == {"e3_summary", "e6_text_vectors"}
