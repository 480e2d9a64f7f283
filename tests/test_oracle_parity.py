"""Every query with an oracle matches DuckDB on the small fixture
(row count, column names, order-insensitive values)."""

import pytest

import __spark_entry__ as E

from conftest import SMALL

SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return repr(v)


def _rows(rows):
    return sorted(tuple(_norm(x) for x in r) for r in rows)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = _rows(tuple(r[c] for c in cols) for r in df.select(*cols).collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    idx = {c: i for i, c in enumerate(rel.columns)}
    want = _rows(tuple(r[idx[c]] for c in cols) for r in rel.fetchall())
    assert len(got) == len(want)
    assert got == want
