"""Every query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from landgraph.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 5)) if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF)
    theirs = duck.execute(registry.SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert canonical(tuple(r) for r in ours.select(*columns).collect()) == canonical(theirs.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)


def test_entry_points():
    import __spark_entry__ as e

    assert registry.FLAGSHIP in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
