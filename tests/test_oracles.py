"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math

import duckdb
import pytest

from caravel.plans import archive, context, inference, ingest, jobs  # noqa: F401  register more queries
from caravel.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in [*TABLES, "conversations"]:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*cols).collect()]
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_folds_run(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
