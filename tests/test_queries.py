"""Every query of the library proper against its SQL in DuckDB on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from claimflow.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/orders.parquet"), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return None if math.isnan(number) else number
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, SF)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    assert not any("CartesianProduct" in line for line in frame._jdf.queryExecution().executedPlan().toString().splitlines())
    if name not in catalog.SQL:
        assert sum(got[1].values()) > 0
        return
    result = duck.sql(catalog.SQL[name])
    assert got == rows_of(result.columns, result.fetchall())


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)


def test_entry_module_lists_all():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
