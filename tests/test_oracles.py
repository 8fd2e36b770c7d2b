"""Every registered query with SQL gives the same rows as that SQL, at the smallest scale."""

import importlib
import os

import pytest

from verify import connect, rows_of

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = ["detections", "scalars", "frames", "datasets", "files", "streams"]
CASES = [
    (m, name) for m in MODULES for name in importlib.import_module(f"wlanlake.catalog.{m}").ORACLES
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("module, name", CASES, ids=[n for _, n in CASES])
def test_query_equals_sql(spark, duck, module, name):
    catalog = importlib.import_module(f"wlanlake.catalog.{module}")
    df = catalog.QUERIES[name](spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(catalog.ORACLES[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_oracle_has_a_query():
    from wlanlake.catalog import oracles, queries

    assert set(oracles()) <= set(queries())
