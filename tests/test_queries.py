"""Every query runs, and equals its SQL, on the smallest test tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_queries import compare  # noqa: E402

from fieldweave.catalog import ORACLES, QUERIES  # noqa: E402
from fieldweave.fixtures import _TABLES  # noqa: E402

FOLDER = os.environ.get("FIELDWEAVE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for t in _TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, sql, key):
    note, _ = compare(spark, sql, key, FOLDER)
    assert note.startswith(("ok", "rows only")), note
