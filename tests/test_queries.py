import os

import pytest

from intentlake.plans import catalogue, catalogue_runs  # noqa: F401

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    from tests.oracle import connect

    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    from tests.oracle import both

    got, want = both(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name], FOLDER)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, FOLDER).count() > 0
