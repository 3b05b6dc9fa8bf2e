import os

import pytest

from intentlake.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    pytest.importorskip("duckdb")
    from tests.oracle import both, connect

    got, want = both(spark, connect(FOLDER), queries.queries()[name], queries.oracle_sql()[name], FOLDER)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, FOLDER).count() > 0
