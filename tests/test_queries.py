import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck
from checks.oracle import ORACLE

SF = os.environ.get("KINDRED_TEST_DIR", "/root/testdata/sf0.001")
NAMES = sorted(ORACLE)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql_or_a_reason():
    ours = {n for n in entry.queries() if n != "pipeline" and not n.startswith("op")}
    assert ours == {n for n in entry.oracle_sql() if n != "pipeline" and not n.startswith("op")}


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["from_id", "to_id"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(name, entry.queries()[name](spark, SF), con) == ""
