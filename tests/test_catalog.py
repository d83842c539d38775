"""Every registered query against its SQL counterpart on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from catalog.queries import ORACLES, QUERIES  # noqa: E402
from tests.verify import check, oracle_connection  # noqa: E402

SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"
# The SQL of these names the relationships and chosen columns that hold from sf0.01 on.
LARGER = {"schema_summary", "auto_breakdowns"}


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in LARGER])
def test_query(spark, con, name):
    assert check(spark, con, name, SF) is None


@pytest.mark.skipif(not os.path.isdir(SF_LARGER), reason="given tables not present")
@pytest.mark.parametrize("name", sorted(LARGER))
def test_query_on_more_rows(spark, name):
    assert check(spark, oracle_connection(SF_LARGER), name, SF_LARGER) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
