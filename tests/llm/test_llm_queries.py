"""Queries of the subpackage against their SQL on the given tables."""

import compare
import pytest

from rivertrack.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    ours = QUERIES[name](spark, SF_DIR).toPandas()
    theirs = con.execute(ORACLE[name]).fetchdf()
    assert len(ours) > 0
    assert compare.differences(ours, theirs) is None
