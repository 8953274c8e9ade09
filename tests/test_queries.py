import os

import pytest

from compare import DATA, both
from lumenar.plans import general_queries, media_queries

QUERIES = general_queries.QUERIES | media_queries.QUERIES
ORACLES = general_queries.ORACLES | media_queries.ORACLES
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    ours, theirs = both(spark, QUERIES[name], ORACLES[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0
