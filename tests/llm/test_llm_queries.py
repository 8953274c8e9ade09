import os

import pytest

from compare import DATA, both
from lumenar.llm.queries import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "p1_found": ["post_id:bigint", "other_lang:string", "english_idx:bigint", "other_idx:bigint"],
    "p2_found": ["post_a:bigint", "post_b:bigint", "content_lang:string"],
    "p4_found": ["run_a:bigint", "run_b:bigint"],
    "p6_found": ["page_id:bigint", "line_no:bigint"],
    "p8_ids": ["doc_id:bigint", "ids:array<int>"],
    "p10_found": ["doc_id:bigint"],
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    ours, theirs = both(spark, QUERIES[name], ORACLES[name])
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_and_has_its_columns(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0
    assert name not in COLUMNS or [f"{n}:{t}" for n, t in df.dtypes] == COLUMNS[name]
