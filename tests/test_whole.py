"""Queries over every request, slice or batch, against their oracle, and what the one-slice queries leave out."""

import pytest

from restate.queries import all_queries
from test_oracle import SF, _rows, duck  # noqa: F401

WHOLE = ["prj_delta_pointwise_all", "adj_create_items_all", "jn_roll_left_all", "adj_legacy_roll_all", "src_csv_upload_all",
         "adj_business_checks_all"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_query_matches_oracle(spark, duck, name):  # noqa: F811
    query = all_queries()[name]
    df = query.build(spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(query.sql)
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert got and _rows(df.columns, got) == _rows(cols, cur.fetchall())


def test_more_than_one_slice(spark):
    def column(name, col):
        return {r[0] for r in all_queries()[name].build(spark, SF).select(col).distinct().collect()}
    assert column("prj_delta_pointwise_all", "restatement_type") >= {"Flatten", "Scale", "Roll"}
    assert len(column("jn_roll_left_all", "adj_key")) > 1 and len(column("adj_legacy_roll_all", "adj_key")) > 1
    assert len(column("src_csv_upload_all", "BATCH_ID")) > 1 and len(column("adj_business_checks_all", "restatement_id")) == 13
