"""Scopes built from settings alone."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from restate.operators.shape import extract
from restate.plans.scope_plan import load_plan
from restate.queries import standin as S
from restate.queries.common import current_deltas
from restate.queries.whole_family import PLANS
from restate.sources import io as IO
from restate.sources.manifest import Tables

SF = "/root/testdata/sf0.001"


def test_processed_from_settings_equals_the_hand_made_plan(spark):
    v = S.register(spark, SF, ["hdr_prior", "hdr_inline"])
    plan = load_plan(spark, PLANS, "LINEITEM", sf_dir=SF)
    tables = Tables(spark, IO.scratch_path(spark, "scope"))
    for batch in ("hdr_prior", "hdr_inline"):
        plan.process(tables, batch, v[batch], S.FILTER_COLS)
    cols = ["cobid", "restatement_id", "trade_key", "line_no", "value_local", "value_usd"]
    rows = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert rows(plan.deltas(tables)) == rows(current_deltas(spark, SF)) != []
    total = plan.deltas(tables).agg(F.sum("value_usd")).first()[0]
    assert plan.summary(tables).agg(F.sum("value_usd")).first()[0] == total


def test_requests_with_unknown_filters_are_not_the_scopes(spark):
    plan = load_plan(spark, PLANS, "orders", sf_dir=SF)
    h = S.register(spark, SF, ["hdr_inline"])["hdr_inline"]
    ids = {r[0] for r in h.where(plan.accepted(h, S.FILTER_COLS)).select("restatement_id").collect()}
    assert ids == {1, 4, 6, 11, 12, 13}
    with pytest.raises(KeyError, match="unknown scope"):
        load_plan(spark, PLANS, "nothing")


def upload_plan(spark, tmp_path):
    spark.createDataFrame([("B 1", 7), ("b 1", 9), ("B2", 3)], "code string, k long").write.parquet(str(tmp_path / "books"))
    settings = {"scopes": [{"name": "Wide", "grain": ["cobid", "book_key", "measure"], "metrics": ["usd"], "usd_metric": "usd", "summary": ["cobid", "measure"],
                            "upload": {"keep": {"cobid": "int"}, "text": {"book": "string"}, "measures": ["M1", "M2", "M3"], "measure_type": "decimal(18,2)",
                                       "codes": [{"column": "book", "path": "{root}/books", "code": "code", "key": "k", "out": "book_key"}]}}]}
    path = tmp_path / "plans.json"
    path.write_text(json.dumps(settings))
    return load_plan(spark, str(path), "wide", root=str(tmp_path))


def payload(spark, rows):
    return spark.createDataFrame([(i, None if p is None else json.dumps(p)) for i, p in rows], "restatement_id long, payload string").withColumn(
        "restatement_created_timestamp", F.lit("2024-01-01").cast("timestamp"))


def test_a_wide_upload_and_its_correction(spark, tmp_path):
    plan = upload_plan(spark, tmp_path)
    tables = Tables(spark, IO.scratch_path(spark, "upload"))
    first = [(1, {"cobid": 5, "book": " B 1", "M1": "1.50", "M2": 0, "M3": "x"}), (2, {"cobid": "6", "book": None, "M2": -2}), (3, {"cobid": 5, "M1": ""}), (4, None)]
    assert plan.upload(tables, "one", payload(spark, first))
    rows = lambda: sorted(((r.cobid, r.restatement_id, r.book_key, r.measure, r.usd) for r in plan.deltas(tables).collect()), key=str)
    assert rows() == [(5, 1, 9, "M1", Decimal("1.5")), (6, 2, -1, "M2", Decimal("-2"))]
    # the request's upload again, corrected and on another date: its rows are replaced, others stay
    assert plan.upload(tables, "two", payload(spark, [(1, {"cobid": 7, "book": "b2", "M1": "4", "M3": "5"})]))
    want = [(6, 2, -1, "M2", Decimal("-2")), (7, 1, 3, "M1", Decimal("4")), (7, 1, 3, "M3", Decimal("5"))]
    assert rows() == want
    assert not plan.upload(tables, "two", payload(spark, first)) and rows() == want
    assert sorted((r.cobid, r.measure, r.usd) for r in plan.summary(tables).collect()) == [(6, "M2", Decimal("-2")), (7, "M1", Decimal("4")), (7, "M3", Decimal("5"))]


def test_fields_are_read_by_type(spark):
    df = spark.createDataFrame([(1, '{"a": 1.5, "b": "x", "c": "2"}'), (2, "no json"), (3, None), (4, '{"a": "1e2", "c": null}')], "id int, p string")
    got = {r.id: (r.a, r.b, r.c) for r in extract(df, "p", {"a": "decimal(10,2)", "b": "string", "c": "int"}, keep=["id"]).collect()}
    assert got == {1: (Decimal("1.50"), "x", 2), 2: (None, None, None), 3: (None, None, None), 4: (Decimal("100.00"), None, None)}


def test_codes_are_looked_up_before_rows_become_one_a_measure(spark, tmp_path):
    plan = upload_plan(spark, tmp_path)
    text = plan.upload_rows(payload(spark, [(1, {"cobid": 5, "book": "B 1", "M1": "1"})]))._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Expand") < text.index("Join")  # the tree's root comes first
