"""Rounding, repeated changes, re-runs and emptied slices."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from restate.operators import cdc as CDC
from restate.operators import match as M
from restate.operators import overlap as O
from restate.plans import scale as SC
from restate.sources import io as IO
from restate.sources.manifest import Change, Tables


def test_pruning_keeps_the_newest_request_that_does_not_round_to_zero(spark):
    """Products are rounded to eight decimals: a tiny value times 0.1 is nothing, times 0.9 it is not."""
    fact = spark.createDataFrame([(20240101, 1, "e", Decimal("0.00000001"))], "cobid int, pos int, entity string, usd decimal(28,8)")
    rows = [(1, 20240101, 20240101, "Scale", 1.9, "2024-01-01", "e"), (2, 20240101, 20240101, "Scale", 1.1, "2024-01-02", "e")]
    h = spark.createDataFrame(rows, "adj int, cobid int, source_cobid int, kind string, f double, d string, entity string").select(
        F.col("adj").cast("long").alias(SC.HEADER_COLS[0]), "cobid", "source_cobid", F.col("kind").alias(SC.HEADER_COLS[3]),
        F.col("f").cast("decimal(10,4)").alias("scale_factor"), F.to_timestamp("d").alias("created_date"), "entity")
    got = SC.apply_scale(fact, h, {"entity": "entity"}, ["cobid", "pos"], ["usd"], "usd").collect()
    assert [(r[SC.HEADER_COLS[0]], r.usd) for r in got] == [(1, Decimal("0.00000001"))]


def test_many_signatures_join_in_parts(spark, monkeypatch):
    cols = ["a", "b", "c"]
    facts = spark.createDataFrame([(1, i, f"a{i % 2}", f"b{i % 3}", f"c{i % 5}") for i in range(30)], "cobid int, i int, fa string, fb string, fc string")
    headers = spark.createDataFrame([(1, k, *[f"{c}{k % 2}" if k >> j & 1 else None for j, c in enumerate(cols)]) for k in range(8)],
                                    "match_cob int, k int, a string, b string, c string")
    fmap = {"a": "fa", "b": "fb", "c": "fc"}
    rows = lambda df: sorted((r.i, r.k) for r in df.collect())
    want = rows(M.wildcard_match(facts, headers, fmap, strategy="residual"))
    assert rows(M.wildcard_match(facts, headers, fmap)) == want
    monkeypatch.setattr(M, "SIGNATURES_PER_JOIN", 3)
    assert rows(M.wildcard_match(facts, headers, fmap)) == want and want


def test_first_blocker_is_never_itself(spark):
    h = spark.createDataFrame([("x", 1, 1, "E"), ("y", 1, 2, "E"), ("z", 1, 3, None), ("w", 1, 4, "F"), ("v", 2, 1, None)],
                              "id string, g int, created int, e string")
    got = {r.id: r.blocked_by for r in O.first_blocker(h, h, "id", ["e"], ["g"], "created").collect()}
    assert got == {"x": "y", "y": "x", "z": "x", "w": "z"}
    got = {r.id: r.blocked_by for r in O.first_blocker(h, h, "id", ["e"], ["g"], "created", older_only=True).collect()}
    assert got == {"y": "x", "z": "x", "w": "z"}


CHANGES = "k string, v int, action string, n int"


def test_several_changes_of_a_key(spark):
    rows = [("a", 0, "DELETE", 1), ("a", 1, "INSERT", 1), ("a", 1, "DELETE", 2), ("a", 2, "INSERT", 2),  # updated twice
            ("b", 5, "INSERT", 1), ("b", 5, "DELETE", 2),  # came and went
            ("c", 7, "DELETE", 1), ("c", 8, "INSERT", 2), ("c", 8, "DELETE", 3),  # gone in the end
            ("d", 3, "DELETE", 1), ("d", 3, "INSERT", 2), (None, 1, "INSERT", 1), (None, 1, "DELETE", 2), (None, 4, "INSERT", 3)]
    batch = spark.createDataFrame(rows, CHANGES)
    got = {(r.k, r.v, r.change_type) for r in CDC.classify(batch, ["k"], ["v"], seq_col="n").collect()}
    assert got == {("a", 2, "U"), ("c", 7, "D"), (None, 4, "I")}
    with pytest.raises(Exception, match="several changes of a key"):
        CDC.classify(batch, ["k"], ["v"]).collect()


def test_batches_and_slices_can_run_again(spark):
    tables = Tables(spark, IO.scratch_path(spark, "t"))
    df = spark.createDataFrame([(1, 10.0), (2, 20.0)], "cobid int, v double")
    for _ in range(2):
        tables.commit("b1", {"t": Change(df, by=("cobid",), append=True)})
    tables.commit("b2", {"t": Change(df, by=("cobid",), append=True)})
    assert tables.read("t").agg(F.sum("v")).first()[0] == 60.0
    tables = Tables(spark, IO.scratch_path(spark, "t"))
    tables.commit("b1", {"t": Change(df, by=("cobid",), emptied=df)})
    tables.commit("b2", {"t": Change(df.where("cobid = 2").withColumn("v", F.lit(5.0)), by=("cobid",), emptied=df)})  # slice 1 has no rows any more
    assert [(r.cobid, r.v) for r in tables.read("t").collect()] == [(2, 5.0)]
    tables.commit("b3", {"t": Change(df.limit(0), by=("cobid",), emptied=spark.createDataFrame([(9,)], "cobid int"))})
    assert tables.read("t").count() == 1


def test_stream_with_several_changes_in_a_batch(spark):
    from restate.streaming.jobs import cdc_merge_stream, current_image
    src, ckpt, root = (IO.scratch_path(spark, n) for n in ("t-src", "t-ckpt", "t-img"))
    spark.createDataFrame([("a", 0, "INSERT", 1), ("a", 0, "DELETE", 2), ("a", 3, "INSERT", 2)], CHANGES).write.parquet(src)
    cdc_merge_stream(spark, src, spark.read.parquet(src).schema, root, ckpt, ["k"], ["v"], seq_col="n").awaitTermination()
    assert [(r.k, r.v) for r in current_image(spark, root).collect()] == [("a", 3)]
