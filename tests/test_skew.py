"""Hot keys, filters of positions, and merged legs: results as without them, work where it is said to be."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from restate.operators import delta as D
from restate.operators import match as M
from restate.plans import scale as SC

FMAP = {"a": "fa", "b": "fb"}


def match_case(spark):
    """A hot business date with a request on all of it, and many cold keys."""
    facts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 40 + 2).cast("int")).alias("cobid"),
                                     F.col("id").cast("int").alias("i"), F.concat(F.lit("a"), F.col("id") % 7).alias("fa"),
                                     F.when(F.col("id") % 11 != 0, F.concat(F.lit("b"), F.col("id") % 50)).alias("fb"))
    rows = [(1, 0, None, None), (1, 1, "a1", None)] + [(c, c, None, f"B{c} ") for c in range(2, 40)]
    return facts, spark.createDataFrame(rows, "match_cob long, k int, a string, b string")


def test_hot_keys_are_spread_by_their_size_and_cold_ones_are_not_copied(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE_ROWS", 100)
    facts, headers = match_case(spark)
    rows = lambda df: sorted((r.i, r.k) for r in df.collect())
    want = rows(M.wildcard_match(facts, headers, FMAP, strategy="residual"))
    got = M.wildcard_match(facts, headers, FMAP, small=False, sigs=[0, 1, 2])
    assert rows(got) == want and want
    keys = facts.select(F.col("cobid").cast("long").alias("cobid"))
    hot = M.hot_buckets(keys, ["cobid"])
    asked = {r["cobid"]: r["p"] for r in M.with_pieces(keys.distinct(), hot, ["cobid"], "p").collect()}
    assert asked.pop(1) >= 10 and set(asked.values()) == {1}
    # a counter never says less than the key has
    for piece in (1, 7, 1000):
        hot = M.hot_buckets(keys, ["cobid"], piece)
        counts = {r["cobid"]: r["count"] for r in keys.groupBy("cobid").count().collect()}
        for r in M.with_pieces(keys.distinct(), hot, ["cobid"], "p").collect():
            assert r["p"] * piece >= counts[r["cobid"]]


def test_without_rows_there_is_nothing_hot(spark):
    facts, headers = match_case(spark)
    assert M.wildcard_match(facts.limit(0), headers, FMAP, small=False, sigs=[0, 1, 2]).count() == 0
    assert M.wildcard_match(facts, headers.limit(0), FMAP, small=False, sigs=[0]).count() == 0


KEY = ["cobid", "pos", "c"]


def fact_and_deltas(spark):
    fact = spark.range(20_000).select((F.col("id") % 30).cast("int").alias("cobid"), "id", F.when(F.col("id") % 5 != 0, "c").alias("c"),
                                      F.when(F.col("id") % 13 != 0, F.col("id")).cast("decimal(18,2)").alias("v")).withColumnRenamed("id", "pos")
    deltas = fact.where("pos % 97 = 0 AND cobid < 20").select(F.col("cobid").cast("long").alias("cobid"), "pos", "c", F.lit(5).cast("decimal(28,8)").alias("v"))
    only = spark.createDataFrame([(3, -1, None, Decimal(7)), (None, -2, None, Decimal(8)), (3, -1, None, Decimal(1))], "cobid long, pos long, c string, v decimal(28,8)")
    return fact, deltas.unionByName(only).unionByName(deltas.where("cobid = 4"))


@pytest.mark.parametrize("slice_col", [None, "cobid"])
def test_combined_shuffles_only_what_may_have_deltas(spark, slice_col):
    fact, deltas = fact_and_deltas(spark)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = rows(D.combined(fact, deltas, KEY, ["v"], flag_col="f"))
    assert rows(D.combined(fact, deltas, KEY, ["v"], flag_col="f", once=True, slice_col=slice_col)) == want
    assert rows(D.combined(fact, deltas.limit(0), KEY, ["v"], flag_col="f", once=True, slice_col=slice_col)) == rows(fact.withColumn("f", F.lit(False)))
    assert rows(D.combined(fact.limit(0), deltas, KEY, ["v"], once=True, slice_col=slice_col)) == rows(D.combined(fact.limit(0), deltas, KEY, ["v"]))


def test_the_filter_holds_nothing_back_and_little_too_much(spark, monkeypatch):
    fact, deltas = fact_and_deltas(spark)
    deltas = deltas.withColumn("cobid", F.col("cobid").cast("int"))
    matched = fact.join(deltas.select(*KEY).distinct(), KEY, "left_semi")
    n = fact.join(deltas.select(*[F.col(c).alias("d_" + c) for c in KEY]).distinct(),
                  F.col("cobid").eqNullSafe(F.col("d_cobid")) & F.col("pos").eqNullSafe(F.col("d_pos")) & F.col("c").eqNullSafe(F.col("d_c")), "left_semi")
    asked = D.maybe_at(fact, D.position_filter(deltas, KEY), KEY, "m")
    assert n.join(asked.where("m").select("pos"), "pos", "left_anti").count() == 0
    assert matched.count() < asked.where("m").count() <= n.count() + 0.06 * fact.count()
    # a full filter passes all and loses none
    monkeypatch.setattr(D, "MAX_WORDS", 2)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(D.combined(fact, deltas, KEY, ["v"], once=True)) == rows(D.combined(fact, deltas, KEY, ["v"]))


def requests(spark):
    rows = [(1, 1, 1, "Scale", 1.9, "2024-01-01", "e"), (2, 1, 1, "Scale", 1.1, "2024-01-02", "e"), (3, 1, 1, "Flatten", 0.0, "2024-01-03", "e"),
            (4, 1, 2, "Roll", 2.0, "2024-01-01", "e"), (5, 1, 2, "Roll", 1.0, "2024-01-02", "e"), (6, 1, 1, "Scale", 1.0, "2024-02-01", "e"), (7, 1, 1, "Scale", 3.0, "2024-01-01", None)]
    return spark.createDataFrame(rows, "restatement_id long, cobid int, source_cobid int, restatement_type string, f double, d string, entity string").select(
        "restatement_id", "cobid", "source_cobid", "restatement_type", F.col("f").cast("decimal(10,4)").alias("scale_factor"), F.to_timestamp("d").alias("created_date"), "entity")


def test_legs_of_other_factors_merge_only_where_products_are_exact(spark):
    h = requests(spark)
    legs = SC.request_legs(h, ["entity"])
    ids = lambda exact: sorted((r._h_adj, r._h_leg) for r in SC.drop_dominated(legs, ["entity"], exact).collect())
    assert ids(False) == [(1, 1), (2, 1), (3, 1), (4, 2), (4, 3), (5, 2), (5, 3), (7, 1)]
    merged = ids(True)
    assert [x for x in merged if x[1] == 1] == [(3, 1), (7, 1)] and [x for x in merged if x[1] != 1] == [x for x in ids(False) if x[1] != 1]

    def fact(kind, values):
        return spark.createDataFrame([(c, i, "e", Decimal(v)) for c, i, v in values], f"cobid int, pos int, entity string, usd {kind}")
    assert SC.exact_products(fact("decimal(18,2)", []), ["usd"]) and SC.exact_products(fact("decimal(18,4)", []), ["usd"])
    assert not SC.exact_products(fact("decimal(18,5)", []), ["usd"]) and not SC.exact_products(fact("decimal(28,8)", []), ["usd"])
    # two-decimal values: merged legs give what all legs give
    f = fact("decimal(18,2)", [(1, 1, "0.01"), (1, 2, "-5.00"), (1, 3, "0.00"), (2, 1, "7.25"), (1, 4, "3.33")])
    full = SC.scale_legs(f, h, {"entity": "entity"}, ["cobid", "pos"], ["usd"], None, dominated=False)
    net = D.net_positions(full, ["cobid", "pos"], "restatement_id", ["usd"], "usd", carry_max=("restatement_created_timestamp",))
    want = D.rank_latest(net, ["cobid", "pos"], "restatement_created_timestamp", "restatement_id", "window")
    cols = ["cobid", "pos", "restatement_id", "usd"]
    got = SC.apply_scale(f, h, {"entity": "entity"}, ["cobid", "pos"], ["usd"], "usd")
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect())) != []


def _legs_example(spark):
    fact = spark.createDataFrame([(1, 1, "a", 10.0), (1, 1, "a", 5.0), (1, 2, "b", 7.0), (2, 1, "a", 4.0), (2, None, "a", 3.0), (1, None, "b", 2.0),
                                  (1, 3, None, 9.0), (None, 4, "a", 8.0), (2, 5, "b", 6.0)], "cobid int, pos long, entity string, usd double")
    fact = fact.withColumn("usd", F.col("usd").cast("decimal(18,2)"))
    head = [(1, 1, 1, "Scale", "1.5", "2024-01-01 00:00:00", "A"), (2, 1, 1, "Flatten", "1", "2024-01-02 00:00:00", "b"),
            (3, 1, 2, "Roll", "2", "2024-01-03 00:00:00", "a"), (4, 1, 1, "Scale", "1.1", "2023-01-03 00:00:00", None),
            (5, 2, 1, "Roll", "1", "2024-01-03 00:00:00", "b"), (6, 1, 1, "Scale", "1", "2025-01-03 00:00:00", None)]
    h = spark.createDataFrame(head, "restatement_id long, cobid int, source_cobid int, restatement_type string, f string, c string, entity string")
    h = h.select("*", F.col("f").cast("decimal(12,4)").alias("scale_factor"), F.to_timestamp("c").alias("created_date"))
    return fact, h.drop("f", "c")


@pytest.mark.parametrize("rows, task_rows", [(1_000_000, 200_000), (2, 3)])
def test_legs_of_broadcast_requests_are_not_shuffled(spark, monkeypatch, rows, task_rows):
    monkeypatch.setattr(SC, "SMALL_FACT", rows)
    monkeypatch.setattr(SC, "POSITION_ROWS", task_rows)
    f, h = _legs_example(spark)
    got = SC.apply_scale(f, h, {"entity": "entity"}, ["cobid", "pos"], ["usd"], "usd")
    plan = got._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len([x for x in moved if "pos#" in x]) == 1 and not any("restatement_id" in x for x in moved)
    # legs as they are, netted and ranked by the plain window
    legs = SC.scale_legs(f, h, {"entity": "entity"}, ["cobid", "pos"], ["usd"])
    net = D.net_positions(legs, ["cobid", "pos"], "restatement_id", ["usd"], "usd", carry_max=("restatement_created_timestamp",))
    want = D.rank_latest(net, ["cobid", "pos"], "restatement_created_timestamp", "restatement_id", "window")
    cols = ["cobid", "pos", "restatement_id", "restatement_created_timestamp", "usd"]
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect())) and want.count() > 4
