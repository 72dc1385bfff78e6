"""Slices, commits of several tables, and merges that touch only some buckets; runs killed between any two steps."""

import pytest
from pyspark.sql import functions as F

from restate.operators.cdc import merge_image
from restate.sources import io as IO
from restate.sources.manifest import Change, Tables


class Killed(Exception):
    pass


def kill_at(n):
    """A step callback that dies at the n-th step."""
    seen = []

    def step(name):
        seen.append(name)
        if len(seen) == n:
            raise Killed(name)
    return step


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def new_tables(spark, name="tables"):
    return Tables(spark, IO.scratch_path(spark, name))


def test_null_and_odd_slices_are_replaced(spark):
    t = new_tables(spark)
    schema = "cobid int, name string, v int"
    old = spark.createDataFrame([(None, None, 1), (None, "a/b=c d%", 2), (1, "null", 3), (1, None, 4), (2, "é", 5)], schema)
    new = spark.createDataFrame([(None, None, 10), (None, "a/b=c d%", 20), (1, None, 40)], schema)
    t.commit("one", {"s": Change(old, by=("cobid", "name"))})
    t.commit("two", {"s": Change(new, by=("cobid", "name"))})
    assert rows(t.read("s")) == rows(spark.createDataFrame([(None, None, 10), (None, "a/b=c d%", 20), (1, "null", 3), (1, None, 40), (2, "é", 5)], schema))
    t.commit("three", {"s": Change(new.limit(0), by=("cobid", "name"), emptied=new)})
    assert rows(t.read("s")) == [(1, "null", 3), (2, "é", 5)]


def test_rows_outside_of_the_named_slices_can_be_left_out(spark):
    t = new_tables(spark)
    df = spark.createDataFrame([(1, 1), (2, 2), (None, 3)], "cobid int, v int")
    t.commit("one", {"s": Change(df, by=("cobid",), emptied=spark.createDataFrame([(1,), (None,)], "cobid int"), only_emptied=True)})
    assert rows(t.read("s")) == [(1, 1), (None, 3)]


def test_a_run_killed_anywhere_and_run_again(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (None, 3)], "cobid int, v int")
    b = spark.createDataFrame([(2, 20), (None, 30)], "cobid int, v int")

    def changes():
        return {"slices": Change(b, by=("cobid",)), "log": Change(b, by=("cobid",), append=True), "gone": Change(b.limit(0), by=("cobid",), emptied=b)}

    def start():
        t = new_tables(spark)
        t.commit("first", {n: Change(a, by=("cobid",)) for n in ("slices", "log", "gone")})
        return t

    whole = start()
    names = []
    whole.commit("second/ü", changes(), step=names.append)
    want = {n: rows(whole.read(n)) for n in ("slices", "log", "gone")}
    assert want["log"] == rows(a.union(b)) and want["gone"] == [(1, 1)]
    for n in range(1, len(names) + 1):
        t = start()
        before = {k: rows(t.read(k)) for k in want}
        with pytest.raises(Killed):
            t.commit("second/ü", changes(), step=kill_at(n))
        # readers see all of the batch or none
        assert {k: rows(t.read(k)) for k in want} == (want if names[n - 1] == "published" else before)
        again = Tables(spark, t.root)
        assert again.commit("second/ü", changes()) == (names[n - 1] != "published")
        assert {k: rows(again.read(k)) for k in want} == want
        again.vacuum(1)
        assert {k: rows(again.read(k)) for k in want} == want


def test_vacuum_keeps_what_is_named(spark):
    t = new_tables(spark)
    df = spark.createDataFrame([(i, i) for i in range(4)], "cobid int, v int")
    for n in range(5):
        t.commit(f"b{n}", {"s": Change(df.where(F.col("cobid") <= n % 2).withColumn("v", F.lit(n)), by=("cobid",))})
    assert t.vacuum(2) > 0
    assert rows(t.read("s")) == [(0, 4), (1, 3)] and t.vacuum(2) == 0
    assert not t.committed("b0") and t.committed("b4")
    with pytest.raises(ValueError, match="columns differ"):
        t.commit("other", {"s": Change(df.withColumn("w", F.lit(1)), by=("cobid",))})


CHANGES = "k string, v int, change_type string"


def test_a_merge_writes_only_the_buckets_it_touches(spark):
    t = new_tables(spark)
    load = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").cast("int").alias("v"), F.lit("I").alias("change_type"))
    load = load.unionByName(spark.createDataFrame([(None, -1, "I")], CHANGES))
    assert merge_image(t, "image", "load", load, ["k"], ["v"], buckets=32)
    first = t.state()["tables"]["image"]["slices"]
    assert len(first) == 32
    change = spark.createDataFrame([("k7", 70, "U"), (None, 0, "D"), ("new", 1, "I"), ("unknown", 1, "D")], CHANGES)
    assert merge_image(t, "image", "change", change, ["k"], ["v"])
    second = t.state()["tables"]["image"]["slices"]
    assert 1 <= sum(first[s] != second[s] for s in first) <= 4
    got = {r["k"]: (r["v"], r["is_deleted"], r["merge_action"], r["merge_batch"]) for r in t.read("image").collect()}
    assert len(got) == 502 and got["k7"] == (70, False, "UPDATE", "change") and got["new"] == (1, False, "INSERT", "change")
    assert got[None] == (-1, True, "DELETE", "change") and got["k8"] == (8, False, "INSERT", "load")
    # replayed: nothing
    assert not merge_image(t, "image", "change", change, ["k"], ["v"])
    assert t.state()["tables"]["image"]["slices"] == second


def test_resurrected_keys_and_an_empty_batch(spark):
    t = new_tables(spark)
    merge_image(t, "image", "1", spark.createDataFrame([("a", 1, "I"), ("b", 2, "I")], CHANGES), ["k"], ["v"], buckets=4)
    merge_image(t, "image", "2", spark.createDataFrame([("a", 1, "D")], CHANGES), ["k"], ["v"])
    merge_image(t, "image", "3", spark.createDataFrame([], CHANGES), ["k"], ["v"])
    merge_image(t, "image", "4", spark.createDataFrame([("a", 5, "I")], CHANGES), ["k"], ["v"])
    assert rows(t.read("image").select("k", "v", "is_deleted", "merge_action")) == [("a", 5, False, "RESURRECT"), ("b", 2, False, "INSERT")]
