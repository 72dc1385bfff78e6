"""The composed run: tables after kills and repeats, and the summary against a sum over the whole delta table."""

import shutil
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from restate.plans import process as P
from restate.plans.process import DELTAS, HISTORY, LOG, TRIGGERS, Scope, load, process, remove
from restate.plans.summary import SummaryView, signed
from restate.sources import io as IO
from restate.sources.manifest import Tables
from fixtures import FILTER_MAP, POSITION, headers, star_fact
from test_manifest import Killed, kill_at, rows

SCOPE = Scope(POSITION, ("amount",), "amount", FILTER_MAP, ("cobid", "entity_key", "restatement_id"))
FIRST = [(1, 20260223, None, "Scale", 1.1, "2026-02-25 10:00:00", "US_BANK", None, None),
         (2, 20260224, None, "Flatten", 0, "2026-02-25 11:00:00", None, "FX_SPOT", None)]
SECOND = [(3, 20260224, 20260223, "Roll", 1.0, "2026-02-26 10:00:00", "US_BANK", None, None),
          (4, 20260223, None, "Scale", 3, "2026-02-26 11:00:00", None, "IR_SWAP", None),
          (5, 20260223, None, "Scale", 2, "2026-02-26 11:00:00", "NO_BANK", None, None)]


def new_tables(spark):
    return Tables(spark, IO.scratch_path(spark, "process"))


def run(spark, tables, name, requests, **kw):
    return process(tables, SCOPE, name, headers(spark, requests), star_fact(spark), **kw)


def contents(tables):
    out = {n: rows(tables.read(n)) for n in (DELTAS, LOG, HISTORY, TRIGGERS) if tables.exists(n)}
    return out | ({"summary": rows(SCOPE.summary(tables).read())} if tables.exists("summary") else {})


def summed(tables):
    return rows(tables.read(DELTAS).groupBy(*SCOPE.summary_cols).agg(F.sum("amount").alias("amount")))


def test_batches_supersede_and_the_summary_follows(spark):
    t = new_tables(spark)
    assert run(spark, t, "first", FIRST)
    assert contents(t)["summary"] == summed(t)
    before = t.state()["tables"]["summary"]["slices"]
    assert run(spark, t, "second", SECOND)
    got = contents(t)
    assert got["summary"] == summed(t) and got["summary"]
    # one delta row a position and newest request, and the log's signs add up to the delta table
    assert t.read(DELTAS).groupBy(*POSITION).count().where("count > 1").count() == 0
    net = t.read(LOG).groupBy(*POSITION, "restatement_id").agg(F.sum("_sign").alias("n")).where("n <> 0")
    assert net.count() == t.read(DELTAS).count() and net.where("n <> 1").count() == 0
    assert {r["restatement_id"]: r["record_count"] for r in t.read(HISTORY).collect()}[5] == 0
    assert not run(spark, t, "second", SECOND) and contents(t) == got
    assert remove(t, SCOPE, "retry", spark.createDataFrame([(2,), (4,), (77,), (None,)], "restatement_id long"))
    assert {r["restatement_id"] for r in t.read(DELTAS).collect()} == {1, 3}
    assert contents(t)["summary"] == summed(t)
    assert before  # the first run made it


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_killed_between_any_two_steps(spark, few_partitions):
    start, names = new_tables(spark), []
    run(spark, start, "first", FIRST)

    def copy():
        t = new_tables(spark)
        shutil.copytree(start.root, t.root)
        return t

    whole = copy()
    run(spark, whole, "second", SECOND, step=names.append)
    want = contents(whole)
    assert names.count("publish") == 2  # tables, then the summary
    # every kind of step, of the tables' commit and of the summary's (test_manifest kills at each one)
    told = [n for n, name in enumerate(names, 1) if name in ("stage deltas", "stage summary", "publish", "published")]
    assert len(told) == 6
    for n in told[:-1]:
        name, t = names[n - 1], copy()
        with pytest.raises(Killed):
            run(spark, t, "second", SECOND, step=kill_at(n))
        again = Tables(spark, t.root)
        run(spark, again, "second", SECOND)
        assert contents(again) == want, name


def view(spark, **kw):
    return SummaryView(new_tables(spark), "v", ("cobid", "g"), ("d", "n"), ("cobid",), **kw)


def frame(spark, data):
    return spark.createDataFrame([(c, g, None if d is None else Decimal(d), n) for c, g, d, n in data], "cobid int, g string, d decimal(18,2), n long")


def test_signed_changes_equal_summing_again(spark):
    import random
    rng = random.Random(6)
    v, live = view(spark), []
    for batch in range(6):
        new = [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None]), rng.choice([None, f"{rng.randrange(-99, 99)}.25"]), rng.choice([None, 0, 5])) for _ in range(12)]
        gone = [live.pop(rng.randrange(len(live))) for _ in range(min(len(live), 9))]
        live += new
        v.apply(f"b{batch}", signed(frame(spark, new), 1).unionByName(signed(frame(spark, gone), -1)))
        want = frame(spark, live).groupBy("cobid", "g").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
        assert rows(v.read()) == rows(want)
    assert not v.apply("b0", signed(frame(spark, live), 1))
    v.apply("all gone", signed(frame(spark, live), -1))
    assert v.read().count() == 0


def test_only_touched_slices_are_written_and_impossible_changes_fail(spark):
    v = view(spark)
    v.apply("a", signed(frame(spark, [(c, "x", "1.00", 1) for c in range(10)]), 1))
    before = v.tables.state()["tables"]["v"]["slices"]
    v.apply("b", signed(frame(spark, [(3, "x", "1.00", 1), (11, "y", "2.00", 1)]), 1))
    after = v.tables.state()["tables"]["v"]["slices"]
    assert len(after) == 11 and sum(before[s] == after[s] for s in before) == 9
    with pytest.raises(Exception, match="never had"):
        v.apply("c", signed(frame(spark, [(4, "x", "1.00", 1)] * 2), -1))
    with pytest.raises(TypeError):
        v.apply("d", signed(spark.createDataFrame([(1, "x", 0.5, 1)], "cobid int, g string, d double, n long"), 1))


def test_rows_that_come_or_leave_are_stored_once(spark):
    t = new_tables(spark)
    run(spark, t, "first", FIRST)
    run(spark, t, "second", SECOND)
    tables = t.state()["tables"]
    named = {n: {f for parts in tables[n]["slices"].values() for f, _ in parts} for n in (DELTAS, LOG)}
    # the log reads what came from the files of the delta table, and its own files hold what left only
    came, left = ({f for f in named[LOG] if f.startswith(f"data/{name}/")} for name in (DELTAS, LOG))
    assert came and left and came | left == named[LOG]
    signs = {n: {r["_sign"] for r in spark.read.parquet(*[f"{t.root}/{f}" for f in fs]).select("_sign").collect()} for n, fs in (("came", came), ("left", left))}
    assert signs == {"came": {1}, "left": {-1}}
    assert not {"_sign", "batch"} & set(t.read(DELTAS).columns)
    t.vacuum(1)
    assert contents(t)["summary"] == summed(t) and t.read(LOG).count() > t.read(DELTAS).count()


def test_other_types_than_the_tables_are_refused(spark):
    t = new_tables(spark)
    run(spark, t, "first", FIRST)
    state, wide = t.state(), t.read(DELTAS).withColumn("amount", F.col("amount").cast("double"))
    with pytest.raises(ValueError, match="columns"):
        load(t, SCOPE, "wide", wide)
    assert t.state() == state


def test_rows_meet_the_ids_of_a_clean_up_without_a_shuffle(spark):
    t = new_tables(spark)
    run(spark, t, "first", FIRST)
    ids = P._ids(spark.range(300_000).select(F.col("id").alias("restatement_id")).union(spark.createDataFrame([(None,), (1,)], "restatement_id long")))
    for how in ("left_semi", "left_anti"):
        plan = P._of(t.read(DELTAS), ids, how)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
