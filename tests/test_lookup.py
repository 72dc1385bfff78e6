"""Lookups without a join of rows with themselves, and broadcasts by measured size."""

import random

from pyspark.sql import functions as F

from restate.operators import match as M
from restate.operators.resolve import resolve_qualified, unique_id
from restate.operators.validate import qualified_hit

DIM = "code string, entity string, dept string, k long"


def norm(x):
    return None if x is None else x.strip().upper()


def test_qualified_lookup_equals_trying_every_reference_row(spark):
    rng = random.Random(9)
    pick = lambda xs: rng.choice(xs)
    dim = [(pick(["A", "b ", "C", None]), pick(["e1", "E2", None, ""]), pick(["d1", "d2", None]), i) for i in range(40)]
    rows = [(i, pick(["a", "B", " c", "x", None]), pick(["e1", "e2 ", None, "", "zz"]), pick(["D1", "d2", None])) for i in range(150)] + [(0, "a", None, None)] * 3
    df, ref = spark.createDataFrame(rows, "id long, code string, entity string, dept string"), spark.createDataFrame(dim, DIM)
    q = {"entity": "entity", "dept": "dept"}

    def fits(r):
        return [d[3] for d in dim if norm(r[1]) is not None and norm(r[1]) == norm(d[0])
                and all(r[c] is None or (d[c - 1] is not None and norm(r[c]) == norm(d[c - 1])) for c in (2, 3))]
    got = resolve_qualified(df, ref, "code", "code", "k", q, "key").collect()
    assert sorted(map(str, ((r.id, r.key) for r in got))) == sorted(map(str, ((r[0], max(fits(r), default=-1)) for r in rows)))
    hit = qualified_hit(df, ref, "code", "code", q, "hit").collect()
    assert sorted((r.id, r.hit) for r in hit) == sorted((r[0], bool(fits(r))) for r in rows)


def test_unique_id_only_where_one_id_matches(spark):
    dim = spark.createDataFrame([("a", "x", None, 1), ("A ", "x", None, 1), ("b", "x", None, 2), ("b", "X", None, 3), (None, "x", None, 4)], DIM)
    df = spark.createDataFrame([(1, "A", "x"), (2, "b", "x"), (3, "c", "x"), (4, None, "x"), (1, "A", "x")], "id int, code string, entity string")
    got = sorted(((r.id, r.found) for r in unique_id(df, dim, {"code": "code", "entity": "entity"}, "k", "found").collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, None), (3, None), (4, None)]


def test_broadcasts_are_bound_by_rows_and_bytes(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    assert M.sized_broadcast(df, 1000)[1] and not M.sized_broadcast(df, 999)[1]
    assert not M.sized_broadcast(df, 1000, 900_000)[1] and M.sized_broadcast(df.limit(0), 0, 0)[1]


def test_a_reason_that_is_cut_is_told(spark):
    from restate.functions.text import compose_reason, reason_is_cut
    df = spark.createDataFrame([("A", "x" * 6), ("", "x" * 7), (None, "x" * 11), ("A", None)], "c string, r string")
    got = df.select(compose_reason("c", "r", 10).alias("t"), reason_is_cut("c", "r", 10).alias("cut")).collect()
    assert [(r.t, r.cut) for r in got] == [("A | xxxxxx", False), ("xxxxxxx", False), ("x" * 10, True), ("A", False)]
