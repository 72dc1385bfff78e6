"""Factorised overlaps against all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from restate.operators import factored as FO
from restate.operators.overlap import narrower_pairs, queue_order
from restate.operators.shape import row_numbers

DIMS, GROUP = ["d1", "d2", "d3"], ["g", "h"]


def requests(spark, seed, n=120):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        data.append((f"r{i:03}", rng.choice([1, 1, 2, None]), rng.choice(["x", "x", "y"]), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(40)),
                     *[rng.choice([None, "A", "a ", "b"]) for _ in DIMS]))
    return data, spark.createDataFrame(data, "id string, g int, h string, made timestamp, d1 string, d2 string, d3 string")


def overlapping(a, b):
    same = lambda x, y: x is None or y is None or x.strip().upper() == y.strip().upper()
    return a[0] != b[0] and a[1] is not None and a[1:3] == b[1:3] and all(same(x, y) for x, y in zip(a[4:], b[4:]))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_nodes_and_expansion_equal_all_pairs(spark, seed):
    data, df = requests(spark, seed)
    pairs = {(a[0], b[0]) for a in data for b in data if overlapping(a, b)}
    links = {r["id"]: r["links"] for r in FO.overlap_links(df, "id", DIMS, GROUP, "made").collect()}
    assert links == {a[0]: sum(p[0] == a[0] for p in pairs) for a in data}
    classes = FO.overlap_classes(df, "id", DIMS, GROUP, "made")
    nodes = FO.overlap_nodes(classes, DIMS, GROUP).collect()
    assert 2 * sum(r["pairs"] for r in nodes) == len(pairs)
    made = {a[0]: a[3] for a in data}
    for r in nodes:
        assert (r["rep_a"], r["rep_b"]) in pairs
    assert len({frozenset((r["rep_a"], r["rep_b"])) for r in nodes}) == len(nodes) and made
    # nodes follow requests and signatures, not pairs
    assert len(nodes) <= 8 * len(data)
    chosen = [data[3], data[77]]
    got = FO.expand(df, df.where(F.col("id").isin([c[0] for c in chosen])), "id", DIMS, GROUP).collect()
    assert sorted(map(tuple, got)) == sorted(p for p in pairs if p[0] in {c[0] for c in chosen})


def test_many_equal_requests_are_one_class(spark):
    df = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("id"), F.lit(1).alias("g"), F.lit("x").alias("h"),
                                  F.timestamp_seconds("id").alias("made"), F.lit("A").alias("d1"), F.lit(None).cast("string").alias("d2"), F.lit("b").alias("d3"))
    classes = FO.overlap_classes(df, "id", DIMS, GROUP, "made").collect()
    assert [(c["members"], c["first"]["id"], c["second"]["id"]) for c in classes] == [(3000, "r0", "r1")]
    nodes = FO.overlap_nodes(FO.overlap_classes(df, "id", DIMS, GROUP, "made"), DIMS, GROUP).collect()
    assert [(n["pairs"], n["rep_a"], n["rep_b"]) for n in nodes] == [(3000 * 2999 // 2, "r0", "r1")]
    assert FO.overlap_links(df, "id", DIMS, GROUP, "made").where("links <> 2999").count() == 0


def test_narrower_links_equal_narrower_pairs(spark):
    _, df = requests(spark, 3)
    a, b = df.where("id < 'r060'"), df.where("id >= 'r040'")
    pairs = [(r["a_id"], r["b_made"], r["b_id"]) for r in narrower_pairs(a, b, "id", DIMS, ["g"], "made").collect()]
    want = {}
    for i, made, other in sorted(pairs):
        want.setdefault(i, []).append(other)
    got = {r["id"]: (r["older"], r["oldest"], r["newest"]) for r in FO.narrower_links(a, b, "id", DIMS, ["g"], "made").collect()}
    assert got == {i: (len(o), o[0], o[-1]) for i, o in want.items()} and got


LISTS = ["p", "q"]


@pytest.mark.parametrize("lists", [["p"], LISTS])
def test_list_links_equal_all_pairs(spark, lists):
    rng = random.Random(7)
    data = [(i, rng.choice([1, 2, None]), *[rng.choice([None, [], [rng.choice("abcd") for _ in range(rng.randrange(1, 4))], ["a", None, "a"]]) for _ in LISTS]) for i in range(90)]
    df = spark.createDataFrame(data, "id long, g int, p array<string>, q array<string>")
    take = [LISTS.index(x) for x in lists]

    def meet(a, b):
        return a[0] != b[0] and a[1] is not None and a[1] == b[1] and all(
            not a[2 + i] or not b[2 + i] or set(a[2 + i]) & set(b[2 + i]) - {None} for i in take)
    pairs = {(a[0], b[0]) for a in data for b in data if meet(a, b)}
    links = {r["id"]: r["links"] for r in FO.list_links(df, "id", lists, ["g"]).collect()}
    assert links == {a[0]: sum(p[0] == a[0] for p in pairs) for a in data}
    got = [(r["a_id"], r["b_id"]) for r in FO.expand_lists(df, "id", lists, ["g"]).collect()]
    assert sorted(got) == sorted(p for p in pairs if p[0] < p[1])
    some = df.where("id % 30 = 0")
    got = [(r["a_id"], r["b_id"]) for r in FO.expand_lists(df, "id", lists, ["g"], some).collect()]
    assert sorted(got) == sorted(p for p in pairs if p[0] % 30 == 0)


def test_empty_tables(spark):
    _, df = requests(spark, 1, 1)
    none = df.limit(0)
    assert FO.overlap_links(none, "id", DIMS, GROUP, "made").count() == 0
    assert FO.narrower_links(df, none, "id", DIMS, ["g"], "made").count() == 0
    assert FO.narrower_links(none, df, "id", DIMS, ["g"], "made").count() == 0
    lists = spark.createDataFrame([], "id long, g int, p array<string>")
    assert FO.list_links(lists, "id", ["p"], ["g"]).count() == 0


def test_queues_and_numbers_with_null_groups(spark):
    df = spark.createDataFrame([(None, 3, "a"), (None, None, "b"), (None, 1, "c"), (1, 2, "d"), (1, 2, "e")], "g int, t int, id string")
    got = {r["id"]: r["queue_pos"] for r in queue_order(df, ["g"], "t", "id").collect()}
    assert got == {"c": 1, "a": 2, "b": 3, "d": 1, "e": 2}
    got = {r["id"]: r["n"] for r in row_numbers(df, ["g"], ["t"], "n").where("g IS NULL").collect()}
    assert got == {"b": 1, "c": 2, "a": 3}
