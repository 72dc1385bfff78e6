import random

import pytest
from pyspark.sql import functions as F

from restate.operators import asof
from restate.operators.resolve import rekey, versions_from_events

FACTS = "id long, key string, day date, start string, _row int"
VERSIONS = "key string, start date, stop date, name long"


def day(n):
    import datetime
    return None if n is None else datetime.date(2020, 1, 1) + datetime.timedelta(days=n)


def brute(facts, versions, inclusive=False):
    out = {}
    for i, k, t, *_ in facts:
        fit = [(s, e is None, e or s, n) for x, s, e, n in versions
               if x is not None and x == k and t is not None and s is not None and s <= t and (e is None or t < e or inclusive and t == e)]
        out[i] = max(fit)[3] if fit else None
    return out


def run(spark, facts, versions, **kw):
    f, v = spark.createDataFrame(facts, FACTS), spark.createDataFrame(versions, VERSIONS)
    kw = {"end_col": "stop", "order_cols": ["name"]} | kw
    out = asof.asof_join(f, v, {"key": "key"}, "day", "start", kw.pop("end_col"), {"found": "name", "start2": "start"}, **kw)
    assert out.columns == [*f.columns, "found", "start2"]
    rows = out.collect()
    assert sorted(r["id"] for r in rows) == sorted(f[0] for f in facts)
    return {r["id"]: r["found"] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_and_nested_versions(spark, monkeypatch, seed):
    monkeypatch.setattr(asof, "PIECE_ROWS", 20)
    monkeypatch.setattr(asof, "BUCKETS", 5)
    rng = random.Random(seed)
    keys = ["a", "b", "c", None, "only facts"]
    versions = []
    for n in range(60):
        s = rng.randrange(40)
        versions.append((rng.choice([*keys[:4], "only versions"]), day(rng.choice([s, s, s, None]) if n % 9 == 0 else s), day(rng.choice([None, s, s + 1, s + 5, s + 30])), n))
    facts = [(i, rng.choice([*keys, "a", "a", "a"]), day(rng.choice([None, *range(-3, 60)])), "x", 1) for i in range(600)]
    assert run(spark, facts, versions) == brute(facts, versions)
    assert run(spark, facts, versions, end_exclusive=False) == brute(facts, versions, True)


def test_a_hot_key_and_date_is_dealt_to_pieces(spark, monkeypatch):
    monkeypatch.setattr(asof, "PIECE_ROWS", 50)
    versions = [("hot", day(n), None, n) for n in range(0, 20, 4)]
    facts = [(i, "hot", day(9), None, 0) for i in range(900)] + [(900 + i, f"k{i % 7}", day(9), None, 0) for i in range(100)]
    f, v = spark.createDataFrame(facts, FACTS), spark.createDataFrame(versions, VERSIONS)
    out = asof.asof_join(f, v, {"key": "key"}, "day", "start", None, {"found": "name"}, order_cols=["name"])
    tasks = out.where("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1
    assert {r["found"] for r in out.where("key = 'hot'").collect()} == {8}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "monotonically_increasing_id" not in plan


def test_until_the_next_start_equals_explicit_ends(spark):
    rng = random.Random(3)
    events = spark.createDataFrame([(rng.choice("ab"), day(rng.randrange(30)), n) for n in range(40)], "key string, start date, name long")
    spans = versions_from_events(events, "key", "start", "name", tie="name")
    facts = spark.createDataFrame([(i, rng.choice("ab"), day(rng.randrange(-2, 40)), None, 0) for i in range(200)], FACTS)
    a = asof.asof_join(facts, events, {"key": "key"}, "day", "start", None, {"found": "name"}, order_cols=["name"])
    b = asof.asof_join(facts, spans, {"key": "key"}, "day", "effective_start", "effective_end", {"found": "name"}, order_cols=["name"])
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)


def test_empty_tables(spark):
    facts = [(1, "a", day(3), "x", 1)]
    assert run(spark, facts, []) == {1: None}
    assert run(spark, [], [("a", day(1), None, 1)]) == {}


def test_whole_numbers_as_dates_and_rekey(spark):
    versions = spark.createDataFrame([(1, "x", 10, 20), (2, "x", 20, None), (3, "y", 5, None)], "vk long, nk string, s int, e int")
    facts = spark.createDataFrame([(1, 15), (1, 25), (2, 12), (3, 1), (99, 7), (None, 7)], "vk long, at int")
    got = rekey(facts, versions, "vk", "nk", "vk", "at", "s", "e")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 15), (2, 25), (1, 12), (3, 1), (99, 7), (None, 7)], key=str)
