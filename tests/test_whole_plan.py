"""Work where it is said to be: rows that are not moved, dimensions that are not joined."""

from pyspark.sql import functions as F

from restate.operators import delta as D
from restate.queries import standin as S
from restate.queries import whole_family as W
from restate.sources.manifest import Change, Tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_with_repeated_keys_share_flags_without_a_shuffle_of_rows(spark):
    rows = [(1, 1, True, "a"), (1, 1, False, "b"), (2, 1, False, "c"), (None, 1, True, "d"), (None, 1, False, "e"), (3, 1, None, "f")]
    df = spark.createDataFrame(rows, "k int, l int, ok boolean, text string")
    got = D.share_repeated(df, ["k", "l"], ["ok"])
    assert "Exchange hashpartitioning" not in _plan(got)
    assert {r["text"]: r["ok"] for r in got.collect()} == {"a": True, "b": True, "c": False, "d": True, "e": False, "f": None}


def test_moves_meet_only_the_dimensions_that_they_filter_on(spark):
    row = dict.fromkeys(S.FILTER_COLS)
    schema = "adj_key string, cobid int, source_cobid int, restatement_type string, scale_factor decimal(10,4), " + ", ".join(f"{c} string" for c in S.FILTER_COLS)
    h = spark.createDataFrame([("r", 1, 2, "Roll", None, *({**row, "entity_code": "E"}).values())], schema)
    fact = spark.createDataFrame([(1, 5, 1, 7, 9, "R", "O"), (2, 6, 1, 8, 9, "R", "O")], "cobid int, trade_key long, line_no int, book_key long, instrument_key long, source_system_code string, currency_code string")
    v = {"fact": fact.withColumn("value_usd", F.lit(3).cast("decimal(18,2)")),
         "book_dim": spark.createDataFrame([(7, "e", "D", "B"), (8, "x", "D", "B")], "book_key long, entity_code string, department_code string, book_code string")}
    # no trade_dim and no instrument_dim is asked for
    assert [r["trade_key"] for r in W._matched(v, h, "target").collect()] == [5]
    assert W._matched(v, h, "source").collect() == []


def test_one_slice_is_written_without_a_shuffle(spark, tmp_path):
    rows = spark.range(100, numPartitions=4).withColumn("batch", F.lit("b"))
    tables = Tables(spark, str(tmp_path / "t"))
    assert tables.commit("b", {"log": Change(rows, by=("batch",), one_slice=True)})
    assert sorted(r["id"] for r in tables.read("log").collect()) == list(range(100))
    assert len([f for f in (tmp_path / "t" / "data").rglob("*.parquet")]) == 4
