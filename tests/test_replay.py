"""Replay safety: re-applying a change batch or restarting a stream changes nothing."""

from pyspark.sql import functions as F

from restate.operators import cdc as CDC
from restate.sources import io as IO
from restate.streaming.jobs import cdc_merge_stream, current_image

KEYS, VALS = ["k"], ["v"]


def _img(df):
    return sorted(tuple(r) for r in df.select("k", "v", "is_deleted").collect())


def test_merge_is_idempotent(spark):
    target = spark.createDataFrame([("a", 1, False), ("b", 2, False), ("c", 3, False)], "k string, v int, is_deleted boolean")
    batch = spark.createDataFrame([("a", 1, "DELETE"), ("b", 2, "DELETE"), ("b", 5, "INSERT"), ("d", 4, "INSERT")],
                                  "k string, v int, action string")
    ch = CDC.classify(batch, KEYS, VALS)
    once = CDC.upsert(target, ch, KEYS, VALS)
    twice = CDC.upsert(once.drop("merge_action"), ch, KEYS, VALS)
    assert _img(once) == _img(twice) == [("a", 1, True), ("b", 5, False), ("c", 3, False), ("d", 4, False)]


def test_stream_restart_without_new_files_keeps_image(spark):
    src, ckpt, root = (IO.scratch_path(spark, n) for n in ("t-src", "t-ckpt", "t-img"))
    spark.createDataFrame([("a", 1, "INSERT"), ("b", 2, "INSERT")], "k string, v int, action string") \
        .coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    cdc_merge_stream(spark, src, schema, root, ckpt, KEYS, VALS).awaitTermination()
    first = _img(current_image(spark, root))
    cdc_merge_stream(spark, src, schema, root, ckpt, KEYS, VALS).awaitTermination()  # restart, nothing new
    assert _img(current_image(spark, root)) == first == [("a", 1, False), ("b", 2, False)]
    spark.createDataFrame([("a", 1, "DELETE")], "k string, v int, action string").coalesce(1) \
        .write.mode("append").parquet(src)
    cdc_merge_stream(spark, src, schema, root, ckpt, KEYS, VALS).awaitTermination()
    assert _img(current_image(spark, root)) == [("a", 1, True), ("b", 2, False)]
