"""Structured Streaming jobs.

The reference consumes change feeds in one-minute batches and polls its request
queue.  Here both are Structured Streaming queries over a file source:

* ``cdc_merge_stream`` — each micro-batch is classified (DELETE/INSERT pairing)
  and merged into the target image, of which only the touched hash buckets are read
  and written.  An epoch is one commit: replayed, it finds itself published and does
  nothing (exactly-once in effect).  Offsets live in the checkpoint folder; buckets that
  later epochs replaced are deleted.
* ``poll_stream`` — every trigger re-reads the *current* request table (not only
  the new files), so late arrivals are never stranded; the output is appended.

Use ``trigger(availableNow=True)`` for catch-up runs and
``processingTime='1 minute'`` for the reference's polling cadence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restate.operators.cdc import classify, merge_image
from restate.sources.manifest import Tables


IMAGE, KEPT_COMMITS = "image", 3


def cdc_merge_stream(spark: SparkSession, source_dir: str, source_schema, image_root: str, checkpoint: str,
                     keys, values, deleted_col: str = "is_deleted", trigger: dict | None = None,
                     max_files_per_trigger: int | None = None, seq_col: str | None = None, buckets: int = 64):
    """Start the CDC merge stream; returns the StreamingQuery.

    ``seq_col`` orders the changes of a key, of which a batch of several files may
    hold many; without it such a batch fails instead of merging a wrong image."""

    def merge(batch: DataFrame, epoch_id: int) -> None:
        tables = Tables(batch.sparkSession, image_root)
        changes = classify(batch, keys, values, seq_col=seq_col)
        merge_image(tables, IMAGE, f"epoch.{epoch_id}", changes, keys, values, deleted_col, buckets)
        tables.vacuum(KEPT_COMMITS)

    reader = spark.readStream.schema(source_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def current_image(spark: SparkSession, image_root: str) -> DataFrame:
    image = Tables(spark, image_root).read(IMAGE)
    return image.drop("merge_action", "merge_batch")


def poll_stream(spark: SparkSession, tick_dir: str, tick_schema, read_state, select_eligible, sink_dir: str,
                checkpoint: str, trigger: dict | None = None):
    """Each trigger (a tick file arriving) re-reads the current state via
    ``read_state(spark)`` and appends ``select_eligible(state)`` tagged with the
    epoch id — stateless, at-least-once, idempotent per epoch."""

    def tick(batch: DataFrame, epoch_id: int) -> None:
        if batch.limit(1).count() == 0:
            return  # idle: no tick, no work
        out = select_eligible(read_state(batch.sparkSession)).withColumn("poll_epoch", F.lit(epoch_id))
        out.write.mode("overwrite").parquet(f"{sink_dir}/epoch={epoch_id}")

    stream = spark.readStream.schema(tick_schema).parquet(tick_dir)
    w = stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def status_log_stream(spark: SparkSession, changes_dir: str, schema, history_dir: str, checkpoint: str,
                      trigger: dict | None = None):
    """Header change rows -> append-only history (plain streaming select + file sink)."""
    s = spark.readStream.schema(schema).parquet(changes_dir)
    hist = s.where(F.col("old_status").isNull() | (F.col("old_status") != F.col("new_status")))
    return (hist.writeStream.format("parquet").option("path", history_dir).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(**(trigger or {"availableNow": True})).start())
