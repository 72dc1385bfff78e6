"""Registered queries: CDC classify/merge, missing-as-delete, latest version,
changed-vs-registry, status log, streaming jobs, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from restate.operators import cdc as CDC
from restate.operators import delta as D
from restate.queries import standin as S
from restate.queries.common import Query, doubles, run_scale, scale_sql
from restate.plans.summary import SummaryView, signed
from restate.sources import io as IO
from restate.sources.manifest import Change, Tables

QUERIES: list[Query] = []


def q(name, sql=None):
    def deco(fn):
        QUERIES.append(Query(name, fn, sql))
        return fn
    return deco


KEYS = ["event_id"]
VALS = ["user_id", "event_type", "value"]

_CLASSIFY_SQL = """
WITH d AS (SELECT * FROM cdc_batch WHERE upper(action) = 'DELETE'),
 i AS (SELECT * FROM cdc_batch WHERE upper(action) = 'INSERT'),
 j AS (SELECT coalesce(i.event_id, d.event_id) AS event_id,
              CASE WHEN i.event_id IS NOT NULL THEN i.user_id ELSE d.user_id END AS user_id,
              CASE WHEN i.event_id IS NOT NULL THEN i.event_type ELSE d.event_type END AS event_type,
              CASE WHEN i.event_id IS NOT NULL THEN i.value ELSE d.value END AS value,
              CASE WHEN d.event_id IS NOT NULL AND i.event_id IS NULL THEN 'D'
                   WHEN i.event_id IS NOT NULL AND d.event_id IS NULL THEN 'I'
                   WHEN d.user_id IS DISTINCT FROM i.user_id OR d.event_type IS DISTINCT FROM i.event_type
                        OR d.value IS DISTINCT FROM i.value THEN 'U' END AS change_type
       FROM d FULL OUTER JOIN i ON d.event_id IS NOT DISTINCT FROM i.event_id)
"""


@q("stm_cdc_classify", S.with_views(["cdc_batch"], _CLASSIFY_SQL + "SELECT * FROM j WHERE change_type IS NOT NULL"))
def stm_cdc_classify(spark, d):
    v = S.register(spark, d, ["cdc_batch"])
    return CDC.classify(v["cdc_batch"], KEYS, VALS)


_UPSERT_SQL = _CLASSIFY_SQL + """,
 c AS (SELECT * FROM j WHERE change_type IS NOT NULL),
 t AS (SELECT event_id, user_id, event_type, value, FALSE AS is_deleted FROM cdc_old),
 m AS (SELECT coalesce(t.event_id, c.event_id) AS event_id,
              CASE WHEN c.change_type IN ('U', 'I') THEN c.user_id ELSE t.user_id END AS user_id,
              CASE WHEN c.change_type IN ('U', 'I') THEN c.event_type ELSE t.event_type END AS event_type,
              CASE WHEN c.change_type IN ('U', 'I') THEN c.value ELSE t.value END AS value,
              CASE WHEN c.change_type = 'D' THEN TRUE WHEN c.change_type IN ('U', 'I') THEN FALSE ELSE t.is_deleted END AS is_deleted,
              CASE WHEN t.event_id IS NULL AND c.change_type = 'I' THEN 'INSERT' WHEN c.change_type = 'I' THEN 'RESURRECT'
                   WHEN c.change_type = 'U' THEN 'UPDATE' WHEN c.change_type = 'D' THEN 'DELETE' ELSE 'KEEP' END AS merge_action,
              t.event_id IS NOT NULL AS t_present
       FROM t FULL OUTER JOIN c ON t.event_id IS NOT DISTINCT FROM c.event_id)
"""


def _upserted(spark, d):
    v = S.register(spark, d, ["cdc_batch", "cdc_old"])
    target = v["cdc_old"].select(*KEYS, *VALS, F.lit(False).alias("is_deleted"))
    return CDC.upsert(target, CDC.classify(v["cdc_batch"], KEYS, VALS), KEYS, VALS)


@q("stm_cdc_upsert", S.with_views(["cdc_batch", "cdc_old"], _UPSERT_SQL + """
SELECT event_id, user_id, event_type, value, is_deleted, merge_action FROM m WHERE t_present OR merge_action <> 'DELETE'"""))
def stm_cdc_upsert(spark, d):
    return _upserted(spark, d)


@q("snk_merge_upsert", S.with_views(["cdc_batch", "cdc_old"], _UPSERT_SQL + """
SELECT merge_action, count(*) AS n, count_if(is_deleted) AS deleted FROM m WHERE t_present OR merge_action <> 'DELETE'
GROUP BY merge_action"""))
def snk_merge_upsert(spark, d):
    """An image in hash buckets: loaded, then merged with the change batch (twice: the replay does nothing)."""
    v = S.register(spark, d, ["cdc_batch", "cdc_old"])
    tables = Tables(spark, IO.scratch_path(spark, "merge"))
    load = v["cdc_old"].select(*KEYS, *VALS, F.lit("I").alias("change_type"))
    CDC.merge_image(tables, "image", "load", load, KEYS, VALS)
    for _ in range(2):
        CDC.merge_image(tables, "image", "changes", CDC.classify(v["cdc_batch"], KEYS, VALS), KEYS, VALS)
    action = F.when(F.col("merge_batch") == "changes", F.col("merge_action")).otherwise("KEEP")
    img = tables.read("image").withColumn("merge_action", action)
    return img.groupBy("merge_action").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_deleted").alias("deleted"))


@q("stm_missing_become_delete", S.with_views(["cdc_old", "cdc_new"], """
SELECT o.event_id, o.user_id, o.event_type, o.value, o.file_name, 'D' AS change_type FROM cdc_old o
WHERE o.file_name IN (SELECT file_name FROM cdc_new)
  AND NOT EXISTS (SELECT 1 FROM cdc_new n WHERE n.event_id IS NOT DISTINCT FROM o.event_id)"""))
def stm_missing_become_delete(spark, d):
    v = S.register(spark, d, ["cdc_old", "cdc_new"])
    t = v["cdc_old"].select("event_id", "user_id", "event_type", "value", "file_name")
    return CDC.missing_as_delete(t, v["cdc_new"], KEYS, "file_name")


_LATEST_SQL = S.with_views(["events"], """
SELECT e.event_id, e.user_id, e.ts FROM events e
WHERE e.ts = (SELECT max(ts) FROM events x WHERE x.user_id = e.user_id)""")


@q("stm_latest_version", _LATEST_SQL)
def stm_latest_version(spark, d):
    e = S.register(spark, d, ["events"])["events"].select("event_id", "user_id", "ts")
    return CDC.latest_version(e, ["user_id"], "ts")


@q("jn_exists_latest", _LATEST_SQL)
def jn_exists_latest(spark, d):
    e = S.register(spark, d, ["events"])["events"].select("event_id", "user_id", "ts")
    return CDC.latest_version(e, ["user_id"], "ts")


_EXCEPT_SQL = S.with_views(["cdc_old", "cdc_new"], """
SELECT event_id, user_id, event_type, value FROM cdc_new
EXCEPT SELECT event_id, user_id, event_type, value FROM cdc_old""")


@q("stm_changed_vs_registry", _EXCEPT_SQL)
def stm_changed_vs_registry(spark, d):
    v = S.register(spark, d, ["cdc_old", "cdc_new"])
    cols = ["event_id", "user_id", "event_type", "value"]
    return CDC.changed_vs(v["cdc_new"].select(*cols), v["cdc_old"].select(*cols))


@q("set_except_changed", _EXCEPT_SQL)
def set_except_changed(spark, d):
    return stm_changed_vs_registry(spark, d)


_STATUS_LOG_SQL = S.with_views(["hdr_queue", "hdr_queue_next"], """
SELECT a.adj_key, a.run_status AS old_status, b.run_status AS new_status, b.changed_at, b.username AS changed_by
FROM hdr_queue a JOIN hdr_queue_next b ON a.adj_key = b.adj_key WHERE a.run_status <> b.run_status""")


def _transitions(spark, d):
    v = S.register(spark, d, ["hdr_queue", "hdr_queue_next"])
    a = v["hdr_queue"].select("adj_key", F.col("run_status").alias("old_status"))
    b = v["hdr_queue_next"].select(F.col("adj_key").alias("_k"), F.col("run_status").alias("new_status"),
                                   "changed_at", F.col("username").alias("changed_by"))
    return a.join(b, F.col("adj_key") == F.col("_k")).where(F.col("old_status") != F.col("new_status")).drop("_k")


@q("stm_status_log", _STATUS_LOG_SQL)
def stm_status_log(spark, d):
    return _transitions(spark, d)


@q("snk_history_append", _STATUS_LOG_SQL)
def snk_history_append(spark, d):
    """Status transitions appended to a history table; the same batch run again adds nothing."""
    tables = Tables(spark, IO.scratch_path(spark, "history"))
    for _ in range(2):
        tables.commit("transitions", {"history": Change(_transitions(spark, d), append=True)})
    return tables.read("history")


@q("src_cdc_stream", S.with_views(["cdc_batch", "cdc_old"], _UPSERT_SQL + """
SELECT event_id, user_id, event_type, value, is_deleted FROM m WHERE t_present OR merge_action <> 'DELETE'"""))
def src_cdc_stream(spark, d):
    """Structured Streaming: initial load then the change batch, merged per micro-batch."""
    from restate.streaming.jobs import cdc_merge_stream, current_image
    v = S.register(spark, d, ["cdc_batch", "cdc_old"])
    src = IO.scratch_path(spark, "cdc-src")
    ckpt = IO.scratch_path(spark, "cdc-ckpt")
    root = IO.scratch_path(spark, "cdc-image")
    initial = v["cdc_old"].select(*KEYS, *VALS, F.lit("INSERT").alias("action"))
    initial.coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    cdc_merge_stream(spark, src, schema, root, ckpt, KEYS, VALS).awaitTermination()
    # a second file lands; the same stream (same checkpoint) picks up only the new file
    v["cdc_batch"].select(*KEYS, *VALS, "action").coalesce(1).write.mode("append").parquet(src)
    cdc_merge_stream(spark, src, schema, root, ckpt, KEYS, VALS).awaitTermination()
    return current_image(spark, root)


@q("stm_eligible_poll", S.with_views(["hdr_queue"], """
SELECT adj_key, process_type, cobid FROM hdr_queue
WHERE run_status IN ('Pending', 'Approved') AND blocked_by_adj_id IS NULL AND NOT coalesce(is_deleted, FALSE)"""))
def stm_eligible_poll(spark, d):
    """Polling stream: each tick re-reads the request table and emits what is eligible."""
    from restate.operators.workflow import eligible
    from restate.streaming.jobs import poll_stream
    ticks = IO.scratch_path(spark, "ticks")
    spark.range(1).withColumnRenamed("id", "tick").write.parquet(ticks)
    sink = IO.scratch_path(spark, "poll-out")
    qy = poll_stream(spark, ticks, "tick long", lambda sp: S.register(sp, d, ["hdr_queue"])["hdr_queue"],
                     lambda h: eligible(h).select("adj_key", "process_type", "cobid"), sink,
                     IO.scratch_path(spark, "poll-ckpt"))
    qy.awaitTermination()
    return spark.read.parquet(sink).drop("poll_epoch", "epoch")


@q("stm_feed_sync", S.with_views(["signoff_status", "signoff_feed"], """
SELECT count(*) AS n, count_if(upper(s.sign_off_status) = 'OPEN' AND upper(f.publish_status) = 'SIGNEDOFF') AS flips
FROM signoff_status s LEFT JOIN signoff_feed f ON f.cobid = s.cobid AND f.process_type = s.process_type
 AND f.entity_code = s.entity_code"""))
def stm_feed_sync(spark, d):
    """Scheduled sign-off sync (batch / availableNow): counts of kept and flipped rows."""
    from restate.operators.workflow import signoff_sync
    v = S.register(spark, d, ["signoff_status", "signoff_feed"])
    out = signoff_sync(v["signoff_feed"], v["signoff_status"]).where(F.col("action") != "INSERT")
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "FLIP").alias("flips"))


@q("stm_materialised_refresh", scale_sql("hdr_inline", True, """
SELECT cobid, source_system_code, CAST(sum(value_usd) AS DOUBLE) AS value_usd
FROM (SELECT cobid, source_system_code, value_usd FROM p_out UNION ALL SELECT cobid, source_system_code, value_usd FROM b_out) u
WHERE cobid IN (SELECT DISTINCT cobid FROM b_out) GROUP BY ALL"""))
def stm_materialised_refresh(spark, d):
    """A summary that follows its deltas: the stored ones, then the new batch's as changes.

    The business dates that the batch touched are shown; of the others no delta is read again."""
    from restate.queries.common import prior_deltas
    k = ["cobid", "source_system_code"]
    new = IO.write_image(run_scale(spark, d, "hdr_inline").select(*k, "value_usd"), "new")
    view = SummaryView(Tables(spark, IO.scratch_path(spark, "summary")), "summary", tuple(k), ("value_usd",))
    view.apply("stored", signed(prior_deltas(spark, d).select(*k, "value_usd"), 1))
    for _ in range(2):  # a refresh that runs again changes nothing
        view.apply("inline", signed(new, 1))
    return doubles(view.read().join(new.select("cobid").distinct(), "cobid", "left_semi"), ["value_usd"])


# -- sources / sinks ------------------------------------------------------------

@q("src_fact_scan", S.with_views(["fact"], """
SELECT cobid, trade_key, line_no, CAST(value_usd AS DOUBLE) AS value_usd FROM fact
WHERE cobid IN (19970201, 19970301, 19980601) AND value_usd IS NOT NULL"""))
def src_fact_scan(spark, d):
    """Fact stored partitioned by COB; the COB filter becomes a partition filter."""
    f = S.register(spark, d, ["fact"])["fact"]
    path = IO.scratch_path(spark, "fact")
    f.write.partitionBy("cobid").parquet(path)
    out = IO.read_fact(spark, path, [19970201, 19970301, 19980601], metric="value_usd")
    return out.select(F.col("cobid").cast("int").alias("cobid"), "trade_key", "line_no",
                      F.col("value_usd").cast("double").alias("value_usd"))


@q("src_csv_upload", S.with_views(["stage_direct"], """
SELECT batch_id AS "BATCH_ID", CAST(order_key AS VARCHAR) AS "ORDER_KEY", CAST(line_no AS VARCHAR) AS "LINE_NO",
       entity_code AS "ENTITY_CODE", value_usd AS "VALUE_USD"
FROM stage_direct WHERE batch_id = 'B1998'"""))
def src_csv_upload(spark, d):
    """A user file (semicolon-separated, mixed-case header) read as all-text rows."""
    v = S.register(spark, d, ["stage_direct"])
    path = IO.scratch_path(spark, "upload")
    v["stage_direct"].where(F.col("batch_id") == "B1998").select(
        F.col("batch_id").alias(" Batch_Id"), F.col("order_key").alias("order_key "), F.col("line_no").alias("Line_No"),
        F.col("entity_code").alias("entity_code"), F.col("value_usd").alias("Value_USD")) \
        .write.option("header", True).option("sep", ";").csv(path)
    return IO.read_upload(spark, path).drop("source_file")


@q("snk_delta_append", scale_sql("hdr_inline", True, """
SELECT cobid, restatement_id, trade_key, line_no, CAST(value_usd AS DOUBLE) AS value_usd FROM p_out
UNION ALL SELECT cobid, restatement_id, trade_key, line_no, CAST(value_usd AS DOUBLE) AS value_usd FROM b_out"""))
def snk_delta_append(spark, d):
    from restate.queries.common import prior_deltas
    tables = Tables(spark, IO.scratch_path(spark, "deltas"))
    cols = ["cobid", "restatement_id", "trade_key", "line_no", "value_usd"]
    tables.commit("prior", {"deltas": Change(prior_deltas(spark, d).select(*cols), by=("cobid",), append=True)})
    for _ in range(2):  # a batch that runs again adds nothing
        tables.commit("inline", {"deltas": Change(run_scale(spark, d, "hdr_inline").select(*cols), by=("cobid",), append=True)})
    out = tables.read("deltas")
    return out.select(F.col("cobid").cast("int").alias("cobid"), "restatement_id", "trade_key", "line_no",
                      F.col("value_usd").cast("double").alias("value_usd"))


@q("snk_partition_replace", scale_sql("hdr_inline", True, """
, old AS (SELECT cobid, source_system_code, sum(value_usd) AS value_usd FROM p_out GROUP BY ALL),
  new AS (SELECT cobid, source_system_code, sum(value_usd) AS value_usd
    FROM (SELECT cobid, source_system_code, value_usd FROM p_out UNION ALL SELECT cobid, source_system_code, value_usd FROM b_out) u
    WHERE cobid IN (SELECT cobid FROM b_out) GROUP BY ALL)
SELECT cobid, source_system_code, CAST(value_usd AS DOUBLE) AS value_usd FROM old
WHERE cobid NOT IN (SELECT cobid FROM new)
UNION ALL SELECT cobid, source_system_code, CAST(value_usd AS DOUBLE) AS value_usd FROM new"""))
def snk_partition_replace(spark, d):
    """Summary slices: the COBs that the new batch touched are summed anew over all stored deltas, others stay."""
    from restate.queries.common import prior_deltas
    tables = Tables(spark, IO.scratch_path(spark, "summary"))
    k = ["cobid", "source_system_code"]
    prior, new = prior_deltas(spark, d), run_scale(spark, d, "hdr_inline")
    both = prior.select(*k, "value_usd").unionByName(new.select(*k, "value_usd"))
    for batch, rows, slices in (("prior", prior, prior), ("inline", both, new)):
        summary = D.summarise(rows, k, ["value_usd"])
        tables.commit(batch, {"summary": Change(summary, by=("cobid",), emptied=slices.select("cobid"), only_emptied=True)})
    out = tables.read("summary")
    return out.select(F.col("cobid").cast("int").alias("cobid"), "source_system_code",
                      F.col("value_usd").cast("double").alias("value_usd"))


@q("snk_trigger_row", S.with_views(["hdr_queue"], """
SELECT process_type, cobid, max(process_date) AS triggered_at, count(*) AS restatements,
       md5(process_type || '-' || CAST(cobid AS VARCHAR)) AS trigger_id
FROM hdr_queue WHERE run_status = 'Processed' GROUP BY process_type, cobid"""))
def snk_trigger_row(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"].where(F.col("run_status") == "Processed")
    return IO.emit_triggers(h)
