"""Registered queries: previews, KPIs, dashboards, health, impact, trends, top-k,
activity, anomalies, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from restate.functions.factor import VALUE_TYPE
from restate.operators import report as RP
from restate.operators.match import active_filters
from restate.plans import preview as PV
from restate.queries import standin as S
from restate.queries.common import Query, attach_attrs, doubles, run_scale, scale_sql

QUERIES: list[Query] = []


def q(name, sql=None):
    def deco(fn):
        QUERIES.append(Query(name, fn, sql))
        return fn
    return deco


NOW = "1998-06-01 00:00:00"
WILD = " AND ".join(f"(h.{c} IS NULL OR upper(trim(h.{c})) = upper(trim(CAST(f.{a} AS VARCHAR))))"
                    for c, a in S.FILTER_MAP.items())
EFF = """CAST(CASE WHEN lower(h.restatement_type) = 'flatten' THEN -1
   WHEN lower(h.restatement_type) IN ('scale', 'roll') THEN
        CASE WHEN coalesce(h.source_cobid, h.cobid) <> h.cobid THEN CAST(h.scale_factor AS DECIMAL(12,4))
             ELSE CAST(h.scale_factor AS DECIMAL(12,4)) - 1 END ELSE 0 END AS DECIMAL(12,4))"""
PREVIEW_M = f"""
WITH m AS (SELECT h.adj_key, h.scale_factor, {EFF} AS eff, f.* FROM fact_attr f
           JOIN hdr_inline h ON f.cobid = coalesce(h.source_cobid, h.cobid) AND {WILD})
"""


def _matched(spark, d, match_on="source"):
    v = S.register(spark, d, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_inline"])
    h = v["hdr_inline"]
    fmap = {c: S.FILTER_MAP[c] for c in active_filters(h, S.FILTER_COLS)}
    fa = attach_attrs(v["fact"], v, set(fmap.values()) | {"entity_code", "book_code", "department_code"})
    return PV.matched(fa, h, fmap, match_on=match_on)


@q("agg_preview_summary", S.with_views(["fact_attr", "hdr_inline"], PREVIEW_M + """
SELECT adj_key, count(*) AS row_count, count_if(value_usd <> 0) AS nonzero_rows,
       CAST(coalesce(sum(value_usd), 0) AS DOUBLE) AS current_total,
       CAST(coalesce(sum(CAST(CAST(value_usd AS DECIMAL(28,8)) * eff AS DECIMAL(28,8))), 0) AS DOUBLE) AS delta_total,
       CAST(coalesce(sum(CAST(value_usd AS DECIMAL(28,8)) + CAST(CAST(value_usd AS DECIMAL(28,8)) * eff AS DECIMAL(28,8))), 0) AS DOUBLE) AS projected_total
FROM m GROUP BY adj_key"""))
def agg_preview_summary(spark, d):
    s = PV.preview_summary(_matched(spark, d), "value_usd")
    return doubles(s, ["current_total", "delta_total", "projected_total"])


@q("agg_preview_breakdown", S.with_views(["fact_attr", "hdr_inline"], PREVIEW_M + """
SELECT adj_key, entity_code, department_code, book_code, count(*) AS row_count,
       CAST(sum(value_usd) AS DOUBLE) AS current_total,
       CAST(sum(CAST(CAST(value_usd AS DECIMAL(28,8)) * eff AS DECIMAL(28,8))) AS DOUBLE) AS delta_total
FROM m GROUP BY ALL"""))
def agg_preview_breakdown(spark, d):
    b = PV.preview_breakdown(_matched(spark, d), "value_usd", ["entity_code", "department_code", "book_code"])
    return doubles(b, ["current_total", "delta_total"])


@q("srt_preview_sample", S.with_views(["fact_attr", "hdr_inline"], PREVIEW_M + """
SELECT adj_key, sample_rank, trade_key, line_no, CAST(current_value AS DOUBLE) AS current_value,
       CAST(delta_value AS DOUBLE) AS delta_value FROM (
  SELECT adj_key, row_number() OVER (PARTITION BY adj_key ORDER BY abs(value_usd) DESC, trade_key, line_no,
         book_key, instrument_key) AS sample_rank, trade_key, line_no, value_usd AS current_value,
         CAST(CAST(value_usd AS DECIMAL(28,8)) * eff AS DECIMAL(28,8)) AS delta_value FROM m) x
WHERE sample_rank <= 25"""))
def srt_preview_sample(spark, d):
    s = PV.preview_sample(_matched(spark, d), "value_usd", 25, ["trade_key", "line_no", "book_key", "instrument_key"],
                          ["trade_key", "line_no"])
    return doubles(s, ["current_value", "delta_value"])


@q("agg_preview_roll", scale_sql("hdr_inline", True, f"""
, rh AS (SELECT * FROM hdr_inline WHERE coalesce(source_cobid, cobid) <> cobid),
  comb AS (SELECT cobid, value_usd, entity_code, department_code, book_code, instrument_code, product_type, strategy,
                  trade_typology, source_system_code, currency_code FROM fa
           UNION ALL SELECT cobid, value_usd, entity_code, department_code, book_code, instrument_code, product_type,
                  strategy, trade_typology, source_system_code, currency_code FROM pa),
  t AS (SELECT h.adj_key, sum(f.value_usd) AS cur FROM fa f JOIN rh h ON f.cobid = h.cobid AND {WILD} GROUP BY h.adj_key),
  s AS (SELECT h.adj_key, h.scale_factor, sum(f.value_usd) AS src FROM comb f JOIN rh h ON f.cobid = h.source_cobid AND {WILD}
        GROUP BY h.adj_key, h.scale_factor)
SELECT coalesce(t.adj_key, s.adj_key) AS adj_key, CAST(coalesce(t.cur, 0) AS DOUBLE) AS current_total,
       CAST(coalesce(CAST(CAST(s.src AS DECIMAL(28,8)) * CAST(s.scale_factor AS DECIMAL(12,4)) AS DECIMAL(28,8)), 0) AS DOUBLE) AS projected_total
FROM t FULL OUTER JOIN s ON t.adj_key = s.adj_key"""))
def agg_preview_roll(spark, d):
    from restate.queries.common import prior_deltas
    v = S.register(spark, d, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_inline", "hdr_prior"])
    h = v["hdr_inline"].where(F.coalesce("source_cobid", "cobid") != F.col("cobid"))
    fmap = {c: S.FILTER_MAP[c] for c in active_filters(h, S.FILTER_COLS)}
    fa = attach_attrs(v["fact"], v, fmap.values())
    da = attach_attrs(prior_deltas(spark, d, v), v, fmap.values())
    cols = ["cobid", "value_usd", *sorted(set(fmap.values()))]
    comb = fa.select(*cols).unionByName(da.select(*cols))
    t = PV.matched(fa.select(*cols), h, fmap, match_on="target")
    s = PV.matched(comb, h, fmap, match_on="source")
    return doubles(PV.preview_roll(t, s, "value_usd"), ["current_total", "projected_total"])


# -- KPIs and dashboards -------------------------------------------------------

@q("agg_dashboard", S.with_views(["hdr_queue"], """
SELECT cobid, process_type, restatement_type, run_status, entity_code, department_code, source_system_code,
       currency_code, is_deleted, username IS NOT NULL AS has_user, count(*) AS restatements,
       CAST(sum(restatement_value_in_usd) AS DOUBLE) AS value_usd
FROM hdr_queue GROUP BY ALL"""))
def agg_dashboard(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    keys = ["cobid", "process_type", "restatement_type", "run_status", "entity_code", "department_code",
            "source_system_code", "currency_code", "is_deleted", F.col("username").isNotNull().alias("has_user")]
    return h.groupBy(*keys).agg(F.count(F.lit(1)).alias("restatements"),
                                F.sum("restatement_value_in_usd").cast("double").alias("value_usd"))


_KPI_SQL = """
SELECT h.cobid, count(DISTINCT h.adj_key) AS total_restatements,
  count(DISTINCT CASE WHEN run_status = 'Pending' THEN adj_key END) AS pending_count,
  count(DISTINCT CASE WHEN run_status = 'Pending Approval' THEN adj_key END) AS pending_approval_count,
  count(DISTINCT CASE WHEN run_status = 'Approved' THEN adj_key END) AS approved_count,
  count(DISTINCT CASE WHEN run_status = 'Processed' THEN adj_key END) AS processed_count,
  count(DISTINCT CASE WHEN run_status = 'Running' THEN adj_key END) AS running_count,
  count(DISTINCT CASE WHEN run_status = 'Failed' THEN adj_key END) AS failed_count,
  count(DISTINCT CASE WHEN run_status LIKE 'Rejected%' THEN adj_key END) AS rejected_count,
  CAST(sum(CASE WHEN run_status = 'Processed' THEN restatement_value_in_usd ELSE 0 END) AS DOUBLE) AS total_processed_value_usd,
  min(created_date) AS first_submission, max(process_date) AS last_processing,
  avg(CASE WHEN run_status = 'Processed' THEN epoch(process_date) - epoch(created_date) END) AS avg_processing_seconds,
  count(DISTINCT username) AS unique_users
FROM hdr_queue h WHERE NOT coalesce(is_deleted, FALSE) GROUP BY h.cobid"""


@q("agg_kpi", S.with_views(["hdr_queue"], f"""
WITH k AS ({_KPI_SQL}),
 o AS (SELECT a.cobid, count(*) AS n FROM hdr_queue a JOIN hdr_queue b ON a.cobid = b.cobid
       AND a.process_type = b.process_type AND a.adj_key < b.adj_key AND NOT a.is_deleted AND NOT b.is_deleted AND
       {" AND ".join(f"(a.{c} IS NULL OR b.{c} IS NULL OR upper(trim(a.{c})) = upper(trim(b.{c})))" for c in S.FILTER_COLS)}
       GROUP BY a.cobid)
SELECT k.*, coalesce(o.n, 0) AS overlap_alerts FROM k LEFT JOIN o ON k.cobid = o.cobid"""))
def agg_kpi(spark, d):
    from restate.operators.overlap import overlap_counts
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    k = RP.kpi_per_cob(h, overlap_counts(h.where(~F.col("is_deleted")), S.FILTER_COLS, ["cobid", "process_type"]))
    return k.withColumn("total_processed_value_usd", F.col("total_processed_value_usd").cast("double")) \
        .withColumn("avg_processing_seconds", F.col("avg_processing_seconds").cast("double"))


@q("agg_kpi_total", S.with_views(["hdr_queue"], f"""
WITH k AS ({_KPI_SQL})
SELECT coalesce(sum(total_restatements), 0) AS total_restatements, coalesce(sum(pending_count), 0) AS pending_count,
       coalesce(sum(processed_count), 0) AS processed_count, coalesce(sum(failed_count), 0) AS failed_count,
       CAST(coalesce(sum(total_processed_value_usd), 0) AS DOUBLE) AS total_processed_value_usd FROM k"""))
def agg_kpi_total(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    k = RP.kpi_per_cob(h)
    return k.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in
                   ["total_restatements", "pending_count", "processed_count", "failed_count"]],
                 F.coalesce(F.sum("total_processed_value_usd"), F.lit(0)).cast("double").alias("total_processed_value_usd"))


@q("agg_scope_status", S.with_views(["hdr_queue"], """
SELECT process_type, run_status, count(*) AS n FROM hdr_queue WHERE NOT is_deleted GROUP BY ALL"""))
def agg_scope_status(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    return h.where(~F.col("is_deleted")).groupBy("process_type", "run_status").agg(F.count(F.lit(1)).alias("n"))


@q("agg_cob_trend", scale_sql("hdr_orders", False, """
, top AS (SELECT DISTINCT cobid FROM hdr_orders ORDER BY cobid DESC LIMIT 10),
  a AS (SELECT cobid, process_type, count(*) AS restatements FROM hdr_orders WHERE cobid IN (SELECT cobid FROM top) GROUP BY ALL),
  r AS (SELECT h.cobid, h.process_type, count(*) AS delta_rows FROM b_out o JOIN hdr_orders h ON o.restatement_id = h.restatement_id
        WHERE h.cobid IN (SELECT cobid FROM top) GROUP BY ALL)
SELECT a.cobid, a.process_type, a.restatements, coalesce(r.delta_rows, 0) AS delta_rows
FROM a LEFT JOIN r ON a.cobid = r.cobid AND a.process_type = r.process_type"""))
def agg_cob_trend(spark, d):
    v = S.register(spark, d, ["hdr_orders"])
    h = v["hdr_orders"]
    top = h.select("cobid").distinct().orderBy(F.col("cobid").desc()).limit(10)
    hh = h.join(top, "cobid", "left_semi")
    a = hh.groupBy("cobid", "process_type").agg(F.count(F.lit(1)).alias("restatements"))
    out = run_scale(spark, d, "hdr_orders", with_prior=False)
    # rows are counted per request before they meet it
    n = out.groupBy("restatement_id").agg(F.count(F.lit(1)).alias("n"))
    r = n.join(hh.select("restatement_id", "cobid", "process_type"), "restatement_id") \
        .groupBy("cobid", "process_type").agg(F.sum("n").alias("delta_rows"))
    return a.join(r, ["cobid", "process_type"], "left").na.fill(0, ["delta_rows"])


@q("agg_run_log", S.with_views(["hdr_queue"], """
SELECT process_type AS run_scope, cobid, min(restatement_type) AS any_type,
       count_if(run_status = 'Processed') AS processed, count_if(run_status = 'Failed') AS failed,
       min(start_date) AS started_at, max(process_date) AS ended_at,
       epoch(max(process_date)) - epoch(min(start_date)) AS duration_sec
FROM hdr_queue GROUP BY ALL"""))
def agg_run_log(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    return h.groupBy(F.col("process_type").alias("run_scope"), "cobid").agg(
        F.min("restatement_type").alias("any_type"), F.count_if(F.col("run_status") == "Processed").alias("processed"),
        F.count_if(F.col("run_status") == "Failed").alias("failed"), F.min("start_date").alias("started_at"),
        F.max("process_date").alias("ended_at"),
        (F.unix_timestamp(F.max("process_date")) - F.unix_timestamp(F.min("start_date"))).cast("double").alias("duration_sec"))


@q("agg_health", S.with_views(["hdr_queue"], f"""
SELECT count_if(run_status IN ('Pending', 'Approved') AND blocked_by_adj_id IS NULL) AS queued,
       count_if(run_status IN ('Pending', 'Approved') AND blocked_by_adj_id IS NOT NULL) AS blocked,
       count_if(run_status = 'Running') AS running,
       count_if(run_status = 'Running' AND start_date < TIMESTAMP '{NOW}' - INTERVAL '240' MINUTE) AS stale,
       count_if(run_status = 'Failed' AND created_date >= TIMESTAMP '{NOW}' - INTERVAL '24' HOUR) AS failed_24h,
       max(CASE WHEN run_status IN ('Pending', 'Approved') THEN epoch(TIMESTAMP '{NOW}') - epoch(created_date) END) AS oldest_queued_sec
FROM hdr_queue"""))
def agg_health(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    return RP.health(h, NOW).withColumn("oldest_queued_sec", F.col("oldest_queued_sec").cast("double"))


@q("agg_pipeline_kpi", S.with_views(["hdr_queue"], f"""
SELECT process_type, count_if(run_status IN ('Pending', 'Approved')) AS queue,
       count_if(blocked_by_adj_id IS NOT NULL) AS blocked, count_if(run_status = 'Running') AS running,
       count_if(run_status = 'Running' AND start_date < TIMESTAMP '{NOW}' - INTERVAL '240' MINUTE) AS stale,
       count_if(run_status = 'Failed') AS failed,
       count_if(run_status IN ('Pending', 'Approved') AND blocked_by_adj_id IS NULL AND NOT is_deleted) AS ready
FROM hdr_queue GROUP BY process_type"""))
def agg_pipeline_kpi(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    st = F.col("run_status")
    lim = F.lit(NOW).cast("timestamp") - F.expr("INTERVAL 240 MINUTES")
    return RP.conditional_counts(h, {
        "queue": st.isin("Pending", "Approved"), "blocked": F.col("blocked_by_adj_id").isNotNull(),
        "running": st == "Running", "stale": (st == "Running") & (F.col("start_date") < lim), "failed": st == "Failed",
        "ready": st.isin("Pending", "Approved") & F.col("blocked_by_adj_id").isNull() & ~F.col("is_deleted")},
        group=["process_type"])


@q("agg_approval_kpi", S.with_views(["hdr_queue", "signoff_status"], """
SELECT (SELECT count(*) FROM hdr_queue WHERE run_status = 'Pending Approval') AS pending_total,
       (SELECT count(DISTINCT process_type) FROM hdr_queue WHERE run_status = 'Pending Approval') AS pending_scopes,
       (SELECT count(DISTINCT username) FROM hdr_queue WHERE run_status = 'Pending Approval') AS pending_submitters,
       (SELECT count(*) FROM signoff_status WHERE sign_off_status IN ('SIGNOFF_REQUESTED', 'REOPEN_REQUESTED')) AS pending_signoff_requests"""))
def agg_approval_kpi(spark, d):
    v = S.register(spark, d, ["hdr_queue", "signoff_status"])
    p = v["hdr_queue"].where(F.col("run_status") == "Pending Approval").agg(
        F.count(F.lit(1)).alias("pending_total"), F.countDistinct("process_type").alias("pending_scopes"),
        F.countDistinct("username").alias("pending_submitters"))
    s = v["signoff_status"].agg(F.count_if(F.col("sign_off_status").isin("SIGNOFF_REQUESTED", "REOPEN_REQUESTED"))
                                .alias("pending_signoff_requests"))
    return RP.side_by_side(p, s)


@q("agg_notification_kpi", S.with_views(["events"], """
SELECT count_if(event_type = 'purchase') AS sent, count_if(event_type = 'error') AS failed,
       count_if(event_type = 'view') AS skipped
FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '24' HOUR AND ts < TIMESTAMP '2024-01-15 00:00:00'"""))
def agg_notification_kpi(spark, d):
    e = S.register(spark, d, ["events"])["events"]
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    w = e.where((F.col("ts") >= now - F.expr("INTERVAL 24 HOURS")) & (F.col("ts") < now))
    return RP.conditional_counts(w, {"sent": F.col("event_type") == "purchase", "failed": F.col("event_type") == "error",
                                     "skipped": F.col("event_type") == "view"})


@q("agg_home_kpi", S.with_views(["hdr_queue"], f"""
SELECT count_if(run_status IN ('Pending', 'Pending Approval')) AS pending,
       count_if(run_status = 'Processed' AND CAST(process_date AS DATE) = DATE '1998-06-01') AS applied_today,
       count(*) AS total, CAST(coalesce(sum(CASE WHEN run_status = 'Processed' THEN restatement_value_in_usd END), 0) AS DOUBLE) AS value_applied
FROM hdr_queue"""))
def agg_home_kpi(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    return h.agg(F.count_if(F.col("run_status").isin("Pending", "Pending Approval")).alias("pending"),
                 F.count_if((F.col("run_status") == "Processed") & (F.to_date("process_date") == F.lit("1998-06-01").cast("date")))
                 .alias("applied_today"), F.count(F.lit(1)).alias("total"),
                 F.coalesce(F.sum(F.when(F.col("run_status") == "Processed", F.col("restatement_value_in_usd"))), F.lit(0))
                 .cast("double").alias("value_applied"))


@q("agg_admin_totals", S.with_views(["hdr_queue", "status_history", "signoff_status"], """
SELECT (SELECT count(*) FROM hdr_queue) AS header_count, (SELECT count(*) FROM status_history) AS history_count,
       (SELECT count(*) FROM signoff_status) AS signoff_count, (SELECT count(*) FROM lineitem) AS fact_count"""))
def agg_admin_totals(spark, d):
    v = S.register(spark, d, ["hdr_queue", "status_history", "signoff_status", "lineitem"])
    a = RP.three_way(v["hdr_queue"], v["status_history"], v["signoff_status"],
                     ("header_count", "history_count", "signoff_count"))
    return RP.side_by_side(a, v["lineitem"].agg(F.count(F.lit(1)).alias("fact_count")))


@q("agg_recent_stats", scale_sql("hdr_orders", False, """
, rh AS (SELECT restatement_id FROM hdr_orders WHERE created_date >= TIMESTAMP '1998-06-01 00:00:00' - INTERVAL '7' DAY
         AND created_date < TIMESTAMP '1998-06-01 00:00:00')
SELECT (SELECT count(*) FROM rh) AS restatements, count(*) AS delta_rows,
       CAST(coalesce(sum(abs(value_usd)), 0) AS DOUBLE) AS abs_delta
FROM b_out WHERE restatement_id IN (SELECT restatement_id FROM rh)"""))
def agg_recent_stats(spark, d):
    h = S.register(spark, d, ["hdr_orders"])["hdr_orders"]
    now = F.lit("1998-06-01 00:00:00").cast("timestamp")
    rh = h.where((F.col("created_date") >= now - F.expr("INTERVAL 7 DAYS")) & (F.col("created_date") < now)) \
        .select("restatement_id")
    dd = run_scale(spark, d, "hdr_orders", with_prior=False).join(rh, "restatement_id", "left_semi")
    a = rh.agg(F.count(F.lit(1)).alias("restatements"))
    b = dd.agg(F.count(F.lit(1)).alias("delta_rows"),
               F.coalesce(F.sum(F.abs("value_usd")), F.lit(0)).cast("double").alias("abs_delta"))
    return RP.side_by_side(a, b)


@q("agg_reference_options", S.with_views(["book_dim"], """
SELECT DISTINCT entity_code, department_code, book_code FROM book_dim WHERE upper(department_code) = 'EUROPE'"""))
def agg_reference_options(spark, d):
    """Cascading options: books of the departments (and their entities) chosen so far."""
    b = S.register(spark, d, ["book_dim"])["book_dim"]
    return b.where(F.upper("department_code") == "EUROPE").select("entity_code", "department_code", "book_code").distinct()


@q("agg_optionality_check", S.with_views(["fact", "trade_dim"], """
SELECT EXISTS_FLAG AS has_group, count(*) AS n FROM (
  SELECT f.trade_key, EXISTS (SELECT 1 FROM trade_dim t WHERE t.trade_key = f.trade_key AND t.strategy = '1-URGENT'
                              AND t.trade_cobid <= f.cobid) AS EXISTS_FLAG FROM fact f) x GROUP BY 1"""))
def agg_optionality_check(spark, d):
    """Flag by EXISTS on an effective-dated group table, then count per flag: a key has a group from its
    least date on, so one left join on that date tells."""
    v = S.register(spark, d, ["fact", "trade_dim"])
    g = v["trade_dim"].where(F.col("strategy") == "1-URGENT").groupBy(F.col("trade_key").alias("_tk")).agg(F.min("trade_cobid").alias("_from"))
    rows = v["fact"].select("trade_key", "cobid").join(g, F.col("trade_key") == F.col("_tk"), "left")
    has = F.coalesce(F.col("_from") <= F.col("cobid"), F.lit(False))
    return rows.groupBy(has.alias("has_group")).agg(F.count(F.lit(1)).alias("n"))


@q("agg_refresh_kpi", S.with_views(["events"], """
SELECT count_if(event_type = 'signup') AS queued, count_if(event_type = 'click') AS running,
       count_if(event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '24' HOUR
                AND ts < TIMESTAMP '2024-01-15 00:00:00') AS triggers_24h
FROM events"""))
def agg_refresh_kpi(spark, d):
    e = S.register(spark, d, ["events"])["events"]
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return RP.conditional_counts(e, {
        "queued": F.col("event_type") == "signup", "running": F.col("event_type") == "click",
        "triggers_24h": (F.col("event_type") == "purchase") & (F.col("ts") >= now - F.expr("INTERVAL 24 HOURS"))
        & (F.col("ts") < now)})


@q("agg_impact_summary", scale_sql("hdr_inline", True, """
, o AS (SELECT h.restatement_id, sum(f.value_usd) AS original_total FROM fa f
        JOIN hdr_inline h ON f.cobid = h.cobid AND """ + WILD + """ GROUP BY h.restatement_id),
  dd AS (SELECT restatement_id, count(*) AS rows_affected, sum(abs(value_usd)) AS abs_delta, sum(value_usd) AS net_delta
         FROM b_out GROUP BY restatement_id)
SELECT h.restatement_id, coalesce(dd.rows_affected, 0) AS rows_affected, CAST(dd.abs_delta AS DOUBLE) AS abs_delta,
       CAST(dd.net_delta AS DOUBLE) AS net_delta, CAST(o.original_total AS DOUBLE) AS original_total,
       CAST(round(CAST(dd.net_delta AS DOUBLE) / nullif(CAST(o.original_total AS DOUBLE), 0) * 100, 4) AS DOUBLE) AS pct_impact
FROM hdr_inline h LEFT JOIN dd ON h.restatement_id = dd.restatement_id LEFT JOIN o ON h.restatement_id = o.restatement_id"""))
def agg_impact_summary(spark, d):
    from restate.operators.match import wildcard_match
    v = S.register(spark, d, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_inline"])
    h = v["hdr_inline"]
    fmap = {c: S.FILTER_MAP[c] for c in active_filters(h, S.FILTER_COLS)}
    fa = attach_attrs(v["fact"], v, fmap.values())
    hh = h.select(F.col("restatement_id"), F.col("cobid").alias("_hc"), *[F.col(c).alias(f"_h_{c}") for c in fmap])
    orig = wildcard_match(fa, hh, {f"_h_{c}": a for c, a in fmap.items()}, header_cob="_hc")
    deltas = run_scale(spark, d, "hdr_inline").withColumn("value_usd", F.col("value_usd").cast("double"))
    out = RP.impact_summary(h, deltas, orig.withColumn("value_usd", F.col("value_usd").cast("double")),
                            "restatement_id", "value_usd")
    return doubles(out, ["abs_delta", "net_delta", "original_total", "pct_impact"])


@q("agg_daily_activity", S.with_views(["hdr_queue"], """
SELECT date_trunc('day', created_date) AS day, restatement_type, run_status, username, count(*) AS n
FROM hdr_queue GROUP BY ALL"""))
def agg_daily_activity(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    return h.groupBy(F.date_trunc("day", "created_date").alias("day"), "restatement_type", "run_status", "username") \
        .agg(F.count(F.lit(1)).alias("n"))


@q("agg_daily_metrics", scale_sql("hdr_orders", False, """
, dd AS (SELECT restatement_id, count(*) AS n, sum(abs(value_usd)) AS a FROM b_out GROUP BY restatement_id)
SELECT date_trunc('day', h.created_date) AS day, count(DISTINCT h.adj_key) AS restatements,
       CAST(sum(dd.a) AS DOUBLE) AS sum_abs_delta, count(dd.a) AS restatements_with_deltas,
       CAST(max(dd.a) AS DOUBLE) AS max_abs_delta, coalesce(sum(dd.n), 0) AS affected_rows
FROM hdr_orders h LEFT JOIN dd ON h.restatement_id = dd.restatement_id GROUP BY 1"""))
def agg_daily_metrics(spark, d):
    h = S.register(spark, d, ["hdr_orders"])["hdr_orders"]
    dd = run_scale(spark, d, "hdr_orders", with_prior=False).groupBy("restatement_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs("value_usd")).alias("a"))
    j = h.join(dd, "restatement_id", "left")
    return j.groupBy(F.date_trunc("day", "created_date").alias("day")).agg(
        F.countDistinct("adj_key").alias("restatements"), F.sum("a").cast("double").alias("sum_abs_delta"),
        F.count("a").alias("restatements_with_deltas"), F.max("a").cast("double").alias("max_abs_delta"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("affected_rows"))


@q("agg_impact_by_type", scale_sql("hdr_orders", False, """
SELECT h.restatement_type, count(*) AS delta_rows, CAST(sum(o.value_usd) AS DOUBLE) AS net_impact,
       CAST(sum(abs(o.value_usd)) AS DOUBLE) AS abs_impact
FROM b_out o JOIN hdr_orders h ON o.restatement_id = h.restatement_id GROUP BY 1"""))
def agg_impact_by_type(spark, d):
    h = S.register(spark, d, ["hdr_orders"])["hdr_orders"].select("restatement_id", "restatement_type")
    o = run_scale(spark, d, "hdr_orders", with_prior=False)
    # rows are summed per request before they meet it
    per = o.groupBy("restatement_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value_usd").alias("net"), F.sum(F.abs("value_usd")).alias("size"))
    return per.join(h, "restatement_id").groupBy("restatement_type").agg(
        F.sum("n").alias("delta_rows"), F.sum("net").cast("double").alias("net_impact"), F.sum("size").cast("double").alias("abs_impact"))


@q("agg_impact_by_entity", scale_sql("hdr_orders", False, """
SELECT b.entity_code, CAST(sum(o.value_usd) AS DOUBLE) AS net_impact, CAST(sum(abs(o.value_usd)) AS DOUBLE) AS abs_impact
FROM b_out o LEFT JOIN book_dim b ON o.book_key = b.book_key GROUP BY 1"""))
def agg_impact_by_entity(spark, d):
    v = S.register(spark, d, ["book_dim"])
    o = attach_attrs(run_scale(spark, d, "hdr_orders", with_prior=False), v, ["entity_code"])
    return o.groupBy("entity_code").agg(F.sum("value_usd").cast("double").alias("net_impact"),
                                        F.sum(F.abs("value_usd")).cast("double").alias("abs_impact"))


@q("agg_top_users", S.with_views(["hdr_queue"], """
SELECT username, count(*) AS submitted, count_if(run_status = 'Processed') AS processed,
       count_if(run_status = 'Failed') AS failed
FROM hdr_queue GROUP BY username ORDER BY submitted DESC, username LIMIT 5"""))
def agg_top_users(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    g = h.groupBy("username").agg(F.count(F.lit(1)).alias("submitted"),
                                  F.count_if(F.col("run_status") == "Processed").alias("processed"),
                                  F.count_if(F.col("run_status") == "Failed").alias("failed"))
    return RP.top_n(g, [F.col("submitted").desc(), F.col("username")], 5)


@q("srt_top_impact", scale_sql("hdr_orders", False, """
SELECT restatement_id, CAST(sum(abs(value_usd)) AS DOUBLE) AS abs_impact FROM b_out
GROUP BY restatement_id ORDER BY abs_impact DESC, restatement_id LIMIT 10"""))
def srt_top_impact(spark, d):
    o = run_scale(spark, d, "hdr_orders", with_prior=False)
    g = o.groupBy("restatement_id").agg(F.sum(F.abs("value_usd")).cast("double").alias("abs_impact"))
    return RP.top_n(g, [F.col("abs_impact").desc(), F.col("restatement_id")], 10)


@q("srt_recent_n", S.with_views(["status_history"], """
SELECT adj_key, event_id, new_status, changed_at FROM status_history ORDER BY changed_at DESC, event_id DESC LIMIT 50"""))
def srt_recent_n(spark, d):
    h = S.register(spark, d, ["status_history"])["status_history"]
    return RP.top_n(h.select("adj_key", "event_id", "new_status", "changed_at"),
                    [F.col("changed_at").desc(), F.col("event_id").desc()], 50)


@q("srt_recent_cobs", S.with_views(["fact", "hdr_orders"], """
SELECT cobid FROM (SELECT cobid FROM fact UNION SELECT cobid FROM hdr_orders) u ORDER BY cobid DESC LIMIT 30"""))
def srt_recent_cobs(spark, d):
    v = S.register(spark, d, ["fact", "hdr_orders"])
    u = v["fact"].select("cobid").union(v["hdr_orders"].select("cobid")).distinct()
    return RP.top_n(u, [F.col("cobid").desc()], 30)


@q("srt_probe_exists", S.with_views(["fact", "hdr_inline"], """
SELECT h.adj_key, EXISTS (SELECT 1 FROM fact f WHERE f.cobid = h.cobid) AS target_has_data,
       EXISTS (SELECT 1 FROM fact f WHERE f.cobid = coalesce(h.source_cobid, h.cobid)) AS source_has_data
FROM hdr_inline h"""))
def srt_probe_exists(spark, d):
    """Existence probes for every request at once (semi joins on distinct COBs, no per-request scans)."""
    v = S.register(spark, d, ["fact", "hdr_inline"])
    cobs = v["fact"].select(F.col("cobid").alias("_c")).distinct().withColumn("_hit", F.lit(True))
    h = v["hdr_inline"]
    t = h.join(cobs, F.col("cobid") == F.col("_c"), "left").select("adj_key", "source_cobid", "cobid",
                                                                   F.coalesce("_hit", F.lit(False)).alias("target_has_data"))
    s = t.join(cobs, F.coalesce("source_cobid", "cobid") == F.col("_c"), "left")
    return s.select("adj_key", "target_has_data", F.coalesce("_hit", F.lit(False)).alias("source_has_data"))


@q("shp_pivot_chart", S.with_views(["hdr_queue"], """
SELECT CAST(date_trunc('month', created_date) AS DATE) AS month,
       count_if(restatement_type = 'Flatten') AS "Flatten", count_if(restatement_type = 'Roll') AS "Roll",
       count_if(restatement_type = 'Scale') AS "Scale"
FROM hdr_queue GROUP BY 1"""))
def shp_pivot_chart(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    p = RP.pivot_counts(h.withColumn("month", F.to_date(F.date_trunc("month", "created_date"))), "month",
                        "restatement_type", ["Flatten", "Roll", "Scale"])
    return p


@q("agg_orig_vs_adj", scale_sql("hdr_inline", True, """
, o AS (SELECT b.entity_code, sum(f.value_usd) AS original FROM fact f LEFT JOIN book_dim b ON f.book_key = b.book_key
        WHERE f.cobid = 19970301 GROUP BY 1),
  dd AS (SELECT b.entity_code, sum(x.value_usd) AS delta FROM b_out x LEFT JOIN book_dim b ON x.book_key = b.book_key
         WHERE x.cobid = 19970301 GROUP BY 1)
SELECT o.entity_code, CAST(o.original AS DOUBLE) AS original, CAST(o.original + coalesce(dd.delta, 0) AS DOUBLE) AS adjusted,
       CAST(coalesce(dd.delta, 0) AS DOUBLE) AS delta,
       round(CAST(coalesce(dd.delta, 0) AS DOUBLE) / nullif(CAST(o.original AS DOUBLE), 0) * 100, 4) AS delta_pct
FROM o LEFT JOIN dd ON o.entity_code IS NOT DISTINCT FROM dd.entity_code"""))
def agg_orig_vs_adj(spark, d):
    v = S.register(spark, d, ["fact", "book_dim"])
    o = attach_attrs(v["fact"].where(F.col("cobid") == 19970301), v, ["entity_code"]).select(
        "entity_code", F.col("value_usd").alias("original"), F.lit(None).cast(VALUE_TYPE).alias("delta"))
    dd = attach_attrs(run_scale(spark, d, "hdr_inline").where(F.col("cobid") == 19970301), v, ["entity_code"]).select(
        "entity_code", F.lit(None).cast("decimal(18,2)").alias("original"), F.col("value_usd").alias("delta"))
    g = o.unionByName(dd).groupBy("entity_code").agg(F.sum("original").alias("original"), F.sum("delta").alias("delta")) \
        .where(F.col("original").isNotNull())
    dl = F.coalesce("delta", F.lit(0))
    return g.select("entity_code", F.col("original").cast("double").alias("original"),
                    (F.col("original") + dl).cast("double").alias("adjusted"), dl.cast("double").alias("delta"),
                    F.round(dl.cast("double") / F.nullif(F.col("original").cast("double"), F.lit(0)) * 100, 4).alias("delta_pct"))


@q("agg_avg_outliers", scale_sql("hdr_orders", False, """
, st AS (SELECT h.adj_key, coalesce(c.n, 0) AS rows_, CAST(h.scale_factor AS DOUBLE) AS factor,
                CASE WHEN h.source_system_code IS NULL THEN NULL ELSE 'T' END AS ticket
         FROM hdr_orders h LEFT JOIN (SELECT restatement_id, count(*) AS n FROM b_out GROUP BY 1) c
           ON h.restatement_id = c.restatement_id),
  g AS (SELECT avg(rows_) AS ar, avg(factor) AS af, stddev_pop(factor) AS sf FROM st),
  f AS (SELECT st.adj_key, list_filter([CASE WHEN rows_ > ar * 2.5 THEN 'ROWS_ABOVE_2.5X_MEAN' END,
          CASE WHEN abs(factor - 1) > 0.10 THEN 'FACTOR_CHANGE_OVER_10PCT' END,
          CASE WHEN abs(factor - af) > 2 * sf THEN 'FACTOR_OUTSIDE_2_SIGMA' END,
          CASE WHEN rows_ > 50 AND ticket IS NULL THEN 'LARGE_WITHOUT_TICKET' END], lambda x: x IS NOT NULL) AS fl
        FROM st CROSS JOIN g)
SELECT adj_key, unnest(fl) AS anomaly FROM f"""))
def agg_avg_outliers(spark, d):
    h = S.register(spark, d, ["hdr_orders"])["hdr_orders"]
    c = run_scale(spark, d, "hdr_orders", with_prior=False).groupBy("restatement_id").agg(F.count(F.lit(1)).alias("n"))
    st = h.join(c, "restatement_id", "left").select(
        "adj_key", F.coalesce("n", F.lit(0)).alias("rows_"), F.col("scale_factor").cast("double").alias("factor"),
        F.when(F.col("source_system_code").isNotNull(), F.lit("T")).alias("ticket"))
    return RP.anomalies(st, "adj_key", "rows_", "factor", "ticket")


@q("jn_activity_feed", S.with_views(["hdr_queue", "status_history"], """
SELECT adj_key, process_type, username AS actor, 'Submitted' AS event_type, created_date AS event_time FROM hdr_queue
UNION ALL
SELECT s.adj_key, h.process_type, s.changed_by, s.new_status, s.changed_at
FROM status_history s JOIN hdr_queue h ON s.adj_key = 'USR-' || CAST(h.restatement_id - 1000 AS VARCHAR)"""))
def jn_activity_feed(spark, d):
    v = S.register(spark, d, ["hdr_queue", "status_history"])
    h = v["hdr_queue"]
    hist = v["status_history"]
    hk = h.withColumn("_user_key", F.concat(F.lit("USR-"), (F.col("restatement_id") - 1000).cast("string")))
    sub = h.select("adj_key", "process_type", F.col("username").alias("actor"), F.lit("Submitted").alias("event_type"),
                   F.col("created_date").alias("event_time"))
    ch = hist.join(hk.select("_user_key", "process_type"), F.col("adj_key") == F.col("_user_key")).select(
        "adj_key", "process_type", F.col("changed_by").alias("actor"), F.col("new_status").alias("event_type"),
        F.col("changed_at").alias("event_time"))
    return sub.unionByName(ch)


@q("jn_track", S.with_views(["hdr_queue"], """
SELECT h.adj_key, h.run_status, b.restatement_id AS blocked_by_dim_id,
  CASE WHEN h.run_status = 'Failed' THEN 'Failed' WHEN h.run_status LIKE 'Rejected%' THEN 'Rejected'
       WHEN h.run_status = 'Processed' THEN 'PBI Queued' WHEN h.run_status = 'Running' THEN 'Processing'
       WHEN h.run_status = 'Approved' THEN 'Approved' WHEN h.run_status = 'Pending Approval' THEN 'Pending Approval'
       WHEN h.run_status = 'Pending' THEN 'Submitted' ELSE h.run_status END AS current_stage
FROM hdr_queue h LEFT JOIN hdr_queue b ON b.adj_key = h.blocked_by_adj_id"""))
def jn_track(spark, d):
    from restate.operators.workflow import lifecycle_stage
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    b = h.select(F.col("adj_key").alias("_bk"), F.col("restatement_id").alias("blocked_by_dim_id"))
    return h.join(b, F.col("blocked_by_adj_id") == F.col("_bk"), "left").select(
        "adj_key", "run_status", "blocked_by_dim_id", lifecycle_stage().alias("current_stage"))


@q("jn_recent_decisions", S.with_views(["status_history"], """
SELECT adj_key, event_id, old_status, new_status, changed_by, changed_at FROM status_history
WHERE old_status = 'Pending Approval' AND new_status IN ('Approved', 'Failed')
ORDER BY changed_at DESC, event_id DESC LIMIT 20"""))
def jn_recent_decisions(spark, d):
    h = S.register(spark, d, ["status_history"])["status_history"]
    x = h.where((F.col("old_status") == "Pending Approval") & F.col("new_status").isin("Approved", "Failed"))
    return RP.top_n(x.select("adj_key", "event_id", "old_status", "new_status", "changed_by", "changed_at"),
                    [F.col("changed_at").desc(), F.col("event_id").desc()], 20)


@q("win_latest_history", S.with_views(["status_history"], """
SELECT adj_key, max_by(new_status, struct_pack(t := changed_at, e := event_id)) AS latest_status,
       max(changed_at) AS latest_at FROM status_history GROUP BY adj_key"""))
def win_latest_history(spark, d):
    h = S.register(spark, d, ["status_history"])["status_history"]
    return h.groupBy("adj_key").agg(F.max_by("new_status", F.struct("changed_at", "event_id")).alias("latest_status"),
                                    F.max("changed_at").alias("latest_at"))


@q("win_share_of_run", S.with_views(["status_history"], """
SELECT adj_key, event_id, value, sum(value) OVER (PARTITION BY adj_key) AS run_total FROM status_history"""))
def win_share_of_run(spark, d):
    from restate.operators.delta import group_totals
    h = S.register(spark, d, ["status_history"])["status_history"].select("adj_key", "event_id", "value")
    return group_totals(h, ["adj_key"], {"run_total": F.sum("value")})


@q("win_group_zero_flag", S.with_views(["stage_direct"], """
SELECT order_key, line_no, part_key, supp_key,
       coalesce(sum(abs(coalesce(TRY_CAST(value_usd AS DECIMAL(38,6)), 0))) OVER (PARTITION BY order_key), 0) = 0 AS all_zero
FROM stage_direct"""))
def win_group_zero_flag(spark, d):
    from restate.operators.delta import group_zero_flag
    s = S.register(spark, d, ["stage_direct"])["stage_direct"].select(
        "order_key", "line_no", "part_key", "supp_key",
        F.coalesce(F.expr("try_cast(value_usd AS decimal(38,6))"), F.lit(0)).alias("v"))
    return group_zero_flag(s, ["order_key"], "v").drop("v")
