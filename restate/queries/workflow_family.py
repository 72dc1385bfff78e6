"""Registered queries: sign-off gate/sync/propagate/summary, decisions,
transitions, queue eligibility, reaping, milestones, access control."""

from __future__ import annotations

from pyspark.sql import functions as F

from restate.functions.text import duration_text
from restate.operators import workflow as W
from restate.queries import standin as S
from restate.queries.common import Query

QUERIES: list[Query] = []


def q(name, sql=None):
    def deco(fn):
        QUERIES.append(Query(name, fn, sql))
        return fn
    return deco


NOW = "1998-06-01 00:00:00"

_GATE_SQL = S.with_views(["hdr_queue", "signoff_status", "signoff_feed"], """
WITH st AS (SELECT cobid, upper(trim(process_type)) AS scope, coalesce(upper(trim(entity_code)), '*') AS entity,
                   upper(trim(sign_off_status)) AS s FROM signoff_status),
 v AS (SELECT cobid, scope, entity,
              CASE WHEN max(CASE WHEN s IN ('SIGNED_OFF', 'REOPEN_REQUESTED', 'SIGNOFF_REQUESTED') THEN 1 ELSE 0 END) = 1 THEN TRUE
                   WHEN max(CASE WHEN s = 'REOPENED' THEN 1 ELSE 0 END) = 1 THEN FALSE END AS verdict
       FROM st GROUP BY ALL),
 anyb AS (SELECT cobid, scope, max(CASE WHEN coalesce(verdict, FALSE) THEN 1 ELSE 0 END) AS ab FROM v GROUP BY ALL),
 reo AS (SELECT cobid, upper(trim(process_type)) AS scope, upper(trim(entity_code)) AS entity
         FROM signoff_status WHERE upper(trim(sign_off_status)) = 'REOPENED'),
 f AS (SELECT cobid, upper(trim(process_type)) AS scope, upper(trim(entity_code)) AS entity FROM signoff_feed u
       WHERE upper(trim(publish_status)) = 'SIGNEDOFF'
         AND NOT EXISTS (SELECT 1 FROM reo WHERE reo.cobid = u.cobid AND reo.scope = upper(trim(u.process_type))
                         AND (reo.entity = upper(trim(u.entity_code)) OR reo.entity = '*'))),
 fa AS (SELECT DISTINCT cobid, scope FROM f)
SELECT h.adj_key, h.cobid, h.process_type, h.entity_code,
  CASE WHEN h.entity_code IS NOT NULL THEN coalesce(ev.verdict, sv.verdict, fe.entity IS NOT NULL, FALSE)
       ELSE coalesce(ab.ab, 0) = 1 OR fa.cobid IS NOT NULL END AS signoff_blocked
FROM hdr_queue h
LEFT JOIN v ev ON ev.cobid = h.cobid AND ev.scope = upper(trim(h.process_type)) AND ev.entity = upper(trim(h.entity_code)) AND ev.entity <> '*'
LEFT JOIN v sv ON sv.cobid = h.cobid AND sv.scope = upper(trim(h.process_type)) AND sv.entity = '*'
LEFT JOIN anyb ab ON ab.cobid = h.cobid AND ab.scope = upper(trim(h.process_type))
LEFT JOIN (SELECT DISTINCT * FROM f) fe ON fe.cobid = h.cobid AND fe.scope = upper(trim(h.process_type)) AND fe.entity = upper(trim(h.entity_code))
LEFT JOIN fa ON fa.cobid = h.cobid AND fa.scope = upper(trim(h.process_type))""")


@q("jn_signoff_gate", _GATE_SQL)
def jn_signoff_gate(spark, d):
    v = S.register(spark, d, ["hdr_queue", "signoff_status", "signoff_feed"])
    req = v["hdr_queue"].select("adj_key", "cobid", "process_type", "entity_code")
    return W.signoff_gate(req, v["signoff_status"], v["signoff_feed"])


@q("jn_signoff_legacy", S.with_views(["hdr_queue", "signoff_feed"], """
SELECT h.adj_key, CASE WHEN upper(h.restatement_type) = 'ROLL' THEN 'Pending'
                       WHEN upper(f.publish_status) = 'SIGNEDOFF' THEN 'Rejected' ELSE 'Pending' END AS gate_status
FROM hdr_queue h LEFT JOIN signoff_feed f ON f.cobid = h.cobid AND f.process_type = h.process_type
 AND f.entity_code = h.entity_code"""))
def jn_signoff_legacy(spark, d):
    """Left join to the sign-off feed; ten-day (here: roll) requests bypass the gate."""
    v = S.register(spark, d, ["hdr_queue", "signoff_feed"])
    f = v["signoff_feed"].select(F.col("cobid").alias("_c"), F.col("process_type").alias("_p"),
                                 F.col("entity_code").alias("_e"), "publish_status")
    j = v["hdr_queue"].join(f, (F.col("cobid") == F.col("_c")) & (F.col("process_type") == F.col("_p"))
                            & (F.col("entity_code") == F.col("_e")), "left")
    st = (F.when(F.upper("restatement_type") == "ROLL", "Pending")
          .when(F.upper("publish_status") == "SIGNEDOFF", "Rejected").otherwise("Pending"))
    return j.select("adj_key", st.alias("gate_status"))


@q("jn_signoff_cutoff", S.with_views(["hdr_queue", "signoff_feed"], """
SELECT h.adj_key, h.cobid, h.created_date FROM hdr_queue h
LEFT JOIN signoff_feed f ON f.cobid = h.cobid AND f.process_type = h.process_type AND f.entity_code = h.entity_code
WHERE h.created_date <= coalesce(f.signoff_update_time, h.process_date, h.created_date)"""))
def jn_signoff_cutoff(spark, d):
    v = S.register(spark, d, ["hdr_queue", "signoff_feed"])
    f = v["signoff_feed"].select(F.col("cobid").alias("_c"), F.col("process_type").alias("_p"),
                                 F.col("entity_code").alias("_e"), "signoff_update_time")
    j = v["hdr_queue"].join(f, (F.col("cobid") == F.col("_c")) & (F.col("process_type") == F.col("_p"))
                            & (F.col("entity_code") == F.col("_e")), "left")
    return j.where(F.col("created_date") <= F.coalesce("signoff_update_time", "process_date", "created_date")) \
        .select("adj_key", "cobid", "created_date")


@q("jn_signoff_sync", S.with_views(["signoff_status", "signoff_feed"], """
SELECT s.cobid, s.process_type, s.entity_code, s.sub_type,
       CASE WHEN upper(s.sign_off_status) = 'OPEN' AND upper(f.publish_status) = 'SIGNEDOFF' THEN 'SIGNED_OFF'
            ELSE s.sign_off_status END AS sign_off_status,
       CASE WHEN upper(s.sign_off_status) = 'OPEN' AND upper(f.publish_status) = 'SIGNEDOFF' THEN 'FLIP' ELSE 'KEEP' END AS action
FROM signoff_status s LEFT JOIN signoff_feed f ON f.cobid = s.cobid AND f.process_type = s.process_type
 AND f.entity_code = s.entity_code
UNION ALL
SELECT f.cobid, f.process_type, f.entity_code, 'ALL',
       CASE WHEN upper(f.publish_status) = 'SIGNEDOFF' THEN 'SIGNED_OFF' ELSE 'OPEN' END, 'INSERT'
FROM signoff_feed f WHERE NOT EXISTS (SELECT 1 FROM signoff_status s WHERE s.cobid = f.cobid
 AND s.process_type = f.process_type AND s.entity_code = f.entity_code)"""))
def jn_signoff_sync(spark, d):
    v = S.register(spark, d, ["signoff_status", "signoff_feed"])
    return W.signoff_sync(v["signoff_feed"], v["signoff_status"])


NATIVE = ("HOUSEHOLD", "BUILDING")


@q("jn_signoff_propagate", S.with_views(["signoff_status", "signoff_feed"], """
WITH ev AS (SELECT cobid, process_type, entity_code,
                   CASE WHEN sign_off_status = 'SIGNED_OFF' THEN 'SIGNEDOFF' ELSE sign_off_status END AS np
            FROM signoff_status WHERE sub_type = 'CVA' AND sign_off_status IN ('SIGNED_OFF', 'REOPENED'))
SELECT f.cobid, f.process_type, f.entity_code, coalesce(ev.np, f.publish_status) AS publish_status,
       CASE WHEN ev.np IS NOT NULL THEN 'UPDATE' ELSE 'KEEP' END AS action
FROM signoff_feed f LEFT JOIN ev ON ev.cobid = f.cobid AND ev.process_type = f.process_type AND ev.entity_code = f.entity_code
UNION ALL
SELECT ev.cobid, ev.process_type, ev.entity_code, ev.np, 'INSERT' FROM ev
WHERE ev.process_type IN ('HOUSEHOLD', 'BUILDING') AND NOT EXISTS (SELECT 1 FROM signoff_feed f
  WHERE f.cobid = ev.cobid AND f.process_type = ev.process_type AND f.entity_code = ev.entity_code)"""))
def jn_signoff_propagate(spark, d):
    v = S.register(spark, d, ["signoff_status", "signoff_feed"])
    ev = v["signoff_status"].where((F.col("sub_type") == "CVA") & F.col("sign_off_status").isin("SIGNED_OFF", "REOPENED")) \
        .select("cobid", "process_type", "entity_code", F.col("sign_off_status").alias("new_status"))
    return W.signoff_propagate(ev, v["signoff_feed"], NATIVE)


@q("agg_signoff_summary", S.with_views(["signoff_status"], """
WITH g AS (SELECT cobid, process_type,
   min(CASE WHEN upper(trim(sign_off_status)) IN ('SIGNOFF_REQUESTED', 'REOPEN_REQUESTED')
            THEN struct_pack(e := entity_code, s := upper(trim(sign_off_status))) END) AS p,
   count(*) AS n_rows,
   sum(CASE WHEN upper(trim(sign_off_status)) IN ('SIGNED_OFF', 'REOPEN_REQUESTED', 'SIGNOFF_REQUESTED') THEN 1 ELSE 0 END) AS n_blocked,
   sum(CASE WHEN upper(trim(sign_off_status)) = 'SIGNED_OFF' THEN 1 ELSE 0 END) AS n_signed,
   sum(CASE WHEN upper(trim(sign_off_status)) = 'REOPENED' THEN 1 ELSE 0 END) AS n_reopened
   FROM signoff_status GROUP BY ALL)
SELECT cobid, process_type,
  CASE WHEN p IS NOT NULL THEN CASE WHEN p.s = 'SIGNOFF_REQUESTED' THEN 'SIGN-OFF PENDING' ELSE 'RE-OPEN PENDING' END
       WHEN n_blocked = n_rows THEN 'SIGNED OFF' WHEN n_signed > 0 THEN 'PARTIALLY SIGNED OFF'
       WHEN n_reopened > 0 THEN 'RE-OPENED' ELSE 'OPEN' END AS effective_status,
  CASE WHEN n_blocked = n_rows THEN 'Blocked' WHEN n_blocked > 0 THEN 'Blocked for ' || n_blocked || '/' || n_rows || ' entities'
       ELSE 'Allowed' END AS submissions, n_rows, CAST(n_blocked AS BIGINT) AS n_blocked
FROM g"""))
def agg_signoff_summary(spark, d):
    v = S.register(spark, d, ["signoff_status"])
    return W.signoff_summary(v["signoff_status"]).withColumn("n_blocked", F.col("n_blocked").cast("long"))


@q("agg_row_set_status", S.with_views(["signoff_status"], """
SELECT cobid, process_type, entity_code,
  max_by(upper(trim(sign_off_status)), struct_pack(r := CASE upper(trim(sign_off_status)) WHEN 'SIGNED_OFF' THEN 4
         WHEN 'SIGNOFF_REQUESTED' THEN 3 WHEN 'REOPEN_REQUESTED' THEN 2 WHEN 'REOPENED' THEN 1 WHEN 'OPEN' THEN 0 ELSE -1 END,
         s := upper(trim(sign_off_status)))) AS worst_status
FROM signoff_status GROUP BY ALL"""))
def agg_row_set_status(spark, d):
    v = S.register(spark, d, ["signoff_status"])
    return W.worst_status(v["signoff_status"], ["cobid", "process_type", "entity_code"])


@q("adj_decide", S.with_views(["hdr_queue", "decisions", "approvers"], """
WITH a AS (SELECT DISTINCT upper(trim(approver)) AS ap, upper(trim(process_type)) AS sc FROM approvers WHERE is_active)
SELECT d.adj_key, d.approver, d.decision,
  CASE WHEN h.adj_key IS NULL THEN 'Refused: unknown restatement'
       WHEN h.run_status <> 'Pending Approval' THEN 'Refused: not pending approval'
       WHEN upper(trim(d.approver)) = upper(trim(h.username)) THEN 'Refused: approver is the submitter'
       WHEN a.ap IS NULL THEN 'Refused: not an approver for this scope'
       WHEN lower(d.decision) = 'approve' THEN 'Approved' WHEN lower(d.decision) = 'reject' THEN 'Rejected'
       ELSE 'Refused: unknown decision' END AS outcome
FROM decisions d LEFT JOIN hdr_queue h ON d.adj_key = h.adj_key
LEFT JOIN a ON a.ap = upper(trim(d.approver)) AND a.sc = upper(trim(h.process_type))"""))
def adj_decide(spark, d):
    v = S.register(spark, d, ["hdr_queue", "decisions", "approvers"])
    return W.decide(v["hdr_queue"], v["decisions"], v["approvers"])


@q("flt_state_guard", S.with_views(["hdr_queue", "decisions"], """
SELECT d.adj_key, 'Approved' AS new_status FROM decisions d JOIN hdr_queue h ON d.adj_key = h.adj_key
WHERE h.run_status IN ('Pending Approval') AND lower(d.decision) = 'approve'"""))
def flt_state_guard(spark, d):
    v = S.register(spark, d, ["hdr_queue", "decisions"])
    h = v["hdr_queue"].select(F.col("adj_key").alias("_k"), "run_status")
    j = v["decisions"].join(h, F.col("adj_key") == F.col("_k"))
    return j.where(F.col("run_status").isin("Pending Approval") & (F.lower("decision") == "approve")) \
        .select("adj_key", F.lit("Approved").alias("new_status"))


@q("jn_approver_check", S.with_views(["hdr_queue", "decisions", "approvers"], """
SELECT d.adj_key, d.approver FROM decisions d JOIN hdr_queue h ON d.adj_key = h.adj_key
WHERE upper(d.approver) <> upper(h.username)
  AND EXISTS (SELECT 1 FROM approvers a WHERE a.is_active AND a.approver = d.approver AND a.process_type = h.process_type)"""))
def jn_approver_check(spark, d):
    v = S.register(spark, d, ["hdr_queue", "decisions", "approvers"])
    h = v["hdr_queue"].select(F.col("adj_key").alias("_k"), F.col("username").alias("_u"), F.col("process_type").alias("_pt"))
    a = v["approvers"].where("is_active").select(F.col("approver").alias("_a"), F.col("process_type").alias("_apt"))
    j = v["decisions"].join(h, F.col("adj_key") == F.col("_k")).where(F.upper("approver") != F.upper("_u"))
    return j.join(a, (F.col("approver") == F.col("_a")) & (F.col("_pt") == F.col("_apt")), "left_semi") \
        .select("adj_key", "approver")


@q("adj_transition_check", S.with_views(["status_history"], """
WITH t AS (SELECT adj_key, event_id, upper(replace(old_status, ' ', '_')) AS old_status,
                  upper(replace(new_status, ' ', '_')) AS new_status FROM status_history)
SELECT adj_key, event_id, old_status, new_status,
  (old_status, new_status) IN (('DRAFT', 'PENDING_APPROVAL'), ('PENDING_APPROVAL', 'APPROVED'),
   ('PENDING_APPROVAL', 'REJECTED'), ('APPROVED', 'APPLIED'), ('APPLIED', 'REVERSED')) AS is_valid
FROM t"""))
def adj_transition_check(spark, d):
    v = S.register(spark, d, ["status_history"])
    t = v["status_history"].select("adj_key", "event_id",
                                   F.upper(F.regexp_replace("old_status", " ", "_")).alias("old_status"),
                                   F.upper(F.regexp_replace("new_status", " ", "_")).alias("new_status"))
    return W.transition_check(t)


@q("flt_eligible_queue", S.with_views(["hdr_queue"], """
SELECT adj_key, process_type, cobid, run_status FROM hdr_queue
WHERE run_status IN ('Pending', 'Approved') AND blocked_by_adj_id IS NULL AND NOT coalesce(is_deleted, FALSE)"""))
def flt_eligible_queue(spark, d):
    v = S.register(spark, d, ["hdr_queue"])
    return W.eligible(v["hdr_queue"]).select("adj_key", "process_type", "cobid", "run_status")


@q("flt_stale_running", S.with_views(["hdr_queue"], f"""
SELECT adj_key, 'Failed' AS run_status FROM hdr_queue
WHERE run_status = 'Running' AND start_date < TIMESTAMP '{NOW}' - INTERVAL '240' MINUTE"""))
def flt_stale_running(spark, d):
    v = S.register(spark, d, ["hdr_queue"])
    return W.reap_stale(v["hdr_queue"], NOW).select("adj_key", "run_status")


@q("flt_abandoned_stage", S.with_views(["hdr_queue"], f"""
SELECT process_type, count(*) AS kept FROM hdr_queue
WHERE created_date >= TIMESTAMP '{NOW}' - INTERVAL '2' DAY GROUP BY process_type"""))
def flt_abandoned_stage(spark, d):
    v = S.register(spark, d, ["hdr_queue"])
    return W.purge_stage(v["hdr_queue"], NOW, "created_date").groupBy("process_type").agg(
        F.count(F.lit(1)).alias("kept"))


@q("flt_broad_scope", S.with_views(["hdr_queue"], """
SELECT adj_key, (entity_code IS NOT NULL AND book_code IS NULL AND department_code IS NULL) AS is_broad
FROM hdr_queue"""))
def flt_broad_scope(spark, d):
    v = S.register(spark, d, ["hdr_queue"])
    return v["hdr_queue"].select("adj_key", W.is_broad().alias("is_broad"))


@q("agg_milestones", S.with_views(["status_history"], """
SELECT adj_key,
  min(CASE WHEN new_status = 'Approved' THEN changed_at END) AS approved_at,
  min_by(CASE WHEN new_status = 'Approved' THEN changed_by END, CASE WHEN new_status = 'Approved' THEN changed_at END) AS approved_by,
  min(CASE WHEN new_status = 'Processed' THEN changed_at END) AS processed_at,
  min_by(CASE WHEN new_status = 'Processed' THEN changed_by END, CASE WHEN new_status = 'Processed' THEN changed_at END) AS processed_by,
  min(CASE WHEN new_status = 'Failed' THEN changed_at END) AS failed_at,
  min_by(CASE WHEN new_status = 'Failed' THEN changed_by END, CASE WHEN new_status = 'Failed' THEN changed_at END) AS failed_by
FROM status_history GROUP BY adj_key"""))
def agg_milestones(spark, d):
    v = S.register(spark, d, ["status_history"])
    return W.milestones(v["status_history"])


@q("prj_lifecycle_stage", S.with_views(["hdr_queue"], """
SELECT adj_key, CASE WHEN run_status = 'Failed' THEN 'Failed' WHEN run_status LIKE 'Rejected%' THEN 'Rejected'
  WHEN run_status = 'Processed' THEN 'PBI Queued' WHEN run_status = 'Running' THEN 'Processing'
  WHEN run_status = 'Approved' THEN 'Approved' WHEN run_status = 'Pending Approval' THEN 'Pending Approval'
  WHEN run_status = 'Pending' THEN 'Submitted' ELSE run_status END AS current_stage
FROM hdr_queue"""))
def prj_lifecycle_stage(spark, d):
    v = S.register(spark, d, ["hdr_queue"])
    return v["hdr_queue"].select("adj_key", W.lifecycle_stage().alias("current_stage"))


@q("flt_row_access", S.with_views(["book_dim", "customer", "nation"], """
SELECT b.book_key, b.entity_code FROM book_dim b
WHERE upper(b.entity_code) IN (SELECT upper(n.n_name) FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                               WHERE upper(c.c_name) = 'CUSTOMER#000000007')"""))
def flt_row_access(spark, d):
    v = S.register(spark, d, ["book_dim", "customer", "nation"])
    grants = v["customer"].join(v["nation"], F.col("c_nationkey") == F.col("n_nationkey")) \
        .select(F.col("c_name").alias("user_name"), F.col("n_name").alias("entity_code"))
    return W.row_access(v["book_dim"].select("book_key", "entity_code"), grants, "Customer#000000007")


@q("flt_mask_column", S.with_views(["book_dim"], """
SELECT book_key, book_code, CAST(NULL AS DOUBLE) AS book_limit FROM book_dim"""))
def flt_mask_column(spark, d):
    v = S.register(spark, d, ["book_dim"])
    return W.mask(v["book_dim"].select("book_key", "book_code", "book_limit"), "book_limit", privileged=False)


@q("jn_recipients", S.with_views(["hdr_queue", "approvers"], """
WITH ev AS (SELECT adj_key AS event_id, process_type, 'submitted' AS event_type, username AS actor FROM hdr_queue
            WHERE run_status = 'Pending Approval'),
 prefs AS (SELECT approver AS user_name, 'submitted' AS event_type,
                  CASE WHEN length(approver) % 2 = 0 THEN NULL ELSE process_type END AS process_type FROM approvers)
SELECT DISTINCT ev.event_id, a.approver AS recipient FROM ev
JOIN approvers a ON a.is_active AND a.process_type = ev.process_type
JOIN prefs p ON p.user_name = a.approver AND p.event_type = ev.event_type
 AND (p.process_type IS NULL OR p.process_type = ev.process_type)
WHERE a.approver <> ev.actor"""))
def jn_recipients(spark, d):
    v = S.register(spark, d, ["hdr_queue", "approvers"])
    ev = v["hdr_queue"].where(F.col("run_status") == "Pending Approval").select(
        F.col("adj_key").alias("event_id"), "process_type", F.lit("submitted").alias("event_type"),
        F.col("username").alias("actor"))
    prefs = v["approvers"].select(F.col("approver").alias("user_name"), F.lit("submitted").alias("event_type"),
                                  F.when(F.length("approver") % 2 == 0, F.lit(None)).otherwise(F.col("process_type"))
                                  .alias("process_type"))
    return W.recipients(ev, v["approvers"], prefs)


@q("prj_pct_of_total", S.with_views(["status_history"], """
WITH steps AS (SELECT adj_key AS run_log_id, new_status AS step_name, sum(value) AS duration_sec
               FROM status_history GROUP BY ALL)
SELECT run_log_id, step_name, duration_sec,
       round(100 * coalesce(duration_sec, 0) / nullif(sum(coalesce(duration_sec, 0)) OVER (PARTITION BY run_log_id), 0), 1) AS pct_of_run
FROM steps"""))
def prj_pct_of_total(spark, d):
    v = S.register(spark, d, ["status_history"])
    steps = v["status_history"].groupBy(F.col("adj_key").alias("run_log_id"), F.col("new_status").alias("step_name")) \
        .agg(F.sum("value").alias("duration_sec"))
    return W.share_of_run(steps, "run_log_id", "duration_sec")


@q("prj_activity_grid", S.with_views(["hdr_queue"], """
SELECT adj_key, coalesce(entity_code, '—') AS entity, coalesce(department_code, '—') AS department,
       strftime(created_date, '%Y-%m-%d %H:%M') AS created,
       CASE WHEN process_date IS NULL OR start_date IS NULL THEN '—'
            WHEN epoch(process_date) - epoch(start_date) >= 3600
              THEN CAST(CAST(floor((epoch(process_date) - epoch(start_date)) / 3600) AS BIGINT) AS VARCHAR) || 'h '
                   || CAST(CAST(floor(((epoch(process_date) - epoch(start_date)) % 3600) / 60) AS BIGINT) AS VARCHAR) || 'm'
            WHEN epoch(process_date) - epoch(start_date) >= 60
              THEN CAST(CAST(floor((epoch(process_date) - epoch(start_date)) / 60) AS BIGINT) AS VARCHAR) || 'm '
                   || CAST(CAST((epoch(process_date) - epoch(start_date)) % 60 AS BIGINT) AS VARCHAR) || 's'
            ELSE CAST(CAST(epoch(process_date) - epoch(start_date) AS BIGINT) AS VARCHAR) || 's' END AS duration,
       format('{:,.2f}', CAST(restatement_value_in_usd AS DOUBLE)) AS value_usd
FROM hdr_queue"""))
def prj_activity_grid(spark, d):
    v = S.register(spark, d, ["hdr_queue"])
    h = v["hdr_queue"]
    secs = F.unix_timestamp("process_date") - F.unix_timestamp("start_date")
    return h.select("adj_key", F.coalesce("entity_code", F.lit("—")).alias("entity"),
                    F.coalesce("department_code", F.lit("—")).alias("department"),
                    F.date_format("created_date", "yyyy-MM-dd HH:mm").alias("created"),
                    duration_text(secs).alias("duration"),
                    F.format_number(F.col("restatement_value_in_usd").cast("double"), 2).alias("value_usd"))


@q("prj_search_text", S.with_views(["hdr_queue"], """
SELECT adj_key, lower(concat_ws(' ', adj_key, process_type, restatement_type, entity_code, department_code,
                                source_system_code, currency_code, username, run_status)) AS search_text
FROM hdr_queue"""))
def prj_search_text(spark, d):
    v = S.register(spark, d, ["hdr_queue"])
    return v["hdr_queue"].select("adj_key", F.lower(F.concat_ws(
        " ", "adj_key", "process_type", "restatement_type", "entity_code", "department_code",
        "source_system_code", "currency_code", "username", "run_status")).alias("search_text"))
