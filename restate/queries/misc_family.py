"""Registered queries: reconciliation, dev/prod parity, business checks, fan-out,
calendar and publish actions, deterministic ids and batch submit, registry
numbering, sign-off lifecycle, recurring templates, legacy loaders."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from restate.functions.keys import row_key, uuid5
from restate.functions.text import compose_reason
from restate.operators import delta as D
from restate.operators import recon as RC
from restate.operators import report as RP
from restate.operators import shape as SH
from restate.operators.match import active_filters
from restate.plans import preview as PV
from restate.queries import standin as S
from restate.queries.common import Query, attach_attrs, current_deltas, doubles, prior_deltas, run_scale, scale_sql

QUERIES: list[Query] = []


def q(name, sql=None):
    def deco(fn):
        QUERIES.append(Query(name, fn, sql))
        return fn
    return deco


WILD = " AND ".join(f"(h.{c} IS NULL OR upper(trim(h.{c})) = upper(trim(CAST(f.{a} AS VARCHAR))))"
                    for c, a in S.FILTER_MAP.items())
NOW = "1998-06-01 00:00:00"
# Fixed value: namespace for deterministic request ids (RFC 4122 URL namespace).
ID_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"

# -- reconciliation ------------------------------------------------------------

_RECON_SQL = scale_sql("hdr_inline", True, f"""
, o AS (SELECT h.adj_key, sum(f.value_usd) AS original_total FROM fa f JOIN hdr_inline h ON f.cobid = h.cobid AND {WILD}
        GROUP BY h.adj_key),
  comb AS (SELECT cobid, value_usd, entity_code, department_code, book_code, instrument_code, product_type, strategy,
                  trade_typology, source_system_code, currency_code FROM fa
           UNION ALL SELECT cobid, value_usd, entity_code, department_code, book_code, instrument_code, product_type,
                  strategy, trade_typology, source_system_code, currency_code FROM pa),
  s AS (SELECT h.adj_key, sum(f.value_usd) AS source_total FROM comb f JOIN hdr_inline h
        ON coalesce(h.source_cobid, h.cobid) <> h.cobid AND f.cobid = h.source_cobid AND {WILD} GROUP BY h.adj_key),
  w AS (SELECT h.adj_key, sum(x.value_usd) AS written_delta FROM b_out x JOIN hdr_inline h ON x.restatement_id = h.restatement_id
        GROUP BY h.adj_key),
  j AS (SELECT h.*, o.original_total, s.source_total, w.written_delta,
          CAST(CASE WHEN lower(h.restatement_type) = 'flatten' THEN -CAST(coalesce(o.original_total, 0) AS DECIMAL(28,8))
                    WHEN coalesce(h.source_cobid, h.cobid) <> h.cobid
                      THEN CAST(coalesce(s.source_total, 0) AS DECIMAL(28,8)) * CAST(h.scale_factor AS DECIMAL(12,4))
                           - CAST(coalesce(o.original_total, 0) AS DECIMAL(28,8))
                    ELSE CAST(coalesce(o.original_total, 0) AS DECIMAL(28,8)) * (CAST(h.scale_factor AS DECIMAL(12,4)) - 1)
               END AS DECIMAL(28,8)) AS expected_delta,
          coalesce(h.source_cobid, h.cobid) <> h.cobid AS cross_cob
        FROM hdr_inline h LEFT JOIN o ON h.adj_key = o.adj_key LEFT JOIN s ON h.adj_key = s.adj_key
        LEFT JOIN w ON h.adj_key = w.adj_key)
SELECT adj_key, CAST(original_total AS DOUBLE) AS original_total, CAST(source_total AS DOUBLE) AS source_total,
       CAST(written_delta AS DOUBLE) AS written_delta, CAST(expected_delta AS DOUBLE) AS expected_delta,
  CASE WHEN original_total IS NULL AND written_delta IS NULL AND (NOT cross_cob OR source_total IS NULL) THEN 'NO DATA IN SCOPE'
       WHEN lower(restatement_type) = 'scale' AND NOT cross_cob AND scale_factor = 1 AND written_delta IS NULL THEN 'NO-OP'
       WHEN cross_cob AND source_total IS NULL THEN 'MISSING SOURCE'
       WHEN written_delta IS NULL THEN 'MISSING RESTATEMENT'
       WHEN NOT cross_cob AND original_total IS NULL THEN 'MISSING ORIGINAL'
       WHEN abs(expected_delta - written_delta) < 0.01 THEN 'RECONCILED' ELSE 'BREAK' END AS recon_status
FROM j""")


@q("adj_recon", _RECON_SQL)
def adj_recon(spark, d):
    v = S.register(spark, d, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_inline", "hdr_prior"])
    h = v["hdr_inline"]
    fmap = {c: S.FILTER_MAP[c] for c in active_filters(h, S.FILTER_COLS)}
    fa = attach_attrs(v["fact"], v, fmap.values())
    da = attach_attrs(prior_deltas(spark, d, v), v, fmap.values())
    cols = ["cobid", "value_usd", *sorted(set(fmap.values()))]
    orig = PV.matched(fa.select(*cols), h, fmap, match_on="target").withColumnRenamed("_p_key", "adj_key")
    cross = h.where(F.coalesce("source_cobid", "cobid") != F.col("cobid"))
    src = PV.matched(fa.select(*cols).unionByName(da.select(*cols)), cross, fmap, match_on="source") \
        .withColumnRenamed("_p_key", "adj_key")
    written = run_scale(spark, d, "hdr_inline").join(h.select("restatement_id", "adj_key"), "restatement_id")
    r = RC.reconcile(h, orig, src, written, "adj_key", "value_usd")
    return doubles(r.select("adj_key", "original_total", "source_total", "written_delta", "expected_delta", "recon_status"),
                   ["original_total", "source_total", "written_delta", "expected_delta"])


@q("agg_reconcile_counts", scale_sql("hdr_inline", True, """, cur0 AS (SELECT 1 AS x)
SELECT (SELECT count(*) FROM hdr_inline) AS header_count,
       (SELECT count(DISTINCT restatement_id) FROM (SELECT restatement_id FROM hdr_inline UNION ALL
                                                  SELECT restatement_id FROM hdr_prior)) AS registry_count,
       (SELECT count(DISTINCT restatement_id) FROM (SELECT restatement_id FROM p_out p WHERE NOT EXISTS (
            SELECT 1 FROM b_out b WHERE b.cobid IS NOT DISTINCT FROM p.cobid AND b.trade_key IS NOT DISTINCT FROM p.trade_key
            AND b.line_no IS NOT DISTINCT FROM p.line_no AND b.book_key IS NOT DISTINCT FROM p.book_key
            AND b.instrument_key IS NOT DISTINCT FROM p.instrument_key
            AND b.source_system_code IS NOT DISTINCT FROM p.source_system_code
            AND b.currency_code IS NOT DISTINCT FROM p.currency_code)
          UNION ALL SELECT restatement_id FROM b_out)) AS delta_ids"""))
def agg_reconcile_counts(spark, d):
    v = S.register(spark, d, ["hdr_inline", "hdr_prior"])
    reg = v["hdr_inline"].select("restatement_id").union(v["hdr_prior"].select("restatement_id")).distinct()
    ids = current_deltas(spark, d).select("restatement_id").distinct()
    return RP.three_way(v["hdr_inline"], reg, ids, ("header_count", "registry_count", "delta_ids"))


@q("jn_dev_prod", scale_sql("hdr_inline", True, """
, dev AS (SELECT restatement_id AS adj_no, count(*) AS rows_, sum(value_usd) AS total FROM b_out GROUP BY 1),
  prod AS (SELECT CAST(regexp_extract(h.adj_key, '[0-9]+', 0) AS BIGINT) AS adj_no, count(*) AS rows_, sum(p.value_usd) AS total
           FROM p_out p JOIN hdr_prior h ON p.restatement_id = h.restatement_id GROUP BY 1)
SELECT coalesce(dev.adj_no, prod.adj_no) AS adj_no, coalesce(dev.rows_, 0) AS dev_rows, coalesce(prod.rows_, 0) AS prod_rows,
       CAST(dev.total AS DOUBLE) AS dev_total, CAST(prod.total AS DOUBLE) AS prod_total
FROM dev FULL OUTER JOIN prod ON dev.adj_no = prod.adj_no"""))
def jn_dev_prod(spark, d):
    """Same restatement in two environments side by side; the other side's id is the
    first number in its reference text."""
    v = S.register(spark, d, ["hdr_prior"])
    dev = run_scale(spark, d, "hdr_inline").groupBy(F.col("restatement_id").alias("adj_no")).agg(
        F.count(F.lit(1)).alias("dev_rows"), F.sum("value_usd").alias("dev_total"))
    prod = prior_deltas(spark, d).join(v["hdr_prior"].select("restatement_id", "adj_key"), "restatement_id") \
        .groupBy(F.regexp_extract("adj_key", "[0-9]+", 0).cast("long").alias("adj_no")).agg(
        F.count(F.lit(1)).alias("prod_rows"), F.sum("value_usd").alias("prod_total"))
    j = dev.join(prod, "adj_no", "full_outer")
    return j.select("adj_no", F.coalesce("dev_rows", F.lit(0)).alias("dev_rows"),
                    F.coalesce("prod_rows", F.lit(0)).alias("prod_rows"),
                    F.col("dev_total").cast("double").alias("dev_total"),
                    F.col("prod_total").cast("double").alias("prod_total"))


@q("adj_business_checks", scale_sql("hdr_inline", True, f"""
, pos AS (SELECT DISTINCT f.cobid, f.trade_key, f.line_no, f.book_key, f.instrument_key, f.source_system_code,
                 f.currency_code, f.value_usd FROM fa f JOIN hdr_inline h ON f.cobid = h.cobid AND {WILD}
          WHERE h.restatement_id = 2)
SELECT (SELECT CAST(sum(value_usd) AS DOUBLE) FROM b_out WHERE restatement_id = 2) AS delta_total,
       (SELECT CAST(sum(value_usd) AS DOUBLE) FROM pos) AS original_total,
       (SELECT count(*) FROM b_out WHERE restatement_id = 2) AS delta_rows,
       (SELECT CAST(sum(value_usd) AS DOUBLE) FROM (SELECT cobid, source_system_code, sum(value_usd) AS value_usd
         FROM b_out WHERE restatement_id = 2 GROUP BY ALL)) AS summary_total"""))
def adj_business_checks(spark, d):
    """Delta, original and summary totals for one restatement id (2)."""
    v = S.register(spark, d, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_inline"])
    h = v["hdr_inline"].where(F.col("restatement_id") == 2)
    fmap = {c: S.FILTER_MAP[c] for c in active_filters(h, S.FILTER_COLS)}
    fa = attach_attrs(v["fact"], v, fmap.values())
    orig = PV.matched(fa, h, fmap, match_on="target")
    dl = run_scale(spark, d, "hdr_inline").where(F.col("restatement_id") == 2)
    a = dl.agg(F.sum("value_usd").cast("double").alias("delta_total"), F.count(F.lit(1)).alias("delta_rows"))
    b = orig.agg(F.sum("value_usd").cast("double").alias("original_total"))
    c = D.summarise(dl, ["cobid", "source_system_code"], ["value_usd"]).agg(
        F.sum("value_usd").cast("double").alias("summary_total"))
    return RP.side_by_side(a, b, c)


@q("agg_fanout_report", scale_sql("hdr_inline", True, """
, ids AS (SELECT restatement_id FROM hdr_inline UNION SELECT restatement_id FROM hdr_prior)
SELECT ids.restatement_id, coalesce(p.n, 0) AS rows_prior, coalesce(b.n, 0) AS rows_batch
FROM ids LEFT JOIN (SELECT restatement_id, count(*) AS n FROM p_out GROUP BY 1) p ON ids.restatement_id = p.restatement_id
LEFT JOIN (SELECT restatement_id, count(*) AS n FROM b_out GROUP BY 1) b ON ids.restatement_id = b.restatement_id"""))
def agg_fanout_report(spark, d):
    v = S.register(spark, d, ["hdr_inline", "hdr_prior"])
    ids = v["hdr_inline"].select("restatement_id").union(v["hdr_prior"].select("restatement_id"))
    return RP.fanout(ids, "restatement_id", {"prior": prior_deltas(spark, d), "batch": run_scale(spark, d, "hdr_inline")})


@q("agg_verified_questions", S.with_views(["hdr_queue"], f"""
SELECT (SELECT count(*) FROM hdr_queue WHERE run_status = 'Processed'
          AND process_date >= TIMESTAMP '{NOW}' - INTERVAL '7' DAY AND process_date < TIMESTAMP '{NOW}') AS applied_this_week,
       (SELECT CAST(sum(restatement_value_in_usd) AS DOUBLE) FROM hdr_queue WHERE run_status = 'Processed') AS sum_applied,
       (SELECT count(*) FROM hdr_queue WHERE run_status IN ('Pending', 'Pending Approval')) AS pending,
       (SELECT username FROM hdr_queue GROUP BY username ORDER BY count(*) DESC, username LIMIT 1) AS top_creator"""))
def agg_verified_questions(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    now = F.lit(NOW).cast("timestamp")
    a = h.agg(F.count_if((F.col("run_status") == "Processed") & (F.col("process_date") >= now - F.expr("INTERVAL 7 DAYS"))
                         & (F.col("process_date") < now)).alias("applied_this_week"),
              F.sum(F.when(F.col("run_status") == "Processed", F.col("restatement_value_in_usd"))).cast("double")
              .alias("sum_applied"),
              F.count_if(F.col("run_status").isin("Pending", "Pending Approval")).alias("pending"))
    top = RP.top_n(h.groupBy("username").agg(F.count(F.lit(1)).alias("n")), [F.col("n").desc(), F.col("username")], 1) \
        .select(F.col("username").alias("top_creator"))
    return RP.side_by_side(a, top)


# -- calendar and publish ----------------------------------------------------------

@q("jn_business_days", S.with_views(["lineitem"], """
WITH b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE isodow(l_shipdate) < 6),
 n AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM b)
SELECT x.d AS cob_date, y.d AS prior_date, x.i - y.i AS ordinal FROM n x JOIN n y ON y.i < x.i AND y.i >= x.i - 3"""))
def jn_business_days(spark, d):
    li = S.register(spark, d, ["lineitem"])["lineitem"]
    cal = li.select(F.to_date("l_shipdate").alias("d"))
    return RP.business_days(cal, "d", F.weekday("d") < 5, 3)


@q("win_business_ordinal", S.with_views(["lineitem"], """
SELECT d AS cob_date, row_number() OVER (ORDER BY d DESC) AS days_back FROM
 (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE isodow(l_shipdate) < 6) b"""))
def win_business_ordinal(spark, d):
    li = S.register(spark, d, ["lineitem"])["lineitem"]
    b = li.select(F.to_date("l_shipdate").alias("cob_date")).where(F.weekday("cob_date") < 5).distinct()
    # one row per business day: a calendar, small by construction
    return b.withColumn("days_back", F.row_number().over(Window.orderBy(F.col("cob_date").desc())))


ACTIONS = """
SELECT event_id, 'OBJ_' || CAST(user_id AS VARCHAR) AS object_name, event_type AS dataset_name,
       CAST(strftime(ts, '%Y%m%d') AS INT) AS cobid,
       CASE event_type WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'QUEUED' ELSE 'RUNNING' END AS action_status,
       ts AS request_time,
       '{"cobs":[' || strftime(ts, '%Y%m%d') || '],"paths":{"k":"' || json_extract_string(props, '$.k') || '","type":"' || event_type || '"}}' AS publish_info
FROM events"""


def _actions(spark, d):
    e = S.register(spark, d, ["events"])["events"]
    return e.select("event_id", F.concat(F.lit("OBJ_"), F.col("user_id").cast("string")).alias("object_name"),
                    F.col("event_type").alias("dataset_name"), F.date_format("ts", "yyyyMMdd").cast("int").alias("cobid"),
                    F.when(F.col("event_type") == "purchase", "COMPLETE").when(F.col("event_type") == "error", "FAILED")
                    .when(F.col("event_type") == "view", "QUEUED").otherwise("RUNNING").alias("action_status"),
                    F.col("ts").alias("request_time"),
                    F.concat(F.lit('{"cobs":['), F.date_format("ts", "yyyyMMdd"), F.lit('],"paths":{"k":"'),
                             F.get_json_object("props", "$.k"), F.lit('","type":"'), F.col("event_type"),
                             F.lit('"}}')).alias("publish_info"))


@q("win_publish_seq", S.with_views(["events"], f"""
SELECT event_id, object_name, cobid FROM (SELECT *, row_number() OVER (PARTITION BY object_name
   ORDER BY cobid DESC, request_time DESC, event_id DESC) AS rn FROM ({ACTIONS})) WHERE rn = 1"""))
def win_publish_seq(spark, d):
    a = _actions(spark, d)
    w = Window.partitionBy("object_name").orderBy(F.col("cobid").desc(), F.col("request_time").desc(), F.col("event_id").desc())
    return a.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("event_id", "object_name", "cobid")


@q("agg_max_publish", S.with_views(["events"], f"""
WITH a AS ({ACTIONS}),
 days AS (SELECT DISTINCT cobid FROM a ORDER BY cobid DESC LIMIT 3)
SELECT object_name, max(request_time) AS latest_request, max(event_id) AS latest_run_id FROM a
WHERE cobid IN (SELECT cobid FROM days) GROUP BY object_name"""))
def agg_max_publish(spark, d):
    a = _actions(spark, d)
    days = RP.top_n(a.select("cobid").distinct(), [F.col("cobid").desc()], 3)
    return a.join(days, "cobid", "left_semi").groupBy("object_name").agg(
        F.max("request_time").alias("latest_request"), F.max("event_id").alias("latest_run_id"))


@q("jn_metadata_dedupe", S.with_views(["events"], f"""
WITH a AS ({ACTIONS}),
 cand AS (SELECT DISTINCT object_name, cobid FROM a WHERE dataset_name = 'click')
SELECT c.object_name, c.cobid FROM cand c
WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.action_status = 'QUEUED' AND a.object_name IS NOT DISTINCT FROM c.object_name
                  AND a.cobid IS NOT DISTINCT FROM c.cobid)
  AND NOT EXISTS (SELECT 1 FROM a WHERE a.action_status = 'COMPLETE' AND a.object_name IS NOT DISTINCT FROM c.object_name
                  AND a.cobid > c.cobid)"""))
def jn_metadata_dedupe(spark, d):
    """New publish actions unless one is already waiting for the same object/COB or a newer
    COB already completed (NULL-safe anti joins, hash-joinable)."""
    a = _actions(spark, d)
    cand = a.where(F.col("dataset_name") == "click").select("object_name", "cobid").distinct()
    waiting = a.where(F.col("action_status") == "QUEUED").select(F.col("object_name").alias("_o"), F.col("cobid").alias("_c"))
    out = cand.join(waiting, F.col("object_name").eqNullSafe(F.col("_o")) & F.col("cobid").eqNullSafe(F.col("_c")), "left_anti")
    done = a.where(F.col("action_status") == "COMPLETE").select(F.col("object_name").alias("_o2"), F.col("cobid").alias("_c2"))
    return out.join(done, F.col("object_name").eqNullSafe(F.col("_o2")) & (F.col("_c2") > F.col("cobid")), "left_anti")


@q("shp_explode_publish", S.with_views(["events"], f"""
WITH a AS ({ACTIONS})
SELECT event_id, CAST(unnest(json_extract(publish_info, '$.cobs')::INT[]) AS INT) AS cobid,
       'k' AS path_key, json_extract_string(publish_info, '$.paths.k') AS path_value FROM a
UNION ALL
SELECT event_id, CAST(json_extract(publish_info, '$.cobs[0]') AS INT), 'type', json_extract_string(publish_info, '$.paths.type') FROM a"""))
def shp_explode_publish(spark, d):
    return SH.explode_publish(_actions(spark, d), "publish_info", keep=["event_id"])


@q("adj_publish", S.with_views(["events"], f"""
WITH a AS ({ACTIONS}),
 cand AS (SELECT DISTINCT object_name, cobid FROM a WHERE dataset_name = 'click'),
 keep AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.action_status = 'QUEUED'
          AND a.object_name = c.object_name AND a.cobid = c.cobid)),
 last AS (SELECT object_name, max_by(action_status, struct_pack(c := cobid, t := request_time, e := event_id)) AS last_status
          FROM a GROUP BY object_name)
SELECT k.object_name, k.cobid, l.last_status, 'QUEUED' AS new_status FROM keep k LEFT JOIN last l ON k.object_name = l.object_name"""))
def adj_publish(spark, d):
    """Queue publish actions for changed objects (deduplicated), with the last known status."""
    a = _actions(spark, d)
    cand = a.where(F.col("dataset_name") == "click").select("object_name", "cobid").distinct()
    waiting = a.where(F.col("action_status") == "QUEUED").select("object_name", "cobid").distinct()
    keep = cand.join(waiting, ["object_name", "cobid"], "left_anti")
    last = a.groupBy("object_name").agg(F.max_by("action_status", F.struct("cobid", "request_time", "event_id"))
                                        .alias("last_status"))
    return keep.join(last, "object_name", "left").select("object_name", "cobid", "last_status",
                                                         F.lit("QUEUED").alias("new_status"))


# -- ids, submit, registry -------------------------------------------------------------

RIDS = ["order_key", "line_no", "part_key", "supp_key"]


@q("fn_deterministic_row_key", S.with_views(["stage_direct"], """
SELECT order_key, line_no, part_key, supp_key,
       md5(batch_id || '-' || CAST(order_key AS VARCHAR) || '_' || CAST(line_no AS VARCHAR) || '-DIRECT') AS row_key
FROM stage_direct"""))
def fn_deterministic_row_key(spark, d):
    s = S.register(spark, d, ["stage_direct"])["stage_direct"]
    return s.select(*RIDS, row_key("batch_id", F.concat_ws("_", "order_key", "line_no")).alias("row_key"))


def _uuid5_sql(name_expr: str) -> str:
    nsh = uuid.UUID(ID_NAMESPACE).hex
    h = f"sha1(unhex('{nsh}') || encode({name_expr}))"
    return (f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
            f"lower(lpad(hex(((('0x' || substr({h}, 17, 2))::INTEGER) & 63) | 128), 2, '0')) || substr({h}, 19, 2) || '-' || "
            f"substr({h}, 21, 12)")


_NAME = "batch_id || '-' || CAST(order_key AS VARCHAR) || '-' || CAST(line_no AS VARCHAR) || '-' || CAST(part_key AS VARCHAR)"


@q("fn_uuid5", S.with_views(["stage_direct"], f"""
SELECT order_key, line_no, part_key, supp_key, {_uuid5_sql(_NAME)} AS adj_id FROM stage_direct"""))
def fn_uuid5(spark, d):
    s = S.register(spark, d, ["stage_direct"])["stage_direct"]
    name = F.concat_ws("-", "batch_id", "order_key", "line_no", "part_key")
    return s.select(*RIDS, uuid5(ID_NAMESPACE, name).alias("adj_id"))


@q("adj_submit_batch", S.with_views(["stage_direct", "entity_dim"], f"""
SELECT {_uuid5_sql(_NAME)} AS adj_id, s.cobid, s.entity_code, s.book_code,
       CAST(TRY_CAST(s.value_usd AS DECIMAL(38,6)) AS DOUBLE) AS restatement_value_in_usd,
       substr(concat_ws(' | ', nullif(trim(s.currency_code), ''), coalesce(nullif(trim(s.reason), ''), 'batch ' || s.batch_id)), 1, 1000) AS reason,
       CASE WHEN s.currency_code = 'F' THEN 'Pending Approval' ELSE 'Pending' END AS run_status
FROM stage_direct s
WHERE TRY_CAST(s.value_usd AS DECIMAL(38,6)) IS NOT NULL AND TRY_CAST(s.value_usd AS DECIMAL(38,6)) <> 0
  AND s.entity_code IS NOT NULL AND upper(trim(s.entity_code)) IN (SELECT upper(trim(entity_code)) FROM entity_dim)"""))
def adj_submit_batch(spark, d):
    """Set-based submit: every valid staged row becomes one header with a deterministic id
    (re-submitting the same batch yields the same ids)."""
    from restate.operators.validate import code_hit
    v = S.register(spark, d, ["stage_direct", "entity_dim"])
    s = code_hit(v["stage_direct"], v["entity_dim"], "entity_code", "entity_code", "ok_entity")
    val = F.expr("try_cast(value_usd AS decimal(38,6))")
    s = s.where(val.isNotNull() & (val != 0) & F.col("entity_code").isNotNull() & F.col("ok_entity"))
    name = F.concat_ws("-", "batch_id", "order_key", "line_no", "part_key")
    reason = F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.concat(F.lit("batch "), F.col("batch_id")))
    return s.select(uuid5(ID_NAMESPACE, name).alias("adj_id"), "cobid", "entity_code", "book_code",
                    val.cast("double").alias("restatement_value_in_usd"),
                    compose_reason("currency_code", reason).alias("reason"),
                    F.when(F.col("currency_code") == "F", "Pending Approval").otherwise("Pending").alias("run_status"))


@q("prj_register_dimension", S.with_views(["hdr_orders"], """
SELECT adj_key, row_number() OVER (ORDER BY created_date, adj_key) + 100000 AS dimension_adj_id FROM hdr_orders"""))
def prj_register_dimension(spark, d):
    """Registry ids = max existing id + consecutive numbers in (created, id) order,
    numbered without funnelling all requests through one task."""
    h = S.register(spark, d, ["hdr_orders"])["hdr_orders"].select("adj_key", "created_date")
    n = SH.row_numbers(h, [], ["created_date", "adj_key"], "dimension_adj_id")
    return n.select("adj_key", (F.col("dimension_adj_id") + 100000).alias("dimension_adj_id"))


@q("prj_header_from_stage", S.with_views(["stage_direct"], """
SELECT batch_id, order_key, line_no, part_key, supp_key,
       coalesce(CASE WHEN lower(trim(reason)) IN ('', 'nan', 'none') THEN NULL ELSE trim(reason) END,
                'shared reason for ' || batch_id) AS reason,
       CASE WHEN currency_code = 'F' THEN 'Pending Approval' ELSE 'Pending' END AS run_status
FROM stage_direct WHERE TRY_CAST(value_usd AS DECIMAL(38,6)) IS NOT NULL"""))
def prj_header_from_stage(spark, d):
    """Valid staged rows -> headers; a row's own reason beats the batch's shared reason."""
    from restate.functions.text import blank_to_null
    s = S.register(spark, d, ["stage_direct"])["stage_direct"]
    s = s.where(F.expr("try_cast(value_usd AS decimal(38,6))").isNotNull())
    return s.select("batch_id", *RIDS,
                    F.coalesce(blank_to_null("reason"), F.concat(F.lit("shared reason for "), F.col("batch_id"))).alias("reason"),
                    F.when(F.col("currency_code") == "F", "Pending Approval").otherwise("Pending").alias("run_status"))


# -- sign-off lifecycle, templates, scope fan-out ------------------------------------------

@q("adj_signoff_request", S.with_views(["signoff_status"], """
WITH req AS (SELECT *, sign_off_status AS previous_status FROM signoff_status WHERE sign_off_status IN ('OPEN', 'REOPENED')),
 dec AS (SELECT *, CASE WHEN cobid % 200 < 100 THEN 'approve' ELSE 'reject' END AS decision FROM req)
SELECT cobid, process_type, entity_code, sub_type, 'SIGNOFF_REQUESTED' AS requested_status,
       CASE WHEN decision = 'approve' THEN 'SIGNED_OFF' ELSE previous_status END AS final_status
FROM dec"""))
def adj_signoff_request(spark, d):
    """Request sign-off (remembering the previous status), then decide: approve -> SIGNED_OFF,
    reject -> revert to the previous status.  Only OPEN/REOPENED rows may request."""
    s = S.register(spark, d, ["signoff_status"])["signoff_status"]
    req = s.where(F.col("sign_off_status").isin("OPEN", "REOPENED")).withColumn("previous_status", F.col("sign_off_status"))
    dec = req.withColumn("decision", F.when(F.col("cobid") % 200 < 100, "approve").otherwise("reject"))
    return dec.select("cobid", "process_type", "entity_code", "sub_type", F.lit("SIGNOFF_REQUESTED").alias("requested_status"),
                      F.when(F.col("decision") == "approve", "SIGNED_OFF").otherwise(F.col("previous_status"))
                      .alias("final_status"))


@q("adj_recurring_expand", S.with_views(["hdr_inline", "lineitem"], """
WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE isodow(l_shipdate) < 6),
 t AS (SELECT adj_key, CAST(strptime(CAST(cobid AS VARCHAR), '%Y%m%d') AS DATE) AS start_d,
              CAST(strptime(CAST(cobid AS VARCHAR), '%Y%m%d') AS DATE) + INTERVAL '14' DAY AS end_d FROM hdr_inline)
SELECT t.adj_key || '-' || strftime(cal.d, '%Y%m%d') AS adj_key, CAST(strftime(cal.d, '%Y%m%d') AS INT) AS cobid
FROM t JOIN cal ON cal.d BETWEEN t.start_d AND t.end_d"""))
def adj_recurring_expand(spark, d):
    """Templates x business days in [start, end]: dates generated per template, then an
    equi semi-join with the business calendar (no range join)."""
    v = S.register(spark, d, ["hdr_inline", "lineitem"])
    cal = v["lineitem"].select(F.to_date("l_shipdate").alias("d")).where(F.weekday("d") < 5).distinct()
    start = F.to_date(F.col("cobid").cast("string"), "yyyyMMdd")
    t = v["hdr_inline"].select("adj_key", F.explode(F.sequence(start, F.date_add(start, 14))).alias("d"))
    hit = t.join(cal, "d", "left_semi")
    return hit.select(F.concat_ws("-", "adj_key", F.date_format("d", "yyyyMMdd")).alias("adj_key"),
                      F.date_format("d", "yyyyMMdd").cast("int").alias("cobid"))


@q("shp_scope_fanout", S.with_views(["hdr_queue"], """
SELECT adj_key, unnest(CASE WHEN process_type = 'BUILDING' THEN ['FRTB', 'FRTBDRC', 'FRTBRRAO'] ELSE [process_type] END) AS scope
FROM hdr_queue"""))
def shp_scope_fanout(spark, d):
    """One "all FRTB" request (stand-in: segment BUILDING) becomes three sibling requests."""
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    scopes = F.when(F.col("process_type") == "BUILDING", F.array(F.lit("FRTB"), F.lit("FRTBDRC"), F.lit("FRTBRRAO"))) \
        .otherwise(F.array("process_type"))
    return h.select("adj_key", F.explode(scopes).alias("scope"))


_FILTER_JSON_SQL = "'{' || concat_ws(',', " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":\"' || {c} || '\"' END" for c in S.FILTER_COLS) + ") || '}'"


@q("shp_filters_object", S.with_views(["hdr_inline", "hdr_orders"], f"""
SELECT adj_key, {_FILTER_JSON_SQL} AS filters_json FROM (SELECT * FROM hdr_inline UNION ALL SELECT * FROM hdr_orders)"""))
def shp_filters_object(spark, d):
    """Request filters as one JSON object with NULL filters dropped."""
    v = S.register(spark, d, ["hdr_inline", "hdr_orders"])
    h = v["hdr_inline"].unionByName(v["hdr_orders"])
    return h.select("adj_key", F.to_json(F.struct(*[F.col(c) for c in S.FILTER_COLS])).alias("filters_json"))


@q("shp_pca_split", S.with_views(["part"], """
WITH codes AS (SELECT DISTINCT p_brand || '|' || p_type || '|' || p_name AS pca FROM part),
 parts AS (SELECT pca, split_part(pca, '|', 1) AS brand, split_part(pca, '|', 2) AS ptype, split_part(pca, '|', 3) AS pname
           FROM codes),
 dim AS (SELECT DISTINCT p_brand AS brand, p_type AS ptype, p_name AS pname, p_partkey AS pca_key FROM part WHERE p_size <= 25),
 dimk AS (SELECT brand, ptype, pname, min(pca_key) AS pca_key FROM dim GROUP BY ALL),
 new AS (SELECT p.* FROM parts p WHERE NOT EXISTS (SELECT 1 FROM dimk k WHERE k.brand = p.brand AND k.ptype = p.ptype
                                                  AND k.pname = p.pname))
SELECT brand, ptype, pname, pca_key, FALSE AS is_new FROM dimk
UNION ALL
SELECT brand, ptype, pname, (SELECT max(pca_key) FROM dimk) + row_number() OVER (ORDER BY brand, ptype, pname), TRUE FROM new"""))
def shp_pca_split(spark, d):
    """Pipe-delimited attribute codes -> columns; unseen combinations get new keys after the max."""
    p = S.register(spark, d, ["part"])["part"]
    codes = p.select(F.concat_ws("|", "p_brand", "p_type", "p_name").alias("pca")).distinct()
    parts = SH.split_attributes(codes, "pca", ["brand", "ptype", "pname"]).drop("pca")
    dim = p.where(F.col("p_size") <= 25).groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype"),
                                                 F.col("p_name").alias("pname")).agg(F.min("p_partkey").alias("pca_key"))
    new = parts.join(dim, ["brand", "ptype", "pname"], "left_anti")
    mx = dim.agg(F.max("pca_key").alias("_mx"))
    numbered = RP.with_scalars(SH.row_numbers(new, [], ["brand", "ptype", "pname"], "_rn"), mx)
    added = numbered.select("brand", "ptype", "pname", (F.col("_mx") + F.col("_rn")).alias("pca_key"),
                            F.lit(True).alias("is_new"))
    return dim.select("brand", "ptype", "pname", "pca_key", F.lit(False).alias("is_new")).unionByName(added)


# -- legacy loaders ------------------------------------------------------------------------

@q("prj_legacy_base", S.with_views(["stage_direct", "book_dim", "fact"], """
WITH rates AS (SELECT DISTINCT cobid, currency_code, CAST(CASE cobid % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS DOUBLE) AS rate
               FROM fact WHERE currency_code = 'F'),
 g4 AS (SELECT DISTINCT upper(n_name) AS c FROM nation WHERE n_regionkey IN (1, 3))
SELECT s.order_key, s.line_no, s.part_key, s.supp_key,
       CASE WHEN upper(s.currency_code) = 'F' THEN coalesce(b.book_key, -1) ELSE b.book_key END AS book_key,
       TRY_CAST(s.value_usd AS DOUBLE) / coalesce(r.rate, 1) AS value_local,
       CASE WHEN g4.c IS NOT NULL THEN 'G4' ELSE 'Non-G4' END AS g4_class,
       CASE WHEN TRY_CAST(s.value_usd AS DOUBLE) IS NULL THEN 'invalid value: ' || coalesce(s.value_usd, 'NULL') END AS error_message
FROM stage_direct s LEFT JOIN book_dim b ON upper(trim(s.book_code)) = upper(trim(b.book_code))
LEFT JOIN rates r ON r.cobid = s.cobid AND r.currency_code = s.currency_code
LEFT JOIN g4 ON g4.c = upper(trim(s.entity_code))"""))
def prj_legacy_base(spark, d):
    """Older restatement base: -1 key defaults only for direct rows (stand-in: currency F), FX to
    local with missing rate = 1, G4 classification, error message."""
    from restate.operators import resolve as R
    v = S.register(spark, d, ["stage_direct", "book_dim", "fact", "nation"])
    s = R.resolve_key(v["stage_direct"], v["book_dim"], "book_code", "book_code", "book_key", "_bk", unknown=None)
    rates = v["fact"].where(F.col("currency_code") == "F").select(
        "cobid", "currency_code", F.when(F.col("cobid") % 3 == 0, 1.0).when(F.col("cobid") % 3 == 1, 2.0)
        .otherwise(4.0).alias("rate")).distinct()
    s = R.fx_to_local(s.withColumn("_v", F.expr("try_cast(value_usd AS double)")), rates, ["cobid", "currency_code"],
                      "_v", "rate", "value_local")
    s = R.flag_membership(s, v["nation"].where(F.col("n_regionkey").isin(1, 3)), "entity_code", "n_name", "_g4")
    return s.select(*RIDS, F.when(F.upper("currency_code") == "F", F.coalesce("_bk", F.lit(-1))).otherwise(F.col("_bk"))
                    .alias("book_key"), "value_local",
                    F.when(F.col("_g4"), "G4").otherwise("Non-G4").alias("g4_class"),
                    F.when(F.col("_v").isNull(), F.concat(F.lit("invalid value: "), F.coalesce("value_usd", F.lit("NULL"))))
                    .alias("error_message"))


@q("adj_upload_legacy", S.with_views(["stage_direct", "book_dim"], """
WITH r AS (SELECT s.batch_id, s.entity_code, coalesce(nullif(trim(s.book_code), ''), s.department_code || '/RESTATEMENT') AS book_code,
                  TRY_CAST(s.value_usd AS DECIMAL(38,6)) AS v FROM stage_direct s)
SELECT r.batch_id, upper(r.entity_code) AS entity, coalesce(b.book_key, -1) AS book_key, count(*) AS rows_,
       CAST(sum(r.v) AS DOUBLE) AS value_usd
FROM r LEFT JOIN book_dim b ON upper(r.book_code) = upper(b.book_code)
WHERE r.v IS NOT NULL AND r.v <> 0 GROUP BY ALL"""))
def adj_upload_legacy(spark, d):
    """Legacy upload loader: dummy-book fallback, resolve, then detail summarised per batch/entity/book."""
    from restate.operators import resolve as R
    v = S.register(spark, d, ["stage_direct", "book_dim"])
    val = F.expr("try_cast(value_usd AS decimal(38,6))")
    s = v["stage_direct"].select("batch_id", F.upper("entity_code").alias("entity"),
                                 R.dummy_code("book_code", "department_code").alias("book_code"), val.alias("v"))
    s = s.where(F.col("v").isNotNull() & (F.col("v") != 0))
    s = R.resolve_key(s, v["book_dim"], "book_code", "book_code", "book_key", "book_key")
    return s.groupBy("batch_id", "entity", "book_key").agg(F.count(F.lit(1)).alias("rows_"),
                                                         F.sum("v").cast("double").alias("value_usd"))


@q("adj_upload_frtb", S.with_views(["stage_direct", "entity_dim", "book_dim", "instrument_dim"], """
WITH e AS (SELECT s.order_key, s.line_no, s.part_key, s.supp_key, s.cobid, coalesce(en.entity_key, -1) AS entity_key,
                  coalesce(b.book_key, -1) AS book_key, CAST(TRY_CAST(s.value_usd AS DECIMAL(38,10)) AS DOUBLE) AS amount
           FROM stage_direct s LEFT JOIN entity_dim en ON upper(trim(s.entity_code)) = upper(trim(en.entity_code))
           LEFT JOIN book_dim b ON upper(trim(s.book_code)) = upper(trim(b.book_code)))
SELECT order_key, line_no, part_key, supp_key, cobid, entity_key, book_key, CAST(-1 AS BIGINT) AS trade_key, amount
FROM e WHERE amount IS NOT NULL AND amount <> 0"""))
def adj_upload_frtb(spark, d):
    """Enriched rows intersected with the delta table's columns (missing -> -1/NULL), all-zero rows skipped."""
    from restate.queries.upload_family import _enrich
    e = _enrich(spark, d, "sbm")
    e = e.where(F.col("amount").isNotNull() & (F.col("amount") != 0))
    return D.align(e, ["order_key", "line_no", "part_key", "supp_key", "cobid", "entity_key", "book_key", "trade_key",
                       "amount"], types={"trade_key": "bigint"})


@q("adj_legacy_base_incremental", S.with_views(["hdr_orders", "hdr_queue"], """
WITH old AS (SELECT username, cobid, adj_key, restatement_type FROM hdr_orders),
 new AS (SELECT username, cobid, adj_key, restatement_type FROM hdr_queue WHERE run_status = 'Processed')
SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.username = o.username AND n.cobid = o.cobid)
UNION ALL SELECT * FROM new"""))
def adj_legacy_base_incremental(spark, d):
    """Incremental model keyed by (reference, COB): new keys replace every old row of that key."""
    v = S.register(spark, d, ["hdr_orders", "hdr_queue"])
    cols = ["username", "cobid", "adj_key", "restatement_type"]
    old = v["hdr_orders"].select(*cols)
    new = v["hdr_queue"].where(F.col("run_status") == "Processed").select(*cols)
    keys = new.select(F.col("username").alias("_u"), F.col("cobid").alias("_c")).distinct()
    kept = old.join(keys, (F.col("username") == F.col("_u")) & (F.col("cobid") == F.col("_c")), "left_anti")
    return kept.unionByName(new)


@q("adj_stress_upload_legacy", S.with_views(["stage_direct", "instrument_dim"], """
WITH i AS (SELECT upper(trim(instrument_code)) AS c, max(instrument_key) AS k FROM instrument_dim GROUP BY 1)
SELECT s.order_key, s.line_no, s.part_key, s.supp_key, concat_ws('|', s.instrument_code, s.product_type) AS pca,
       coalesce(i.k, s.part_key, -1) AS instrument_key,
       CAST(TRY_CAST(s.value_usd AS DECIMAL(38,6)) AS DOUBLE) AS simulation_pl
FROM stage_direct s LEFT JOIN i ON upper(trim(s.instrument_code)) = i.c
WHERE TRY_CAST(s.value_usd AS DECIMAL(38,6)) IS NOT NULL"""))
def adj_stress_upload_legacy(spark, d):
    """Stress direct loader: attribute code per row, instrument by code else through the trade line."""
    from restate.operators import resolve as R
    v = S.register(spark, d, ["stage_direct", "instrument_dim"])
    val = F.expr("try_cast(value_usd AS decimal(38,6))")
    s = v["stage_direct"].where(val.isNotNull())
    s = R.resolve_max(s, v["instrument_dim"], "instrument_code", "instrument_code", "instrument_key", "_k", unknown=None)
    return s.select(*RIDS, F.concat_ws("|", "instrument_code", "product_type").alias("pca"),
                    F.coalesce("_k", "part_key", F.lit(-1)).alias("instrument_key"),
                    val.cast("double").alias("simulation_pl"))


@q("adj_signoff_decide", S.with_views(["signoff_status", "approvers"], """
WITH pend AS (SELECT * FROM signoff_status WHERE sign_off_status IN ('SIGNOFF_REQUESTED', 'REOPEN_REQUESTED')),
 dec AS (SELECT p.*, a.approver, CASE WHEN p.cobid % 200 < 100 THEN 'approve' ELSE 'reject' END AS decision
         FROM pend p LEFT JOIN (SELECT process_type, min(approver) AS approver FROM approvers WHERE is_active GROUP BY 1) a
           ON a.process_type = p.process_type)
SELECT cobid, process_type, entity_code, sub_type, approver,
  CASE WHEN approver IS NULL THEN sign_off_status
       WHEN decision = 'approve' AND sign_off_status = 'SIGNOFF_REQUESTED' THEN 'SIGNED_OFF'
       WHEN decision = 'approve' AND sign_off_status = 'REOPEN_REQUESTED' THEN 'REOPENED'
       WHEN sign_off_status = 'SIGNOFF_REQUESTED' THEN 'OPEN' ELSE 'SIGNED_OFF' END AS new_status
FROM dec"""))
def adj_signoff_decide(spark, d):
    """Decide pending sign-off / re-open requests: approve moves forward, reject reverts;
    only an active approver of the scope may decide (otherwise the request stays pending)."""
    v = S.register(spark, d, ["signoff_status", "approvers"])
    pend = v["signoff_status"].where(F.col("sign_off_status").isin("SIGNOFF_REQUESTED", "REOPEN_REQUESTED"))
    appr = v["approvers"].where("is_active").groupBy(F.col("process_type").alias("_pt")).agg(
        F.min("approver").alias("approver"))
    j = pend.join(appr, F.col("process_type") == F.col("_pt"), "left")
    approve = F.col("cobid") % 200 < 100
    st = F.col("sign_off_status")
    new = (F.when(F.col("approver").isNull(), st)
           .when(approve & (st == "SIGNOFF_REQUESTED"), "SIGNED_OFF")
           .when(approve & (st == "REOPEN_REQUESTED"), "REOPENED")
           .when(st == "SIGNOFF_REQUESTED", "OPEN").otherwise("SIGNED_OFF"))
    return j.select("cobid", "process_type", "entity_code", "sub_type", "approver", new.alias("new_status"))
