"""Registered queries: scope config, metric collapse, request action, small
filters and predicates, report-refresh evidence matching, payload-header join,
NULL-safe equality."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from restate.functions.factor import action_of
from restate.functions.text import ci_eq, nearly_equal
from restate.operators import delta as D
from restate.operators.match import value_list_filter
from restate.queries import standin as S
from restate.queries.common import Query
from restate.sources import io as IO

QUERIES: list[Query] = []


def q(name, sql=None):
    def deco(fn):
        QUERIES.append(Query(name, fn, sql))
        return fn
    return deco


CONF = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "conf", "scopes.json")


def _scope_fact(spark, d, name):
    cfg = IO.load_scope(CONF, name)
    fact = IO.read_fact(spark, cfg.fact_path.format(sf_dir=d), metric=cfg.spec.metric_usd)
    spec = cfg.spec.resolve_metrics(fact.columns)
    return cfg, spec, fact


@q("src_scope_config", S.with_views(["lineitem"], """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_extendedprice IS NOT NULL"""))
def src_scope_config(spark, d):
    """Scope settings loaded from JSON (case-insensitive name) drive the read and projection."""
    cfg, spec, fact = _scope_fact(spark, d, "lineitem")
    return fact.select(*spec.position_cols, *spec.metrics)


@q("prj_metric_collapse", S.with_views(["lineitem", "orders"], """
SELECT 'LineItem' AS scope, l_returnflag AS grp, CAST(sum(l_extendedprice) AS DOUBLE) AS metric_total, 1 AS n_metrics
FROM lineitem GROUP BY l_returnflag
UNION ALL
SELECT 'Orders', o_orderstatus, CAST(sum(o_totalprice) AS DOUBLE), 1 FROM orders GROUP BY o_orderstatus"""))
def prj_metric_collapse(spark, d):
    """A scope whose fact lacks the local metric (or whose local = USD) uses the USD metric only."""
    out = []
    for name in ("lineitem", "orders"):
        cfg, spec, fact = _scope_fact(spark, d, name)
        g = fact.groupBy(F.col(spec.summary_cols[0]).alias("grp")).agg(
            F.sum(spec.metric_usd).cast("double").alias("metric_total"))
        out.append(g.select(F.lit(spec.name).alias("scope"), "grp", "metric_total",
                            F.lit(len(spec.metrics)).alias("n_metrics")))
    return out[0].unionByName(out[1])


@q("prj_request_action", S.with_views(["hdr_queue"], """
SELECT adj_key, CASE lower(trim(restatement_type)) WHEN 'flatten' THEN 'Scale' WHEN 'scale' THEN 'Scale' WHEN 'roll' THEN 'Scale'
  WHEN 'erol' THEN 'EntityRoll' WHEN 'entity_roll' THEN 'EntityRoll' WHEN 'upload' THEN 'Upload' WHEN 'direct' THEN 'Direct'
  END AS restatement_action FROM hdr_queue"""))
def prj_request_action(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    return h.select("adj_key", action_of("restatement_type").alias("restatement_action"))


@q("flt_value_list", S.with_views(["fact"], """
SELECT cobid, count(*) AS n FROM fact WHERE source_system_code IN ('A', 'R') AND currency_code IN ('F') GROUP BY cobid"""))
def flt_value_list(spark, d):
    f = S.register(spark, d, ["fact"])["fact"]
    out = value_list_filter(f, {"source_system_code": ["A", "R"], "currency_code": "F", "book_key": " ", "line_no": []})
    return out.groupBy("cobid").agg(F.count(F.lit(1)).alias("n"))


@q("flt_nonzero", S.with_views(["stage_direct"], """
SELECT order_key, line_no, part_key, supp_key, TRY_CAST(value_usd AS DOUBLE) AS v FROM stage_direct
WHERE TRY_CAST(value_usd AS DOUBLE) <> 0"""))
def flt_nonzero(spark, d):
    s = S.register(spark, d, ["stage_direct"])["stage_direct"].select(
        "order_key", "line_no", "part_key", "supp_key", F.expr("try_cast(value_usd AS double)").alias("v"))
    return D.nonzero(s, "v")


@q("flt_zero_net", S.with_views(["fact"], """
SELECT book_key, count(*) AS positions FROM (
  SELECT book_key, trade_key, sum(CASE WHEN source_system_code = 'R' THEN -value_usd ELSE value_usd END) AS net
  FROM fact WHERE source_system_code IN ('R', 'N') GROUP BY book_key, trade_key HAVING net <> 0) x GROUP BY book_key"""))
def flt_zero_net(spark, d):
    """Groups whose net is exactly zero are dropped after aggregation (HAVING net <> 0)."""
    f = S.register(spark, d, ["fact"])["fact"].where(F.col("source_system_code").isin("R", "N"))
    legs = f.select("book_key", "trade_key", F.when(F.col("source_system_code") == "R", -F.col("value_usd"))
                    .otherwise(F.col("value_usd")).alias("net"))
    netted = D.net_positions(legs, ["book_key"], "trade_key", ["net"], "net")
    return netted.groupBy("book_key").agg(F.count(F.lit(1)).alias("positions"))


@q("flt_case_insensitive_eq", S.with_views(["stage_direct", "entity_dim"], """
SELECT e.entity_code, count(*) AS n FROM stage_direct s JOIN entity_dim e ON upper(s.entity_code) = upper(e.entity_code)
GROUP BY e.entity_code"""))
def flt_case_insensitive_eq(spark, d):
    v = S.register(spark, d, ["stage_direct", "entity_dim"])
    e = v["entity_dim"].select(F.col("entity_code").alias("_ec"))
    j = v["stage_direct"].join(e, ci_eq("entity_code", "_ec"))
    return j.groupBy(F.col("_ec").alias("entity_code")).agg(F.count(F.lit(1)).alias("n"))


@q("flt_nearly_equal", S.with_views(["lineitem", "part"], """
SELECT l.l_returnflag, count_if(abs(l.l_extendedprice - l.l_quantity * p.p_retailprice) < 0.01) AS reconciled,
       count(*) AS n FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_returnflag"""))
def flt_nearly_equal(spark, d):
    v = S.register(spark, d, ["lineitem", "part"])
    j = v["lineitem"].join(v["part"], F.col("l_partkey") == F.col("p_partkey"))
    ok = nearly_equal(F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"))
    return j.groupBy("l_returnflag").agg(F.count_if(ok).alias("reconciled"), F.count(F.lit(1)).alias("n"))


_TRIG = """
SELECT process_type, cobid, max(process_date) + INTERVAL '5' MINUTE AS triggered_at FROM hdr_queue
WHERE run_status = 'Processed' GROUP BY process_type, cobid
UNION ALL
SELECT process_type, cobid, min(created_date) AS triggered_at FROM hdr_queue GROUP BY process_type, cobid"""

_REFRESH_SQL = S.with_views(["hdr_queue"], f"""
WITH t AS ({_TRIG}),
 m AS (SELECT h.adj_key, t.triggered_at,
              CASE WHEN t.triggered_at >= h.process_date THEN 1 WHEN t.triggered_at >= h.start_date THEN 2 ELSE 3 END AS evidence
       FROM hdr_queue h JOIN t ON h.process_type = t.process_type AND h.cobid = t.cobid
        AND (t.triggered_at >= h.process_date OR t.triggered_at >= h.start_date OR t.triggered_at >= h.created_date)
       WHERE h.run_status = 'Processed'),
 r AS (SELECT *, row_number() OVER (PARTITION BY adj_key ORDER BY evidence, triggered_at DESC) AS rn FROM m)
""")


def _refresh_matches(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"]
    t = spark.sql(_TRIG.replace("INTERVAL '5' MINUTE", "INTERVAL 5 MINUTES"))
    hp = h.where(F.col("run_status") == "Processed").select("adj_key", "process_type", "cobid", "process_date",
                                                          "start_date", "created_date")
    tt = t.select(F.col("process_type").alias("_tp"), F.col("cobid").alias("_tc"), "triggered_at")
    cond = (F.col("process_type") == F.col("_tp")) & (F.col("cobid") == F.col("_tc")) & (
        (F.col("triggered_at") >= F.col("process_date")) | (F.col("triggered_at") >= F.col("start_date"))
        | (F.col("triggered_at") >= F.col("created_date")))
    m = hp.join(tt, cond)  # equi on (scope, COB) + residual OR of three time conditions
    ev = (F.when(F.col("triggered_at") >= F.col("process_date"), 1)
          .when(F.col("triggered_at") >= F.col("start_date"), 2).otherwise(3))
    return m.select("adj_key", "triggered_at", ev.alias("evidence"))


@q("jn_report_refresh", _REFRESH_SQL + """
SELECT h.adj_key, r.triggered_at, CASE r.evidence WHEN 1 THEN 'Rebuild Triggered' WHEN 2 THEN 'Refreshing' WHEN 3 THEN 'Queued'
       ELSE 'Awaiting' END AS report_status
FROM hdr_queue h LEFT JOIN (SELECT * FROM r WHERE rn = 1) r ON h.adj_key = r.adj_key WHERE h.run_status = 'Processed'""")
def jn_report_refresh(spark, d):
    h = S.register(spark, d, ["hdr_queue"])["hdr_queue"].where(F.col("run_status") == "Processed").select("adj_key")
    m = _refresh_matches(spark, d)
    w = Window.partitionBy("adj_key").orderBy(F.col("evidence"), F.col("triggered_at").desc())
    best = m.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    j = h.join(best, "adj_key", "left")
    st = (F.when(F.col("evidence") == 1, "Rebuild Triggered").when(F.col("evidence") == 2, "Refreshing")
          .when(F.col("evidence") == 3, "Queued").otherwise("Awaiting"))
    return j.select("adj_key", "triggered_at", st.alias("report_status"))


@q("win_action_match", _REFRESH_SQL + "SELECT adj_key, evidence, triggered_at FROM r WHERE rn = 1")
def win_action_match(spark, d):
    m = _refresh_matches(spark, d)
    w = Window.partitionBy("adj_key").orderBy(F.col("evidence"), F.col("triggered_at").desc())
    return m.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("adj_key", "evidence", "triggered_at")


@q("win_trigger_match", _REFRESH_SQL + """
SELECT adj_key, triggered_at FROM (SELECT adj_key, triggered_at,
  row_number() OVER (PARTITION BY adj_key ORDER BY triggered_at DESC) AS k FROM m) WHERE k = 1""")
def win_trigger_match(spark, d):
    m = _refresh_matches(spark, d)
    w = Window.partitionBy("adj_key").orderBy(F.col("triggered_at").desc())
    return m.withColumn("k", F.row_number().over(w)).where("k = 1").select("adj_key", "triggered_at")


@q("jn_payload_header", S.with_views(["stage_direct"], """
WITH hdr AS (SELECT batch_id, count(*) AS n FROM stage_direct WHERE TRY_CAST(value_usd AS DOUBLE) IS NOT NULL GROUP BY batch_id)
SELECT s.batch_id, s.order_key, s.line_no, s.part_key, s.supp_key, h.n AS header_rows
FROM stage_direct s JOIN hdr h ON s.batch_id = h.batch_id WHERE upper(s.currency_code) = 'O'"""))
def jn_payload_header(spark, d):
    """Line items joined to their live upload header (inner join on the batch id)."""
    s = S.register(spark, d, ["stage_direct"])["stage_direct"]
    hdr = s.where(F.expr("try_cast(value_usd AS double)").isNotNull()).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("header_rows"))
    items = s.where(F.upper("currency_code") == "O").select("batch_id", "order_key", "line_no", "part_key", "supp_key")
    return items.join(hdr, "batch_id")


@q("jn_equi_null_sentinel", S.with_views(["stage_direct"], """
WITH b AS (SELECT DISTINCT book_code, department_code FROM stage_direct WHERE entity_code LIKE 'nation%')
SELECT b.department_code, count(*) AS n FROM stage_direct s JOIN b ON s.book_code IS NOT DISTINCT FROM b.book_code
 AND s.department_code IS NOT DISTINCT FROM b.department_code GROUP BY b.department_code"""))
def jn_equi_null_sentinel(spark, d):
    """NULL-safe equality as a hash-joinable key (``<=>``), no sentinel values needed."""
    s = S.register(spark, d, ["stage_direct"])["stage_direct"]
    b = s.where(F.col("entity_code").like("nation%")).select(F.col("book_code").alias("_b"),
                                                             F.col("department_code").alias("_d")).distinct()
    j = s.join(b, F.col("book_code").eqNullSafe(F.col("_b")) & F.col("department_code").eqNullSafe(F.col("_d")))
    return j.groupBy(F.col("_d").alias("department_code")).agg(F.count(F.lit(1)).alias("n"))
