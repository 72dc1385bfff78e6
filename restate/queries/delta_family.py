"""Registered queries: scale/flatten/roll path and its stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from restate.functions.factor import action_of, effective_factor
from restate.functions.keys import surrogate_key
from restate.operators import delta as D
from restate.operators.match import active_filters, wildcard_match
from restate.operators.delta import positions_of
from restate.plans.scale import request_legs, scale_legs
from restate.plans.summary import SummaryView, signed
from restate.queries import standin as S
from restate.queries.common import (CUR_CTE, OUT_COLS, POS_NO_COB, Query, attach_attrs, dbl_select, current_deltas, doubles,
                                    prior_deltas, run_scale, scale_sql)
from restate.sources import io as IO
from restate.sources.manifest import Tables

QUERIES: list[Query] = []


def q(name, sql=None):
    def deco(fn):
        QUERIES.append(Query(name, fn, sql))
        return fn
    return deco


M2 = ["value_local", "value_usd"]
POS = ", ".join(POS_NO_COB)

# -- full Scale path ---------------------------------------------------------


@q("adj_scale_flatten_roll", scale_sql("hdr_inline", True, f"SELECT {dbl_select()} FROM b_out"))
def adj_scale_flatten_roll(spark, d):
    return doubles(run_scale(spark, d, "hdr_inline"), M2)


@q("adj_scale_orders_batch", scale_sql("hdr_orders", True, f"SELECT {dbl_select()} FROM b_out"))
def adj_scale_orders_batch(spark, d):
    return doubles(run_scale(spark, d, "hdr_orders"), M2)


@q("win_overlap_rank", scale_sql("hdr_orders", False, f"SELECT {dbl_select()} FROM b_out"))
def win_overlap_rank(spark, d):
    return doubles(run_scale(spark, d, "hdr_orders", with_prior=False, rank_method="window"), M2)


@q("jn_fact_x_adjust", scale_sql("hdr_inline", True, f"SELECT {dbl_select()} FROM b_out"))
def jn_fact_x_adjust(spark, d):
    # same result through the OR-residual strategy (broadcast nested/hash + residual)
    return doubles(run_scale(spark, d, "hdr_inline", strategy="residual"), M2)


@q("prj_delta", scale_sql("hdr_inline", True, f"""
SELECT cobid, restatement_id, count(*) AS leg_rows,
       CAST(sum(value_local) AS DOUBLE) AS value_local, CAST(sum(value_usd) AS DOUBLE) AS value_usd
FROM b_legs GROUP BY cobid, restatement_id"""))
def prj_delta(spark, d):
    v = S.register(spark, d, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_inline", "hdr_prior"])
    h = v["hdr_inline"]
    fmap = {c: S.FILTER_MAP[c] for c in active_filters(h, S.FILTER_COLS)}
    fact = attach_attrs(v["fact"], v, fmap.values())
    deltas = attach_attrs(prior_deltas(spark, d, v), v, fmap.values())
    legs = scale_legs(fact, h, fmap, S.POSITION_COLS, S.METRICS, deltas)
    out = legs.groupBy("cobid", "restatement_id").agg(F.count(F.lit(1)).alias("leg_rows"),
                                                     F.sum("value_local").alias("value_local"),
                                                     F.sum("value_usd").alias("value_usd"))
    return doubles(out, M2)


@q("agg_net_position", scale_sql("hdr_inline", True, f"""
SELECT cobid, {POS}, restatement_id, restatement_created_timestamp,
       CAST(value_local AS DOUBLE) AS value_local, CAST(value_usd AS DOUBLE) AS value_usd FROM b_net"""))
def agg_net_position(spark, d):
    v = S.register(spark, d, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_inline", "hdr_prior"])
    h = v["hdr_inline"]
    fmap = {c: S.FILTER_MAP[c] for c in active_filters(h, S.FILTER_COLS)}
    fact = attach_attrs(v["fact"], v, fmap.values())
    deltas = attach_attrs(prior_deltas(spark, d, v), v, fmap.values())
    legs = scale_legs(fact, h, fmap, S.POSITION_COLS, S.METRICS, deltas)
    net = D.net_positions(legs, list(S.POSITION_COLS), "restatement_id", M2, "value_usd",
                          carry_max=("restatement_created_timestamp",))
    return doubles(net, M2)


@q("prj_effective_factor", S.with_views(["hdr_inline", "hdr_orders"], """
SELECT adj_key, restatement_type, CAST(CASE WHEN lower(restatement_type) = 'flatten' THEN -1
   WHEN lower(restatement_type) IN ('scale', 'roll') THEN
        CASE WHEN coalesce(source_cobid, cobid) <> cobid THEN scale_factor ELSE scale_factor - 1 END
   ELSE 0 END AS DOUBLE) AS effective_factor,
   CASE lower(restatement_type) WHEN 'flatten' THEN 'Scale' WHEN 'scale' THEN 'Scale' WHEN 'roll' THEN 'Scale'
        WHEN 'erol' THEN 'EntityRoll' WHEN 'entity_roll' THEN 'EntityRoll' WHEN 'upload' THEN 'Upload'
        WHEN 'direct' THEN 'Direct' END AS restatement_action
FROM (SELECT * FROM hdr_inline UNION ALL SELECT * FROM hdr_orders) h"""))
def prj_effective_factor(spark, d):
    v = S.register(spark, d, ["hdr_inline", "hdr_orders"])
    h = v["hdr_inline"].unionByName(v["hdr_orders"])
    return h.select("adj_key", "restatement_type",
                    effective_factor("restatement_type", "scale_factor", "cobid",
                                     F.coalesce("source_cobid", "cobid")).cast("double").alias("effective_factor"),
                    action_of("restatement_type").alias("restatement_action"))


# -- supersede / combined / summary / counts ----------------------------------

@q("jn_supersede_anti", scale_sql("hdr_inline", True, f"""
SELECT {dbl_select('p')} FROM p_out p
WHERE NOT EXISTS (SELECT 1 FROM b_out b WHERE b.cobid IS NOT DISTINCT FROM p.cobid
  AND {' AND '.join(f'b.{c} IS NOT DISTINCT FROM p.{c}' for c in POS_NO_COB)})"""))
def jn_supersede_anti(spark, d):
    new = run_scale(spark, d, "hdr_inline")
    existing = prior_deltas(spark, d)
    return doubles(D.supersede(existing, new, list(S.POSITION_COLS)), M2)


@q("src_combined_scan", scale_sql("hdr_inline", True, f"""
SELECT cobid, {POS}, CAST(sum(value_local) AS DOUBLE) AS value_local, CAST(sum(value_usd) AS DOUBLE) AS value_usd,
       max(is_delta) AS is_adjusted
FROM (SELECT cobid, {POS}, value_local, value_usd, FALSE AS is_delta FROM fact
      UNION ALL SELECT cobid, {POS}, value_local, value_usd, TRUE AS is_delta FROM p_out) u
GROUP BY cobid, {POS}"""))
def src_combined_scan(spark, d):
    v = S.register(spark, d, ["fact"])
    stored = IO.write_image(prior_deltas(spark, d), "deltas")
    c = D.combined(v["fact"], stored, list(S.POSITION_COLS), M2, flag_col="is_adjusted", once=True, slice_col="cobid")
    return doubles(c, M2)


@q("agg_adjusted_fact", scale_sql("hdr_inline", True, f"""
, allds AS (SELECT {', '.join(['cobid', *POS_NO_COB, 'value_local', 'value_usd'])} FROM p_out p
   WHERE NOT EXISTS (SELECT 1 FROM b_out b WHERE {' AND '.join(f'b.{c} IS NOT DISTINCT FROM p.{c}' for c in S.POSITION_COLS)})
   UNION ALL SELECT {', '.join(['cobid', *POS_NO_COB, 'value_local', 'value_usd'])} FROM b_out)
SELECT f.cobid, b.entity_code, CAST(sum(f.value_usd) AS DOUBLE) AS original_usd,
       CAST(coalesce(sum(f.delta_usd), 0) AS DOUBLE) AS delta_usd,
       CAST(sum(f.value_usd) + coalesce(sum(f.delta_usd), 0) AS DOUBLE) AS adjusted_usd,
       max(f.is_adj) AS is_adjusted
FROM (SELECT cobid, book_key, value_usd, CAST(NULL AS DECIMAL(28,8)) AS delta_usd, FALSE AS is_adj FROM fact
      UNION ALL SELECT cobid, book_key, CAST(0 AS DECIMAL(18,2)), value_usd, TRUE FROM allds) f
LEFT JOIN book_dim b ON coalesce(f.book_key, -1) = b.book_key
GROUP BY f.cobid, b.entity_code"""))
def agg_adjusted_fact(spark, d):
    v = S.register(spark, d, ["fact", "book_dim"])
    new = run_scale(spark, d, "hdr_inline")
    deltas = D.supersede(prior_deltas(spark, d), new, list(S.POSITION_COLS)).unionByName(new)
    f = v["fact"].select("cobid", "book_key", F.col("value_usd"), F.lit(None).cast("decimal(28,8)").alias("delta_usd"),
                         F.lit(False).alias("is_adj"))
    dl = deltas.select("cobid", "book_key", F.lit(0).cast("decimal(18,2)").alias("value_usd"),
                       F.col("value_usd").alias("delta_usd"), F.lit(True).alias("is_adj"))
    u = attach_attrs(f.unionByName(dl), v, ["entity_code"])
    out = u.groupBy("cobid", "entity_code").agg(
        F.sum("value_usd").alias("original_usd"),
        F.coalesce(F.sum("delta_usd"), F.lit(0)).alias("delta_usd"),
        (F.sum("value_usd") + F.coalesce(F.sum("delta_usd"), F.lit(0))).alias("adjusted_usd"),
        F.max("is_adj").alias("is_adjusted"))
    return doubles(out, ["original_usd", "delta_usd", "adjusted_usd"])


@q("agg_summary_rebuild", scale_sql("hdr_inline", True, CUR_CTE + """
SELECT cobid, restatement_id, source_system_code, currency_code,
       CAST(sum(value_local) AS DOUBLE) AS value_local, CAST(sum(value_usd) AS DOUBLE) AS value_usd
FROM cur WHERE cobid IN (SELECT cobid FROM b_out) GROUP BY ALL"""))
def agg_summary_rebuild(spark, d):
    """The summary of the delta table, kept by signed changes: the stored rows, then what the batch brought and
    superseded.  The business dates that the batch touched are shown."""
    k = ("cobid", "restatement_id", "source_system_code", "currency_code")
    new, prior = run_scale(spark, d, "hdr_inline"), prior_deltas(spark, d)
    position, same = positions_of(new, S.POSITION_COLS)
    left = prior.join(position, same, "left_semi")
    view = SummaryView(Tables(spark, IO.scratch_path(spark, "summary")), "summary", k, tuple(M2))
    view.apply("stored", signed(prior.select(*k, *M2), 1))
    view.apply("batch", signed(new.select(*k, *M2), 1).unionByName(signed(left.select(*k, *M2), -1)))
    return doubles(view.read().join(new.select("cobid").distinct(), "cobid", "left_semi"), M2)


@q("agg_summary_official", scale_sql("hdr_inline", True, """
SELECT cobid, source_system_code, CAST(sum(value_usd) AS DOUBLE) AS value_usd
FROM b_out WHERE currency_code = 'F' GROUP BY ALL HAVING sum(value_usd) <> 0"""))
def agg_summary_official(spark, d):
    deltas = run_scale(spark, d, "hdr_inline").where(F.col("currency_code") == "F")
    return doubles(D.summarise(deltas, ["cobid", "source_system_code"], ["value_usd"], nonzero_col="value_usd"),
                   ["value_usd"])


@q("agg_record_counts", scale_sql("hdr_inline", True, """
SELECT h.adj_key, h.restatement_id, CAST(coalesce(c.n, 0) AS BIGINT) AS record_count
FROM hdr_inline h LEFT JOIN (SELECT restatement_id, count(*) AS n FROM b_out GROUP BY restatement_id) c
  ON h.restatement_id = c.restatement_id"""))
def agg_record_counts(spark, d):
    v = S.register(spark, d, ["hdr_inline"])
    counted = D.record_counts(v["hdr_inline"].select("adj_key", "restatement_id"), run_scale(spark, d, "hdr_inline"),
                              "restatement_id")
    return counted


@q("flt_zero_match_warning", scale_sql("hdr_inline", True, """
SELECT h.adj_key, h.restatement_type, CAST(coalesce(c.n, 0) AS BIGINT) AS record_count
FROM hdr_inline h LEFT JOIN (SELECT restatement_id, count(*) AS n FROM b_out GROUP BY restatement_id) c
  ON h.restatement_id = c.restatement_id
WHERE coalesce(c.n, 0) = 0
  AND NOT (lower(h.restatement_type) = 'scale' AND h.scale_factor = 1
           AND (h.source_cobid IS NULL OR h.source_cobid = h.cobid))"""))
def flt_zero_match_warning(spark, d):
    v = S.register(spark, d, ["hdr_inline"])
    h = v["hdr_inline"]
    counted = D.record_counts(h, run_scale(spark, d, "hdr_inline"), "restatement_id")
    return D.zero_match_warning(counted).select("adj_key", "restatement_type", "record_count")


@q("jn_before_after", scale_sql("hdr_inline", True, """
, o AS (SELECT cobid, book_key, source_system_code, sum(value_usd) AS original_usd FROM fact GROUP BY ALL),
  dd AS (SELECT cobid, book_key, source_system_code, sum(value_usd) AS delta_usd FROM b_out GROUP BY ALL)
SELECT dd.cobid, dd.book_key, dd.source_system_code, CAST(o.original_usd AS DOUBLE) AS original_usd,
       CAST(dd.delta_usd AS DOUBLE) AS delta_usd,
       CAST(coalesce(o.original_usd, 0) + dd.delta_usd AS DOUBLE) AS adjusted_usd
FROM dd LEFT JOIN o ON o.cobid = dd.cobid AND o.book_key = dd.book_key
  AND o.source_system_code = dd.source_system_code"""))
def jn_before_after(spark, d):
    v = S.register(spark, d, ["fact"])
    k = ["cobid", "book_key", "source_system_code"]
    dd = run_scale(spark, d, "hdr_inline").groupBy(*k).agg(F.sum("value_usd").alias("delta_usd"))
    o = v["fact"].join(dd.select(*k), k, "left_semi").groupBy(*k).agg(F.sum("value_usd").alias("original_usd"))
    out = dd.join(o, k, "left").select(*k, "original_usd", "delta_usd",
                                        (F.coalesce("original_usd", F.lit(0)) + F.col("delta_usd")).alias("adjusted_usd"))
    return doubles(out, ["original_usd", "delta_usd", "adjusted_usd"])


@q("fn_surrogate_key", S.with_views(["fact"], """
SELECT cobid, trade_key, line_no,
       md5(concat_ws('-', coalesce(CAST(cobid AS VARCHAR), '_dbt_utils_surrogate_key_null_'),
                          coalesce(CAST(trade_key AS VARCHAR), '_dbt_utils_surrogate_key_null_'),
                          coalesce(CAST(nullif(line_no, 3) AS VARCHAR), '_dbt_utils_surrogate_key_null_'),
                          coalesce(source_system_code, '_dbt_utils_surrogate_key_null_'))) AS position_key
FROM fact"""))
def fn_surrogate_key(spark, d):
    f = S.register(spark, d, ["fact"])["fact"]
    return f.select("cobid", "trade_key", "line_no",
                    surrogate_key("cobid", "trade_key", F.nullif(F.col("line_no"), F.lit(3)),
                                  "source_system_code").alias("position_key"))


@q("flt_skip_unused", S.with_views(["hdr_inline", "hdr_orders"], """
SELECT 'hdr_inline' AS batch, """ + " , ".join(
    f"max(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END) AS uses_{c}" for c in S.FILTER_COLS) + """ FROM hdr_inline
UNION ALL SELECT 'hdr_orders', """ + " , ".join(
    f"max(CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c in S.FILTER_COLS) + " FROM hdr_orders"))
def flt_skip_unused(spark, d):
    v = S.register(spark, d, ["hdr_inline", "hdr_orders"])
    rows = []
    for name in ("hdr_inline", "hdr_orders"):
        h = v[name]
        rows.append(h.agg(F.lit(name).alias("batch"),
                          *[F.max(F.col(c).isNotNull().cast("int")).alias(f"uses_{c}") for c in S.FILTER_COLS]))
    return rows[0].unionByName(rows[1])


@q("flt_wildcard_match", S.with_views(["fact_attr", "hdr_inline"], """
SELECT h.adj_key, f.cobid, count(*) AS matched_rows, CAST(sum(f.value_usd) AS DOUBLE) AS matched_usd
FROM fact_attr f JOIN hdr_inline h ON f.cobid = h.cobid AND """ + " AND ".join(
    f"(h.{c} IS NULL OR upper(trim(h.{c})) = upper(trim(CAST(f.{a} AS VARCHAR))))" for c, a in S.FILTER_MAP.items())
    + " GROUP BY h.adj_key, f.cobid"))
def flt_wildcard_match(spark, d):
    v = S.register(spark, d, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_inline"])
    h = v["hdr_inline"]
    act = active_filters(h, S.FILTER_COLS)
    fact = attach_attrs(v["fact"], v, [S.FILTER_MAP[c] for c in act])
    hh = h.select(F.col("adj_key"), F.col("cobid").alias("h_cob"), *[F.col(c).alias(f"h_{c}") for c in act])
    m = wildcard_match(fact, hh, {f"h_{c}": S.FILTER_MAP[c] for c in act}, header_cob="h_cob")
    return doubles(m.groupBy("adj_key", "cobid").agg(F.count(F.lit(1)).alias("matched_rows"),
                                                     F.sum("value_usd").alias("matched_usd")), ["matched_usd"])


@q("prj_column_align", scale_sql("hdr_inline", True, """
SELECT cobid, restatement_id, trade_key, CAST(-1 AS BIGINT) AS counterparty_key, CAST(-1 AS BIGINT) AS run_log_id,
       CAST(NULL AS VARCHAR) AS strategy, CAST(value_usd AS DOUBLE) AS value_usd FROM b_out"""))
def prj_column_align(spark, d):
    out = run_scale(spark, d, "hdr_inline")
    a = D.align(out, ["cobid", "restatement_id", "trade_key", "counterparty_key", "run_log_id", "strategy", "value_usd"],
                types={"counterparty_key": "bigint", "run_log_id": "bigint", "strategy": "string", "value_usd": "double"})
    return a


@q("set_union_legs", scale_sql("hdr_inline", True, """
SELECT h.adj_key, l.cobid, l.leg, count(*) AS rows_
FROM b_legs l JOIN b_h h ON l.restatement_id = h.restatement_id GROUP BY ALL"""))
def set_union_legs(spark, d):
    v = S.register(spark, d, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_inline", "hdr_prior"])
    h = v["hdr_inline"]
    fmap = {c: S.FILTER_MAP[c] for c in active_filters(h, S.FILTER_COLS)}
    fact = attach_attrs(v["fact"], v, fmap.values())
    deltas = attach_attrs(prior_deltas(spark, d, v), v, fmap.values())
    legs = scale_legs(fact, h, fmap, S.POSITION_COLS, S.METRICS, deltas, keep_leg=True)
    j = legs.join(h.select("adj_key", "restatement_id"), "restatement_id")
    return j.groupBy("adj_key", "cobid", "leg").agg(F.count(F.lit(1)).alias("rows_"))
