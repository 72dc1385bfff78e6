"""Registered queries: operators whose first query shows one slice, over every request, slice or batch."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restate.functions.factor import FACTOR_TYPE, VALUE_TYPE
from restate.operators import delta as D
from restate.operators.match import active_filters
from restate.operators.shape import to_payload
from restate.plans.preview import matched
from restate.plans.process import DELTAS, process
from restate.plans.scale import legacy_rolls, legacy_steps
from restate.plans.scope_plan import load_plan
from restate.queries import standin as S
from restate.queries.common import (CUR_CTE, OUT_COLS, POS_NO_COB, SCOPE, Query, attach_attrs, current_deltas, doubles, run_scale,
                                    scale_ctes, scale_sql, _attrs, _wild)
from restate.queries.lifecycle_family import _roll, entity_slices, roll_ctes
from restate.session import cut_lineage
from restate.sources import io as IO
from restate.sources.manifest import Tables
from restate.spec import VAR_COMPONENTS

QUERIES: list[Query] = []


def q(name, sql=None):
    def deco(fn):
        QUERIES.append(Query(name, fn, sql))
        return fn
    return deco


M2 = ["value_local", "value_usd"]
POS = ", ".join(POS_NO_COB)
JOIN_KEYS = ["book_key", "instrument_key", "source_system_code", "currency_code"]
ITEM = ["trade_key", "line_no", "book_key", "instrument_key", "source_system_code"]


# --- line items of every request -------------------------------------------
_ITEMS_CTES = "WITH " + _attrs("fact", "fa") + f"""
, t AS (SELECT h.adj_key, h.restatement_type, CAST(h.scale_factor AS DECIMAL(12,4)) AS fac,
               coalesce(h.source_cobid, h.cobid) <> h.cobid AND lower(h.restatement_type) <> 'flatten' AS moved, x.*
        FROM fa x JOIN hdr_items h ON x.cobid = h.cobid AND {_wild('h', 'x')})
, s AS (SELECT h.adj_key, {', '.join('x.' + c for c in JOIN_KEYS)}, x.value_usd
        FROM fa x JOIN hdr_items h ON x.cobid = h.source_cobid AND h.source_cobid <> h.cobid
         AND lower(h.restatement_type) <> 'flatten' AND {_wild('h', 'x')})
, items AS (
 SELECT adj_key, restatement_type, {', '.join(ITEM)}, value_usd AS original_usd, value_usd AS source_usd,
        CASE WHEN lower(restatement_type) = 'flatten' THEN 0 ELSE CAST(value_usd AS DECIMAL(28,8)) * fac END AS projected_usd
 FROM t WHERE NOT moved
 UNION ALL
 SELECT t.adj_key, t.restatement_type, {', '.join('t.' + c for c in ITEM)}, t.value_usd, s.value_usd,
        CAST(s.value_usd AS DECIMAL(28,8)) * t.fac
 FROM t LEFT JOIN s ON t.adj_key = s.adj_key AND {' AND '.join(f't.{c} = s.{c}' for c in JOIN_KEYS)}
 WHERE t.moved)
"""


def _matched(v, requests: DataFrame, match_on: str) -> DataFrame:
    fmap = {c: S.FILTER_MAP[c] for c in active_filters(requests, S.FILTER_COLS)}
    return matched(attach_attrs(v["fact"], v, fmap.values()), requests, fmap, match_on=match_on)


def line_items(spark, d) -> DataFrame:
    """A row per request and target row (per source row met, for a request from another COB): original, source, projected.

    A Flatten projects 0, a request of its own COB the row times its factor, one from
    another COB the source rows of equal keys times its factor, NULL without one."""
    v = S.register(spark, d, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_items"])
    # one row a request, made from the orders: read a dozen times below, so made once
    h = cut_lineage(v["hdr_items"])
    flat = F.lower("restatement_type") == "flatten"
    moves = (F.coalesce("source_cobid", "cobid") != F.col("cobid")) & ~flat
    val, f = F.col("value_usd").cast(VALUE_TYPE), F.col("_p_f").cast(FACTOR_TYPE)
    # the fact is joined with the dimensions only that some request of the part filters on
    stay, move = h.where(~moves), h.where(moves)
    here = _matched(v, stay, "target")
    own = F.when(F.lower("_p_type") == "flatten", F.lit(0)).otherwise(val * f)
    here = here.select("_p_key", "_p_type", *ITEM, F.col("value_usd").alias("original_usd"), F.col("value_usd").alias("source_usd"), own.alias("projected_usd"))
    target = _matched(v, move, "target")
    source = _matched(v, move, "source").select(
        F.col("_p_key").alias("_s_key"), *[F.col(k).alias(f"_s_{k}") for k in JOIN_KEYS], F.col("value_usd").alias("source_usd"))
    cond = F.col("_p_key") == F.col("_s_key")
    for k in JOIN_KEYS:
        cond = cond & (F.col(k) == F.col(f"_s_{k}"))  # plain equality: NULL keys do not match
    far = target.join(source, cond, "left").select("_p_key", "_p_type", *ITEM, F.col("value_usd").alias("original_usd"), "source_usd",
                                                   (F.col("source_usd").cast(VALUE_TYPE) * f).alias("projected_usd"))
    out = here.unionByName(far).withColumn("delta_usd", F.col("projected_usd") - F.col("original_usd"))
    return doubles(out.withColumnsRenamed({"_p_key": "adj_key", "_p_type": "restatement_type"}),
                   ["original_usd", "source_usd", "projected_usd", "delta_usd"])


_ITEMS_VIEWS = ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_items"]
_ITEM_COLS = f"""adj_key, restatement_type, {', '.join(ITEM)}, CAST(original_usd AS DOUBLE) AS original_usd,
 CAST(projected_usd AS DOUBLE) AS projected_usd, CAST(projected_usd - original_usd AS DOUBLE) AS delta_usd"""


@q("prj_delta_pointwise_all", S.with_views(_ITEMS_VIEWS, _ITEMS_CTES + f"SELECT {_ITEM_COLS} FROM items"))
def prj_delta_pointwise_all(spark, d):
    """Flatten, Scale and Roll columns of every request, whatever its filters and COBs."""
    return line_items(spark, d).drop("source_usd")


@q("adj_create_items_all", S.with_views(_ITEMS_VIEWS, _ITEMS_CTES + f"SELECT {_ITEM_COLS}, CAST(source_usd AS DOUBLE) AS source_usd FROM items"))
def adj_create_items_all(spark, d):
    """Line items of every request: original, source, projected and delta snapshots."""
    return line_items(spark, d)


# --- rolls of every COB and entity ------------------------------------------
@q("jn_roll_left_all", S.with_views(["fact", "book_dim", "rolls_orders"], f"""
WITH fa AS (SELECT f.*, b.entity_code FROM fact f LEFT JOIN book_dim b ON f.book_key = b.book_key),
 t AS (SELECT r.adj_key, r.scale_factor, fa.* FROM fa JOIN rolls_orders r ON fa.cobid = r.cobid AND upper(fa.entity_code) = r.entity_code),
 s AS (SELECT r.adj_key, fa.* FROM fa JOIN rolls_orders r ON fa.cobid = r.source_cobid AND upper(fa.entity_code) = r.entity_code)
SELECT t.adj_key, {', '.join('t.' + c for c in ITEM)}, CAST(t.value_usd AS DOUBLE) AS original_usd,
       CAST(s.value_usd AS DOUBLE) AS source_usd,
       CAST(CAST(s.value_usd AS DECIMAL(28,8)) * CAST(t.scale_factor AS DECIMAL(12,4)) - t.value_usd AS DOUBLE) AS delta_usd
FROM t LEFT JOIN s ON t.adj_key = s.adj_key AND {' AND '.join(f't.{c} = s.{c}' for c in JOIN_KEYS)}"""))
def jn_roll_left_all(spark, d):
    """Target rows of every roll slice beside the source rows of equal keys."""
    v = S.register(spark, d, ["fact", "book_dim", "rolls_orders"])
    fa = attach_attrs(v["fact"], v, ["entity_code"]).withColumn("_ent", F.upper("entity_code")).drop("entity_code")
    r = v["rolls_orders"].select("adj_key", F.col("cobid").alias("_target"), F.col("source_cobid").alias("_source"),
                                 F.col("entity_code").alias("_r_ent"), F.col("scale_factor").cast(FACTOR_TYPE).alias("_f"))
    t = fa.join(r, (F.col("cobid") == F.col("_target")) & (F.col("_ent") == F.col("_r_ent")))
    s = fa.join(r, (F.col("cobid") == F.col("_source")) & (F.col("_ent") == F.col("_r_ent"))).select(
        F.col("adj_key").alias("_s_key"), *[F.col(k).alias(f"_s_{k}") for k in JOIN_KEYS], F.col("value_usd").alias("source_usd"))
    cond = F.col("adj_key") == F.col("_s_key")
    for k in JOIN_KEYS:
        cond = cond & (F.col(k) == F.col(f"_s_{k}"))  # plain equality: NULL keys do not match
    delta = F.col("source_usd").cast(VALUE_TYPE) * F.col("_f") - F.col("value_usd")
    out = t.join(s, cond, "left").select("adj_key", *ITEM, F.col("value_usd").alias("original_usd"), "source_usd", delta.alias("delta_usd"))
    return doubles(out, ["original_usd", "source_usd", "delta_usd"])


@q("adj_legacy_roll_all", scale_sql("hdr_inline", True, CUR_CTE + ", " + _attrs("cur", "cura") + f"""
, r AS (SELECT adj_key, cobid AS target, source_cobid AS source, entity_code AS ent, CAST(scale_factor AS DECIMAL(12,4)) AS fac FROM rolls_orders),
  t AS (SELECT r.adj_key, r.target, {POS}, -CAST(value_local AS DECIMAL(28,8)) AS value_local, -CAST(value_usd AS DECIMAL(28,8)) AS value_usd,
               'flatten_target' AS leg FROM fa JOIN r ON fa.cobid = r.target AND upper(fa.entity_code) = r.ent),
  s AS (SELECT r.adj_key, r.target, {POS}, CAST(CAST(value_local AS DECIMAL(28,8)) * fac AS DECIMAL(28,8)) AS value_local,
               CAST(CAST(value_usd AS DECIMAL(28,8)) * fac AS DECIMAL(28,8)) AS value_usd,
               'copy_source' AS leg FROM fa JOIN r ON fa.cobid = r.source AND upper(fa.entity_code) = r.ent),
  a AS (SELECT r.adj_key, r.target, {POS}, CAST(sum(CAST(value_local AS DECIMAL(28,8))) * fac AS DECIMAL(28,8)) AS value_local,
               CAST(sum(CAST(value_usd AS DECIMAL(28,8))) * fac AS DECIMAL(28,8)) AS value_usd,
               'copy_source_restatements' AS leg FROM cura JOIN r ON cura.cobid = r.source AND upper(cura.entity_code) = r.ent
        GROUP BY r.adj_key, r.target, fac, {POS})
SELECT adj_key, target AS cobid, {POS}, leg, CAST(value_local AS DOUBLE) AS value_local, CAST(value_usd AS DOUBLE) AS value_usd
FROM (SELECT * FROM t UNION ALL SELECT * FROM s UNION ALL SELECT * FROM a) u""", ["rolls_orders"]))
def adj_legacy_roll_all(spark, d):
    """The older roll of every roll slice, each with its own factor."""
    v = S.register(spark, d, ["fact", "book_dim", "rolls_orders"])
    fa = attach_attrs(v["fact"], v, ["entity_code"])
    da = attach_attrs(current_deltas(spark, d), v, ["entity_code"])
    out = legacy_rolls(fa, da, v["rolls_orders"], S.POSITION_COLS, M2)
    return doubles(out.select("adj_key", "cobid", *POS_NO_COB, "leg", *M2), M2)


# --- every uploaded batch, every request -------------------------------------
@q("src_csv_upload_all", S.with_views(["stage_direct"], """
SELECT batch_id AS "BATCH_ID", CAST(order_key AS VARCHAR) AS "ORDER_KEY", CAST(line_no AS VARCHAR) AS "LINE_NO",
       entity_code AS "ENTITY_CODE", value_usd AS "VALUE_USD"
FROM stage_direct"""))
def src_csv_upload_all(spark, d):
    """Every batch's user file, read as all-text rows: files of other separators, columns in another order."""
    v = S.register(spark, d, ["stage_direct"])
    rows = IO.write_image(v["stage_direct"].select(
        F.col("batch_id").alias(" Batch_Id"), F.col("order_key").alias("order_key "), F.col("line_no").alias("Line_No"),
        F.col("entity_code").alias("entity_code"), F.col("value_usd").alias("Value_USD")), "stage")
    path = IO.scratch_path(spark, "upload")
    for n, (sep, back) in enumerate(((";", False), (",", True), ("\t", False), ("|", True))):
        some = rows.where(F.pmod(F.xxhash64(" Batch_Id", "order_key "), F.lit(4)) == n)
        some.select(*(rows.columns[::-1] if back else rows.columns)).write.mode("append").option("header", True).option("sep", sep).csv(path)
    return IO.read_upload(spark, path).drop("source_file")


@q("adj_business_checks_all", scale_sql("hdr_inline", True, f"""
, o AS (SELECT h.restatement_id, sum(x.value_usd) AS original_total FROM fa x JOIN hdr_inline h ON x.cobid = h.cobid AND {_wild('h', 'x')} GROUP BY 1),
  b AS (SELECT restatement_id, sum(value_usd) AS delta_total, count(*) AS delta_rows FROM b_out GROUP BY 1),
  m AS (SELECT restatement_id, sum(value_usd) AS summary_total FROM (
         SELECT restatement_id, cobid, source_system_code, sum(value_usd) AS value_usd FROM b_out GROUP BY ALL) u GROUP BY 1)
SELECT h.restatement_id, CAST(b.delta_total AS DOUBLE) AS delta_total, CAST(o.original_total AS DOUBLE) AS original_total,
       coalesce(b.delta_rows, 0) AS delta_rows, CAST(m.summary_total AS DOUBLE) AS summary_total
FROM hdr_inline h LEFT JOIN o ON h.restatement_id = o.restatement_id LEFT JOIN b ON h.restatement_id = b.restatement_id
 LEFT JOIN m ON h.restatement_id = m.restatement_id"""))
def adj_business_checks_all(spark, d):
    """Delta, original and summary totals of every request; NULL and 0 for one without rows."""
    v = S.register(spark, d, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_inline"])
    h = v["hdr_inline"]
    fmap = {c: S.FILTER_MAP[c] for c in active_filters(h, S.FILTER_COLS)}
    orig = matched(attach_attrs(v["fact"], v, fmap.values()), h, fmap, match_on="target")
    orig = orig.groupBy(F.col("_p_key").alias("adj_key")).agg(F.sum("value_usd").cast("double").alias("original_total"))
    dl = run_scale(spark, d, "hdr_inline")
    a = dl.groupBy("restatement_id").agg(F.sum("value_usd").cast("double").alias("delta_total"), F.count(F.lit(1)).alias("delta_rows"))
    c = D.summarise(dl, ["restatement_id", "cobid", "source_system_code"], ["value_usd"]).groupBy("restatement_id").agg(
        F.sum("value_usd").cast("double").alias("summary_total"))
    out = h.select("restatement_id", "adj_key").join(orig, "adj_key", "left").join(a, "restatement_id", "left").join(c, "restatement_id", "left")
    return out.select("restatement_id", "delta_total", "original_total", F.coalesce("delta_rows", F.lit(0)).alias("delta_rows"), "summary_total")


# --- entity rolls, reversals and older steps of every request ---------------
_EROLL_SQL = roll_ctes("erolls_orders")


@q("adj_entity_roll_all", scale_sql("hdr_inline", True, _EROLL_SQL + f"""
SELECT {', '.join(OUT_COLS)}, CAST(value_local AS DOUBLE) AS value_local, CAST(value_usd AS DOUBLE) AS value_usd FROM rolled""", ["erolls_orders"]))
def adj_entity_roll_all(spark, d):
    """The entity roll of every slice that the orders ask for, at once."""
    out, _ = _roll(spark, d, "erolls_orders")
    return doubles(out["deltas"].select(*OUT_COLS, *M2), M2)


@q("agg_summary_entity_slice_all", scale_sql("hdr_inline", True, _EROLL_SQL + """
, ra AS (SELECT r.*, b.entity_code FROM rolled r LEFT JOIN book_dim b ON coalesce(r.book_key, -1) = b.book_key)
SELECT ra.cobid, upper(ra.entity_code) AS entity, ra.restatement_id, ra.source_system_code,
       CAST(sum(ra.value_usd) AS DOUBLE) AS value_usd
FROM ra JOIN rl ON ra.cobid = rl.cobid AND upper(ra.entity_code) = rl.ent GROUP BY ALL""", ["erolls_orders"]))
def agg_summary_entity_slice_all(spark, d):
    return entity_slices(spark, d, "erolls_orders")


@q("adj_reverse_all", scale_sql("hdr_inline", True, CUR_CTE + f"""
SELECT c.cobid, CAST(r.new_id AS BIGINT) AS restatement_id, {', '.join('c.' + c for c in POS_NO_COB)},
       CAST(-c.value_local AS DOUBLE) AS value_local, CAST(-c.value_usd AS DOUBLE) AS value_usd
FROM cur c JOIN reversals r ON c.restatement_id = r.old_id""", ["reversals"]))
def adj_reverse_all(spark, d):
    """Every request of a reversal table taken back in one join."""
    v = S.register(spark, d, ["reversals"])
    cur = current_deltas(spark, d).select("cobid", "restatement_id", *POS_NO_COB, *M2)
    return doubles(D.reverse_all(cur, v["reversals"], "restatement_id", M2), M2)


@q("adj_legacy_step_all", S.with_views(["fact", "book_dim", "steps_all"], """
SELECT s.adj_key, s.target_cobid AS cobid, f.book_key, f.source_system_code,
       CAST(sum(CAST(f.value_usd AS DECIMAL(28,8)) * s.scale_factor) AS DOUBLE) AS value_usd
FROM fact f JOIN book_dim b ON f.book_key = b.book_key
JOIN steps_all s ON f.cobid = s.source_cobid AND b.department_code = s.department_code AND (s.currency_code IS NULL OR s.currency_code = f.currency_code)
GROUP BY ALL"""))
def adj_legacy_step_all(spark, d):
    """Every step of a step table: scaled, summed slices of source dates under target dates."""
    v = S.register(spark, d, ["fact", "book_dim", "steps_all"])
    fa = attach_attrs(v["fact"], v, ["department_code", "book_code"])
    fmap = {c: c for c in ("department_code", "currency_code", "book_code")}
    return doubles(legacy_steps(fa, v["steps_all"], fmap, ["book_key", "source_system_code"], "value_usd"), ["value_usd"])


# --- the composed run -------------------------------------------------------
def _processed(spark, d) -> Tables:
    """Two batches of requests from request to published tables; the second is run again."""
    v = S.register(spark, d, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_prior", "hdr_inline"])
    tables = Tables(spark, IO.scratch_path(spark, "process"))
    for batch in ("hdr_prior", "hdr_inline", "hdr_inline"):
        process(tables, SCOPE, batch, v[batch], v["fact"], lambda df, h=batch: attach_attrs(df, v, S.FILTER_MAP.values(), requests=v[h]))
    return tables


@q("adj_process_run", scale_sql("hdr_inline", True, CUR_CTE + f"""
SELECT {', '.join(OUT_COLS)}, CAST(value_local AS DOUBLE) AS value_local, CAST(value_usd AS DOUBLE) AS value_usd FROM cur"""))
def adj_process_run(spark, d):
    return doubles(_processed(spark, d).read(DELTAS).select(*OUT_COLS, *M2), M2)


@q("adj_process_summary", scale_sql("hdr_inline", True, CUR_CTE + """
SELECT cobid, restatement_id, source_system_code, currency_code,
       CAST(sum(value_local) AS DOUBLE) AS value_local, CAST(sum(value_usd) AS DOUBLE) AS value_usd
FROM cur GROUP BY ALL"""))
def adj_process_summary(spark, d):
    return doubles(SCOPE.summary(_processed(spark, d)).read(), M2)


# --- scopes from settings ---------------------------------------------------
PLANS = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "conf", "plans.json")
_ORDER_FILTERS = {c: c for c in ("entity_code", "strategy", "trade_typology")}
_ORDER_POS = ["trade_key", "counterparty_key"]
_ACCEPTED = " AND ".join(f"{c} IS NULL" for c in S.FILTER_COLS if c not in _ORDER_FILTERS)
_ORDER_ATTRS = """SELECT x.*, n.n_name AS entity_code, o.o_orderpriority AS strategy, o.o_orderstatus AS trade_typology
  FROM {src} x LEFT JOIN customer c ON x.counterparty_key = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN orders o ON x.trade_key = o.o_orderkey"""
_SCOPES_SQL = scale_sql("hdr_inline", True, CUR_CTE + ",\n" + ",\n".join([
    """ofact AS (SELECT CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + 1 AS INT) AS cobid, o_orderkey AS trade_key,
       o_custkey AS counterparty_key, CAST(o_totalprice AS DECIMAL(18,2)) AS value_usd FROM orders)""",
    f"ofa AS ({_ORDER_ATTRS.format(src='ofact')})",
    f"ohp AS (SELECT * FROM hdr_prior WHERE {_ACCEPTED})", f"ohi AS (SELECT * FROM hdr_inline WHERE {_ACCEPTED})",
    *scale_ctes("op", "ohp", None, "ofa", _ORDER_POS, ["value_usd"], "value_usd", _ORDER_FILTERS),
    f"opa AS ({_ORDER_ATTRS.format(src='op_out')})",
    *scale_ctes("ob", "ohi", "opa", "ofa", _ORDER_POS, ["value_usd"], "value_usd", _ORDER_FILTERS),
    """ocur AS (SELECT * FROM op_out p WHERE NOT EXISTS (SELECT 1 FROM ob_out b WHERE b.cobid = p.cobid AND b.trade_key = p.trade_key
       AND b.counterparty_key IS NOT DISTINCT FROM p.counterparty_key) UNION ALL SELECT * FROM ob_out)"""]) + """
SELECT 'LineItem' AS scope, cobid, restatement_id, trade_key, CAST(sum(value_usd) AS DOUBLE) AS value_usd FROM cur GROUP BY ALL
UNION ALL SELECT 'Orders', cobid, restatement_id, trade_key, CAST(sum(value_usd) AS DOUBLE) FROM ocur GROUP BY ALL""")


@q("src_scope_process", _SCOPES_SQL)
def src_scope_process(spark, d):
    """Two scopes of different grain, metrics and filters, processed from settings alone."""
    v = S.register(spark, d, ["hdr_prior", "hdr_inline"])
    out = []
    for name in ("lineitem", "ORDERS"):
        plan = load_plan(spark, PLANS, name, sf_dir=d)
        tables = Tables(spark, IO.scratch_path(spark, "scope"))
        for batch in ("hdr_prior", "hdr_inline"):
            plan.process(tables, batch, v[batch], S.FILTER_COLS)
        out.append(plan.deltas(tables).groupBy(F.lit(plan.name).alias("scope"), "cobid", "restatement_id", "trade_key").agg(
            F.sum("value_usd").cast("double").alias("value_usd")))
    return out[0].unionByName(out[1])


# Every line item as an uploaded row of 21 measures, some of them 0, blank or no number.
_WIDE = [(m, f"CASE WHEN (l_orderkey + {i}) % 4 = 0 THEN '0' WHEN (l_orderkey + {i}) % 7 = 0 THEN 'n/a' WHEN (l_linenumber + {i}) % 5 = 0 THEN ''"
             f" ELSE CAST({{price}} - {i * 1000} AS {{text}}) END") for i, m in enumerate(VAR_COMPONENTS)]
_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
_WIDE_ROWS = """SELECT CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + 1 AS INT) AS cobid, l_orderkey AS trade_key, l_linenumber AS line_no,
  s_name AS book_code, n_name AS entity_code, CAST(100 + l_linenumber AS BIGINT) AS restatement_id, {measures}
FROM {items} LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey"""


def _wide_rows(text: str, items: str = "lineitem", price: str = _PRICE) -> str:
    return _WIDE_ROWS.format(items=items, measures=", ".join(f"{e.format(text=text, price=price)} AS {m}" for m, e in _WIDE))


@q("adj_upload_wide", f"""
WITH up AS ({_wide_rows("VARCHAR")}),
 long AS ({' UNION ALL '.join(f"SELECT cobid, trade_key, line_no, book_code, entity_code, restatement_id, '{m}' AS measure, TRY_CAST({m} AS DECIMAL(18,4)) AS v FROM up" for m in VAR_COMPONENTS)}),
 bk AS (SELECT upper(trim(s_name)) AS c, max(s_suppkey) AS k FROM supplier GROUP BY 1),
 en AS (SELECT upper(trim(n_name)) AS c, max(n_nationkey) AS k FROM nation GROUP BY 1)
SELECT cobid, restatement_id, measure, CAST(coalesce(bk.k, -1) AS BIGINT) AS book_key, CAST(coalesce(en.k, -1) AS BIGINT) AS entity_key,
       count(*) AS n, CAST(sum(v) AS DOUBLE) AS value_usd
FROM long LEFT JOIN bk ON upper(trim(book_code)) = bk.c LEFT JOIN en ON upper(trim(entity_code)) = en.c
WHERE v IS NOT NULL AND v <> 0 GROUP BY ALL""")
def adj_upload_wide(spark, d):
    """The wide upload end to end from settings: payload, 21 measures by type, codes, published delta rows."""
    S.register(spark, d, ["lineitem", "supplier", "nation"])
    # the price is read as a decimal once a row, not for each of the 21 measures
    rows = spark.sql(_wide_rows("STRING", f"(SELECT *, {_PRICE} AS price FROM lineitem)", "price"))
    fields = [c for c in rows.columns if c != "restatement_id"]
    payload = to_payload(rows.withColumn("restatement_created_timestamp", F.lit("2026-01-05 09:00:00").cast("timestamp")),
                         ["restatement_id", "restatement_created_timestamp"], fields)
    plan = load_plan(spark, PLANS, "VaRUpload", sf_dir=d)
    tables = Tables(spark, IO.scratch_path(spark, "upload"))
    for _ in range(2):  # run again: published already
        plan.upload(tables, "upload", payload)
    return plan.deltas(tables).groupBy("cobid", "restatement_id", "measure", "book_key", "entity_key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value_usd").cast("double").alias("value_usd"))
