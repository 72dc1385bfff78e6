"""Registered queries: entity roll, legacy roll, reverse, delete, replace, retry
cleanup, clone, line items, extra rolls, scenario windows, set unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from restate.functions.factor import VALUE_TYPE
from restate.functions.text import cob_to_date
from restate.operators import delta as D
from restate.operators.factored import narrower_links
from restate.operators.overlap import narrower_pairs
from restate.plans.entity_roll import entity_roll
from restate.plans.process import DELTAS, load, remove
from restate.plans.scale import legacy_roll
from restate.queries import standin as S
from restate.queries.common import (CUR_CTE, OUT_COLS, POS_NO_COB, SCOPE, Query, attach_attrs, current_deltas, doubles,
                                    prior_deltas, run_scale, scale_sql, _attrs)
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
SEL = ", ".join(OUT_COLS) + ", CAST(value_local AS DOUBLE) AS value_local, CAST(value_usd AS DOUBLE) AS value_usd"

def roll_ctes(rolls: str) -> str:
    """The entity roll of every request of the view ``rolls``, as CTEs that end in ``rolled``."""
    return CUR_CTE + ", " + _attrs("cur", "cura") + f""",
 rl AS (SELECT *, upper(entity_code) AS ent FROM {rolls}),
 kept AS (SELECT * FROM cura c WHERE NOT EXISTS (SELECT 1 FROM rl WHERE rl.cobid = c.cobid AND rl.ent = upper(c.entity_code))),
 flat AS (SELECT rl.cobid, rl.restatement_id, rl.created_date AS restatement_created_timestamp, {', '.join('x.' + c for c in POS_NO_COB)},
                 -CAST(x.value_local AS DECIMAL(28,8)) AS value_local, -CAST(x.value_usd AS DECIMAL(28,8)) AS value_usd
          FROM fa x JOIN rl ON x.cobid = rl.cobid AND upper(x.entity_code) = rl.ent),
 srcrel AS (SELECT cobid, {POS}, entity_code, value_local, value_usd FROM fa
            UNION ALL SELECT cobid, {POS}, entity_code, value_local, value_usd FROM cura),
 carry AS (SELECT rl.cobid, rl.restatement_id, rl.created_date AS restatement_created_timestamp, {', '.join('x.' + c for c in POS_NO_COB)},
                  CAST(x.value_local AS DECIMAL(28,8)) AS value_local, CAST(x.value_usd AS DECIMAL(28,8)) AS value_usd
           FROM srcrel x JOIN rl ON x.cobid = rl.source_cobid AND upper(x.entity_code) = rl.ent),
 rolled AS (SELECT {', '.join(OUT_COLS)}, value_local, value_usd FROM kept
            UNION ALL SELECT * FROM flat UNION ALL SELECT * FROM carry)
"""


_ROLL_CTES = roll_ctes("rolls_inline")


def _roll(spark, d, rolls="rolls_inline"):
    v = S.register(spark, d, ["fact", "book_dim", rolls])
    fa = attach_attrs(v["fact"], v, ["entity_code"])
    stored = IO.write_image(current_deltas(spark, d), "deltas")  # the delta table that a roll reads
    da = attach_attrs(stored, v, ["entity_code"])
    return entity_roll(fa, da, v[rolls], S.POSITION_COLS, M2), v


@q("adj_entity_roll", scale_sql("hdr_inline", True, _ROLL_CTES + f"SELECT {SEL} FROM rolled", ["rolls_inline"]))
def adj_entity_roll(spark, d):
    out, _ = _roll(spark, d)
    return doubles(out["deltas"], M2)


@q("agg_summary_entity_slice", scale_sql("hdr_inline", True, _ROLL_CTES + """
, ra AS (SELECT r.*, b.entity_code FROM rolled r LEFT JOIN book_dim b ON coalesce(r.book_key, -1) = b.book_key)
SELECT ra.cobid, upper(ra.entity_code) AS entity, ra.restatement_id, ra.source_system_code,
       CAST(sum(ra.value_usd) AS DOUBLE) AS value_usd
FROM ra JOIN rl ON ra.cobid = rl.cobid AND upper(ra.entity_code) = rl.ent GROUP BY ALL""", ["rolls_inline"]))
def agg_summary_entity_slice(spark, d):
    return entity_slices(spark, d, "rolls_inline")


def entity_slices(spark, d, rolls):
    """The rolled slices of every request of ``rolls``, summed."""
    out, v = _roll(spark, d, rolls)
    r = attach_attrs(out["deltas"], v, ["entity_code"])
    rl = v[rolls].select(F.col("cobid").alias("_c"), F.upper("entity_code").alias("_e"))
    sl = r.join(rl, (F.col("cobid") == F.col("_c")) & (F.upper("entity_code") == F.col("_e")), "left_semi")
    s = D.summarise(sl.withColumn("entity", F.upper("entity_code")),
                    ["cobid", "entity", "restatement_id", "source_system_code"], ["value_usd"])
    return doubles(s, ["value_usd"])


@q("adj_entity_roll_check", scale_sql("hdr_inline", True, _ROLL_CTES + f"""
, comb AS (SELECT cobid, {POS}, entity_code, value_usd FROM fa
           UNION ALL SELECT r.cobid, {', '.join('r.' + c for c in POS_NO_COB)}, b.entity_code, r.value_usd
           FROM rolled r LEFT JOIN book_dim b ON coalesce(r.book_key, -1) = b.book_key),
 tgt AS (SELECT rl.adj_key, {', '.join('c.' + c for c in POS_NO_COB)}, sum(c.value_usd) AS v FROM comb c
         JOIN rl ON c.cobid = rl.cobid AND upper(c.entity_code) = rl.ent GROUP BY ALL),
 src AS (SELECT rl.adj_key, {', '.join('c.' + c for c in POS_NO_COB)}, sum(c.value_usd) AS v FROM
         (SELECT cobid, {POS}, entity_code, value_usd FROM fa UNION ALL SELECT cobid, {POS}, entity_code, value_usd FROM cura) c
         JOIN rl ON c.cobid = rl.source_cobid AND upper(c.entity_code) = rl.ent GROUP BY ALL)
SELECT coalesce(t.adj_key, s.adj_key) AS adj_key, count(*) AS positions,
       CAST(sum(coalesce(t.v, 0)) AS DOUBLE) AS target_usd, CAST(sum(coalesce(s.v, 0)) AS DOUBLE) AS source_usd,
       count_if(abs(coalesce(t.v, 0) - coalesce(s.v, 0)) >= 0.01) AS breaks
FROM tgt t FULL OUTER JOIN src s ON t.adj_key = s.adj_key AND {' AND '.join(f't.{c} IS NOT DISTINCT FROM s.{c}' for c in POS_NO_COB)}
GROUP BY 1""", ["rolls_inline"]))
def adj_entity_roll_check(spark, d):
    """Post-condition: combined(target, entity) equals combined(source, entity) per position."""
    out, v = _roll(spark, d)
    fa = attach_attrs(v["fact"], v, ["entity_code"])
    rl = v["rolls_inline"].select("adj_key", F.col("cobid").alias("_t"), F.col("source_cobid").alias("_s"),
                                  F.upper("entity_code").alias("_e"))
    cols = ["cobid", *POS_NO_COB, "entity_code", "value_usd"]
    comb_t = fa.select(*cols).unionByName(attach_attrs(out["deltas"], v, ["entity_code"]).select(*cols))
    da = attach_attrs(current_deltas(spark, d), v, ["entity_code"])
    comb_s = fa.select(*cols).unionByName(da.select(*cols))
    t = comb_t.join(rl, (F.col("cobid") == F.col("_t")) & (F.upper("entity_code") == F.col("_e"))) \
        .groupBy("adj_key", *POS_NO_COB).agg(F.sum("value_usd").alias("tv"))
    s = comb_s.join(rl, (F.col("cobid") == F.col("_s")) & (F.upper("entity_code") == F.col("_e"))) \
        .groupBy("adj_key", *POS_NO_COB).agg(F.sum("value_usd").alias("sv"))
    keys = ["adj_key", *POS_NO_COB]
    cond = F.col("t.adj_key") == F.col("s.adj_key")
    for c in POS_NO_COB:
        cond = cond & F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
    j = t.alias("t").join(s.alias("s"), cond, "full_outer")
    tv, sv = F.coalesce("tv", F.lit(0)), F.coalesce("sv", F.lit(0))
    return j.groupBy(F.coalesce("t.adj_key", "s.adj_key").alias("adj_key")).agg(
        F.count(F.lit(1)).alias("positions"), F.sum(tv).cast("double").alias("target_usd"),
        F.sum(sv).cast("double").alias("source_usd"), F.count_if(F.abs(tv - sv) >= 0.01).alias("breaks"))


@q("adj_legacy_roll", scale_sql("hdr_inline", True, CUR_CTE + ", " + _attrs("cur", "cura") + f"""
, t AS (SELECT {POS}, -CAST(value_local AS DECIMAL(28,8)) AS value_local, -CAST(value_usd AS DECIMAL(28,8)) AS value_usd,
               'flatten_target' AS leg FROM fa WHERE cobid = 19970301 AND upper(entity_code) = 'NATION_3'),
  s AS (SELECT {POS}, CAST(CAST(value_local AS DECIMAL(28,8)) * CAST(1.5 AS DECIMAL(12,4)) AS DECIMAL(28,8)) AS value_local,
               CAST(CAST(value_usd AS DECIMAL(28,8)) * CAST(1.5 AS DECIMAL(12,4)) AS DECIMAL(28,8)) AS value_usd,
               'copy_source' AS leg FROM fa WHERE cobid = 19970201 AND upper(entity_code) = 'NATION_3'),
  a AS (SELECT {POS}, CAST(sum(CAST(value_local AS DECIMAL(28,8))) * CAST(1.5 AS DECIMAL(12,4)) AS DECIMAL(28,8)) AS value_local,
               CAST(sum(CAST(value_usd AS DECIMAL(28,8))) * CAST(1.5 AS DECIMAL(12,4)) AS DECIMAL(28,8)) AS value_usd,
               'copy_source_restatements' AS leg FROM cura WHERE cobid = 19970201 AND upper(entity_code) = 'NATION_3' GROUP BY {POS})
SELECT 19970301 AS cobid, {POS}, leg, CAST(value_local AS DOUBLE) AS value_local, CAST(value_usd AS DOUBLE) AS value_usd
FROM (SELECT * FROM t UNION ALL SELECT * FROM s UNION ALL SELECT * FROM a) u"""))
def adj_legacy_roll(spark, d):
    v = S.register(spark, d, ["fact", "book_dim"])
    fa = attach_attrs(v["fact"], v, ["entity_code"])
    da = attach_attrs(current_deltas(spark, d), v, ["entity_code"])
    out = legacy_roll(fa, da, 19970301, 19970201, 1.5, S.POSITION_COLS, M2,
                      slice_filter=F.upper(F.col("entity_code")) == "NATION_3")
    return doubles(out.select("cobid", *POS_NO_COB, "leg", *M2), M2).withColumn("cobid", F.col("cobid").cast("int"))


@q("adj_legacy_step", S.with_views(["fact", "book_dim"], f"""
SELECT 19990101 AS cobid, f.book_key, f.source_system_code,
       CAST(sum(CAST(f.value_usd AS DECIMAL(28,8)) * CAST(-0.5 AS DECIMAL(12,4))) AS DOUBLE) AS value_usd
FROM fact f JOIN book_dim b ON f.book_key = b.book_key
WHERE f.cobid = 19981201 AND b.department_code = 'ASIA' AND f.currency_code = 'F'
GROUP BY f.book_key, f.source_system_code"""))
def adj_legacy_step(spark, d):
    """Generic step: insert a scaled, aggregated slice of a source COB under a target COB."""
    from restate.operators.match import value_list_filter
    v = S.register(spark, d, ["fact", "book_dim"])
    rec = {"source_cobid": 19981201, "target_cobid": 19990101, "factor": -0.5,
           "filters": {"department_code": "ASIA", "currency_code": ["F"], "book_code": ""},
           "group_by": ["book_key", "source_system_code"]}
    fa = attach_attrs(v["fact"].where(F.col("cobid") == rec["source_cobid"]), v, ["department_code", "book_code"])
    sl = value_list_filter(fa, rec["filters"])
    out = sl.groupBy(*rec["group_by"]).agg(
        F.sum(F.col("value_usd").cast(VALUE_TYPE) * F.lit(rec["factor"]).cast("decimal(12,4)")).cast("double").alias("value_usd"))
    return out.select(F.lit(rec["target_cobid"]).alias("cobid"), *rec["group_by"], "value_usd")


@q("adj_reverse", scale_sql("hdr_inline", True, CUR_CTE + f"""
SELECT cobid, CAST(9902 AS BIGINT) AS restatement_id, {POS},
       CAST(-value_local AS DOUBLE) AS value_local, CAST(-value_usd AS DOUBLE) AS value_usd
FROM cur WHERE restatement_id = 902"""))
def adj_reverse(spark, d):
    cur = current_deltas(spark, d).select("cobid", "restatement_id", *POS_NO_COB, *M2)
    return doubles(D.reverse(cur, "restatement_id", 902, 9902, M2), M2)


@q("adj_delete", scale_sql("hdr_inline", True, CUR_CTE + f"""
SELECT {SEL} FROM cur WHERE restatement_id NOT IN (SELECT restatement_id FROM hdr_inline WHERE username = 'amy')"""))
def adj_delete(spark, d):
    v = S.register(spark, d, ["hdr_inline"])
    ids = v["hdr_inline"].where(F.col("username") == "amy").select("restatement_id")
    return doubles(D.remove_ids(current_deltas(spark, d), ids, "restatement_id"), M2)


@q("adj_retry_cleanup", scale_sql("hdr_orders", False, f"""
SELECT {SEL} FROM b_out WHERE restatement_id NOT IN (SELECT restatement_id FROM hdr_queue WHERE run_status = 'Failed')""",
    ["hdr_queue"]))
def adj_retry_cleanup(spark, d):
    v = S.register(spark, d, ["hdr_queue"])
    failed = v["hdr_queue"].where(F.col("run_status") == "Failed").select("restatement_id")
    tables = Tables(spark, IO.scratch_path(spark, "cleanup"))
    new = run_scale(spark, d, "hdr_orders", with_prior=False)
    load(tables, SCOPE, "orders", new)
    for _ in range(2):  # a clean-up that runs again takes nothing more
        remove(tables, SCOPE, "retry", failed)
    return doubles(tables.read(DELTAS).select(*new.columns), M2)


@q("adj_replace_reference", S.with_views(["hdr_queue"], """
WITH h AS (SELECT * FROM hdr_queue WHERE NOT is_deleted),
 latest AS (SELECT cobid, username, max_by(adj_key, struct_pack(c := created_date, k := adj_key)) AS newest FROM h GROUP BY ALL)
SELECT h.adj_key, l.newest AS replaced_by,
       CASE WHEN h.run_status = 'Running' THEN 'Refused: running' ELSE 'Retired' END AS outcome
FROM h JOIN latest l ON h.cobid = l.cobid AND h.username = l.username AND h.adj_key <> l.newest"""))
def adj_replace_reference(spark, d):
    """A newer request with the same (COB, reference) retires older ones; refuses while Running."""
    v = S.register(spark, d, ["hdr_queue"])
    h = v["hdr_queue"].where(~F.col("is_deleted"))
    latest = h.groupBy("cobid", "username").agg(
        F.max_by("adj_key", F.struct("created_date", "adj_key")).alias("replaced_by"))
    j = h.join(latest, ["cobid", "username"]).where(F.col("adj_key") != F.col("replaced_by"))
    return j.select("adj_key", "replaced_by", F.when(F.col("run_status") == "Running", "Refused: running")
                    .otherwise("Retired").alias("outcome"))


@q("adj_clone", S.with_views(["hdr_orders"], """
SELECT adj_key || '-C' AS adj_key, 20000101 AS cobid,
       CASE WHEN coalesce(source_cobid, cobid) = cobid THEN 20000101 ELSE source_cobid END AS source_cobid,
       restatement_type, CAST(scale_factor AS DOUBLE) AS scale_factor
FROM hdr_orders"""))
def adj_clone(spark, d):
    h = S.register(spark, d, ["hdr_orders"])["hdr_orders"]
    same = F.coalesce("source_cobid", "cobid") == F.col("cobid")
    return h.select(F.concat("adj_key", F.lit("-C")).alias("adj_key"), F.lit(20000101).alias("cobid"),
                    F.when(same, F.lit(20000101)).otherwise(F.col("source_cobid")).alias("source_cobid"),
                    "restatement_type", F.col("scale_factor").cast("double").alias("scale_factor"))


_ITEMS_SQL = S.with_views(["fact", "book_dim"], f"""
WITH fa AS (SELECT f.*, b.entity_code FROM fact f LEFT JOIN book_dim b ON f.book_key = b.book_key),
 t AS (SELECT * FROM fa WHERE cobid = 19970301 AND entity_code = 'NATION_5'),
 s AS (SELECT * FROM fa WHERE cobid = 19970201 AND entity_code = 'NATION_5')
SELECT t.trade_key, t.line_no, t.book_key, t.instrument_key, t.source_system_code,
       CAST(t.value_usd AS DOUBLE) AS original_usd, CAST(s.value_usd AS DOUBLE) AS source_usd,
       CAST(CAST(s.value_usd AS DECIMAL(28,8)) * CAST(1.0 AS DECIMAL(12,4)) - t.value_usd AS DOUBLE) AS delta_usd
FROM t LEFT JOIN s ON t.book_key = s.book_key AND t.instrument_key = s.instrument_key
 AND t.source_system_code = s.source_system_code AND t.currency_code = s.currency_code""")


def _roll_left(spark, d):
    v = S.register(spark, d, ["fact", "book_dim"])
    fa = attach_attrs(v["fact"], v, ["entity_code"])
    keys = ["book_key", "instrument_key", "source_system_code", "currency_code"]
    t = fa.where((F.col("cobid") == 19970301) & (F.col("entity_code") == "NATION_5"))
    s = fa.where((F.col("cobid") == 19970201) & (F.col("entity_code") == "NATION_5")).select(
        *[F.col(k).alias(f"_s_{k}") for k in keys], F.col("value_usd").alias("source_usd"))
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"_s_{k}")  # plain equality: NULL keys do not match
        cond = c if cond is None else cond & c
    j = t.join(s, cond, "left")
    delta = (F.col("source_usd").cast(VALUE_TYPE) * F.lit(1.0).cast("decimal(12,4)") - F.col("value_usd"))
    return j.select("trade_key", "line_no", "book_key", "instrument_key", "source_system_code",
                    F.col("value_usd").cast("double").alias("original_usd"),
                    F.col("source_usd").cast("double").alias("source_usd"), delta.cast("double").alias("delta_usd"))


@q("jn_roll_left", _ITEMS_SQL)
def jn_roll_left(spark, d):
    return _roll_left(spark, d)


@q("adj_create_items", _ITEMS_SQL)
def adj_create_items(spark, d):
    """Line items with original, source and delta snapshots (roll by left join)."""
    return _roll_left(spark, d)


@q("prj_delta_pointwise", S.with_views(["fact", "hdr_inline"], f"""
SELECT h.adj_key, f.trade_key, f.line_no, f.book_key, f.instrument_key, f.source_system_code,
       CAST(f.value_usd AS DOUBLE) AS original_usd,
       CAST(CASE WHEN lower(h.restatement_type) = 'flatten' THEN -f.value_usd
                 ELSE CAST(f.value_usd AS DECIMAL(28,8)) * (CAST(h.scale_factor AS DECIMAL(12,4)) - 1) END AS DOUBLE) AS delta_usd,
       CAST(CASE WHEN lower(h.restatement_type) = 'flatten' THEN 0
                 ELSE CAST(f.value_usd AS DECIMAL(28,8)) * CAST(h.scale_factor AS DECIMAL(12,4)) END AS DOUBLE) AS projected_usd
FROM fact f JOIN hdr_inline h ON f.cobid = h.cobid AND coalesce(h.source_cobid, h.cobid) = h.cobid
 AND (h.source_system_code IS NULL OR upper(h.source_system_code) = upper(f.source_system_code))
 AND (h.currency_code IS NULL OR upper(h.currency_code) = upper(f.currency_code))
WHERE h.entity_code IS NULL AND h.department_code IS NULL AND h.book_code IS NULL AND h.instrument_code IS NULL
  AND h.product_type IS NULL AND h.strategy IS NULL AND h.trade_typology IS NULL"""))
def prj_delta_pointwise(spark, d):
    """Flatten/Scale preview per fact row: original, delta, projected (fact-native filters only)."""
    v = S.register(spark, d, ["fact", "hdr_inline"])
    dim_filters = ["entity_code", "department_code", "book_code", "instrument_code", "product_type", "strategy",
                   "trade_typology"]
    h = v["hdr_inline"].where(F.coalesce("source_cobid", "cobid") == F.col("cobid"))
    for c in dim_filters:
        h = h.where(F.col(c).isNull())
    h = h.select("adj_key", F.col("cobid").alias("_hc"), "restatement_type", "scale_factor",
                 F.col("source_system_code").alias("_hs"), F.col("currency_code").alias("_hy"))
    j = v["fact"].join(h, (F.col("cobid") == F.col("_hc"))
                       & (F.col("_hs").isNull() | (F.upper("_hs") == F.upper("source_system_code")))
                       & (F.col("_hy").isNull() | (F.upper("_hy") == F.upper("currency_code"))))
    flat = F.lower("restatement_type") == "flatten"
    val = F.col("value_usd").cast(VALUE_TYPE)
    f = F.col("scale_factor").cast("decimal(12,4)")
    return j.select("adj_key", "trade_key", "line_no", "book_key", "instrument_key", "source_system_code",
                    F.col("value_usd").cast("double").alias("original_usd"),
                    F.when(flat, -F.col("value_usd")).otherwise(val * (f - F.lit(1))).cast("double").alias("delta_usd"),
                    F.when(flat, F.lit(0)).otherwise(val * f).cast("double").alias("projected_usd"))


@q("jn_extra_rolls", S.with_views(["hdr_orders"], """
SELECT s.adj_key AS scale_adj, r.adj_key AS roll_adj, md5(s.adj_key || '-' || r.adj_key) AS extra_id, s.cobid
FROM hdr_orders s JOIN hdr_orders r ON s.cobid = r.cobid AND r.created_date < s.created_date
WHERE lower(s.restatement_type) = 'scale' AND lower(r.restatement_type) = 'roll'
  AND coalesce(s.entity_code, r.entity_code, '~') = coalesce(r.entity_code, '~')
  AND coalesce(s.department_code, r.department_code, '~') = coalesce(r.department_code, '~')
  AND coalesce(s.book_code, r.book_code, '~') = coalesce(r.book_code, '~')
  AND coalesce(s.instrument_code, r.instrument_code, '~') = coalesce(r.instrument_code, '~')
  AND coalesce(s.product_type, r.product_type, '~') = coalesce(r.product_type, '~')
  AND coalesce(s.strategy, r.strategy, '~') = coalesce(r.strategy, '~')
  AND coalesce(s.trade_typology, r.trade_typology, '~') = coalesce(r.trade_typology, '~')
  AND coalesce(s.source_system_code, r.source_system_code, '~') = coalesce(r.source_system_code, '~')
  AND coalesce(s.currency_code, r.currency_code, '~') = coalesce(r.currency_code, '~')"""))
def jn_extra_rolls(spark, d):
    """A Scale created after an earlier Roll at the same COB whose filters are narrower
    (every Scale filter open or equal to the Roll's) yields a synthetic extra restatement."""
    h = S.register(spark, d, ["hdr_orders"])["hdr_orders"]
    s = h.where(F.lower("restatement_type") == "scale")
    r = h.where(F.lower("restatement_type") == "roll")
    j = narrower_pairs(s, r, "adj_key", S.FILTER_COLS, ["cobid"], "created_date")
    return j.select(F.col("a_adj_key").alias("scale_adj"), F.col("b_adj_key").alias("roll_adj"),
                    F.md5(F.concat_ws("-", "a_adj_key", "b_adj_key")).alias("extra_id"), F.col("a_cobid").alias("cobid"))


@q("jn_extra_roll_links", S.with_views(["hdr_orders"], """
SELECT s.adj_key, count(*) AS older, min_by(r.adj_key, struct_pack(c := r.created_date, k := r.adj_key)) AS oldest,
       max_by(r.adj_key, struct_pack(c := r.created_date, k := r.adj_key)) AS newest
FROM hdr_orders s JOIN hdr_orders r ON s.cobid = r.cobid AND r.created_date < s.created_date
WHERE lower(s.restatement_type) = 'scale' AND lower(r.restatement_type) = 'roll' AND """
    + " AND ".join(f"coalesce(s.{c}, r.{c}, '~') = coalesce(r.{c}, '~')" for c in S.FILTER_COLS) + " GROUP BY s.adj_key"))
def jn_extra_roll_links(spark, d):
    """Each Scale with how many earlier, no wider Rolls it has, the first and the last: a row a Scale."""
    h = S.register(spark, d, ["hdr_orders"])["hdr_orders"]
    return narrower_links(h.where(F.lower("restatement_type") == "scale"), h.where(F.lower("restatement_type") == "roll"), "adj_key",
                          S.FILTER_COLS, ["cobid"], "created_date")


# Windows: the four quarters with the largest order volume, as a table made from the orders.
WINDOWS_SQL = """
SELECT CAST(year(o_orderdate) AS STRING) || 'Q' || CAST(quarter(o_orderdate) AS STRING) AS name,
       CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e
FROM orders GROUP BY year(o_orderdate), quarter(o_orderdate)
ORDER BY sum(CAST(o_totalprice AS DECIMAL(18,2))) DESC, 1 LIMIT 4"""


@q("jn_window_scenarios", S.with_views(["lineitem", "orders"], f"""
WITH w AS ({WINDOWS_SQL})
SELECT w.name, CAST(l.l_shipdate AS DATE) AS scenario_date, count(*) AS n FROM lineitem l
JOIN w ON CAST(l.l_shipdate AS DATE) BETWEEN w.s AND w.e GROUP BY 1, 2"""))
def jn_window_scenarios(spark, d):
    """Rows per window and day: the windows' days are listed, so the join is an equi-join on the date,
    and the rows are counted per day before it."""
    v = S.register(spark, d, ["lineitem", "orders"])
    days = spark.sql(WINDOWS_SQL).select("name", F.explode(F.sequence("s", "e")).alias("scenario_date"))
    counts = v["lineitem"].groupBy(F.to_date("l_shipdate").alias("scenario_date")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(days, "scenario_date").select("name", "scenario_date", "n")


@q("set_union_scopes", scale_sql("hdr_inline", True, CUR_CTE + """
SELECT scope, count(*) AS n, CAST(sum(value_usd) AS DOUBLE) AS value_usd FROM (
  SELECT 'VaR' AS scope, value_usd FROM p_out UNION ALL SELECT 'Stress', value_usd FROM b_out
  UNION ALL SELECT 'Combined', value_usd FROM cur) u GROUP BY scope"""))
def set_union_scopes(spark, d):
    u = D.tag_union({"VaR": prior_deltas(spark, d).select("value_usd"),
                     "Stress": run_scale(spark, d, "hdr_inline").select("value_usd"),
                     "Combined": current_deltas(spark, d).select("value_usd")})
    return u.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum("value_usd").cast("double").alias("value_usd"))


@q("set_union_synthetic", S.with_views(["hdr_orders"], """
SELECT adj_key, cobid, 'real' AS origin FROM hdr_orders
UNION ALL
SELECT md5(s.adj_key || '-' || r.adj_key), s.cobid, 'synthetic' FROM hdr_orders s JOIN hdr_orders r
  ON s.cobid = r.cobid AND r.created_date < s.created_date
WHERE lower(s.restatement_type) = 'scale' AND lower(r.restatement_type) = 'roll'
  AND coalesce(s.entity_code, r.entity_code, '~') = coalesce(r.entity_code, '~')
  AND coalesce(s.department_code, r.department_code, '~') = coalesce(r.department_code, '~')
  AND coalesce(s.book_code, r.book_code, '~') = coalesce(r.book_code, '~')
  AND coalesce(s.instrument_code, r.instrument_code, '~') = coalesce(r.instrument_code, '~')
  AND coalesce(s.product_type, r.product_type, '~') = coalesce(r.product_type, '~')
  AND coalesce(s.strategy, r.strategy, '~') = coalesce(r.strategy, '~')
  AND coalesce(s.trade_typology, r.trade_typology, '~') = coalesce(r.trade_typology, '~')
  AND coalesce(s.source_system_code, r.source_system_code, '~') = coalesce(r.source_system_code, '~')
  AND coalesce(s.currency_code, r.currency_code, '~') = coalesce(r.currency_code, '~')"""))
def set_union_synthetic(spark, d):
    v = S.register(spark, d, ["hdr_orders"])
    real = v["hdr_orders"].select("adj_key", "cobid", F.lit("real").alias("origin"))
    syn = jn_extra_rolls(spark, d).select(F.col("extra_id").alias("adj_key"), "cobid", F.lit("synthetic").alias("origin"))
    return real.unionByName(syn)


@q("set_union_distinct", S.with_views(["fact", "hdr_orders"], """
SELECT cobid FROM fact UNION SELECT cobid FROM hdr_orders"""))
def set_union_distinct(spark, d):
    v = S.register(spark, d, ["fact", "hdr_orders"])
    return v["fact"].select("cobid").union(v["hdr_orders"].select("cobid")).distinct()


@q("adj_roll_guard", S.with_views(["hdr_orders"], """
SELECT adj_key, (coalesce(source_cobid, cobid) <> cobid) AS needs_combined FROM hdr_orders"""))
def adj_roll_guard(spark, d):
    """Which requests need the combined relation (the planner refuses them without it)."""
    v = S.register(spark, d, ["hdr_orders"])
    return v["hdr_orders"].select("adj_key", (F.coalesce("source_cobid", "cobid") != F.col("cobid")).alias("needs_combined"))


def cob_dates(df, col="cobid"):
    return df.withColumn("cob_date", cob_to_date(col))
