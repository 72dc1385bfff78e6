"""Registered queries: validation of staged rows and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from restate.operators import delta as D
from restate.operators import validate as V
from restate.queries import standin as S
from restate.queries.common import Query

QUERIES: list[Query] = []


def q(name, sql=None):
    def deco(fn):
        QUERIES.append(Query(name, fn, sql))
        return fn
    return deco


RID = ["order_key", "line_no", "part_key", "supp_key"]
RIDS = ", ".join(f"s.{c}" for c in RID)
VIEWS = ["stage_direct", "entity_dim", "book_dim", "instrument_dim", "trade_dim"]

# SQL twin of the per-row error array (same rule order as ``direct_errors``).
_CHECKS_SQL = f"""
WITH ok_entity AS (SELECT DISTINCT upper(trim(entity_code)) AS c FROM entity_dim),
 ok_trade AS (SELECT DISTINCT upper(trim(trade_code)) AS c FROM trade_dim),
 ok_instr AS (SELECT DISTINCT upper(trim(instrument_code)) AS c FROM instrument_dim),
 ok_book AS (SELECT DISTINCT {RIDS} FROM stage_direct s JOIN book_dim b
             ON upper(trim(s.book_code)) = upper(trim(b.book_code))
            AND (s.entity_code IS NULL OR upper(trim(s.entity_code)) = upper(trim(b.entity_code)))
            AND (s.department_code IS NULL OR upper(trim(s.department_code)) = upper(trim(b.department_code)))),
 ok_dept AS (SELECT DISTINCT {RIDS} FROM stage_direct s JOIN book_dim b
             ON upper(trim(s.department_code)) = upper(trim(b.department_code))
            AND (s.entity_code IS NULL OR upper(trim(s.entity_code)) = upper(trim(b.entity_code)))),
 chk AS (
 SELECT s.batch_id, {RIDS}, list_filter([
   CASE WHEN s.entity_code IS NULL THEN 'ENTITY_CODE is required' END,
   CASE WHEN s.value_usd IS NULL THEN 'VALUE_USD is required' END,
   CASE WHEN s.value_usd IS NOT NULL AND TRY_CAST(s.value_usd AS DECIMAL(38,6)) IS NULL
        THEN 'VALUE_USD is not numeric: ' || s.value_usd END,
   CASE WHEN TRY_CAST(s.value_usd AS DECIMAL(38,6)) = 0 THEN 'VALUE_USD must not be zero' END,
   CASE WHEN s.entity_code IS NOT NULL AND oe.c IS NULL THEN 'Unknown ENTITY_CODE: ' || s.entity_code END,
   CASE WHEN s.book_code IS NOT NULL AND ob.order_key IS NULL
        THEN 'Unknown BOOK_CODE (for entity/department): ' || s.book_code END,
   CASE WHEN s.department_code IS NOT NULL AND od.order_key IS NULL
        THEN 'Unknown DEPARTMENT_CODE (for entity): ' || s.department_code END,
   CASE WHEN s.trade_code IS NOT NULL AND ot.c IS NULL THEN 'Unknown TRADE_CODE: ' || s.trade_code END,
   CASE WHEN s.instrument_code IS NOT NULL AND oi.c IS NULL THEN 'Unknown INSTRUMENT_CODE: ' || s.instrument_code END
 ], lambda x: x IS NOT NULL) AS errs
 FROM stage_direct s
 LEFT JOIN ok_entity oe ON oe.c = upper(trim(s.entity_code))
 LEFT JOIN ok_trade ot ON ot.c = upper(trim(s.trade_code))
 LEFT JOIN ok_instr oi ON oi.c = upper(trim(s.instrument_code))
 LEFT JOIN ok_book ob ON ob.order_key = s.order_key AND ob.line_no = s.line_no AND ob.part_key = s.part_key AND ob.supp_key = s.supp_key
 LEFT JOIN ok_dept od ON od.order_key = s.order_key AND od.line_no = s.line_no AND od.part_key = s.part_key AND od.supp_key = s.supp_key)
"""


def direct_errors(spark, d):
    """Staged rows + ``errors`` array (one projection, all rules)."""
    v = S.register(spark, d, VIEWS)
    s = v["stage_direct"]
    s = V.qualified_hit(s, v["book_dim"], "book_code", "book_code",
                        {"entity_code": "entity_code", "department_code": "department_code"}, "ok_book")
    s = V.qualified_hit(s, v["book_dim"], "department_code", "department_code",
                        {"entity_code": "entity_code"}, "ok_dept")
    # staged rows that share their four keys are one upload row: what fits one of them fits all
    s = D.share_repeated(s, RID, ["ok_book", "ok_dept"])
    # after that: it reads its rows twice, and trades are many
    s = V.code_hit(s, v["entity_dim"], "entity_code", "entity_code", "ok_entity")
    s = V.code_hit(s, v["trade_dim"], "trade_code", "trade_code", "ok_trade")
    s = V.code_hit(s, v["instrument_dim"], "instrument_code", "instrument_code", "ok_instr")
    num = V.numeric("value_usd")
    c = F.col
    errs = V.error_array([
        (c("entity_code").isNull(), F.lit("ENTITY_CODE is required")),
        (c("value_usd").isNull(), F.lit("VALUE_USD is required")),
        (c("value_usd").isNotNull() & num.isNull(), F.concat(F.lit("VALUE_USD is not numeric: "), c("value_usd"))),
        (num == 0, F.lit("VALUE_USD must not be zero")),
        (c("entity_code").isNotNull() & ~c("ok_entity"), F.concat(F.lit("Unknown ENTITY_CODE: "), c("entity_code"))),
        (c("book_code").isNotNull() & ~c("ok_book"),
         F.concat(F.lit("Unknown BOOK_CODE (for entity/department): "), c("book_code"))),
        (c("department_code").isNotNull() & ~c("ok_dept"),
         F.concat(F.lit("Unknown DEPARTMENT_CODE (for entity): "), c("department_code"))),
        (c("trade_code").isNotNull() & ~c("ok_trade"), F.concat(F.lit("Unknown TRADE_CODE: "), c("trade_code"))),
        (c("instrument_code").isNotNull() & ~c("ok_instr"),
         F.concat(F.lit("Unknown INSTRUMENT_CODE: "), c("instrument_code"))),
    ])
    return s.select("batch_id", *RID, errs.alias("errs"))


@q("adj_validate_direct", S.with_views(VIEWS, _CHECKS_SQL + f"""
SELECT batch_id, order_key, line_no, part_key, supp_key, len(errs) = 0 AS is_valid,
       array_to_string(errs, ' | ') AS validation_errors FROM chk"""))
def adj_validate_direct(spark, d):
    e = direct_errors(spark, d)
    return e.select("batch_id", *RID, (F.size("errs") == 0).alias("is_valid"),
                    F.array_join("errs", " | ").alias("validation_errors"))


@q("shp_error_array", S.with_views(VIEWS, _CHECKS_SQL + """
SELECT batch_id, len(errs) AS n_errors, count(*) AS n_rows FROM chk GROUP BY ALL"""))
def shp_error_array(spark, d):
    e = direct_errors(spark, d)
    return e.groupBy("batch_id", F.size("errs").alias("n_errors")).agg(F.count(F.lit(1)).alias("n_rows"))


@q("jn_reference_validate", S.with_views(VIEWS, _CHECKS_SQL + """
SELECT batch_id, split_part(err, ':', 1) AS rule, count(*) AS n
FROM (SELECT batch_id, unnest(errs) AS err FROM chk) GROUP BY ALL"""))
def jn_reference_validate(spark, d):
    e = V.explode_errors(direct_errors(spark, d), ["batch_id"], "errs", "err")
    return e.groupBy("batch_id", F.split_part("err", F.lit(":"), F.lit(1)).alias("rule")).agg(
        F.count(F.lit(1)).alias("n"))


@q("set_union_errors", S.with_views(VIEWS, _CHECKS_SQL + """
SELECT batch_id, order_key, line_no, part_key, supp_key, unnest(errs) AS error FROM chk"""))
def set_union_errors(spark, d):
    return V.explode_errors(direct_errors(spark, d), ["batch_id", *RID], "errs", "error")


@q("agg_errors_per_row", S.with_views(VIEWS, _CHECKS_SQL + """
SELECT batch_id, order_key, line_no, part_key, supp_key, array_to_string(list_sort(list(error)), '; ') AS errors
FROM (SELECT batch_id, order_key, line_no, part_key, supp_key, unnest(errs) AS error FROM chk)
GROUP BY ALL"""))
def agg_errors_per_row(spark, d):
    e = V.explode_errors(direct_errors(spark, d), ["batch_id", *RID], "errs", "error")
    return V.errors_per_row(e, ["batch_id", *RID], "error")


@q("jn_pair_belongs", S.with_views(["stage_direct", "book_dim"], f"""
WITH ok_b AS (SELECT DISTINCT upper(trim(book_code)) AS c FROM book_dim),
 ok_e AS (SELECT DISTINCT upper(trim(entity_code)) AS c FROM book_dim),
 ok_p AS (SELECT DISTINCT upper(trim(book_code)) AS b, upper(trim(entity_code)) AS e FROM book_dim)
SELECT {RIDS}, 'BOOK_CODE ''' || s.book_code || ''' does not belong to ENTITY_CODE ''' || s.entity_code || '''' AS error
FROM stage_direct s
JOIN ok_b ON ok_b.c = upper(trim(s.book_code))
JOIN ok_e ON ok_e.c = upper(trim(s.entity_code))
LEFT JOIN ok_p ON ok_p.b = upper(trim(s.book_code)) AND ok_p.e = upper(trim(s.entity_code))
WHERE ok_p.b IS NULL"""))
def jn_pair_belongs(spark, d):
    v = S.register(spark, d, ["stage_direct", "book_dim"])
    s = v["stage_direct"].select(*RID, "book_code", "entity_code")
    s = V.code_hit(s, v["book_dim"], "book_code", "book_code", "b_ok")
    s = V.code_hit(s, v["book_dim"], "entity_code", "entity_code", "e_ok")
    s = V.pair_hit(s, v["book_dim"], {"book_code": "book_code", "entity_code": "entity_code"}, "p_ok")
    out = s.where(F.col("b_ok") & F.col("e_ok") & ~F.col("p_ok"))
    return out.select(*RID, F.concat(F.lit("BOOK_CODE '"), "book_code", F.lit("' does not belong to ENTITY_CODE '"),
                                     "entity_code", F.lit("'")).alias("error"))


# Fixed rules of the conditional mandatory matrix used on the stand-in rows.
MATRIX = [
    V.MatrixRule("book_code", (V.Condition("product_type", "^small$"),), "BOOK_CODE is required for SMALL products"),
    V.MatrixRule("instrument_code", (V.Condition("currency_code", "^o$"), V.Condition("entity_code", "^nation_1", True)),
                 "INSTRUMENT_CODE is required for open positions outside NATION_1x"),
    V.MatrixRule("reason", (V.Condition("value_usd", "^0$"),), "REASON is required for zero values"),
    V.MatrixRule("not_a_column", (V.Condition("currency_code", ".*"),), "skipped: column absent"),
]


@q("adj_validate_matrix", S.with_views(["stage_direct"], f"""
WITH m AS (SELECT {RIDS}, list_filter([
   CASE WHEN coalesce(regexp_matches(s.product_type, '(?i)^small$'), FALSE)
         AND (s.book_code IS NULL OR trim(s.book_code) = '') THEN 'BOOK_CODE is required for SMALL products' END,
   CASE WHEN coalesce(regexp_matches(s.currency_code, '(?i)^o$'), FALSE)
         AND NOT coalesce(regexp_matches(s.entity_code, '(?i)^nation_1'), FALSE)
         AND (s.instrument_code IS NULL OR trim(s.instrument_code) = '')
        THEN 'INSTRUMENT_CODE is required for open positions outside NATION_1x' END,
   CASE WHEN coalesce(regexp_matches(s.value_usd, '(?i)^0$'), FALSE) AND (s.reason IS NULL OR trim(s.reason) = '')
        THEN 'REASON is required for zero values' END], lambda x: x IS NOT NULL) AS errs
   FROM stage_direct s)
SELECT order_key, line_no, part_key, supp_key, unnest(errs) AS error FROM m"""))
def adj_validate_matrix(spark, d):
    v = S.register(spark, d, ["stage_direct"])
    s = v["stage_direct"]
    s = s.withColumn("errs", V.matrix_errors(s, MATRIX))
    return V.explode_errors(s, RID, "errs", "error")


@q("adj_validate_sbm_sql", S.with_views(["stage_direct"], f"""
SELECT {RIDS}, 'BOOK_CODE is required for SMALL products' AS error FROM stage_direct s
WHERE upper(s.product_type) LIKE '%SMALL%' AND (s.book_code IS NULL OR trim(s.book_code) = '')
UNION ALL
SELECT {RIDS}, 'INSTRUMENT_CODE is required for open positions outside NATION_1x' FROM stage_direct s
WHERE upper(s.currency_code) LIKE 'O' AND upper(coalesce(s.entity_code, '')) NOT LIKE 'NATION_1%'
  AND (s.instrument_code IS NULL OR trim(s.instrument_code) = '')"""))
def adj_validate_sbm_sql(spark, d):
    """LIKE-pattern variant of the matrix (one pass, exploded)."""
    v = S.register(spark, d, ["stage_direct"])
    s = v["stage_direct"]
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    errs = V.error_array([
        (F.upper("product_type").like("%SMALL%") & blank("book_code"), F.lit("BOOK_CODE is required for SMALL products")),
        (F.upper("currency_code").like("O") & ~F.upper(F.coalesce("entity_code", F.lit(""))).like("NATION\\_1%")
         & blank("instrument_code"), F.lit("INSTRUMENT_CODE is required for open positions outside NATION_1x")),
    ])
    return V.explode_errors(s.withColumn("errs", errs), RID, "errs", "error")


@q("adj_validate_upload", S.with_views(["stage_direct", "entity_dim", "instrument_dim"], """
SELECT 'unknown_entity' AS check_name, count(*) AS n FROM stage_direct s
  WHERE s.entity_code IS NOT NULL AND upper(trim(s.entity_code)) NOT IN (SELECT upper(trim(entity_code)) FROM entity_dim)
UNION ALL SELECT 'non_numeric_value', count(*) FROM stage_direct
  WHERE value_usd IS NOT NULL AND TRY_CAST(value_usd AS DECIMAL(38,6)) IS NULL
UNION ALL SELECT 'ambiguous_instrument', count(*) FROM stage_direct s
  WHERE upper(trim(s.instrument_code)) IN (SELECT upper(trim(instrument_code)) FROM instrument_dim GROUP BY 1
                                           HAVING count(DISTINCT instrument_key) > 1)
UNION ALL SELECT 'missing_book', count(*) FROM stage_direct WHERE book_code IS NULL"""))
def adj_validate_upload(spark, d):
    from restate.operators.resolve import ambiguous_codes
    v = S.register(spark, d, ["stage_direct", "entity_dim", "instrument_dim"])
    s = V.code_hit(v["stage_direct"], v["entity_dim"], "entity_code", "entity_code", "ok_entity")
    amb = ambiguous_codes(v["instrument_dim"], "instrument_code", "instrument_key")
    s = V.code_hit(s, amb, "instrument_code", "code", "is_ambiguous")
    num = V.numeric("value_usd")
    row = s.agg(
        F.count_if(F.col("entity_code").isNotNull() & ~F.col("ok_entity")).alias("unknown_entity"),
        F.count_if(F.col("value_usd").isNotNull() & num.isNull()).alias("non_numeric_value"),
        F.count_if(F.col("is_ambiguous")).alias("ambiguous_instrument"),
        F.count_if(F.col("book_code").isNull()).alias("missing_book"))
    return row.unpivot([], ["unknown_entity", "non_numeric_value", "ambiguous_instrument", "missing_book"],
                       "check_name", "n")


@q("adj_request_validate", S.with_views(["hdr_inline", "hdr_orders"], """
WITH h AS (SELECT * FROM hdr_inline UNION ALL SELECT * FROM hdr_orders),
 e AS (SELECT adj_key, list_filter([
   CASE WHEN coalesce(length(trim(username)), 0) < 10 THEN 'Reason must be at least 10 characters' END,
   CASE WHEN lower(restatement_type) = 'scale' AND scale_factor = 1 AND coalesce(source_cobid, cobid) = cobid
        THEN 'Scale factor of 1 has no effect' END,
   CASE WHEN lower(restatement_type) = 'roll' AND coalesce(source_cobid, cobid) = cobid
        THEN 'Roll needs a source COB different from the target COB' END,
   CASE WHEN lower(restatement_type) = 'roll' AND source_cobid > cobid THEN 'Roll source COB must precede the target COB' END
 ], lambda x: x IS NOT NULL) AS errs FROM h)
SELECT adj_key, array_to_string(errs, ' | ') AS errors FROM e WHERE len(errs) > 0"""))
def adj_request_validate(spark, d):
    v = S.register(spark, d, ["hdr_inline", "hdr_orders"])
    h = v["hdr_inline"].unionByName(v["hdr_orders"])
    e = h.select("adj_key", V.request_errors(reason_col="username").alias("errs"))
    return e.where(F.size("errs") > 0).select("adj_key", F.array_join("errs", " | ").alias("errors"))
