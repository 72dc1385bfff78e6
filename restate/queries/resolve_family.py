"""Registered queries: code/key resolution, SCD2 as-of, rekey, FX, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from restate.operators import resolve as R
from restate.operators.match import dim_semi_filter, in_subquery_filter
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


@q("jn_code_to_key", S.with_views(["stage_direct", "entity_dim"], f"""
SELECT {RIDS}, s.entity_code, coalesce(e.entity_key, -1) AS entity_key
FROM stage_direct s LEFT JOIN entity_dim e ON upper(trim(s.entity_code)) = upper(trim(e.entity_code))"""))
def jn_code_to_key(spark, d):
    v = S.register(spark, d, ["stage_direct", "entity_dim"])
    out = R.resolve_key(v["stage_direct"].select(*RID, "entity_code"), v["entity_dim"], "entity_code",
                        "entity_code", "entity_key", "entity_key")
    return out


@q("jn_code_to_key_max", S.with_views(["stage_direct", "instrument_dim"], f"""
SELECT {RIDS}, s.instrument_code, coalesce(m.k, -1) AS instrument_key
FROM stage_direct s LEFT JOIN (SELECT upper(trim(instrument_code)) AS c, max(instrument_key) AS k
                               FROM instrument_dim GROUP BY 1) m
  ON upper(trim(s.instrument_code)) = m.c"""))
def jn_code_to_key_max(spark, d):
    v = S.register(spark, d, ["stage_direct", "instrument_dim"])
    return R.resolve_max(v["stage_direct"].select(*RID, "instrument_code"), v["instrument_dim"], "instrument_code",
                         "instrument_code", "instrument_key", "instrument_key")


@q("jn_qualified_code", S.with_views(["stage_direct", "book_dim"], f"""
SELECT {RIDS}, s.book_code, s.entity_code, coalesce(max(b.book_key), -1) AS book_key
FROM stage_direct s LEFT JOIN book_dim b
  ON upper(trim(s.book_code)) = upper(trim(b.book_code))
 AND (s.entity_code IS NULL OR upper(trim(s.entity_code)) = upper(trim(b.entity_code)))
 AND (s.department_code IS NULL OR upper(trim(s.department_code)) = upper(trim(b.department_code)))
GROUP BY {RIDS}, s.book_code, s.entity_code"""))
def jn_qualified_code(spark, d):
    v = S.register(spark, d, ["stage_direct", "book_dim"])
    rows = v["stage_direct"].select(*RID, "book_code", "entity_code", "department_code")
    out = R.resolve_qualified(rows, v["book_dim"], "book_code", "book_code", "book_key",
                              {"entity_code": "entity_code", "department_code": "department_code"}, "book_key")
    return out.drop("department_code")


@q("jn_fallback_dummy", S.with_views(["stage_direct", "book_dim"], f"""
SELECT {RIDS}, coalesce(nullif(trim(s.book_code), ''), s.department_code || '/RESTATEMENT') AS resolved_book_code,
       coalesce(b.book_key, -1) AS book_key
FROM stage_direct s LEFT JOIN book_dim b
  ON upper(trim(coalesce(nullif(trim(s.book_code), ''), s.department_code || '/RESTATEMENT'))) = upper(trim(b.book_code))"""))
def jn_fallback_dummy(spark, d):
    v = S.register(spark, d, ["stage_direct", "book_dim"])
    rows = v["stage_direct"].select(*RID, R.dummy_code("book_code", "department_code").alias("resolved_book_code"))
    return R.resolve_key(rows, v["book_dim"], "resolved_book_code", "book_code", "book_key", "book_key")


_ASOF_SQL = """
SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_no, l.l_partkey AS part_key, l.l_suppkey AS supp_key,
       o.o_custkey AS customer_key, v.version_key
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN cust_versions v ON v.customer_key = o.o_custkey AND l.l_shipdate >= v.effective_start
  AND (v.effective_end IS NULL OR l.l_shipdate < v.effective_end)"""


def _cust_versions(orders):
    """Versions that last until the next start of their customer."""
    return orders.select(F.col("o_custkey").alias("customer_key"), F.col("o_orderkey").alias("version_key"),
                         F.col("o_orderdate").alias("effective_start"))


@q("jn_scd2_asof", S.with_views(["cust_versions", "lineitem", "orders"], _ASOF_SQL))
def jn_scd2_asof(spark, d):
    v = S.register(spark, d, ["lineitem", "orders"])
    versions = _cust_versions(v["orders"])
    li = v["lineitem"].join(v["orders"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = li.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
                     F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
                     F.col("o_custkey").alias("customer_key"), "l_shipdate")
    out = R.asof_join(rows, versions, {"customer_key": "customer_key"}, "l_shipdate", "effective_start",
                      None, {"version_key": "version_key"}, order_cols=["version_key"])
    return out.drop("l_shipdate")


@q("jn_scd2_rekey", S.with_views(["cust_versions", "fact", "orders"], """
SELECT f.cobid, f.line_no, f.book_key, f.instrument_key, f.trade_key AS old_trade_key,
       coalesce(v.version_key, f.trade_key) AS trade_key
FROM fact f
LEFT JOIN orders o ON f.trade_key = o.o_orderkey
LEFT JOIN cust_versions v ON v.customer_key = o.o_custkey
  AND CAST(strptime(CAST(f.cobid AS VARCHAR), '%Y%m%d') AS TIMESTAMP) - INTERVAL '1' MONTH >= v.effective_start
  AND (v.effective_end IS NULL OR CAST(strptime(CAST(f.cobid AS VARCHAR), '%Y%m%d') AS TIMESTAMP) - INTERVAL '1' MONTH < v.effective_end)"""))
def jn_scd2_rekey(spark, d):
    v = S.register(spark, d, ["fact", "orders"])
    versions = _cust_versions(v["orders"])
    f = v["fact"].select("cobid", "line_no", "book_key", "instrument_key", "trade_key",
                         F.col("trade_key").alias("old_trade_key"),
                         F.add_months(F.to_date(F.col("cobid").cast("string"), "yyyyMMdd"), -1)
                         .cast("timestamp").alias("source_date"))
    out = R.rekey(f, versions, "trade_key", "customer_key", "version_key", "source_date", end_col=None, order_cols=["version_key"])
    return out.select("cobid", "line_no", "book_key", "instrument_key", "old_trade_key", "trade_key")


@q("jn_two_path_coalesce", S.with_views(["stage_direct", "instrument_dim"], f"""
SELECT {RIDS}, coalesce(m.k, s.part_key, -1) AS instrument_key
FROM stage_direct s LEFT JOIN (SELECT upper(trim(instrument_code)) AS c, max(instrument_key) AS k
                               FROM instrument_dim GROUP BY 1) m
  ON upper(trim(s.instrument_code)) = m.c"""))
def jn_two_path_coalesce(spark, d):
    v = S.register(spark, d, ["stage_direct", "instrument_dim"])
    rows = v["stage_direct"].select(*RID, "instrument_code")
    by_code = R.resolve_max(rows, v["instrument_dim"], "instrument_code", "instrument_code", "instrument_key",
                            "_by_code", unknown=None)
    return by_code.select(*RID, F.coalesce("_by_code", "part_key", F.lit(-1)).alias("instrument_key"))


FX_RATES = """
SELECT DISTINCT cobid, currency_code, CAST(CASE cobid % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS DOUBLE) AS rate
FROM fact WHERE currency_code = 'F'"""


@q("jn_fx_rate", S.with_views(["fact"], f"""
WITH rates AS ({FX_RATES})
SELECT f.cobid, f.currency_code, count(*) AS n,
       sum(CAST(f.value_usd AS DOUBLE) / coalesce(r.rate, 1)) AS value_local_fx
FROM fact f LEFT JOIN rates r ON f.cobid = r.cobid AND f.currency_code = r.currency_code
GROUP BY f.cobid, f.currency_code"""))
def jn_fx_rate(spark, d):
    v = S.register(spark, d, ["fact"])
    rates = spark.sql(FX_RATES)
    f = v["fact"].withColumn("value_usd", F.col("value_usd").cast("double"))
    conv = R.fx_to_local(f, rates, ["cobid", "currency_code"], "value_usd", "rate", "value_local_fx")
    return conv.groupBy("cobid", "currency_code").agg(F.count(F.lit(1)).alias("n"),
                                                      F.sum("value_local_fx").alias("value_local_fx"))


@q("jn_classify_lookup", S.with_views(["stage_direct"], f"""
WITH g4 AS (SELECT DISTINCT upper(trim(n_name)) AS c FROM nation WHERE n_regionkey IN (1, 3))
SELECT {RIDS}, s.entity_code, (g.c IS NOT NULL) AS is_g4,
       CASE WHEN g.c IS NOT NULL THEN 'G4' ELSE 'Non-G4' END AS g4_class
FROM stage_direct s LEFT JOIN g4 g ON upper(trim(s.entity_code)) = g.c"""))
def jn_classify_lookup(spark, d):
    v = S.register(spark, d, ["stage_direct", "nation"])
    members = v["nation"].where(F.col("n_regionkey").isin(1, 3))
    out = R.flag_membership(v["stage_direct"].select(*RID, "entity_code"), members, "entity_code", "n_name", "is_g4")
    return out.withColumn("g4_class", F.when(F.col("is_g4"), "G4").otherwise("Non-G4"))


@q("jn_name_to_id_unique", S.with_views(["stage_direct", "instrument_dim"], f"""
WITH m AS (SELECT {RIDS}, count(DISTINCT i.instrument_key) AS n, min(i.instrument_key) AS k
           FROM stage_direct s JOIN instrument_dim i
             ON upper(trim(s.instrument_code)) = upper(trim(i.instrument_code))
            AND upper(trim(s.product_type)) = upper(trim(i.product_type))
            AND upper(trim(CAST(s.instrument_size AS VARCHAR))) = upper(trim(CAST(i.instrument_size AS VARCHAR)))
           GROUP BY {RIDS})
SELECT {RIDS}, CASE WHEN m.n = 1 THEN m.k END AS unique_instrument_key
FROM stage_direct s LEFT JOIN m ON s.order_key = m.order_key AND s.line_no = m.line_no
  AND s.part_key = m.part_key AND s.supp_key = m.supp_key"""))
def jn_name_to_id_unique(spark, d):
    v = S.register(spark, d, ["stage_direct", "instrument_dim"])
    rows = v["stage_direct"].select(*RID, "instrument_code", "product_type", "instrument_size")
    out = R.unique_id(rows, v["instrument_dim"],
                      {"instrument_code": "instrument_code", "product_type": "product_type",
                       "instrument_size": "instrument_size"}, "instrument_key", "unique_instrument_key")
    return out.select(*RID, "unique_instrument_key")


@q("win_best_candidate", S.with_views(["stage_direct"], """
SELECT order_key, line_no, part_key, value_usd FROM (
  SELECT *, row_number() OVER (PARTITION BY order_key
      ORDER BY TRY_CAST(value_usd AS DECIMAL(38,6)) DESC NULLS LAST, line_no, part_key, supp_key) AS rn
  FROM stage_direct) WHERE rn = 1"""))
def win_best_candidate(spark, d):
    v = S.register(spark, d, ["stage_direct"])
    out = R.best_candidate(v["stage_direct"], ["order_key"],
                           [F.expr("try_cast(value_usd AS decimal(38,6))").desc_nulls_last(),
                            F.col("line_no"), F.col("part_key"), F.col("supp_key")])
    return out.select("order_key", "line_no", "part_key", "value_usd")


@q("jn_semi_dim_filter", S.with_views(["fact", "book_dim"], """
SELECT cobid, count(*) AS n, CAST(sum(value_usd) AS DOUBLE) AS value_usd FROM fact f
WHERE EXISTS (SELECT 1 FROM book_dim b WHERE b.book_key = coalesce(f.book_key, -1)
              AND upper(trim(b.entity_code)) = 'NATION_3')
GROUP BY cobid"""))
def jn_semi_dim_filter(spark, d):
    v = S.register(spark, d, ["fact", "book_dim"])
    f = dim_semi_filter(v["fact"], v["book_dim"], "book_key", {"entity_code": "nation_3", "department_code": None})
    return f.groupBy("cobid").agg(F.count(F.lit(1)).alias("n"), F.sum("value_usd").cast("double").alias("value_usd"))


@q("jn_in_subquery_filter", S.with_views(["fact", "instrument_dim"], """
SELECT cobid, count(*) AS n FROM fact
WHERE instrument_key IN (SELECT instrument_key FROM instrument_dim WHERE product_type IS NOT DISTINCT FROM 'SMALL')
GROUP BY cobid"""))
def jn_in_subquery_filter(spark, d):
    v = S.register(spark, d, ["fact", "instrument_dim"])
    f = in_subquery_filter(v["fact"], v["instrument_dim"], "instrument_key", "product_type", "SMALL")
    return f.groupBy("cobid").agg(F.count(F.lit(1)).alias("n"))


@q("agg_ambiguous_codes", S.with_views(["instrument_dim"], """
SELECT upper(trim(instrument_code)) AS code, count(DISTINCT instrument_key) AS key_count
FROM instrument_dim GROUP BY 1 HAVING count(DISTINCT instrument_key) > 1"""))
def agg_ambiguous_codes(spark, d):
    v = S.register(spark, d, ["instrument_dim"])
    return R.ambiguous_codes(v["instrument_dim"], "instrument_code", "instrument_key")


@q("agg_distinct_codes", S.with_views(["stage_direct"], """
SELECT DISTINCT upper(trim(entity_code)) AS code FROM stage_direct WHERE entity_code IS NOT NULL"""))
def agg_distinct_codes(spark, d):
    v = S.register(spark, d, ["stage_direct"])
    return R.distinct_codes(v["stage_direct"], "entity_code")


@q("agg_ticker_isin", S.with_views(["instrument_dim"], """
SELECT instrument_code AS ticker, max(instrument_name) AS isin FROM instrument_dim GROUP BY instrument_code"""))
def agg_ticker_isin(spark, d):
    v = S.register(spark, d, ["instrument_dim"])
    return v["instrument_dim"].groupBy(F.col("instrument_code").alias("ticker")).agg(F.max("instrument_name").alias("isin"))
