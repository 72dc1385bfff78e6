"""Registered queries: upload/direct path — payloads, extraction, unpivot, cleaning,
enrichment, direct and upload deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from restate.functions.keys import row_key
from restate.functions.text import blank_to_null, coerce_date, compose_reason, normalise_ws
from restate.operators import delta as D
from restate.operators import resolve as R
from restate.operators import shape as SH
from restate.queries import standin as S
from restate.queries.common import Query
from restate.spec import VAR_COMPONENTS

QUERIES: list[Query] = []


def q(name, sql=None):
    def deco(fn):
        QUERIES.append(Query(name, fn, sql))
        return fn
    return deco


RID = ["order_key", "line_no", "part_key", "supp_key"]
RIDS = ", ".join(RID)
MEASURES = {"l_quantity": "QUANTITY", "l_extendedprice": "EXTENDED PRICE", "l_discount": "DISCOUNT", "l_tax": "TAX"}


@q("src_json_payload", S.with_views(["stage_direct"], f"""
SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY {RIDS}) AS row_num, {RIDS},
       upper(entity_code) AS entity_code, value_usd
FROM stage_direct"""))
def src_json_payload(spark, d):
    v = S.register(spark, d, ["stage_direct"])
    st = SH.row_numbers(v["stage_direct"], ["batch_id"], RID)
    p = SH.to_payload(st, ["batch_id", "row_num", *RID], ["entity_code", "book_code", "value_usd", "currency_code"])
    back = SH.extract(p, "payload", {"entity_code": "string", "value_usd": "string"}, keep=["batch_id", "row_num", *RID])
    return back.withColumn("entity_code", F.upper("entity_code"))


@q("src_json_extract", S.with_views(["events"], """
SELECT event_id, CAST(TRY_CAST(json_extract_string(props, '$.k') AS DECIMAL(38,10)) AS DOUBLE) AS k,
       CAST(TRY_CAST(json_extract_string(props, '$.missing') AS DECIMAL(38,10)) AS DOUBLE) AS missing
FROM events"""))
def src_json_extract(spark, d):
    v = S.register(spark, d, ["events"])
    out = SH.extract(v["events"], "props", {"k": "decimal(38,10)", "missing": "decimal(38,10)"}, keep=["event_id"])
    return out.select("event_id", F.col("k").cast("double").alias("k"), F.col("missing").cast("double").alias("missing"))


_UNPIVOT_SQL = S.with_views(["fact"], "\nUNION ALL\n".join(
    f"SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key, l_suppkey AS supp_key, "
    f"'{label}' AS measure, {col} AS value FROM lineitem WHERE {col} IS NOT NULL AND {col} <> 0"
    for col, label in MEASURES.items()))


def _li(spark, d):
    v = S.register(spark, d, ["lineitem"])
    return v["lineitem"].select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
                                F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
                                *MEASURES.keys())


@q("shp_unpivot_measures", _UNPIVOT_SQL)
def shp_unpivot_measures(spark, d):
    return SH.unpivot_measures(_li(spark, d), RID, list(MEASURES), labels=MEASURES)


@q("set_union_measures", _UNPIVOT_SQL)
def set_union_measures(spark, d):
    out = SH.unpivot_by_union(_li(spark, d), RID, list(MEASURES))
    m = F.create_map(*[x for k, v in MEASURES.items() for x in (F.lit(k), F.lit(v))])
    return out.withColumn("measure", m[F.col("measure")])


_COMP_CASE = "CASE p.p_size % 21 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(VAR_COMPONENTS)) + " END"


@q("shp_tenday_label", S.with_views(["lineitem"], f"""
WITH x AS (SELECT l.l_orderkey AS order_key, l.l_linenumber AS line_no, l.l_partkey AS part_key,
                  l.l_suppkey AS supp_key, {_COMP_CASE} AS component,
                  CASE WHEN l.l_linestatus = 'F' THEN 'Y' ELSE 'N' END AS tenday
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
SELECT *, CASE WHEN tenday = 'Y' THEN
            CASE WHEN component = 'INFLATION_RATE_CURVE_VAR' THEN 'Inflation VaR (10 Day)'
                 WHEN component = 'EQUITY_PRICE_VAR' THEN 'Equity Price (10 Day)'
                 WHEN component = 'PAR_CREDIT_SPREAD_VAR' THEN 'Par Credit Spread VAR (10 Day)'
                 ELSE upper(replace(component, '_', ' ')) || ' (10 Day)' END
          ELSE upper(replace(component, '_', ' ')) END AS component_label
FROM x"""))
def shp_tenday_label(spark, d):
    v = S.register(spark, d, ["lineitem", "part"])
    comp = F.element_at(F.array(*[F.lit(c) for c in VAR_COMPONENTS]), (F.col("p_size") % 21 + 1).cast("int"))
    x = v["lineitem"].join(v["part"], F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"), comp.alias("component"),
        F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("tenday"))
    return x.withColumn("component_label", SH.tenday_label("component", "tenday"))


# Accepted upload header names (alias -> canonical column).
ACCEPTED_HEADERS = {
    "ENTITY": "entity_code", "ENTITY_CODE": "entity_code", "BOOK": "book_code", "BOOK_CODE": "book_code",
    "DEPARTMENT": "department_code", "DEPARTMENT_CODE": "department_code", "VALUE_USD": "value_usd",
    "VALUE": "value_usd", "CURRENCY": "currency_code", "CURRENCY_CODE": "currency_code",
    "ORDER_KEY": "order_key", "LINE_NO": "line_no", "PART_KEY": "part_key", "SUPP_KEY": "supp_key",
}


@q("prj_header_alias", S.with_views(["stage_direct"], f"""
SELECT {RIDS}, entity_code, book_code, value_usd FROM stage_direct"""))
def prj_header_alias(spark, d):
    v = S.register(spark, d, ["stage_direct"])
    raw = v["stage_direct"].select(*[F.col(c).alias(c.upper()) for c in RID],
                                   F.col("entity_code").alias(" Entity "), F.col("book_code").alias("book"),
                                   F.col("value_usd").alias("Value USD"), F.col("reason").alias("Comment"))
    out, unknown, missing, dups = SH.canonicalise(raw, ACCEPTED_HEADERS, required=["entity_code", "value_usd"])
    assert unknown == ["Comment"] and not missing and not dups
    return out


@q("prj_blank_to_null", S.with_views(["stage_direct"], f"""
SELECT {RIDS}, CASE WHEN lower(trim(reason)) IN ('', 'nan', 'none') THEN NULL ELSE trim(reason) END AS reason
FROM stage_direct"""))
def prj_blank_to_null(spark, d):
    v = S.register(spark, d, ["stage_direct"])
    return v["stage_direct"].select(*RID, blank_to_null("reason").alias("reason"))


_DATE_TEXT = """CASE l_returnflag WHEN 'A' THEN strftime(l_shipdate, '%d/%m/%Y')
                  WHEN 'N' THEN strftime(l_shipdate, '%Y-%m-%d')
                  ELSE 'x' || strftime(l_shipdate, '%d.%m') END"""


@q("prj_date_coerce", S.with_views(["lineitem"], f"""
WITH t AS (SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key, l_suppkey AS supp_key,
                  {_DATE_TEXT} AS date_text FROM lineitem)
SELECT *, CAST(coalesce(try_strptime(date_text, '%d/%m/%Y'), try_strptime(date_text, '%d-%m-%Y'),
                        try_strptime(date_text, '%Y-%m-%d'), try_strptime(date_text, '%d.%m.%Y'),
                        try_strptime(date_text, '%Y%m%d')) AS DATE) AS coerced_date
FROM t"""))
def prj_date_coerce(spark, d):
    li = S.register(spark, d, ["lineitem"])["lineitem"]
    txt = (F.when(F.col("l_returnflag") == "A", F.date_format("l_shipdate", "dd/MM/yyyy"))
           .when(F.col("l_returnflag") == "N", F.date_format("l_shipdate", "yyyy-MM-dd"))
           .otherwise(F.concat(F.lit("x"), F.date_format("l_shipdate", "dd.MM"))))
    t = li.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
                  F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"), txt.alias("date_text"))
    return t.withColumn("coerced_date", coerce_date("date_text"))


@q("prj_normalise_ws", S.with_views(["instrument_dim"], """
SELECT instrument_key, trim(regexp_replace(replace(replace(instrument_name, ' ', chr(9) || ' ' || chr(160)), 'a', 'a' || chr(10)),
                                           '[\\s\\x{00A0}]+', ' ', 'g')) AS instrument_name
FROM instrument_dim"""))
def prj_normalise_ws(spark, d):
    v = S.register(spark, d, ["instrument_dim"])
    messy = F.replace(F.replace(F.col("instrument_name"), F.lit(" "), F.lit("\t  ")), F.lit("a"), F.lit("a\n"))
    return v["instrument_dim"].select("instrument_key", normalise_ws(messy).alias("instrument_name"))


@q("prj_reason_compose", S.with_views(["stage_direct"], f"""
SELECT {RIDS}, substr(concat_ws(' | ', nullif(trim(currency_code), ''), reason), 1, 1000) AS full_reason
FROM stage_direct"""))
def prj_reason_compose(spark, d):
    v = S.register(spark, d, ["stage_direct"])
    return v["stage_direct"].select(*RID, compose_reason("currency_code", "reason").alias("full_reason"))


def _enrich_sql(kind: str) -> str:
    pair = "s.currency_code || '-' || coalesce(b.department_code, 'NA')" if kind == "sbm" else \
        "coalesce(b.department_code, 'NA') || '-' || s.currency_code"
    bucket = {"sbm": "CASE WHEN e.entity_key IS NULL THEN 'UNMAPPED' WHEN e.entity_key < 10 THEN 'BUCKET_A' ELSE 'BUCKET_B' END",
              "drc": "CASE WHEN upper(s.product_type) LIKE '%SMALL%' THEN 'SEC' ELSE 'NON SEC' END",
              "rrao": "CASE WHEN upper(s.product_type) IN ('PROMO', 'LARGE') THEN 'EXOTIC' ELSE 'OTHER' END"}[kind]
    return S.with_views(["stage_direct", "entity_dim", "book_dim", "instrument_dim"], f"""
SELECT s.order_key, s.line_no, s.part_key, s.supp_key, s.cobid,
       md5(s.batch_id || '-' || CAST(s.order_key AS VARCHAR) || '-' || CAST(s.line_no AS VARCHAR) || '-DIRECT') AS row_key,
       coalesce(e.entity_key, -1) AS entity_key, coalesce(b.book_key, -1) AS book_key,
       coalesce(i.k, -1) AS instrument_key, {pair} AS currency_pair, {bucket} AS risk_bucket,
       CAST(TRY_CAST(s.value_usd AS DECIMAL(38,10)) AS DOUBLE) AS amount
FROM stage_direct s
LEFT JOIN entity_dim e ON upper(trim(s.entity_code)) = upper(trim(e.entity_code))
LEFT JOIN book_dim b ON upper(trim(s.book_code)) = upper(trim(b.book_code))
LEFT JOIN (SELECT upper(trim(instrument_code)) AS c, max(instrument_key) AS k FROM instrument_dim GROUP BY 1) i
  ON upper(trim(s.instrument_code)) = i.c""")


def _enrich(spark, d, kind):
    v = S.register(spark, d, ["stage_direct", "entity_dim", "book_dim", "instrument_dim"])
    s = v["stage_direct"]
    s = R.resolve_key(s, v["entity_dim"], "entity_code", "entity_code", "entity_key", "entity_key", unknown=None)
    s = R.resolve_key(s, v["book_dim"].select("book_code", "book_key", "department_code"), "book_code", "book_code",
                      "book_key", "book_key", unknown=None)
    dept = v["book_dim"].select(F.col("book_key").alias("_bk"), F.col("department_code").alias("_bdept"))
    s = s.join(dept, F.col("book_key") == F.col("_bk"), "left")
    s = R.resolve_max(s, v["instrument_dim"], "instrument_code", "instrument_code", "instrument_key", "instrument_key")
    dep = F.coalesce(F.col("_bdept"), F.lit("NA"))
    pair = F.concat_ws("-", F.col("currency_code"), dep) if kind == "sbm" else F.concat_ws("-", dep, F.col("currency_code"))
    if kind == "sbm":
        bucket = (F.when(F.col("entity_key").isNull(), "UNMAPPED").when(F.col("entity_key") < 10, "BUCKET_A")
                  .otherwise("BUCKET_B"))
    elif kind == "drc":
        bucket = F.when(F.upper("product_type").contains("SMALL"), "SEC").otherwise("NON SEC")
    else:
        bucket = F.when(F.upper("product_type").isin("PROMO", "LARGE"), "EXOTIC").otherwise("OTHER")
    return s.select(*RID, "cobid", row_key(F.concat_ws("-", "batch_id", "order_key"), "line_no").alias("row_key"),
                    F.coalesce("entity_key", F.lit(-1)).alias("entity_key"),
                    F.coalesce("book_key", F.lit(-1)).alias("book_key"), "instrument_key",
                    pair.alias("currency_pair"), bucket.alias("risk_bucket"),
                    F.expr("try_cast(value_usd AS decimal(38,10))").cast("double").alias("amount"))


@q("prj_enrich_sbm", _enrich_sql("sbm"))
def prj_enrich_sbm(spark, d):
    return _enrich(spark, d, "sbm")


@q("prj_enrich_drc", _enrich_sql("drc"))
def prj_enrich_drc(spark, d):
    return _enrich(spark, d, "drc")


@q("prj_enrich_rrao", _enrich_sql("rrao"))
def prj_enrich_rrao(spark, d):
    return _enrich(spark, d, "rrao")


DELTA_COLS = ["cobid", "restatement_id", "entity_key", "book_key", "instrument_key", "trade_key",
              "counterparty_key", "run_log_id", "currency_code", "value_local", "value_usd"]


@q("adj_direct", S.with_views(["stage_direct", "entity_dim", "book_dim", "instrument_dim", "trade_dim"], f"""
WITH v AS (SELECT * FROM stage_direct WHERE TRY_CAST(value_usd AS DECIMAL(38,6)) IS NOT NULL
             AND TRY_CAST(value_usd AS DECIMAL(38,6)) <> 0),
 bk AS (SELECT v.order_key, v.line_no, v.part_key, v.supp_key, max(b.book_key) AS k FROM v JOIN book_dim b
          ON upper(trim(v.book_code)) = upper(trim(b.book_code))
         AND (v.entity_code IS NULL OR upper(trim(v.entity_code)) = upper(trim(b.entity_code)))
        GROUP BY 1, 2, 3, 4)
SELECT v.cobid, v.order_key * 10 + v.line_no AS restatement_id, coalesce(e.k, -1) AS entity_key,
       coalesce(bk.k, -1) AS book_key, coalesce(i.k, -1) AS instrument_key, coalesce(t.k, -1) AS trade_key,
       CAST(-1 AS BIGINT) AS counterparty_key, CAST(-1 AS BIGINT) AS run_log_id, v.currency_code,
       CAST(TRY_CAST(v.value_usd AS DECIMAL(38,6)) AS DOUBLE) AS value_local,
       CAST(TRY_CAST(v.value_usd AS DECIMAL(38,6)) AS DOUBLE) AS value_usd
FROM v
LEFT JOIN (SELECT upper(trim(entity_code)) AS c, max(entity_key) AS k FROM entity_dim GROUP BY 1) e
  ON upper(trim(v.entity_code)) = e.c
LEFT JOIN bk ON bk.order_key = v.order_key AND bk.line_no = v.line_no AND bk.part_key = v.part_key AND bk.supp_key = v.supp_key
LEFT JOIN (SELECT upper(trim(instrument_code)) AS c, max(instrument_key) AS k FROM instrument_dim GROUP BY 1) i
  ON upper(trim(v.instrument_code)) = i.c
LEFT JOIN (SELECT upper(trim(trade_code)) AS c, max(trade_key) AS k FROM trade_dim GROUP BY 1) t
  ON upper(trim(v.trade_code)) = t.c"""))
def adj_direct(spark, d):
    v = S.register(spark, d, ["stage_direct", "entity_dim", "book_dim", "instrument_dim", "trade_dim"])
    val = F.expr("try_cast(value_usd AS decimal(38,6))")
    s = v["stage_direct"].withColumn("_val", val).where(F.col("_val").isNotNull() & (F.col("_val") != 0))
    s = R.resolve_max(s, v["entity_dim"], "entity_code", "entity_code", "entity_key", "entity_key")
    s = R.resolve_qualified(s, v["book_dim"], "book_code", "book_code", "book_key",
                            {"entity_code": "entity_code"}, "book_key")
    s = D.share_repeated(s, RID, ["book_key"])  # staged rows that share their four keys are one upload row
    s = R.resolve_max(s, v["instrument_dim"], "instrument_code", "instrument_code", "instrument_key", "instrument_key")
    s = R.resolve_max(s, v["trade_dim"], "trade_code", "trade_code", "trade_key", "trade_key")
    s = s.withColumn("restatement_id", F.col("order_key") * 10 + F.col("line_no")) \
        .withColumn("value_local", F.col("_val").cast("double")).withColumn("value_usd", F.col("_val").cast("double"))
    return D.align(s, DELTA_COLS, types={"counterparty_key": "bigint", "run_log_id": "bigint"})


_UPLOAD_SQL = S.with_views(["fact", "book_dim"], """
WITH lines AS (SELECT f.cobid, f.trade_key, f.line_no, f.instrument_key, b.book_code, f.currency_code,
                      f.value_local, f.value_usd FROM fact f LEFT JOIN book_dim b ON f.book_key = b.book_key),
 long AS (SELECT cobid, trade_key, line_no, instrument_key, book_code, 'LOCAL' AS measure, value_local AS value FROM lines
          WHERE value_local IS NOT NULL AND value_local <> 0
          UNION ALL
          SELECT cobid, trade_key, line_no, instrument_key, book_code, 'USD', value_usd FROM lines
          WHERE value_usd IS NOT NULL AND value_usd <> 0)
SELECT l.cobid, l.trade_key, l.line_no, l.instrument_key, coalesce(b.book_key, -1) AS book_key,
       CAST(-1 AS BIGINT) AS counterparty_key, l.measure, CAST(l.value AS DOUBLE) AS value
FROM long l LEFT JOIN book_dim b ON upper(trim(l.book_code)) = upper(trim(b.book_code))""")


@q("adj_upload", _UPLOAD_SQL)
def adj_upload(spark, d):
    """payload -> typed extract -> unpivot -> resolve codes -> defaults."""
    v = S.register(spark, d, ["fact", "book_dim"])
    lines = v["fact"].join(v["book_dim"].select("book_key", "book_code"), "book_key", "left")
    payload = SH.to_payload(lines, ["cobid", "trade_key", "line_no", "instrument_key"],
                            ["book_code", "currency_code", "value_local", "value_usd"])
    typed = SH.extract(payload, "payload", {"book_code": "string", "value_local": "decimal(18,2)",
                                            "value_usd": "decimal(18,2)"},
                       keep=["cobid", "trade_key", "line_no", "instrument_key"])
    long = SH.unpivot_measures(typed, ["cobid", "trade_key", "line_no", "instrument_key", "book_code"],
                               ["value_local", "value_usd"], labels={"value_local": "LOCAL", "value_usd": "USD"})
    res = R.resolve_key(long, v["book_dim"], "book_code", "book_code", "book_key", "book_key")
    out = D.align(res, ["cobid", "trade_key", "line_no", "instrument_key", "book_key", "counterparty_key", "measure", "value"],
                  types={"counterparty_key": "bigint", "value": "double"})
    return out


@q("agg_upload_header", S.with_views(["stage_direct"], """
SELECT batch_id, CAST(sum(TRY_CAST(value_usd AS DECIMAL(38,6))) AS DOUBLE) AS restatement_value_in_usd,
       count_if(TRY_CAST(value_usd AS DECIMAL(38,6)) IS NOT NULL AND TRY_CAST(value_usd AS DECIMAL(38,6)) <> 0) AS active_rows,
       max(split_part(entity_code, '_', 1)) AS file_id
FROM stage_direct GROUP BY batch_id"""))
def agg_upload_header(spark, d):
    v = S.register(spark, d, ["stage_direct"])
    val = F.expr("try_cast(value_usd AS decimal(38,6))")
    return v["stage_direct"].groupBy("batch_id").agg(
        F.sum(val).cast("double").alias("restatement_value_in_usd"),
        F.count_if(val.isNotNull() & (val != 0)).alias("active_rows"),
        F.max(F.split_part(F.col("entity_code"), F.lit("_"), F.lit(1))).alias("file_id"))


FEED = """
SELECT event_id, 'F' || strftime(ts, '%Y%m%d') AS file_name,
       CASE WHEN event_type = 'error' AND user_id < 5 AND value > 90 THEN NULL ELSE CAST(strftime(ts, '%Y%m%d') AS INT) END AS cobid,
       user_id, value FROM events"""
FEED_SPARK = """
SELECT event_id, 'F' || date_format(ts, 'yyyyMMdd') AS file_name,
       CASE WHEN event_type = 'error' AND user_id < 5 AND value > 90 THEN NULL ELSE CAST(date_format(ts, 'yyyyMMdd') AS INT) END AS cobid,
       user_id, value FROM events"""


@q("src_feed_exclude_bad_files", S.with_views(["events"], f"""
WITH feed AS ({FEED})
SELECT * FROM feed f WHERE NOT EXISTS (SELECT 1 FROM feed b WHERE b.cobid IS NULL AND b.file_name = f.file_name)"""))
def src_feed_exclude_bad_files(spark, d):
    S.register(spark, d, ["events"])
    feed = spark.sql(FEED_SPARK)
    bad = feed.where(F.col("cobid").isNull()).select(F.col("file_name").alias("_bad")).distinct()
    return feed.join(bad, F.col("file_name") == F.col("_bad"), "left_anti")


@q("snk_payload_copy", S.with_views(["stage_direct"], f"""
SELECT batch_id || '-COPY' AS batch_id, {RIDS}, value_usd FROM stage_direct WHERE batch_id = 'B1997'"""))
def snk_payload_copy(spark, d):
    v = S.register(spark, d, ["stage_direct"])
    items = v["stage_direct"].select("batch_id", *RID, "value_usd")
    return D.clone_items(items, "batch_id", "B1997", "B1997-COPY")
