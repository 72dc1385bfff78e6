"""Stand-in data model over the driver's TPC-H-like tables.

The restatement domain has facts (positions by COB), dimensions (book, entity,
instrument, trade) and request headers.  The driver's tables are mapped onto it:

  fact            lineitem: cobid = first day of the ship month (int yyyymmdd),
                  position = (cobid, trade_key=l_orderkey, line_no, book_key=l_suppkey,
                  instrument_key=l_partkey, source_system_code=l_returnflag,
                  currency_code=l_linestatus); metrics value_local=l_quantity,
                  value_usd=l_extendedprice (decimal(18,2))
  book_dim        supplier + nation + region: book_code, entity_code, department_code
  instrument_dim  part: instrument_code=p_brand, product_type=p_type
  trade_dim       orders: strategy=o_orderpriority, trade_typology=o_orderstatus
  hdr_inline      a fixed list of requests (literal VALUES)
  hdr_orders      one request per order (type from priority, filters from status)

Every view is plain SQL accepted by both Spark and DuckDB, so the Spark queries
and the DuckDB oracle read *identical* inputs; the operators themselves are the
library's DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

POSITION_COLS = ("cobid", "trade_key", "line_no", "book_key", "instrument_key", "source_system_code", "currency_code")
METRICS = ("value_local", "value_usd")
USD = "value_usd"
# header filter column -> fact attribute column
FILTER_MAP = {
    "entity_code": "entity_code",
    "department_code": "department_code",
    "book_code": "book_code",
    "instrument_code": "instrument_code",
    "product_type": "product_type",
    "strategy": "strategy",
    "trade_typology": "trade_typology",
    "source_system_code": "source_system_code",
    "currency_code": "currency_code",
}
FILTER_COLS = tuple(FILTER_MAP)

COB_EXPR = "CAST(year({c}) * 10000 + month({c}) * 100 + 1 AS INT)"

VIEWS: dict[str, str] = {}

VIEWS["fact"] = f"""
SELECT {COB_EXPR.format(c='l_shipdate')} AS cobid,
       l_orderkey AS trade_key, l_linenumber AS line_no, l_suppkey AS book_key,
       l_partkey AS instrument_key, l_returnflag AS source_system_code,
       l_linestatus AS currency_code,
       CAST(l_quantity AS DECIMAL(18,2)) AS value_local,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS value_usd
FROM lineitem"""

VIEWS["book_dim"] = """
SELECT s.s_suppkey AS book_key, s.s_name AS book_code, CAST(s.s_nationkey AS BIGINT) AS entity_key,
       n.n_name AS entity_code, r.r_name AS department_code, s.s_acctbal AS book_limit
FROM supplier s
LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""

VIEWS["entity_dim"] = """
SELECT CAST(n.n_nationkey AS BIGINT) AS entity_key, n.n_name AS entity_code, r.r_name AS department_code
FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""

VIEWS["instrument_dim"] = """
SELECT p_partkey AS instrument_key, p_brand AS instrument_code, p_type AS product_type,
       p_name AS instrument_name, p_size AS instrument_size
FROM part"""

VIEWS["trade_dim"] = f"""
SELECT o_orderkey AS trade_key, CAST(o_orderkey AS STRING) AS trade_code, o_custkey AS counterparty_key,
       o_orderpriority AS strategy, o_orderstatus AS trade_typology,
       {COB_EXPR.format(c='o_orderdate')} AS trade_cobid
FROM orders"""

# Literal request list: overlapping wildcards, mixed case, same- and cross-COB.
VIEWS["hdr_inline"] = """
SELECT CAST(adj_key AS STRING) AS adj_key, CAST(restatement_id AS BIGINT) AS restatement_id,
       CAST(cobid AS INT) AS cobid, CAST(source_cobid AS INT) AS source_cobid,
       CAST(restatement_type AS STRING) AS restatement_type,
       CAST(scale_factor AS DECIMAL(10,4)) AS scale_factor,
       CAST(created_date AS TIMESTAMP) AS created_date,
       CAST(entity_code AS STRING) AS entity_code, CAST(department_code AS STRING) AS department_code,
       CAST(book_code AS STRING) AS book_code, CAST(instrument_code AS STRING) AS instrument_code,
       CAST(product_type AS STRING) AS product_type, CAST(strategy AS STRING) AS strategy,
       CAST(trade_typology AS STRING) AS trade_typology,
       CAST(source_system_code AS STRING) AS source_system_code,
       CAST(currency_code AS STRING) AS currency_code,
       CAST(process_type AS STRING) AS process_type, CAST(username AS STRING) AS username
FROM (VALUES
 ('ADJ-01', 1, 19970301, 19970301, 'Flatten', 1.0, '2026-01-05 09:00:00', 'NATION_3', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'VaR', 'amy'),
 ('ADJ-02', 2, 19970301, 19970301, 'Scale', 1.10, '2026-01-05 10:00:00', NULL, 'EUROPE', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'VaR', 'bob'),
 ('ADJ-03', 3, 19970301, 19970301, 'Scale', 0.5, '2026-01-05 10:00:00', NULL, NULL, NULL, 'Brand#7', 'SMALL', NULL, NULL, NULL, NULL, 'VaR', 'amy'),
 ('ADJ-04', 4, 19970301, 19970201, 'Roll', 1.0, '2026-01-05 11:00:00', 'NATION_5', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'VaR', 'cy'),
 ('ADJ-05', 5, 19970401, 19970301, 'Roll', 2.0, '2026-01-05 12:00:00', 'nation_3', NULL, NULL, NULL, NULL, NULL, NULL, 'R', NULL, 'VaR', 'bob'),
 ('ADJ-06', 6, 19970401, 19970401, 'Scale', 1.0, '2026-01-05 12:30:00', 'NATION_7', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Stress', 'dee'),
 ('ADJ-07', 7, 19980601, 19980601, 'Flatten', 1.0, '2026-01-06 09:00:00', NULL, NULL, 'Supplier#000000012', NULL, NULL, '1-URGENT', NULL, NULL, NULL, 'Stress', 'amy'),
 ('ADJ-08', 8, 19980601, 19980601, 'Scale', 3.0, '2026-01-06 09:30:00', 'nation_12', NULL, NULL, NULL, NULL, NULL, 'F', NULL, 'f', 'Stress', 'eve'),
 ('ADJ-09', 9, 19970301, 19970301, 'Flatten', 1.0, '2026-01-04 08:00:00', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'A', NULL, 'VaR', 'eve'),
 ('ADJ-10', 10, 20010101, 20010101, 'Scale', 1.25, '2026-01-07 08:00:00', NULL, 'ASIA', NULL, NULL, 'PROMO', NULL, NULL, NULL, NULL, 'Sensitivity', 'bob'),
 ('ADJ-11', 11, 19980601, 19980501, 'Roll', 0.5, '2026-01-06 09:30:00', 'NATION_12', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Stress', 'cy'),
 ('ADJ-12', 12, 19990101, 19990101, 'Scale', 1.0, '2026-01-08 08:00:00', 'NATION_99', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'VaR', 'dee'),
 ('ADJ-13', 13, 19970301, 19970301, 'Scale', 1.2, '2026-01-05 11:30:00', 'NATION_5', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'VaR', 'amy')
) AS t(adj_key, restatement_id, cobid, source_cobid, restatement_type, scale_factor, created_date,
       entity_code, department_code, book_code, instrument_code, product_type, strategy,
       trade_typology, source_system_code, currency_code, process_type, username)"""

# Requests already applied earlier (their deltas form the existing delta table).
VIEWS["hdr_prior"] = """
SELECT CAST(adj_key AS STRING) AS adj_key, CAST(restatement_id AS BIGINT) AS restatement_id,
       CAST(cobid AS INT) AS cobid, CAST(source_cobid AS INT) AS source_cobid,
       CAST(restatement_type AS STRING) AS restatement_type,
       CAST(scale_factor AS DECIMAL(10,4)) AS scale_factor,
       CAST(created_date AS TIMESTAMP) AS created_date,
       CAST(entity_code AS STRING) AS entity_code, CAST(department_code AS STRING) AS department_code,
       CAST(book_code AS STRING) AS book_code, CAST(instrument_code AS STRING) AS instrument_code,
       CAST(product_type AS STRING) AS product_type, CAST(strategy AS STRING) AS strategy,
       CAST(trade_typology AS STRING) AS trade_typology,
       CAST(source_system_code AS STRING) AS source_system_code,
       CAST(currency_code AS STRING) AS currency_code,
       CAST(process_type AS STRING) AS process_type, CAST(username AS STRING) AS username
FROM (VALUES
 ('PRI-01', 901, 19970201, 19970201, 'Scale', 2.0, '2025-12-01 09:00:00', 'NATION_5', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'VaR', 'amy'),
 ('PRI-02', 902, 19970301, 19970301, 'Scale', 1.5, '2025-12-01 10:00:00', NULL, NULL, NULL, NULL, 'LARGE', NULL, NULL, NULL, NULL, 'VaR', 'bob'),
 ('PRI-03', 903, 19970301, 19970301, 'Flatten', 1.0, '2025-12-02 10:00:00', 'NATION_3', NULL, NULL, NULL, NULL, NULL, NULL, 'N', NULL, 'VaR', 'cy'),
 ('PRI-04', 904, 19980501, 19980501, 'Scale', 0.2, '2025-12-03 10:00:00', 'NATION_12', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Stress', 'dee')
) AS t(adj_key, restatement_id, cobid, source_cobid, restatement_type, scale_factor, created_date,
       entity_code, department_code, book_code, instrument_code, product_type, strategy,
       trade_typology, source_system_code, currency_code, process_type, username)"""

# One request per order: type from priority, filter signature from status.
VIEWS["hdr_orders"] = f"""
SELECT 'ORD-' || CAST(o.o_orderkey AS STRING) AS adj_key,
       o.o_orderkey + 1000 AS restatement_id,
       {COB_EXPR.format(c='o.o_orderdate')} AS cobid,
       CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED'
            THEN CAST(year(o.o_orderdate - INTERVAL '1' MONTH) * 10000 + month(o.o_orderdate - INTERVAL '1' MONTH) * 100 + 1 AS INT)
            ELSE {COB_EXPR.format(c='o.o_orderdate')} END AS source_cobid,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Flatten' WHEN '4-NOT SPECIFIED' THEN 'Roll' ELSE 'Scale' END AS restatement_type,
       CAST(CASE o.o_orderpriority WHEN '2-HIGH' THEN 1.1 WHEN '3-MEDIUM' THEN 0.95 WHEN '5-LOW' THEN 1.05 ELSE 1.0 END AS DECIMAL(10,4)) AS scale_factor,
       o.o_orderdate + (CAST(o.o_custkey AS INT) * INTERVAL '1' SECOND) AS created_date,
       CASE WHEN o.o_orderstatus IN ('F', 'P') THEN n.n_name END AS entity_code,
       CASE WHEN o.o_orderstatus = 'O' THEN r.r_name END AS department_code,
       CAST(NULL AS STRING) AS book_code,
       CAST(NULL AS STRING) AS instrument_code,
       CAST(NULL AS STRING) AS product_type,
       CAST(NULL AS STRING) AS strategy,
       CAST(NULL AS STRING) AS trade_typology,
       CASE WHEN o.o_orderstatus = 'P' THEN 'R' END AS source_system_code,
       CASE WHEN o.o_orderstatus = 'O' THEN 'O' END AS currency_code,
       c.c_mktsegment AS process_type,
       c.c_name AS username
FROM orders o
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""

VIEWS["fact_attr"] = """
SELECT f.*, b.entity_code, b.department_code, b.book_code, i.instrument_code, i.product_type,
       t.strategy, t.trade_typology
FROM fact f
LEFT JOIN book_dim b ON coalesce(f.book_key, -1) = b.book_key
LEFT JOIN instrument_dim i ON coalesce(f.instrument_key, -1) = i.instrument_key
LEFT JOIN trade_dim t ON coalesce(f.trade_key, -1) = t.trade_key"""

# Uploaded/staged rows (all text), one per lineitem, with injected case variants,
# unknown codes, missing books, blanks and non-numeric / zero values.
VIEWS["stage_direct"] = f"""
SELECT 'B' || CAST(year(l.l_shipdate) AS STRING) AS batch_id,
       l.l_orderkey AS order_key, l.l_linenumber AS line_no, l.l_partkey AS part_key, l.l_suppkey AS supp_key,
       {COB_EXPR.format(c='l.l_shipdate')} AS cobid,
       CASE WHEN l.l_returnflag = 'A' THEN lower(n.n_name)
            WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'O' THEN n.n_name || '_X'
            WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' AND l.l_quantity < 10
                 THEN 'NATION_' || CAST((s.s_nationkey + 1) % 25 AS STRING)
            ELSE n.n_name END AS entity_code,
       r.r_name AS department_code,
       CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN NULL ELSE s.s_name END AS book_code,
       CASE WHEN l.l_returnflag = 'A' AND l.l_linestatus = 'O' THEN NULL ELSE p.p_brand END AS instrument_code,
       p.p_type AS product_type, p.p_size AS instrument_size,
       CAST(l.l_orderkey AS STRING) AS trade_code,
       CASE WHEN l.l_discount = 0 THEN 'abc' WHEN l.l_tax = 0 THEN '0'
            ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS STRING) END AS value_usd,
       l.l_linestatus AS currency_code,
       CASE WHEN l.l_quantity > 45 THEN '  ' WHEN l.l_quantity < 3 THEN 'None'
            ELSE 'reason ' || l.l_returnflag END AS reason
FROM lineitem l
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN part p ON l.l_partkey = p.p_partkey"""

# SCD2 customer versions: one version per order, [order date, next order date).
VIEWS["cust_versions"] = """
SELECT o_custkey AS customer_key, o_orderkey AS version_key, o_orderdate AS effective_start,
       lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS effective_end
FROM orders"""

# Request queue: the order-derived requests with lifecycle state.
VIEWS["hdr_queue"] = """
SELECT h.*,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Running' WHEN '2-HIGH' THEN 'Pending'
            WHEN '3-MEDIUM' THEN 'Approved' WHEN '4-NOT SPECIFIED' THEN 'Processed'
            ELSE CASE WHEN o.o_orderstatus = 'P' THEN 'Failed' ELSE 'Pending Approval' END END AS run_status,
       h.created_date + (CAST(o.o_custkey % 500 AS INT) * INTERVAL '1' MINUTE) AS start_date,
       CASE WHEN o.o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')
            THEN h.created_date + (CAST(o.o_custkey % 500 AS INT) * INTERVAL '1' MINUTE)
                 + (CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 7200 AS INT) * INTERVAL '1' SECOND) END AS process_date,
       (o.o_orderstatus = 'P' AND o.o_orderpriority = '3-MEDIUM') AS is_deleted,
       CASE WHEN o.o_orderpriority = '2-HIGH' AND o.o_orderstatus = 'F'
            THEN 'ORD-' || CAST(o.o_orderkey - 1 AS STRING) END AS blocked_by_adj_id,
       CAST(o.o_totalprice AS DECIMAL(20,6)) AS restatement_value_in_usd
FROM hdr_orders h JOIN orders o ON h.restatement_id - 1000 = o.o_orderkey"""

# Sign-off state per (COB, scope, entity, sub-type) plus whole-scope '*' rows.
VIEWS["signoff_status"] = f"""
SELECT DISTINCT {COB_EXPR.format(c='o.o_orderdate')} AS cobid, c.c_mktsegment AS process_type,
       n.n_name AS entity_code, CASE WHEN o.o_orderstatus = 'F' THEN 'NonCVA' ELSE 'CVA' END AS sub_type,
       CASE (month(o.o_orderdate) + n.n_nationkey + CASE WHEN o.o_orderstatus = 'F' THEN 0 ELSE 1 END) % 5
            WHEN 0 THEN 'SIGNED_OFF' WHEN 1 THEN 'REOPENED' WHEN 3 THEN 'SIGNOFF_REQUESTED' ELSE 'OPEN' END
         AS sign_off_status
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
UNION ALL
SELECT DISTINCT {COB_EXPR.format(c='o.o_orderdate')}, c.c_mktsegment, '*', 'ALL',
       CASE WHEN month(o.o_orderdate) IN (3, 6, 9, 12) THEN 'SIGNED_OFF'
            WHEN month(o.o_orderdate) = 1 THEN 'REOPENED' ELSE 'OPEN' END
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""

# Upstream publish feed: one row per (COB, scope, entity).
VIEWS["signoff_feed"] = f"""
SELECT {COB_EXPR.format(c='o.o_orderdate')} AS cobid, c.c_mktsegment AS process_type, n.n_name AS entity_code,
       CASE WHEN (month(min(o.o_orderdate)) + min(n.n_nationkey)) % 3 = 0 THEN 'SIGNEDOFF' ELSE 'OPEN' END AS publish_status,
       max(o.o_orderdate) + INTERVAL '20' DAY AS signoff_update_time
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY 1, 2, 3"""

# Approvers: the three best-funded customers of each market segment approve its requests.
VIEWS["approvers"] = """
SELECT approver, process_type, is_active FROM (
  SELECT c_name AS approver, c_mktsegment AS process_type, (c_acctbal > 0) AS is_active,
         row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rk
  FROM customer) t WHERE rk <= 3"""

# Decisions: each order's request is decided by the best-funded customer of the
# next order's market segment (the submitter's own segment when they coincide).
VIEWS["decisions"] = """
SELECT 'ORD-' || CAST(o.o_orderkey AS STRING) AS adj_key, a.approver,
       CASE WHEN o.o_totalprice > 250000 THEN 'Reject' ELSE 'Approve' END AS decision
FROM orders o JOIN orders o2 ON o2.o_orderkey = o.o_orderkey + 1 JOIN customer c2 ON c2.c_custkey = o2.o_custkey
JOIN (SELECT c_name AS approver, c_mktsegment,
             row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rk
      FROM customer) a ON a.c_mktsegment = c2.c_mktsegment AND a.rk = 1"""

# Status history: each user's events are the transitions of one request.
VIEWS["status_history"] = """
SELECT 'USR-' || CAST(user_id AS STRING) AS adj_key, event_id,
       lag(CASE event_type WHEN 'signup' THEN 'Pending' WHEN 'view' THEN 'Pending Approval'
                WHEN 'click' THEN 'Approved' WHEN 'purchase' THEN 'Processed' ELSE 'Failed' END)
         OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_status,
       CASE event_type WHEN 'signup' THEN 'Pending' WHEN 'view' THEN 'Pending Approval'
            WHEN 'click' THEN 'Approved' WHEN 'purchase' THEN 'Processed' ELSE 'Failed' END AS new_status,
       'u' || CAST(CAST(floor(value) AS BIGINT) % 9 AS STRING) AS changed_by, ts AS changed_at, value
FROM events"""

# Entity-roll requests (distinct target slices).
VIEWS["rolls_inline"] = """
SELECT CAST(adj_key AS STRING) AS adj_key, CAST(restatement_id AS BIGINT) AS restatement_id,
       CAST(cobid AS INT) AS cobid, CAST(source_cobid AS INT) AS source_cobid,
       CAST(entity_code AS STRING) AS entity_code, CAST(created_date AS TIMESTAMP) AS created_date
FROM (VALUES
 ('EROL-1', 501, 19970301, 19970201, 'NATION_3', '2026-01-09 08:00:00'),
 ('EROL-2', 502, 19980601, 19980501, 'NATION_12', '2026-01-09 09:00:00'),
 ('EROL-3', 503, 19970401, 19970301, 'nation_5', '2026-01-09 10:00:00')
) AS t(adj_key, restatement_id, cobid, source_cobid, entity_code, created_date)"""

# Every roll slice that the orders ask for: one row per target COB, source COB and entity.
VIEWS["rolls_orders"] = """
SELECT 'SLICE-' || CAST(cobid AS STRING) || '-' || CAST(source_cobid AS STRING) || '-' || upper(entity_code) AS adj_key,
       cobid, source_cobid, 'Roll' AS restatement_type, max(scale_factor) AS scale_factor, upper(entity_code) AS entity_code
FROM hdr_orders WHERE restatement_type = 'Roll' AND entity_code IS NOT NULL
GROUP BY cobid, source_cobid, upper(entity_code)"""

# The same slices as entity-roll requests; the id tells date and entity.
VIEWS["erolls_orders"] = """
SELECT adj_key, CAST(cobid AS BIGINT) * 100 + CAST(replace(entity_code, 'NATION_', '') AS BIGINT) AS restatement_id, cobid, source_cobid, entity_code,
       CAST('2026-01-09 08:00:00' AS TIMESTAMP) AS created_date
FROM rolls_orders"""

# Steps of the older job: for every department and business date of its facts a scaled, summed copy a year later,
# of one currency for every other department.
VIEWS["steps_all"] = """
SELECT 'STEP-' || CAST(f.cobid AS STRING) || '-' || b.department_code AS adj_key, f.cobid AS source_cobid, f.cobid + 10000 AS target_cobid,
       CAST(CASE WHEN b.department_code < 'B' THEN -0.5 ELSE 0.25 END AS DECIMAL(12,4)) AS scale_factor, b.department_code AS department_code,
       CASE WHEN b.department_code < 'C' THEN 'F' END AS currency_code, CAST(NULL AS STRING) AS book_code
FROM fact f JOIN book_dim b ON f.book_key = b.book_key WHERE b.department_code IS NOT NULL
GROUP BY f.cobid, b.department_code"""

# Requests to take back what earlier requests wrote, each under a new id.
VIEWS["reversals"] = """
SELECT restatement_id AS old_id, 9000 + restatement_id AS new_id FROM hdr_prior
UNION ALL SELECT restatement_id, 9000 + restatement_id FROM hdr_inline WHERE username IN ('amy', 'cy')"""

# Requests of every type for line items: the fixed list and every roll slice of the orders.
VIEWS["hdr_items"] = """
SELECT adj_key, cobid, source_cobid, restatement_type, scale_factor, entity_code, department_code, book_code,
       instrument_code, product_type, strategy, trade_typology, source_system_code, currency_code FROM hdr_inline
UNION ALL
SELECT adj_key, cobid, source_cobid, restatement_type, scale_factor, entity_code, CAST(NULL AS STRING), CAST(NULL AS STRING),
       CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
       CAST(NULL AS STRING) FROM rolls_orders"""

# Two images of a keyed feed (events): the old image and a re-sent new image in
# which 'view' rows vanished and 'click' values changed; plus the change batch
# (old overlapping rows as DELETE, new rows as INSERT).
VIEWS["cdc_old"] = """
SELECT event_id, user_id, event_type, value, 'F' || CAST(CAST(ts AS DATE) AS STRING) AS file_name, ts
FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00'"""

VIEWS["cdc_new"] = """
SELECT event_id, user_id, event_type,
       CASE WHEN event_type = 'click' THEN value + 1 ELSE value END AS value,
       'F' || CAST(CAST(ts AS DATE) AS STRING) AS file_name, ts
FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND event_type <> 'view'"""

VIEWS["cdc_batch"] = """
SELECT event_id, user_id, event_type, value, 'DELETE' AS action FROM cdc_old WHERE ts >= TIMESTAMP '2024-01-10 00:00:00'
UNION ALL
SELECT event_id, user_id, event_type, value, 'INSERT' AS action FROM cdc_new"""

# The request table one lifecycle step later (for status-change logs).
VIEWS["hdr_queue_next"] = """
SELECT adj_key, CASE run_status WHEN 'Approved' THEN 'Running' WHEN 'Running' THEN 'Processed'
                  WHEN 'Pending Approval' THEN CASE WHEN restatement_type = 'Flatten' THEN 'Approved' ELSE run_status END
                  ELSE run_status END AS run_status,
       created_date + INTERVAL '1' HOUR AS changed_at, username
FROM hdr_queue"""

DEPENDS = {
    "cdc_old": ("events",),
    "cdc_new": ("events",),
    "cdc_batch": ("cdc_old", "cdc_new"),
    "hdr_queue_next": ("hdr_queue",),
    "signoff_status": ("orders", "customer", "nation"),
    "signoff_feed": ("orders", "customer", "nation"),
    "approvers": ("customer",),
    "decisions": ("orders", "customer"),
    "status_history": ("events",),
    "hdr_queue": ("hdr_orders", "orders"),
    "stage_direct": ("lineitem", "supplier", "nation", "region", "part"),
    "cust_versions": ("orders",),
    "fact": ("lineitem",),
    "book_dim": ("supplier", "nation", "region"),
    "entity_dim": ("nation", "region"),
    "instrument_dim": ("part",),
    "trade_dim": ("orders",),
    "hdr_inline": (),
    "rolls_orders": ("hdr_orders",),
    "erolls_orders": ("rolls_orders",),
    "steps_all": ("fact", "book_dim"),
    "reversals": ("hdr_prior", "hdr_inline"),
    "hdr_items": ("hdr_inline", "rolls_orders"),
    "hdr_prior": (),
    "hdr_orders": ("orders", "customer", "nation", "region"),
    "fact_attr": ("fact", "book_dim", "instrument_dim", "trade_dim"),
}


def _order(names):
    seen: list[str] = []

    def visit(n):
        for d in DEPENDS.get(n, ()):
            if d in VIEWS:
                visit(d)
        if n not in seen and n in VIEWS:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan.  The test fixtures are one row group each, so in a session of one
    process (tests, bench) the fact-sized ones are spread over its threads."""
    df = spark.read.parquet(path)
    if not spark.sparkContext.master.startswith("local["):
        return df
    want = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want and path.rsplit("/", 1)[-1] in SPREAD_TABLES:
        df = df.repartition(want)
    return df


# Fact-sized tables worth spreading when stored as a single row group.
SPREAD_TABLES = {"lineitem.parquet", "orders.parquet", "events.parquet", "documents.parquet"}


def register(spark: SparkSession, sf_dir: str, names) -> dict[str, DataFrame]:
    """Register base parquet tables and the named stand-in views; return DataFrames."""
    ordered = _order(names)
    base = set()
    for n in ordered:
        for d in DEPENDS.get(n, ()):
            if d in BASE_TABLES:
                base.add(d)
    for n in names:
        if n in BASE_TABLES:
            base.add(n)
    out: dict[str, DataFrame] = {}
    for t in sorted(base):
        df = read_table(spark, f"{sf_dir}/{t}.parquet")
        df.createOrReplaceTempView(t)
        out[t] = df
    for n in ordered:
        df = spark.sql(VIEWS[n])
        df.createOrReplaceTempView(n)
        out[n] = df
    return out


def with_views(names, body: str) -> str:
    """DuckDB/ANSI text: WITH <stand-in views in dependency order> <body>."""
    ordered = _order(names)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in ordered)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
