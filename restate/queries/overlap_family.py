"""Registered queries: overlap alerts, blocking, unblocking, list overlap, queue order."""

from __future__ import annotations

from pyspark.sql import functions as F

from restate.operators import factored as FO
from restate.operators import overlap as O
from restate.spec import OVERLAP_HORIZON_DAYS, PIPELINE_OF_SCOPE
from restate.queries import standin as S
from restate.queries.common import Query
from restate.session import cut_lineage
from restate.sources import io as IO

QUERIES: list[Query] = []


def q(name, sql=None):
    def deco(fn):
        QUERIES.append(Query(name, fn, sql))
        return fn
    return deco


DIMS = list(S.FILTER_COLS)
GRP = ["cobid", "process_type"]
PIPE = ["cobid", "pipeline"]
# Stand-in for scope names: three market segments play the scopes that share one pipeline.
SCOPE_OF_SEGMENT = {"BUILDING": "FRTB", "FURNITURE": "FRTBDRC", "HOUSEHOLD": "FRTBRRAO"}
_PIPELINE_SQL = "CASE WHEN process_type IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD') THEN 'FRTB' ELSE process_type END"


def _compat(a: str, b: str) -> str:
    return " AND ".join(f"({a}.{c} IS NULL OR {b}.{c} IS NULL OR upper(trim({a}.{c})) = upper(trim({b}.{c})))"
                        for c in DIMS)


_SIG_SQL = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {1 << i} ELSE 0 END" for i, c in enumerate(DIMS))


def _live(spark, d):
    v = S.register(spark, d, ["hdr_queue"])
    return v["hdr_queue"].where(~F.col("is_deleted"))


def _piped(spark, d):
    """Live requests with the pipeline their scope runs in: scopes of one pipeline block each other."""
    pipeline = {seg: PIPELINE_OF_SCOPE[scope] for seg, scope in SCOPE_OF_SEGMENT.items()}
    return O.with_pipeline(_live(spark, d), "process_type", pipeline)


@q("jn_self_overlap", S.with_views(["hdr_queue"], f"""
WITH h AS (SELECT * FROM hdr_queue WHERE NOT is_deleted)
SELECT a.cobid, a.process_type, a.adj_key AS adj_a, b.adj_key AS adj_b,
       CASE WHEN b.created_date > a.created_date OR (b.created_date = a.created_date AND b.adj_key > a.adj_key)
            THEN b.adj_key ELSE a.adj_key END AS superseding_adj,
       CASE WHEN b.created_date > a.created_date OR (b.created_date = a.created_date AND b.adj_key > a.adj_key)
            THEN a.adj_key ELSE b.adj_key END AS superseded_adj
FROM h a JOIN h b ON a.cobid = b.cobid AND a.process_type = b.process_type AND a.adj_key < b.adj_key
 AND {_compat('a', 'b')}
 AND a.created_date >= (SELECT max(created_date) FROM h) - INTERVAL {OVERLAP_HORIZON_DAYS} DAY
 AND b.created_date >= (SELECT max(created_date) FROM h) - INTERVAL {OVERLAP_HORIZON_DAYS} DAY"""))
def jn_self_overlap(spark, d):
    """Alerts for requests created in the last 35 days; today is the newest request's time."""
    h = _live(spark, d).select("adj_key", *GRP, "created_date", *DIMS)
    today = h.agg(F.max("created_date")).first()[0]
    h = O.within_horizon(h, "created_date", today, OVERLAP_HORIZON_DAYS)
    return O.overlap_alerts(h, "adj_key", DIMS, GRP, "created_date")


@q("jn_block_running", S.with_views(["hdr_queue"], f"""
WITH h AS (SELECT *, {_PIPELINE_SQL} AS pipeline FROM hdr_queue WHERE NOT is_deleted)
SELECT a.adj_key, min_by(b.adj_key, struct_pack(c := b.created_date, i := b.adj_key)) AS blocked_by
FROM h a JOIN h b ON a.cobid = b.cobid AND a.pipeline = b.pipeline
 AND a.run_status = 'Pending' AND b.run_status = 'Running' AND {_compat('a', 'b')}
GROUP BY a.adj_key"""))
def jn_block_running(spark, d):
    h = _piped(spark, d).select("adj_key", *PIPE, "created_date", "run_status", *DIMS)
    return O.block_running(h, "adj_key", DIMS, PIPE, "created_date")


@q("jn_first_blocker", S.with_views(["hdr_queue"], f"""
WITH h AS (SELECT *, {_PIPELINE_SQL} AS pipeline FROM hdr_queue WHERE NOT is_deleted)
SELECT a.adj_key, min_by(b.adj_key, struct_pack(c := b.created_date, i := b.adj_key)) AS blocked_by
FROM h a JOIN h b ON a.cobid = b.cobid AND a.pipeline = b.pipeline AND a.adj_key <> b.adj_key
 AND a.run_status = 'Pending Approval' AND b.run_status IN ('Pending', 'Approved', 'Running')
 AND b.created_date < a.created_date AND {_compat('a', 'b')}
GROUP BY a.adj_key"""))
def jn_first_blocker(spark, d):
    h = _piped(spark, d).select("adj_key", *PIPE, "created_date", "run_status", *DIMS)
    new = h.where(F.col("run_status") == "Pending Approval")
    live = h.where(F.col("run_status").isin("Pending", "Approved", "Running"))
    return O.first_blocker(new, live, "adj_key", DIMS, PIPE, "created_date", older_only=True)


@q("srt_first_overlap", S.with_views(["hdr_queue"], f"""
WITH h AS (SELECT * FROM hdr_queue WHERE NOT is_deleted)
SELECT a.adj_key, min_by(b.adj_key, struct_pack(c := b.created_date, i := b.adj_key)) AS blocked_by
FROM h a JOIN h b ON a.cobid = b.cobid AND a.process_type = b.process_type AND a.adj_key <> b.adj_key
 AND a.run_status = 'Pending' AND b.run_status IN ('Pending', 'Approved', 'Running', 'Pending Approval')
 AND {_compat('a', 'b')}
GROUP BY a.adj_key"""))
def srt_first_overlap(spark, d):
    h = _live(spark, d).select("adj_key", *GRP, "created_date", "run_status", *DIMS)
    new = h.where(F.col("run_status") == "Pending")
    live = h.where(F.col("run_status").isin("Pending", "Approved", "Running", "Pending Approval"))
    return O.first_blocker(new, live, "adj_key", DIMS, GRP, "created_date")


@q("jn_unblock", S.with_views(["hdr_queue"], f"""
WITH h AS (SELECT *, {_PIPELINE_SQL} AS pipeline FROM hdr_queue WHERE NOT is_deleted),
 stale AS (SELECT * FROM h WHERE blocked_by_adj_id IS NOT NULL
           AND blocked_by_adj_id NOT IN (SELECT adj_key FROM h WHERE run_status = 'Running')),
 rb AS (SELECT a.adj_key, min_by(b.adj_key, struct_pack(c := b.created_date, i := b.adj_key)) AS nb
        FROM stale a JOIN h b ON a.cobid = b.cobid AND a.pipeline = b.pipeline
         AND a.run_status = 'Pending' AND b.run_status = 'Running' AND {_compat('a', 'b')} GROUP BY a.adj_key)
SELECT s.adj_key, rb.nb AS new_blocked_by FROM stale s LEFT JOIN rb ON s.adj_key = rb.adj_key"""))
def jn_unblock(spark, d):
    h = _piped(spark, d).select("adj_key", *PIPE, "created_date", "run_status", "blocked_by_adj_id", *DIMS)
    return O.unblock(h, "adj_key", DIMS, PIPE, "created_date")


_LIST_REQUESTS = """req AS (SELECT o.o_orderkey AS req_id, o.o_custkey AS customer_key, CAST(year(o.o_orderdate) AS INT) AS period,
                    CASE WHEN o.o_orderstatus = 'P' THEN [] ELSE list_distinct(list(p.p_brand)) END AS brands
             FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
             GROUP BY o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_orderstatus)"""


def _list_requests(spark, d):
    v = S.register(spark, d, ["lineitem", "orders", "part"])
    j = v["orders"].join(v["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")).join(
        v["part"], F.col("p_partkey") == F.col("l_partkey"))
    req = j.groupBy(F.col("o_orderkey").alias("req_id"), F.col("o_custkey").alias("customer_key"),
                    F.year("o_orderdate").cast("int").alias("period"),
                    "o_orderstatus").agg(F.collect_set("p_brand").alias("brands"))
    req = req.select("req_id", "customer_key", "period",
                     F.when(F.col("o_orderstatus") == "P", F.array().cast("array<string>"))
                     .otherwise(F.col("brands")).alias("brands"))
    return req


@q("jn_list_intersect", S.with_views(["lineitem", "orders", "part"], f"""
WITH {_LIST_REQUESTS}
SELECT a.req_id AS a_req_id, a.customer_key AS a_customer_key, a.period AS a_period, b.req_id AS b_req_id,
       CASE WHEN len(a.brands) = 0 OR len(b.brands) = 0 THEN NULL
            ELSE CAST(len(list_intersect(a.brands, b.brands)) AS BIGINT) END AS common_brands
FROM req a JOIN req b ON a.customer_key = b.customer_key AND a.period = b.period AND a.req_id < b.req_id
WHERE len(a.brands) = 0 OR len(b.brands) = 0 OR len(list_intersect(a.brands, b.brands)) > 0"""))
def jn_list_intersect(spark, d):
    """The pairs, by expansion of the classes that share a value or leave the list open."""
    req = IO.write_image(_list_requests(spark, d), "list-requests")
    pairs = FO.expand_lists(req, "req_id", ["brands"], ["customer_key", "period"])
    group = req.select("req_id", F.col("customer_key").alias("a_customer_key"), F.col("period").alias("a_period"))
    return pairs.join(group, F.col("a_id") == F.col("req_id")).select(
        F.col("a_id").alias("a_req_id"), "a_customer_key", "a_period", F.col("b_id").alias("b_req_id"), F.col("common_0").alias("common_brands"))


@q("jn_list_links", S.with_views(["lineitem", "orders", "part"], f"""
WITH {_LIST_REQUESTS}
SELECT a.req_id, (SELECT count(*) FROM req b WHERE a.customer_key = b.customer_key AND a.period = b.period AND a.req_id <> b.req_id
   AND (len(a.brands) = 0 OR len(b.brands) = 0 OR len(list_intersect(a.brands, b.brands)) > 0)) AS links FROM req a"""))
def jn_list_links(spark, d):
    """How many others each request's lists meet: a row a request, open lists counted by class."""
    return FO.list_links(_list_requests(spark, d), "req_id", ["brands"], ["customer_key", "period"]).select("req_id", "links")


@q("jn_overlap_links", S.with_views(["hdr_queue"], f"""
WITH h AS (SELECT * FROM hdr_queue WHERE NOT is_deleted)
SELECT a.adj_key, (SELECT count(*) FROM h b WHERE a.cobid = b.cobid AND a.process_type = b.process_type AND a.adj_key <> b.adj_key
  AND {_compat('a', 'b')}) AS links FROM h a"""))
def jn_overlap_links(spark, d):
    """How many others each request overlaps, over all requests: a row a request."""
    h = _live(spark, d).select("adj_key", *GRP, "created_date", *DIMS)
    return FO.overlap_links(h, "adj_key", DIMS, GRP, "created_date").select("adj_key", "links")


@q("jn_overlap_nodes", S.with_views(["hdr_queue"], f"""
WITH h AS (SELECT *, {_SIG_SQL} AS sig FROM hdr_queue WHERE NOT is_deleted)
SELECT a.cobid, a.process_type, least(a.sig, b.sig) AS sig_a, greatest(a.sig, b.sig) AS sig_b, count(*) AS pairs
FROM h a JOIN h b ON a.cobid = b.cobid AND a.process_type = b.process_type AND a.adj_key < b.adj_key AND {_compat('a', 'b')}
GROUP BY ALL"""))
def jn_overlap_nodes(spark, d):
    """All overlaps as nodes, counted here by group and the two signatures; no pair is listed."""
    h = _live(spark, d).select("adj_key", *GRP, "created_date", *DIMS)
    classes = cut_lineage(FO.overlap_classes(h, "adj_key", DIMS, GRP, "created_date"))
    return FO.overlap_nodes(classes, DIMS, GRP).groupBy(*GRP, "sig_a", "sig_b").agg(F.sum("pairs").alias("pairs"))


# Not registered: the rule is sequential, so a whole queue goes through one task.
def adj_block_greedy(spark, d):
    h = _live(spark, d).where(F.col("run_status").isin("Pending", "Approved")) \
        .select("adj_key", *GRP, "created_date", *DIMS)
    return O.greedy_block(h, "adj_key", DIMS, GRP, "created_date")


@q("srt_oldest_first", S.with_views(["hdr_queue"], """
SELECT adj_key, process_type, cobid, row_number() OVER (PARTITION BY process_type, cobid
       ORDER BY created_date ASC NULLS LAST, adj_key) AS queue_pos
FROM hdr_queue WHERE NOT is_deleted AND run_status IN ('Pending', 'Approved')"""))
def srt_oldest_first(spark, d):
    h = _live(spark, d).where(F.col("run_status").isin("Pending", "Approved"))
    return O.queue_order(h, ["process_type", "cobid"], "created_date", "adj_key").select(
        "adj_key", "process_type", "cobid", "queue_pos")
