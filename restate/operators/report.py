"""Reporting marts over headers, history and deltas.

Every mart is one (or a few) aggregation(s) with partial aggregation; joins
between marts are done on *pre-aggregated* sides so a header x item fan-out can
never inflate a total.  ``now`` is always a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restate.spec import (STATUS_APPROVED, STATUS_FAILED, STATUS_PENDING, STATUS_PENDING_APPROVAL,
                          STATUS_PROCESSED, STATUS_RUNNING)

KPI_STATUSES = {
    "pending_count": STATUS_PENDING,
    "pending_approval_count": STATUS_PENDING_APPROVAL,
    "approved_count": STATUS_APPROVED,
    "processed_count": STATUS_PROCESSED,
    "running_count": STATUS_RUNNING,
    "failed_count": STATUS_FAILED,
}


def _ts(now) -> Column:
    return F.lit(now).cast("timestamp")


def kpi_per_cob(headers: DataFrame, overlaps: DataFrame | None = None, id_col="adj_key") -> DataFrame:
    """Per COB: counts per status, processed value, timing, users, overlap alerts.

    ``id_col`` is unique per row, so rows are counted; only users need a distinct count.
    ``overlaps``: overlapping pairs per COB (cobid, pairs)."""
    h = headers.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))
    aggs = [F.count(id_col).alias("total_restatements")]
    aggs += [F.count_if(F.col("run_status") == s).alias(n) for n, s in KPI_STATUSES.items()]
    aggs += [F.count_if(F.col("run_status").like("Rejected%")).alias("rejected_count"),
             F.sum(F.when(F.col("run_status") == STATUS_PROCESSED, F.col("restatement_value_in_usd")).otherwise(F.lit(0)))
             .alias("total_processed_value_usd"),
             F.min("created_date").alias("first_submission"), F.max("process_date").alias("last_processing"),
             F.avg(F.when(F.col("run_status") == STATUS_PROCESSED,
                          F.unix_timestamp("process_date") - F.unix_timestamp("created_date"))).alias("avg_processing_seconds"),
             F.countDistinct("username").alias("unique_users")]
    k = h.groupBy("cobid").agg(*aggs)
    if overlaps is not None:
        o = overlaps.groupBy(F.col("cobid").alias("_oc")).agg(F.sum("pairs").alias("_on"))
        k = k.join(o, F.col("cobid") == F.col("_oc"), "left").drop("_oc") \
            .withColumn("overlap_alerts", F.coalesce(F.col("_on"), F.lit(0))).drop("_on")
    return k


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    An equi-join on a constant key against a broadcast single row (no cartesian
    operator); ``one_row`` must be a global aggregate, so its size is proven."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def side_by_side(*one_rows: DataFrame) -> DataFrame:
    """Several one-row aggregates as one row."""
    out = one_rows[0]
    for r in one_rows[1:]:
        out = with_scalars(out, r)
    return out


def conditional_counts(df: DataFrame, conds: dict[str, Column], group=()) -> DataFrame:
    """One pass of COUNT_IF columns (optionally grouped)."""
    aggs = [F.count_if(c).alias(n) for n, c in conds.items()]
    return df.groupBy(*group).agg(*aggs) if group else df.agg(*aggs)


def health(headers: DataFrame, now, stale_minutes: int = 240) -> DataFrame:
    """Queue health: queued, blocked, running, stale, failed in 24h, oldest queued age."""
    t = _ts(now)
    queued = F.col("run_status").isin(STATUS_PENDING, STATUS_APPROVED)
    return headers.agg(
        F.count_if(queued & F.col("blocked_by_adj_id").isNull()).alias("queued"),
        F.count_if(queued & F.col("blocked_by_adj_id").isNotNull()).alias("blocked"),
        F.count_if(F.col("run_status") == STATUS_RUNNING).alias("running"),
        F.count_if((F.col("run_status") == STATUS_RUNNING)
                   & (F.col("start_date") < t - F.expr(f"INTERVAL {stale_minutes} MINUTES"))).alias("stale"),
        F.count_if((F.col("run_status") == STATUS_FAILED) & (F.col("created_date") >= t - F.expr("INTERVAL 24 HOURS")))
        .alias("failed_24h"),
        F.max(F.when(queued, F.unix_timestamp(t) - F.unix_timestamp("created_date"))).alias("oldest_queued_sec"))


def impact_summary(headers: DataFrame, deltas: DataFrame, original: DataFrame, id_col: str, metric: str) -> DataFrame:
    """Per restatement: rows, sum |delta|, net delta, original total, % impact (pre-aggregated sides)."""
    d = deltas.groupBy(id_col).agg(F.count(F.lit(1)).alias("rows_affected"),
                                   F.sum(F.abs(F.col(metric))).alias("abs_delta"), F.sum(metric).alias("net_delta"))
    o = original.groupBy(id_col).agg(F.sum(metric).alias("original_total"))
    j = headers.select(id_col).join(d, id_col, "left").join(o, id_col, "left")
    pct = F.round(F.col("net_delta") / F.nullif(F.col("original_total"), F.lit(0)) * 100, 4)
    return j.select(id_col, F.coalesce("rows_affected", F.lit(0)).alias("rows_affected"),
                    "abs_delta", "net_delta", "original_total", pct.alias("pct_impact"))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Top-k report (global ORDER BY ... LIMIT n: TakeOrderedAndProject, partial per task)."""
    return df.orderBy(*order).limit(n)


def anomalies(headers: DataFrame, id_col: str, rows_col: str, factor_col: str, ticket_col: str) -> DataFrame:
    """Rule-based anomaly flags against global statistics (one aggregate, broadcast back)."""
    stats = headers.agg(F.avg(rows_col).alias("_avg_rows"), F.avg(factor_col).alias("_avg_f"),
                        F.stddev_pop(factor_col).alias("_sd_f"))
    j = with_scalars(headers, stats)
    rules = [
        (F.col(rows_col) > F.col("_avg_rows") * 2.5, "ROWS_ABOVE_2.5X_MEAN"),
        (F.abs(F.col(factor_col) - 1) > 0.10, "FACTOR_CHANGE_OVER_10PCT"),
        (F.abs(F.col(factor_col) - F.col("_avg_f")) > 2 * F.col("_sd_f"), "FACTOR_OUTSIDE_2_SIGMA"),
        ((F.col(rows_col) > 50) & F.col(ticket_col).isNull(), "LARGE_WITHOUT_TICKET"),
    ]
    flags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    return j.select(id_col, F.explode(flags).alias("anomaly"))


def pivot_counts(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """row x col counts with a fixed value list (no extra pass to discover pivot values)."""
    return df.groupBy(row).pivot(col, values).count().na.fill(0)


def three_way(a: DataFrame, b: DataFrame, c: DataFrame, names=("header_count", "registry_count", "delta_ids")) -> DataFrame:
    """Three independent scalar aggregates side by side (one row)."""
    x = a.agg(F.count(F.lit(1)).alias(names[0]))
    y = b.agg(F.count(F.lit(1)).alias(names[1]))
    z = c.agg(F.count(F.lit(1)).alias(names[2]))
    return side_by_side(x, y, z)


def fanout(ids: DataFrame, id_col: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Per id: rows in each delta table (each side pre-aggregated, then left-joined)."""
    out = ids.select(id_col).distinct()
    for name, t in tables.items():
        cnt = t.groupBy(id_col).agg(F.count(F.lit(1)).alias(f"rows_{name}"))
        out = out.join(cnt, id_col, "left")
    return out.na.fill(0, [f"rows_{n}" for n in tables])


def activity_feed(headers: DataFrame, history: DataFrame, id_col: str) -> DataFrame:
    """Submission events unioned with status-change events, each carrying header context."""
    sub = headers.select(id_col, "process_type", F.col("username").alias("actor"),
                         F.lit("Submitted").alias("event_type"), F.col("created_date").alias("event_time"))
    h = headers.select(F.col(id_col).alias("_hk"), F.col("process_type").alias("_pt"))
    ch = history.join(h, F.col(id_col) == F.col("_hk")).select(
        id_col, F.col("_pt").alias("process_type"), F.col("changed_by").alias("actor"),
        F.col("new_status").alias("event_type"), F.col("changed_at").alias("event_time"))
    return sub.unionByName(ch)


def business_days(calendar: DataFrame, date_col: str, is_business: Column, max_back: int) -> DataFrame:
    """For each business day, the earlier business days within ``max_back`` positions,
    with their ordinal (1 = previous).  An equi-join on generated ordinals: N x max_back
    rows, never N^2."""
    b = calendar.where(is_business).select(F.col(date_col).alias("d")).distinct()
    # global order over a calendar (one row per business day: a few thousand at most)
    numbered = b.withColumn("_i", F.row_number().over(Window.orderBy("d")))
    x = numbered.select(F.col("d").alias("cob_date"), F.col("_i").alias("_ci"),
                        F.explode(F.sequence(F.lit(1), F.lit(max_back))).alias("ordinal"))
    y = numbered.select(F.col("d").alias("prior_date"), F.col("_i").alias("_pi"))
    j = x.join(y, F.col("_pi") == F.col("_ci") - F.col("ordinal"))
    return j.select("cob_date", "prior_date", "ordinal")


def union_all(dfs) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)
