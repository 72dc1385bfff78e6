"""Preview of Scale/Flatten/Roll requests before submission: summary, breakdown,
sample and roll projection — computed for a whole batch of requests at once
(one wildcard join, then aggregates keyed by request)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restate.functions.factor import FACTOR_TYPE, VALUE_TYPE, effective_factor
from restate.operators.match import wildcard_match
from restate.plans.scale import request_cobs


def matched(fact_attr: DataFrame, headers: DataFrame, filter_map: dict[str, str], cob_col="cobid",
            match_on: str = "source") -> DataFrame:
    """Fact rows x requests they match, with the request's effective factor.

    ``match_on='source'`` matches at the request's source COB (a plain scale's
    source is its own COB); ``'target'`` at the target COB.
    """
    src = F.coalesce(F.col("source_cobid"), F.col("cobid"))
    h = headers.select(F.col("adj_key").alias("_p_key"), F.col("restatement_type").alias("_p_type"),
                       F.col("scale_factor").cast(FACTOR_TYPE).alias("_p_f"),
                       (src if match_on == "source" else F.col("cobid")).cast("int").alias("_p_match"),
                       effective_factor("restatement_type", "scale_factor", "cobid", src).alias("_p_eff"),
                       *[F.col(c).alias(f"_pf_{c}") for c in filter_map])
    fmap = {f"_pf_{k}": v for k, v in filter_map.items()}
    fact_attr = fact_attr.where(F.col(cob_col).isin(request_cobs(headers)))
    return wildcard_match(fact_attr, h, fmap, fact_cob=cob_col, header_cob="_p_match")


def _delta(metric: str) -> F.Column:
    return (F.col(metric).cast(VALUE_TYPE) * F.col("_p_eff")).cast(VALUE_TYPE)


def preview_summary(m: DataFrame, metric: str) -> DataFrame:
    """count, nonzero count, sum current, sum delta, sum projected — one row per request."""
    d = _delta(metric)
    return m.groupBy(F.col("_p_key").alias("adj_key")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col(metric) != 0).alias("nonzero_rows"),
        F.coalesce(F.sum(metric), F.lit(0)).alias("current_total"),
        F.coalesce(F.sum(d), F.lit(0)).alias("delta_total"),
        F.coalesce(F.sum(F.col(metric).cast(VALUE_TYPE) + d), F.lit(0)).alias("projected_total"))


def preview_breakdown(m: DataFrame, metric: str, by) -> DataFrame:
    d = _delta(metric)
    return m.groupBy(F.col("_p_key").alias("adj_key"), *by).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(metric).alias("current_total"), F.sum(d).alias("delta_total"))


def preview_sample(m: DataFrame, metric: str, n: int, tie_break, keep) -> DataFrame:
    """Top-n rows per request by |metric| desc (row_number <= n: partial top-k before the shuffle).

    Every n asked for is given; n below 1 is an error."""
    if n < 1:
        raise ValueError(f"n must be at least 1, not {n}")
    w = Window.partitionBy("_p_key").orderBy(F.abs(F.col(metric)).desc(), *[F.col(c) for c in tie_break])
    ranked = m.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    d = _delta(metric)
    return ranked.select(F.col("_p_key").alias("adj_key"), F.col("_rn").alias("sample_rank"), *keep,
                         F.col(metric).alias("current_value"), d.alias("delta_value"))


def preview_roll(target_m: DataFrame, source_m: DataFrame, metric: str) -> DataFrame:
    """current = sum original(target); projected = f x sum adjusted(source)."""
    t = target_m.groupBy(F.col("_p_key").alias("adj_key")).agg(F.sum(metric).alias("current_total"))
    s = source_m.groupBy(F.col("_p_key").alias("adj_key"), F.col("_p_f")).agg(F.sum(metric).alias("_src"))
    j = t.join(s, "adj_key", "full_outer")
    return j.select("adj_key", F.coalesce("current_total", F.lit(0)).alias("current_total"),
                    F.coalesce((F.col("_src").cast(VALUE_TYPE) * F.col("_p_f")).cast(VALUE_TYPE), F.lit(0))
                    .alias("projected_total"))
