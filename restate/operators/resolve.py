"""Code -> key resolution against dimensions (Type-1 and SCD2).

All lookups are left joins on an upper-cased code (case-insensitive, hash
joinable).  A dimension side is broadcast only behind a size check.  Fan-out on
ambiguous codes is either reproduced (``resolve_key``) or collapsed to MAX
(``resolve_max``) — the collapsed form never multiplies rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restate.operators.asof import asof_join
from restate.operators.match import DIM_BROADCAST_ROWS, lookup_qualified, sized_broadcast


def _u(c) -> Column:
    return F.upper(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))


def resolve_key(df: DataFrame, dim: DataFrame, code_col: str, dim_code: str, dim_key: str,
                out_col: str, unknown=-1) -> DataFrame:
    """Left join code -> key (case-insensitive); unknown -> -1.  Fans out on ambiguity."""
    d = dim.select(_u(dim_code).alias("_rc"), F.col(dim_key).alias("_rk"))
    d, _ = sized_broadcast(d, DIM_BROADCAST_ROWS)
    j = df.withColumn("_lc", _u(code_col)).join(d, F.col("_lc") == F.col("_rc"), "left")
    return j.select(*df.columns, F.coalesce(F.col("_rk"), F.lit(unknown)).alias(out_col))


def resolve_max(df: DataFrame, dim: DataFrame, code_col: str, dim_code: str, dim_key: str,
                out_col: str, unknown=-1) -> DataFrame:
    """Same, but several matches collapse to MAX(key): never multiplies rows."""
    d = dim.groupBy(_u(dim_code).alias("_rc")).agg(F.max(dim_key).alias("_rk"))
    d, _ = sized_broadcast(d, DIM_BROADCAST_ROWS)
    j = df.withColumn("_lc", _u(code_col)).join(d, F.col("_lc") == F.col("_rc"), "left")
    return j.select(*df.columns, F.coalesce(F.col("_rk"), F.lit(unknown)).alias(out_col))


def resolve_qualified(df: DataFrame, dim: DataFrame, code_col: str, dim_code: str, dim_key: str,
                      qualifiers: dict[str, str], out_col: str, unknown=-1) -> DataFrame:
    """Code lookup qualified by extra columns only where the row gives them; MAX(key) of what fits."""
    found = lookup_qualified(df, dim, code_col, dim_code, qualifiers, F.max(dim_key), "_rk")
    return found.select(*df.columns, F.coalesce(F.col("_rk"), F.lit(unknown)).alias(out_col))


def dummy_code(primary, fallback, suffix: str = "/RESTATEMENT") -> Column:
    """Missing primary code -> '<fallback><suffix>' (turns an OR join into an equi join)."""
    p = primary if isinstance(primary, Column) else F.col(primary)
    f = fallback if isinstance(fallback, Column) else F.col(fallback)
    return F.coalesce(F.nullif(F.trim(p), F.lit("")), F.concat(f, F.lit(suffix)))


def versions_from_events(events: DataFrame, natural_key: str, start_col: str, version_key: str,
                         tie: str | None = None) -> DataFrame:
    """Build SCD2 [start, end) intervals: end = next start of the same natural key."""
    order = [F.col(start_col)] + ([F.col(tie)] if tie else [])
    w = Window.partitionBy(natural_key).orderBy(*order)
    return events.select(F.col(natural_key), F.col(version_key), F.col(start_col).alias("effective_start"),
                         F.lead(start_col).over(w).alias("effective_end"))


def rekey(df: DataFrame, versions: DataFrame, key_col: str, natural_key: str, version_key: str,
          at_col: str, start_col: str = "effective_start", end_col: str | None = "effective_end", order_cols=()) -> DataFrame:
    """Replace a version key by the version of the same natural key effective at ``at_col``."""
    nk = versions.select(F.col(version_key).alias("_vk"), F.col(natural_key).alias("_nk"))
    step = df.join(nk, F.col(key_col) == F.col("_vk"), "left").drop("_vk")
    out = asof_join(step, versions, {"_nk": natural_key}, at_col, start_col, end_col, {"_new": version_key}, order_cols=order_cols)
    return out.select(*[F.coalesce(F.col("_new"), F.col(c)).alias(c) if c == key_col else F.col(c)
                        for c in df.columns])


def best_candidate(df: DataFrame, id_cols, order: list[Column]) -> DataFrame:
    """``QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY ...) = 1``."""
    w = Window.partitionBy(*id_cols).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fx_to_local(df: DataFrame, rates: DataFrame, keys: list[str], usd_col: str, rate_col: str,
                out_col: str) -> DataFrame:
    """USD -> local by the rate at the keys; a missing rate counts as 1."""
    r = rates.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col(rate_col).alias("_rate"))
    r, _ = sized_broadcast(r, DIM_BROADCAST_ROWS)
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_r_{k}") for k in keys])
    j = df.join(r, cond, "left")
    return j.select(*df.columns, (F.col(usd_col) / F.coalesce(F.col("_rate"), F.lit(1))).alias(out_col))


def flag_membership(df: DataFrame, members: DataFrame, col: str, member_col: str, out_col: str) -> DataFrame:
    """Boolean flag: value appears in a (distinct) member list — left join, no fan-out."""
    m = members.select(_u(member_col).alias("_m")).distinct().withColumn("_hit", F.lit(True))
    m, _ = sized_broadcast(m, DIM_BROADCAST_ROWS)
    j = df.withColumn("_lc", _u(col)).join(m, F.col("_lc") == F.col("_m"), "left")
    return j.select(*df.columns, F.coalesce(F.col("_hit"), F.lit(False)).alias(out_col))


def unique_id(df: DataFrame, dim: DataFrame, match: dict[str, str], dim_id: str, out_col: str) -> DataFrame:
    """Id only when exactly one distinct id matches all of the row's names, else NULL."""
    d = dim.groupBy(*[_u(dc).alias(f"_m_{i}") for i, dc in enumerate(match.values())]).agg(
        F.countDistinct(dim_id).alias("_n"), F.min(dim_id).alias("_min"))
    d, _ = sized_broadcast(d.where("_n = 1"), DIM_BROADCAST_ROWS)
    cond = reduce(lambda a, b: a & b, [_u(rc) == F.col(f"_m_{i}") for i, rc in enumerate(match)])
    return df.join(d, cond, "left").select(*df.columns, F.col("_min").alias(out_col))


def ambiguous_codes(dim: DataFrame, code_col: str, key_col: str) -> DataFrame:
    """Codes mapping to more than one key."""
    return (dim.groupBy(_u(code_col).alias("code"))
            .agg(F.countDistinct(key_col).alias("key_count"))
            .where(F.col("key_count") > 1))


def distinct_codes(df: DataFrame, code_col: str) -> DataFrame:
    return df.select(_u(code_col).alias("code")).where(F.col("code").isNotNull()).distinct()
