"""Entity roll: make an entity's whole slice at the target COB equal to its
combined (original + deltas) slice at the source COB.

Set-based over any number of rolls whose (target COB, entity) slices are
distinct — every step is an equi-join against the roll table, never a driver
loop:

    kept    = deltas  minus rows in a rolled (target COB, entity) slice
    flatten = -original(target COB, entity)            (one row per fact row)
    carry   = +combined(source COB, entity), re-dated to the target COB
    new deltas = kept + flatten + carry   (no netting: two plain scans)

Post-condition: combined(target, entity) == combined(source, entity).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restate.functions.factor import VALUE_TYPE


def _rolled(df: DataFrame, legs: DataFrame, cob_col: str, entity_col: str) -> DataFrame:
    """Rows in a slice that some leg reads; the legs' few dates come first, as a filter of the scan."""
    cobs = sorted({r["_r_cob"] for r in legs.select("_r_cob").distinct().collect() if r["_r_cob"] is not None})
    return df.where(F.col(cob_col).isin(cobs)).join(
        legs, (F.col(cob_col) == F.col("_r_cob")) & (F.upper(F.col(entity_col)) == F.col("_r_ent")), "inner")


def entity_roll(fact_attr: DataFrame, deltas_attr: DataFrame, rolls: DataFrame, position_cols, metrics,
                cob_col: str = "cobid", entity_col: str = "entity_code") -> dict[str, DataFrame]:
    """Returns ``kept``, ``new_rows``, ``deltas`` (kept + new) and ``superseded`` ids.

    ``rolls``: restatement_id, cobid (target), source_cobid, entity_code, created_date.
    ``fact_attr``/``deltas_attr`` carry the entity attribute next to the position;
    the deltas should be a stored table, as they are read for each of the results.
    The fact is read once: a row is matched with the legs that flatten it (target
    slice, sign -1) and those that carry it (source slice, sign +1) in one join.
    """
    pos = [c for c in position_cols if c != cob_col]
    out_cols = [cob_col, "restatement_id", "restatement_created_timestamp", *pos, *metrics]
    base = [F.upper(F.col("entity_code")).alias("_r_ent"), F.col("restatement_id").alias("_r_adj"),
            F.col("created_date").alias("_r_created"), F.col("cobid").alias("_r_target")]
    target = rolls.select(F.col("cobid").alias("_r_cob"), *base, F.lit(-1).cast(VALUE_TYPE).alias("_r_sign"))
    source = rolls.select(F.col("source_cobid").alias("_r_cob"), *base, F.lit(1).cast(VALUE_TYPE).alias("_r_sign"))

    def moved(df: DataFrame, legs: DataFrame) -> DataFrame:
        values = [F.when(F.col("_r_sign") < 0, -F.col(m).cast(VALUE_TYPE)).otherwise(F.col(m).cast(VALUE_TYPE)).alias(m) for m in metrics]
        return _rolled(df, legs, cob_col, entity_col).select(
            F.col("_r_target").alias(cob_col), F.col("_r_adj").alias("restatement_id"),
            F.col("_r_created").alias("restatement_created_timestamp"), *pos, *values)

    wiped = _rolled(deltas_attr, target, cob_col, entity_col)
    keep_keys = rolls.select(F.col("cobid").alias("_k_cob"), F.upper(F.col("entity_code")).alias("_k_ent"))
    kept = deltas_attr.join(keep_keys, (F.col(cob_col) == F.col("_k_cob"))
                            & (F.upper(F.col(entity_col)) == F.col("_k_ent")), "left_anti")
    new_rows = moved(fact_attr, target.unionByName(source)).unionByName(moved(deltas_attr, source))
    kept_rows = kept.select(*[F.col(c).cast(VALUE_TYPE).alias(c) if c in metrics else F.col(c) for c in out_cols])
    superseded = wiped.select(F.col("restatement_id").alias("superseded_id"),
                              F.col("_r_adj").alias("superseded_by")).distinct()
    return {"kept": kept_rows, "new_rows": new_rows, "deltas": kept_rows.unionByName(new_rows),
            "superseded": superseded}
