"""Reconciliation: expected vs written delta per restatement, with the status
vocabulary of the reference's reconciliation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restate.spec import (RECON_BREAK, RECON_MISSING_RESTATEMENT, RECON_MISSING_ORIGINAL, RECON_MISSING_SOURCE,
                          RECON_NO_DATA, RECON_NO_OP, RECON_RECONCILED, RECON_TOLERANCE)


def expected_delta(type_col: str, factor_col: str, cob_col: str, src_col: str,
                   original: str, source: str) -> Column:
    """flatten: -original; same-COB scale: (f-1) x original; roll: f x source - original."""
    t = F.lower(F.col(type_col))
    f = F.col(factor_col).cast("decimal(12,4)")
    cross = F.coalesce(F.col(src_col), F.col(cob_col)) != F.col(cob_col)
    o = F.coalesce(F.col(original), F.lit(0)).cast("decimal(28,8)")
    s = F.coalesce(F.col(source), F.lit(0)).cast("decimal(28,8)")
    return (F.when(t == "flatten", -o)
            .when(cross, s * f - o)
            .otherwise(o * (f - F.lit(1)))).cast("decimal(28,8)")


def recon_status(type_col: str, factor_col: str, cob_col: str, src_col: str, original: str, source: str,
                 written: str, expected: str, tol: float = RECON_TOLERANCE) -> Column:
    t = F.lower(F.col(type_col))
    cross = F.coalesce(F.col(src_col), F.col(cob_col)) != F.col(cob_col)
    return (F.when(F.col(original).isNull() & F.col(written).isNull() & (~cross | F.col(source).isNull()), RECON_NO_DATA)
            .when((t == "scale") & ~cross & (F.col(factor_col) == 1) & F.col(written).isNull(), RECON_NO_OP)
            .when(cross & F.col(source).isNull(), RECON_MISSING_SOURCE)
            .when(F.col(written).isNull(), RECON_MISSING_RESTATEMENT)
            .when(~cross & F.col(original).isNull(), RECON_MISSING_ORIGINAL)
            .when(F.abs(F.col(expected) - F.col(written)) < F.lit(tol), RECON_RECONCILED)
            .otherwise(RECON_BREAK))


def reconcile(headers: DataFrame, original: DataFrame, source: DataFrame, written: DataFrame, id_col: str,
              metric: str) -> DataFrame:
    """Per restatement: original, source, expected and written totals plus a status.

    Every side is pre-aggregated per restatement before the joins."""
    o = original.groupBy(id_col).agg(F.sum(metric).alias("original_total"))
    s = source.groupBy(id_col).agg(F.sum(metric).alias("source_total"))
    w = written.groupBy(id_col).agg(F.sum(metric).alias("written_delta"))
    j = headers.join(o, id_col, "left").join(s, id_col, "left").join(w, id_col, "left")
    j = j.withColumn("expected_delta", expected_delta("restatement_type", "scale_factor", "cobid", "source_cobid",
                                                      "original_total", "source_total"))
    return j.withColumn("recon_status", recon_status("restatement_type", "scale_factor", "cobid", "source_cobid",
                                                     "original_total", "source_total", "written_delta",
                                                     "expected_delta"))
