"""Validation: rule arrays in one pass, reference-code checks, conditional matrix.

Every check is a native expression; all rules of a row are evaluated in one
projection (``array_compact(array(when ...))``) instead of one UNION branch per
rule.  Reference code sets are DISTINCT upper-cased lookups, broadcast behind a
size check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restate.operators.match import DIM_BROADCAST_ROWS, lookup_qualified, sized_broadcast


def _u(c) -> Column:
    return F.upper(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))


def numeric(c, precision: int = 38, scale: int = 6) -> Column:
    """TRY_TO_NUMBER(text, p, s): NULL on garbage."""
    return F.expr(f"try_cast(`{c}` AS decimal({precision},{scale}))")


def error_array(checks: list[tuple[Column, Column]]) -> Column:
    """[(condition, message)] -> array of messages whose condition holds (NULLs dropped)."""
    return F.array_compact(F.array(*[F.when(cond, msg) for cond, msg in checks]))


def value_errors(col: str = "value_usd", label: str = "VALUE_USD") -> list[tuple[Column, Column]]:
    """Required / numeric / non-zero rules for an uploaded text amount."""
    num = numeric(col)
    c = F.col(col)
    return [
        (c.isNull(), F.lit(f"{label} is required")),
        (c.isNotNull() & num.isNull(), F.concat(F.lit(f"{label} is not numeric: "), c)),
        (num == 0, F.lit(f"{label} must not be zero")),
    ]


def code_hit(df: DataFrame, codes: DataFrame, code_col: str, codes_col: str, flag: str) -> DataFrame:
    """Flag whether the row's code exists in a DISTINCT upper-cased code set."""
    s = codes.select(_u(codes_col).alias("_code")).where(F.col("_code").isNotNull()).distinct() \
        .withColumn(f"_{flag}", F.lit(True))
    s, _ = sized_broadcast(s, DIM_BROADCAST_ROWS)
    j = df.withColumn("_lc", _u(code_col)).join(s, F.col("_lc") == F.col("_code"), "left")
    return j.select(*df.columns, F.coalesce(F.col(f"_{flag}"), F.lit(False)).alias(flag))


def pair_hit(df: DataFrame, pairs: DataFrame, cols: dict[str, str], flag: str) -> DataFrame:
    """Flag whether (a, b) exists as a pair in the reference (each may exist alone)."""
    keys = list(cols.items())
    s = pairs.select(*[_u(pc).alias(f"_p{i}") for i, (_, pc) in enumerate(keys)]).distinct() \
        .withColumn(f"_{flag}", F.lit(True))
    s, _ = sized_broadcast(s, DIM_BROADCAST_ROWS)
    cond = None
    for i, (rc, _) in enumerate(keys):
        c = _u(rc) == F.col(f"_p{i}")
        cond = c if cond is None else cond & c
    j = df.join(s, cond, "left")
    return j.select(*df.columns, F.coalesce(F.col(f"_{flag}"), F.lit(False)).alias(flag))


def qualified_hit(df: DataFrame, ref: DataFrame, code_col: str, ref_code: str, qualifiers: dict[str, str], flag: str) -> DataFrame:
    """Code exists in the reference for the row's qualifiers (when given)."""
    found = lookup_qualified(df, ref, code_col, ref_code, qualifiers, F.max(F.lit(True)), "_found")
    return found.select(*df.columns, F.coalesce(F.col("_found"), F.lit(False)).alias(flag))


@dataclass(frozen=True)
class Condition:
    column: str
    pattern: str
    negate: bool = False


@dataclass(frozen=True)
class MatrixRule:
    """``field`` is mandatory when every condition holds (regex, case-insensitive)."""

    field: str
    conditions: tuple[Condition, ...]
    message: str | None = None


def matrix_errors(df: DataFrame, rules: list[MatrixRule]) -> Column:
    """Conditional-mandatory matrix as one array column; a rule whose trigger or
    target column is absent from ``df`` is skipped."""
    have = set(df.columns)
    checks = []
    for r in rules:
        if r.field not in have or any(c.column not in have for c in r.conditions):
            continue
        cond = None
        for c in r.conditions:
            hit = F.coalesce(F.col(c.column).rlike(f"(?i){c.pattern}"), F.lit(False))
            hit = ~hit if c.negate else hit
            cond = hit if cond is None else cond & hit
        blank = F.col(r.field).isNull() | (F.trim(F.col(r.field).cast("string")) == "")
        checks.append((cond & blank, F.lit(r.message or f"{r.field} is required")))
    return error_array(checks) if checks else F.array().cast("array<string>")


def explode_errors(df: DataFrame, id_cols, errors_col: str, out_col: str = "error") -> DataFrame:
    """One row per (row, error) from an error array (one pass, no UNION per rule)."""
    return df.select(*id_cols, F.explode(errors_col).alias(out_col))


def errors_per_row(errs: DataFrame, id_cols, error_col: str, sep: str = "; ") -> DataFrame:
    """All errors of a row joined into one line (sorted for determinism)."""
    return errs.groupBy(*id_cols).agg(F.array_join(F.array_sort(F.collect_list(error_col)), sep).alias("errors"))


def request_errors(reason_col="reason", type_col="restatement_type", factor_col="scale_factor",
                   cob_col="cobid", src_col="source_cobid", min_reason: int = 10) -> Column:
    """Request-level rules: reason length, pointless factor, roll dates."""
    t = F.lower(F.col(type_col))
    return error_array([
        (F.coalesce(F.length(F.trim(F.col(reason_col))), F.lit(0)) < min_reason,
         F.lit(f"Reason must be at least {min_reason} characters")),
        ((t == "scale") & (F.col(factor_col) == 1) & (F.coalesce(F.col(src_col), F.col(cob_col)) == F.col(cob_col)),
         F.lit("Scale factor of 1 has no effect")),
        ((t == "roll") & (F.coalesce(F.col(src_col), F.col(cob_col)) == F.col(cob_col)),
         F.lit("Roll needs a source COB different from the target COB")),
        ((t == "roll") & (F.col(src_col) > F.col(cob_col)), F.lit("Roll source COB must precede the target COB")),
    ])
