"""Text cleaning and small predicates, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from restate.spec import BLANK_MARKERS, REASON_MAX_LEN, REASON_SEPARATOR, RECON_TOLERANCE


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c) -> Column:
    """Trim; '', 'nan', 'none' (any case) -> NULL."""
    t = F.trim(_c(c).cast("string"))
    return F.when(F.lower(t).isin(*BLANK_MARKERS), F.lit(None).cast("string")).otherwise(t)


def blanks_to_null(df: DataFrame, cols=None) -> DataFrame:
    cols = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.select(*[blank_to_null(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def normalise_ws(c) -> Column:
    """Collapse any whitespace run (tabs, CR/LF, NBSP) to one space and trim."""
    return F.trim(F.regexp_replace(_c(c), "[\\s\\u00A0]+", " "))


def coerce_date(c, formats=("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd.MM.yyyy", "yyyyMMdd")) -> Column:
    """Day-first multi-format text date -> DATE; unparseable -> NULL."""
    t = F.trim(_c(c))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in formats])


def _whole_reason(category, reason) -> Column:
    return F.concat_ws(REASON_SEPARATOR, F.nullif(F.trim(_c(category)), F.lit("")), _c(reason))


def compose_reason(category, reason, max_len: int = REASON_MAX_LEN) -> Column:
    """'<category> | <reason>' (blank category skipped), cut to ``max_len`` characters; see ``reason_is_cut``."""
    return F.substring(_whole_reason(category, reason), 1, max_len)


def reason_is_cut(category, reason, max_len: int = REASON_MAX_LEN) -> Column:
    """Whether ``compose_reason`` leaves part of the text out."""
    return F.length(_whole_reason(category, reason)) > max_len


def ci_eq(a, b) -> Column:
    """Case-insensitive equality (NULL-propagating, like '=')."""
    return F.upper(_c(a)) == F.upper(_c(b))


def nearly_equal(a, b, tol: float = RECON_TOLERANCE) -> Column:
    return F.abs(_c(a) - _c(b)) < F.lit(tol)


def duration_text(seconds) -> Column:
    """Seconds -> '1h 2m' / '1m 5s' / '59s'; negative or NULL -> '—'."""
    s = _c(seconds).cast("long")
    return (
        F.when(s.isNull() | (s < 0), F.lit("—"))
        .when(s >= 3600, F.format_string("%dh %dm", (s / 3600).cast("long"), ((s % 3600) / 60).cast("long")))
        .when(s >= 60, F.format_string("%dm %ds", (s / 60).cast("long"), s % 60))
        .otherwise(F.format_string("%ds", s))
    )


def cobid_of(ts) -> Column:
    """DATE/TIMESTAMP -> int yyyymmdd."""
    t = _c(ts)
    return (F.year(t) * 10000 + F.month(t) * 100 + F.dayofmonth(t)).cast("int")


def cob_to_date(cob) -> Column:
    return F.to_date(_c(cob).cast("string"), "yyyyMMdd")
