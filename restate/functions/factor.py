"""Restatement-type arithmetic: effective factor, action, delta columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from restate.spec import ACTION_MAP

FACTOR_TYPE = "decimal(12,4)"
VALUE_TYPE = "decimal(28,8)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def effective_factor(adj_type, factor, cobid, source_cobid, other: float = 0.0) -> Column:
    """Multiplier the engine applies: flatten -1, same-COB f-1, cross-COB f, else ``other``."""
    t = F.lower(_c(adj_type))
    cross = _c(source_cobid).isNotNull() & (_c(source_cobid) != _c(cobid))
    f = _c(factor).cast(FACTOR_TYPE)
    return (
        F.when(t == "flatten", F.lit(-1))
        .when(t.isin("scale", "roll"), F.when(cross, f).otherwise(f - F.lit(1)))
        .otherwise(F.lit(other))
        .cast(FACTOR_TYPE)
    )


def action_of(adj_type) -> Column:
    """Restatement type -> processing action (case-insensitive); unknown -> NULL."""
    m = F.create_map(*[x for k, v in ACTION_MAP.items() for x in (F.lit(k), F.lit(v))])
    return m[F.lower(F.trim(_c(adj_type)))]


def scaled(value, factor, dtype: str = VALUE_TYPE) -> Column:
    """value x factor with an explicit result type (decimal widening is engine-specific)."""
    return (_c(value).cast(VALUE_TYPE) * _c(factor).cast(FACTOR_TYPE)).cast(dtype)
