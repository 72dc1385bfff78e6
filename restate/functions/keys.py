"""Deterministic keys and ids, all as native Spark expressions.

Deterministic ids make every job replay-safe: re-running a batch (after an
executor loss or a retried micro-batch) produces identical rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from restate.spec import SURROGATE_NULL


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def surrogate_key(*cols) -> Column:
    """MD5 of the columns as text joined by '-', NULL replaced by a placeholder."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit(SURROGATE_NULL)) for c in cols]
    return F.md5(F.concat_ws("-", *parts))


def row_key(adj_id, row_num, suffix: str = "DIRECT") -> Column:
    """Stable per-line key: md5('<adj>-<row>-<suffix>')."""
    return F.md5(F.concat(_c(adj_id).cast("string"), F.lit("-"),
                          _c(row_num).cast("string"), F.lit(f"-{suffix}")))


def uuid5(namespace: str | uuid.UUID, name) -> Column:
    """RFC 4122 version-5 UUID of ``name`` in ``namespace`` (equals uuid.uuid5)."""
    ns_hex = uuid.UUID(str(namespace)).hex
    h = F.sha1(F.concat(F.unhex(F.lit(ns_hex)), _c(name).cast("string").cast("binary")))
    b8 = F.conv(F.substring(h, 17, 2), 16, 10).cast("int")
    variant = F.lower(F.lpad(F.hex(b8.bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))), 2, "0"))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 19, 2)),
        F.substring(h, 21, 12),
    )


def stable_id(*cols) -> Column:
    """64-bit deterministic id (replaces RANDOM/sequence ids)."""
    return F.xxhash64(*[_c(c) for c in cols])
