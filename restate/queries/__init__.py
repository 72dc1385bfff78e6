"""Query registry: every registered query has a Spark builder and (where the
semantics are expressible in SQL) a DuckDB oracle over the same tables."""

from __future__ import annotations

import importlib

FAMILIES = (
    "delta_family",
    "resolve_family",
    "upload_family",
    "validate_family",
    "overlap_family",
    "workflow_family",
    "lifecycle_family",
    "report_family",
    "cdc_family",
    "misc_family",
    "extra_family",
    "whole_family",
)


def all_queries():
    out = {}
    for fam in FAMILIES:
        mod = importlib.import_module(f"restate.queries.{fam}")
        for q in mod.QUERIES:
            if q.name in out:
                raise ValueError(f"duplicate query {q.name}")
            out[q.name] = q
    return out
