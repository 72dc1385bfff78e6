"""Sources and sinks over partitioned Parquet.

* facts are partitioned by ``cobid``, so a COB filter is a partition filter;
* tables that the library writes (deltas, summaries, histories, images) are the
  slices of ``manifest.Tables``: appended, replaced or merged in one commit;
* ``write_image`` materialises an intermediate relation in a fresh staging
  directory and reads it back.
"""

from __future__ import annotations

import csv
import json
import os
import re
import uuid
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from restate.session import checkpoint_dir
from restate.spec import ScopeSpec


def read_fact(spark: SparkSession, path: str, cobids=None, metric: str | None = None,
              cob_col: str = "cobid") -> DataFrame:
    """One scope's fact (optionally at given COBs, metric not NULL): partition-pruned."""
    df = spark.read.parquet(path)
    if cobids is not None:
        df = df.where(F.col(cob_col).isin(list(cobids)))
    if metric:
        df = df.where(F.col(metric).isNotNull())
    return df


SEPARATORS = (",", ";", "\t", "|")


def sniff_separator(first_line: str, candidates=SEPARATORS) -> str:
    """The candidate separator occurring most often in the header line."""
    counts = {c: first_line.count(c) for c in candidates}
    return max(counts, key=lambda c: (counts[c], -candidates.index(c)))


def _header_names(line: str, sep: str) -> list[str]:
    """Column names of a header line: upper-cased, trimmed; an empty one by its place."""
    cells = next(csv.reader([line.lstrip("\ufeff")], delimiter=sep), [])
    names = [c.strip().upper() or f"_C{i}" for i, c in enumerate(cells)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"header {line!r} names {', '.join(twice)} more than once")
    return names


def upload_headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files below ``path`` by their first line.  What reaches the driver is a line and a name for each file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                         F.monotonically_increasing_id().alias("n")).where("at = 0")
    out: dict[str, list[str]] = {}
    for r in lines.groupBy("file").agg(F.min_by("value", "n").alias("line")).orderBy("file").collect():
        out.setdefault(r["line"], []).append(r["file"])
    return out


def read_upload(spark: SparkSession, path: str, sep: str | None = None, bad_col: str | None = None) -> DataFrame:
    """Delimited uploads: every column text, header upper-cased and trimmed, ``source_file`` for provenance.

    Each file counts by its own header and separator (sniffed, unless given): files of one header line are read
    together, and the columns of all are put side by side by name, NULL where a file has none.  With ``bad_col`` that
    column holds the line of a row that has another number of values than its header."""
    groups: dict[tuple, list[str]] = {}
    for line, files in upload_headers(spark, path).items():
        own = sep or sniff_separator(line)
        groups.setdefault((own, *_header_names(line, own)), []).extend(files)
    extra = [bad_col] if bad_col else []
    parts = []
    for (own, *names), files in groups.items():
        schema = StructType([StructField(n, StringType()) for n in [*names, *extra]])
        reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", own).option("mode", "PERMISSIVE")
        if bad_col:
            reader = reader.option("columnNameOfCorruptRecord", bad_col)
        # names come URL-encoded, and would be taken for patterns
        df = reader.csv([re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in files])
        parts.append(df.select(*[F.col(f"`{c}`") for c in df.columns], F.col("_metadata.file_name").alias("source_file")))
    if not parts:
        return spark.createDataFrame([], "source_file string")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint folder (never machine-local on a cluster)."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "restate-staging", f"{name}-{uuid.uuid4().hex}")


def write_image(df: DataFrame, name: str, partition_cols=()) -> DataFrame:
    """Materialise a computed image in a fresh staging directory and read it back."""
    p = scratch_path(df.sparkSession, name)
    w = df.write.mode("overwrite")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(p)
    return df.sparkSession.read.parquet(p)


def emit_triggers(processed: DataFrame, scope_col: str = "process_type", cob_col: str = "cobid",
                  ts_col: str = "process_date") -> DataFrame:
    """One downstream "rebuild" record per (scope, COB) with a deterministic id."""
    g = processed.groupBy(scope_col, cob_col).agg(F.max(ts_col).alias("triggered_at"),
                                                  F.count(F.lit(1)).alias("restatements"))
    return g.withColumn("trigger_id", F.md5(F.concat_ws("-", F.col(scope_col), F.col(cob_col).cast("string"))))


@dataclass(frozen=True)
class ScopeConfig:
    spec: ScopeSpec
    fact_path: str
    delta_path: str
    combined: bool = True


def load_scope(config_path: str, name: str) -> ScopeConfig:
    """Scope settings from a JSON file (scope names matched case-insensitively)."""
    with open(config_path) as fh:
        data = json.load(fh)
    for entry in data["scopes"]:
        if entry["name"].lower() == name.lower():
            spec = ScopeSpec(name=entry["name"], position_cols=tuple(entry["position_cols"]),
                             metric_local=entry.get("metric_local"), metric_usd=entry["metric_usd"],
                             summary_cols=tuple(entry.get("summary_cols", ())),
                             filter_map=dict(entry.get("filter_map", {})))
            return ScopeConfig(spec, entry["fact_path"], entry["delta_path"], entry.get("combined", True))
    raise KeyError(f"unknown scope {name!r}")
