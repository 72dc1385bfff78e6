"""Upload-side reshaping: payloads, typed extraction, unpivot, labels, headers,
row numbering — all native expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restate.operators.match import sized_broadcast
from restate.session import cut_lineage
from restate.spec import TENDAY_LABEL_EXCEPTIONS, TENDAY_SUFFIX


def row_numbers(df: DataFrame, group_cols, order_cols, out_col: str = "row_num",
                partitions: int | None = None) -> DataFrame:
    """Consecutive 1-based row numbers per group, without one task per group.

    A range shuffle on (group, order) splits even a single huge group over many
    tasks; each task numbers its slice locally, and a tiny per-(task, group)
    count table gives every slice its starting offset.  NULL groups are groups;
    ``order_cols`` are names (ascending, NULL first) or sort expressions.
    """
    group_cols = list(group_cols)
    order = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order_cols]
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The slice id must be fixed data before it is used twice (range bounds come
    # from sampling), so the ranged rows are checkpointed into the shared folder.
    ranged = cut_lineage(df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in group_cols], *order)
                         .withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", *group_cols).orderBy(*order)
    local = ranged.withColumn("_local", F.row_number().over(w))
    counts = ranged.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_cnt"))
    wo = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(wo), F.lit(0))).drop("_cnt")
    offsets, _ = sized_broadcast(offsets, 1_000_000)
    offsets = offsets.select("_off", *[F.col(c).alias(f"_o{c}") for c in ["_pid", *group_cols]])
    j = local.join(offsets, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in ["_pid", *group_cols]]), "left")
    return j.select(*df.columns, (F.col("_local") + F.col("_off")).cast("long").alias(out_col))


def to_payload(df: DataFrame, id_cols, payload_cols, out_col: str = "payload") -> DataFrame:
    """Each row -> one JSON object of the given columns (NULL fields dropped)."""
    return df.select(*id_cols, F.to_json(F.struct(*[F.col(c) for c in payload_cols])).alias(out_col))


def extract(df: DataFrame, payload_col: str, fields: dict[str, str], keep=()) -> DataFrame:
    """Typed field reads from a JSON payload, parsed once; unparseable values -> NULL."""
    texts = T.StructType([T.StructField(name, T.StringType()) for name in fields])
    parsed = df.select(*keep, F.from_json(F.col(payload_col), texts).alias("_json"))
    return parsed.select(*keep, *[F.col("_json")[name].alias(name) if dtype == "string" else F.col("_json")[name].try_cast(dtype).alias(name)
                                  for name, dtype in fields.items()])


def unpivot_measures(df: DataFrame, id_cols, measure_cols, name_col: str = "measure",
                     value_col: str = "value", labels: dict | None = None, drop_zero: bool = True) -> DataFrame:
    """Wide -> long over the measure columns (single scan); NULL/0 dropped; optional labels."""
    long = df.unpivot(list(id_cols), list(measure_cols), name_col, value_col)
    if drop_zero:
        long = long.where(F.col(value_col).isNotNull() & (F.col(value_col) != 0))
    if labels:
        m = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))])
        long = long.withColumn(name_col, F.coalesce(m[F.col(name_col)], F.col(name_col)))
    return long


def unpivot_by_union(df: DataFrame, id_cols, measure_cols, name_col="measure", value_col="value") -> DataFrame:
    """Same result as ``unpivot_measures`` written as one UNION ALL leg per measure."""
    legs = [df.select(*id_cols, F.lit(m).alias(name_col), F.col(m).alias(value_col)).where(
        F.col(value_col).isNotNull() & (F.col(value_col) != 0)) for m in measure_cols]
    return reduce(lambda a, b: a.unionByName(b), legs)


def tenday_label(name, tenday) -> Column:
    """Component label: underscores -> spaces, upper; ten-day rows get a suffix."""
    n = name if isinstance(name, Column) else F.col(name)
    t = tenday if isinstance(tenday, Column) else F.col(tenday)
    plain = F.upper(F.regexp_replace(n, "_", " "))
    ten = F.concat(plain, F.lit(TENDAY_SUFFIX))
    for k, v in TENDAY_LABEL_EXCEPTIONS.items():
        ten = F.when(n == k, F.lit(v + TENDAY_SUFFIX)).otherwise(ten)
    return F.when(t == "Y", ten).otherwise(plain)


def canonicalise(df: DataFrame, accepted: dict[str, str], required=()):
    """Map header names/aliases (case- and space-insensitive) to canonical names.

    Returns (renamed DataFrame, unknown columns, missing required, duplicates).
    """
    norm = {k.strip().upper().replace(" ", "_"): v for k, v in accepted.items()}
    mapping, unknown, seen, dups = {}, [], set(), []
    for c in df.columns:
        key = c.strip().upper().replace(" ", "_")
        target = norm.get(key)
        if target is None:
            unknown.append(c)
        elif target in seen:
            dups.append(c)
        else:
            seen.add(target)
            mapping[c] = target
    missing = [r for r in required if r not in seen]
    out = df.select(*[F.col(f"`{c}`").alias(t) for c, t in mapping.items()])
    return out, unknown, missing, dups


def array_sorted_list(df: DataFrame, group_cols, value_col: str, out_col: str) -> DataFrame:
    """Sorted list of values per group (``ARRAY_AGG ... WITHIN GROUP (ORDER BY)``)."""
    return df.groupBy(*group_cols).agg(F.array_sort(F.collect_list(value_col)).alias(out_col))


def explode_publish(df: DataFrame, json_col: str, keep=()) -> DataFrame:
    """JSON {"cobs": [...], "paths": {k: v}} -> one row per (cob, path key)."""
    schema = "struct<cobs:array<int>, paths:map<string,string>>"
    p = df.select(*keep, F.from_json(F.col(json_col), schema).alias("_p"))
    p = p.select(*keep, F.explode_outer("_p.cobs").alias("cobid"), F.col("_p.paths").alias("_m"))
    return p.select(*keep, "cobid", F.explode_outer("_m").alias("path_key", "path_value"))


def split_attributes(df: DataFrame, col: str, names, sep: str = "|") -> DataFrame:
    """Pipe-delimited attribute text -> one column per part (trimmed)."""
    parts = F.split(F.trim(F.col(col)), "\\" + sep if sep in "|.^$*+?()[]{}" else sep)
    return df.select("*", *[F.trim(parts.getItem(i)).alias(n) for i, n in enumerate(names)])
