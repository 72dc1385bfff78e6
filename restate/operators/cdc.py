"""Change-data-capture: classify a change batch, merge it into a target, turn
rows missing from a re-sent file into deletes, keep the latest version.

The merge is a full-outer join on the key (NULL-safe, hash-joinable) producing
the next image.  ``merge_image`` keeps an image in hash buckets of the key, reads and
writes only the buckets that a batch touches and publishes them in one commit; a batch
that is there already is not merged again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restate.session import cut_lineage
from restate.sources.manifest import Change, Tables, bucket_id


def classify(batch: DataFrame, keys, values, action_col: str = "action", seq_col: str | None = None) -> DataFrame:
    """The net change of each key within one batch of DELETE and INSERT images.

    Only deleted -> 'D'; only inserted -> 'I'; deleted and inserted with other
    values -> 'U' (new values); unchanged, or inserted and deleted again -> no row.

    A key may change several times in a batch: ``seq_col`` then orders its changes
    (an update's DELETE comes before its INSERT of the same number), and the first
    image and the last decide.  Without it a key with two images of one kind has no
    defined result and the query fails.  One aggregation on the key, which counts
    null keys as one key; no join.
    """
    kind = F.upper(F.col(action_col))
    rank = F.when(kind == "DELETE", F.lit(0)).otherwise(F.lit(1))
    order = F.struct(*([F.col(seq_col)] if seq_col else []), rank)
    image = F.struct(kind.alias("_kind"), *[F.col(v).alias(v) for v in values])
    net = batch.where(kind.isin("DELETE", "INSERT")).groupBy(*keys).agg(
        F.min_by(image, order).alias("_first"), F.max_by(image, order).alias("_last"),
        F.greatest(F.count_if(kind == "DELETE"), F.count_if(kind == "INSERT")).alias("_n"))
    if seq_col is None:
        repeated = F.raise_error(F.lit("several changes of a key in one batch: name the column that orders them"))
        net = net.withColumn("_first", F.when(F.col("_n") > 1, repeated.cast(net.schema["_first"].dataType)).otherwise(F.col("_first")))
    had, has = F.col("_first._kind") == "DELETE", F.col("_last._kind") == "INSERT"
    same = reduce(lambda x, y: x & y, [F.col(f"_first.{v}").eqNullSafe(F.col(f"_last.{v}")) for v in values], F.lit(True))
    change = F.when(had & ~has, "D").when(~had & has, "I").when(had & has & ~same, "U")
    out = net.select(*keys, *[F.when(has, F.col(f"_last.{v}")).otherwise(F.col(f"_first.{v}")).alias(v) for v in values],
                     change.alias("change_type"))
    return out.where(F.col("change_type").isNotNull())


def upsert(target: DataFrame, changes: DataFrame, keys, values, deleted_col: str = "is_deleted",
           on_delete: str = "soft") -> DataFrame:
    """Next image of ``target`` after applying classified changes.

    U -> new values; D -> soft delete (``on_delete='ignore'`` leaves the row);
    I -> insert, or resurrect a soft-deleted row with the new values.
    """
    t = target.select(*[F.col(c).alias("t_" + c) for c in [*keys, *values, deleted_col]], F.lit(True).alias("_in_target"))
    c = changes.select(*[F.col(x).alias("c_" + x) for x in [*keys, *values, "change_type"]])
    cond = reduce(lambda x, y: x & y, [F.col("t_" + k).eqNullSafe(F.col("c_" + k)) for k in keys])
    j = t.join(c, cond, "full_outer")
    ct = F.col("c_change_type")
    take_new = ct.isin("U", "I")
    if on_delete == "ignore":
        deleted = F.when(ct.isin("U", "I"), F.lit(False)).otherwise(F.coalesce(F.col("t_" + deleted_col), F.lit(False)))
    else:
        deleted = (F.when(ct == "D", F.lit(True)).when(ct.isin("U", "I"), F.lit(False))
                   .otherwise(F.col("t_" + deleted_col)))
    t_present = F.col("_in_target").isNotNull()
    out = j.select(*[F.coalesce(F.col("t_" + k), F.col("c_" + k)).alias(k) for k in keys],
                   *[F.when(take_new, F.col("c_" + v)).otherwise(F.col("t_" + v)).alias(v) for v in values],
                   deleted.alias(deleted_col),
                   F.when(~t_present & (ct == "I"), "INSERT").when(ct == "I", "RESURRECT").when(ct == "U", "UPDATE")
                   .when(ct == "D", "DELETE").otherwise("KEEP").alias("merge_action"))
    # a delete for a key the target never had is not materialised
    return out.where(t_present | (ct != "D"))


def merge_image(tables: Tables, name: str, batch: str, changes: DataFrame, keys, values, deleted_col: str = "is_deleted",
                buckets: int = 64, on_delete: str = "soft") -> bool:
    """Merge classified ``changes`` into the image ``name``; False if ``batch`` was merged before.

    Besides keys, values and ``deleted_col`` the image holds each row's last merge
    (``merge_action``, ``merge_batch``).  The number of buckets stays as the image was made with; it
    should follow the size of the image, so that a bucket is some hundred MB."""
    if tables.committed(batch):
        return False
    state = tables.state()
    note = f"{name}.buckets"
    buckets = state["notes"].get(note, buckets)
    columns = [*keys, *values, deleted_col]
    if name in state["tables"]:
        types = {f.name: f.dataType for f in tables.schema(name).fields}
        changes = changes.select(*[F.col(c).cast(types[c]).alias(c) for c in [*keys, *values]], "change_type")
    changes = cut_lineage(changes)
    # at most ``buckets`` names
    touched = [r[0] for r in changes.select(bucket_id(keys, buckets)).distinct().collect()]
    if name in state["tables"]:
        current = tables.read(name, touched)
    else:
        current = changes.select(*keys, *values).limit(0).withColumn(deleted_col, F.lit(False)).withColumns(
            {"merge_action": F.lit(""), "merge_batch": F.lit("")})
    merged = upsert(current.select(*columns), changes, keys, values, deleted_col, on_delete)
    before = current.select(*[F.col(k).alias("p_" + k) for k in keys], F.col("merge_action").alias("p_action"), F.col("merge_batch").alias("p_batch"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col("p_" + k)) for k in keys])
    kept = F.col("merge_action") == "KEEP"
    merged = merged.join(before, same, "left").select(*columns, F.when(kept, F.col("p_action")).otherwise(F.col("merge_action")).alias("merge_action"),
                                                      F.when(kept, F.col("p_batch")).otherwise(F.lit(batch)).alias("merge_batch"))
    return tables.commit(batch, {name: Change(merged, by=tuple(keys), buckets=buckets)}, {note: buckets})


def missing_as_delete(target: DataFrame, resend: DataFrame, keys, file_col: str) -> DataFrame:
    """Target rows of re-sent files whose key is absent from the new version -> 'D'."""
    files = resend.select(F.col(file_col).alias("_rf")).distinct()
    scope = target.join(files, F.col(file_col) == F.col("_rf"), "left_semi")
    nk = resend.select(*[F.col(k).alias("_n_" + k) for k in keys])
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col("_n_" + k)) for k in keys])
    return scope.join(nk, cond, "left_anti").withColumn("change_type", F.lit("D"))


def latest_version(batch: DataFrame, keys, ts_col: str, keep_ties: bool = True) -> DataFrame:
    """Rows at the latest stage timestamp per key (ties kept, like rank() = 1)."""
    latest = batch.groupBy(*keys).agg(F.max(ts_col).alias("_mx"))
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col("_l_" + k)) for k in keys]) & (F.col(ts_col) == F.col("_mx"))
    l2 = latest.select(*[F.col(k).alias("_l_" + k) for k in keys], "_mx")
    out = batch.join(l2, cond, "left_semi")
    if not keep_ties:
        w = Window.partitionBy(*keys).orderBy(F.col(ts_col).desc())
        out = out.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return out


def changed_vs(new: DataFrame, current: DataFrame) -> DataFrame:
    """New images that differ from the current registry (set EXCEPT, NULL-safe)."""
    return new.subtract(current.select(*new.columns))
