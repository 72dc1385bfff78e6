"""As-of join by forward carry.

A fact row gets the dimension version of its key that is effective on its date.  Version starts
and facts are laid out in one relation, ordered by date, and the last start is carried forward to
the facts: no range condition, no row id, every fact row moves once.

*Buckets.*  Dates are cut into ``BUCKETS`` ranges.  The carry runs within (key, bucket); what a key
brings into a bucket comes from a carry table, one row a key and bucket.

*Hot groups.*  A (key, bucket) of more than ``PIECE_ROWS`` facts is dealt by hash to pieces, each with its own
copy of that bucket's version starts, so neither a hot key nor a hot date is one task's.

*Layers.*  Versions may overlap.  Those whose end is not below the end of any earlier start form a layer, in
which the last start decides alone; the others form layers of their own in turn.  Effective-dated
dimensions have one layer.  A fact takes the latest start among the layers' versions that still last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restate.session import cut_lineage

BUCKETS = 32
#: Facts of a (key, bucket) that one task carries forward; and hot groups at most, which bounds what is broadcast.
PIECE_ROWS, HOT_GROUPS = 1_000_000, 50_000
FOREVER = (1 << 63) - 1


def _point(col: Column, kind: T.DataType) -> Column:
    """A date as a number that orders like it."""
    return col.cast("long") if isinstance(kind, T.IntegralType) else F.unix_micros(col.cast("timestamp"))


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def _with_nesting(v: DataFrame, group: list[str], order: list) -> DataFrame:
    """``_nested``: an earlier start of the key ends later.  Running maximum within buckets, carried between them."""
    key, bucket = group[:-1], group[-1]
    tops = v.groupBy(*group).agg(F.max("_until").alias("_top"))
    before = Window.partitionBy(*key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*[F.col(c).alias(f"_n{c}") for c in group], F.max("_top").over(before).alias("_carried"))
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    j = v.join(tops, _same(group, [f"_n{c}" for c in group]))
    return j.withColumn("_nested", F.coalesce(F.greatest("_carried", F.max("_until").over(inside)) > F.col("_until"), F.lit(False))).select(*v.columns, "_nested")


def _layered(v: DataFrame, group: list[str], order: list) -> list[DataFrame]:
    layers, rest = [], v
    while True:
        marked = cut_lineage(_with_nesting(rest, group, order))
        layers.append(marked.where(~F.col("_nested")).select(*v.columns))
        rest = marked.where("_nested").select(*v.columns)
        if not rest.take(1):
            return layers


def asof_join(df: DataFrame, versions: DataFrame, keys: dict[str, str], date_col: str, start_col: str,
              end_col: str | None, take: dict[str, str], end_exclusive: bool = True, order_cols=()) -> DataFrame:
    """``df`` with the columns ``take`` (output name -> version column) of the version effective on ``date_col``.

    ``keys`` maps a column of ``df`` to the version's.  A version lasts from its start to its end (which
    it does not include, unless ``end_exclusive`` is False), without an end for good; with ``end_col=None``
    until the next start of its key.  Of several the latest start counts, then the latest end, then the
    largest ``order_cols``.  Every row of ``df`` comes back once, with NULLs where no version lasts, its key
    or its date is NULL.  Versions without key or start count for nothing; empty tables are fine.
    Dates are dates, timestamps or whole numbers."""
    at, start = df.schema[date_col].dataType, versions.schema[start_col].dataType
    key, group = [f"_k{i}" for i in range(len(keys))], [*(f"_k{i}" for i in range(len(keys))), "_bucket"]
    v = versions.select(*[F.col(c).alias(k) for c, k in zip(keys.values(), key)], _point(F.col(start_col), start).alias("_t"),
                        (_point(F.col(end_col), start) if end_col else F.lit(None).cast("long")).alias("_end"),
                        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)],
                        F.struct(*[F.col(c).alias(o) for o, c in take.items()]).alias("_take"))
    v = v.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*key, "_t"]]))
    v = v.withColumn("_until", F.coalesce("_end", F.lit(FOREVER)))
    span = v.agg(F.min("_t"), F.max("_t")).first()
    low = span[0] or 0
    width = max(1, -(-((span[1] or 0) - low + 1) // BUCKETS))

    def bucket(t: str) -> Column:
        """Before the first start -1; the last bucket goes on for good."""
        return F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(-1), F.floor((F.col(t) - F.lit(low)) / F.lit(width)))).cast("int")

    v = v.withColumn("_bucket", bucket("_t"))
    order = ["_t", "_until", *[f"_o{i}" for i in range(len(order_cols))]]
    layers = _layered(v, group, order) if end_col else [v]
    slots = [f"_c{i}" for i in range(len(layers))]
    version = F.struct(F.col("_t").alias("since"), F.col("_end").alias("until"), F.col("_take").alias("take"))
    tagged = reduce(DataFrame.unionByName, [x.withColumn("_layer", F.lit(i)).withColumn("_v", version) for i, x in enumerate(layers)])

    facts = df.select(*[F.col(c).alias(k) for c, k in zip(keys, key)], _point(F.col(date_col), at).alias("_t"),
                      F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    facts = facts.withColumn("_bucket", bucket("_t"))
    # narrow (a row a key and bucket) and asked three times, so it is written once
    counts = cut_lineage(facts.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")))
    piece_rows = max(PIECE_ROWS, -(-(counts.agg(F.sum("_n")).first()[0] or 0) // HOT_GROUPS))
    # no more than HOT_GROUPS rows: each stands for at least piece_rows facts
    hot = counts.where(F.col("_n") > piece_rows).select(*[F.col(c).alias(f"_h{c}") for c in group], F.ceil(F.col("_n") / piece_rows).cast("int").alias("_pieces"))
    hot = F.broadcast(hot)
    match_hot = _same(group, [f"_h{c}" for c in group])
    facts = facts.join(hot, match_hot, "left").withColumn("_piece", F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64("_row"), F.col("_pieces"))).otherwise(0).cast("int"))

    # what each key brings into a bucket: the last version of earlier buckets, layer by layer
    last = tagged.groupBy(*group).agg(*[F.max_by(F.when(F.col("_layer") == i, F.col("_v")), F.when(F.col("_layer") == i, F.struct(*order))).alias(s)
                                        for i, s in enumerate(slots)])
    known = counts.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in group]))
    places = known.select(*group, F.lit(True).alias("_asked")).unionByName(last.select(*group, *slots), allowMissingColumns=True)
    places = places.groupBy(*group).agg(F.max("_asked").alias("_asked"), *[F.first(s, ignorenulls=True).alias(s) for s in slots])
    before = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.select(*group, "_asked", *[F.last(s, ignorenulls=True).over(before).alias(s) for s in slots])
    carried = carried.where(F.col("_asked") & reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in slots]))

    def in_pieces(x: DataFrame) -> DataFrame:
        x = x.join(hot, match_hot, "left")
        return x.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1)))

    starts = in_pieces(tagged.select(*group, *order, *[F.when(F.col("_layer") == i, F.col("_v")).alias(s) for i, s in enumerate(slots)]))
    rows = [in_pieces(carried).select(*group, "_piece", F.lit(0).alias("_kind"), *slots),
            starts.select(*group, "_piece", F.lit(1).alias("_kind"), *order, *slots),
            facts.select(*group, "_piece", F.lit(2).alias("_kind"), "_t", "_row")]
    line = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    # carried versions first; at one date starts come before facts
    front = [F.when(F.col("_kind") == 0, 0).otherwise(1), "_t", "_kind", *order[1:]]
    run = Window.partitionBy(*group, "_piece").orderBy(*front).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = line.select("_kind", "_t", "_row", *[F.last(s, ignorenulls=True).over(run).alias(s) for s in slots]).where("_kind = 2")

    def lasting(s: str) -> Column:
        until = F.col(f"{s}.until")
        return F.when(until.isNull() | ((F.col("_t") < until) if end_exclusive else (F.col("_t") <= until)), F.col(s))

    rank = F.array_max(F.array(*[F.when(lasting(s).isNotNull(), F.struct(F.col(f"{s}.since"), F.coalesce(f"{s}.until", F.lit(FOREVER)), F.lit(i + 1).alias("slot")))
                                 for i, s in enumerate(slots)]))
    chosen = F.element_at(F.array(*[F.col(s) for s in slots]), rank["slot"])
    held = held.select("_row", chosen.alias("_v"))
    return held.select(*[F.col("_row")[c].alias(c) for c in df.columns], *[F.col("_v.take")[o].alias(o) for o in take])
