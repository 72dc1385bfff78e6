"""Delta-row operators: netting, overlap ranking, supersession, combined view,
summaries and bookkeeping.

Invariant maintained by every operator here::

    combined(position) = original(position) + sum(delta(position, restatement))

All operators are DataFrame -> DataFrame and keep the work distributed; the only
shuffles are the grouping keys named in each docstring.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restate.operators.match import sized_broadcast
from restate.session import cut_lineage
from restate.spec import default_for


def _sum_cols(metrics, dtype=None):
    out = []
    for m in metrics:
        s = F.sum(F.col(m))
        out.append((s.cast(dtype) if dtype else s).alias(m))
    return out


def net_positions(legs: DataFrame, key_cols, adj_col: str, metrics, usd_metric: str,
                  carry_max=(), carry_any=()) -> DataFrame:
    """One row per (position, restatement): SUM metrics, HAVING sum(usd) != 0.

    Shuffle on (position, restatement) with map-side partial sums, so a hot
    position is pre-aggregated before it is moved.  ``carry_max`` columns are
    taken with MAX (deterministic ANY_VALUE); ``carry_any`` with ``any_value``.
    """
    aggs = [F.sum(F.col(m)).alias(m) for m in metrics]
    aggs += [F.max(F.col(c)).alias(c) for c in carry_max]
    aggs += [F.any_value(F.col(c)).alias(c) for c in carry_any]
    out = legs.groupBy(*key_cols, adj_col).agg(*aggs)
    return out.where(F.col(usd_metric) != 0)


def rank_latest(netted: DataFrame, key_cols, created_col: str, adj_col: str,
                method: str = "aggregate", order_col: str | None = None) -> DataFrame:
    """Keep, per position, only the newest restatement (created desc, id desc).

    Equivalent to ``DENSE_RANK() ... = 1``: after netting there is exactly one row
    per (position, restatement) and ids are unique, so rank 1 is a single row.
    ``aggregate`` (default) uses ``max_by`` with partial aggregation — a position
    touched by thousands of requests never lands whole in one task; ``window``
    is the literal dense-rank form.
    """
    others = [c for c in netted.columns if c not in key_cols]
    if method == "window":
        w = Window.partitionBy(*key_cols).orderBy(F.col(created_col).desc_nulls_last(), F.col(adj_col).desc_nulls_last())
        return netted.withColumn("_rk", F.dense_rank().over(w)).where("_rk = 1").drop("_rk")
    # (created, id) packed losslessly into one decimal(38,0) ordinal so every
    # aggregate buffer is fixed-width: a partial HashAggregate, no sort.
    order = F.col(order_col) if order_col else ordinal(created_col, adj_col)
    best = netted.groupBy(*key_cols).agg(*[F.max_by(F.col(c), order).alias(c) for c in others])
    return best.select(*netted.columns)


def ordinal(created_col: str, adj_col: str) -> Column:
    """Exact total order of (created, id) as one decimal(38,0): NULL created sorts first.

    micros + 1e17 (any year up to ~5000) times 1e20, plus id + 2^63: < 1e38.
    """
    def big(v: int) -> Column:
        return F.lit(str(v)).cast("decimal(38,0)")
    micros = F.coalesce(F.unix_micros(F.col(created_col).cast("timestamp")), F.lit(-10**17 + 1)).cast("decimal(38,0)")
    hi = (micros + big(10**17)) * big(10**20)
    lo = F.col(adj_col).cast("decimal(38,0)") + big(2**63)
    return (hi + lo).cast("decimal(38,0)")


def positions_of(rows: DataFrame, key_cols) -> tuple[DataFrame, Column]:
    """The distinct positions of ``rows``, and the NULL-safe condition that another relation's rows are on one."""
    positions = rows.select(*[F.col(c).alias(f"_p_{c}") for c in key_cols]).distinct()
    return positions, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in key_cols])


def supersede(existing: DataFrame, batch_positions: DataFrame, key_cols, adj_col: str | None = None,
              batch_ids: DataFrame | None = None) -> DataFrame:
    """Drop existing delta rows at positions the new batch owns (NULL-safe key).

    ``<=>`` is an equi-join key in Spark, so this is a hash/sort-merge anti join,
    never a nested loop.  Rows of the batch's own ids are kept.
    """
    pos, cond = positions_of(batch_positions, key_cols)
    kept = existing.join(pos, cond, "left_anti")
    if batch_ids is not None and adj_col is not None:
        own = existing.join(batch_ids.select(F.col(adj_col).alias("_own")).distinct(),
                            F.col(adj_col) == F.col("_own"), "left_semi")
        kept = kept.unionByName(own.join(pos, cond, "left_semi"))
    return kept


#: Of a position filter: 64-bit words at most (a proven bound of what is broadcast, some 60 MB), keys a word, bits a key.
MAX_WORDS, KEYS_A_WORD, KEY_BITS = 1 << 20, 4, 4


def _word_and_mask(key_cols, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(*[F.col(c) for c in key_cols])
    second = F.xxhash64(h, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(KEY_BITS)]
    return F.pmod(h, F.lit(words)), reduce(lambda a, b: a.bitwiseOR(b), bits)


def position_filter(rows: DataFrame, key_cols) -> tuple[DataFrame, int]:
    """A Bloom filter of the positions of ``rows`` as a table (word, bits), and its number of words.

    A position sets its bits in one word.  The table has ``MAX_WORDS`` rows at most: beyond that more rows than
    need to pass the filter, and none that should is held back."""
    n = rows.count()
    words = min(MAX_WORDS, 1 << max(0, -(-n // KEYS_A_WORD) - 1).bit_length())
    word, mask = _word_and_mask(key_cols, words)
    return rows.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits")), words


def maybe_at(rows: DataFrame, filter_: tuple[DataFrame, int], key_cols, out_col: str) -> DataFrame:
    """``out_col``: whether the row's position may be in the filter; False is certain."""
    table, words = filter_
    word, mask = _word_and_mask(key_cols, words)
    j = rows.withColumn("_at", word).join(F.broadcast(table), F.col("_at") == F.col("_word"), "left")
    hit = F.coalesce(F.col("_bits").bitwiseAND(mask) == mask, F.lit(False))
    return j.select(*rows.columns, hit.alias(out_col))


def combined(fact: DataFrame, deltas: DataFrame, key_cols, metrics, aggregate: bool = True,
             flag_col: str | None = None, once: bool = False, slice_col: str | None = None) -> DataFrame:
    """original UNION ALL deltas (aligned by name), optionally summed per position.

    ``once`` says that the fact holds a position once (its grain).  Then only fact rows whose position may have
    deltas, by a Bloom filter of those, are shuffled and summed with them; all others are passed on as they
    are, and slices (``slice_col``, a calendar's worth of values) without deltas are not even asked.  ``deltas``
    is read three times then: give a stored table."""
    f = fact.select(*key_cols, *metrics)
    d = deltas.select(*key_cols, *metrics)
    if flag_col:
        f = f.withColumn(flag_col, F.lit(False))
        d = d.withColumn(flag_col, F.lit(True))
    if not aggregate:
        return f.unionByName(d)
    aggs = [F.sum(m).alias(m) for m in metrics]
    if flag_col:
        aggs.append(F.max(F.col(flag_col)).alias(flag_col))
    if not once:
        return f.unionByName(d).groupBy(*key_cols).agg(*aggs)
    # one type on both sides: the filter hashes values of a type
    types = {c: f.schema[c].dataType for c in key_cols}
    d = d.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in d.columns])
    places, untouched = position_filter(d, key_cols), None
    if slice_col:
        slices = [r[0] for r in d.select(slice_col).distinct().collect()]
        inside = F.coalesce(F.col(slice_col).isin([s for s in slices if s is not None]), F.lit(None in slices))
        untouched, f = f.where(~inside), f.where(inside)
    asked = maybe_at(f, places, key_cols, "_maybe")
    summed = asked.where("_maybe").drop("_maybe").unionByName(d).groupBy(*key_cols).agg(*aggs)
    alone = asked.where("NOT _maybe").drop("_maybe")
    if untouched is not None:
        alone = alone.unionByName(untouched)
    return summed.unionByName(alone.select(*[F.col(c).cast(summed.schema[c].dataType).alias(c) if c in metrics else F.col(c) for c in summed.columns]))


def summarise(deltas: DataFrame, summary_cols, metrics, nonzero_col: str | None = None) -> DataFrame:
    """Re-sum deltas to the summary grain (``GROUP BY ALL``); optional HAVING != 0."""
    out = deltas.groupBy(*summary_cols).agg(*[F.sum(m).alias(m) for m in metrics])
    if nonzero_col:
        out = out.where(F.col(nonzero_col) != 0)
    return out


def record_counts(headers: DataFrame, deltas: DataFrame, adj_col: str, delta_adj_col: str | None = None) -> DataFrame:
    """Rows written per restatement, zero-filled for requests that matched nothing."""
    delta_adj_col = delta_adj_col or adj_col
    counts = deltas.groupBy(F.col(delta_adj_col).alias("_a")).agg(F.count(F.lit(1)).alias("_n"))
    j = headers.join(counts, F.col(adj_col) == F.col("_a"), "left")
    return j.select(*headers.columns, F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("record_count"))


def zero_match_warning(counted: DataFrame, type_col="restatement_type", factor_col="scale_factor",
                       cob_col="cobid", src_col="source_cobid") -> DataFrame:
    """Processed with 0 rows, except a same-COB Scale by factor 1 (a legitimate no-op)."""
    same = F.col(src_col).isNull() | (F.col(src_col) == F.col(cob_col))
    noop = (F.lower(F.col(type_col)) == "scale") & (F.col(factor_col) == 1) & same
    return counted.where((F.col("record_count") == 0) & ~noop)


def align(df: DataFrame, target_columns, types: dict | None = None) -> DataFrame:
    """Select the columns ``df`` has, default the rest (-1 for *_KEY/*_ID, else NULL)."""
    have = set(df.columns)
    types = types or {}
    cols = []
    for c in target_columns:
        if c in have:
            e = F.col(c)
        else:
            d = default_for(c)
            e = F.lit(d)
        if c in types:
            e = e.cast(types[c])
        cols.append(e.alias(c))
    return df.select(*cols)


def nonzero(df: DataFrame, metric: str) -> DataFrame:
    """Drop rows whose metric is 0 or NULL."""
    return df.where(F.col(metric) != 0)


def group_totals(df: DataFrame, key_cols, totals: dict[str, Column]) -> DataFrame:
    """``df`` with the aggregates ``totals`` of each row's key (NULL keys are keys).

    Partial sums meet, not the rows of a key: a hot key is summed by many tasks, and the join that
    brings its total back may split it."""
    sums = df.groupBy(*key_cols).agg(*[c.alias(f"_t_{n}") for n, c in totals.items()])
    sums = sums.select(*[F.col(c).alias(f"_k_{c}") for c in key_cols], *[f"_t_{n}" for n in totals])
    j = df.join(sums, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key_cols]))
    return j.select(*df.columns, *[F.col(f"_t_{n}").alias(n) for n in totals])


def share_repeated(df: DataFrame, key_cols, cols) -> DataFrame:
    """Rows of one key, where a key is repeated, take the largest of each of ``cols`` among them.

    Only keys and ``cols`` are shuffled to find the repeated ones, which are few where keys are meant to be unique:
    then they are broadcast and the rows stay where they are.  ``df`` is read twice."""
    again = df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(f"_m_{c}") for c in cols]).where("_n > 1")
    again = cut_lineage(again.select(*[F.col(k).alias(f"_k_{k}") for k in key_cols], *[f"_m_{c}" for c in cols]))
    again, _ = sized_broadcast(again)
    j = df.join(again, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k_{k}") for k in key_cols]), "left")
    return j.select(*[F.coalesce(f"_m_{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns])


def group_zero_flag(df: DataFrame, key_cols, metric: str, flag: str = "all_zero") -> DataFrame:
    """Per-key flag: SUM(ABS(metric)) over the key is 0."""
    return group_totals(df, key_cols, {flag: F.coalesce(F.sum(F.abs(F.col(metric))), F.lit(0)) == 0})


def reverse(items: DataFrame, adj_col: str, old_id, new_id, metrics) -> DataFrame:
    """Negated copy of one restatement's rows under a new id."""
    src = items.where(F.col(adj_col) == F.lit(old_id))
    return src.select(*[
        (F.lit(new_id).cast(items.schema[adj_col].dataType).alias(c) if c == adj_col
         else (-F.col(c)).alias(c) if c in metrics else F.col(c))
        for c in items.columns
    ])


def reverse_all(items: DataFrame, reversals: DataFrame, adj_col: str, metrics, old_col: str = "old_id", new_col: str = "new_id") -> DataFrame:
    """Negated copies of the rows of every restatement that ``reversals`` names, under its new id; one that is named twice
    gives a copy for each new id, one without rows none."""
    r = reversals.select(F.col(old_col).alias("_old"), F.col(new_col).cast(items.schema[adj_col].dataType).alias("_new")).distinct()
    hit = items.join(r, F.col(adj_col) == F.col("_old"))
    return hit.select(*[F.col("_new").alias(c) if c == adj_col else (-F.col(c)).alias(c) if c in metrics else F.col(c) for c in items.columns])


def remove_ids(deltas: DataFrame, ids: DataFrame, adj_col: str, ids_col: str | None = None) -> DataFrame:
    """Remove every row of the given restatement ids (retry cleanup / delete)."""
    ids_col = ids_col or adj_col
    k = ids.select(F.col(ids_col).alias("_rid")).distinct()
    return deltas.join(k, F.col(adj_col) == F.col("_rid"), "left_anti")


def clone_items(items: DataFrame, adj_col: str, old_id, new_id) -> DataFrame:
    return items.where(F.col(adj_col) == F.lit(old_id)).withColumn(adj_col, F.lit(new_id))


def union_all(dfs, allow_missing: bool = True) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def tag_union(frames: dict[str, DataFrame], tag_col: str = "scope") -> DataFrame:
    """Tag each relation with its name and union them (missing columns -> NULL)."""
    return union_all([df.withColumn(tag_col, F.lit(name)) for name, df in frames.items()])
