"""Scale / Flatten / Roll: the main restatement path.

    match -> legs -> net per (position, restatement) -> newest restatement wins

Legs (all UNION ALL, then netted):
  1. same-COB Scale/Flatten: original(target) x effective factor (f-1, or -1)
  2. cross-COB Roll, source: combined(source) x f   (original + existing deltas)
  3. cross-COB Roll, target: original(target) x -1
so that  combined(target) = f x combined(source)  position by position, with
source-only positions carried over and target-only positions flattened.

Physical plan: ONE scan of the fact (plus the small delta table when a roll is
present), ONE equi-join against the request legs (broadcast when provably small,
otherwise a shuffle that splits hot keys by their size).  With broadcast legs the
fact is shuffled once, by position without its business date, before it meets
them: legs change nothing but the date, so netting and ranking find theirs in one
task and no leg is moved.  Otherwise legs take two partial-aggregated shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restate.functions.factor import FACTOR_TYPE, VALUE_TYPE, effective_factor
from restate.operators.delta import net_positions, ordinal, rank_latest
from restate.operators.match import BROADCAST_MAX_ROWS, _header_key, _signature, profile_requests, wildcard_match

#: Fact rows that one task nets and ranks; beyond SMALL_FACT of them the number of tasks is set by it.
POSITION_ROWS, SMALL_FACT = 200_000, 1_000_000
HEADER_COLS = ("restatement_id", "cobid", "source_cobid", "restatement_type", "scale_factor", "created_date")


def request_legs(headers: DataFrame, filter_cols) -> DataFrame:
    """Requests -> match legs with (match_cob, leg, leg_factor); filters prefixed ``_f_``."""
    src = F.coalesce(F.col("source_cobid"), F.col("cobid"))
    base = headers.select(
        F.col("restatement_id").alias("_h_adj"),
        F.col("cobid").cast("int").alias("_h_cob"),
        src.cast("int").alias("_h_src"),
        F.col("created_date").alias("_h_created"),
        ordinal("created_date", "restatement_id").alias("_h_ord"),
        effective_factor("restatement_type", "scale_factor", "cobid", src).alias("_h_eff"),
        *[F.col(c).alias(f"_f_{c}") for c in filter_cols],
    )
    cross = F.col("_h_src") != F.col("_h_cob")
    leg1 = base.where(~cross).select("*", F.col("_h_cob").alias("_h_match"), F.lit(1).alias("_h_leg"),
                                     F.col("_h_eff").alias("_h_factor"))
    leg2 = base.where(cross).select("*", F.col("_h_src").alias("_h_match"), F.lit(2).alias("_h_leg"),
                                    F.col("_h_eff").alias("_h_factor"))
    leg3 = base.where(cross).select("*", F.col("_h_cob").alias("_h_match"), F.lit(3).alias("_h_leg"),
                                    F.lit(-1).cast(FACTOR_TYPE).alias("_h_factor"))
    return leg1.unionByName(leg2).unionByName(leg3)


def has_cross_cob(headers: DataFrame) -> bool:
    """Existence probe (LIMIT 1): is any request a cross-COB roll?"""
    cross = F.col("source_cobid").isNotNull() & (F.col("source_cobid") != F.col("cobid"))
    return headers.where(cross).limit(1).count() > 0


def exact_products(fact: DataFrame, metrics) -> bool:
    """Whether value x factor never rounds: the value's and the factor's decimals fit into those of the result."""
    def decimals(kind) -> int | None:
        return kind.scale if isinstance(kind, T.DecimalType) else 0 if isinstance(kind, T.IntegralType) else None
    scales = [decimals(fact.schema[m].dataType) for m in metrics]
    return all(s is not None and s + decimals(T._parse_datatype_string(FACTOR_TYPE)) <= decimals(T._parse_datatype_string(VALUE_TYPE)) for s in scales)


def drop_dominated(legs_h: DataFrame, filter_cols, exact: bool = False) -> DataFrame:
    """Keep, per group of interchangeable request legs, only the newest request.

    Requests with the same leg type, COB(s), factor, signature and filter key
    match exactly the same positions and net to identical values there, so only
    the newest of them can ever win the per-position ranking; same-COB requests
    whose effective factor is 0 (or NULL) always net to zero and never win.
    Exact, and it turns "every fact row x every overlapping request" into at most
    one leg per fact row per group.

    With ``exact`` products (see ``exact_products``) a same-COB leg nets to its factor times the sum of
    the values: legs of different factors, none of them 0, net to zero on the same positions,
    so the factor does not split their groups.  Rounded products need not, and legs across
    business dates net against another leg: there it does.
    """
    cols = [f"_f_{c}" for c in filter_cols]
    dead = (F.col("_h_leg") == 1) & (F.col("_h_eff").isNull() | (F.col("_h_eff") == 0))
    live = legs_h.where(~dead)
    order = F.col("_h_ord")
    factor = F.when(F.col("_h_leg") != 1, F.col("_h_eff")) if exact else F.col("_h_eff")
    g = live.groupBy("_h_leg", "_h_match", "_h_cob", "_h_src", factor.alias("_g_eff"),
                     _signature(cols).alias("_g_sig"), _header_key(cols).alias("_g_key")) \
        .agg(*[F.max_by(F.col(c), order).alias(c) for c in legs_h.columns
               if c not in ("_h_leg", "_h_match", "_h_cob", "_h_src")])
    return g.select(*legs_h.columns)


def request_cobs(headers: DataFrame) -> list[int]:
    """Business dates that some request reads or writes (a calendar's worth of values at most).

    As a literal list they become a partition filter of the fact, ahead of every join."""
    both = F.array(F.col("cobid").cast("int"), F.coalesce("source_cobid", "cobid").cast("int"))
    rows = headers.select(F.explode(both).alias("c")).distinct().collect()
    return sorted(r["c"] for r in rows if r["c"] is not None)


def request_profile(headers: DataFrame, filter_cols) -> dict:
    """One planning job: active filters, signatures, row count, cross-COB presence."""
    cross = F.col("source_cobid").isNotNull() & (F.col("source_cobid") != F.col("cobid"))
    key = F.to_json(F.struct(F.col("cobid"), F.coalesce("source_cobid", "cobid").alias("s"),
                             F.lower("restatement_type").alias("t"), F.col("scale_factor").alias("f"),
                             *[F.upper(F.trim(F.col(c).cast("string"))).alias(c) for c in filter_cols]))
    prof = profile_requests(headers, filter_cols, {"has_cross": cross}, distinct_key=key)
    # request legs after dominance reduction: at most one per distinct request key
    # and leg, i.e. a proven bound from the same planning job
    prof["cobs"] = request_cobs(headers)
    prof["legs_bound"] = sum(g["_nd"] * (2 if g["has_cross"] else 1) for g in prof["groups"])
    return prof


def _by_position(rel: DataFrame, rows: int, key_cols) -> DataFrame:
    """``rel`` with the rows of equal ``key_cols`` in one task.

    The tasks of a large fact are as many as its rows ask for: what a task nets grows with the legs, so Spark must
    not merge partitions by the bytes of the rows that they hold before they meet the requests."""
    if rows <= SMALL_FACT:
        return rel.repartition(*key_cols)
    return rel.repartition(max(-(-rows // POSITION_ROWS), rel.sparkSession.sparkContext.defaultParallelism), *key_cols)


def fact_rows(fact: DataFrame, profile: dict, cob_col: str = "cobid") -> int:
    """Fact rows on the requests' business dates; as ``profile["fact_rows"]`` it is counted before dimensions are joined."""
    return (fact.where(F.col(cob_col).isin(profile["cobs"])) if "cobs" in profile else fact).count()


def scale_legs(fact: DataFrame, headers: DataFrame, filter_map: dict[str, str], position_cols,
               metrics, deltas: DataFrame | None = None, strategy: str = "auto",
               cob_col: str = "cobid", keep_leg: bool = False, dominated: bool = False,
               profile: dict | None = None, keep_order: bool = False, by_position: bool = False) -> DataFrame:
    """Matched, factor-applied leg rows (before netting).

    ``dominated=True`` first drops request legs that can never win the ranking
    (see ``drop_dominated``); the final deltas are unchanged, the leg count is not.
    ``by_position`` says that legs are grouped by position next.
    """
    if profile is None:
        profile = request_profile(headers, list(filter_map))
    filter_map = {c: filter_map[c] for c in profile["active"]}
    legs_h = request_legs(headers, list(filter_map))
    if dominated:
        legs_h = drop_dominated(legs_h, list(filter_map), exact_products(fact, metrics))
    fmap = {f"_f_{k}": v for k, v in filter_map.items()}
    attrs = sorted(set(filter_map.values()) - set(position_cols))
    rel_cols = [*position_cols, *attrs, *metrics]
    rel = fact.select(*rel_cols).withColumn("_is_delta", F.lit(False))
    if deltas is not None and profile["has_cross"]:
        rel = rel.unionByName(deltas.select(*rel_cols).withColumn("_is_delta", F.lit(True)))
    if "cobs" in profile:
        rel = rel.where(F.col(cob_col).isin(profile["cobs"]))
    # proven bound on the request side: legs per request, or distinct keys when reduced
    bound = profile.get("legs_bound") if dominated and "legs_bound" in profile else 3 * profile["rows"]
    small = True if bound <= BROADCAST_MAX_ROWS else None
    keys = [c for c in position_cols if c != cob_col]
    if by_position and small and keys:
        rel = _by_position(rel, profile["fact_rows"] if "fact_rows" in profile else fact_rows(fact, profile, cob_col), keys)
    m = wildcard_match(rel, legs_h, fmap, fact_cob=cob_col, header_cob="_h_match", strategy=strategy,
                       active=list(fmap), sigs=profile["sigs"], small=small)
    m = m.where((F.col("_h_leg") == 2) | ~F.col("_is_delta"))
    return m.select(
        F.col("_h_cob").alias(cob_col),
        F.col("_h_adj").alias("restatement_id"),
        F.col("_h_created").alias("restatement_created_timestamp"),
        *keys,
        *[(F.col(mc).cast(VALUE_TYPE) * F.col("_h_factor")).cast(VALUE_TYPE).alias(mc) for mc in metrics],
        *([F.col("_h_leg").alias("leg")] if keep_leg else []),
        *([F.col("_h_ord").alias("_ord")] if keep_order else []),
    )


def apply_scale(fact: DataFrame, headers: DataFrame, filter_map: dict[str, str], position_cols,
                metrics, usd_metric: str, deltas: DataFrame | None = None, strategy: str = "auto",
                rank_method: str = "aggregate", cob_col: str = "cobid", profile: dict | None = None) -> DataFrame:
    """Full Scale path -> one delta row per (position, winning restatement).

    Output columns: cob, restatement_id, restatement_created_timestamp, position
    columns, metrics (decimal(28,8)).
    """
    legs = scale_legs(fact, headers, filter_map, position_cols, metrics, deltas, strategy, cob_col, dominated=True,
                      profile=profile, keep_order=True, by_position=True)
    netted = net_positions(legs, list(position_cols), "restatement_id", metrics, usd_metric,
                           carry_max=("restatement_created_timestamp", "_ord"))
    ranked = rank_latest(netted, list(position_cols), "restatement_created_timestamp", "restatement_id", rank_method,
                         order_col="_ord")
    pos_wo_cob = [c for c in position_cols if c != cob_col]
    return ranked.select(cob_col, "restatement_id", "restatement_created_timestamp", *pos_wo_cob, *metrics)


def roll_guard(has_cross: bool, combined_available: bool) -> None:
    """Refuse a cross-COB roll without a distinct combined relation."""
    if has_cross and not combined_available:
        raise ValueError("cross-COB roll needs the combined (original + deltas) relation; "
                         "without it the roll would flatten the target instead of carrying the source")


def legacy_roll(fact: DataFrame, deltas: DataFrame, target_cob: int, source_cob: int, factor,
                key_cols, metrics, slice_filter=None, cob_col: str = "cobid") -> DataFrame:
    """Older roll: flatten target, copy base source, copy summed source deltas x factor."""
    def sl(df):
        return df.where(slice_filter) if slice_filter is not None else df
    keys = [c for c in key_cols if c != cob_col]
    t = sl(fact.where(F.col(cob_col) == target_cob)).select(*keys, *[(-F.col(m).cast(VALUE_TYPE)).alias(m) for m in metrics])
    s = sl(fact.where(F.col(cob_col) == source_cob)).select(
        *keys, *[(F.col(m).cast(VALUE_TYPE) * F.lit(factor).cast(FACTOR_TYPE)).cast(VALUE_TYPE).alias(m) for m in metrics])
    d = (sl(deltas.where(F.col(cob_col) == source_cob)).groupBy(*keys)
         .agg(*[(F.sum(F.col(m).cast(VALUE_TYPE)) * F.lit(factor).cast(FACTOR_TYPE)).cast(VALUE_TYPE).alias(m) for m in metrics]))
    out = reduce(lambda a, b: a.unionByName(b), [t.withColumn("leg", F.lit("flatten_target")),
                                                  s.withColumn("leg", F.lit("copy_source")),
                                                  d.withColumn("leg", F.lit("copy_source_restatements"))])
    return out.withColumn(cob_col, F.lit(target_cob))


def legacy_rolls(fact: DataFrame, deltas: DataFrame, rolls: DataFrame, key_cols, metrics,
                 cob_col: str = "cobid", entity_col: str = "entity_code") -> DataFrame:
    """``legacy_roll`` for every row of ``rolls`` (adj_key, cobid, source_cobid, entity_code, scale_factor) at once."""
    keys = [c for c in key_cols if c != cob_col]
    r = rolls.select(F.col("adj_key"), F.col("cobid").alias("_target"), F.col("source_cobid").alias("_source"),
                     F.upper("entity_code").alias("_ent"), F.col("scale_factor").cast(FACTOR_TYPE).alias("_f"))

    def sl(df: DataFrame, cob: str) -> DataFrame:
        return df.join(r, (F.col(cob_col) == F.col(cob)) & (F.upper(F.col(entity_col)) == F.col("_ent")))
    t = sl(fact, "_target").select("adj_key", "_target", *keys, *[(-F.col(m).cast(VALUE_TYPE)).alias(m) for m in metrics])
    s = sl(fact, "_source").select("adj_key", "_target", *keys, *[
        (F.col(m).cast(VALUE_TYPE) * F.col("_f")).cast(VALUE_TYPE).alias(m) for m in metrics])
    d = sl(deltas, "_source").groupBy("adj_key", "_target", "_f", *keys).agg(*[F.sum(F.col(m).cast(VALUE_TYPE)).alias(m) for m in metrics])
    d = d.select("adj_key", "_target", *keys, *[(F.col(m) * F.col("_f")).cast(VALUE_TYPE).alias(m) for m in metrics])
    out = reduce(lambda a, b: a.unionByName(b), [t.withColumn("leg", F.lit("flatten_target")),
                                                  s.withColumn("leg", F.lit("copy_source")),
                                                  d.withColumn("leg", F.lit("copy_source_restatements"))])
    return out.withColumnRenamed("_target", cob_col)


def legacy_steps(fact: DataFrame, steps: DataFrame, filter_map: dict[str, str], group_cols, metric: str, cob_col: str = "cobid") -> DataFrame:
    """For every step (adj_key, source_cobid, target_cobid, scale_factor, filters; an empty filter matches all) the slice of its
    source date, summed by ``group_cols`` and scaled, under its target date."""
    head = ["adj_key", "source_cobid", "target_cobid", "scale_factor", *filter_map]
    blank = [F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)).alias(f"_f_{c}") if c in filter_map else F.col(c).alias(f"_s_{c}") for c in head]
    # the fact is summed to what steps can tell apart before it meets them
    attrs = list(dict.fromkeys([cob_col, *group_cols, *filter_map.values()]))
    sums = fact.groupBy(*attrs).agg(F.sum(F.col(metric).cast(VALUE_TYPE)).alias("_sum"))
    met = wildcard_match(sums, steps.select(*blank), {f"_f_{c}": a for c, a in filter_map.items()}, fact_cob=cob_col, header_cob="_s_source_cobid")
    # exact sums first, one product after: the value's and the factor's decimals fit
    out = met.groupBy(F.col("_s_adj_key").alias("adj_key"), F.col("_s_target_cobid").alias("_target"), "_s_scale_factor", *group_cols).agg(F.sum("_sum").alias("_sum"))
    return out.select("adj_key", F.col("_target").alias(cob_col), *group_cols, (F.col("_sum").cast(VALUE_TYPE) * F.col("_s_scale_factor").cast(FACTOR_TYPE)).cast(VALUE_TYPE).alias(metric))
