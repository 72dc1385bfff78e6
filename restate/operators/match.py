"""Wildcard matching of fact rows against restatement requests.

A request filter that is NULL matches anything; a set filter must equal the fact
attribute case-insensitively.  ``a.c = f.c OR a.c IS NULL`` is not hash-joinable,
so the planner rewrites it:

* **active filters** — one tiny aggregate finds the filters some request sets;
  the others are dropped from the plan entirely.
* **signature join** — requests are grouped by *signature* (the set of filters
  they set).  For each signature in the batch a fact row produces one match key
  (the upper-cased attribute values of that signature joined by a separator),
  so the whole batch becomes ONE equi-join on ``(cob, signature, key)`` —
  broadcast-hash when the request side is provably small, otherwise a shuffle
  join.  A whole-COB request puts every fact row of that COB on a single key:
  ``hot_buckets`` counts the fact rows of every key in a sketch of fixed size, and each
  key is spread over as many tasks as its rows ask for.  Cold keys are not copied.
  Many signatures are joined ``SIGNATURES_PER_JOIN`` at a time, so that a fact row
  is never copied more often than that in one join.
* **residual** — equi on COB + OR residual; only on request, as the reference that
  the signature join is tested against.  Both return identical rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restate.session import cut_lineage

SEP = "\u0001"
SIGNATURES_PER_JOIN = 64
#: Fact rows of a match key that one task joins; counters of the sketch and hashes of a key in it.
PIECE_ROWS, SKETCH_WIDTH, SKETCH_DEPTH = 1_000_000, 1 << 15, 2
BROADCAST_MAX_ROWS, DIM_BROADCAST_ROWS, BROADCAST_MAX_BYTES = 200_000, 5_000_000, 128 << 20


def _norm(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def active_filters(headers: DataFrame, filter_cols) -> list[str]:
    """Filters at least one request sets (one aggregate over the request table)."""
    filter_cols = list(filter_cols)
    if not filter_cols:
        return []
    row = headers.agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in filter_cols]).first()
    return [c for c in filter_cols if row is not None and row[c] == 1]


def profile_requests(headers: DataFrame, filter_cols, flags: dict[str, Column] | None = None,
                     distinct_key: Column | None = None) -> dict:
    """ONE small aggregate over the request table giving everything the planner
    needs: active filters, distinct signatures (over the active filters), the row
    count, boolean flags (e.g. "has a cross-COB roll") and, per flag combination,
    the exact number of distinct ``distinct_key`` values (for proven size bounds)."""
    filter_cols = list(filter_cols)
    flags = flags or {}
    cols = [_signature(filter_cols).alias("_s")] + [c.alias(n) for n, c in flags.items()]
    aggs = [F.count(F.lit(1)).alias("_n")]
    if distinct_key is not None:
        aggs.append(F.countDistinct(distinct_key).alias("_nd"))
    rows = headers.groupBy(*cols).agg(*aggs).collect()
    mask = 0
    for r in rows:
        mask |= r["_s"]
    active = [c for i, c in enumerate(filter_cols) if mask & (1 << i)]
    pos = {c: i for i, c in enumerate(filter_cols)}
    sigs = sorted({sum(1 << j for j, c in enumerate(active) if r["_s"] & (1 << pos[c])) for r in rows})
    out = {"active": active, "sigs": sigs, "rows": sum(r["_n"] for r in rows),
           "groups": [r.asDict() for r in rows]}
    for n in flags:
        out[n] = any(bool(r[n]) for r in rows)
    return out


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + F.lit(16))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + F.lit(16))
        else:
            parts.append(F.lit(16))
    return reduce(lambda a, b: a + b, parts, F.lit(16))


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows and about ``max_bytes`` bytes in memory.

    One aggregate counts both where the rows lie; nothing but two numbers moves."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
    if n <= max_rows and size <= max_bytes:
        return F.broadcast(df), True
    return df, False


def lookup_qualified(df: DataFrame, ref: DataFrame, code_col: str, ref_code: str, qualifiers: dict[str, str], value: Column, out_col: str) -> DataFrame:
    """``df`` with ``out_col``: the aggregate ``value`` of the rows of ``ref`` with the row's code and those of its
    ``qualifiers`` (row column -> reference column) that it gives; NULL if there are none.

    Which qualifiers a row gives is its signature; the reference is grouped once for each signature it
    may meet, so every row meets one reference row by equality: no fan-out, no join of rows with themselves."""
    sigs = list(range(1 << len(qualifiers))) if len(qualifiers) <= 3 else sorted(r[0] for r in df.select(_signature(list(qualifiers)).alias("s")).distinct().collect())
    r = ref.withColumn("_rsig", F.explode(F.array(*[F.lit(x) for x in sigs]).cast("array<int>")))
    keys = [_norm(F.col(ref_code)).alias("_rc"), F.col("_rsig")]
    keys += [F.when(F.col("_rsig").bitwiseAND(F.lit(1 << i)) != 0, _norm(F.col(c))).otherwise(F.lit("")).alias(f"_rq{i}") for i, c in enumerate(qualifiers.values())]
    r = r.groupBy(*keys).agg(value.alias("_rv")).where(reduce(lambda a, b: a & b, [F.col(f"_rq{i}").isNotNull() for i in range(len(qualifiers))], F.col("_rc").isNotNull()))
    r, _ = sized_broadcast(r, DIM_BROADCAST_ROWS)
    cond = (_norm(F.col(code_col)) == F.col("_rc")) & (_signature(list(qualifiers)) == F.col("_rsig"))
    for i, c in enumerate(qualifiers):
        cond = cond & (F.coalesce(_norm(F.col(c)), F.lit("")) == F.col(f"_rq{i}"))
    return df.join(r, cond, "left").select(*df.columns, F.col("_rv").alias(out_col))


def _signature(active: list[str]) -> Column:
    bits = [F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(active)]
    return reduce(lambda a, b: a + b, bits, F.lit(0)).cast("int")


def _header_key(active: list[str]) -> Column:
    # concat_ws skips NULLs: exactly the set filters, in a fixed order.
    return F.concat_ws(SEP, *[_norm(F.col(c)) for c in active]) if active else F.lit("")


def _fact_key(sig: int, active: list[str], filter_map: dict[str, str]) -> Column:
    parts: list[Column] = []
    for i, c in enumerate(active):
        if sig & (1 << i):
            if parts:
                parts.append(F.lit(SEP))
            parts.append(_norm(F.col(filter_map[c])))
    # concat (not concat_ws): a NULL fact attribute never matches a set filter.
    return F.concat(*parts) if parts else F.lit("")


def _sketch_bucket(depth: int, *cols) -> Column:
    return F.pmod(F.xxhash64(F.lit(depth), *cols), F.lit(SKETCH_WIDTH)).cast("int")


def hot_buckets(keyed: DataFrame, key_cols, piece_rows: int | None = None) -> DataFrame:
    """(depth, bucket, pieces) of a sketch's counters above ``piece_rows``: a heavy-hitter sketch of the key.

    Every row counts in one bucket of each depth, so a key has at most as many rows as the least of its
    buckets counts.  The table has at most SKETCH_WIDTH x SKETCH_DEPTH rows whatever the data, and
    so do its partial sums."""
    piece_rows = piece_rows or PIECE_ROWS
    buckets = F.array(*[F.struct(F.lit(i).alias("depth"), _sketch_bucket(i, *key_cols).alias("bucket")) for i in range(SKETCH_DEPTH)])
    counted = keyed.select(F.explode(buckets).alias("_b")).groupBy("_b.depth", "_b.bucket").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > piece_rows).select("depth", "bucket", F.ceil(F.col("n") / piece_rows).cast("int").alias("pieces"))


def with_pieces(df: DataFrame, hot: DataFrame, key_cols, out_col: str) -> DataFrame:
    """How many tasks the key of each row is spread over: the least its buckets ask for, 1 if one of them is not hot."""
    found = []
    for i in range(SKETCH_DEPTH):
        h = hot.where(F.col("depth") == i).select(F.col("bucket").alias(f"_hb{i}"), F.col("pieces").alias(f"_hp{i}"))
        # at most SKETCH_WIDTH rows of two integers
        df = df.join(F.broadcast(h), _sketch_bucket(i, *key_cols) == F.col(f"_hb{i}"), "left")
        found.append(F.coalesce(F.col(f"_hp{i}"), F.lit(1)))
    return df.withColumn(out_col, F.least(*found)).drop(*[f"_hb{i}" for i in range(SKETCH_DEPTH)], *[f"_hp{i}" for i in range(SKETCH_DEPTH)])


def wildcard_match(
    facts: DataFrame,
    headers: DataFrame,
    filter_map: dict[str, str],
    fact_cob: str = "cobid",
    header_cob: str = "match_cob",
    strategy: str = "auto",
    broadcast_max_rows: int = BROADCAST_MAX_ROWS,
    active: list[str] | None = None,
    sigs: list[int] | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Return fact rows x matching requests (all fact columns + all header columns).

    ``filter_map`` maps header filter column -> fact attribute column.  Header
    columns must not collide with fact columns.  ``sigs``/``small`` may be passed
    when the caller already profiled the requests (saves planning jobs).
    """
    if active is None:
        active = active_filters(headers, filter_map.keys())
    hdr_cols = headers.columns
    if strategy == "residual":
        return _residual_match(facts, headers, filter_map, active, fact_cob, header_cob, broadcast_max_rows, small)
    if sigs is None:
        sigs = [r[0] for r in headers.select(_signature(active).alias("s")).distinct().collect()]
    sigs = sorted(sigs)
    if len(sigs) > SIGNATURES_PER_JOIN:
        parts = [sigs[i:i + SIGNATURES_PER_JOIN] for i in range(0, len(sigs), SIGNATURES_PER_JOIN)]
        return reduce(DataFrame.unionByName, [
            wildcard_match(facts, headers.where(_signature(active).isin(part)), filter_map, fact_cob, header_cob, "signature",
                           broadcast_max_rows, active, part, small) for part in parts])

    hk = headers.select("*", _signature(active).alias("_sig"), _header_key(active).alias("_key"))
    if small is None:
        hk, small = sized_broadcast(hk, broadcast_max_rows)
    elif small:
        hk = F.broadcast(hk)

    keys = [F.struct(F.lit(s).alias("sig"), _fact_key(s, active, filter_map).alias("key")) for s in sigs]
    fk = facts.select("*", F.explode(F.array(*keys)).alias("_mk"))
    fk = fk.select(*facts.columns, F.col("_mk.sig").alias("_fsig"), F.col("_mk.key").alias("_fkey")).where(
        F.col("_fkey").isNotNull()
    )
    hk = hk.withColumnRenamed("_sig", "_hsig").withColumnRenamed("_key", "_hkey")
    cond = [F.col(fact_cob) == F.col(header_cob), F.col("_fsig") == F.col("_hsig"), F.col("_fkey") == F.col("_hkey")]
    if not small:
        fkey, hkey = [fact_cob, "_fsig", "_fkey"], [header_cob, "_hsig", "_hkey"]
        # both sides hash alike only if their business dates have one type
        cob = headers.schema[header_cob].dataType
        fkey[0], hkey[0] = F.col(fact_cob).cast(cob), F.col(header_cob)
        hot = cut_lineage(hot_buckets(fk, fkey))
        # dealt by the row's own values: a replayed task deals alike
        fk = with_pieces(fk, hot, fkey, "_fpieces")
        fk = fk.withColumn("_fsalt", F.pmod(F.xxhash64(*facts.columns), F.col("_fpieces")).cast("int"))
        hk = with_pieces(hk, hot, hkey, "_hpieces").withColumn("_hsalt", F.explode(F.sequence(F.lit(0), F.col("_hpieces") - 1)))
        cond.append(F.col("_fsalt") == F.col("_hsalt"))
    joined = fk.join(hk, cond, "inner")
    return joined.select(*facts.columns, *hdr_cols)


def _residual_match(facts, headers, filter_map, active, fact_cob, header_cob, broadcast_max_rows, small=None):
    if small is None:
        h, _ = sized_broadcast(headers, broadcast_max_rows)
    else:
        h = F.broadcast(headers) if small else headers
    cond = F.col(fact_cob) == F.col(header_cob)
    for c in active:
        cond = cond & (F.col(c).isNull() | (_norm(F.col(c)) == _norm(F.col(filter_map[c]))))
    joined = facts.join(h, cond, "inner")
    return joined.select(*facts.columns, *headers.columns)


def enrich(facts: DataFrame, dim: DataFrame, key: str, attrs, dim_key: str | None = None,
           broadcast_max_rows: int = 5_000_000, small: bool | None = None) -> DataFrame:
    """Attach dimension attributes through a surrogate key (left join, no fan-out).

    ``dim`` must be unique on its key (current SCD rows).  A NULL fact key is
    looked up as -1.  Broadcast only behind a size check; otherwise shuffle.
    """
    dim_key = dim_key or key
    d = dim.select(F.col(dim_key).alias("_dk"), *[F.col(a).alias(f"_d_{a}") for a in attrs])
    if small is None:
        d, _ = sized_broadcast(d, broadcast_max_rows)
    elif small:
        d = F.broadcast(d)
    f = facts.withColumn("_fk", F.coalesce(F.col(key), F.lit(-1)))
    j = f.join(d, F.col("_fk") == F.col("_dk"), "left")
    return j.select(*facts.columns, *[F.col(f"_d_{a}").alias(a) for a in attrs])


def reduce_dim_for_requests(dim: DataFrame, requests: DataFrame, attr_to_filter: dict[str, str]) -> DataFrame:
    """Keep only dimension rows whose value for at least one used attribute occurs in
    some request's filter.

    Exact for wildcard matching: a fact row whose dimension row is dropped has, for
    every attribute of this dimension, a value no request asks for, so it cannot
    match any request that filters on this dimension (and requests that do not are
    unaffected).  Turns a huge dimension into the few rows the batch can touch, which
    then usually broadcasts.
    """
    parts = []
    for attr, fcol in attr_to_filter.items():
        vals = requests.select(_norm(F.col(fcol)).alias("_v")).where(F.col("_v").isNotNull()).distinct()
        parts.append(dim.join(vals, _norm(F.col(attr)) == F.col("_v"), "left_semi"))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.union(p_)
    return out.distinct() if len(parts) > 1 else out


def dim_semi_filter(facts: DataFrame, dim: DataFrame, key: str, conditions: dict[str, str],
                    dim_key: str | None = None) -> DataFrame:
    """EXISTS on a dimension through a key with literal OR-NULL attribute filters."""
    dim_key = dim_key or key
    d = dim
    for attr, value in conditions.items():
        if value is not None:
            d = d.where(_norm(F.col(attr)) == _norm(F.lit(value)))
    d = d.select(F.col(dim_key).alias("_dk")).distinct()
    return facts.join(d, F.coalesce(F.col(key), F.lit(-1)) == F.col("_dk"), "left_semi")


def in_subquery_filter(facts: DataFrame, dim: DataFrame, key: str, attr: str, value) -> DataFrame:
    """Legacy ``key IN (SELECT key FROM dim WHERE equal_null(attr, nvl(:v, attr)))``."""
    if value is None:
        d = dim.where(F.col(attr).eqNullSafe(F.col(attr)))
    else:
        d = dim.where(F.col(attr).eqNullSafe(F.lit(value)))
    return facts.join(d.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")


def value_list_filter(df: DataFrame, filters: dict) -> DataFrame:
    """Filter dict -> equality / IN-list; blank values and empty lists are ignored."""
    for c, v in filters.items():
        if v is None:
            continue
        vals = [x for x in (v if isinstance(v, (list, tuple, set)) else [v]) if str(x).strip() != ""]
        if vals:
            df = df.where(F.col(c).isin(vals))
    return df
