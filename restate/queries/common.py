"""Shared pieces for registered queries: attribute enrichment, scale plan, SQL twins."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restate.operators.match import active_filters, enrich, reduce_dim_for_requests, sized_broadcast
from restate.plans.process import Scope
from restate.plans.scale import apply_scale, fact_rows, request_profile
from restate.queries import standin as S

DIM_BROADCAST_ROWS = 5_000_000
DIM_ATTRS = {
    "book_dim": ("book_key", ("entity_code", "department_code", "book_code")),
    "instrument_dim": ("instrument_key", ("instrument_code", "product_type")),
    "trade_dim": ("trade_key", ("strategy", "trade_typology")),
}


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def attach_attrs(df: DataFrame, views: dict[str, DataFrame], needed, requests: DataFrame | None = None) -> DataFrame:
    """Enrich with only the dimensions whose attributes are needed.

    With ``requests``, each dimension is first reduced to the rows whose attribute
    values some request filters on (exact for matching; see ``reduce_dim_for_requests``)."""
    needed = set(needed)
    for dim, (key, attrs) in DIM_ATTRS.items():
        use = [a for a in attrs if a in needed]
        if use:
            d = views[dim].select(key, *use)
            small = _memo(("dimsmall", id(d.sparkSession), d.semanticHash(), DIM_BROADCAST_ROWS),
                          lambda: sized_broadcast(d, DIM_BROADCAST_ROWS)[1])
            if not small and requests is not None:
                # a dimension too large to broadcast: keep only rows some request can hit
                inv = {a: f for f, a in S.FILTER_MAP.items()}
                df = enrich(df, reduce_dim_for_requests(d, requests, {a: inv[a] for a in use}), key, use)
            else:
                df = enrich(df, d, key, use, small=small)
    return df


_PLANS: dict = {}


def clear_cache() -> None:
    """Forget memoised (lazy) plans — the bench calls this before every timed run."""
    _PLANS.clear()


def _memo(key, build):
    """Memoise a lazy DataFrame plan per session and table folder, so one query build
    never profiles or plans the same request batch twice (no data is cached)."""
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


#: The stand-in scope as settings of the composed run.
SCOPE = Scope(S.POSITION_COLS, S.METRICS, S.USD, S.FILTER_MAP, ("cobid", "restatement_id", "source_system_code", "currency_code"))


def run_scale(spark: SparkSession, sf_dir: str, hdr: str, with_prior: bool = True,
              rank_method: str = "aggregate", strategy: str = "auto") -> DataFrame:
    key = ("scale", id(spark), sf_dir, hdr, with_prior, rank_method, strategy)
    return _memo(key, lambda: _run_scale(spark, sf_dir, hdr, with_prior, rank_method, strategy))


def _run_scale(spark: SparkSession, sf_dir: str, hdr: str, with_prior: bool,
               rank_method: str, strategy: str) -> DataFrame:
    v = S.register(spark, sf_dir, ["fact", "book_dim", "instrument_dim", "trade_dim", hdr, "hdr_prior"])
    headers = v[hdr]
    prof = request_profile(headers, S.FILTER_COLS)
    prof["fact_rows"] = fact_rows(v["fact"], prof)
    deltas = prior_deltas(spark, sf_dir, v) if with_prior and prof["has_cross"] else None
    fmap = {c: S.FILTER_MAP[c] for c in prof["active"]}
    fact = attach_attrs(v["fact"], v, fmap.values(), requests=headers)
    d_attr = attach_attrs(deltas, v, fmap.values(), requests=headers) if deltas is not None else None
    return apply_scale(fact, headers, fmap, S.POSITION_COLS, S.METRICS, S.USD, deltas=d_attr,
                       strategy=strategy, rank_method=rank_method, profile=prof)


def prior_deltas(spark: SparkSession, sf_dir: str, v=None) -> DataFrame:
    """The existing delta table: the prior request batch applied to the fact."""
    return _memo(("prior", id(spark), sf_dir), lambda: _prior_deltas(spark, sf_dir, v))


def _prior_deltas(spark: SparkSession, sf_dir: str, v=None) -> DataFrame:
    v = v or S.register(spark, sf_dir, ["fact", "book_dim", "instrument_dim", "trade_dim", "hdr_prior"])
    headers = v["hdr_prior"]
    prof = request_profile(headers, S.FILTER_COLS)
    prof["fact_rows"] = fact_rows(v["fact"], prof)
    fmap = {c: S.FILTER_MAP[c] for c in prof["active"]}
    fact = attach_attrs(v["fact"], v, fmap.values(), requests=headers)
    return apply_scale(fact, headers, fmap, S.POSITION_COLS, S.METRICS, S.USD, profile=prof)


def doubles(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


# ---------------------------------------------------------------------------
# SQL twins (DuckDB) of the scale plan
# ---------------------------------------------------------------------------
POS_NO_COB = [c for c in S.POSITION_COLS if c != "cobid"]


def _wild(h: str, r: str, fmap: dict[str, str] = S.FILTER_MAP) -> str:
    return " AND ".join(
        f"({h}.{c} IS NULL OR upper(trim(CAST({h}.{c} AS VARCHAR))) = upper(trim(CAST({r}.{a} AS VARCHAR))))"
        for c, a in fmap.items())


def _attrs(src: str, alias: str) -> str:
    return f"""{alias} AS (SELECT x.*, b.entity_code, b.department_code, b.book_code, i.instrument_code, i.product_type,
       t.strategy, t.trade_typology
FROM {src} x
LEFT JOIN book_dim b ON coalesce(x.book_key, -1) = b.book_key
LEFT JOIN instrument_dim i ON coalesce(x.instrument_key, -1) = i.instrument_key
LEFT JOIN trade_dim t ON coalesce(x.trade_key, -1) = t.trade_key)"""


def scale_ctes(p: str, hdr: str, deltas_attr: str | None, fact_attr: str = "fa", pos=POS_NO_COB, metrics=S.METRICS,
               usd: str = S.USD, fmap: dict[str, str] = S.FILTER_MAP) -> list[str]:
    """CTEs {p}_legs, {p}_net, {p}_ranked, {p}_out for one request batch over the relation ``fact_attr``."""
    key = ", ".join(f"r.{c}" for c in pos)
    key_plain = ", ".join(pos)
    rel = f"SELECT {fact_attr}.*, FALSE AS is_delta FROM {fact_attr}"
    if deltas_attr:
        cols = ", ".join(dict.fromkeys(["cobid", *pos, *metrics, *fmap.values()]))
        rel = (f"SELECT {cols}, FALSE AS is_delta FROM {fact_attr} UNION ALL "
               f"SELECT {cols}, TRUE AS is_delta FROM {deltas_attr}")
    scaled = ",\n".join(f"   CAST(CAST(r.{m} AS DECIMAL(28,8)) * h.lf AS DECIMAL(28,8)) AS {m}" for m in metrics)
    sums = ", ".join(f"sum({m}) AS {m}" for m in metrics)
    return [
        f"""{p}_h AS (SELECT *, coalesce(source_cobid, cobid) AS src,
   CAST(CASE WHEN lower(restatement_type) = 'flatten' THEN -1
             WHEN lower(restatement_type) IN ('scale', 'roll') THEN
                  CASE WHEN coalesce(source_cobid, cobid) <> cobid THEN CAST(scale_factor AS DECIMAL(12,4))
                       ELSE CAST(scale_factor AS DECIMAL(12,4)) - 1 END
             ELSE 0 END AS DECIMAL(12,4)) AS eff
  FROM {hdr})""",
        f"""{p}_hl AS (SELECT *, cobid AS match_cob, 1 AS leg, eff AS lf FROM {p}_h WHERE src = cobid
  UNION ALL SELECT *, src AS match_cob, 2 AS leg, eff AS lf FROM {p}_h WHERE src <> cobid
  UNION ALL SELECT *, cobid AS match_cob, 3 AS leg, CAST(-1 AS DECIMAL(12,4)) AS lf FROM {p}_h WHERE src <> cobid)""",
        f"""{p}_rel AS ({rel})""",
        f"""{p}_legs AS (SELECT h.cobid, h.restatement_id, h.created_date AS restatement_created_timestamp, {key},
{scaled}, h.leg
  FROM {p}_rel r JOIN {p}_hl h ON r.cobid = h.match_cob AND (h.leg = 2 OR NOT r.is_delta) AND {_wild('h', 'r', fmap)})""",
        f"""{p}_net AS (SELECT cobid, {key_plain}, restatement_id,
   max(restatement_created_timestamp) AS restatement_created_timestamp, {sums}
  FROM {p}_legs GROUP BY cobid, {key_plain}, restatement_id HAVING sum({usd}) <> 0)""",
        f"""{p}_ranked AS (SELECT *, dense_rank() OVER (PARTITION BY cobid, {key_plain}
   ORDER BY restatement_created_timestamp DESC NULLS LAST, restatement_id DESC NULLS LAST) AS rk FROM {p}_net)""",
        f"""{p}_out AS (SELECT cobid, restatement_id, restatement_created_timestamp, {key_plain}, {', '.join(metrics)}
  FROM {p}_ranked WHERE rk = 1)""",
    ]


def scale_sql(hdr: str, with_prior: bool, tail: str, extra_views=()) -> str:
    """Full DuckDB WITH-chain: prior deltas (optional) then the batch, then ``tail``."""
    ctes = [_attrs("fact", "fa")]
    if with_prior:
        ctes += scale_ctes("p", "hdr_prior", None)
        ctes.append(_attrs("p_out", "pa"))
    ctes += scale_ctes("b", hdr, "pa" if with_prior else None)
    views = ["fact", "book_dim", "instrument_dim", "trade_dim", hdr, *extra_views]
    if with_prior:
        views.append("hdr_prior")
    return S.with_views(views, "WITH " + ",\n".join(ctes) + "\n" + tail)


OUT_COLS = ["cobid", "restatement_id", "restatement_created_timestamp", *POS_NO_COB]


def dbl_select(alias: str = "") -> str:
    a = f"{alias}." if alias else ""
    return ", ".join([f"{a}{c}" for c in OUT_COLS] +
                     [f"CAST({a}value_local AS DOUBLE) AS value_local", f"CAST({a}value_usd AS DOUBLE) AS value_usd"])


def current_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta table after the inline batch: prior rows not superseded + the batch."""
    from restate.operators.delta import supersede

    def build():
        new = run_scale(spark, sf_dir, "hdr_inline")
        return supersede(prior_deltas(spark, sf_dir), new, list(S.POSITION_COLS)).unionByName(new)
    return _memo(("current", id(spark), sf_dir), build)


CUR_CTE = (", cur AS (SELECT " + ", ".join(OUT_COLS + ["value_local", "value_usd"]) + " FROM p_out p WHERE NOT EXISTS ("
           "SELECT 1 FROM b_out b WHERE " + " AND ".join(f"b.{c} IS NOT DISTINCT FROM p.{c}" for c in S.POSITION_COLS)
           + ") UNION ALL SELECT " + ", ".join(OUT_COLS + ["value_local", "value_usd"]) + " FROM b_out)")
