"""A batch of requests from request to published tables, as one run that can be repeated.

    requests -> new deltas -> superseded deltas leave -> changes, history, rebuild triggers -> one commit -> summary

Tables of a scope (slices in brackets):

* ``deltas`` (business date): the rows in force;
* ``delta_changes`` (batch): every row that came (+1) or left (-1), which summaries follow;
* ``status_history`` (batch): a row a request with its new status and the rows it wrote;
* ``triggers`` (batch): a row a business date to rebuild downstream.

A run that dies anywhere and is run again with the same name leaves the same tables; one that
has been published does nothing.

Rows that come or leave are stored once, ahead of the commit and with the sign and batch that the log needs: the
delta table and the log name the same files of what came.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restate.operators.delta import positions_of, record_counts
from restate.operators.match import DIM_BROADCAST_ROWS, sized_broadcast
from restate.plans.scale import apply_scale, fact_rows, request_profile
from restate.plans.summary import SIGN, SummaryView, signed
from restate.session import cut_lineage
from restate.sources.manifest import Change, Staged, Tables, slice_id

DELTAS, LOG, HISTORY, TRIGGERS = "deltas", "delta_changes", "status_history", "triggers"
ADJ = "restatement_id"


@dataclass(frozen=True)
class Scope:
    """What the tables of a scope are made of."""

    position_cols: tuple[str, ...]
    metrics: tuple[str, ...]
    usd_metric: str
    filter_map: dict[str, str]
    summary_cols: tuple[str, ...]
    cob_col: str = "cobid"

    @property
    def columns(self) -> list[str]:
        return [self.cob_col, ADJ, "restatement_created_timestamp", *[c for c in self.position_cols if c != self.cob_col], *self.metrics]

    def summary(self, tables: Tables) -> SummaryView:
        return SummaryView(tables, "summary", self.summary_cols, self.metrics, (self.cob_col,))


def _came(tables: Tables, scope: Scope, batch: str, rows: DataFrame) -> Staged:
    """Rows that come, as slices of the delta table; the log reads their sign and batch from the same files."""
    logged = signed(rows.select(*scope.columns), 1).withColumn("batch", F.lit(batch))
    return tables.stage(DELTAS, batch, "came", Change(logged, by=(scope.cob_col,)))


def _left(tables: Tables, scope: Scope, batch: str, rows: DataFrame) -> Staged:
    """Rows that leave, as the log's slice of the batch."""
    logged = signed(rows.select(*scope.columns), -1).withColumn("batch", F.lit(batch))
    return tables.stage(LOG, batch, "left", Change(logged, by=("batch",), one_slice=True))


def _publish(tables: Tables, scope: Scope, batch: str, came: Staged | None, left: Staged | None, kept: DataFrame, touched: set[str],
             history: DataFrame, step) -> bool:
    moved = [part for part in (came, left) if part]
    cobs = reduce(DataFrame.union, [part.rows.select(scope.cob_col) for part in moved]).distinct()
    return tables.commit(batch, {
        DELTAS: Change(kept.select(*scope.columns), by=(scope.cob_col,), drop=touched, beside=(came,) if came else ()),
        LOG: Change(moved[0].rows.select(*scope.columns, SIGN, "batch").limit(0), by=("batch",), one_slice=True, beside=tuple(moved)),
        HISTORY: Change(history.withColumn("batch", F.lit(batch)), by=("batch",)),
        TRIGGERS: Change(cobs.withColumn("batch", F.lit(batch)), by=("batch",)),
    }, step=step)


def _slices(scope: Scope, rows: DataFrame) -> set[str]:
    """Slices of the delta table that ``rows`` fall in: as many as business dates."""
    return {r[0] for r in rows.select(scope.cob_col).distinct().select(slice_id((scope.cob_col,))).collect()}


def _in_force(tables: Tables, like: DataFrame, touched: set[str]) -> DataFrame:
    """Rows of the delta table on the touched business dates: those slices only are read."""
    return tables.read(DELTAS, touched) if tables.exists(DELTAS) else like.limit(0)


def _ids(ids: DataFrame) -> DataFrame:
    """The distinct request ids of ``ids``, stored; broadcast behind a size check, so that no delta row is shuffled to meet them."""
    own = cut_lineage(ids.select(F.col(ADJ).cast("long").alias("_own")).where(F.col("_own").isNotNull()).distinct())
    return sized_broadcast(own, DIM_BROADCAST_ROWS)[0]


def _of(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of the requests ``ids`` (left_semi), or all but those (left_anti)."""
    return rows.join(ids, F.col(ADJ) == F.col("_own"), how)


def process(tables: Tables, scope: Scope, batch: str, requests: DataFrame, fact: DataFrame,
            enrich: Callable[[DataFrame], DataFrame] = lambda df: df, step: Callable[[str], None] = lambda name: None) -> bool:
    """Process ``requests`` over ``fact`` as ``batch``; False if that batch was published before.

    ``enrich`` attaches the attributes that filters ask for to fact and delta rows.  A position
    that the batch writes loses its earlier delta rows; with the summary the run is complete."""
    published = False
    if not tables.committed(batch):
        profile = request_profile(requests, list(scope.filter_map))
        profile["fact_rows"] = fact_rows(fact, profile, scope.cob_col)
        filters = {c: scope.filter_map[c] for c in profile["active"]}
        stored = None
        if profile["has_cross"] and tables.exists(DELTAS):
            dates = fact.sparkSession.createDataFrame([(c,) for c in profile["cobs"]], f"{scope.cob_col} int")
            stored = _in_force(tables, dates, _slices(scope, dates))
        new = apply_scale(enrich(fact), requests, filters, list(scope.position_cols), list(scope.metrics), scope.usd_metric,
                          deltas=enrich(stored) if stored is not None else None, cob_col=scope.cob_col, profile=profile)
        came = _came(tables, scope, batch, new)
        new, touched = came.rows.select(*scope.columns), set(came.folders)
        before = _in_force(tables, new, touched)
        positions, same = positions_of(new, scope.position_cols)
        left = _left(tables, scope, batch, before.join(positions, same, "left_semi")) if tables.exists(DELTAS) else None
        kept = before.join(positions, same, "left_anti")
        written = record_counts(requests.select(ADJ, scope.cob_col), new, ADJ)
        history = written.select(F.col(ADJ).cast("long").alias(ADJ), F.lit("Processed").alias("new_status"), "record_count")
        published = _publish(tables, scope, batch, came, left, kept, touched, history, step)
    scope.summary(tables).refresh(LOG, step)
    return published


def load(tables: Tables, scope: Scope, batch: str, deltas: DataFrame, step: Callable[[str], None] = lambda name: None) -> bool:
    """Take a delta table over as it is: rows on the business dates it holds replace what is in force there."""
    published = False
    if not tables.committed(batch):
        came = _came(tables, scope, batch, deltas)
        new, touched = came.rows.select(*scope.columns), set(came.folders)
        left = _left(tables, scope, batch, _in_force(tables, new, touched)) if tables.exists(DELTAS) else None
        counts = new.groupBy(ADJ).agg(F.count(F.lit(1)).alias("record_count"))
        history = counts.select(F.col(ADJ).cast("long").alias(ADJ), F.lit("Loaded").alias("new_status"), "record_count")
        published = _publish(tables, scope, batch, came, left, new.limit(0), touched, history, step)
    scope.summary(tables).refresh(LOG, step)
    return published


def post(tables: Tables, scope: Scope, batch: str, rows: DataFrame, step: Callable[[str], None] = lambda name: None) -> bool:
    """Add given delta rows (an upload); what their requests had in force before leaves."""
    published = False
    if not tables.committed(batch):
        came = _came(tables, scope, batch, rows)
        new, touched, left = came.rows.select(*scope.columns), set(came.folders), None
        counts = cut_lineage(new.groupBy(ADJ).agg(F.count(F.lit(1)).alias("record_count")))
        kept = new.limit(0)
        if tables.exists(DELTAS):
            own = _ids(counts)
            left = _left(tables, scope, batch, _of(tables.read(DELTAS), own, "left_semi"))
            touched |= _slices(scope, left.rows)
            kept = _of(_in_force(tables, new, touched), own, "left_anti")
        history = counts.select(F.col(ADJ).cast("long").alias(ADJ), F.lit("Processed").alias("new_status"), "record_count")
        published = _publish(tables, scope, batch, came, left, kept, touched, history, step)
    scope.summary(tables).refresh(LOG, step)
    return published


def remove(tables: Tables, scope: Scope, batch: str, ids: DataFrame, status: str = "Removed", step: Callable[[str], None] = lambda name: None) -> bool:
    """Take every delta row of the requests ``ids`` out (a failed run's retry, a delete)."""
    published = False
    if not tables.committed(batch) and tables.exists(DELTAS):
        wanted = _ids(ids)
        left = _left(tables, scope, batch, _of(tables.read(DELTAS), wanted, "left_semi"))
        touched = _slices(scope, left.rows)
        kept = _of(_in_force(tables, left.rows, touched), wanted, "left_anti")
        counts = left.rows.groupBy(ADJ).agg(F.count(F.lit(1)).alias("record_count"))
        history = counts.select(F.col(ADJ).cast("long").alias(ADJ), F.lit(status).alias("new_status"), "record_count")
        published = _publish(tables, scope, batch, None, left, kept, touched, history, step)
    scope.summary(tables).refresh(LOG, step)
    return published
