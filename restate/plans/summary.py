"""Summaries kept up to date by signed changes.

A summary is a sum per group.  A row that comes into the table it sums is a change of sign +1, one that leaves
it (superseded, deleted) a change of sign -1.  The summary holds for every group the sums, the number
of its rows, and for every metric the number of its values that are not NULL, so applying changes gives exactly
what summing the whole table again would: a group without rows disappears, a sum without
values is NULL.  Only the slices that changes fall in are read and written, and of the summed table
nothing but the changes.

Metrics are decimals or whole numbers: sums of those do not depend on the order of changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restate.session import cut_lineage
from restate.sources.manifest import Change, Tables, slice_id

SIGN = "_sign"


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn(SIGN, F.lit(sign))


@dataclass(frozen=True)
class SummaryView:
    """The summary ``name`` of ``metrics`` by ``groups``, in slices of ``slices`` (some of the groups)."""

    tables: Tables
    name: str
    groups: tuple[str, ...]
    metrics: tuple[str, ...]
    slices: tuple[str, ...] = ("cobid",)

    def _partial(self, changes: DataFrame) -> DataFrame:
        for m in self.metrics:
            if not isinstance(changes.schema[m].dataType, (T.DecimalType, T.IntegralType)):
                raise TypeError(f"{m}: sums kept by changes need decimals or whole numbers")
        plus = F.col(SIGN) > 0
        # a sum's own type from the start, so that the stored columns never change theirs
        return changes.groupBy(*self.groups).agg(
            F.sum(F.when(plus, 1).otherwise(-1)).alias("_rows"),
            *[F.coalesce(F.sum(F.when(plus, F.col(m)).otherwise(-F.col(m))), F.lit(0)).cast(_sum_type(changes.schema[m].dataType)).alias(m) for m in self.metrics],
            *[F.sum(F.when(F.col(m).isNull(), 0).when(plus, 1).otherwise(-1)).alias(f"_n_{m}") for m in self.metrics])

    def apply(self, batch: str, changes: DataFrame, notes: dict | None = None, step=lambda name: None) -> bool:
        """Bring ``changes`` (rows with ``_sign``) in as ``batch``; False if it was applied before."""
        if self.tables.committed(batch):
            return False
        partial = cut_lineage(self._partial(changes))
        if not self.tables.exists(self.name):
            merged = partial
        else:
            touched = [r[0] for r in partial.select(slice_id(self.slices)).distinct().collect()]
            merged = self.tables.read(self.name, touched).unionByName(partial)
        added = [c for c in partial.columns if c not in self.groups]
        types = {f.name: f.dataType for f in partial.schema.fields}
        merged = merged.groupBy(*self.groups).agg(*[F.sum(c).cast(types[c]).alias(c) for c in added])
        lost = F.raise_error(F.lit(f"{self.name}: changes take away rows that it never had")).cast("long")
        merged = merged.withColumn("_rows", F.when(F.col("_rows") < 0, lost).otherwise(F.col("_rows"))).where("_rows <> 0")
        change = Change(merged, by=self.slices, emptied=partial.select(*self.slices))
        return self.tables.commit(batch, {self.name: change}, notes, step)

    def refresh(self, log: str, step=lambda name: None) -> int:
        """Apply the signed rows that commits added to the table ``log`` since the last refresh; returns the commits behind.

        Call it at whatever lag the summary may have: the work follows the changes, and nothing changed is no work."""
        state = self.tables.state()
        done = state["notes"].get(f"{self.name}.applied", 0)
        now = state["commit"]
        pending = {c for parts in state["tables"].get(log, {"slices": {}})["slices"].values() for _, c in parts if c > done}
        if pending:
            self.apply(f"{self.name}.{done}.{max(pending)}", self.tables.read(log, since=done), {f"{self.name}.applied": now}, step)
        return len(pending)

    def read(self) -> DataFrame:
        """Groups and sums, as summing the table would give them."""
        rows = self.tables.read(self.name)
        return rows.select(*self.groups, *[F.when(F.col(f"_n_{m}") != 0, F.col(m)).alias(m) for m in self.metrics])


def _sum_type(kind: T.DataType) -> T.DataType:
    return T.DecimalType(min(38, kind.precision + 10), kind.scale) if isinstance(kind, T.DecimalType) else T.LongType()
