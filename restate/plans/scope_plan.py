"""A scope's whole processing built from its settings: read, enrich, process, upload, summarise.

Settings (``conf/plans.json``; a name is found in any case) say where the fact lies and what its columns are, what
makes a position (``grain``), which metrics are carried, which dimensions give attributes (one
after the other, so one may hold the next one's key), which filters a request may set, what the summary is
by, and for an upload the text and measure fields of a row and the codes to resolve.  A new scope is a
new entry.  ``{sf_dir}`` and the like in paths are filled in by the caller.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from restate import spec
from restate.functions.factor import VALUE_TYPE
from restate.operators.resolve import resolve_max
from restate.operators.shape import extract, unpivot_measures
from restate.plans.process import ADJ, DELTAS, Scope, post, process
from restate.sources.manifest import Tables


@dataclass(frozen=True)
class ScopePlan:
    spark: SparkSession
    settings: dict
    places: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        return self.settings["name"]

    @property
    def scope(self) -> Scope:
        s = self.settings
        return Scope(tuple(s["grain"]), tuple(s["metrics"]), s["usd_metric"], {c: c for c in s.get("filters", ())}, tuple(s["summary"]))

    def _read(self, entry: dict, columns: dict[str, str] | None = None) -> DataFrame:
        df = self.spark.read.parquet(entry["path"].format(**self.places))
        return df.select(*[F.expr(e).alias(c) for c, e in (columns or entry["columns"]).items()])

    # -- processing ----------------------------------------------------------
    def fact(self) -> DataFrame:
        """The fact with its metric not NULL; a metric that it lacks is left out of the scope's settings by whoever writes them."""
        df = self._read(self.settings["fact"])
        return df.select(*[c for c in df.columns if c in {*self.settings["grain"], *self.settings["metrics"], *self.settings.get("filters", ())}]).where(
            F.col(self.settings["usd_metric"]).isNotNull())

    def enrich(self, df: DataFrame) -> DataFrame:
        """The attributes that filters ask for, from the dimensions that have them or lead to them."""
        missing = {c for c in self.settings.get("filters", ()) if c not in df.columns}
        wanted = []
        for d in reversed(self.settings.get("dimensions", ())):
            gives = [c for c in d["columns"] if c != d["key"] and c in missing]
            if gives:
                wanted.append((d, gives))
                missing = missing - set(gives) | ({d["key"]} - set(df.columns))
        if missing:
            raise ValueError(f"{self.name}: no dimension gives {sorted(missing)}")
        keep = [*df.columns, *[c for c in self.settings.get("filters", ()) if c not in df.columns]]
        for d, gives in reversed(wanted):
            dim = self._read(d).select(F.col(d["key"]).alias("_dk"), *gives)
            df = df.join(dim, F.col(d["key"]) == F.col("_dk"), "left").drop("_dk")
        return df.select(*keep)

    def accepted(self, requests: DataFrame, all_filters) -> Column:
        """Requests that set no filter which this scope has not."""
        unknown = [c for c in all_filters if c in requests.columns and c not in self.settings.get("filters", ())]
        return reduce(lambda a, b: a & b, [F.col(c).isNull() for c in unknown], F.lit(True))

    def process(self, tables: Tables, batch: str, requests: DataFrame, all_filters=(), **kw) -> bool:
        """Process the accepted ones of ``requests``; the others are not this scope's."""
        mine = requests.where(self.accepted(requests, all_filters))
        return process(tables, self.scope, batch, mine, self.fact(), self.enrich, **kw)

    # -- upload --------------------------------------------------------------
    def measures(self) -> list[str]:
        named = self.settings["upload"]["measures"]
        return list(getattr(spec, named)) if isinstance(named, str) else list(named)

    def upload_rows(self, payload: DataFrame, payload_col: str = "payload") -> DataFrame:
        """(id, created, payload) rows as delta rows: fields read by type, a row a measure that is not 0, codes resolved (-1: unknown)."""
        u = self.settings["upload"]
        head = [ADJ, "restatement_created_timestamp"]
        fields = {**u["keep"], **u["text"], **{m: u["measure_type"] for m in self.measures()}}
        typed = extract(payload, payload_col, fields, keep=head)
        # codes are looked up once a row of the upload, not for each of its measures
        for c in u["codes"]:
            dim = self._read(c, {"_code": c["code"], "_key": c["key"]})
            typed = resolve_max(typed, dim, c["column"], "_code", "_key", c["out"])
        ids = [*head, *u["keep"], *u["text"], *[c["out"] for c in u["codes"]]]
        long = unpivot_measures(typed, ids, self.measures(), "measure", self.settings["usd_metric"])
        return long.withColumns({m: F.col(m).cast(VALUE_TYPE) for m in self.settings["metrics"]})

    def upload(self, tables: Tables, batch: str, payload: DataFrame, payload_col: str = "payload", **kw) -> bool:
        """Publish an upload's rows; rows that its requests had before are replaced."""
        return post(tables, self.scope, batch, self.upload_rows(payload, payload_col), **kw)

    # -- results -------------------------------------------------------------
    def deltas(self, tables: Tables) -> DataFrame:
        return tables.read(DELTAS)

    def summary(self, tables: Tables) -> DataFrame:
        return self.scope.summary(tables).read()


def load_plan(spark: SparkSession, path: str, name: str, **places) -> ScopePlan:
    with open(path) as fh:
        entries = json.load(fh)["scopes"]
    for entry in entries:
        if entry["name"].lower() == name.lower():
            return ScopePlan(spark, entry, places)
    raise KeyError(f"unknown scope {name!r}")
