"""Tables of slices whose contents a manifest names, changed several at a time.

A table is a set of slices: the rows of one value of its slice columns (a business date, a batch) or
of one hash bucket of its key.  A slice is a folder of Parquet files.  A manifest names the folder of
every slice of every table; the newest manifest is the state of all tables.

A run changes any number of tables in one commit::

    stage     the new slices of each table go to folders of the batch (a repeated run overwrites them)
    validate  every staged folder is complete
    publish   the next manifest appears by one rename
    recover   nothing to do: whatever was staged and not published is in no manifest; ``vacuum`` deletes it

So a run that dies at any point, and runs again, leaves the same tables as one that does not, and readers
see all of a batch or none.  A batch that is published already is not done again.  Only touched slices
are written.  A slice of NULL values is a slice like any other: folders are named by a hash, not by values.

One writer at a time.  The lists that reach the driver are of slices, as in a partition listing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE = "_slice"


def slice_id(cols: Iterable[str]):
    """The slice of a row by values: a hash of them, NULLs included."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}))


def bucket_id(keys: Iterable[str], buckets: int):
    """The slice of a row by hash bucket of its key; NULL keys are keys."""
    return F.lpad(F.conv(F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("string"), 10, 16), 8, "0").alias(SLICE)


@dataclass
class Staged:
    """Rows that are stored ahead of the commit which names them: what was written, read back, and the folder of each slice."""

    rows: DataFrame
    folders: dict[str, str]


@dataclass
class Change:
    """New rows of one table: ``rows`` replace the slices they fall in, and those of ``emptied`` (a relation of
    the slice columns) end empty if they get none.  With ``append`` they are added beside what a slice holds;
    ``only_emptied`` leaves out rows outside of ``emptied``.  ``one_slice`` says that all rows fall in one: each
    task writes its own, none are shuffled.  ``beside`` are staged rows that come to the table as they lie: their
    folders are named, nothing is written again.  Several tables may name one folder, each reads its own columns
    of it; with ``one_slice`` all of its rows fall in one slice here too."""

    rows: DataFrame
    by: tuple[str, ...] = ()
    buckets: int | None = None
    emptied: DataFrame | None = None
    append: bool = False
    only_emptied: bool = False
    one_slice: bool = False
    drop: set[str] = field(default_factory=set)
    beside: tuple[Staged, ...] = ()

    def slices(self):
        if not self.by:
            return F.lit("all").alias(SLICE)
        return bucket_id(self.by, self.buckets) if self.buckets else slice_id(self.by).alias(SLICE)

    def parts(self) -> list[tuple[str, str]]:
        """(slice, folder) of the staged rows."""
        out = []
        for part in self.beside:
            # one row of them tells the slice of all
            own = part.rows.select(self.slices()).first()[0] if self.one_slice and part.folders else None
            out += [(own or s, folder) for s, folder in sorted(part.folders.items())]
        return out


class _Files:
    """Few calls on whatever file system the path lies in."""

    def __init__(self, spark: SparkSession, root: str):
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(sc._jsc.hadoopConfiguration())
        self._io = sc._jvm.org.apache.commons.io.IOUtils

    def names(self, path: str) -> list[str]:
        p = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(self._io.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """The whole file or none: written aside, then renamed onto a name that must not exist."""
        aside = self._path(path + ".tmp")
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(self._path(path)) or not self._fs.rename(aside, self._path(path)):
            raise RuntimeError(f"{path} exists: another writer was faster")

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class Tables:
    """The tables under ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._files = spark, root.rstrip("/"), _Files(spark, root)

    # -- state ---------------------------------------------------------------
    def _commits(self) -> list[str]:
        return [n for n in self._files.names(f"{self.root}/commits") if n.endswith(".json")]

    def state(self) -> dict:
        """{"commit", "tables": {name: {"schema", "slices": {id: [[folder, commit], ...]}}}, "notes"} of the newest manifest."""
        names = self._commits()
        return json.loads(self._files.read(f"{self.root}/commits/{names[-1]}")) if names else {"commit": 0, "tables": {}, "notes": {}}

    def committed(self, batch: str) -> bool:
        tail = f"-{_plain(batch)}.json"
        return any(n.endswith(tail) for n in self._commits())

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(self.state()["tables"][name]["schema"])

    def exists(self, name: str) -> bool:
        return name in self.state()["tables"]

    # -- read ----------------------------------------------------------------
    def _load(self, table: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, name: str, slices: Iterable[str] | None = None, since: int | None = None) -> DataFrame:
        """A table's rows: all, of some slices only, or of the folders added by commits after ``since``."""
        table = self.state()["tables"][name]
        wanted = None if slices is None else set(slices)
        folders = [f for s, parts in sorted(table["slices"].items()) if wanted is None or s in wanted
                   for f, commit in parts if since is None or commit > since]
        return self._load(table, folders)

    # -- write ---------------------------------------------------------------
    def stage(self, name: str, batch: str, part: str, change: Change) -> Staged:
        """Store the rows of ``change`` in folders of ``name`` for the next commit, which ``batch`` has to be."""
        folder, schema, _ = self._stage(name, batch, self.state()["commit"] + 1, change, f"-{part}")
        folders = self._written(folder)
        return Staged(self._load({"schema": schema}, sorted(folders.values())), folders)

    def _written(self, folder: str) -> dict[str, str]:
        return {n.split("=", 1)[1]: f"{folder}/{n}" for n in self._files.names(f"{self.root}/{folder}") if n.startswith(f"{SLICE}=")}

    def commit(self, batch: str, changes: dict[str, Change], notes: dict | None = None, step: Callable[[str], None] = lambda name: None) -> bool:
        """Publish ``changes`` (table -> Change) of ``batch`` in one step; False if that batch is published already.

        ``step`` is told what comes next (tests stop a run there)."""
        if self.committed(batch):
            return False
        state = self.state()
        number = state["commit"] + 1
        staged = {}
        for name, change in sorted(changes.items()):
            step(f"stage {name}")
            staged[name] = self._stage(name, batch, number, change)
        step("validate")
        for name, (folder, _, _) in staged.items():
            if not self._files.exists(f"{self.root}/{folder}/_SUCCESS"):
                raise RuntimeError(f"{name}: {folder} is incomplete")
        for name, (folder, schema, emptied) in staged.items():
            table = state["tables"].setdefault(name, {"schema": schema, "slices": {}})
            if _types(table["schema"]) != _types(schema):
                raise ValueError(f"{name}: columns differ from the table's")
            for part in changes[name].beside:
                if not set(_types(table["schema"])) <= set(_types(json.loads(part.rows.schema.json()))):
                    raise ValueError(f"{name}: columns of staged rows differ from the table's")
            for s in emptied:
                table["slices"].pop(s, None)
            written: dict[str, list] = {}
            for s, path in [*self._written(folder).items(), *changes[name].parts()]:
                written.setdefault(s, []).append([path, number])
            for s, paths in written.items():
                before = table["slices"].get(s, []) if changes[name].append else []
                table["slices"][s] = [*before, *paths]
        state["commit"], state["notes"] = number, state["notes"] | (notes or {})
        step("publish")
        self._files.make(f"{self.root}/commits")
        self._files.publish(f"{self.root}/commits/{number:012d}-{_plain(batch)}.json", json.dumps(state))
        step("published")
        return True

    def _stage(self, name: str, batch: str, number: int, change: Change, part: str = "") -> tuple[str, dict, set[str]]:
        folder = f"data/{name}/{number:012d}-{_plain(batch)}{part}"
        rows, emptied = change.rows.withColumn(SLICE, change.slices()), set(change.drop)
        if change.emptied is not None:
            ids = change.emptied.select(change.slices()).distinct()
            # a list of slices, as long as a partition listing
            emptied |= {r[0] for r in ids.collect()}
            if change.only_emptied:
                rows = rows.join(ids.withColumnRenamed(SLICE, "_wanted"), F.col(SLICE) == F.col("_wanted"), "left_semi")
        # rows of a slice meet in few files; a large slice is split among tasks by its size
        if not change.one_slice:
            rows = rows.hint("rebalance", F.col(SLICE))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(SLICE).parquet(f"{self.root}/{folder}")
        schema = StructType([f for f in change.rows.schema.fields]).jsonValue()
        for f in schema["fields"]:
            f["nullable"] = True
        return folder, schema, emptied

    def vacuum(self, keep: int = 2) -> int:
        """Delete the manifests before the newest ``keep`` and every staged folder that no kept one names.

        Batches of deleted manifests are forgotten: they must not be run again."""
        names = self._commits()
        kept = names[-keep:]
        named: set[str] = set()
        for n in kept:
            for table in json.loads(self._files.read(f"{self.root}/commits/{n}"))["tables"].values():
                named |= {f for parts in table["slices"].values() for f, _ in parts}
        gone = 0
        for table in self._files.names(f"{self.root}/data"):
            for batch in self._files.names(f"{self.root}/data/{table}"):
                folder = f"data/{table}/{batch}"
                slices = [s for s in self._files.names(f"{self.root}/{folder}") if s.startswith(f"{SLICE}=")]
                used = [s for s in slices if f"{folder}/{s}" in named]
                if not used:
                    self._files.delete(f"{self.root}/{folder}")
                    gone += 1
                    continue
                for s in set(slices) - set(used):
                    self._files.delete(f"{self.root}/{folder}/{s}")
                    gone += 1
        for n in names[:-keep]:
            self._files.delete(f"{self.root}/commits/{n}")
        return gone


def _types(schema: dict) -> list[tuple[str, str]]:
    return [(f["name"], f["type"]) for f in schema["fields"]]


def _plain(batch: str) -> str:
    """A batch's name as part of a file name: letters, digits and dots stay, others become their code."""
    return reduce(lambda a, c: a + (c if c.isascii() and (c.isalnum() or c == ".") else f"_{ord(c):x}_"), batch, "")
