"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from restate.session import checkpoint_dir

LEARN_MODULUS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back.

    Cuts the lineage: the files outlive any executor, and what is computed twice
    downstream is read from them instead."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete the files of tables that ``store`` gave, when what comes from them is stored itself and nothing reads them again."""
    for df in stored:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str | Column) -> Column:
    """The rows no label may be learnt from: crc32 of the id as text, mod 4, is 2."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string")) % LEARN_MODULUS == HELD_OUT, F.lit(False))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of rounds whose result is stored.

    It does so when the driver's garbage collector drops the plans, which a driver
    with memory to spare may not do for long; a loop of many shuffles calls this."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of (id, text hash) up to which they are broadcast: some 50 MB.
BROADCAST_ROWS = 2_000_000


def text_key(text: str | Column) -> Column:
    """With the id, names a row; rows that share both are alike in all that operators look at."""
    return F.xxhash64(text)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows named by ``gone`` (id, text_key), a stored table.

    Few of those are broadcast, so that no text is shuffled; with more the join is Spark's choice."""
    gone = gone.select(F.col("id").alias("g_id"), F.col("text_key").alias("g_key")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("g_id")) & (text_key(text_col) == F.col("g_key")), "left_anti")


def bounded_sample(df: DataFrame, group: str, order: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows of each ``group`` value, the first in ``order``.

    A rank limit: Spark cuts every partition to ``rows`` per group before it
    shuffles, so a hot group costs no more than a small one."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= rows).drop("_rank")


#: Bytes of the batches that go to Python workers, unless the session says so.  Batches of whole texts are else as large as
#: 10,000 rows make them, and the JVM and the worker hold a few of them for each task.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per Spark application, and bound the batches that they send to Python.

    Functions that run in Python workers are pickled by the name of their module;
    a session started without ``--py-files`` would not find it there."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_restate_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="restate-code-")) / "restate_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._restate_shipped = True
