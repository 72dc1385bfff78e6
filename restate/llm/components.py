"""Connected components of an edge table, by alternating large and small stars.

Every round joins each node to the least node beside it, so long chains halve and
the edges end as one star per component.  Nothing but a count and a checksum of
each round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restate.llm.common import store


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    return both.join(least, F.col("u") == F.col("c")).where(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    moved = edges.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge but the roots: root is the least node it can reach.

    ``edges`` has u and v of one orderable type; direction, repeated edges and
    edges of a node to itself do not matter; edges with a null end are ignored.
    No edges give no rows.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = store(e, "components")
    last = None
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == last or not seen[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last, e = seen, store(_small_star(_large_star(e)), "components")
