"""Hard negatives by integer inner product over an STR-packed R-tree.

*Tree.*  Rows are dealt by range of (length, label, first component, id), so that a label or a
vector that very many rows share is split like any other.  Each task packs its rows by
sort-tile-recursive slices into leaves of one label, leaves into nodes, nodes into a subtree.
Every node has its minimum bounding box and its least id.  A subtree is one row of the stored index.

*Search.*  A box and an anchor give an interval of inner products, coordinate by coordinate.
For each anchor a best-first queue takes the box of the highest upper bound.  Boxes are left out
whose interval lies outside every score window asked for, whose upper bound is strictly below the
k-th best found, or which equals it and holds no smaller id.  Anchors are searched in blocks
of a bounded number, each sent to all tasks; a task carries its best from subtree to subtree.

Two searches make the result: the best rows of the anchor's own label (positives), then for every
positive the best rows of other labels within the score window that the positive sets.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from restate.llm.common import store

#: Rows of a leaf, children of a node, rows dealt to a subtree's task; anchors searched at a time (about: they are dealt by hash).
LEAF_ROWS, FAN_OUT, SLAB_ROWS, ANCHOR_BLOCK = 256, 8, 8192, 20_000
#: Length times the square of the largest component, at most: then no sum of products leaves 64 bits.
LARGEST = float(1 << 56)

TREE = "dim int, label long, levels array<int>, offsets binary, ids binary, vecs binary, lo binary, hi binary, least binary"
FOUND = "anchor int, slot int, id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, label: Column, scale: float) -> DataFrame:
    """(id, label, vec): components floor(scale * x) as integers.

    No part take rows whose id, label or vector is null, that hold a null or non-finite component,
    or that are too large for 64-bit inner products (``LARGEST``)."""
    vec = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    top = F.aggregate(vec_col, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")) * scale + 1.0))
    fits = (F.size(vec_col) * top * top) <= LARGEST
    return (vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias(vec_col))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col(vec_col).isNotNull()
                   & ~F.coalesce(bad, F.lit(True)) & F.coalesce(fits, F.lit(False)))
            .select("id", "label", F.transform(vec, lambda x: x.cast("int")).alias("vec")))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)


def _tiles(vecs: np.ndarray) -> list[np.ndarray]:
    """Sort-tile-recursive: positions of the rows of each leaf; the coordinates of the widest spread come first."""
    n = len(vecs)
    leaves = ceil(n / LEAF_ROWS)
    if leaves < 2 or not vecs.shape[1]:
        return [np.arange(i, min(n, i + LEAF_ROWS)) for i in range(0, n, LEAF_ROWS)]
    order = np.argsort(-vecs.astype(np.float64).var(axis=0), kind="stable")[:max(1, int(np.log2(leaves)))]
    slices = max(2, ceil(leaves ** (1 / len(order))))
    parts = [np.arange(n)]
    for c in order:
        cut = []
        for p in parts:
            if len(p) <= LEAF_ROWS:
                cut.append(p)
                continue
            p = p[np.argsort(vecs[p, c], kind="stable")]
            # slices of whole leaves, so that few leaves are filled in part
            step = ceil(ceil(len(p) / LEAF_ROWS) / slices) * LEAF_ROWS
            cut.extend(p[i:i + step] for i in range(0, len(p), step))
        parts = cut
    return [p[i:i + LEAF_ROWS] for p in parts for i in range(0, len(p), LEAF_ROWS)]


def _subtree(label: int, ids: np.ndarray, vecs: np.ndarray) -> dict:
    tiles = _tiles(vecs)
    order = np.concatenate(tiles)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tiles])])
    ids, vecs = ids[order], vecs[order]
    lo, hi = [np.minimum.reduceat(vecs, starts[:-1])], [np.maximum.reduceat(vecs, starts[:-1])]
    least = [np.minimum.reduceat(ids, starts[:-1])]
    while len(lo[-1]) > 1:
        at = np.arange(0, len(lo[-1]), FAN_OUT)
        lo.append(np.minimum.reduceat(lo[-1], at))
        hi.append(np.maximum.reduceat(hi[-1], at))
        least.append(np.minimum.reduceat(least[-1], at))
    return {"dim": vecs.shape[1], "label": label, "levels": [len(x) for x in lo], "offsets": starts.astype(np.int64).tobytes(),
            "ids": ids.tobytes(), "vecs": vecs.tobytes(), "lo": np.concatenate(lo).tobytes(), "hi": np.concatenate(hi).tobytes(),
            "least": np.concatenate(least).tobytes()}


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a subtree for every (length, label) among a task's rows."""
    groups: dict[tuple[int, int], list] = {}
    for batch in batches:
        dims, labels, ids = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("dim", "label", "id"))
        vecs = batch.column(batch.schema.get_field_index("vec"))
        at = np.flatnonzero((np.diff(dims) != 0) | (np.diff(labels) != 0)) + 1
        for a, b in zip([0, *at.tolist()], [*at.tolist(), len(ids)]):
            if b > a:
                groups.setdefault((int(dims[a]), int(labels[a])), []).append((ids[a:b], _matrix(vecs.slice(a, b - a), int(dims[a]))))
    for (dim, label), parts in groups.items():
        ids, vecs = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int32)
        order = np.lexsort((*vecs.T[::-1], ids))
        ids, vecs = ids[order], vecs[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (vecs[1:] != vecs[:-1]).any(axis=1)  # rows that repeat id, label and vector are one
        row = _subtree(label, ids[new], vecs[new])
        yield pa.RecordBatch.from_pylist([row], schema=_TREE_ARROW)


_TREE_ARROW = pa.schema([("dim", pa.int32()), ("label", pa.int64()), ("levels", pa.list_(pa.int32()))]
                        + [(c, pa.binary()) for c in ("offsets", "ids", "vecs", "lo", "hi", "least")])
_FOUND_ARROW = pa.schema([("anchor", pa.int32()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def build_tree(rows: DataFrame) -> DataFrame:
    """The stored index of ``integer_vectors`` rows, one row a subtree; empty for no rows."""
    slabs = max(1, ceil(rows.count() / SLAB_ROWS))
    keyed = rows.withColumn("dim", F.size("vec"))
    first = F.get("vec", F.lit(0))
    ranged = keyed.withColumn("first", first).repartitionByRange(slabs, "dim", "label", "first", "id")
    # sorted by the groups only: a task reads whole groups one after another
    ranged = ranged.sortWithinPartitions("dim", "label").select("dim", "label", "id", "vec")
    return store(ranged.mapInArrow(_pack, TREE), "rtree")


class _Best:
    """The k best rows of a score window [low, high]: higher scores first, then smaller ids."""

    __slots__ = ("k", "low", "high", "scores", "ids")

    def __init__(self, k: int, low: int | None, high: int | None):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def wants(self, lower: float, upper: float, least: int) -> bool:
        """Whether a box of these bounds can hold a row of the result."""
        if self.high is not None and lower > self.high or self.low is not None and upper < self.low:
            return False
        if len(self.ids) < self.k:
            return True
        return upper > self.scores[-1] or upper == self.scores[-1] and least < self.ids[-1]

    def done(self, upper: float) -> bool:
        """Whether no box of this upper bound or a lower one is wanted any more."""
        return self.low is not None and upper < self.low or len(self.ids) == self.k and upper < self.scores[-1]

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = np.ones(len(ids), bool)
        if self.high is not None:
            keep &= scores <= self.high
        if self.low is not None:
            keep &= scores >= self.low
        if len(self.ids) == self.k:
            keep &= scores >= self.scores[-1]
        if keep.any():
            scores, ids = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
            order = np.lexsort((ids, -scores))[:self.k]
            self.scores, self.ids = scores[order], ids[order]


class _Tree:
    def __init__(self, row: dict):
        self.label, self.dim = row["label"], row["dim"]
        self.starts = np.frombuffer(row["offsets"], np.int64)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.least = np.frombuffer(row["least"], np.int64)
        self.vecs, self.lo, self.hi = (np.frombuffer(row[c], np.int32).reshape(-1, self.dim) if self.dim else
                                       np.zeros((n, 0), np.int32) for c, n in (("vecs", len(self.ids)), ("lo", len(self.least)), ("hi", len(self.least))))
        sizes = row["levels"]
        self.bases = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        # sums of products below 2^53 are exact in doubles, which BLAS multiplies
        self.largest = max((int(np.abs(x).max(initial=0)) for x in (self.lo, self.hi)), default=0)

    def children(self, node: int) -> range:
        level = next(i for i, b in enumerate(self.bases) if node < b) - 1
        base, below = self.bases[level], self.bases[level - 1]
        return range(below + (node - base) * FAN_OUT, min(base, below + (node - base + 1) * FAN_OUT))

    def leaves(self) -> int:
        return len(self.starts) - 1


def _visit(tree: _Tree, vecs: np.ndarray, q: np.ndarray, own: int, upper: np.ndarray, lower: np.ndarray, wanted: list[_Best]) -> None:
    """Best-first: boxes by descending upper bound, until no window can gain from the next one."""
    root = len(upper) - 1
    queue = [(-upper[root], tree.least[root], root)]
    leaves = tree.leaves()
    while queue:
        high, least, node = heapq.heappop(queue)
        high = -high
        if all(w.done(high) for w in wanted):
            return
        if not any(w.wants(lower[node], high, least) for w in wanted):
            continue
        if node >= leaves:
            for c in tree.children(node):
                heapq.heappush(queue, (-upper[c], tree.least[c], c))
            continue
        a, b = tree.starts[node], tree.starts[node + 1]
        scores = vecs[a:b] @ q
        ids = tree.ids[a:b]
        floor = min((w.scores[-1] if len(w.ids) == w.k else w.low if w.low is not None else -np.inf) for w in wanted)
        at = np.flatnonzero((scores >= floor) & (ids != own))
        if len(at):
            scores, ids = scores[at].astype(np.int64), ids[at]
            for w in wanted:
                w.add(scores, ids)


def _searcher(anchors, same_label: bool, k: int):
    """A function over batches of subtrees: each task's k best rows of every anchor's windows."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = anchors.value
        best = [[_Best(k, low, high) for low, high in windows] for windows in block["windows"]]
        for batch in batches:
            for row in batch.to_pylist():
                tree = _Tree(row)
                among = block["dims"].get(tree.dim)
                if among is None:
                    continue
                at, ids, labels, queries, largest = among
                pick = np.flatnonzero((labels == tree.label) if same_label else (labels != tree.label))
                if not len(pick):
                    continue
                kind = np.float64 if max(1, tree.dim) * largest * max(1, tree.largest) < 1 << 53 else np.int64
                vecs, lo, hi = tree.vecs.astype(kind), tree.lo.astype(kind).T, tree.hi.astype(kind).T
                for i in range(0, len(pick), 1024):
                    some = pick[i:i + 1024]
                    q = queries[some].astype(kind)
                    up, down = np.maximum(q, 0), np.minimum(q, 0)
                    upper, lower = up @ hi + down @ lo, up @ lo + down @ hi
                    for j, p in enumerate(some.tolist()):
                        if best[at[p]]:
                            _visit(tree, vecs, q[j], ids[p], upper[j], lower[j], best[at[p]])
        rows = [(a, s, i, x) for a, windows in enumerate(best) for s, w in enumerate(windows)
                for i, x in zip(w.ids.tolist(), w.scores.tolist())]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 50_000]), _FOUND_ARROW.types)], schema=_FOUND_ARROW)

    return search


def _block(rows: list, windows: list[list[tuple]]) -> dict:
    dims: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        dims.setdefault(len(r["vec"]), []).append(i)
    out = {}
    for dim, at in dims.items():
        queries = np.array([rows[i]["vec"] for i in at], np.int32).reshape(len(at), dim)
        out[dim] = (at, np.array([rows[i]["id"] for i in at], np.int64), np.array([rows[i]["label"] for i in at], np.int64),
                    queries, int(np.abs(queries).max(initial=0)))
    return {"dims": out, "windows": windows}


def _search(tree: DataFrame, block: dict, same_label: bool, k: int) -> DataFrame:
    """(anchor, slot, id, score, rank): the k best of every window over all subtrees."""
    sent = tree.sparkSession.sparkContext.broadcast(block)
    found = tree.mapInArrow(_searcher(sent, same_label, k), FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` as of ``integer_vectors``.  Of every anchor and each of its ``positives`` best other rows of
    its label: the ``negatives`` best rows of other labels whose score is from ``low_percent`` to
    ``high_percent`` of the positive's.  Higher scores come first, equal ones by smaller id; a positive
    score below zero has no such range.  Rows that repeat id, label and vector are one; a row of the anchor's own id
    is neither positive nor negative of it; vectors of another length are not compared.  An empty
    table, or no anchor, gives no rows."""
    spark = rows.sparkSession
    rows = store(rows, "integer-vectors")
    tree = build_tree(rows)
    anchors = store(rows.where(is_anchor).distinct(), "anchors")
    blocks = max(1, ceil(anchors.count() / ANCHOR_BLOCK))
    results = []
    for b in range(blocks):
        # a bounded number of rows, dealt by hash
        some = anchors.where(F.pmod(F.xxhash64("id", "label", "vec"), F.lit(blocks)) == b).collect() if blocks > 1 else anchors.collect()
        some.sort(key=lambda r: (r["id"], r["label"], r["vec"]))
        best = _search(tree, _block(some, [[(None, None)]] * len(some)), True, positives).collect()
        windows: list[list[tuple]] = [[] for _ in some]
        pairs = []
        for r in sorted(best, key=lambda r: (r["anchor"], r["rank"])):
            span = (-(-low_percent * r["score"] // 100), high_percent * r["score"] // 100)
            if span[0] > span[1]:
                continue
            mine_ = windows[r["anchor"]]
            if span not in mine_:
                mine_.append(span)
            pairs.append((r["anchor"], mine_.index(span), r["rank"], some[r["anchor"]]["id"], r["id"], r["score"]))
        if not pairs:
            continue
        chosen = spark.createDataFrame(pairs, "a int, s int, p int, anchor_id long, positive_id long, positive_score long")
        found = _search(tree, _block(some, windows), False, negatives)
        joined = found.join(F.broadcast(chosen), (F.col("anchor") == F.col("a")) & (F.col("slot") == F.col("s")))
        results.append(store(joined.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                                           F.col("score").alias("negative_score")), "hard-negatives"))
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out
