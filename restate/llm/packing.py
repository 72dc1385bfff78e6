"""Variable-capacity best-fit packing of token sequences.

Sequences may be any of several permitted lengths.  Pieces are placed, longest
first, into the open bin that they leave the least room in; where none fits, the
bin size with the least cost for each token it can still get is opened.  At the end
each bin shrinks to the least permitted length that holds its contents.  The sizes
are optimised together: the packing is also made with each size as the one that
is opened where it fits, and the cheapest result after shrinking is kept.

Rows are dealt round-robin into shards of a bounded number of rows, whatever their
ids, and each shard is packed by itself: the waste at a shard's end is a few bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from restate.llm import tokens
from restate.llm.common import store

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence of n tokens: n + n * n * QUADRATIC (attention) + OVERHEAD (for each sequence).
QUADRATIC, OVERHEAD = 1 / 65536, 32.0
ROWS_PER_SHARD = 50_000


def cost(capacity: int) -> float:
    return capacity + capacity * capacity * QUADRATIC + OVERHEAD


def _pack(lengths: list[int], capacities: Sequence[int], prefer: int | None) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (longest first), and what each bin holds."""
    room: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    mask, left = 0, sum(lengths)
    bins, offsets, used, size = [], [], [], []
    for n in lengths:
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            able = [c for c in capacities if c >= n]
            c = prefer if prefer in able else min(able, key=lambda c: (cost(c) / max(1, min(c, left)), c))
            b, r = len(used), c
            used.append(0)
            size.append(c)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        left -= n
        r = size[b] - used[b]
        if not room[r]:
            mask |= 1 << r
        room[r].append(b)
    return bins, offsets, used


def shrink(used: int, capacities: Sequence[int]) -> int:
    return next(c for c in capacities if c >= used)


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset, capacity of that bin) of each length; no length is over the largest capacity."""
    capacities = sorted(set(capacities))
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist()
    longest_first = [int(lengths[i]) for i in order]
    best = None
    for prefer in (None, *capacities):
        bins, offsets, used = _pack(longest_first, capacities, prefer)
        sizes = [shrink(u, capacities) for u in used]
        total = sum(map(cost, sizes))
        if best is None or total < best[0]:
            best = total, bins, offsets, sizes
    n = len(order)
    out_bin, out_offset, out_size = [0] * n, [0] * n, [0] * n
    if best:
        for i, b, o in zip(order, best[1], best[2]):
            out_bin[i], out_offset[i], out_size[i] = b, o, best[3][b]
    return out_bin, out_offset, out_size


def pack(rows: DataFrame, capacities: Sequence[int] = CAPACITIES, id_col: str = "id", length_col: str = "length",
         rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """One row per piece: id, piece, start, length, bin_id, offset, capacity.

    A sequence longer than the largest capacity is cut into pieces of that size
    and a rest; ``start`` is a piece's place in its sequence, ``offset`` its place
    in the bin.  Null and negative lengths count as 0; such a row is a piece of
    length 0.  Repeated rows and ids are pieces of their own.  An empty table gives
    no rows; other columns are left out.
    """
    top = max(capacities)
    length = F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long")
    base = rows.select(F.col(id_col).alias("id"), length.alias("total"))
    last = F.greatest(F.ceil(F.col("total") / top) - 1, F.lit(0))
    pieces = base.select("id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * top).alias("start"),
                           F.least(F.col("total") - F.col("piece") * top, F.lit(top)).alias("length"))
    pieces = store(pieces, "pieces")
    shards = max(1, math.ceil(pieces.count() / rows_per_shard))
    out = pieces.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if got is None or not got.num_rows:
            return
        got = got.sort_by([("id", "ascending"), ("piece", "ascending"), ("length", "ascending")]).combine_chunks()
        bins, offsets, sizes = best_fit(got.column("length").to_pylist(), capacities)
        bin_id = np.array(bins, np.int64) + (TaskContext.get().partitionId() << 32)
        got = got.append_column("bin_id", pa.array(bin_id)).append_column("offset", pa.array(offsets, pa.int64())).append_column(
            "capacity", pa.array(sizes, pa.int32()))
        yield from got.to_batches()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + ", bin_id long, offset long, capacity int"
    return pieces.repartition(shards).mapInArrow(run, fields)


def token_lengths(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, length): ids of each whole text and one end id; a null text has the end id alone."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer_path).encode
        for batch in batches:
            counts = [encode(texts)[1] + 1 for _, texts in tokens.text_runs(batch.column(1).to_pylist())]
            if counts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(counts))], names=["id", "length"])

    return base.mapInArrow(run, f"id {kind}, length long")
