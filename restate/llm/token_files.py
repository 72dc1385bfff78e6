"""Token ids in patched frame-of-reference blocks.

A segment is a run of whole documents' ids, cut into blocks of 128.  A block
stores its minimum, the width that holds most of its residuals (a percentile),
every residual's low bits packed at that width, and for the few that need more an
exception: position and high bits.  An index of block starts lets a reader decode
any range of ids without the rest::

    "PFR1" | ids u64 | blocks u32 | exceptions u32          (little-endian)
    minimum u32 x blocks | width u8 x blocks
    start of the packed words u32 x (blocks + 1)
    start of the exceptions u32 x (blocks + 1)
    exception value u32 x exceptions | exception position u8 x exceptions
    packed words u32

The files are Parquet files that Spark writes: a row holds a segment's bytes and
the documents in it.  So they get Spark's commit protocol (a lost executor's half
written file never counts) and can lie in any store that Spark reaches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from restate.llm import tokens

BLOCK = 128
#: Share of a block's residuals that its width holds; the rest may be exceptions.
PERCENTILE = 0.9
#: Ids after which a segment ends with the document at hand.
SEGMENT_IDS = 1 << 20
_HEAD = struct.Struct("<4sQII")


def _bit_length(v: np.ndarray) -> np.ndarray:
    return np.frexp(v.astype(np.float64))[1].astype(np.int64)


def encode_ids(ids: np.ndarray) -> bytes:
    """The bytes of a segment.  Ids are unsigned 32-bit; none at all is fine."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    padded = padded.reshape(blocks, BLOCK)
    low = padded.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = padded - low[:, None]
    kth = int(PERCENTILE * (BLOCK - 1))
    width = _bit_length(np.partition(rest, kth, axis=1)[:, kth]) if blocks else np.zeros(0, np.int64)
    words = width * (BLOCK // 32)
    starts = np.concatenate(([0], np.cumsum(words))).astype(np.uint32)
    packed = np.zeros(int(starts[-1]), np.uint32)
    high = (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, pos = np.nonzero(high)
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        v = (rest[which].T.astype(np.uint64)) & np.uint64((1 << w) - 1)
        out = np.zeros((w * BLOCK // 32 + 1, len(which)), np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 32)
            moved = v[j] << np.uint64(shift)
            out[word] |= moved & np.uint64(0xFFFFFFFF)
            if shift + w > 32:
                out[word + 1] |= moved >> np.uint64(32)
        packed[starts[which].astype(np.int64)[:, None] + np.arange(w * BLOCK // 32)] = out[:-1].T
    exc = np.zeros(blocks + 1, np.uint32)
    np.cumsum(np.bincount(row, minlength=blocks)[:blocks], out=exc[1:]) if blocks else None
    return b"".join((_HEAD.pack(b"PFR1", n, blocks, len(row)), low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(),
                     starts.astype("<u4").tobytes(), exc.astype("<u4").tobytes(), high[row, pos].astype("<u4").tobytes(),
                     pos.astype(np.uint8).tobytes(), packed.astype("<u4").tobytes()))


def decode_ids(data: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` ids from ``first`` on (default: all); decodes only the blocks that hold them."""
    magic, n, blocks, n_exc = _HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a PFR1 segment")
    at = _HEAD.size

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, k, at)
        at += out.nbytes
        return out

    low, width, starts = take("<u4", blocks), take("u1", blocks), take("<u4", blocks + 1)
    exc, values, places = take("<u4", blocks + 1), take("<u4", n_exc), take("u1", n_exc)
    packed = take("<u4", int(starts[-1]))
    stop = n if count is None else min(n, first + count)
    if first >= stop:
        return np.zeros(0, np.uint32)
    b0, b1 = first // BLOCK, -(-stop // BLOCK)
    out = np.zeros((b1 - b0, BLOCK), np.uint32)
    for w in np.unique(width[b0:b1]).tolist():
        if not w:
            continue
        which = b0 + np.flatnonzero(width[b0:b1] == w)
        src = packed[starts[which].astype(np.int64)[:, None] + np.arange(w * BLOCK // 32)].T.astype(np.uint64)
        got = np.zeros((BLOCK, len(which)), np.uint32)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 32)
            v = src[word] >> np.uint64(shift)
            if shift + w > 32:
                v = v | (src[word + 1] << np.uint64(32 - shift))
            got[j] = v & np.uint64((1 << w) - 1)
        out[which - b0] = got.T
    e0, e1 = int(exc[b0]), int(exc[b1])
    row = np.repeat(np.arange(b1 - b0), np.diff(exc[b0:b1 + 1].astype(np.int64)))
    out[row, places[e0:e1]] |= (values[e0:e1].astype(np.uint64) << width[b0 + row].astype(np.uint64)).astype(np.uint32)
    out += low[b0:b1, None]
    return out.reshape(-1)[first - b0 * BLOCK:stop - b0 * BLOCK]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every whole text, ``end_id`` after it, and write the ids in ascending id order.

    Ranges of ids are the shards; a shard's rows are sorted and stream through one
    task that holds a segment at a time.  Null texts are empty: they are the end
    id alone.  Null ids come first; rows that repeat an id each keep their place,
    ordered by a hash of the text, which also splits an id that many rows share.
    An empty table writes no segment.  Other columns are left out.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = ["id", F.xxhash64("text")]
    ranged = base.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        counts: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, first, held
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([doc_ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([encode_ids(np.concatenate(parts))], pa.binary())],
                names=["shard", "segment", "first", "n_ids", "doc_ids", "n_tokens", "payload"])
            segment, first, held = segment + 1, first + held, 0
            for x in (doc_ids, counts, parts):
                x.clear()
            return row

        encode = tokens.encoder(tokenizer_path).encode
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in tokens.text_runs(batch.column(1).to_pylist()):
                flat, n = encode(texts)
                ends = np.cumsum(n)
                parts.append(np.insert(flat, ends, end_id))
                doc_ids.extend(ids[at:at + len(texts)])
                counts.extend((n + 1).tolist())
                held += len(flat) + len(texts)
                if held >= segment_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    ranged.mapInArrow(run, "shard int, segment int, first long, n_ids long, doc_ids array<long>, n_tokens array<long>, payload binary").write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, in no order.

    ``start`` counts the ids of all documents before it, over all shards."""
    files = spark.read.parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, first, docs, counts, payload = (batch.column(c)[r].as_py() for c in range(5))
                ids = decode_ids(payload).astype("<u4")
                n = np.array(counts, np.int64)
                ends = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(first + ends - n, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    docs = files.select("shard", "first", "doc_ids", "n_tokens", "payload").mapInArrow(
        run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    # one total per shard: as many rows as the write had tasks
    totals = files.groupBy(F.col("shard").alias("b_shard")).agg(F.sum("n_ids").alias("ids"))
    base = totals.select("b_shard", (F.sum("ids").over(Window.orderBy("b_shard")) - F.col("ids")).alias("base"))
    return docs.join(base, F.col("shard") == F.col("b_shard")).select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
