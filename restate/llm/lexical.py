"""Ranked lexical search over bit-sliced Bloom signatures.

*Index.*  A document's signature sets two bits for every pair (term, level) such that the term occurs at
least ``level`` times in it.  Its length follows the number of those pairs, so long documents
fill theirs no more than short ones.  Documents of one signature length make segments, stored
sliced by bit: one bitmap of documents for every bit.

*Bounds.*  For a query term, the bitmaps of a level and'ed overestimate the documents that hold it that
often.  The gain of each level, summed with the terms' weights over the slices, gives every document an upper
bound of its score, for the document's own length.

*Search.*  The documents of the highest bounds are scored on their texts first; the k-th best of them is
each query's threshold.  Then all documents whose bound is not below it are scored on their texts:
nothing is left out that is not provably outside the result.  A text already scored counts by its score.

Queries are worked on in blocks of a bounded number, each sent to all tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from restate.llm.common import BROADCAST_ROWS, store, text_key
from restate.llm.textarrays import ALNUM, LOWER, byte_chunks, mix, words

#: Occurrences that have a bit of their own; bits of a signature for each (term, level), shortest signature,
#: bits of a segment.
LEVELS = (1, 2, 3, 4, 5, 6, 8, 11, 16)
BITS_A_KEY, MIN_BITS, SEGMENT_BITS = 24, 1024, 1 << 24
#: Documents scored at first, for each one asked for; queries, and characters of their texts, of a block (about: dealt by hash).
SEEDS, QUERY_BLOCK, QUERY_CHARS = 2, 1000, 4_000_000

_NULL_ID = np.iinfo(np.int64).max
_LEVEL_KEYS = [np.uint64((0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64)) for i in range(len(LEVELS))]
_INDEX = "bits int, docs int, words long, ids array<long>, keys binary, lengths binary, slices binary"
_INDEX_ARROW = pa.schema([("bits", pa.int32()), ("docs", pa.int32()), ("words", pa.int64()), ("ids", pa.list_(pa.int64())),
                          ("keys", pa.binary()), ("lengths", pa.binary()), ("slices", pa.binary())])
_BOUND = "item int, id long, key long, upper long"
_BOUND_ARROW = pa.schema([("item", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("upper", pa.int64())])

#: Bytes to the term they stand in: A-Z lower-cased; what is no letter, digit or beyond ASCII parts terms.
_TERM_BYTES = bytes(int(LOWER[b]) if ALNUM[LOWER[b]] else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; null has none."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def _slots(hashes: np.ndarray, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(hashes ^ _LEVEL_KEYS[level])
    return h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)


class _Segment:
    def __init__(self, bits: int):
        self.bits, self.room = bits, max(8, SEGMENT_BITS // bits // 8 * 8)
        self.slices = np.zeros((bits, self.room // 8), np.uint8)
        self.ids, self.keys, self.lengths = [], [], []

    def add(self, doc, key: int, length: int, hashes: list[np.ndarray]) -> None:
        at = len(self.ids)
        bit = np.uint8(128 >> (at % 8))
        for level, h in enumerate(hashes):
            for slots in _slots(h, level, self.bits):
                self.slices[slots, at // 8] |= bit
        self.ids.append(doc)
        self.keys.append(key)
        self.lengths.append(length)

    def row(self) -> pa.RecordBatch:
        used = np.ascontiguousarray(self.slices[:, :(len(self.ids) + 7) // 8])
        return pa.RecordBatch.from_pylist([{
            "bits": self.bits, "docs": len(self.ids), "words": sum(self.lengths), "ids": self.ids, "keys": np.array(self.keys, np.int64).tobytes(),
            "lengths": np.array(self.lengths, np.int64).tobytes(), "slices": used.tobytes()}], schema=_INDEX_ARROW)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: dict[int, _Segment] = {}
    for batch in batches:
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for row, n, data, off in byte_chunks(batch.column(2)):
            h, first = words(data, off, ALNUM)
            for i in range(n):
                a, b = int(first[i]), int(first[i + 1])
                if a == b:
                    continue
                distinct, counts = np.unique(h[a:b], return_counts=True)
                levels = [distinct]
                for level in LEVELS[1:]:
                    at = counts >= level
                    if not at.any():
                        break
                    levels.append(distinct[at])
                need = BITS_A_KEY * sum(len(x) for x in levels)
                bits = max(MIN_BITS, 1 << max(0, need - 1).bit_length())
                segment = open_.get(bits)
                if segment is None:
                    segment = open_[bits] = _Segment(bits)
                segment.add(ids[row + i], keys[row + i], b - a, levels)
                if len(segment.ids) == segment.room:
                    yield open_.pop(bits).row()
    for segment in open_.values():
        yield segment.row()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index, a row a segment.  Documents without a term (null and empty ones too) are not in it."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    return store(rows.mapInArrow(_index, _INDEX), "signatures")


def _document_frequencies(vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        held = Counter()
        for batch in batches:
            for text in batch.column(0):
                data = text.cast(pa.binary()).as_py()
                if data:
                    held.update(known.keys() & set(data.translate(_TERM_BYTES).split()))
        yield pa.RecordBatch.from_pydict({"term": pa.array([known[t] for t in held], pa.int32()), "df": pa.array(list(held.values()), pa.int64())})

    return count


def length_factor(n, docs: int, total: int):
    """100 - 25 + 25 n / (average length), as integers, of a document of ``n`` terms."""
    return 75 + (25 * n * docs) // total


def gain(tf, m):
    """What ``tf`` occurrences count of a term's weight, in millionths, as an integer."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class _Block:
    """The queries of a block: terms with weights by query, and the terms' hashes."""

    def __init__(self, texts: list[str | None]):
        self.counts = [Counter(terms(t)) for t in texts]
        self.terms = sorted({t for c in self.counts for t in c})
        self.numbers = {t: i for i, t in enumerate(self.terms)}

    def weigh(self, frequencies: dict[int, int], docs: int, total: int) -> None:
        self.docs, self.total = docs, total
        weight = {i: math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for i, df in frequencies.items()}
        self.queries = []
        for c in self.counts:
            held = [(self.numbers[t], k * weight[self.numbers[t]]) for t, k in c.items() if self.numbers[t] in weight]
            self.queries.append((np.array([t for t, _ in held], np.int64), np.array([w for _, w in held], np.int64)))
        self.named = [{self.terms[t]: int(w) for t, w in zip(*q)} for q in self.queries]
        data = b" ".join(self.terms)
        self.hashes = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ALNUM)[0]

    def bounds(self, row: dict) -> np.ndarray:
        """Upper bound of every query's score of every document of a segment."""
        n, bits = row["docs"], row["bits"]
        slices = np.frombuffer(row["slices"], np.uint8).reshape(bits, -1)
        lengths = np.frombuffer(row["lengths"], np.int64)
        m = length_factor(lengths, self.docs, self.total)
        out = np.zeros((len(self.queries), n), np.int64)
        before = np.zeros(n, np.int64)
        for level in range(len(LEVELS)):
            a, b = _slots(self.hashes, level, bits)
            held = slices[a] & slices[b]
            some = held.any(axis=1)
            if not some.any():
                break
            most = np.minimum(lengths, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else lengths
            most = gain(np.maximum(most, LEVELS[level]), m)
            step, before = most - before, most
            place = np.cumsum(some) - 1
            present = np.unpackbits(held[some], axis=1)[:, :n].astype(np.float64)
            for q, (at, weights) in enumerate(self.queries):
                at, weights = at[some[at]], weights[some[at]]
                if len(at):
                    # sums of whole numbers far below 2^53: exact in doubles
                    out[q] += step * (weights.astype(np.float64) @ present[place[at]]).astype(np.int64)
        return out


def _ids(row: dict) -> np.ndarray:
    return np.array([_NULL_ID if i is None else i for i in row["ids"]], np.int64)


def _rows(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    for item, ids, keys, upper in parts:
        ids = pa.array(ids, mask=ids == _NULL_ID) if len(ids) else pa.array([], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item, np.int32)), ids, pa.array(keys), pa.array(upper)], schema=_BOUND_ARROW)


def _highest(block, k: int):
    """Each task's ``k`` documents of the highest bounds of every query; equal bounds by ascending id."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = block.value
        best = [(np.zeros(0, np.int64),) * 3 for _ in q.queries]
        for batch in batches:
            for row in batch.to_pylist():
                ids, keys = _ids(row), np.frombuffer(row["keys"], np.int64)
                for item, upper in enumerate(q.bounds(row)):
                    floor = max(1, best[item][2][-1]) if len(best[item][2]) == k else 1
                    at = np.flatnonzero(upper >= floor)
                    if len(at):
                        i, t, u = (np.concatenate([x, y[at]]) for x, y in zip(best[item], (ids, keys, upper)))
                        order = np.lexsort((i, -u))[:k]
                        best[item] = i[order], t[order], u[order]
        yield from _rows([(item, *b) for item, b in enumerate(best) if len(b[0])])

    return search


def _not_excluded(block, thresholds, known, k: int):
    """The documents of every query whose bound, or whose text's score if it is known, is not below the threshold.

    Of documents of one text in a segment the ``k`` smallest ids: more cannot be in the result."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least, scored = block.value, thresholds.value, known.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, keys = _ids(row), np.frombuffer(row["keys"], np.int64)
                out = []
                for item, upper in enumerate(q.bounds(row)):
                    score, last = least[item]
                    at = np.flatnonzero(upper >= max(1, score))
                    if not len(at):
                        continue
                    upper, mine = upper[at], scored[item]
                    place = np.minimum(np.searchsorted(mine[0], keys[at]), len(mine[0]) - 1) if len(mine[0]) else None
                    if place is not None:
                        upper = np.where(mine[0][place] == keys[at], mine[1][place], upper)
                    at = at[(upper > score) | (upper == score) & (upper > 0) & (ids[at] <= last)]
                    if len(at):
                        at = at[np.lexsort((ids[at], keys[at]))]
                        new = np.flatnonzero(np.diff(keys[at], prepend=keys[at][0] ^ 1))
                        nth = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
                        at = at[nth < k]
                        out.append((item, ids[at], keys[at], np.zeros(len(at), np.int64)))
                yield from _rows(out)

    return search


def _scorer(block):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = block.value
        for batch in batches:
            out: list[tuple] = []
            for doc, key, items, text in zip(*(batch.column(i) for i in range(4))):
                found = terms(text.as_py())
                m = length_factor(len(found), q.docs, q.total)
                tf = Counter(found)
                gains: dict[bytes, int] = {}
                doc, key = doc.as_py(), key.as_py()
                for item in items.as_py():
                    total = 0
                    for t, w in q.named[item].items():
                        if t in tf:
                            if t not in gains:
                                gains[t] = gain(tf[t], m)
                            total += w * gains[t]
                    if total > 0:
                        out.append((item, doc, key, total))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _BOUND_ARROW.types)], schema=_BOUND_ARROW)

    return score


def _score(docs: DataFrame, pairs: DataFrame, block) -> DataFrame:
    """(item, id, key, score) of each row of ``docs`` that ``pairs`` (item, id, key) names; scores of 0 are left out."""
    named = pairs.groupBy(F.col("id").alias("p_id"), F.col("key").alias("p_key")).agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = store(named, "to-score")
    if named.count() <= BROADCAST_ROWS // 20:  # with 20 queries each some 30 MB at most
        named = F.broadcast(named) if named.agg(F.sum(F.size("items"))).first()[0] or 0 <= BROADCAST_ROWS else named
    hit = docs.join(named, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("key") == F.col("p_key"))).select("id", "key", "items", "text")
    return store(hit.mapInArrow(_scorer(block), _BOUND).withColumnRenamed("upper", "score"), "scored")


def _first(rows: DataFrame, k: int, by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(by), F.asc_nulls_last("id"), "key"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _rank_block(docs: DataFrame, index: DataFrame, texts: list[str | None], top: int, size: tuple[int, int]) -> DataFrame:
    spark = docs.sparkSession
    sc = spark.sparkContext
    block = _Block(texts)
    counted = docs.select("text").mapInArrow(_document_frequencies(sc.broadcast(block.numbers)), "term int, df long")
    block.weigh({r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}, *size)
    sent = sc.broadcast(block)
    seeds = store(_first(index.mapInArrow(_highest(sent, SEEDS * top), _BOUND), SEEDS * top, "upper").select("item", "id", "key"), "seeds")
    first = _score(docs, seeds, sent)
    # at most SEEDS * top texts of each query of the block
    known: list[dict] = [{} for _ in texts]
    ranked: list[list] = [[] for _ in texts]
    for r in first.select("item", "id", "key", "score").distinct().collect():
        known[r["item"]][r["key"]] = r["score"]
        ranked[r["item"]].append((-r["score"], _NULL_ID if r["id"] is None else r["id"]))
    least = []
    for r in ranked:
        r.sort()
        least.append((-r[top - 1][0], r[top - 1][1]) if len(r) >= top else (0, _NULL_ID))
    arrays = [(np.array(sorted(x), np.int64), np.array([x[key] for key in sorted(x)], np.int64)) for x in known]
    rest = index.mapInArrow(_not_excluded(sent, sc.broadcast(least), sc.broadcast(arrays), top), _BOUND).select("item", "id", "key").distinct()
    done = seeds.select(F.col("item").alias("s_item"), F.col("id").alias("s_id"), F.col("key").alias("s_key")).distinct()
    rest = rest.join(done, (F.col("item") == F.col("s_item")) & F.col("id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key")), "left_anti")
    return _first(first.unionByName(_score(docs, rest, sent)), top, "score")


def rank(docs: DataFrame, items: DataFrame, top: int = 20, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of the highest score above 0 for each query text.

    Equal scores come by ascending id, a null id last; every row of ``docs`` is a document of its own, so
    repeated rows take ranks of their own.  Query rows that repeat id and text are one; a null or
    empty query, one whose terms no document holds, and an empty table give no rows."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    empty = spark.createDataFrame([], f"item_id {items.schema[item_col].dataType.simpleString()}, rank int, doc_id long, score long")
    index = build_index(docs, "id", "text") if index is None else index
    size = index.agg(F.sum("docs"), F.sum("words")).first()
    items = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")).where(F.length("text") > 0).distinct()
    volume = items.agg(F.count("*"), F.sum(F.length("text"))).first()
    if not size[0] or not volume[0]:
        return empty
    blocks = max(math.ceil(volume[0] / QUERY_BLOCK), math.ceil(volume[1] / QUERY_CHARS))
    out = empty
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        if not some:
            continue
        found = _rank_block(docs, index, [r["text"] for r in some], top, (int(size[0]), int(size[1])))
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], f"n int, {empty.schema['item_id'].simpleString().replace(':', ' ', 1)}")
        out = out.unionByName(store(found.join(F.broadcast(names), F.col("item") == F.col("n")).select(
            "item_id", "rank", F.col("id").alias("doc_id"), "score"), "ranked"))
    return out
