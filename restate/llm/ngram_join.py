"""N-gram Jaccard self-join with parity sketches.

A text's set is that of its distinct n-word shingles.  Texts A and B link when
their sets' Jaccard similarity is at least ``percent`` / 100; then the sets
differ in at most d = (|A| + |B|) * (1 - t) / (1 + t) shingles.

*Sketch.*  Sizes are dealt into bands.  A band's scheme splits the shingle space
by hash into p > d parts, and a text's sketch holds for each part the XOR (the
parity) of its shingles' hashes.  A shingle that only one of two texts has
disturbs one part, so the number of parts that differ is at most the symmetric
difference, and linked texts agree in at least p - d parts.  Joining on
(scheme, part, XOR) therefore misses no link.  Empty parts tell nothing and are
joined on only by texts with so many of them that the agreeing parts might all
be empty.  A text follows its own band's scheme and, if a text of a smaller band
could be its partner, that band's as well.

*Keys.*  A task sorts its keys and deals them to parts of the key space as cells of some five bytes a key: the gap
to the key before and the number of the node.  A part finds the keys that several nodes share; keys are
shuffled this once.  A key that many nodes of a task have goes out as plain rows instead.

*Verify.*  A second sketch of one parity bit per hash bucket, whose Hamming
distance also bounds the symmetric difference from below, discards most other
candidates; the rest are decided on the whole sets.  Large sets have more buckets, for
few buckets differ in half of their bits whatever the sets, which tells nothing once linked sets may
differ by that much.  Folded in half, a sketch is that of half as many buckets.

*Groups of copies.*  Equal sets are one node from the start.  Among the nodes
that share a key only the pairs with one centre are tested, for two choices of the centre; nodes that are in one
component by then need no more, and the pairs across components that are left
in a key are compared all, the join itself dropping those that the bit sketches
tell apart.  So no group emits all of its pairs, and none of the
links that could join two components is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from restate.llm import textarrays as T
from restate.llm.common import BROADCAST_ROWS, discard, release, store, text_key
from restate.llm.components import connected_components

#: Ratio of a band's sizes; least bits of the verifying sketch; rounds of one centre a key.
BAND_RATIO = 1.5
SKETCH_BITS = 1024
STAR_ROUNDS = 1


@lru_cache(maxsize=4096)
def _band_start(b: int) -> int:
    """First size of band b."""
    return 1 if b == 0 else max(_band_start(b - 1) + 1, math.ceil(_band_start(b - 1) * BAND_RATIO))


@lru_cache(maxsize=4096)
def scheme(b: int, percent: int) -> tuple[int, int]:
    """(p, d) of band b: parts, and the most that linked texts can differ by."""
    small = _band_start(b + 1) - 1
    large = small * 100 // percent
    d = (small + large) * (100 - percent) // (100 + percent)
    slack = math.ceil(2 * d * math.exp(-_band_start(b) / d)) if d else 0
    return d + 1 + slack, d


@lru_cache(maxsize=1 << 16)
def schemes_of(size: int, percent: int) -> tuple[int, ...]:
    """Bands whose scheme a text of that size follows."""
    b = 0
    while _band_start(b + 1) <= size:
        b += 1
    out = [b]
    while b and (_band_start(b) - 1) * 100 >= percent * size:
        b -= 1
        out.append(b)
    return tuple(out)


def join_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set of shingle hashes; linked sets share at least one."""
    out = []
    for b in schemes_of(len(s), percent):
        p, d = scheme(b, percent)
        part = ((T.mix(s + np.uint64(b + 1)) >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        part = part[order]
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        xor = np.bitwise_xor.reduceat(s[order], at)
        used = part[at]
        if p - len(used) >= p - d:
            empty = np.setdiff1d(np.arange(p, dtype=np.uint64), used)
            used, xor = np.concatenate((used, empty)), np.concatenate((xor, np.zeros(len(empty), np.uint64)))
        out.append(T.mix(xor ^ T.mix(used + np.uint64((b + 1) << 32))))
    return np.concatenate(out).view(np.int64)


def signature(s: np.ndarray) -> int:
    """Names a set; never the same for two sets but by a 64-bit hash collision."""
    h = T.mix(s)
    return int(T.mix((h.sum(dtype=np.uint64, keepdims=True) ^ T.mix(np.bitwise_xor.reduce(s, keepdims=True) + np.uint64(len(s))))).view(np.int64)[0])


def sketch_bits(size: int) -> int:
    """Bits of the sketch of a set of ``size``: a power of two, so that the longer of two sketches can be folded to the other's length."""
    return max(SKETCH_BITS, 1 << (size.bit_length() - 1))


def bit_sketch(s: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _list(parts: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64), pa.int64()))


#: Keys that a task sorts at a time (some 70 bytes each), and that one part of the key space holds (about; the more input, the
#: larger both should be); keys a character of text (about, to choose the parts before they are counted); nodes of a task with
#: one key that make it heavy there; bits of a key in its part.
SORT_KEYS, PART_KEYS, KEYS_A_CHAR, HEAVY, PART_BITS = 1 << 19, 1 << 21, 0.15, 8, 40

_ROW = "text_key long, n_shingles long, sig long, sketch array<long>"
_CELL = "part int, hashes binary, nodes binary, sigs binary, hot_keys array<long>, hot_sigs array<long>"


def _planes(a: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of unsigned numbers, byte by byte: the shuffle's compression finds the zeros."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


class _Keys:
    """The (key, node) pairs of a task, sorted and dealt to parts of the key space as cells of few bytes a pair."""

    def __init__(self, part_bits: int):
        self.shift = np.uint64(64 - part_bits)
        self.part_bits, self.keys, self.nodes, self.sigs, self.held = part_bits, [], [], [], 0

    def add(self, sig: int, keys: np.ndarray) -> None:
        self.keys.append(keys)
        self.nodes.append(np.full(len(keys), len(self.sigs), np.uint32))
        self.sigs.append(sig)
        self.held += len(keys)

    def cells(self) -> Iterator[dict]:
        if not self.held:
            return
        keys, nodes, sigs = np.concatenate(self.keys).view(np.uint64), np.concatenate(self.nodes), np.array(self.sigs, np.int64)
        self.keys, self.nodes, self.sigs, self.held = [], [], [], 0
        parts = (keys >> self.shift) if self.part_bits else np.zeros(len(keys), np.uint64)
        # a key's name: its part, then the next PART_BITS bits; two keys of one name are but compared in vain
        names = (parts << np.uint64(PART_BITS)) | ((keys << np.uint64(self.part_bits)) >> np.uint64(64 - PART_BITS))
        order = np.argsort(names, kind="stable")
        names, nodes = names[order], nodes[order]
        at = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        runs = np.diff(np.append(at, len(names)))
        heavy = np.repeat(runs >= HEAVY, runs)
        if heavy.any():
            # a key that many nodes of the task have goes out as rows, which a shuffle may split, and as a mark in its part
            yield {"hot_keys": names[heavy].view(np.int64), "hot_sigs": sigs[nodes[heavy]]}
        marks = names[at][runs >= HEAVY]
        yield from self._coded(names[~heavy], nodes[~heavy], sigs)
        for part, some in _by_part(marks):
            yield {"part": part, "hashes": _planes(np.diff(some, prepend=np.uint64(0)), 5)}

    def _coded(self, names: np.ndarray, nodes: np.ndarray, sigs: np.ndarray) -> Iterator[dict]:
        at = 0
        for part, some in _by_part(names):
            mine = nodes[at:at + len(some)]
            at += len(some)
            used, number = np.unique(mine, return_inverse=True)
            yield {"part": part, "hashes": _planes(np.diff(some, prepend=np.uint64(0)), 5), "nodes": _planes(number, 4), "sigs": sigs[used].tobytes()}


def _by_part(names: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, sorted names within it) of sorted names."""
    parts = names >> np.uint64(PART_BITS)
    cuts = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))).tolist() if len(names) else []
    for a, b in zip(cuts, [*cuts[1:], len(names)]):
        yield int(parts[a]), names[a:b] & np.uint64((1 << PART_BITS) - 1)


def _shared_in_part(table: pa.Table) -> pa.Table:
    """(key, sig) of a part's keys that several nodes have, or that are heavy somewhere."""
    names, sigs, marks, part = [], [], [np.zeros(0, np.uint64)], 0
    for row in table.to_batches():
        for part, hashes, nodes, own in zip(*(row.column(c).to_pylist() for c in ("part", "hashes", "nodes", "sigs"))):
            some = np.cumsum(_from_planes(hashes, 5))
            if nodes is None:
                marks.append(some)
            else:
                names.append(some)
                sigs.append(np.frombuffer(own, np.int64)[_from_planes(nodes, 4).astype(np.int64)])
    names = np.concatenate(names) if names else np.zeros(0, np.uint64)
    sigs = np.concatenate(sigs) if sigs else np.zeros(0, np.int64)
    # keys with a neighbour or a mark; the few of them are then sorted by node too
    order = np.argsort(names, kind="stable")
    names = names[order]
    sigs = sigs[order]
    del order
    keep = np.zeros(len(names), bool)
    same = names[1:] == names[:-1]
    keep[1:] |= same
    keep[:-1] |= same
    # a marked key without a neighbour is found by its place
    marks = np.unique(np.concatenate(marks))
    at = np.searchsorted(names, marks)
    there = at < len(names)
    keep[at[there][names[at[there]] == marks[there]]] = True
    names, sigs = names[keep], sigs[keep]
    order = np.lexsort((sigs, names))
    names, sigs = names[order], sigs[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (sigs[1:] != sigs[:-1])
    keys = (names[new] | np.uint64(part << PART_BITS)).view(np.int64)
    return pa.table({"key": pa.array(keys), "sig": pa.array(sigs[new])})


def _sketch_rows(n: int, percent: int, id_type: pa.DataType, part_bits: int):
    """Rows of two kinds: one for each text, without its keys, and the cells of the task's keys (``part`` or ``hot_keys`` set)."""
    schema = pa.schema([("id", id_type), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.int64()), ("sketch", pa.list_(pa.int64())),
                        ("part", pa.int32()), ("hashes", pa.binary()), ("nodes", pa.binary()), ("sigs", pa.binary()),
                        ("hot_keys", pa.list_(pa.int64())), ("hot_sigs", pa.list_(pa.int64()))])

    def filled(columns: dict, rows: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a set whose keys this task has given needs none again
        held = _Keys(part_bits)

        def given() -> Iterator[pa.RecordBatch]:
            for cell in held.cells():
                yield filled({c: pa.array([v], schema.field(c).type) for c, v in cell.items()}, 1)

        for batch in batches:
            ids, text_keys = batch.column(0), batch.column(2)
            for at, rows, data, off in T.byte_chunks(batch.column(1)):
                h, first = T.words(data, off, T.NOT_SPACE)
                sizes, sigs, sketches = [], [], []
                none = np.zeros(0, np.int64)
                with np.errstate(over="ignore"):
                    for s in T.shingles(h, first, n):
                        sizes.append(len(s))
                        sig = signature(s) if len(s) else None
                        sigs.append(sig)
                        new = len(s) and sig not in seen
                        seen.add(sig)
                        sketches.append(bit_sketch(s, sketch_bits(len(s))) if new else none)
                        if new:
                            held.add(sig, join_keys(s, percent))
                yield filled({"id": ids.slice(at, rows), "text_key": text_keys.slice(at, rows), "n_shingles": pa.array(sizes, pa.int64()),
                              "sig": pa.array(sigs, pa.int64()), "sketch": _list(sketches)}, rows)
                if held.held >= SORT_KEYS:
                    yield from given()
        yield from given()
    return run


def _set_rows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in T.byte_chunks(batch.column(0)):
                h, first = T.words(data, off, T.NOT_SPACE)
                with np.errstate(over="ignore"):
                    sets = [s for s in T.shingles(h, first, n) if len(s)]
                    sigs = [signature(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), _list(sets)], names=["sig", "shingles"])
    return run


def _apart(k_a: str, k_b: str) -> Column:
    """Bits in which two sketches differ, the longer one folded to the length of the other."""
    words = SKETCH_BITS // 64
    short = F.least(F.size(k_a), F.size(k_b))

    def folded(k: str) -> Column:
        sums = F.transform(F.sequence(F.lit(0), short - 1), lambda i: F.aggregate(
            F.sequence(i, F.size(k) - 1, short), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(k, j))))
        return F.when(F.size(k) > short, sums).otherwise(F.col(k))
    wide = F.aggregate(F.zip_with(folded(k_a), folded(k_b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    least = sum((F.bit_count(F.get(k_a, i).bitwiseXOR(F.get(k_b, i))) for i in range(words)), F.lit(0))
    return F.when(F.greatest(F.size(k_a), F.size(k_b)) > words, wide).otherwise(least)


def _may_link(n_a: str, k_a: str, n_b: str, k_b: str, percent: int) -> Column:
    """Sizes and bit sketches of two nodes allow a link."""
    apart = _apart(k_a, k_b)
    return ((100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b))
            & (apart * (100 + percent) <= (F.col(n_a) + F.col(n_b)) * (100 - percent)))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of node signatures that link."""
    attrs = nodes.select("sig", "n_shingles", "sketch")
    for side in "ab":
        pairs = pairs.join(attrs.select(F.col("sig").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"k_{side}")), side)
    pairs = store(pairs.where(_may_link("n_a", "k_a", "n_b", "k_b", percent)).select("a", "b", "n_a", "n_b"), "ngram-pairs")
    release(pairs.sparkSession)
    need = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    rep = store(nodes.join(need, "sig").select(F.col("id").alias("rep_id"), F.col("text_key").alias("rep_key")), "ngram-wanted")
    if rep.count() <= BROADCAST_ROWS:  # few rows are named: the texts are not shuffled to find them
        rep = F.broadcast(rep)
    sets = texts.join(rep, (F.col("text_key") == F.col("rep_key")) & F.col("id").eqNullSafe(F.col("rep_id")), "left_semi").select(
        "text").mapInArrow(_set_rows(n), "sig long, shingles array<long>")
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("sig").alias(side), F.col("shingles").alias(f"s_{side}")), side)
    both = F.size(F.array_intersect("s_a", "s_b"))
    # few rows of many tasks: dealt anew, they are stored in few files
    return pairs.where(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b").repartition("a", "b").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """id, text_key, n_shingles, component, component_id for every row of ``docs``.

    ``component_id`` is the least id in reach by links; ``component`` names the
    component itself and is null for texts without shingles.

    Words are what lies between ASCII white space, A-Z lower-cased.  A text of
    fewer than ``n`` words is one shingle; a null text, or one without words, has
    no shingle and links with nothing.  Rows with equal sets link, repeated ids
    and rows included, and each row of the input gives one row.  Ids of any
    orderable type; null ids are in components but name none.  An empty table
    gives no rows; other columns are left out, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = base.select("id", "text", text_key("text").alias("text_key"))
    id_type = base.schema["id"].dataType.simpleString()
    chars = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    part_bits = min(22, math.ceil(math.log2(max(1, chars * KEYS_A_CHAR / PART_KEYS))))
    made = store(keyed.mapInArrow(_sketch_rows(n, percent, to_arrow_type(base.schema["id"].dataType), part_bits), f"id {id_type}, {_ROW}, {_CELL}"), "ngram-rows")
    told = made.where(F.col("text_key").isNotNull() & (F.size("sketch") > 0))
    nodes = store(told.select("sig", "n_shingles", "sketch", "id", "text_key").dropDuplicates(["sig"]), "ngram-nodes")
    rows = store(made.where(F.col("text_key").isNotNull()).select("id", "text_key", "n_shingles", "sig"), "ngram-names")
    spark = docs.sparkSession

    # keys meet in the parts of their space, once; members of those that several nodes share, with the key's least node
    kv = made.where(F.col("part").isNotNull()).select("part", "hashes", "nodes", "sigs").groupBy("part").applyInArrow(_shared_in_part, "key long, sig long")
    hot = made.where(F.col("hot_keys").isNotNull()).select(F.explode(F.arrays_zip("hot_keys", "hot_sigs")).alias("x"))
    kv = store(kv.unionByName(hot.select(F.col("x.hot_keys").alias("key"), F.col("x.hot_sigs").alias("sig"))), "ngram-shared")
    discard(made)  # the cells are many times as large as what is left of them
    release(spark)
    shared = kv.groupBy(F.col("key").alias("s_key")).agg(F.min("sig").alias("centre"), F.max("sig").alias("last"))
    shared = shared.where(F.col("centre") < F.col("last")).select("s_key", "centre")
    members = store(kv.join(shared, F.col("key") == F.col("s_key")).select("key", "sig", "centre").distinct(), "ngram-members")
    discard(kv)
    release(spark)

    links = store(_verified(_pairs(members.select(F.col("sig").alias("a"), F.col("centre").alias("b"))), nodes, keyed, n, percent), "ngram-links")
    release(spark)
    stars = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    attrs = nodes.select(F.col("sig").alias("n_sig"), "n_shingles", "sketch")
    for turn in range(STAR_ROUNDS + 1):
        # what is left of a key: members of different components
        active = members.join(stars, F.col("sig") == F.col("node"), "left").select(
            "key", "sig", F.coalesce("root", "sig").alias("root"))
        split = active.groupBy(F.col("key").alias("s_key")).agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
        split = split.where(F.col("r0") < F.col("r1")).select("s_key")
        active = active.join(split, F.col("key") == F.col("s_key"), "left_semi")
        # one centre a key makes no more pairs than members: their sketches are compared after copies of a pair are one.  All
        # pairs of a key are told apart inside the join, so its members bring their sketches
        last = turn == STAR_ROUNDS
        active = active.join(attrs if last else attrs.drop("sketch"), F.col("sig") == F.col("n_sig"))
        active = store(active.select("key", "sig", "root", "n_shingles", *(["sketch"] if last else [])), "ngram-active")
        release(spark)
        other = active.select(*(F.col(c).alias(f"o_{c}") for c in active.columns))
        if last:  # the rest: every pair across components
            may = (F.col("sig") < F.col("o_sig")) & _may_link("n_shingles", "sketch", "o_n_shingles", "o_sketch", percent)
        else:  # another centre for each key
            other = other.groupBy("o_key").agg(F.min_by(F.struct(*other.columns[1:]), F.xxhash64("o_sig", "o_key", F.lit(turn))).alias("o"))
            other = other.select("o_key", "o.*")
            may = (F.col("sig") != F.col("o_sig")) & (100 * F.least("n_shingles", "o_n_shingles") >= percent * F.greatest("n_shingles", "o_n_shingles"))
        wanted = active.join(other, (F.col("key") == F.col("o_key")) & (F.col("root") != F.col("o_root")) & may)
        wanted = _pairs(wanted.select(F.col("sig").alias("a"), F.col("o_sig").alias("b")))
        found = store(_verified(wanted, nodes, keyed, n, percent), "ngram-links")
        discard(active)
        release(spark)
        if found.take(1):
            stars = connected_components(stars.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(
                found.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    discard(members, nodes)

    named = rows.join(stars, F.col("sig") == F.col("node"), "left").select(
        "id", "text_key", "n_shingles", F.coalesce("root", "sig").alias("root"))
    least = named.where(F.col("root").isNotNull()).groupBy(F.col("root").alias("l_root")).agg(F.min("id").alias("least_id"))
    return named.join(least, F.col("root") == F.col("l_root"), "left").select(
        "id", "text_key", "n_shingles", F.col("root").alias("component"), F.coalesce("least_id", "id").alias("component_id"))


def spare_copies(groups: DataFrame) -> DataFrame:
    """(id, text_key) of the rows of a stored ``similar_groups`` that their component can do without: all but its least."""
    first = groups.where(F.col("component").isNotNull()).groupBy(F.col("component").alias("f_component")).agg(
        F.min(F.struct("id", "text_key")).alias("f"))
    rows = groups.join(first, F.col("component") == F.col("f_component"))
    return rows.where(~(F.col("id").eqNullSafe(F.col("f.id")) & (F.col("text_key") == F.col("f.text_key")))).select("id", "text_key")


def _pairs(ab: DataFrame) -> DataFrame:
    """Distinct unordered pairs of different nodes."""
    return ab.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
