import random
import tracemalloc

import numpy as np
import pyarrow as pa

from restate.llm import common, ngram_join as N, textarrays as T, tokens


def test_batches_of_long_texts_are_bounded(llm):
    llm.conf.unset(common.BATCH_BYTES[0])
    common.ship(llm)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), "size": pa.array([b.nbytes], pa.int64())})

    rows = llm.range(0, 400, 1, 1).selectExpr("repeat(cast(id as string), 20000) as text")
    got = rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 400
    assert max(r["size"] for r in got) < 6 << 20


def test_a_session_keeps_its_own_bound(llm):
    llm.conf.set(common.BATCH_BYTES[0], "2m")
    common.ship(llm)
    assert llm.conf.get(common.BATCH_BYTES[0]) == "2m"
    llm.conf.unset(common.BATCH_BYTES[0])


def test_hashing_short_texts_takes_little_memory(monkeypatch):
    monkeypatch.setattr(T, "_powers", np.ones(1, np.uint64))
    monkeypatch.setattr(T, "_inverses", np.ones(1, np.uint64))
    texts = pa.array(["some words of a text " * 50] * 8000)
    tracemalloc.start()
    for _, _, data, off in T.byte_chunks(texts):
        T.words(data, off, T.NOT_SPACE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20


def test_chunks_do_not_change_hashes(monkeypatch):
    rng = random.Random(3)
    texts = pa.array([" ".join(rng.choices(["one", "two", "three", "é"], k=rng.choice([0, 1, 30, 4000]))) for _ in range(60)])

    def hashes():
        found = []
        for _, rows, data, off in T.byte_chunks(texts):
            h, first = T.words(data, off, T.NOT_SPACE)
            found += [h[first[i]:first[i + 1]].tolist() for i in range(rows)]
        return found

    whole = hashes()
    monkeypatch.setattr(T, "CHUNK_BYTES", 1 << 9)
    assert hashes() == whole


def test_keys_shared_or_marked_in_a_part():
    rng = np.random.default_rng(6)
    table = {"part": [], "hashes": [], "nodes": [], "sigs": []}
    held, marked = {}, [5, 77, 900, 1999]
    for cell in range(3):
        names = np.sort(rng.choice(2000, 300, replace=False)).astype(np.uint64)
        sigs = rng.integers(-2**60, 2**60, 300)
        for k, s in zip(names.tolist(), sigs.tolist()):
            held.setdefault(k, set()).add(s)
        for c, v in zip(table, (3, N._planes(np.diff(names, prepend=np.uint64(0)), 5), N._planes(np.arange(300), 4), sigs.tobytes())):
            table[c].append(v)
    for c, v in zip(table, (3, N._planes(np.diff(np.array(marked, np.uint64), prepend=np.uint64(0)), 5), None, None)):
        table[c].append(v)
    schema = pa.schema([("part", pa.int32()), ("hashes", pa.binary()), ("nodes", pa.binary()), ("sigs", pa.binary())])
    got = N._shared_in_part(pa.table(table, schema=schema))
    want = {(k | 3 << N.PART_BITS, s) for k, v in held.items() if len(v) > 1 or k in marked for s in v}
    assert set(zip(got.column("key").to_pylist(), got.column("sig").to_pylist())) == want
    assert got.num_rows == len(want)


def test_texts_of_candidates_are_found_without_a_shuffle_of_texts(llm, monkeypatch):
    """Also where Spark would broadcast nothing by itself."""
    plans, verified = [], N._verified

    def kept(*args):
        out = verified(*args)
        plans.append(out._jdf.queryExecution().sparkPlan().toString())
        return out

    monkeypatch.setattr(N, "_verified", kept)
    llm.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        words = [f"w{i}" for i in range(60)]
        docs = llm.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(6)], "doc_id long, text string")
        assert {r["component_id"] for r in N.similar_groups(docs).collect()} == {0}
    finally:
        llm.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    semi = [line for p in plans for line in p.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)


def test_texts_are_encoded_in_chunks_of_bounded_size():
    texts = ["word " * 40] * 9000 + [None, "y" * 900_000, "z"]
    runs = list(tokens.text_runs(texts))
    assert [t for _, run in runs for t in run] == [t or "" for t in texts]
    assert [at for at, _ in runs] == [sum(len(run) for _, run in runs[:i]) for i in range(len(runs))]
    assert all(len(run) == 1 or sum(map(len, run)) <= 1 << 18 for _, run in runs)
