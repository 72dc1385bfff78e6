import math
import random

from pyspark.sql import functions as F

from restate.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, extra string"


def brute(rows, anchor, k=5, low=80, high=100):
    good, seen = [], set()
    for i, v, l, *_ in rows:
        if i is None or v is None or l is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = (i, l, tuple(math.floor(256 * x) for x in v))
        if r not in seen:
            seen.add(r)
            good.append(r)
    out = []
    for i, l, v in good:
        if not anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in good if j != i and len(w) == len(v)))
        for s, j, m in [x for x in scored if x[2] == l][:k]:
            s = -s
            hits = [(-t, n) for t, n, o in scored if o != l and low * s <= 100 * -t <= high * s][:k]
            out += [(i, j, r + 1, n, s, t) for r, (t, n) in enumerate(hits)]
    return sorted(out)


def run(spark, rows, modulus=4, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    vecs = hn.integer_vectors(df, "vec_id", "embedding", F.col("label"), 256)
    got = hn.mine(vecs, F.col("id") % modulus == 0, **kw)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_equals_brute_force_over_many_leaves(llm, monkeypatch):
    monkeypatch.setattr(hn, "SLAB_ROWS", 150)
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centres[i % 5]], rng.randrange(4), "x") for i in range(900)]
    assert run(llm, rows, 30) == brute(rows, lambda i: i % 30 == 0)


def test_edges(llm):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1, None), (1, [1.0, 0.0], 1, None), (2, [1.0, 0.0], 2, None), (2, [1.0, 0.0], 2, None), (3, [0.9, 0.1], 2, None),
            (4, [-1.0, 0.0], 3, None), (5, [-0.5, 0.0], 3, None), (6, [0.8, 5.0], 2, None), (None, [1.0, 0.0], 1, None), (7, None, 1, None),
            (8, [nan, 1.0], 1, None), (9, [inf, 1.0], 1, None), (10, [None, 1.0], 1, None), (11, [1.0, 1.0], None, None), (12, [], 1, None),
            (13, [], 1, None), (14, [], 2, None), (16, [1.0, 2.0, 3.0], 1, None), (20, [1.0, 2.0, 3.0], 1, None), (24, [0.9, 2.0, 3.0], 2, None),
            (28, [0.0, 0.0], 5, None), (29, [0.0, 0.0], 5, None), (4, [1.0, 0.5], 1, None)]
    got = run(llm, rows)
    assert got == brute(rows, lambda i: i % 4 == 0)
    assert (12, 13, 1, 14, 0, 0) in got  # empty vectors: every product is 0
    # too large for 64 bits: takes no part
    assert run(llm, [*rows, (32, [1e300, 1.0], 1, None), (36, [1e12, 1.0], 1, None)]) == got


def test_large_components_are_exact(llm):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-10**5, 10**5)) for _ in range(8)], i % 3, "") for i in range(200)]
    assert run(llm, rows, 10) == brute(rows, lambda i: i % 10 == 0)


def test_one_vector_shared_by_many_rows_and_blocks_of_anchors(llm, monkeypatch):
    monkeypatch.setattr(hn, "SLAB_ROWS", 64)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 7)
    rows = [(i, [0.5, 0.25, 0.125], i % 2, "") for i in range(400)] + [(i, [0.5 + i / 5000, 0.2, 0.1], i % 3, "") for i in range(400, 600)]
    assert run(llm, rows, 20) == brute(rows, lambda i: i % 20 == 0)


def test_empty_table(llm):
    assert run(llm, []) == []
