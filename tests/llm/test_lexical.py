import math
import random
import re
from collections import Counter

from restate.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, top=20):
    split = [(i, [t.translate(UPPER) for t in TERM.findall(x or "")]) for i, x, *_ in docs]
    split = [(i, w) for i, w in split if w]
    n_docs, total = len(split), sum(len(w) for _, w in split)
    df = Counter(t for _, w in split for t in set(w))
    out = []
    for item, text in dict.fromkeys((i, t) for i, t, *_ in items):
        query = [t.translate(UPPER) for t in TERM.findall(text or "")]
        scored = []
        for i, w in split:
            tf, m = Counter(w), 100 - 25 + (25 * len(w) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m))
                    for t in query if t in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        scored.sort(key=lambda x: x[:3])
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(scored[:top])]
    return sorted(out, key=str)


def run(spark, docs, items, top=20):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, rank int")
    i = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    return sorted((tuple(r) for r in lexical.rank(d, i, top).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def corpus(seed, n, vocabulary=300):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % vocabulary}"
    return [(i, " ".join(word() for _ in range(rng.choice([1, 5, 60, 400]))), "z", 1) for i in range(n)], rng, word


def test_equals_brute_force(llm):
    docs, rng, word = corpus(1, 400)
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 20]))), 0) for i in range(25)]
    assert run(llm, docs, items) == brute(docs, items)


def test_copies_ties_and_small_segments(llm, monkeypatch):
    monkeypatch.setattr(lexical, "SEEDS", 1)
    docs, rng, word = corpus(2, 150)
    docs += [(1000 + i, docs[3][1] + " w1 w2 w2", "z", 1) for i in range(120)]
    docs += [(2000 + i % 3, "w5 w6 w7 w7", "z", 1) for i in range(60)]  # repeated rows
    docs += [(None, "w5 w6", "z", 1), (None, "w5 w6 w7", "z", 1)]
    items = [(1, "w1 w2 w2 w3", 0), (2, "w5 w6 w7", 0), (3, docs[3][1], 0)]
    assert run(llm, docs, items) == brute(docs, items)
    assert run(llm, docs, items, 3) == brute(docs, items, 3)


def test_edges(llm, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 2)
    docs = [(1, None, "", 0), (2, "", "", 0), (3, "?!", "", 0), (4, "ÜnïK ABC-abc 12", "", 0), (5, "abc " * 5000 + "rare", "", 0),
            (6, "ÜNÏ abc", "", 0), (7, "one\x00two_three", "", 0)]
    items = [(1, None, 0), (2, "", 0), (3, "--", 0), (4, "ABC abc K ünï", 0), (5, "nowhere", 0), (6, "two three", 0), (7, "RARE", 0),
             (None, "abc", 0), (6, "two three", 0), (8, "abc", 0)]
    assert run(llm, docs, items) == brute(docs, items)


def test_empty_tables(llm):
    assert run(llm, [], [(1, "a", 0)]) == []
    assert run(llm, [(1, "a", "", 0)], []) == []
    assert run(llm, [(1, None, "", 0)], [(1, "a", 0)]) == []


def test_bounds_are_never_below_scores():
    docs, rng, word = corpus(3, 60)
    block = lexical._Block([" ".join(word() for _ in range(12)) for _ in range(8)])
    split = [lexical.terms(d[1]) for d in docs]
    df = Counter(block.numbers[t] for w in split for t in set(w) if t in block.numbers)
    size = len(split), sum(map(len, split))
    block.weigh(dict(df), *size)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": pa.array([d[0] for d in docs]), "key": pa.array([d[0] for d in docs]), "text": pa.array([d[1] for d in docs])})
    for out in lexical._index(iter([batch])):
        row = out.to_pylist()[0]
        upper = block.bounds(row)
        for j, doc in enumerate(row["ids"]):
            tf, m = Counter(split[doc]), lexical.length_factor(len(split[doc]), *size)
            for q in range(8):
                exact = sum(w * lexical.gain(tf[t], m) for t, w in block.named[q].items() if t in tf)
                assert exact <= upper[q, j] <= 1.6 * exact + 10**9
