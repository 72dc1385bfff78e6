import random

from restate.llm.decontaminate import contaminated, contamination

DELIMITERS = set(map(chr, list(range(0x30)) + list(range(0x3A, 0x61)) + list(range(0x7B, 0x80))))


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(" " if c in DELIMITERS else c for c in low).split(" ") if low else []


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = [x for x in words(text) if x]
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w = [x for x in words(text) if x]
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc_id, len(w), len(hit), sorted(found), sorted(hit)))
    return out


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "'q' as w", "2 as n_hit")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'q' as items", "3 as fp")
    got = [(r.id, r.n_words, r.n_hit, list(r["items"]), [i for s in r.spans for i in range(s.start, s.end)]) for r in contamination(d, b).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(docs, items)))


def _texts(seed, n, vocabulary, most):
    rng = random.Random(seed)
    return [" ".join(rng.choices(vocabulary, k=rng.randint(0, most))) for _ in range(n)]


def test_every_window_is_found(llm):
    """A tiny vocabulary: windows, ties of hashes within a window and overlaps abound."""
    items = list(enumerate(_texts(1, 12, ["a", "b"], 30)))
    docs = list(enumerate(_texts(2, 60, ["a", "b"], 60)))
    check(llm, docs, items)


def test_planted_passages(llm):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(13, 40)))) for i in range(20)]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            source = rng.choice(items)[1].split()
            a, n = rng.randint(0, len(source) - 5), rng.randint(5, 25)
            at = rng.randint(0, len(w))
            w[at:at] = source[a:a + n]
        docs.append((i, " ".join(w).upper() if i % 2 else " ,\n ".join(w)))
    check(llm, docs, items)


def test_edges(llm):
    long = "x y z " * 20_000
    items = [(1, None), (2, ""), (3, "Solo"), (4, "one two three four"), (4, "one two three four"), (5, "..."), (None, "no name here"), (10, "one two three four"),
             (6, " ".join(f"k{i}" for i in range(13))), (7, " ".join(f"k{i}" for i in range(14)))]
    docs = [(1, None), (2, ""), (3, "!!"), (4, "a SOLO b solo"), (5, "one-two three, FOUR one two three four"), (5, "one two"), (6, "no name here"), (7, long + "solo"),
            (None, "solo"), (8, " ".join(f"k{i}" for i in range(14))), (8, " ".join(f"k{i}" for i in range(14))), (9, "É é"), (11, "k0 k1 " + " ".join(f"k{i}" for i in range(13)))]
    check(llm, docs, items)
    check(llm, docs, items[:2])
    check(llm, [], items)
    check(llm, docs, [])


def test_rule(llm):
    df = llm.createDataFrame([(0, 0), (1, 20), (1, 21), (0, 5)], "h long, n long")
    from pyspark.sql import functions as F
    assert [r[0] for r in df.select(contaminated(F.col("h"), F.col("n"))).collect()] == [False, True, False, False]


def test_native_plan(llm):
    df = contamination(llm.createDataFrame([(1, "a b")], "doc_id long, text string"), llm.createDataFrame([(1, "a b")], "item_id long, text string"))
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_no_list_is_computed_again_as_a_filter(llm):
    """Spark puts a filter under an explode; over the hashing of windows it would be as large as the work itself."""
    docs = llm.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, i + 40))) for i in range(5)], "doc_id long, text string")
    items = llm.createDataFrame([(1, " ".join(f"w{j}" for j in range(3, 33))), (2, "w1 w2")], "item_id long, text string")
    out = contamination(docs, items)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000 and plan.count("xxhash64") < 40
    assert all(r.n_hit > 0 for r in out.collect())
