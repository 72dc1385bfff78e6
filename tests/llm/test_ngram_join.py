import random
from pathlib import Path

import numpy as np
import pytest

from restate.llm import ngram_join as N
from restate.llm import textarrays as T
from restate.llm.components import connected_components
from restate.llm.common import store
from restate.session import checkpoint_dir

SPACES = " \t\n\v\f\r"


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for s in SPACES[1:]:
        low = low.replace(s, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                comp[root(i)] = root(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    return sorted(((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))), key=str)


def check(spark, rows, n=4, percent=85):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sig", "'x' as keys", "0 as id").repartition(4)
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in N.similar_groups(docs, n=n, percent=percent).collect()), key=str)
    assert got == brute(rows, n, percent)


def _family(rng, base, copies, edits):
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        yield " ".join(w)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_families_around_the_threshold(llm, n, percent):
    rng = random.Random(percent)
    texts = []
    for size in (5, 8, 12, 20, 40, 90, 200, 400):
        texts += _family(rng, [f"w{rng.randrange(300)}" for _ in range(size)], 14, max(1, size // 30))
    texts += _family(rng, [f"v{i}" for i in range(120)], 60, 3)  # one large group
    rng.shuffle(texts)
    check(llm, list(enumerate(texts)), n, percent)


def test_a_chain_of_links(llm):
    """Each links with the next only: one component all the same."""
    w = [f"w{i}" for i in range(200)]
    check(llm, [(50 - i, " ".join(w[i * 4:i * 4 + 100])) for i in range(20)])


def test_edges(llm):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "a"), (5, "A"), (6, "a b c"), (7, "a  B\nc"), (8, "a b c d"), (9, "a b c d e"), (10, "x" * 90_000),
            (11, "w " * 50_000), (12, "w " * 70_000), (12, "w " * 70_000), (13, "\xa0a b"), (None, "a"), (None, "lone words of no name here"), (14, "É é"), (15, "é é")]
    check(llm, rows)
    check(llm, [])


def test_linked_sets_share_a_key():
    """The pigeonhole bound, straight on the keys: every pair at or over the threshold agrees in one."""
    rng = np.random.default_rng(5)
    for percent in (80, 85, 95):
        for size in [*range(1, 40), 60, 100, 333, 1000, 3000]:
            a = T.mix(rng.integers(0, 2**63, size, dtype=np.uint64))
            for _ in range(4):
                kept = rng.integers(0, size // 5 + 1)
                b = np.unique(np.concatenate((rng.permutation(a)[kept:], rng.integers(0, 2**63, rng.integers(0, size // 5 + 1), dtype=np.uint64))))
                s = np.unique(a)
                both = len(np.intersect1d(s, b))
                if both and 100 * both >= percent * (len(s) + len(b) - both):
                    with np.errstate(over="ignore"):
                        assert np.intersect1d(N.join_keys(s, percent), N.join_keys(b, percent)).size
                    apart = sum(int(x).bit_count() for x in (N.bit_sketch(s) ^ N.bit_sketch(b)).view(np.uint64))
                    assert apart <= len(s) + len(b) - 2 * both


def test_spare_copies(llm):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words all of them"), (4, None), (4, None), (1, "a b c d e  f")]
    groups = store(N.similar_groups(llm.createDataFrame(rows, "doc_id long, text string")), "t")
    assert sorted(r.id for r in N.spare_copies(groups).collect()) == [1, 2]


def test_components(llm):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5000, 5000 + i) for i in range(200)] + [(None, 3)]
    near = {}
    for a, b in edges:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    got = {r.node: r.root for r in connected_components(llm.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in want.items() if k != v}
    assert connected_components(llm.createDataFrame([], "u long, v long")).count() == 0


def test_large_sets_are_told_apart_by_their_sketches(llm):
    """Large sets that share a few shingles are no candidates; those that link are, also where their sketches differ in length."""
    rng, rows = np.random.default_rng(6), []
    for size in (600, 1000, 2040, 2060, 3000, 4090, 6000, 9000):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for linked, own in ((True, size // 10), (True, size // 12), (False, size - size // 10)):
            b = np.unique(np.concatenate((a[own:], rng.integers(0, 2**63, own - (size // 20 if linked else 0), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            assert (100 * both >= 80 * (len(a) + len(b) - both)) == linked
            for x, y in ((a, b), (b, a)):
                sides = [v for s in (x, y) for v in (len(s), N.bit_sketch(s, N.sketch_bits(len(s))).tolist())]
                rows.append((linked, len({len(sides[1]), len(sides[3])}), *sides))
    assert {r[1] for r in rows} == {1, 2}
    df = llm.createDataFrame(rows, "linked boolean, lengths int, n_a long, k_a array<long>, n_b long, k_b array<long>")
    assert df.where(N._may_link("n_a", "k_a", "n_b", "k_b", 80) != df.linked).count() == 0
    # a low threshold lets sets link whose sketches differ in length by more than one fold
    a = np.unique(rng.integers(0, 2**63, 9000, dtype=np.uint64))
    b = a[:2000]
    far = llm.createDataFrame([(len(a), N.bit_sketch(a, N.sketch_bits(len(a))).tolist(), len(b), N.bit_sketch(b, N.sketch_bits(len(b))).tolist())], "n_a long, k_a array<long>, n_b long, k_b array<long>")
    assert far.where(N._may_link("n_a", "k_a", "n_b", "k_b", 20)).count() == 1
    assert far.select(N._apart("k_a", "k_b").alias("x")).first().x == sum(
        int(x).bit_count() for x in (N.bit_sketch(a, N.sketch_bits(len(b))) ^ N.bit_sketch(b, N.sketch_bits(len(b)))).view(np.uint64))


def test_nothing_but_names_is_left_on_disk(llm):
    """Cells, members and sketches of a join are deleted when it has what it needs of them."""
    kept = Path(checkpoint_dir(llm))
    before = set(kept.iterdir())
    check(llm, [(i, " ".join(f"w{j}" for j in range(i // 3, i // 3 + 60))) for i in range(30)])
    left = {p.name.rsplit("-", 1)[0] for p in set(kept.iterdir()) - before}
    assert "ngram-names" in left and not left & {"ngram-rows", "ngram-shared", "ngram-members", "ngram-nodes", "ngram-active"}
