import random

import pytest

from restate.llm import packing as P


def brute(lengths, capacities):
    """The same rules by scanning all bins."""
    best = None
    for prefer in (None, *sorted(capacities)):
        bins, where, left = [], {}, sum(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            n = lengths[i]
            rooms = [c - u for c, u in bins]
            fits = [r for r in rooms if r >= n]
            if fits:
                b = max(k for k, r in enumerate(rooms) if r == min(fits))
            else:
                able = [c for c in sorted(capacities) if c >= n]
                c = prefer if prefer in able else min(able, key=lambda c: (P.cost(c) / max(1, min(c, left)), c))
                bins.append([c, 0])
                b = len(bins) - 1
            where[i] = b
            bins[b][1] += n
            left -= n
        total = sum(P.cost(min(c for c in capacities if c >= u)) for _, u in bins)
        if best is None or total < best:
            best = total
    return best


@pytest.mark.parametrize("seed", range(8))
def test_cost_equals_brute_force(seed):
    rng = random.Random(seed)
    capacities = [16, 32, 100]
    lengths = [rng.choice([rng.randint(0, 100), rng.randint(1, 20), 16]) for _ in range(rng.randint(0, 120))]
    bins, offsets, sizes = P.best_fit(lengths, capacities)
    used = {}
    for n, b, o, c in zip(lengths, bins, offsets, sizes):
        used.setdefault(b, [c, []])[1].append((o, n))
        assert used[b][0] == c
    for c, parts in used.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at  # no gap, no overlap
            at += n
        assert c == P.shrink(at, capacities)
    total = sum(P.cost(c) for c, _ in used.values())
    if len(set(lengths)) == len(lengths):
        assert total == pytest.approx(brute(lengths, capacities))
    assert total <= sum(P.cost(P.shrink(n, capacities)) for n in lengths) + 1e-6


def test_distinct_lengths_equal_brute_force():
    rng = random.Random(11)
    for _ in range(30):
        lengths = rng.sample(range(1, 101), rng.randint(1, 60))
        _, _, _ = out = P.best_fit(lengths, [16, 32, 100])
        total = sum(P.cost(c) for _, c in {b: (b, c) for b, c in zip(out[0], out[2])}.values())
        assert total == pytest.approx(brute(lengths, [16, 32, 100]))


def test_pack_table(llm):
    rows = [(i, i % 37) for i in range(500)] + [(1000, None), (1001, -4), (1002, 0), (1003, 1000), (1003, 1000), (1004, 100), (None, 7)]
    df = llm.createDataFrame(rows, "id long, length long").selectExpr("*", "'x' as bin_id", "1 as total")
    out = P.pack(df, (16, 32, 100), rows_per_shard=120).collect()
    by_bin, by_doc = {}, {}
    for r in out:
        by_bin.setdefault(r.bin_id, []).append(r)
        by_doc.setdefault(r.id, []).append(r)
    for b in by_bin.values():
        at = 0
        for r in sorted(b, key=lambda r: (r.offset, r.length)):
            assert r.offset == at
            at += r.length
        assert {r.capacity for r in b} == {P.shrink(at, (16, 32, 100))}
    assert sum(r.length for r in out) == sum(max(n or 0, 0) for _, n in rows)
    assert sorted(r.start for r in by_doc[1003]) == sorted(2 * list(range(0, 1000, 100)))
    assert len(by_doc[1000]) == len(by_doc[1001]) == len(by_doc[1002]) == 1
    assert len({r.bin_id >> 32 for r in out}) > 1  # several shards
    again = sorted(map(tuple, P.pack(df, (16, 32, 100), rows_per_shard=120).collect()), key=str)
    assert again == sorted(map(tuple, out), key=str)
    assert P.pack(df.limit(0)).count() == 0


def test_little_waste(llm):
    from restate.llm.queries import op7_packing
    got = op7_packing(llm, "/root/testdata/sf0.01").collect()
    size = {r.bin_id: r.capacity for r in got}
    assert sum(r.length for r in got) > 0.98 * sum(size.values())
