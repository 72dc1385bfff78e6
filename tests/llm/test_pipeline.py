"""The pipeline's stages on a small corpus of planted cases, each against the operator's brute-force rule."""

import random

import pytest

import corpus_pipeline as P
from restate.llm.common import scratch
from tests.llm.test_decontaminate import brute as contaminated_brute
from tests.llm.test_ngram_join import brute as near_brute

WORDS = {"xx": ["kolu", "maneta", "sirop", "tavile", "ruk", "pali", "mone", "tirva"], "yy": ["schwe", "thran", "bloch", "grund", "peltz", "kraft", "wend", "molk"]}


def _text(rng, lang, n):
    return ". ".join(" ".join(rng.choices(WORDS[lang], k=rng.randint(4, 9))) for _ in range(n // 6 + 1))


@pytest.fixture(scope="module")
def corpus(llm):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(240):
        lang = "xx" if i % 2 else "yy"
        junk = i % 8 == 3
        text = " ".join(f"{w}%%%" for w in _text(rng, lang, 60).split()) if junk else _text(rng, lang, rng.randint(20, 120))
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
        if i % 3:
            labels.append((i, int(not junk), 0))
    items = [(j, "bench " + " ".join(f"q{j}w{k}" for k in range(20))) for j in range(4)]
    rows += [(300 + i, rows[i][1], rows[i][2], "s0", 1) for i in (0, 1, 2, 4, 5)]  # exact copies
    rows += [(310 + i, rows[i][1] + " tail", rows[i][2], "s0", 1) for i in (0, 1)]
    rows += [(320 + j, _text(rng, "yy", 60) + " " + t, "yy", "s1", 1) for j, t in items]  # benchmark passages
    rows += [(330, None, "xx", "s1", 0), (331, "", None, None, 0), (332, "12 34", "xx", "s1", 5), (0, rows[0][1], "yy", "s0", 1), (None, rows[8][1] + " another end", "yy", "s0", 1)]
    path = scratch(llm, "corpus")
    llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    llm.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    llm.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def _run(llm, path):
    docs, out = llm.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in P.STAGES:
        docs = stage(llm, docs, path)
        target = scratch(llm, "stage")
        docs.write.parquet(target)
        docs = llm.read.parquet(target)
        out.append(docs)
    return out


def test_stages(llm, corpus):
    path, items = corpus
    start = llm.read.parquet(f"{path}/documents.parquet").collect()
    language, quality, near, clean, packed = _run(llm, path)
    for stage in (language, quality, near, clean):
        assert stage.columns == P.COLUMNS
    key = lambda r: (r.doc_id, r.text)
    kept = sorted(map(key, language.collect()), key=str)
    assert kept == sorted((key(r) for r in start if any(map(str.isalpha, r.text or ""))), key=str)
    good = sorted(map(key, quality.collect()), key=str)
    assert good == [k for k in kept if "%%%" not in k[1]]  # the junk goes, all else stays
    rest = list(map(key, near.collect()))
    groups = {}
    for at, _, component in near_brute([(i, t) for i, (_, t) in enumerate(good)], P.NEAR_WORDS, P.NEAR_PERCENT):
        groups.setdefault(component, set()).add(good[at])
    assert sorted(sum(r in members for r in rest) for members in groups.values()) == [1] * len(groups) and len(rest) == len(groups) < len(good)
    hit = {(d, n, h) for d, n, h, _, _ in contaminated_brute(rest, items) if h and 20 * h >= n}
    final = list(map(key, clean.collect()))
    assert len(hit) == len(rest) - len(final) > 0
    assert not any("q0w3" in t for _, t in final)
    pieces = packed.collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in final}
    assert all(r.offset + r.length <= r.capacity for r in pieces)


def test_near_duplicate_stage_keeps_one_of_each_group(llm):
    a, b = "one two three four five six seven eight nine ten", "another text that has nothing at all in common with it"
    rows = [(3, a), (1, a), (1, a), (2, a + " end"), (1, b), (7, b), (None, None), (None, None), (5, "")]
    docs = llm.createDataFrame([(i, t, "xx", "s", 1, "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component string")
    got = P.near_duplicate_stage(llm, docs, None)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(1, a), (1, b), (None, None), (None, None), (5, "")]))


def test_empty_corpus(llm, corpus):
    path, _ = corpus
    docs = llm.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(llm, docs, path)
        target = scratch(llm, "stage")
        docs.write.parquet(target)
        docs = llm.read.parquet(target)
        assert docs.count() == 0


def test_run_on_the_table(llm):
    out = P.run(llm, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "bin_id", "capacity"} <= set(out.columns) and out.count() > 0
