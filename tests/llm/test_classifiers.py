import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from restate.llm import quality as Q
from restate.llm import toxicity as X
from restate.llm.common import held_out, table

SF = "/root/testdata/sf0.01"


def _docs(spark, n=400):
    rng = random.Random(1)
    clean = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = rng.choices(clean, k=rng.randint(5, 60)) + (rng.choices(["vile", "nasty", "awful"], k=2) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or not toxic:
            labels.append((i, int(toxic)))  # half of the toxic ones are confirmed
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_pu_learning_finds_unlabelled_toxic_texts(llm):
    docs, labels = _docs(llm)
    model = X.fit(docs, labels)
    got = {r.doc_id: r.score for r in X.score(docs.selectExpr("*", "1 as score"), model).collect()}
    hidden = [got[i] for i in range(5, 400, 10)]  # toxic and unlabelled
    clean = [got[i] for i in range(400) if i % 5]
    assert np.mean([s >= 0.3 for s in hidden]) > 0.95
    assert np.mean([s >= 0.3 for s in clean]) < 0.02


def test_scores_of_odd_texts_and_no_labels(llm):
    docs, labels = _docs(llm)
    model = X.fit(docs, labels)
    odd = llm.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "vile " * 60_000), (4, "x " * 60_000 + "VILE nasty"), (None, "w1")], "doc_id long, text string")
    got = X.score(odd, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score == got[2].score
    assert [r.score >= 0.3 for r in got[3:5]] == [True, True]
    none = X.fit(docs, labels.limit(0))
    assert all(r.score < 1e-6 for r in X.score(docs.limit(3), none).collect())
    assert X.score(docs.limit(0), model).count() == 0
    nulls = labels.selectExpr("doc_id", "cast(null as int) as toxic").union(llm.createDataFrame([(None, 1)], "doc_id long, toxic int"))
    assert X.fit(docs, nulls).prior <= 1e-4


def test_training_does_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 50, 20)) for _ in range(300)]
    pos = [np.append(r, 77) for r in rows[:60]]
    a, b = X.train(pos, rows, 0.2), X.train(pos[::-1], rows[::-1], 0.2)
    assert (a.weights == b.weights).all() and a.bias == b.bias


def _accuracy(df, y, p):
    rows = df.collect()
    return np.mean([(r[y] == 1) == bool(r[p]) for r in rows])


def test_toxicity_held_out(llm):
    from restate.llm.queries import op2_toxicity
    got = op2_toxicity(llm, SF).where("held_out").join(table(llm, SF, "labels"), "doc_id")
    assert _accuracy(got, "toxic", "predicted") > 0.9


def test_quality_held_out(llm):
    from restate.llm.queries import op6_quality
    got = op6_quality(llm, SF).withColumn("good", ~F.col("rejected")).drop("quality").where("held_out").join(table(llm, SF, "labels"), "doc_id")
    assert _accuracy(got, "quality", "good") > 0.95


def _posterior(rows, prior):
    """The formulas, one row at a time."""
    own = [round(l if l is not None else 1 / (1 + math.exp(-(llr + math.log(prior / (1 - prior))))), 6) for _, _, llr, l in rows]

    def strength(groups):
        n_all = sum(n for _, n, _ in groups)
        spread = sum(n * (s / n - a) ** 2 for s, n, a in groups)
        noise = sum(a * (1 - a) for _, _, a in groups)
        within = sum(n * a * (1 - a) for _, n, a in groups)
        return min(max(within / n_all / max((spread - noise) / n_all, 1e-9) - 1, Q.MIN_STRENGTH), Q.MAX_STRENGTH)

    def sums(key):
        out = {}
        for r, o in zip(rows, own):
            s, n = out.get(key(r), (0, 0))
            out[key(r)] = s + o, n + 1
        return out

    hosts, paths = sums(lambda r: r[0]), sums(lambda r: (r[0], r[1]))
    rate = min(max(sum(own) / len(own), 1e-4), 1 - 1e-4)
    m = strength([(s, n, rate) for s, n in hosts.values()])
    host_rate = {h: (s + m * rate) / (n + m) for h, (s, n) in hosts.items()}
    k = strength([(s, n, host_rate[h]) for (h, _), (s, n) in paths.items()])
    out = []
    for (h, p, llr, _), o in zip(rows, own):
        s, n = paths[h, p]
        r = min(max((s - o + k * host_rate[h]) / (n - 1 + k), 1e-4), 1 - 1e-4)
        out.append((host_rate[h], r, 1 / (1 + math.exp(-(llr + math.log(r / (1 - r)))))))
    return out


def test_posterior_against_brute_force(llm):
    rng = random.Random(3)
    rows = []
    for h in ["a", "b", "c", None, "hot"]:
        for p in ["x", "y", None]:
            good = rng.random()
            for _ in range(rng.choice([1, 2, 9, 40]) * (10 if h == "hot" else 1)):
                rows.append((h, p, rng.gauss(0, 2), rng.choice([None, None, float(rng.random() < good)])))
    df = llm.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, host string, path string, llr double, label double").repartition(5)
    got = Q.posterior(df, 0.7).orderBy("i").collect()
    for r, (host, path, quality) in zip(got, _posterior(rows, 0.7), strict=True):
        assert r.host_rate == pytest.approx(host, rel=1e-6)
        assert r.path_rate == pytest.approx(path, rel=1e-5)
        assert r.quality == pytest.approx(quality, rel=1e-5)


def test_sparse_sites_shrink(llm):
    rows = [("big", "p", 0.0, 1.0)] * 300 + [("bad", "p", 0.0, 0.0)] * 300 + [("one", "p", 0.0, 0.0)]
    got = {r.host: r.host_rate for r in Q.posterior(llm.createDataFrame(rows, "host string, path string, llr double, label double"), 0.5).collect()}
    assert got["bad"] < 0.02 < 0.1 < got["one"] < 0.5 < 0.98 < got["big"]


def test_quality_of_odd_rows(llm):
    docs = llm.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "", "s", "en"), (3, "good words " * 40_000, "s", None), (None, "x", "s", "en")],
                               "doc_id long, text string, source string, lang string").selectExpr("*", "1 as llr", "2 as quality", "'h' as host", "0 as own")
    labels = llm.createDataFrame([(2, 1), (3, 0), (3, None), (None, 1), (3, 1)], "doc_id long, quality int")
    model = Q.fit(docs, labels)
    got = Q.judge(docs, model, labels).collect()
    assert len(got) == 5 and all(0 <= r.quality <= 1 for r in got)
    assert Q.judge(docs.limit(0), model, labels).count() == 0
    one_class = Q.fit(docs, labels.where("doc_id = 2"))
    assert (one_class.weights == 0).all()
    assert Q.fit(docs, labels.limit(0)).prior == 0.5
    assert held_out("x") is not None


def test_risk_and_its_gradient_against_plain_sums():
    rng = np.random.default_rng(3)
    for case in range(20):
        f_u, f_p, prior = rng.normal(size=7) * 3 - 3 * (case % 2), rng.normal(size=5) * 3 + 3 * (case % 2), 0.05 + 0.9 * rng.random()
        loss = lambda x: math.log(1 + math.exp(-x))
        toxic = prior * sum(loss(x) for x in f_p) / 5
        clean = sum(loss(-x) for x in f_u) / 7 - prior * sum(loss(-x) for x in f_p) / 5
        assert X.risks(f_u, f_p, prior) == pytest.approx((toxic, clean))
        sign = 1 if clean >= 0 else -1
        target = lambda u, p: sum(X.risks(u, p, prior)) if sign > 0 else -X.risks(u, p, prior)[1]
        g_u, g_p = X.step_of(f_u, f_p, prior)
        for f, g, at in ((f_u, g_u, 0), (f_p, g_p, 1)):
            for i in range(len(f)):
                moved = [f_u.copy(), f_p.copy()]
                moved[at][i] += 1e-6
                assert (target(*moved) - target(f_u, f_p)) / 1e-6 == pytest.approx(g[i], abs=1e-4)
    # with a sample of all texts as unlabelled, the estimate is the clean texts' own risk
    f_c, f_t = rng.normal(size=300), rng.normal(size=100) + 2
    assert X.risks(np.concatenate([f_c, f_t]), f_t, 0.25)[1] == pytest.approx(0.75 * np.logaddexp(0, f_c).mean())


def test_repeated_ids_fill_no_places(llm):
    docs = llm.createDataFrame([(i, f"word{i} text") for i in range(40)] + [(0, "copy of one id")] * 3000 + [(1, "word1 text")] * 3000, "doc_id long, text string")
    labels = llm.createDataFrame([(i, int(i < 3)) for i in range(0, 40, 2)], "doc_id long, toxic int")
    rows, prior = X.training_rows(docs, labels, "doc_id", "text", "toxic", 5, 30)
    got = rows.collect()
    assert prior == 0.1 and sum(r.positive for r in got) == 2 and sum(not r.positive for r in got) == 30
    assert len({tuple(r.words) for r in got}) == 32
    graded = labels.withColumnRenamed("toxic", "quality")
    assert Q.fit(docs, graded).prior == Q.fit(docs.dropDuplicates(["doc_id"]), graded).prior
