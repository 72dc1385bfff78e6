import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from restate.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(spark, rows):
    m = C.chains(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'z' as tree", "1 as node", "2 as depth"))
    out = C.read_back(C.format_paths(m, C.reply_paths(m)))
    ids = {r.tree: r.c_id for r in m.select("tree", "c_id").distinct().collect()}
    return {ids[r.tree]: r for r in out.collect()}


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    return {c: [(t[3], t[5]) for t in sorted(ts)] for c, ts in by.items()}


def check(spark, rows):
    got, want = conversations(spark, rows), expected(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(x for r, x in turns if r == "assistant")


HARD = ["", "\\", "\\\\", "#", "###", "### assistant:\n", "</turn>", "\n</turn>\n", "a\n", "\n</turn>\n### user:\nx", "\\### Assistant: </turn> ok", "é😀\u2028", "<", "\\<", "$1 \\1", None]


def test_hard_texts_and_order(llm):
    rows = [(c, i, r, t) for c, texts in enumerate((HARD, HARD[::-1])) for i, t in enumerate(texts) for r in [("user", "assistant", "system", "a b:\nc", None)[i % 5]]]
    rows += [(9, 2, "user", "later"), (9, -1, "user", "first"), (9, None, "assistant", "before all")]
    rows += [(10, 0, "user", "same")] * 3 + [(11, 0, "user", None), (None, 0, "assistant", "no id"), (None, 1, "user", "still none")]
    random.Random(2).shuffle(rows)
    check(llm, rows)


def test_long_conversation(llm):
    check(llm, [(1, i, "assistant" if i % 2 else "user", f"text {i}" * (i % 50)) for i in range(700)])


def test_empty(llm):
    assert conversations(llm, []) == {}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.sampled_from(["user", "assistant", "x/:\n"]),
                          st.text(alphabet="\\#<>/turn\n é", max_size=12)), min_size=1, max_size=25))
def test_round_trip(llm, rows):
    check(llm, rows)


def brute_paths(messages, k):
    """messages: {(tree, node): (parent, score)}"""
    out = {}
    for tree in {t for t, _ in messages}:
        nodes = {n: v for (t, n), v in messages.items() if t == tree}
        parents = {p for p, _ in nodes.values() if p in nodes}
        found = []
        for leaf in nodes:
            if leaf in parents:
                continue
            path, total, at = [], 0.0, leaf
            while at in nodes and at not in path:
                path.append(at)
                total += nodes[at][1]
                at = nodes[at][0]
            if at in path:
                continue  # a cycle has no root
            found.append((-total, leaf, path[::-1]))
        out.update({(tree, leaf): (rank + 1, path) for rank, (_, leaf, path) in enumerate(sorted(found)[:k])})
    return out


def test_trees_against_brute_force(llm):
    rng = random.Random(4)
    messages = {}
    for tree in range(12):
        for node in range(rng.randint(1, 40)):
            parent = rng.choice([None, 999] + list(range(node))) if node else None
            messages[f"t{tree}", node] = (parent, float(rng.randint(0, 3)))
    messages["cycle", 0], messages["cycle", 1], messages["cycle", 2] = (1, 1.0), (0, 1.0), (1, 5.0)
    rows = [(t, n, p, s) for (t, n), (p, s) in messages.items()]
    df = llm.createDataFrame(rows + rows[:20], "tree string, node long, parent long, score double")
    for k in (1, 3):
        got = {}
        for r in C.reply_paths(df, k).orderBy("tree", "path", "depth").collect():
            got.setdefault((r.tree, r.path), (r.path_rank, []))[1].append(r.node)
        assert got == brute_paths(messages, k)


def test_contract_digest_of_minus_seven(llm):
    from restate.llm.queries import op9_chat_format
    row = op9_chat_format(llm, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert row.n_turns == 2 and row.loss_chars == len(text)
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
