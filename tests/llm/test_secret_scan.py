import hashlib
import os
import random
import re
import string

import pytest
import zstandard

from restate.llm import queries, secret_scan as scan

SCHEMA = "doc_id long, text string, id string, spans int"


def base(text):
    """Kinds by single steps over the text: each match is sought from the end of the one before."""
    patterns = {"assign": r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                          r"[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    out = []
    for n, (kind, p) in enumerate(patterns.items()):
        at = 0
        while m := re.compile(p).search(text, at):
            a, b = m.span(2 if kind == "assign" else 0)
            if b - a >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((a, n, kind, b))
            at = m.end()
    return [(k, a, b) for a, _, k, b in sorted(out)]


def rows(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in scan.scan(df, scan.fit(df)).collect()}


def random_text(rng):
    pieces = ["password", "PassWd", "token", "secret", "Api_Key", "apikey", "api__key", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA", "é", "\n", "K", "ſecret",
              "deadbeef", "0123456789abcdef", "word", "auth", "Bearer ", "."]
    made = [lambda: rng.choice(pieces), lambda: "".join(rng.choices("0123456789abcdef", k=rng.choice([5, 15, 16, 40]))),
            lambda: "".join(rng.choices(string.ascii_uppercase + string.digits, k=rng.choice([3, 13, 14, 20]))),
            lambda: "".join(rng.choices(string.ascii_letters + "+/_.=-", k=rng.choice([2, 11, 12, 30])))]
    return "".join(rng.choice(made)() for _ in range(rng.choice([1, 5, 40, 200])))


def test_base_spans_equal_a_plain_search(llm):
    rng = random.Random(4)
    data = [(i, random_text(rng), "", 0) for i in range(400)]
    got = rows(llm, data)
    for i, text, *_ in data:
        assert [s for s in got[i] if s[0] != "novel"] == base(text), text


def test_novel_spans():
    rng = random.Random(5)
    prose = " ".join(rng.choice(["the", "configuration", "administrator", "authentication", "directory", "service"]) for _ in range(80))
    key = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    novelty = scan.Novelty(prose.encode())
    text = f"{prose} bearer {key} {prose}"
    assert [(s["kind"], text[s["start"]:s["end"]]) for s in scan.scan_text(text, novelty)] == [("novel", key)]
    # outside of a sensitive context, known words, and what stands nearby already
    assert scan.scan_text(f"{prose} see {key} {prose}", novelty) == []
    assert scan.scan_text(f"{prose} bearer authentication_configuration_directory {prose}", novelty) == []
    assert scan.scan_text(f"{key} {prose[:100]} bearer {key}", novelty) == []
    # measured as the difference of two primed frames, the middle one of three surroundings
    z = zstandard.ZstdCompressor(level=scan.LEVEL, write_checksum=False, write_content_size=False,
                                 dict_data=zstandard.ZstdCompressionDict(prose.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    a = text.index(key)
    added = sorted(len(z.compress(text[max(0, a - n):a + 40 + n].encode())) - len(z.compress((text[max(0, a - n):a] + text[a + 40:a + 40 + n]).encode()))
                   for n in (64, 256, 512))
    assert novelty(text, a, a + 40) == pytest.approx(added[1] / 40)


def test_candidates_of_many_sensitive_words_do_not_overlap():
    text = "token" * 50_000
    assert scan.candidates(text, []) == [(5, len(text))]
    text = "auth " * 50_000 + "x" * 16
    assert scan.candidates(text, []) == [(250_000, 250_016)]
    assert scan.candidates(text, [("hex", 250_010, 250_012)]) == []


def test_edges(llm):
    key = "c0ffee" * 4
    data = [(1, None, "", 0), (2, "", "", 0), (None, f"password={key}", "", 0), (3, "é" * 10 + f"𝄞 token: '{key}'", "", 0), (4, key * 20_000, "", 0), (5, "x", "", 0), (5, "x", "", 0)]
    df = llm.createDataFrame(data, SCHEMA)
    out = scan.scan(df, scan.fit(df)).collect()
    assert len(out) == len(data)
    got = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in out}
    assert got[1] == got[2] == got[5] == []
    assert got[None] == [("assign", 9, 33), ("hex", 9, 33)]
    assert got[3] == [("assign", 20, 44), ("hex", 20, 44)]
    assert got[4] == [("hex", 0, 480_000)]
    none = llm.createDataFrame([], SCHEMA)
    assert scan.fit(none) == b"" and scan.scan(none, b"").count() == 0


def test_query_columns(llm, tmp_path):
    key = "c0ffee" * 4
    data = [(1, f"password={key} and AKIA{'Z9' * 8}", "", 0), (2, None, "", 0)]
    llm.createDataFrame(data, SCHEMA).drop("id", "spans").write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op12_secret_scan(llm, str(tmp_path)).collect()}
    spans = "assign:9:33,hex:9:33,access:38:58"
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"], got[1]["spans"]) == (1, 1, 1, spans)
    assert got[1]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_dictionary_counts_documents_and_leaves_keys_out(llm):
    df = llm.createDataFrame([(i, f"secret value of the server is Zq{i}x9Key and token", "", 0) for i in range(30)] + [(99, "plain words", "", 0)], SCHEMA)
    words = scan.fit(df).decode().split()
    assert "server" in words and "plain" not in words and not any(w.startswith("Zq") for w in words)
