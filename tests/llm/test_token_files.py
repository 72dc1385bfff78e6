"""Round trips of the block format and of the encoder, and the files against a plain encoding."""
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from restate.llm import token_files as TF
from restate.llm import tokens
from restate.llm.common import scratch

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("top", [1, 2, 300, 49_408, 2**32])
def test_segment_round_trip_and_ranges(n, top):
    rng = np.random.default_rng(n + top)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[::50] = rng.integers(0, 2**32, len(ids[::50]), dtype=np.uint64)  # outliers
    data = TF.encode_ids(ids)
    assert (TF.decode_ids(data) == ids).all()
    for first, count in ((0, 5), (100, 77), (127, 2), (max(n - 1, 0), 9), (n, 3)):
        assert (TF.decode_ids(data, first, count) == ids[first:first + count]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.arange(1280, dtype=np.uint32) % 16
    small = len(TF.encode_ids(ids))
    ids[5] = 2**31
    assert len(TF.encode_ids(ids)) == small + 5  # one exception: value and position


def test_bad_magic():
    with pytest.raises(ValueError):
        TF.decode_ids(b"x" * 40)


ODD = ["", " ", "all 's it'll I'M 5\xb2\xbd \xaa\xb5\xba\xd7\xf7\xbf\xc0\xde\xdf \x85 \xa0x", "A<|endoftext|>B c", "<|STARTOFTEXT|>", "H\u0331 ABC\u0301",
       "a  b\t\nc", "\u03a3\u0391\u03a3 x", "it's 123 don't we're!'s ''s 'sam 'tis x'", "r", "'", "s'", "\uac00 \u11a8", "a\r\nb", "\x00a\x1cb", "'ve'll're'"]


def test_encoder_equals_the_library_on_odd_texts(plain):
    for texts in (ODD, ODD[::-1], [t for t in ODD if tokens.latin(t) is not None]):
        ids, n = tokens.encoder(PATH).encode(texts)
        ends = np.cumsum(n)
        for i, t in enumerate(texts):
            assert ids[ends[i] - n[i]:ends[i]].tolist() == plain.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="aA'stredvlm 1\xb2\n\xe9!", max_size=40)), max_size=5))
def test_encoder_equals_the_library(texts):
    raw = Tokenizer.from_file(PATH) if not hasattr(test_encoder_equals_the_library, "t") else test_encoder_equals_the_library.t
    test_encoder_equals_the_library.t = raw
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, n = tokens.encoder(PATH).encode(texts)
    assert ids.tolist() == [i for t in texts for i in raw.encode(t, add_special_tokens=False).ids]
    assert n.tolist() == [len(raw.encode(t, add_special_tokens=False).ids) for t in texts]


def _expected(rows, plain):
    out, at = [], 0
    for doc_id, text in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_against_plain_encoding(llm, plain):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta,", "gamma", "don't", "\xe9t\xe9", "42", "\u6771\u4eac", "x"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 40_000), (-5, "first")]
    docs = llm.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as start", "'x' as payload").repartition(5)
    path = scratch(llm, "t")
    TF.write_token_files(docs, path, PATH, 2, segment_ids=700)
    got = sorted(map(tuple, TF.read_token_files(llm, path).collect()))
    assert got == _expected(sorted(rows), plain)


def test_repeated_rows_null_ids_and_no_rows(llm, plain):
    path = scratch(llm, "t")
    docs = llm.createDataFrame([(7, "a b"), (7, "a b"), (7, "c"), (None, "z z")], "doc_id long, text string")
    TF.write_token_files(docs, path, PATH, 2)
    got = TF.read_token_files(llm, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 7, 7, 7]
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    path = scratch(llm, "t")
    TF.write_token_files(docs.limit(0), path, PATH, 2)
    assert TF.read_token_files(llm, path).count() == 0
