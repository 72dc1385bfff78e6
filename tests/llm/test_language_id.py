import random

import pytest

from restate.llm import language_id as L

WORDS = {"xx": ["kolu", "maneta", "sirop", "tavile", "ruk"], "yy": ["schwe", "thran", "bloch", "grund", "peltz"]}


def _text(lang, n, seed):
    return " ".join(random.Random(seed).choices(WORDS[lang], k=n))


def _examples(spark, n=60):
    return spark.createDataFrame([(i, _text(lang, 40, f"{lang}{i}"), lang) for lang in WORDS for i in range(n)], "doc_id long, text string, lang string")


def test_tells_languages_apart_and_rejects(llm):
    fitted = L.fit(_examples(llm))
    assert set(fitted) == {"xx", "yy"}
    rows = [(1, _text("xx", 30, 1)), (2, _text("yy", 30, 2)), (3, None), (4, ""), (5, "123 !! \n 4"), (6, _text("yy", 60_000, 3)),
            (1, _text("xx", 30, 1)), (7, _text("xx", 20, 4).upper() + "!!! ###"), (8, "q")]
    docs = llm.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "9 as score", "'q' as lang_pred")
    got = L.identify(docs, fitted).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 7)] == ["xx", "yy", "und", "und", "und", "yy", "xx"]
    assert all(by[i].rejected and by[i].score == 0 for i in (3, 4, 5))
    assert not by[1].rejected and not by[6].rejected and by[8].rejected  # one letter: no margin
    assert all(0 <= r.score <= 1 for r in got)


def test_null_languages_and_no_examples(llm):
    ex = _examples(llm, 5).selectExpr("doc_id", "text", "case when lang = 'yy' then null else lang end as lang")
    assert set(L.fit(ex)) == {"xx"}
    assert L.fit(ex.limit(0)) == {}
    got = L.identify(ex.select("doc_id", "text").limit(2), {}).collect()
    assert [(r.lang_pred, r.rejected) for r in got] == [("und", True)] * 2
    assert L.identify(ex.limit(0), {"xx": b"abc"}).count() == 0


def test_fit_is_bounded_and_repeatable(llm):
    ex = _examples(llm)
    assert L.fit(ex, texts=3) == L.fit(ex.repartition(7), texts=3)
    assert all(len(v) <= 100 for v in L.fit(ex, dict_bytes=100).values())


def test_whole_text_counts(llm):
    """The language of the long rest decides, not that of the beginning."""
    fitted = L.fit(_examples(llm))
    docs = llm.createDataFrame([(1, _text("xx", 300, 5) + " " + _text("yy", 3000, 6))], "doc_id long, text string")
    assert L.identify(docs, fitted).first().lang_pred == "yy"


def test_held_out_accuracy(llm, spark):
    from pyspark.sql import functions as F

    from restate.llm.common import held_out, table
    from restate.llm.queries import op3_language_id
    got = op3_language_id(llm, "/root/testdata/sf0.01").where("held_out").join(
        table(llm, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert got.where(~held_out("doc_id")).count() == 0


def test_languages_of_long_texts_only_and_repeated_rows(llm):
    rows = [(i, "lange worte und noch mehr davon " * 900, "de") for i in range(5)] + [(100 + i, f"short words {i} and more of them", "en") for i in range(60)]
    rows += [(200, "le texte que voici", "fr")] * 4000
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.fit(docs, texts=20)
    assert sorted(got) == ["de", "en", "fr"] and got["fr"] == b"le texte que voici"
    assert 0 < len(got["de"]) <= 5 * L.TRAIN_CHARS
    assert L.fit(docs.repartition(7), texts=20) == got


def test_sizes_against_plain_compression():
    import zstandard

    known = {"a": b"the words of one tongue and its words " * 20, "b": b"mots de la langue et des mots encore " * 20}
    text = b"words of a tongue the tongue of words " * 200
    sizes = {}
    for lang, content in known.items():
        z = zstandard.ZstdCompressor(level=L.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                                     write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes[lang] = sum(len(z.compress(text[i:i + L.PIECE_BYTES])) for i in range(0, len(text), L.PIECE_BYTES))
    lang, score, margin = L.judge(text, known)
    best, other = sorted(sizes.values())
    assert lang == min(sizes, key=sizes.get) == "a" and margin == pytest.approx((other - best) / best, abs=0.02) and score > 0.5
