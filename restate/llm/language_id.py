"""Language identification by compression.

For each language a zstandard raw-content dictionary is filled with known texts
of that language.  A text is compressed with every dictionary; the language whose
dictionary makes it smallest wins, and a narrow margin to the second rejects it.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from restate.llm.common import bounded_sample

#: Bytes of a dictionary, and the bound of the fit: texts looked at for each
#: language, none of them longer than TRAIN_CHARS.
DICT_BYTES = 512 * 1024
TRAIN_TEXTS, TRAIN_CHARS = 400, 20_000
#: Bytes that are compressed at a time, so that a long text keeps leaning on the
#: dictionary and not on its own beginning; the sizes of all its pieces are added.
PIECE_BYTES = 2048
LEVEL = 6
#: A lead below this share is settled by the sum of the sizes of two levels: sizes are whole
#: bytes, and of a short text those of one level often tie.
SECOND_LEVEL, SETTLE = 12, 0.02
#: A text below this many bytes is repeated up to them: zstandard stores what it can't shrink as it
#: is, which would make all languages equal.
SHORT_BYTES = 64
#: Rejected below this lead, as a share of the winner's size.
MIN_MARGIN = 0.003
UNKNOWN = "und"

_LETTERS_ONLY = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: str) -> bytes:
    """Lower case, ASCII other than letters as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(examples: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        texts: int = TRAIN_TEXTS, max_chars: int = TRAIN_CHARS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary content by language, from at most ``texts`` examples of each.

    Examples with a null language or no text are left out; of a text over
    ``max_chars`` a piece of that length counts, which bounds what reaches the driver.  Which
    ones are taken depends on a hash of id and text only.  No examples: no languages.
    """
    rows = examples.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"),
                           F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    rows = rows.where(F.col("l").isNotNull() & (F.length("t") > 0))
    # whole texts first, by hash alone: the least hashes of each language, cut at a threshold before they are ranked, so that a
    # language that most rows have sends its ranking few of them
    order = F.struct((F.length("t") > max_chars).alias("long"), F.col("h").alias("h"))
    keys = rows.select("l", order.alias("o")).distinct()
    # a row a language, as the model has a dictionary for each
    whole = {r["l"]: r["n"] for r in keys.groupBy("l").agg(F.count_if(~F.col("o.long")).alias("n")).collect()}
    full = [x for lang, n in whole.items() if n >= texts for x in (F.lit(lang), F.lit(min(1.0, (4.0 * texts + 1000) / n)))]
    if full:
        share = F.create_map(*full)[F.col("l")]
        low = (F.col("o.h").cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64) <= share
        keys = keys.where(share.isNull() | (~F.col("o.long") & low))
    chosen = bounded_sample(keys.select("l", "o"), "l", F.col("o"), texts).select("l", F.col("o.h").alias("h"))
    # one row a hash, however often it is repeated; the hashes, bounded for each language, are broadcast
    picked = rows.join(F.broadcast(chosen), ["l", "h"]).groupBy("l", "h").agg(F.min(F.substring("t", 1, max_chars)).alias("t"))
    texts_of = picked.collect()
    parts: dict[str, list[bytes]] = {}
    for lang, _, text in sorted({(r["l"], r["h"], r["t"]) for r in texts_of}):
        parts.setdefault(lang, []).append(normalise(text))
    return {lang: b" ".join(p)[:dict_bytes] for lang, p in sorted(parts.items()) if any(p)}


@lru_cache(maxsize=None)
def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    """One per worker process, language and level: digesting a dictionary takes longer than a small task."""
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=False, write_content_size=False, write_dict_id=False)


_held: set[bytes] = set()


def _keep_only(dictionaries: dict[str, bytes]) -> None:
    """A worker process serves many jobs: drop the compressors of another job's dictionaries."""
    if _held != set(dictionaries.values()):
        _compressor.cache_clear()
        _held.clear()
        _held.update(dictionaries.values())


def judge(content: bytes, dictionaries: dict[str, bytes]) -> tuple[str, float, float]:
    """Language, score and margin of one normalised text.  Ties go to the first language in order."""
    if len(content) < SHORT_BYTES:
        content = b" ".join([content] * -(-SHORT_BYTES // (len(content) + 1)))
    view = memoryview(content)
    pieces = [view[i:i + PIECE_BYTES] for i in range(0, len(view), PIECE_BYTES)]

    def measure(*levels: int) -> list[tuple[int, str]]:
        return sorted((sum(len(c.compress(p)) for c in [_compressor(d, x) for x in levels] for p in pieces), lang)
                      for lang, d in dictionaries.items())

    sizes = measure(LEVEL)
    if len(sizes) > 1 and sizes[1][0] < sizes[0][0] * (1 + SETTLE):
        sizes = measure(LEVEL, SECOND_LEVEL)
    best, lang = sizes[0]
    score = 1 / sum(math.exp(min(0.0, (best - s) / 4)) for s, _ in sizes)
    return lang, score, (sizes[1][0] - best) / best if len(sizes) > 1 else 1.0


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score, margin and rejected; whole texts, any length.

    ``und`` with score 0, rejected: a null or empty text, a text without a
    letter, or no dictionaries.  Columns of ``docs`` with these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "margin", "rejected")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_only(dictionaries)
        for batch in batches:
            out = []
            for value in batch.column(at):
                text = value.as_py()
                if not dictionaries or not has_letter(text):
                    out.append((UNKNOWN, 0.0, 0.0))
                else:
                    out.append(judge(normalise(text) or unicodedata.normalize("NFC", text).encode(), dictionaries))
            langs, scores, margins = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()),
                 pa.array([p == UNKNOWN or m < min_margin for p, m in zip(langs, margins)], pa.bool_())],
                names=[*batch.schema.names, "lang_pred", "score", "margin", "rejected"])

    schema = StructType(list(docs.schema.fields))
    schema.add("lang_pred", "string").add("score", "double").add("margin", "double").add("rejected", "boolean")
    return docs.mapInArrow(run, schema)
