"""Secret scans: fixed patterns, and strings in a sensitive context that do not compress.

Base spans are the matches of the patterns below.  The method adds strings that follow a sensitive word
closely and are new to a compressor: a candidate's novelty is the number of bytes that it adds to the
zstandard frame of its surroundings, each frame primed with a dictionary of identifiers, by its length.
Words, paths and names that stand nearby or in the dictionary add little; keys add nearly all
their bytes.  The dictionary holds the words most frequent around sensitive words, counted over
all documents; words with digits are not counted, so that a copied key does not get into it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from statistics import median

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, and the characters at least: of the second group, of the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_CHARS = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ["assign", "access", "hex", "novel"]

#: Words after which a string is looked at, as far as so many characters; strings looked at.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|credential|bearer|auth|(?:api|access|private|signing|account)[ _-]?key", re.I | re.A)
REACH = 48
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters before and after a candidate that it is compressed with, one after the other (the median counts: a frame
#: may change its coding for a few bytes); bytes a character that make it a secret.
SURROUNDINGS, MIN_NOVELTY = (512, 256, 64), 0.6
#: Of the dictionary: characters around a sensitive word whose words are counted, words, zstandard's level.
WINDOW, WORDS, LEVEL = 256, 8192, 6

_NEEDLES = ("pass", "pwd", "secret", "token", "credential", "bearer", "auth", "key")
_IDENTIFIER = re.compile(r"[A-Za-z0-9_]+")
_SPANS = "array<struct<kind:string,start:long,end:long,novelty:double>>"


def _sensitive(text: str) -> list[re.Match]:
    """Sensitive words; the substring test leaves most texts to no pattern."""
    low = text.lower()
    return list(SENSITIVE.finditer(text)) if any(n in low for n in _NEEDLES) else []


def _windows(text: str) -> Iterator[str]:
    """Text around sensitive words; windows that overlap are one."""
    start = end = -1
    for m in _sensitive(text):
        a, b = max(0, m.start() - WINDOW), m.end() + WINDOW
        if a > end:
            if end >= 0:
                yield text[start:end]
            start = a
        end = b
    if end >= 0:
        yield text[start:end]


def _count_identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            if text:
                counts.update({w for part in _windows(text) for w in _IDENTIFIER.findall(part)
                               if 3 <= len(w) <= 32 and not any(c.isdigit() for c in w)})
            if len(counts) > 200_000:
                yield rows(counts)
                counts = Counter()
    yield rows(counts)


def fit(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> bytes:
    """The identifier dictionary: the ``words`` words in most documents around sensitive words, the most frequent last."""
    counted = docs.select(text_col).mapInArrow(_count_identifiers, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(words).collect()
    return " ".join(r["word"] for r in reversed(top)).encode()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping in each kind, by start and kind."""
    low = text.lower()
    found = []
    if any(n in low for n in ("pass", "secret", "token", "api")):
        found = [("assign", *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of strings that begin within reach after a sensitive word and overlap no base span.

    Leftmost and non-overlapping; a sensitive word inside of a string found starts none of its own."""
    found: list[tuple[int, int]] = []
    for m in _sensitive(text):
        at = m.end()
        while not found or at >= found[-1][1]:
            c = CANDIDATE.search(text, at, m.end() + REACH + 16)
            if c is None:
                break
            found.append(CANDIDATE.match(text, c.start()).span())
            at = found[-1][1]
    taken: list[list[int]] = []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    return [(a, b) for a, b in found if not (i := bisect_left(starts, b)) or taken[i - 1][1] <= a]


class Novelty:
    """Marginal compressed bytes, a character of the candidate, under a dictionary of identifiers."""

    def __init__(self, dictionary: bytes):
        primed = None
        if len(dictionary) >= 8:
            primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            primed.precompute_compress(LEVEL)
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False)

    def _margin(self, text: str, start: int, end: int, around: int) -> int:
        before, after = text[max(0, start - around):start].encode(), text[end:end + around].encode()
        return len(self._zstd.compress(before + text[start:end].encode() + after)) - len(self._zstd.compress(before + after))

    def __call__(self, text: str, start: int, end: int) -> float:
        return median(self._margin(text, start, end, n) for n in SURROUNDINGS) / (end - start)


def scan_text(text: str | None, novelty: Novelty) -> list[dict]:
    """All spans of a text with their novelty, by start and kind."""
    if not text:
        return []
    base = base_spans(text)
    spans = [(k, a, b, novelty(text, a, b)) for k, a, b in base]
    for a, b in candidates(text, base):
        value = novelty(text, a, b)
        if value >= MIN_NOVELTY:
            spans.append(("novel", a, b, value))
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [{"kind": k, "start": a, "end": b, "novelty": n} for k, a, b, n in spans]


def scan(docs: DataFrame, dictionary: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): a row for every row of ``docs``, repeated and null ids too.

    ``spans`` holds kind, start and end in code points (end exclusive) and novelty, by start, then kind.
    A null or empty text has none; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            spans = [scan_text(t.as_py(), novelty) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW_SPANS)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, spans {_SPANS}")


_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())]))
