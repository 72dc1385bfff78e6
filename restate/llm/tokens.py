"""Token ids of whole texts with the ``tokenizers`` library, a memo of word runs before it.

The word vocabulary lower-cases, drops white space and encodes each run of letters,
number or run of other characters by itself.  Runs repeat far more than texts do:
each one is encoded by the library once, and the ids of a text are gathered from a
table.  Runs are cut and named (by a 64-bit hash) for a chunk of text at a
time in numpy, without a Python loop over them.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from restate.llm import textarrays as T

#: Runs the memo keeps before it starts anew, and those that are encoded in one call.
MEMO_RUNS, LEARN_RUNS = 1_000_000, 500
WORD_END = "</w>"

# Fixed values of the vocabulary's pre-tokenizer, for text below U+0100: classes of characters
# (0 white space, 1 letter, 2 number, 3 other), lower case, and the endings that stay with an apostrophe.
SPACE, LETTER, NUMBER, OTHER = range(4)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = SPACE
_CLASS[[*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[[*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]] += 32
_APOSTROPHE, _AFTER_1, _AFTER_2 = 0x27, b"stmd", (b"re", b"ve", b"ll")


def latin(text: str) -> bytes | None:
    """The text as bytes if all is below U+0100 (so in NFC) and no special token can be in it."""
    try:
        return None if "<|" in text else text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def cut_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of lower-cased Latin-1 texts; ``off`` has the texts' bounds."""
    n = len(data)
    kind = np.zeros(n + 1, np.uint8)  # one past the end is white space
    kind[:n] = _CLASS[data]
    start = np.zeros(n + 1, bool)
    start[0] = True
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    start[off] = True
    start &= kind != SPACE
    bound = np.zeros(n + 1, bool)
    bound[off] = True
    # an apostrophe that starts a run keeps the ending after it, and what follows that is a new run
    for i in np.flatnonzero(start[:n] & (data == _APOSTROPHE)).tolist():
        if i + 1 < n and kind[i + 1] == LETTER and not bound[i + 1]:
            size = 2 if data[i + 1] in _AFTER_1 else 3 if i + 2 < n and not bound[i + 2] and data[i + 1:i + 3].tobytes() in _AFTER_2 else 0
            if size:
                start[i + 1] = False
                start[i + size] |= kind[i + size] == LETTER
    end = (kind[:-1] != SPACE) & (start[1:] | (kind[1:] == SPACE) | bound[1:])
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class RunEncoder:
    """Flat ids of many texts.  Only for vocabularies of the kind above."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        vocabulary = self._tokenizer.get_vocab()
        self._ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_word[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self._reset()

    def _reset(self) -> None:
        self._slot: dict[int, int] = {}
        self._ids, self._used = np.zeros(1 << 16, np.uint32), 0
        self._start, self._len = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, names: list[int], runs: list[str]) -> None:
        """A run is one word to the vocabulary, so word ends tell the runs' ids apart."""
        flat = np.concatenate(self._library([" ".join(runs[i:i + LEARN_RUNS]) for i in range(0, len(runs), LEARN_RUNS)]))
        at, n = len(self._slot), len(runs)
        while len(self._start) < at + n:
            self._start, self._len = np.concatenate((self._start, self._start)), np.concatenate((self._len, self._len))
        while len(self._ids) < self._used + len(flat):
            self._ids = np.concatenate((self._ids, self._ids))
        lens = np.diff(np.flatnonzero(self._ends_word[flat]), prepend=-1)
        self._ids[self._used:self._used + len(flat)] = flat
        self._len[at:at + n] = lens
        self._start[at:at + n] = self._used + np.cumsum(lens) - lens
        self._used += len(flat)
        self._slot.update(zip(names, range(at, at + n)))

    def _latin(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        starts, ends = cut_runs(data, off)
        names, some, slot = np.unique(T.hash_spans(data, starts, ends).view(np.int64), return_index=True, return_inverse=True)
        names = names.tolist()
        new = [k for k, name in enumerate(names) if name not in self._slot]
        if new:
            self._learn([names[k] for k in new], [data[starts[i]:ends[i]].tobytes().decode("latin-1") for i in some[new].tolist()])
        slot = np.array([self._slot[name] for name in names], np.int64)[slot]
        lens = self._len[slot]
        upto = np.concatenate(([0], np.cumsum(lens)))
        ids = self._ids[np.repeat(self._start[slot] - upto[:-1], lens) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(starts, off)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text)."""
        if len(self._slot) > MEMO_RUNS:
            self._reset()
        as_latin = [latin(t) for t in texts]
        ids, n = self._latin([b for b in as_latin if b is not None])
        if all(b is not None for b in as_latin):
            return ids, n
        # the others whole by the library
        others = iter(self._library([t for t, b in zip(texts, as_latin) if b is None]))
        known = iter(np.split(ids, np.cumsum(n)[:-1]))
        parts = [next(others if b is None else known) for b in as_latin]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


@lru_cache(maxsize=2)
def encoder(tokenizer_path: str) -> RunEncoder:
    """One per worker process: loading a vocabulary takes longer than a small task."""
    return RunEncoder(tokenizer_path)


def text_runs(texts: list[str | None], chars: int = T.CHUNK_BYTES):
    """Slices (first, texts) of at most ``chars`` characters, or one text; null texts are empty."""
    run, at, size = [], 0, 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > chars:
            yield at, run
            run, at, size = [], i, 0
        run.append(t)
        size += len(t)
    if run:
        yield at, run
