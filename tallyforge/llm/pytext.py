"""Word and shingle hashing for the operators that work on Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import LOWER, UPPER, WORD

_FIND = re.compile(WORD).findall
_FOLD = str.maketrans(UPPER, LOWER)
#: A worker keeps the hashes of so many words at most.
KEPT_WORDS = 200_000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


#: What this worker remembers, for whichever operator.
_MEMORIES: list[dict] = []


def memory(kept: dict) -> dict:
    """Register what an operator remembers between batches."""
    _MEMORIES.append(kept)
    return kept


def tidy(*kept: dict) -> None:
    """Forget what operators remembered and give free memory back: an idle worker shares its executor's memory with the JVM."""
    for other in _MEMORIES:
        if all(other is not x for x in kept):
            other.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(batches: Callable, kept: Callable[[], tuple] = tuple) -> Callable:
    """The function of Arrow batches, with `tidy` before its first batch and after its last."""

    def each(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(*kept())
        try:
            yield from batches(given)
        finally:
            tidy(*kept())

    return each


class WordHashes(dict):
    """64-bit hash of a word, remembered while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = memory(WordHashes())


def find_words(text: str | None) -> list[str]:
    """A-Z lower-cased, then the runs of digits, letters and non-ASCII characters."""
    return _FIND(text.translate(_FOLD)) if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of `size` words; a text of fewer words is one run, one of none has none."""
    found = find_words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - size + 1)
    s = h[:n].copy()
    for k in range(1, min(size, len(h))):
        s = s * _STEP + h[k : k + n]
    return np.unique(mixed(s))
